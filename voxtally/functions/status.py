"""Task states, error codes and messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RUNNING, COMPLETED, FAILED, NOT_FOUND = "running", "completed", "failed", "not_found"
TERMINAL = (COMPLETED, FAILED)

FETCH_FAILED, NO_REVIEWS, INSUFFICIENT, OK = (
    "fetch_failed", "no_reviews", "insufficient", "ok",
)
ANALYSIS_FAILED = "analysis_failed"

# The wording users of the service already see in stored errors.
FETCH_FAILED_TEXT = (
    "Error scraping reviews: Failed to find URL on Trustpilot, please use alternative URL "
    "or search for another company. Status code: %s"
)
NO_REVIEWS_TEXT = "Error scraping reviews: No reviews found for this company"
INSUFFICIENT_TEXT = (
    "Found %d reviews, but %d are required. Please try searching for an alternative URL "
    "on trustpilot.com or search for another company."
)
INSUFFICIENT_NOTICE = (
    "There are not enough reviews for the selected URL on Trustpilot. Check for an "
    "alternative URL on trustpilot.com or search for another company."
)
MISSING_URL_TEXT = "No company URL provided"
INVALID_URL_TEXT = "Invalid company URL format"
TIMEOUT_TEXT = "Analysis timed out after 3 minutes"
FAILED_TEXT = "Analysis failed"
UNKNOWN_TITLE_TEXT = "No product has this title"


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def task_id(subject: Column, ts_micros: Column) -> Column:
    """Repeatable task id. A live service may use ``F.uuid()`` instead."""
    return F.md5(F.concat_ws("|", subject, ts_micros.cast("string")))


def url_reject_reason(raw: Column, cleaned: Column) -> Column:
    """Null for an acceptable company URL, else the message shown to the user."""
    return F.when(F.coalesce(raw, F.lit("")) == "", MISSING_URL_TEXT).when(
        (cleaned == "") | ~cleaned.contains("."), INVALID_URL_TEXT
    )


def insufficient_message(found: Column, required: Column) -> Column:
    return F.format_string(INSUFFICIENT_TEXT, found, required)


def outcome_message(outcome: Column, found: Column, required: Column, code: Column) -> Column:
    """Message for each outcome but ``ok``; a page that was never saved has no code."""
    shown = F.coalesce(code.cast("string"), F.lit("None"))
    return (
        F.when(outcome == FETCH_FAILED, F.format_string(FETCH_FAILED_TEXT, shown))
        .when(outcome == NO_REVIEWS, F.lit(NO_REVIEWS_TEXT))
        .when(outcome == INSUFFICIENT, insufficient_message(found, required))
    )


def user_message(code: Column, error: Column) -> Column:
    """What the user is told; decided by code, never by searching the text."""
    return F.when(code == INSUFFICIENT, INSUFFICIENT_NOTICE).otherwise(
        F.coalesce(error, F.lit(FAILED_TEXT))
    )
