"""The product flow and the company flow, each over all subjects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.prompts import COMPANY_TASKS, PRODUCT_TASKS
from voxtally.functions.text import company_name
from voxtally.operators.insights import point_text, prompt_table
from voxtally.operators.mining import (
    PROFILE_FIELDS, STRATEGY_K, company_profile, improvement_candidate, mine_points, mine_unrated,
    most_helpful, page_position, point_lists, product_points, with_context,
)
from voxtally.operators.pages import (
    MIN_REVIEWS, REVIEW_CLASS, company_reviews, min_review_gate, page_limits, passing_reviews,
)
from voxtally.operators.reviews import TOP_REVIEWS, reviews_text_numbered, reviews_text_plain
from voxtally.session import materialize


def _wide(subjects: DataFrame, *texts: Column) -> DataFrame:
    """One text column per task, by position."""
    return subjects.select("subject", *(c.alias(f"output_{i}") for i, c in enumerate(texts)))


def _outputs(subjects: DataFrame, tasks: tuple[str, ...], *texts) -> DataFrame:
    """Long form (subject, task_pos, task, output) from one text column per task."""
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("task_pos"), F.lit(t).alias("task"), c.alias("output"))
            for i, (t, c) in enumerate(zip(tasks, texts))
        )
    )
    return subjects.select("subject", F.inline(rows))


def _product_texts() -> tuple[Column, ...]:
    proposal = F.concat(F.lit("Improve "), F.col("improve_term"))
    return point_text(F.col("praise")), point_text(F.col("pain")), proposal


def product_outputs(lists: DataFrame, best: DataFrame | None, products: DataFrame) -> DataFrame:
    """The three findings of every product in long form."""
    return _outputs(improvement_candidate(lists, best, products), PRODUCT_TASKS, *_product_texts())


def product_insights(
    reviews: DataFrame, products: DataFrame, mined_k: int | None = None
) -> DataFrame:
    """One row per product: praised features, pain points, improvement.

    ``reviews``: subject, id, rating, helpful_vote, text. ``products``: subject,
    title, features. All reviews are mined, or the ``mined_k`` most helpful of each.
    """
    found = product_points(most_helpful(reviews, mined_k), products)
    return _wide(improvement_candidate(found, None, products), *_product_texts())


def product_prompt_table(
    reviews: DataFrame, products: DataFrame, k: int = TOP_REVIEWS, mined_k: int | None = None
) -> DataFrame:
    """Prompts of the three product tasks, the third with the findings as context.

    A prompt holds the ``k`` most helpful reviews; findings are mined from all of them, or ``mined_k``.
    """
    texts = reviews_text_numbered(reviews, "subject", k).withColumnRenamed(
        "reviews_text", "reviews"
    )
    lists = point_lists(mine_points(most_helpful(reviews, mined_k)))
    findings = with_context(products, texts, lists)
    context = F.concat_ws("\n", point_text(F.col("pain")), point_text(F.col("praise")))
    return prompt_table(findings, PRODUCT_TASKS, {"improvement": context})


def profile_text() -> Column:
    return F.concat_ws(
        "\n",
        *(
            F.concat(F.lit(name.replace("_", " ") + ": "), F.col(name))
            for name in PROFILE_FIELDS
        ),
    )


def _company_texts() -> tuple[Column, ...]:
    strategy = F.array_join(
        F.transform(
            F.slice("pain", 1, STRATEGY_K), lambda p: F.concat(F.lit("Improve "), p["term"])
        ),
        "\n",
    )
    return (
        profile_text(), point_text(F.col("praise")), point_text(F.col("pain")),
        F.when(F.size("pain") > 0, strategy),
    )


def company_outputs(lists: DataFrame, profiles: DataFrame) -> DataFrame:
    """The four findings of every company in long form; ``profiles`` lists the companies."""
    return _outputs(with_context(profiles, lists), COMPANY_TASKS, *_company_texts())


def parsed_company_reviews(
    pages: DataFrame,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    max_pages: int | None = None,
) -> DataFrame:
    """Reviews of every company, written out once: later steps read them several times."""
    return materialize(company_reviews(pages, tag, css_class, max_pages), "company-reviews")


def company_insights(
    pages: DataFrame,
    words: DataFrame,
    profiles: DataFrame,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    max_pages: int | None = None,
    n: int = MIN_REVIEWS,
) -> DataFrame:
    """Saved pages to one row per company that passes the review gate.

    ``words`` (word, weight) rates the scraped reviews, which carry no rating;
    ``profiles`` has subject and the four profile fields.
    """
    parsed = parsed_company_reviews(pages, tag, css_class, max_pages)
    outcomes = min_review_gate(pages, parsed, page_limits(pages, max_pages), n)
    reviews = passing_reviews(parsed, outcomes)
    lists = point_lists(company_points(reviews, words))
    passed = outcomes.where(F.col("outcome") == "ok").select(F.col("company").alias("subject"))
    return _wide(with_context(company_profile(passed, profiles), lists), *_company_texts())


def company_points(reviews: DataFrame, words: DataFrame) -> DataFrame:
    """Points of scraped reviews, which a word table rates."""
    placed = reviews.where(F.col("company").isNotNull()).select(
        F.col("company").alias("subject"), page_position(F.col("page_no"), F.col("pos")).alias("ord"), "text"
    )
    return mine_unrated(placed, words)


def company_prompt_table(
    reviews: DataFrame, lists: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Prompts of the four company tasks, the last with all findings as context."""
    texts = reviews_text_plain(reviews).select(
        F.col("company").alias("subject"), F.col("reviews_text").alias("reviews")
    )
    findings = with_context(profiles, texts, lists)
    context = F.concat_ws(
        "\n", profile_text(), point_text(F.col("praise")), point_text(F.col("pain"))
    )
    return prompt_table(
        findings.withColumn("company", company_name(F.col("subject"))),
        COMPANY_TASKS,
        {"strengths": profile_text(), "challenges": profile_text(), "strategy": context},
    )
