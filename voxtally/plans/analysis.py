"""Model-written analyses of products and companies, all subjects in one run.

Tasks run in stages: a stage needs the answers of the stages before it. Answers
are dear and never the same twice, so each stage is written to the shared folder
once, and later steps read that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from voxtally.functions.prompts import COMPANY_STAGES, CONTEXT_TASKS, PRODUCT_STAGES
from voxtally.functions.status import COMPLETED, FAILED
from voxtally.functions.text import company_name
from voxtally.operators.catalog import titles_to_parent
from voxtally.operators.insights import insight_bundle, map_prompts, prompt_table
from voxtally.operators.pages import (
    MIN_REVIEWS, REVIEW_CLASS, min_review_gate, page_limits, passing_reviews,
)
from voxtally.operators.reviews import TOP_REVIEWS, reviews_text_numbered, reviews_text_plain
from voxtally.operators.skew import salted_join
from voxtally.plans.flows import parsed_company_reviews
from voxtally.session import materialize

MakeModel = Callable[[], Callable[[str, str | None], str]]


def run_stages(
    subjects: DataFrame,
    stages: Sequence[Sequence[str]],
    make_model: MakeModel,
    concurrency: int | None = None,
) -> DataFrame:
    """Answers in long form: ``subject, task_pos, task, model, output, error, error_code``.

    A subject one of whose tasks failed gets no further tasks.
    """
    order = [task for stage in stages for task in stage]
    done: list[DataFrame] = []
    for stage in stages:
        waiting, contexts = subjects, {}
        if done:
            known = reduce(DataFrame.unionByName, done)
            answers = known.groupBy("subject").pivot("task", order).agg(F.max("output"))
            failed = known.where(F.col("error").isNotNull()).select("subject").distinct()
            waiting = subjects.join(answers, "subject").join(failed, "subject", "left_anti")
            contexts = {t: F.concat_ws("\n", *CONTEXT_TASKS[t]) for t in stage}
        asked = prompt_table(waiting, stage, contexts, order)
        answered = map_prompts(asked, make_model, concurrency=concurrency).drop("prompt")
        done.append(materialize(answered, "answers"))
    return reduce(DataFrame.unionByName, done)


def analysis_result(answers: DataFrame, stages: Sequence[Sequence[str]]) -> DataFrame:
    """One row per subject: status, first error with its code, and the answers by position."""
    order = [task for stage in stages for task in stage]
    first = F.min_by(F.struct("error", "error_code"), F.when(F.col("error").isNotNull(), F.col("task_pos")))
    errors = answers.groupBy("subject").agg(first.alias("e")).select("subject", "e.*")
    status = F.when(F.col("error").isNull(), COMPLETED).otherwise(FAILED)
    return insight_bundle(answers, order).join(errors, "subject").withColumn("status", status)


def product_subjects(
    reviews: DataFrame, metadata: DataFrame, titles: DataFrame | None = None, k: int = TOP_REVIEWS
) -> DataFrame:
    """``subject, title, features, reviews`` for the asked titles, or for all.

    Reviews of products nobody asked for are dropped before they are ranked.
    """
    chosen = metadata if titles is None else metadata.join(titles.distinct(), "title", "left_semi")
    products = titles_to_parent(chosen, "features")
    wanted = products.select("parent_asin").distinct()
    mine = salted_join(reviews, wanted, ["parent_asin"], "left_semi", F.col("id"))
    texts = reviews_text_numbered(mine, "parent_asin", k)
    return products.join(texts, "parent_asin", "left").select(
        F.col("title").alias("subject"), "title", "features", F.col("reviews_text").alias("reviews")
    )


def analyze_products(
    reviews: DataFrame,
    metadata: DataFrame,
    make_model: MakeModel,
    titles: DataFrame | None = None,
    k: int = TOP_REVIEWS,
    concurrency: int | None = None,
) -> DataFrame:
    """Praised features, pain points and improvement for each title."""
    subjects = materialize(product_subjects(reviews, metadata, titles, k), "product-subjects")
    return analysis_result(
        run_stages(subjects, PRODUCT_STAGES, make_model, concurrency), PRODUCT_STAGES
    )


def analyze_companies(
    pages: DataFrame,
    make_model: MakeModel,
    tag: str = "div",
    css_class: str | None = REVIEW_CLASS,
    max_pages: int | None = None,
    n: int = MIN_REVIEWS,
    concurrency: int | None = None,
    companies: DataFrame | None = None,
) -> DataFrame:
    """Profile, strengths, challenges and strategy for each company that passes the gate.

    ``companies`` (cleaned, in ``company``) are those asked for, all saved ones without it.
    A company that does not pass has status ``failed``, the gate's message, and the gate's
    outcome as error code; one of which no page was saved has failed to be fetched.
    """
    if companies is not None:
        companies = materialize(companies.select("company").distinct(), "companies")
        pages = pages.join(companies, "company", "left_semi")
    parsed = parsed_company_reviews(pages, tag, css_class, max_pages)
    outcomes = materialize(
        min_review_gate(pages if companies is None else companies, parsed, page_limits(pages, max_pages), n), "outcomes"
    )
    texts = reviews_text_plain(passing_reviews(parsed, outcomes))
    passed = outcomes.where(F.col("message").isNull()).select("company").join(texts, "company", "left")
    subjects = materialize(
        passed.select(
            F.col("company").alias("subject"),
            company_name(F.col("company")).alias("company"),
            F.col("reviews_text").alias("reviews"),
        ),
        "company-subjects",
    )
    answers = run_stages(subjects, COMPANY_STAGES, make_model, concurrency)
    refused = outcomes.where(F.col("message").isNotNull()).select(
        F.col("company").alias("subject"), F.lit(FAILED).alias("status"),
        F.col("message").alias("error"), F.col("outcome").alias("error_code"),
    )
    return analysis_result(answers, COMPANY_STAGES).unionByName(refused, allowMissingColumns=True)
