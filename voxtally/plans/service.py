"""From a request to its page: analyses run, are logged, and the newest result is served.

A request becomes a task: a ``running`` row in the log, then ``completed`` with the answers
or ``failed`` with text and code. The log is only appended to, so it is also what the task
streams read. A page joins what is known of a subject to its newest completed task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.functions.prompts import COMPANY_TASKS, PRODUCT_TASKS
from voxtally.functions.status import (
    ANALYSIS_FAILED, FAILED, FETCH_FAILED, FETCH_FAILED_TEXT, NOT_FOUND, UNKNOWN_TITLE_TEXT, task_id,
)
from voxtally.functions.times import epoch_micros
from voxtally.operators.catalog import as_card, titles_to_parent
from voxtally.operators.pages import validate_companies
from voxtally.operators.tasks import latest_completed, latest_per_key, start_tasks
from voxtally.plans.analysis import MakeModel, analyze_companies, analyze_products
from voxtally.schemas import ANALYSIS_LOG_SCHEMA
from voxtally.session import materialize

PRODUCT, COMPANY = "product", "company"
CARD = ("main_category", "average_rating", "rating_number", "price")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(ANALYSIS_LOG_SCHEMA).parquet(log_path)


def _append(rows: DataFrame, kind: str, log_path: str) -> None:
    known = rows.withColumn("kind", F.lit(kind))
    none = {f.name: F.lit(None).cast(f.dataType) for f in ANALYSIS_LOG_SCHEMA if f.name not in known.columns}
    known.withColumns(none).select(*ANALYSIS_LOG_SCHEMA.names).write.mode("append").parquet(log_path)


def _run(
    subjects: DataFrame, kind: str, log_path: str, analyze: Callable[[DataFrame], DataFrame], missing: tuple[str, str],
    n_outputs: int, as_of: Column | None,
) -> DataFrame:
    """Logs and analyses ``subjects``; the states of their tasks come back.

    ``analyze`` gives a row per subject it knows; ``missing`` is text and code for the others.
    """
    spark = subjects.sparkSession
    clock = F.current_timestamp() if as_of is None else as_of
    asked = subjects.where(F.col("subject").isNotNull()).distinct().withColumn("ts", clock)
    started = start_tasks(asked, task_id(F.col("subject"), epoch_micros(F.col("ts"))), F.col("ts"))
    # Written, so that the ids and times are the same for all that follows.
    started = materialize(started, "tasks")
    _append(started, kind, log_path)
    ids = started.select("task_id", "subject")
    try:
        results = analyze(ids.select("subject"))
        outputs = F.array(*(F.col(f"output_{i}") for i in range(n_outputs)))
        known = results.select("subject", "status", "error", "error_code", outputs.alias("outputs"), F.lit(True).alias("known"))
        text, code = missing
        lost = F.col("known").isNull()
        ended = ids.join(known, "subject", "left").select(
            "task_id", "subject",
            F.when(lost, FAILED).otherwise(F.col("status")).alias("status"),
            F.when(lost, text).otherwise(F.col("error")).alias("error"),
            F.when(lost, code).otherwise(F.col("error_code")).alias("error_code"),
            F.when(F.col("status") != FAILED, F.col("outputs")).alias("outputs"),
        )
        _append(ended.withColumn("ts", clock), kind, log_path)
    except Exception as e:
        # The run itself broke: its tasks do not stay "running" for ever.
        broken = ids.select(
            "*", F.lit(FAILED).alias("status"), F.lit(str(e)[:1000] or type(e).__name__).alias("error"),
            F.lit(ANALYSIS_FAILED).alias("error_code"), clock.alias("ts"),
        )
        _append(broken, kind, log_path)
        raise
    return latest_per_key(read_log(spark, log_path).join(ids.select("task_id"), "task_id", "left_semi"))


def run_product_analyses(
    titles: DataFrame, reviews: DataFrame, metadata: DataFrame, make_model: MakeModel, log_path: str,
    as_of: Column | None = None, **kw,
) -> DataFrame:
    """A task for each of ``titles`` (column ``title``), from its first log row to its last.

    A title no product has fails as ``not_found``. ``kw`` goes to ``analyze_products``.
    """

    def analyze(subjects: DataFrame) -> DataFrame:
        return analyze_products(reviews, metadata, make_model, subjects.select(F.col("subject").alias("title")), **kw)

    subjects = titles.select(F.col("title").alias("subject"))
    return _run(subjects, PRODUCT, log_path, analyze, (UNKNOWN_TITLE_TEXT, NOT_FOUND), len(PRODUCT_TASKS), as_of)


def run_company_analyses(
    requests: DataFrame, pages: DataFrame, make_model: MakeModel, log_path: str, as_of: Column | None = None, **kw
) -> tuple[DataFrame, DataFrame]:
    """(states of the tasks, refused requests) for ``requests`` (column ``company_url``).

    Addresses are cleaned first; one that is refused makes no task and comes back with its
    reason. A company of which no page was saved fails as ``fetch_failed``. ``kw`` goes to
    ``analyze_companies``.
    """
    checked = validate_companies(requests)
    subjects = checked.where(F.col("reject_reason").isNull()).select(F.col("company").alias("subject"))

    def analyze(asked: DataFrame) -> DataFrame:
        return analyze_companies(pages, make_model, companies=asked.select(F.col("subject").alias("company")), **kw)

    unfetched = (FETCH_FAILED_TEXT % "None", FETCH_FAILED)
    states = _run(subjects, COMPANY, log_path, analyze, unfetched, len(COMPANY_TASKS), as_of)
    return states, checked.where(F.col("reject_reason").isNotNull())


def _newest(log: DataFrame, kind: str, tasks: tuple[str, ...]) -> DataFrame:
    done = latest_completed(log.where(F.col("kind") == kind))
    named = [F.get("outputs", F.lit(i)).alias(f"output_{i}") for i in range(len(tasks))]
    return done.select("subject", "ts", *named)


def product_pages(metadata: DataFrame, log: DataFrame) -> DataFrame:
    """Card and newest result of every product that has a completed analysis.

    The card is that of the product a title stands for; a title that has left the catalogue
    since keeps its result and has an empty card.
    """
    products = titles_to_parent(metadata, *CARD)
    found = _newest(log, PRODUCT, PRODUCT_TASKS).withColumnRenamed("subject", "title")
    cards = as_card(products).withColumn("listed", F.lit(True))
    page = found.join(cards, "title", "left")
    return page.withColumn("price", F.when(F.col("listed"), F.col("price"))).drop("listed")


def company_pages(log: DataFrame) -> DataFrame:
    """Newest result of every company that has a completed analysis."""
    return _newest(log, COMPANY, COMPANY_TASKS).withColumnRenamed("subject", "company")
