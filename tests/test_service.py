"""Model calls in bounded pieces, and requests that become logged tasks and pages."""

import sys
import threading
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxtally.functions import status as st
from voxtally.operators import insights, tasks
from voxtally.operators.insights import ModelFailure
from voxtally.plans import service
from voxtally.streaming import ingest, tasks as live

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = datetime(2024, 1, 1, 12)


class Recorder:
    """A model that notes calls, and how many are under way at once."""

    def __init__(self, pause=0.0):
        self.asked, self.under_way, self.most, self.pause = [], 0, 0, pause
        self.lock = threading.Lock()

    def __call__(self, prompt, model):
        with self.lock:
            self.asked.append(prompt)
            self.under_way += 1
            self.most = max(self.most, self.under_way)
        time.sleep(self.pause)
        with self.lock:
            self.under_way -= 1
        if prompt.endswith("3"):
            raise ModelFailure("refused", f"not {prompt}")
        if prompt.endswith("7"):
            raise KeyError
        return prompt * 2


def test_answers_leave_before_the_batch_ends():
    model = Recorder()
    batch = pd.DataFrame({"prompt": [str(i) for i in range(1000)]})
    pieces = insights.answered([batch], model, "prompt", None, 4, piece=4)
    rows, answers = next(pieces)
    assert list(rows["prompt"]) == ["0", "1", "2", "3"] and len(model.asked) <= 8
    assert answers[0] == ("00", None, None) and answers[3] == (None, "not 3", "refused")
    rest = [a for rows, found in pieces for a in zip(rows["prompt"], found)]
    assert [p for p, _ in rest] == [str(i) for i in range(4, 1000)]
    assert all(a == (p * 2, None, None) for p, a in rest if p[-1] not in "37")
    assert {a for p, a in rest if p.endswith("7")} == {(None, "KeyError", st.ANALYSIS_FAILED)}
    assert sorted(model.asked, key=int) == [str(i) for i in range(1000)]


def test_slow_answers_leave_after_a_while():
    model = Recorder(0.05)
    batch = pd.DataFrame({"prompt": [str(i) for i in range(20)]})
    pieces = [len(found) for _, found in insights.answered([batch], model, "prompt", None, 2, seconds=0.2)]
    assert sum(pieces) == 20 and len(pieces) > 1


def test_calls_are_under_way_together_and_bounded():
    model = Recorder(0.02)
    batch = pd.DataFrame({"prompt": [str(i) for i in range(40)]})
    start = time.perf_counter()
    list(insights.answered([batch, batch.head(0), batch.head(3)], model, "prompt", None, 8))
    assert 1 < model.most <= 8 and time.perf_counter() - start < 43 * 0.02 * 0.6


def test_a_task_has_a_bounded_number_of_prompts(spark):
    """So a task that runs again asks no more than these again; order within a row and errors stay."""

    def make():
        from uuid import uuid4

        task = uuid4().hex
        return lambda prompt, model: task

    df = spark.range(1000).select("id", F.col("id").cast("string").alias("prompt"))
    out = insights.map_prompts(df, make, model_col=None, rows_per_task=50)
    per_task = {r.output: r["count"] for r in out.groupBy("output").count().collect()}
    assert len(per_task) == 20 and max(per_task.values()) <= 60 and sum(per_task.values()) == 1000
    with pytest.raises(ValueError):
        insights.map_prompts(df, make, rows_per_task=5, concurrency=5)


def make_model():
    def answer(prompt, model):
        if "Lamp" in prompt:
            raise ModelFailure("quota", "no quota left")
        return f"{len(prompt)}"

    return answer


def catalogue(spark):
    reviews = spark.createDataFrame(
        [(1, "P1", 5.0, 1, "bright"), (2, "P2", 1.0, 1, "dim"), (3, "P3", 1.0, 1, "big")],
        "id long, parent_asin string, rating double, helpful_vote long, text string",
    )
    meta = spark.createDataFrame(
        [("P1", "Watch", 9, "[]", "c", 4.5, 2.0), ("P2", "Lamp", 9, "[]", "c", 4.0, None), ("P4", "Watch", 2, "[]", "d", 1.0, 1.0)],
        "parent_asin string, title string, rating_number long, features string, main_category string, average_rating double, price double",
    )
    return reviews, meta


def test_requests_become_pages(spark, tmp_path, rows):
    reviews, meta = catalogue(spark)
    log = str(tmp_path / "log")
    titles = spark.createDataFrame([("Watch",), ("Lamp",), ("Sofa",), ("Watch",), (None,)], "title string")
    states = service.run_product_analyses(titles, reviews, meta, make_model, log, F.lit(T0))
    assert rows(states, "subject", "status", "error_code") == [
        ("Lamp", "failed", "quota"), ("Sofa", "failed", st.NOT_FOUND), ("Watch", "completed", None),
    ]
    whole = service.read_log(spark, log)
    assert rows(tasks.status_counts(whole)) == [("completed", 1), ("failed", 2), ("running", 3)]
    assert rows(tasks.failure_log(tasks.latest_per_key(whole)), "subject", "user_message") == [
        ("Lamp", "no quota left"), ("Sofa", st.UNKNOWN_TITLE_TEXT),
    ]
    page = service.product_pages(meta, whole).collect()
    assert [(r.title, r.main_category, r.rating_number, r.price, r.ts) for r in page] == [("Watch", "c", 9, "$2.0", T0)]
    # A newer result takes the place of the older one; a title that left the catalogue keeps its result.
    later = T0 + timedelta(hours=1)
    service.run_product_analyses(titles.limit(1), reviews, meta, lambda: lambda prompt, model: "new", log, F.lit(later))
    page = service.product_pages(meta.where("title <> 'Watch'"), service.read_log(spark, log)).collect()
    assert [(r.title, r.price, r.ts, r.output_0, r.output_2) for r in page] == [("Watch", None, later, "new", "new")]


def test_the_log_feeds_the_task_streams(spark, tmp_path, rows):
    reviews, meta = catalogue(spark)
    log, out, point = (str(tmp_path / x) for x in ("log", "out", "cp"))
    titles = spark.createDataFrame([("Watch",), ("Lamp",)], "title string")
    service.run_product_analyses(titles, reviews, meta, make_model, log, F.lit(T0))
    stream = ingest.scan_stream(spark, log, service.ANALYSIS_LOG_SCHEMA)
    live.run_expiring_tasks(stream, out, point).awaitTermination()
    assert [r.status for r in live.read_live_tasks(spark, out).orderBy("status").collect()] == ["completed", "failed"]
    assert rows(live.read_snapshot(spark, out).where("status = 'completed'"), "subject")[0] == ("Watch",)
    assert len(live.read_snapshot(spark, out).where("status = 'completed'").first().outputs) == 3


def test_companies_fail_with_the_code_of_the_gate(spark, tmp_path, rows):
    def html(n):
        return "".join(f'<div class="rev">text {i}</div>' for i in range(n))

    pages = spark.createDataFrame(
        [("a.com", 1, 200, html(3)), ("b.com", 1, 200, html(1)), ("c.com", 1, 200, "<p></p>"), ("d.com", 1, 404, ""), ("e.com", 1, 200, html(9))],
        "company string, page_no int, status_code int, html string",
    )
    urls = ["https://www.A.com/x", "b.com", "c.com", "d.com", "f.com", "nodot", "", None, "a.com"]
    asked = spark.createDataFrame([(u,) for u in urls], "company_url string")
    log = str(tmp_path / "log")
    states, refused = service.run_company_analyses(
        asked, pages, lambda: lambda prompt, model: "ok", log, F.lit(T0), css_class="rev", n=2
    )
    assert rows(states, "subject", "status", "error_code") == [
        ("a.com", "completed", None), ("b.com", "failed", st.INSUFFICIENT), ("c.com", "failed", st.NO_REVIEWS),
        ("d.com", "failed", st.FETCH_FAILED), ("f.com", "failed", st.FETCH_FAILED),
    ]
    assert refused.count() == 3
    shown = dict(rows(tasks.failure_log(states), "subject", "user_message"))
    assert shown["b.com"] == st.INSUFFICIENT_NOTICE and shown["c.com"] == st.NO_REVIEWS_TEXT
    page = service.company_pages(service.read_log(spark, log)).collect()
    assert [(r.company, r.output_0, r.output_3) for r in page] == [("a.com", "ok", "ok")]


def test_a_run_that_breaks_leaves_no_task_running(spark, tmp_path, rows):
    reviews, meta = catalogue(spark)
    log = str(tmp_path / "log")
    titles = spark.createDataFrame([("Watch",)], "title string")

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        service.run_product_analyses(titles, reviews, meta, broken, log, F.lit(T0))
    state = tasks.latest_per_key(service.read_log(spark, log)).first()
    assert (state.status, state.error_code) == ("failed", st.ANALYSIS_FAILED) and "no model" in state.error
