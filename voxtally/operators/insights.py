"""Prompts, model runs and the insight table."""

from __future__ import annotations

import sys
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.prompts import build_prompt, route_model
from voxtally.functions.status import ANALYSIS_FAILED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROMPT_FIELDS = ("title", "features", "company", "reviews")
IN_FLIGHT = 8
#: Answers leave a task when there are so many, or after so many seconds.
PIECE, PIECE_SECONDS = 256, 1.0

Model = Callable[[str, str | None], str]
# Answer, error text and error code: the first, or the other two.
Answer = tuple[str | None, str | None, str | None]


class ModelFailure(Exception):
    """A failure that knows its kind; ``code`` goes to the log as it is."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message)
        self.code = code

    def __reduce__(self):
        return type(self), (self.code, str(self))


def point_text(points: Column) -> Column:
    """An array of points as one line each: rank, term and number of reviews.

    Null when there is no point.
    """
    lines = F.array_join(
        F.transform(
            points,
            lambda p: F.concat(
                p["rank"].cast("string"), F.lit(". "), p["term"], F.lit(" ("),
                p["own_df"].cast("string"), F.lit(")"),
            ),
        ),
        "\n",
    )
    return F.when(F.size(points) > 0, lines)


def prompt_table(
    subjects: DataFrame,
    tasks: Sequence[str],
    contexts: Mapping[str, Column] | None = None,
    order: Sequence[str] | None = None,
    key: str = "subject",
) -> DataFrame:
    """One row per subject and task: position, model and full prompt.

    ``subjects`` has the key and any of title, features, company, reviews;
    ``contexts`` gives the context of a task from its columns. ``order`` lists all
    tasks of the analysis when only some are asked for. The tasks are an array
    literal exploded in place, so nothing is joined or shuffled.
    """
    contexts = contexts or {}
    positions = list(order or tasks)
    fields = {f: F.col(f) if f in subjects.columns else F.lit(None) for f in PROMPT_FIELDS}
    rows = F.array(
        *(
            F.struct(
                F.lit(positions.index(task)).alias("task_pos"),
                F.lit(task).alias("task"),
                route_model(F.lit(task)).alias("model"),
                build_prompt(
                    task, **fields, context=contexts.get(task, F.lit(None))
                ).alias("prompt"),
            )
            for task in tasks
        )
    )
    return subjects.select(key, F.inline(rows))


def ask(model: Model, prompt: str, name: str | None) -> Answer:
    """One call. Any failure belongs to its row, with the kind the failure itself tells."""
    try:
        return model(prompt, name), None, None
    except Exception as e:
        return None, str(e) or type(e).__name__, getattr(e, "code", None) or ANALYSIS_FAILED


def in_order(calls: Iterable[tuple[str, str | None]], model: Model, pool: ThreadPoolExecutor, in_flight: int) -> Iterator[Answer]:
    """Answers in the order of the calls, with up to ``in_flight`` of them under way.

    A call is made only when the one ``in_flight`` places before it has been answered and
    taken, so calls never run further ahead of the reader.
    """
    waiting: deque = deque()
    for prompt, name in calls:
        if len(waiting) == in_flight:
            yield waiting.popleft().result()
        waiting.append(pool.submit(ask, model, prompt, name))
    while waiting:
        yield waiting.popleft().result()


def answered(
    batches: Iterable[pd.DataFrame], model: Model, prompt_col: str, model_col: str | None, in_flight: int,
    piece: int = PIECE, seconds: float = PIECE_SECONDS,
):
    """(rows, answers) in pieces of at most ``piece`` rows, handed on after ``seconds`` if that is sooner."""
    with ThreadPoolExecutor(in_flight) as pool:
        for batch in batches:
            names = batch[model_col] if model_col else [None] * len(batch)
            found: list[Answer] = []
            first, begun = 0, time.monotonic()
            for answer in in_order(zip(batch[prompt_col], names), model, pool, in_flight):
                found.append(answer)
                if len(found) == piece or time.monotonic() - begun >= seconds:
                    yield batch.iloc[first : first + len(found)], found
                    first, found, begun = first + len(found), [], time.monotonic()
            if found:
                yield batch.iloc[first:], found


def map_prompts(
    df: DataFrame,
    make_model: Callable[[], Model],
    prompt_col: str = "prompt",
    out_col: str = "output",
    model_col: str | None = "model",
    concurrency: int | None = None,
    in_flight: int = IN_FLIGHT,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Runs a user's text model over a prompt table: adds the answer, ``error`` and ``error_code``.

    ``make_model`` is called once per task and returns ``f(prompt, model)``, which a task
    calls from ``in_flight`` threads (1 for a model that bears one call at a time). A call
    that raises fills error and code for its row and leaves the others alone. Answers
    leave the task after ``PIECE_SECONDS``, or when there are ``PIECE``, and it holds no more.

    ``concurrency`` is the number of tasks; with ``in_flight`` it bounds the calls at a
    time. ``rows_per_task`` cuts the table into tasks of about that many rows instead: a
    task that is lost with its executor asks those prompts again, and no others.
    """
    if concurrency and rows_per_task:
        raise ValueError("give concurrency or rows_per_task, not both")
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, answers in answered(batches, make_model(), prompt_col, model_col, in_flight):
            output, error, code = zip(*answers)
            yield rows[names].assign(**{out_col: list(output), "error": list(error), "error_code": list(code)})

    if rows_per_task:
        concurrency = max(1, -(-df.count() // rows_per_task))
    dealt = df.repartition(concurrency) if concurrency else df
    return dealt.mapInPandas(run, f"{schema}, `{out_col}` string, `error` string, `error_code` string")


def insight_bundle(
    outputs: DataFrame, tasks: Sequence[str], key: str = "subject", value: str = "output"
) -> DataFrame:
    """One row per subject with its task outputs by position: ``output_0``, ``output_1`` ...

    ``outputs`` has one row per subject and task. The positions are given, so no
    extra job looks for them.
    """
    positions = list(range(len(tasks)))
    wide = outputs.groupBy(key).pivot("task_pos", positions).agg(F.max(value))
    return wide.select(key, *(F.col(str(i)).alias(f"output_{i}") for i in positions))
