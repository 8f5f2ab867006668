"""Registered queries beside their SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import queries
from voxtally.llm import queries as queries_module
from voxtally.llm.queries import ORACLE_SQL, QUERIES
from voxtally.llm.warc import parsed
from voxtally.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF) is None


def test_all_operators_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries())


def test_mixing_moves_whole_documents(spark, monkeypatch):
    written = {}

    def keep(df, purpose):
        written[purpose] = materialize(df, purpose)
        return written[purpose]

    monkeypatch.setattr(queries_module, "materialize", keep, raising=False)
    out = QUERIES["op10_poisson_mixing"](spark, SF)
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = written["mixed"]
    assert set(docs.columns) <= set(mixed.columns)
    want = docs.join(out.select("doc_id", "copy"), "doc_id").select(*docs.columns)
    assert len(keys) > 0 and mixed.select(*docs.columns).exceptAll(want).count() == want.exceptAll(mixed.select(*docs.columns)).count() == 0


def test_derivatives_hold_whole_records(spark):
    out = QUERIES["op1_warc_derivatives"](spark, SF).collect()
    assert len(out) > 0
    for r in out:
        headers, block = parsed(bytes(r.record))
        assert headers["WARC-Record-ID"] == r.record_id and block.decode() == r.text
