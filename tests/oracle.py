"""Runs registered queries beside their SQL: python tests/oracle.py [sf dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        files = f"{sf_dir}/{t}.parquet"
        files += "/*.parquet" if Path(files).is_dir() else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def canonical(rows: list[tuple], names: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "\0null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    if "-t" in sys.argv:
        print("   ", sorted((n, t) for n, t in df.dtypes), sorted((d[0], str(d[1])) for d in cur.description))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "no rows on either side" if not got[1] else "no rows in SQL"
    if got[1] != want[1]:
        mine, theirs = set(got[1]), set(want[1])
        return (
            f"rows {len(got[1])} / {len(want[1])}; only spark {sorted(mine - theirs)[:2]}; "
            f"only sql {sorted(theirs - mine)[:2]}"
        )
    return None


def local_session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    from __spark_entry__ import queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = [a for a in sys.argv[2:] if a != "-t"] or list(queries())
    session, duck = local_session(), connect(sf)
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for q in chosen:
        start = time.time()
        try:
            problem = compare(session, duck, q, sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {q} {time.time() - start:.1f}s {problem or ''}"[:1800], flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
