"""Line dedup against a plain restatement of its rule."""

import random

import pytest

from voxtally.llm.lines import drop_repeated_lines, line_bitmaps, line_key, lines_of
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, least=10):
    owner = {}
    for i, text in rows:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= least:
                was = owner.setdefault(k, i)
                owner[k] = i if was is None or (i is not None and i < was) else was
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = drop_repeated_lines(docs, **kw)
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())


def corpus(seed):
    r = random.Random(seed)
    shared = ["short", "Some Line with É", "some line with É", "SOME LINE WITH é", "  padded line here\t", "PADDED line here", "hot line, everywhere"]
    rows = []
    for i in range(300):
        n = r.choice([0, 1, 4, 90 if i % 50 == 0 else 6])
        lines = [r.choice(shared) if r.random() < 0.5 else f"line {i} {j} of its own" for j in range(n)]
        lines += ["hot line, everywhere"] * (r.randint(1, 70) if r.random() < 0.5 else 0)
        rows.append((None if i % 41 == 7 else i, None if i % 37 == 5 else "\n".join(lines)))
    return [*rows, *rows[3:9], (4, "hot line, everywhere\nsame id, other text"), (900, ""), (901, "\n\n")]


@pytest.mark.parametrize("kw", [{}, {"range_rows": 64, "samples": 300}, {"min_chars": 3}])
def test_kept_lines_equal_brute_force(spark, kw):
    rows = corpus(5)
    assert found(spark, rows, **kw) == brute(rows, kw.get("min_chars", 10))


def test_a_hot_line_is_divided_and_carried(spark, monkeypatch):
    """A line that holds most rows lies in several parts, and still one document keeps it."""
    from voxtally.llm import lines

    parts = []
    whole = lines.carried
    monkeypatch.setattr(lines, "carried", lambda hot: parts.append(hot.select("_range", "_part").distinct().count()) or whole(hot))
    rows = [(i, "\n".join(["the line that all have"] * 40 + [f"line {i} alone"])) for i in range(200, 0, -1)]
    assert found(spark, rows, range_rows=32) == brute(rows)
    assert parts[0] > 4


def test_long_text(spark):
    own = [f"line number {j} of the long one" for j in range(30_000)]
    rows = [(1, "\n".join(own[::3])), (2, "\n".join(own)), (3, own[1]), (4, own[1] + "\r")]
    got = found(spark, rows)
    assert got == brute(rows) and [x[2] for x in got] == [0, 10_000, 1, 1]


def test_bitmaps_hold_words_with_gaps_alone(spark):
    own = [f"a line of document two {j}" for j in range(300)]
    rows = [(1, f"{own[70]}\n{own[71]}\n{own[255]}"), (2, "\n".join(own))]
    maps = line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(m.doc_id, m.n_dropped, [w.word for w in m.keep]) for m in maps] == [(2, 3, [1, 3])]
    gone = {64 * w.word + b for w in maps[0].keep for b in range(64) if not w.bits >> b & 1}
    assert gone == {70, 71, 255}


def test_clashing_and_other_columns_and_other_kinds_of_id(spark):
    names = "n_lines string, doc string, keep int, _id int, _row int, word int, key string, body string, name string"
    rows = [("x", "y", 1, 2, 3, 4, "z", "the very same line\nfirst", "b"), ("x", None, 1, 2, 3, 4, "z", "the very same line\nsecond", "a")]
    out = drop_repeated_lines(spark.createDataFrame(rows, names), "name", "body")
    got = {r["name"]: (r.kept_text, r.n_lines, r.n_dropped, r.keep, r["_id"], r.word) for r in out.collect()}
    assert got == {"a": ("the very same line\nsecond", 2, 0, 1, 2, 4), "b": ("first", 2, 1, 1, 2, 4)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_lines(docs).collect() == line_bitmaps(docs).collect() == []


def test_keys(spark):
    texts = [" \t\x0bAbÉ Z\r\x0c", " A ", "İI", ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(line_key(F.col("t"))).collect()] == [key(x) for x in texts]
    assert [r[0] for r in df.select(F.size(lines_of(F.col("t")))).collect()] == [1, 1, 1, 1]
