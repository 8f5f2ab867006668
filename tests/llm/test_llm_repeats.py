"""Repeated windows and passages against brute force."""

import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from voxtally.llm.repeats import mark, read_flags, send_rows
from voxtally.llm.substrings import remove_repeated_windows
from voxtally.llm.suffixes import lowest_in, repeated_passages
from voxtally.llm.words import find_words, hash_word, mixed, window_hashes, window_starts, word_hashes

LINE = "the quick brown fox jumps over the lazy dog and runs far away from here"
ROWS = [
    (1, f"alpha {LINE} omega", 7, "x"),
    (2, f"beta {LINE} psi", None, None),
    (3, "one two three", 1, "y"),
    (4, "", 1, "y"),
    (5, None, 1, "y"),
    (None, f"gamma {LINE} chi", 1, "y"),
    (7, "ab " * 40, 1, "y"),
    (8, "same text of these nine words comes back twice", 1, "z"),
    (8, "same text of these nine words comes back twice", 1, "z"),
    (9, " ".join(f"w{i}" for i in range(60_000)), 1, "z"),
    (10, "x\x1cy é z \t\n q", 1, "z"),
]
COLUMNS = "doc_id long, text string, chunk int, id string"


def brute(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return words, out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


def test_windows_equal_brute_force(docs):
    got = sorted(tuple(r) for r in remove_repeated_windows(docs, window=5, group_size=500).select(
        "kept_sha256", "n_words", "n_removed", "kept_text").collect())
    words, gone = brute([r[1] for r in ROWS], 5)
    want = []
    for w, g in zip(words, gone, strict=True):
        kept = b" ".join(x for x, y in zip(w, g, strict=True) if not y)
        want.append((hashlib.sha256(kept).hexdigest(), len(w), sum(g), kept.decode()))
    assert got == sorted(want)


def test_intervals_cover_what_is_removed(docs):
    for r in remove_repeated_windows(docs, window=5).collect():
        assert sum(i["n"] for i in r.intervals) == r.n_removed
        assert all(i["n"] >= 5 for i in r.intervals)


def test_passages_equal_brute_force(docs):
    got = Counter()
    for r in repeated_passages(docs, length=8, seed=3, group_size=500).collect():
        got[r.doc_id, r.first_word, r.n_words] += 1
    words, gone = brute([r[1] for r in ROWS], 8)
    want = Counter()
    for (name, *_), g in zip(ROWS, gone, strict=True):
        edges = [i for i in range(len(g) + 1) if (g[i - 1] if i else False) != (g[i] if i < len(g) else False)]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            want[name, a, b - a] += 1
    assert got == want
    assert (None, 1, 15) in got


def test_empty_table(docs):
    none = docs.filter("doc_id < 0")
    assert remove_repeated_windows(none).count() == 0
    assert repeated_passages(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x1c", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    found = find_words(pa.array(texts, pa.string()))
    own = [bytes(found.data[a:b]) for a, b in zip(found.start, found.end, strict=True)]
    assert own == [w for t in texts for w in (t or "").encode().split()]
    hashes = word_hashes(found)
    assert len(set(hashes.tolist())) == len(set(own))
    starts = window_starts(found, 3)
    runs = [tuple(own[i : i + 3]) for i in starts]
    prints = window_hashes(hashes, 3)[starts].tolist()
    assert len(set(zip(runs, prints, strict=True))) == len(set(runs)) == len(set(prints))


def test_hashes_across_blocks():
    found = find_words(pa.array(["q " * 200_000 + "z" * 300_000, "z" * 300_000 + " q q q"]))
    hashes = word_hashes(found)
    assert hashes[0] == hashes[199_999] == hashes[-1] == hash_word("q")
    assert hashes[200_000] == hashes[200_001] != hashes[0]
    windows = window_hashes(hashes, 3)
    assert windows[0] == windows[199_997] == windows[-1]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 31])
def test_lowest_in(width):
    values = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    want = [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]
    assert lowest_in(values, width).tolist() == want


@pytest.mark.parametrize("groups", [1, 7, 5000])
def test_flags_of_a_chunk_for_any_number_of_groups(groups):
    r = np.random.default_rng(groups)
    prints = r.integers(0, 3000, 4000).astype(np.uint64)
    second = mixed(prints)
    other = np.arange(2000, 2600, dtype=np.uint64)
    sent = pa.Table.from_batches([send_rows(0, prints, second, groups), send_rows(1, other, mixed(other), groups)])
    parts = sorted(set(sent["part"].to_pylist()))
    flags = pa.concat_tables([mark(sent.filter(pc.equal(sent["part"], p))) for p in parts])
    got = read_flags(prints, second, groups, flags.filter(pc.equal(flags["chunk"], 0)))
    seen = Counter(prints.tolist())
    assert got.tolist() == [seen[p] > 1 or 2000 <= p < 2600 for p in prints.tolist()]


def test_work_for_a_chunk_does_not_follow_the_number_of_groups():
    r = np.random.default_rng(0)
    prints = r.integers(0, 1 << 62, 300_000).astype(np.uint64)
    second = mixed(prints)
    took = []
    for groups in (40, 10_000):
        flags = pa.Table.from_batches([send_rows(0, prints, second, groups)])
        bits = [np.packbits(np.zeros(len(x) // 8, bool)).tobytes() for x in flags["prints"].to_pylist()]
        flags = flags.append_column("bits", pa.array(bits, pa.binary()))
        start = time.perf_counter()
        read_flags(prints, second, groups, flags)
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 0.2
