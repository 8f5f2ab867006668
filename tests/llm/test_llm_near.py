"""Near duplicates, leaks and top-k search against brute force."""

import random

import numpy as np
import pytest

from voxtally.llm import contamination, near, topk
from voxtally.llm.components import connected_components
from voxtally.llm.contamination import build_index, find_leaks, split_item
from voxtally.llm.near import near_duplicates, shortest_prefix
from voxtally.llm.topk import exact_top_k
from pyspark.sql import functions as F


def make_texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randrange(40))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0], None, "", None, "two words", "two words", "  ", "long " * 50_000]


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = [shingles(t) for t in texts]
    return {
        (i, j)
        for i in range(len(sets)) for j in range(len(sets))
        if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    }


def classes(links, n):
    root = list(range(n))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("rows_together,block", [(1024, 400_000), (2, 300)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rows_together, block):
    """The second case sends all through large groups and many blocks."""
    monkeypatch.setattr(near, "GROUP_ROWS", rows_together)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", block)
    texts = make_texts()
    docs = spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(texts)], "doc_id long, text string, node int, root string")
    links = brute_links(texts)
    root = classes(links, len(texts))
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].n_links == sum(a == i for a, _ in links)
        assert got[i].class_id == root[i]
        assert got[i].keep == (root[i] == i)


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (None, "only here")],
        "doc_id long, text string",
    )
    got = sorted(tuple(r) for r in near_duplicates(docs).select(F.coalesce("class_id", F.lit(-1)), "n_links", "keep").collect())
    assert got == sorted([(4, 3, False), (4, 3, False), (4, 3, True), (4, 3, True), (-1, 0, True), (-1, 0, True)])
    assert near_duplicates(docs.limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert shortest_prefix(0.8, 0.9999) == 4
    assert shortest_prefix(0.8, 0.999999) < 4 < shortest_prefix(0.95, 0.9999)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99), (99, 99)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 99: 99, 100: 99}


def test_edges_inside_a_component_are_read_once(spark, monkeypatch):
    """A long path whose ids do not follow it, and a dense group: rounds after the first hold few edges."""
    from voxtally.llm import components

    written = []
    kept = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, purpose: (lambda x: (written.append((purpose, x.count())), x)[1])(kept(df, purpose)))
    ids = list(range(100))
    random.Random(3).shuffle(ids)
    path = list(zip(ids, ids[1:], strict=False))
    dense = [(200 + i, 200 + j) for i in range(40) for j in range(i)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path + dense, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100), 0), **dict.fromkeys(range(200, 240), 200)}
    edges = [n for purpose, n in written if purpose == "edges"]
    assert edges[0] == len(path + dense) and all(n <= len(path) / 2 for n in edges[1:]) and len(edges) <= 8
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lowest_name_below_each_root():
    names, root = np.array([50, 7, 30, 9]), np.array([0, 1, 0, 1])
    assert near.lowest_of(names, root).tolist() == [30, 7, 30, 7]


ITEMS = [
    (0, "What is the capital of the small northern country? The capital is called Marensburg today."),
    (1, "Which river runs through seven green valleys and ends in the salt lake? It is the Ondra."),
    (2, None),
    (3, "  "),
    (4, "Red fox. Blue."),
]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = " ".join(f"word{i % 300}" for i in range(400))
    rows = [
        (1, f"{filler} {ITEMS[0][1]} {filler}"),
        (2, ITEMS[1][1].upper().replace(" ", "  ")),
        (3, "Which river runs through seven green valleys and ends in the salt lake? Nobody knows."),
        (4, filler), (5, None), (6, ""), (None, ITEMS[0][1]), (1, f"{filler} {ITEMS[0][1]} {filler}"),
        (7, f"{ITEMS[0][1]} {ITEMS[1][1]}"), (8, "red fox, blue"), (9, "red hen, blue"), (10, "a b " * 60_000 + ITEMS[1][1]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.item_id) for r in find_leaks(docs, items).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 1), (7, 0), (7, 1), (8, 4), (10, 1)]
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(docs.limit(0), items).count() == 0


def test_index_gives_a_whole_item_the_score_one():
    index = build_index([(i, *split_item(t)) for i, t in ITEMS if t])
    total = sum(matrix.sum(axis=0) for _, matrix in index.blocks)
    assert total == pytest.approx([1.0] * len(index.names))
    assert split_item("one two three four five") == ("one two three", "four five")


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)], i) for i in range(60)]
    vectors += [(60 + i, vectors[0][1], 0) for i in range(40)]
    odd = [(200, None, 1), (201, [1.0, None] + [0.0] * 4, 1), (202, [float("nan")] + [0.0] * 5, 1), (203, [float("inf")] + [0.0] * 5, 1), (None, vectors[1][1], 1)]
    df = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=3, block_rows=8, lane_blocks=3).collect())
    import numpy as np

    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in vectors}
    want = []
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[d], strict=True)), d) for d in ints if d != q)[:3]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("sizes", [(2, 1, 1), (3, 2, 2)])
def test_top_k_in_two_rounds_of_many_tasks(spark, monkeypatch, sizes):
    for name, n in zip(("SUMMARY_BLOCKS", "SUMMARY_QUERIES", "COPIES"), sizes, strict=True):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(5)
    vectors = [(i, [rng.randint(-9, 9) / 256 for _ in range(3 + i % 2)]) for i in range(90)]
    repeated = [(10, [1 / 256] * 3), (11, [9 / 256] * 3), (11, [9 / 256] * 3), (20, []), (7, [])]
    df = spark.createDataFrame(vectors + repeated, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=4, block_rows=6, lane_blocks=2).collect())
    ints = [(i, [int(x * 256) for x in v]) for i, v in vectors + repeated]
    want = []
    for q in range(0, 90, 10):
        mine = min(v for i, v in ints if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(mine))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:4])]
    assert got == sorted(want)


def test_second_round_takes_blocks_that_reach_a_kth_score():
    import numpy as np
    import pyarrow as pa

    def packed(*numbers):
        return np.array(numbers, np.int64).tobytes()

    blocks = pa.Table.from_pylist([{"dim": 2, "at": n, "lowest": packed(-n, 0), "highest": packed(n, 1)} for n in range(6)])
    # Bounds of the first query are 0 to 5, those of the second 0 to 5 and one more.
    asked = {"dim": 2, "turn": 7, "ids": packed(1, 2), "terms": packed(1, 0, -1, 1), "kth": packed(4, 4), "done": packed(5)}
    assert topk.still_open(pa.Table.from_pylist([asked]), blocks, 1) == [(7, 0, 4), (7, 1, 3)]
    asked["kth"] = packed(9, 9)
    assert topk.still_open(pa.Table.from_pylist([asked]), blocks, 1) == []
    assert [b for _, b, _ in topk.best_first(pa.Table.from_pylist([asked]), blocks, 2)] == [5, 4]


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.25, 0.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 128 * 64)]
    assert exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_leaks_do_not_depend_on_the_split_of_the_benchmark(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    common = "which of these is the right answer to the question"
    items = [(k, f"{common} {' '.join(words[12 * k : 12 * k + 6 + k % 6])}. {' '.join(words[12 * k + 6 : 12 * k + 8 + k % 5])}.") for k in range(30)]
    docs = [(100 * k + cut, f"lead in {' '.join(t.split()[: len(t.split()) - cut])} and so on") for k, t in items for cut in range(8)]
    docs += [(9000 + k, t.split(" question ")[1]) for k, t in items]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)

    def found():
        return sorted((*r[:4], *(round(x, 9) for x in r[4:])) for r in find_leaks(docs, bench).collect())

    whole = found()
    monkeypatch.setattr(contamination, "INDEX_ITEMS", 7)
    assert len(whole) > 30 and found() == whole
    # Few items of more bytes than an index takes each have an index of their own.
    monkeypatch.setattr(contamination, "INDEX_BYTES", 1)
    bench = bench.limit(2)
    few = found()
    monkeypatch.undo()
    assert few and found() == few


def plain_words(text):
    import re

    return re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", (text or "").lower())


def brute_leaks(docs, items, score_at_least=0.6, overlap=0.6, short=8):
    """BM25 of every item in every pair of neighbouring segments, then shares of grams, in plain loops."""
    import math
    from collections import Counter

    split = {i: [plain_words(p) for p in split_item(t)] for i, t in items if t and plain_words(t)}
    bags = {i: Counter(q + a) for i, (q, a) in split.items()}
    df = Counter(t for bag in bags.values() for t in bag)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    reach = max(sum(b.values()) for b in bags.values())

    def weight(bag, t):
        norm = 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)
        return math.log1p((len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + norm)

    def share(part, passage):
        if not part:
            return 1.0
        width = min(3 if len(part) >= 6 else 1, len(part))
        grams = {tuple(part[k : k + width]) for k in range(len(part) - width + 1)}
        there = {tuple(passage[k : k + width]) for k in range(len(passage) - width + 1)}
        return len(grams & there) / len(grams)

    out = set()
    for d, text in docs:
        words = plain_words(text)
        for a in range(0, len(words), reach):
            passage = words[a : a + 2 * reach]
            for i, bag in bags.items():
                score = sum(weight(bag, t) for t in bag if t in set(passage)) / sum(weight(bag, t) for t in bag)
                need = overlap if sum(bag.values()) >= short else 1.0
                if score >= score_at_least and min(share(p, passage) for p in split[i]) >= need:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("block_items", [1, 3, 8])
def test_leaks_equal_brute_force(spark, monkeypatch, block_items):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", block_items)
    rng = random.Random(block_items)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(80)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = [(i, f"{' '.join(some(rng.randint(2, 14)))}. {' '.join(some(rng.randint(1, 9)))}.") for i in range(30)]
    docs = []
    for d in range(160):
        words = some(rng.randint(0, 70))
        if d % 2:
            part = items[rng.randrange(30)][1].split()
            cut = part[: len(part) - rng.randint(0, 4)]
            words[len(words) // 2 : len(words) // 2] = cut
        docs.append((d, " ".join(words)))
    table = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], "doc_id long, text string, item string, score double")
    got = {(r.doc_id, r.item_id) for r in find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 20


def test_short_items_can_be_treated_as_any(spark):
    items = spark.createDataFrame([(1, "red fox ran. blue hen.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red fox and a blue hen")], "doc_id long, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(docs, items, short_item=0).count() == 1


def test_blocks_of_one_node_are_compared_across():
    import numpy as np

    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 9, (2, 6, 40)).astype(np.uint16)
    right[2], right[4, :36] = left[1], left[1, :36]
    root = near.agreeing(left, right, 0.8)
    assert [x for x in range(12) if root[x] != x] == [8, 10] and root[8] == root[10] == 1


def test_all_links_of_a_small_corpus(spark):
    """Every pair of the documents, counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    links = [0] * len(rows)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]} - {i}:
            links[i] += len(s & sets[j]) >= 0.8 * len(s | sets[j])
    got = {r.doc_id: r.n_links for r in near_duplicates(docs).collect()}
    assert [got[d] for d, _ in rows] == links and sum(links) > 100
