"""The conversation trie against a plain restatement of its rule."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxtally.llm.trie import Slots, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    length = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + turns[h:]
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for a in range(len(k) + 1):
            saved[k[:a]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:a]] += children[k] == 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if length[c] == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=str)


def talks(seed):
    r = random.Random(seed)
    words = ["hi", "héllo", "what is this", "", None, "ok then"]
    rows = []
    for c in range(200):
        if c % 17 == 0:
            continue
        for t in range(r.choice([1, 2, 3, 5, 9, 12])):
            role = r.choice(["user", "assistant", None]) if r.random() < 0.3 else "user"
            rows.append((c, None if r.random() < 0.03 else t, role, words[t % 3] if r.random() < 0.7 else r.choice(words)))
    # Turns of one number, a very long conversation, rows without conversation, and repeated rows.
    rows += [(400, 1, "user", x) for x in "cab"] + [(500, t, "user", f"long {t % 3}") for t in range(700)]
    return [*rows, (None, 1, "user", "x"), *rows[:5]]


@pytest.mark.parametrize("kw", [{}, {"subtree": 8}])
def test_nodes_equal_brute_force(spark, kw):
    rows = talks(3)
    assert found(spark, rows, **kw) == brute(rows)


def test_copies_and_a_common_first_turn(spark):
    """A third of all conversations are one, and most share their first turn."""
    rows = [(c, t, "user", "hello" if t == 0 else f"{c * (c % 3 > 0)} {t}") for c in range(0, 900, 5) for t in range(4)]
    assert found(spark, rows, subtree=16) == brute(rows)


def test_turnless_conversations(spark):
    """Without its family's first one, a conversation shorter than its head has no turn left."""
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 5]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in got)


def test_no_conversations(spark):
    assert found(spark, []) == found(spark, [(None, 0, "user", "x")]) == []


def test_other_names_and_extra_columns(spark):
    rows = talks(4)[:60]
    df = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], "cid long, n long, who string, said string, depth int, p1 string, c int")
    got = prefix_trie(df, "cid", "n", "who", "said").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, (2, 5000), np.uint64)
    slots = Slots(a, b)
    assert sorted(slots.slot) == list(range(5000))
    assert (slots.find(a, b) == slots.slot).all()
    assert (slots.find(a, b + np.uint64(1)) == -1).all()
    assert len(Slots(a[:0], b[:0]).slot) == 0
    with pytest.raises(ValueError, match="twice"):
        Slots(a[[0, 1, 0]], b[[0, 1, 0]])
