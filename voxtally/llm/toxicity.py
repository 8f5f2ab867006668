"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.words import Words, find_words, hash_word, is_letter_byte, mixed, slices, text_buffers, word_hashes
from voxtally.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 16_000
LEXICON_WORDS = 200
NEAR = 8
STEM = "*"
STEM_LETTERS = (3, 4, 5, 6, 7)
SLICE_BYTES = 2 << 20
# Second-person forms of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos usted ustedes tus tú ti vosotros"
).split()
FEATURES = (
    "lexicon_density", "lexicon_words", "lexicon_kinds", "lexicon_weight", "second_person_density",
    "lexicon_near_second_person", "capital_rate", "capital_word_rate", "punctuation_rate",
    "exclamation_rate", "digit_rate", "sign_in_word_rate", "words_log", "word_length",
)


def text_features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """Adds ``features``, the array of ``FEATURES`` of the whole text.

    Words are runs of letters in lower case. Texts without words have zeros.
    """
    # Whole words at length 0; stems by their length in bytes, each compared with that much of a word.
    tables = {}
    for length in {len(w.rstrip(STEM).encode()) * w.endswith(STEM) for w in lexicon}:
        own = {w.rstrip(STEM): v for w, v in lexicon.items() if len(w.rstrip(STEM).encode()) * w.endswith(STEM) == length}
        ranked = sorted((hash_word(w), v) for w, v in own.items())
        tables[length] = np.array([h for h, _ in ranked], np.uint64), np.array([v for _, v in ranked], np.float64)
    second = np.array(sorted(hash_word(w) for w in SECOND_PERSON), np.uint64)
    upper, digit, sign, exclaim, letters = (np.zeros(256, bool) for _ in range(5))
    upper[65:91] = digit[48:58] = True
    sign[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    exclaim[33] = True
    letters |= is_letter_byte()

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])

    def place(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Index into ``table``, or -1."""
        if not len(table):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.where(table[at] == hashes, at, -1)

    def measure(texts: pa.Array) -> np.ndarray:
        raw, bounds = text_buffers(texts)
        written = find_words(texts, letters)
        words = find_words(pc.utf8_lower(texts), letters)
        hashes = word_hashes(words)
        n, size = np.maximum(words.counts(), 1), np.maximum(np.diff(bounds), 1)
        you = place(hashes, second) >= 0
        weight = np.zeros(len(hashes))
        for length, (known, weights) in tables.items():
            stems = Words(words.data, words.start, np.minimum(words.start + length, words.end), words.first)
            hit = place(word_hashes(stems) if length else hashes, known)
            found = hit >= 0
            weight[found] = np.maximum(weight[found], weights[hit[found]])
        bad = weight > 0
        owner = words.text_of()
        pairs = np.unique(mixed(hashes[bad]) + owner[bad].astype(np.uint64), return_index=True)[1]
        kinds = owner[bad][pairs]
        # Positions of second-person forms, kept apart between texts.
        spot = np.arange(len(hashes)) + owner * NEAR
        yous = spot[you]
        right = np.searchsorted(yous, spot[bad])
        gaps = np.full(len(right), NEAR)
        if len(yous):
            gaps = np.minimum(
                np.abs(yous[np.minimum(right, len(yous) - 1)] - spot[bad]), np.abs(spot[bad] - yous[np.maximum(right - 1, 0)])
            )
        near = np.zeros(len(hashes), bool)
        near[np.flatnonzero(bad)[gaps < NEAR]] = True
        inside = letters[raw]
        # A sign or digit with a letter on both sides hides a word.
        odd = np.zeros(len(raw), bool)
        if len(raw) > 2:
            odd[1:-1] = (sign | digit)[raw][1:-1] & inside[:-2] & inside[2:]
        lengths = words.end - words.start
        shout = upper[raw]
        caps = np.concatenate(([0], np.cumsum(shout)))
        shouted = (caps[written.end] - caps[written.start] == written.end - written.start) & (written.end - written.start > 1)
        bad_count = per_text(bad, words.first)
        return np.stack(
            [
                bad_count / n, bad_count, np.bincount(kinds, minlength=len(n)), per_text(weight, words.first) / n,
                per_text(you, words.first) / n, per_text(near, words.first) / n,
                per_text(shout, bounds) / size, per_text(shouted, written.first) / n,
                per_text(sign[raw], bounds) / size, per_text(exclaim[raw], bounds) / size,
                per_text(digit[raw], bounds) / size, per_text(odd, bounds) / n,
                np.log1p(words.counts()), per_text(lengths, words.first) / n,
            ],
            axis=1,
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                found = measure(part.column(text_col)).astype(np.float64)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel())
                )
                keep = [i for i, n in enumerate(part.schema.names) if n != text_col]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in keep), lists], names=[*(part.schema.names[i] for i in keep), "features"]
                )

    schema = docs.drop(text_col, "features").withColumn("features", F.array(F.lit(0.0))).schema
    return docs.drop("features").mapInArrow(rows, schema)


def learn_lexicon(
    sample: DataFrame, text_col: str = "text", label_col: str = "label", words: int = LEXICON_WORDS,
    least_texts: int = 5, least_share: float = 0.01, least_odds: float = 2.5,
) -> dict[str, float]:
    """Words and word beginnings (marked ``*``) found far oftener in positive texts, with their log odds.

    A term counts once per text. It must occur in ``least_texts`` positive texts and in
    ``least_share`` of them. Of those, the ``words`` terms that tell most are kept, by
    log odds times positive texts.
    """
    totals = sample.groupBy(label_col).count().collect()
    n = {bool(r[label_col]): r["count"] for r in totals}
    if not n.get(True) or not n.get(False):
        return {}
    whole = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}]+"), F.lit(0)))
    stems = [
        F.transform(F.filter(whole, longer(n)), cut(n))
        for n in STEM_LETTERS
    ]
    tokens = F.array_distinct(F.concat(whole, *stems))
    each = sample.select(F.explode(tokens).alias("word"), F.col(label_col).cast("int").alias("y"))
    counts = each.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n[True] + 1)) - F.log((F.col("neg") + 0.5) / (n[False] + 1))
    best = (
        counts.filter((F.col("pos") >= least_texts) & (F.col("pos") >= least_share * n[True]))
        .select("word", "pos", odds.alias("odds"))
        .filter(F.col("odds") >= least_odds)
        .orderBy(F.desc(F.col("odds") * F.col("pos")), "word")
        .limit(words)
        .collect()
    )
    return {r["word"]: float(r["odds"]) for r in best}


def longer(n: int):
    return lambda w: F.length(w) > n


def cut(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit(STEM))


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[list[float], list[float]]:
    """Non-decreasing fit by pooling adjacent violators: corner points (score, value)."""
    blocks: list[list[float]] = []
    order = np.lexsort((labels, scores))
    for s, y, w in zip(scores[order], labels[order], weights[order], strict=True):
        if blocks and blocks[-1][1] == s:
            top = blocks.pop()
            blocks.append([top[0], s, top[2] + y * w, top[3] + w])
        else:
            blocks.append([s, s, y * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            a = blocks.pop()
            blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    xs, ys = [], []
    for low, high, total, w in blocks:
        for x in dict.fromkeys((low, high)):
            xs.append(float(x))
            ys.append(float(total / w))
    return xs, ys


def interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear between the corner points, level beyond them."""
    if not xs:
        return x
    at = F.size(F.filter(F.array(*map(F.lit, xs)), lambda v: v <= x))
    low, high = F.greatest(at, F.lit(1)), F.least(at + 1, F.lit(len(xs)))

    def item(values: Sequence[float], i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), i)

    width = item(xs, high) - item(xs, low)
    share = F.when((at == 0) | (width <= 0), 0.0).otherwise((x - item(xs, low)) / width)
    return item(ys, low) + share * (item(ys, high) - item(ys, low))


class ToxicityModel:
    """A fitted lexicon, forest and calibration."""

    def __init__(self, lexicon: dict[str, float], forest, corners: tuple[list[float], list[float]], base: float):
        self.lexicon, self.forest, self.corners, self.base = lexicon, forest, corners, base

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Replaces the text by ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on).

        Every whole text is scored, null and empty ones as texts without words; repeated
        rows score alike. Columns of ``docs`` of the added names are replaced, others kept.
        """
        kept = [c for c in docs.columns if c not in ("score", "predicted", text_col)]
        # The row travels as one value, so that no name of its columns can clash with those made here.
        rows = docs.select(F.struct(*kept).alias("doc"), docs[text_col].cast("string").alias("text"))
        if self.forest is None:
            scored = rows.select("doc", F.lit(self.base).alias("score"))
        else:
            ready = text_features(rows, self.lexicon).select("doc", array_to_vector("features").alias("_vector"))
            scored = self.forest.transform(ready).select("doc", vector_to_array("_raw")[1].alias("_margin"))
            scored = scored.select("doc", interpolated(F.col("_margin"), *self.corners).alias("score"))
        scored = scored.select("doc.*", "score")
        return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 3,
) -> ToxicityModel:
    """Learns from at most ``sample_rows`` rows of ``labels``, those with the lowest hash of their id.

    Rows without label, and ids not in ``docs``, do not count; an id labelled twice and
    equal texts count once, as toxic if any is. A third of the sample, by hash of the
    text, calibrates the scores and is not seen by the trees. Without both labels in the
    sample, every text scores the share of positive rows.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col(label_col) > 0).cast("int")).alias("label")
    )
    # Written, so that its size is known: Catalyst then joins it without moving the texts.
    picks = materialize(known.orderBy(F.xxhash64(F.lit("toxicity"), "_id"), "_id").limit(sample_rows), "toxicity-ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(picks, "_id")
    folded = found.groupBy(F.xxhash64("text").alias("mark"), "text").agg(F.max("label").alias("label"))
    sample = materialize(folded, "toxicity-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, total = counts.get(1, 0), sum(counts.values())
    base = positive / total if total else 0.0
    if not positive or positive == total:
        return ToxicityModel({}, None, ([], []), base)
    held = F.pmod(F.col("mark"), F.lit(3)) == 0
    lexicon = learn_lexicon(sample.filter(~held))
    ready = materialize(text_features(sample, lexicon).withColumn("held", held).drop("mark"), "toxicity-features")
    ready = ready.withColumn("_vector", array_to_vector("features"))
    train = ready.filter(~F.col("held"))
    if train.select("label").distinct().count() < 2:
        return ToxicityModel({}, None, ([], []), base)
    grow = GBTClassifier(
        labelCol="label", featuresCol="_vector", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=7
    )
    forest = grow.fit(train.select("label", "_vector"))
    forest.setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction")
    held_rows = forest.transform(ready.filter("held")).select(vector_to_array("_raw")[1].alias("m"), "label").collect()
    margins = np.array([r["m"] for r in held_rows], float)
    labels = np.array([r["label"] for r in held_rows], float)
    corners = isotonic(margins, labels, np.ones(len(labels))) if len(set(labels.tolist())) == 2 else ([], [])
    if not corners[0]:
        corners = ([-4.0, 4.0], [0.0, 1.0])
    return ToxicityModel(lexicon, forest, corners, base)
