"""Sharding, mixing, language, toxicity, WARC records and the pipeline."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxtally.llm import sharding
from voxtally.llm.language import learn_dictionaries, predict_language
from voxtally.llm.mixing import mix_sources, unit
from voxtally.llm.sharding import shard_by_splitters
from voxtally.llm.toxicity import FEATURES, fit_toxicity, isotonic, interpolated, text_features
from voxtally.llm.warc import derive_records, gzip_member, parsed, plain_text, responses_of_pages
from voxtally.session import materialize

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("samples", [20, 4096])
def test_shards_have_near_equal_sizes(spark, samples):
    rows = [(i, i % 3 and i % 97, 10 + i % 50, 0, "s") for i in range(900)] + [(None, None, None, 1, "t")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, k long, size long, _range int, shard string")
    out = shard_by_splitters(docs, ["k", "doc_id"], "size", 7, samples=samples).collect()
    assert len(out) == 903
    total = sum(r.size or 0 for r in out)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0))
    at, want = 0, {}
    for i, r in enumerate(order):
        want.setdefault(r[0], []).append((min(at * 7 // total, 6), i))
        at += r[2] or 0
    for s in range(7):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size or 0 for r in own) - total / 7) < 60
    for name, places in want.items():
        assert sorted(r.shard for r in out if r.doc_id == name) == sorted(s for s, _ in places)
    assert {r["_range"] for r in out} == {0, 1}


def test_shards_of_hot_and_empty_tables(spark):
    one = spark.createDataFrame([(i, "same", 16) for i in range(400)], "doc_id long, k string, size long")
    counts = shard_by_splitters(one, ["k", "doc_id"], "size", 8).groupBy("shard").count().collect()
    assert [r["count"] for r in counts] == [50] * 8
    assert shard_by_splitters(one.limit(0), ["k", "doc_id"], "size", 8).count() == 0
    nothing = one.withColumn("size", F.lit(0).cast("long"))
    assert shard_by_splitters(nothing, ["k", "doc_id"], "size", 8).filter("slot >= 0").count() == 400


@pytest.mark.parametrize("size", [0, 16])
def test_copies_of_one_document_are_divided(spark, monkeypatch, size):
    ranges = []

    def keep(df, purpose):
        out = materialize(df, purpose)
        ranges.extend([out] if purpose == "ranges" and "_n" in out.columns else [])
        return out

    monkeypatch.setattr(sharding, "materialize", keep)
    rows = [(7, 500, size)] * 3000 + [(i, i, 16 * (size > 0)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, k long, size long").repartition(8)
    out = shard_by_splitters(docs, ["k", "doc_id"], "size", 8).collect()
    assert ranges[-1].agg(F.max("_n")).first()[0] < 400
    shards = {s: sorted(r.slot for r in out if r.shard == s) for s in {r.shard for r in out}}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    if size:
        assert [len(shards[s]) for s in range(8)] == [500] * 8
        ordered = [(r.k, r.doc_id) for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)
    assert sorted((r.doc_id, r.k, r.size) for r in out) == sorted(rows)


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total and k < 400:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_inverts_the_poisson_distribution(spark):
    rows = [(i, "a" if i % 3 else None if i % 2 else "b", i, "q") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _rate int, copy string")
    weights = {"a": 1.0, "b": 3.0}
    out = mix_sources(docs, weights, total=3000, seed=4).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r["copy"])
        assert r["_rate"] == r.doc_id
    counts = {"a": 400, "b": 100, None: 100}
    for i, source, *_ in rows:
        u = int(hashlib.md5(f"4:{i}".encode()).hexdigest()[:13], 16) / 2**52
        rate = {"a": 750 / 400, "b": 2250 / 100}.get(source, 0.0)
        k = poisson(u, rate) if rate else 0
        assert sorted(got.get(i, [])) == list(range(k))
    assert abs(len(out) - 3000) < 200 and counts["a"] == 400
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    assert unit is not None


def test_mixing_small_tables(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (1, "")], "doc_id long, source string")
    out = mix_sources(docs, seed=1)
    assert out.filter("doc_id is null").count() % 2 == 0
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, {"other": 1.0}).count() == 0


def test_language_by_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("part", F.col("doc_id") % 4)
    out = predict_language(docs.filter("part = 2"), learn_dictionaries(docs.filter("part <> 2"))).toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all() and out[out.accepted].score.gt(0).all()


def test_language_of_odd_texts(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !! 7", "c"), (4, "der die das und ist nicht ein", "de"), (None, "the of and to in is that", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.lang: r for r in predict_language(docs, learn_dictionaries(docs)).collect()}
    assert [out[x].lang_pred for x in ("a", "b", "c", "de", "en")] == ["und", "und", "und", "de", "en"]
    assert [out[x].score for x in ("a", "b", "c")] == [0, 0, 0] and not out["a"].accepted
    assert predict_language(docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert learn_dictionaries(docs.limit(0)) == {} and predict_language(docs.limit(0), {"x": b"abc"}).count() == 0


def test_language_of_clean_texts_of_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang in ('de', 'en', 'es', 'fr')")
    dictionaries = learn_dictionaries(docs.filter("doc_id % 4 <> 2"))
    texts = {}
    for r in docs.filter("doc_id % 4 = 2 and text is not null").select("lang", "text").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    rows = []
    for lang, own in sorted(texts.items()):
        joined = " ".join(own)
        for mb in (1, 5, 12):
            rows.append((lang, mb, (joined * (mb * 1_000_000 // len(joined) + 1))[: mb * 1_000_000]))
    long = spark.createDataFrame(rows, "lang string, mb int, text string").repartition(4)
    out = predict_language(long, dictionaries).select("lang", "mb", "lang_pred", "accepted").collect()
    assert [(r.lang, r.mb) for r in out if r.lang_pred != r.lang or not r.accepted] == []


def test_features(spark):
    rows = [(1, "You IDIOT! st4pid réeux5 fine"), (2, None), (3, ""), (4, "x " * 100_000 + "idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: dict(zip(FEATURES, r.features, strict=True)) for r in text_features(docs, {"idiot": 3.0, "réeu*": 4.0}).collect()}
    assert out[1]["lexicon_words"] == 2 and out[1]["lexicon_kinds"] == 2
    assert out[1]["lexicon_near_second_person"] > 0 and out[1]["capital_word_rate"] > 0 and out[1]["sign_in_word_rate"] > 0
    assert set(out[2].values()) == set(out[3].values()) == {0.0}
    assert out[4]["lexicon_words"] == 1 and out[4]["second_person_density"] == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", F.lit(1).alias("_margin"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = fit_toxicity(docs, labels.filter("doc_id % 3 <> 1"))
    odd = spark.createDataFrame([(-1, None, 1), (-2, "", 1)], "doc_id long, text string, _margin int")
    scored = model.score(docs.unionByName(odd))
    held = scored.join(labels.filter("doc_id % 3 = 1"), "doc_id").toPandas()
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert scored.filter("doc_id < 0 and predicted = 0 and score between 0 and 1 and _margin = 1").count() == 2


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0)], "doc_id long, toxic int")
    assert {r.score for r in fit_toxicity(docs, labels).score(docs).collect()} == {1.0}
    assert {r.score for r in fit_toxicity(docs, labels.limit(0)).score(docs).collect()} == {0.0}


def test_isotonic(spark):
    xs, ys = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert ys == sorted(ys) and ys[0] == 0 and ys[-1] == 1
    values = spark.range(7).select(interpolated(F.col("id").cast("double"), xs, ys).alias("v")).collect()
    assert [r.v for r in values] == pytest.approx(list(np.interp(range(7), xs, ys)))


def test_plain_text():
    html = '<head><title>x</title></head><p a="1>2">A &amp; b<br>c</p><script>var t="</p>"</script><li>x \n y</li><!-- z --> <b>q</b>r'
    assert plain_text(html) == "A & b\nc\nx\ny\nqr"
    assert plain_text("a <![x[ y]]> b < c") == "a b < c"
    assert plain_text("a<script>never closed") == "a" and plain_text("") == ""


def test_derivatives_link_to_their_source(spark):
    rows = [(1, "http://a.example/", "<p>Hé &lt;b&gt;</p>"), (2, None, None), (3, "u\r\nv", ""), (1, "http://a.example/", "<p>Hé &lt;b&gt;</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = derive_records(responses_of_pages(pages), keep=["page_id"]).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "conversion")] * 2 + [(1, "metadata")] * 2 + [(2, "metadata"), (3, "metadata")]
    first = [r for r in out if r.page_id == 1]
    payload = rows[0][2].encode()
    want = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {r.source_payload_digest for r in first} == {want} and all(r.source_digest_ok for r in first)
    assert len({r.refers_to for r in first}) == 1 and len({r.record_id for r in first}) == 2
    for r in out:
        headers, block = parsed(bytes(r.record))
        assert headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Record-ID"] == r.record_id
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() == r.block_digest
        assert block.decode() == r.text and len(block) == r.content_length
        assert zlib.decompress(gzip_member(bytes(r.record)), 31) == bytes(r.record)
    meta = next(r for r in first if r.record_type == "metadata").text
    assert "source-Content-Type: text/html; charset=utf-8" in meta and f"source-payload-digest: {want}" in meta
    assert next(r for r in first if r.record_type == "conversion").text == "Hé <b>"
    assert derive_records(responses_of_pages(pages.limit(0))).count() == 0


def test_derivatives_of_given_responses(spark):
    headers = [("Content-Type", "application/pdf"), ("X-A", "b")]
    rows = [("<urn:x>", "u", "d", "sha1:WRONG", "sha1:B", 404, headers, b"%PDF"), (None, None, None, None, None, None, None, b"<i>t</i>\xff")]
    schema = "record_id string, target_uri string, date string, payload_digest string, block_digest string, http_status int, http_headers array<struct<name:string,value:string>>, payload binary"
    out = derive_records(spark.createDataFrame(rows, schema)).collect()
    pdf = [r for r in out if r.refers_to == "<urn:x>"]
    assert [r.record_type for r in pdf] == ["metadata"] and pdf[0].source_digest_ok is False
    assert "source-X-A: b" in pdf[0].text and "source-http-status: 404" in pdf[0].text and "source-block-digest: sha1:B" in pdf[0].text
    rest = [r for r in out if r.refers_to != "<urn:x>"]
    assert sorted(r.record_type for r in rest) == ["conversion", "metadata"] and {r.text for r in rest} >= {"t�"}


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = docs.filter("length(text) > 1500 and lang = 'en'").orderBy("doc_id").first()
    rows = [
        (-1, base.text, "en", "src0", 1), (-2, base.text + " extra", "en", None, 1), (-3, "123 456", "en", "src1", 1),
        (-4, f"{base.text[:700]} {item} and more", None, "src1", 1), (None, None, None, None, None),
    ]
    planted = docs.withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(spark.createDataFrame(rows, docs.schema))
    planted.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), name)
        counts.append({r.doc_id for r in kept.select("doc_id").collect()})
        if name != "shards":
            assert kept.columns == docs.columns
    assert {-3, None} & counts[0] == set() and {-1, -2, -4} <= counts[0]
    assert -2 in counts[1] and -1 not in counts[1] and base.doc_id not in counts[1]
    assert -4 in counts[1] and -4 not in counts[2]
    assert counts[4] == counts[3] <= counts[2]
    assert kept.filter("shard not between 0 and 39 or slot < 0").count() == 0
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_own_columns(spark):
    """Each stage on its own input with nulls, repeats and columns named as those it makes, against plain loops."""
    stages = dict(corpus_pipeline.STAGES)
    names = ["score", "accepted", "lang_pred", "copy", "copies", "shuffle_key", "size", "doc", "row", "key_text", "keep", "text_key", "Copy_of_document"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "src0", 0), (-6, None, None, "src1", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    docs = docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    docs = corpus_pipeline.materialize(docs, "own-columns")
    given = [r.asDict() for r in docs.collect()]
    by_row = lambda rows: sorted(map(repr, (tuple(r.values()) for r in rows)))
    sizes = {s: sum((r["source"] or "") == s for r in given) for s in {r["source"] or "" for r in given}}

    def copies(r):
        u = int(hashlib.md5(f"17:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, total = len(given) / len(sizes) / sizes[r["source"] or ""], 0, 0.0
        while True:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if u < total:
                return k
            k += 1

    mixed = stages["mix"](spark, docs, SF)
    assert mixed.columns == docs.columns
    assert by_row(r.asDict() for r in mixed.collect()) == by_row(r for r in given for _ in range(copies(r)))
    for name in ("language", "near_duplicates", "decontaminate"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns
        kept = by_row(r.asDict() for r in out.collect())
        assert kept and set(kept) <= set(by_row(given))
    dealt = stages["shards"](spark, docs, SF).collect()
    assert len(dealt) == len(given) and all(r.size == len((r.text or "").encode()) + 16 for r in dealt)
    order = sorted(dealt, key=lambda r: (r.shard, r.slot))
    keys = [(r.text_crc32, r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    total, before = sum(r.size for r in order), 0
    for r in order:
        assert r.shard == before * 40 // total
        before += r.size


def test_kept_columns_may_bear_derived_names(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>a</p>", "own", 5)], "page_id long, url string, html string, text string, kept_text int")
    responses = responses_of_pages(pages).join(pages.select("page_id", "text", "kept_text"), "page_id")
    out = derive_records(responses, keep=["page_id", "text", "kept_text", "date"]).collect()
    assert len(out) == 2
    for r in out:
        assert (r.page_id, r.kept_text, r.kept_kept_text, r.kept_date) == (1, "own", 5, r.date)
    assert {r.text for r in out if r.record_type == "conversion"} == {"a"}


def test_derivatives_of_a_very_long_page(spark):
    html = "<p>word</p>" * 400_000
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    out = derive_records(responses_of_pages(pages)).filter("record_type = 'conversion'").first()
    assert out.text == "\n".join(["word"] * 400_000)


def test_a_rare_source_against_many_rows(spark):
    """A rate of ten thousands is inverted exactly, and its copies are made by several tasks."""
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("big").alias("source"),
        F.when(F.col("id") == 0, F.repeat(F.lit("long "), 20_000)).otherwise("short").alias("text"),
    )
    out = mix_sources(docs, {"rare": 1.0, "big": 2.0}, total=30_000, seed=9)
    rate = 5000.0
    got = {r.doc_id: r["count"] for r in out.filter("source = 'rare'").groupBy("doc_id").count().collect()}
    for i in (0, 1):
        u = int(hashlib.md5(f"9:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, 0.0
        while True:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if u < total:
                break
            k += 1
        assert got[i] == k and out.filter(F.col("doc_id") == i).select("copy").distinct().count() == k
    assert abs(out.filter("source = 'big'").count() - 20_000) < 800


def test_poisson_steps_are_the_distribution(spark):
    from voxtally.llm.mixing import poisson_steps

    rates = [0.0, 0.25, 3.0, 19.5, 21.0, 400.0, 90_000.0]
    table = poisson_steps(spark.createDataFrame([(str(r), r) for r in rates], "_source string, _rate double"))
    for row in table.collect():
        rate = float(row["_source"])
        mass = [
            math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
            for k in range(row["_first"], row["_first"] + len(row["_steps"]))
        ]
        assert row["_steps"] == pytest.approx(list(np.cumsum(mass)), abs=1e-9)
        assert row["_steps"][-1] == pytest.approx(1.0, abs=1e-9) and len(row["_steps"]) < 24 * rate**0.5 + 40


def test_code_lengths_decide_the_language(spark):
    """Each text is coded with each dictionary in plain zstandard calls, piece by piece; the shortest total wins."""
    import zstandard

    from voxtally.llm import language as lg

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = learn_dictionaries(docs.filter("doc_id % 4 <> 2"))
    coders = {
        lang: zstandard.ZstdCompressor(
            level=lg.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        )
        for lang, data in dictionaries.items()
    }
    got = {r.doc_id: r.lang_pred for r in predict_language(docs, dictionaries).collect()}
    checked = 0
    for r in docs.filter("doc_id % 9 = 2 and text is not null").collect():
        raw = lg.plain(r.text)
        if got[r.doc_id] == "und" or not raw:
            continue
        pieces = [raw[a : a + lg.PIECE_BYTES] for a in range(0, len(raw), lg.PIECE_BYTES)]
        sizes = {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in coders.items()}
        least, second = sorted(sizes.values())[:2]
        if second > least + 4:  # headers may differ by a few bytes
            assert sizes[got[r.doc_id]] == least
            checked += 1
    assert checked > 80
