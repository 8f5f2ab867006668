"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally.llm.centroids import cluster_vectors
from voxtally.llm.contamination import find_leaks
from voxtally.llm.language import crc_part, learn_dictionaries, predict_language
from voxtally.llm.lines import drop_repeated_lines
from voxtally.llm.mixing import mix_sources
from voxtally.llm.near import near_duplicates
from voxtally.llm.sharding import shard_by_splitters
from voxtally.llm.substrings import remove_repeated_windows
from voxtally.llm.suffixes import repeated_passages
from voxtally.llm.topk import exact_top_k
from voxtally.llm.toxicity import fit_toxicity
from voxtally.llm.trie import prefix_trie
from voxtally.llm.warc import derive_records, responses_of_pages
from voxtally.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covered_words_sql(size: int) -> str:
    """CTEs ``d`` (row, doc_id, words w) and ``gone`` (row, place of a word that a repeated window covers)."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT row, i, array_to_string(w[i:i + {size - 1}], ' ') AS words
  FROM d, unnest(range(1, len(w) - {size - 2})) AS u(i)),
r AS (SELECT row, i FROM s WHERE words IN (SELECT words FROM s GROUP BY words HAVING count(*) > 1)),
gone AS (SELECT DISTINCT row, p FROM r, unnest(range(i, i + {size})) AS u(p))"""


@query("op1_warc_derivatives")
def op1(spark, sf_dir):
    responses = responses_of_pages(table(spark, sf_dir, "pages"))
    return derive_records(responses, keep=["page_id"])


@query(
    "op2_suffix_array_dedup",
    covered_words_sql(50)
    + """
, g AS (SELECT row, p, p - row_number() OVER (PARTITION BY row ORDER BY p) AS island FROM gone)
SELECT d.doc_id, min(p) - 1 AS first_word, count(*) AS n_words
FROM g JOIN d USING (row) GROUP BY row, d.doc_id, island""",
)
def op2(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_toxicity_trees")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_part("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    out = fit_toxicity(docs, labels).score(docs)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query(
    "op4_substring_dedup",
    covered_words_sql(35)
    + """
, k AS (
  SELECT row, string_agg(x, ' ' ORDER BY p) AS kept
  FROM (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (row, p)
  GROUP BY row),
n AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row) LEFT JOIN n USING (row)""",
)
def op4(spark, sf_dir):
    out = remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


# CRC-32 byte by byte: the table of the reflected polynomial, then one step per byte.
CRC_SQL = """
WITH tbl AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) AS r(b))),
x AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, n + 16 AS size,
    xor(list_reduce(
      list_transform(range(n), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM x, tbl)"""


@query(
    "op5_sampled_splitters",
    CRC_SQL
    + """
, o AS (
  SELECT *, sum(size) OVER (ORDER BY text_crc32, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos, sum(size) OVER () AS total
  FROM c),
s AS (SELECT *, (pos::HUGEINT * 40 // total::HUGEINT)::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard
FROM s""",
)
def op5(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shard_by_splitters(docs, ["text_crc32", "doc_id"], "size", 40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query("op6_ngram_jaccard_join")
def op6(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_links", "keep")


@query("op7_benchmark_leaks")
def op7(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op8_exact_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5""",
)
def op8(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_compression_language")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.filter(crc_part("doc_id", 4) != 2))
    out = predict_language(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


SEED = 17
HASH_SQL = "('0x' || substr(md5(concat('{seed}', ':', {key})), 1, 13))::BIGINT"


@query(
    "op10_poisson_mixing",
    f"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) FROM n)::DOUBLE / (SELECT count(*) FROM n) / n AS rate FROM n),
e AS (
  SELECT s, list_transform(range(0, (ceil(rate + 12 * sqrt(rate)) + 30)::BIGINT), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1))) AS p
  FROM r),
cdf AS (SELECT s, list_transform(range(1, len(p) + 1), lambda k: list_sum(p[1:k])) AS c FROM e),
d AS (
  SELECT doc_id, source, {HASH_SQL.format(seed=SEED, key="coalesce(doc_id::VARCHAR, '')")} / 4503599627370496.0 AS u
  FROM documents),
m AS (SELECT doc_id, source, len(list_filter(c, lambda x: x <= u)) AS copies FROM d JOIN cdf ON s = coalesce(source, ''))
SELECT doc_id, source, copies, copy,
       {HASH_SQL.format(seed=f"{SEED}:", key="coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR")} AS shuffle_key
FROM m, unnest(range(0, copies)) AS x(copy)""",
)
def op10(spark, sf_dir):
    # Written whole, so that texts and all other columns are replicated and dealt too.
    out = materialize(mix_sources(table(spark, sf_dir, "documents"), seed=SEED), "mixed")
    return out.select("doc_id", "source", "copies", "copy", "shuffle_key").sort("shuffle_key")


STRIPPED_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op11_line_bitmaps",
    f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT row, doc_id, p, l[p] AS line FROM d, unnest(range(1, len(l) + 1)) AS u(p)),
k AS (
  SELECT *, translate(trim(line, {STRIPPED_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM x),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY row, doc_id""",
)
def op11(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def rounds_sql(rounds: int) -> str:
    """CTEs of k-means rounds over ``x`` (row, dim, x) from centroids ``c0`` (j, dim, c); ``a{rounds}`` is the last assignment."""
    ctes = []
    for t in range(rounds + 1):
        ctes.append(f"""
, a{t} AS MATERIALIZED (
  SELECT row, min_by(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT row, j, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{t} USING (dim) GROUP BY row, j) GROUP BY row)""")
        if t < rounds:
            ctes.append(f"""
, m{t} AS (SELECT j, dim, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} USING (row) GROUP BY j, dim)
, c{t + 1} AS MATERIALIZED (
  SELECT j, dim, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{t} LEFT JOIN m{t} USING (j, dim))""")
    return "".join(ctes)


@query(
    "op12_ns_bounds_clusters",
    """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT row, dim, e[dim] AS x FROM v, unnest(range(1, 65)) AS u(dim)),
s AS (
  SELECT e, row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), e) - 1 AS j FROM v WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT j, dim, e[dim] AS c FROM s, unnest(range(1, 65)) AS u(dim) WHERE j < 8)"""
    + rounds_sql(10)
    + """
, h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c10 GROUP BY j)
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN v USING (row) JOIN h USING (j)""",
)
def op12(spark, sf_dir):
    out = cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
    digits = F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(digits, 256).alias("centroid_sha256"))


@query(
    "op13_conversation_trie",
    """
WITH tbl AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) AS r(b))),
o AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, o.t, xor(list_reduce(
      list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda s, b: xor(s >> 8, tbl.t[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM o, tbl),
r AS (SELECT a.c, coalesce(b.t[:a.h], []) || a.t[a.h + 1:] AS t FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 5),
p AS MATERIALIZED (SELECT c, len(t) AS n, d, t[:d] AS key FROM r, unnest(range(0, len(t) + 1)) AS u(d)),
v AS MATERIALIZED (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(key[d].text)) END AS own
  FROM p GROUP BY key, d),
k AS (SELECT key[:d - 1] AS key, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (key)),
s AS (
  SELECT key[:a] AS key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM w, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s USING (key) LEFT JOIN v u ON w.d > 0 AND u.key = w.key[:w.d - 1]""",
)
def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
