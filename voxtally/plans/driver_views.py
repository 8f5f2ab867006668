"""Review-shaped views over the given tables, for the registered queries.

Each view exists twice: as a DataFrame (here) and as the text of an SQL common
table expression (``SQL_VIEWS``), with the same rows in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxtally.functions.status import (
    ANALYSIS_FAILED, COMPLETED, FAILED, FETCH_FAILED, FETCH_FAILED_TEXT, INSUFFICIENT, INSUFFICIENT_TEXT, NO_REVIEWS,
    NO_REVIEWS_TEXT, RUNNING,
)
from voxtally.functions.text import MIN_LETTERS, clean_company_url, terms
from voxtally.session import configure

AS_OF = "2024-01-30 23:59:59"
OTHER_FAILURE_TEXT = "model call failed"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with line items. Line items are folded per part before the join."""
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("rating_number"))
    )
    return (
        table(spark, sf_dir, "part")
        .join(counts, F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("p_partkey").cast("string").alias("parent_asin"),
            F.col("p_type").alias("main_category"),
            F.col("p_name").alias("title"),
            (F.col("quantity") / F.col("rating_number") / 10).alias("average_rating"),
            "rating_number",
            F.col("p_brand").alias("features"),
            F.col("p_retailprice").alias("price"),
        )
    )


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same products as a raw category file would hold them, nested fields and all."""
    return metadata(spark, sf_dir).select(
        "main_category",
        "title",
        "average_rating",
        "rating_number",
        F.array("features").alias("features"),
        F.array("title", "main_category").alias("description"),
        F.col("price").cast("string").alias("price"),
        "parent_asin",
        F.array("main_category").alias("categories"),
        F.create_map(F.lit("brand"), "features").alias("details"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        (1 + (F.col("l_linenumber") + quantity) % 5).cast("double").alias("rating"),
        quantity.alias("helpful_vote"),
        F.col("l_shipdate").alias("timestamp"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string")).alias(
            "text"
        ),
        (line * 100000 + F.col("l_suppkey")).alias("id"),
    )


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    rating = (
        F.when(F.col("toxic") == 1, 2.0)
        .when(F.col("quality") == 0, 1.0)
        .when(F.col("quality") == 1, 5.0)
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("subject"),
        rating.alias("rating"),
        F.col("n_chars").alias("helpful_vote"),
        "text",
    )


def raw_reviews_from(events: DataFrame) -> DataFrame:
    """Dirty load input from the events table or stream."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 50
    return events.select(
        F.col("value").alias("rating"),
        F.col("event_type").alias("title"),
        F.col("props").alias("text"),
        F.col("user_id").cast("string").alias("asin"),
        (F.col("user_id") % 20).cast("string").alias("parent_asin"),
        F.when(kind == 0, -1).when(kind == 1, 4102444800).when(kind != 2, seconds)
        .alias("timestamp"),
        F.col("event_id").alias("helpful_vote"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reviews_from(table(spark, sf_dir, "events"))


def task_log_from(events: DataFrame) -> DataFrame:
    """Task log from the events table or stream."""
    status = (
        F.when(F.col("event_type") == "purchase", COMPLETED)
        .when(F.col("event_type") == "error", FAILED)
        .otherwise(RUNNING)
    )
    kind = F.col("event_id") % 4
    error = (
        F.when(kind == 0, F.format_string(INSUFFICIENT_TEXT, F.col("event_id") % 50, F.lit(50)))
        .when(kind == 1, NO_REVIEWS_TEXT)
        .when(kind == 2, FETCH_FAILED_TEXT % 404)
        .otherwise(OTHER_FAILURE_TEXT)
    )
    code = F.when(kind == 0, INSUFFICIENT).when(kind == 1, NO_REVIEWS).when(kind == 2, FETCH_FAILED).otherwise(ANALYSIS_FAILED)
    return events.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.concat(F.lit("subject-"), (F.col("user_id") % 20).cast("string")).alias("subject"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", error).alias("error"),
        "ts",
        "value",
        F.when(F.col("event_type") == "error", code).alias("error_code"),
    )


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_log_from(table(spark, sf_dir, "events"))


def pages(spark: SparkSession, sf_dir: str, *columns: str, upto: int | None = None) -> DataFrame:
    """Saved pages. ``columns`` of the raw table come along; page text only when asked for.

    ``upto`` bounds the page number, which lets each task drop later pages of a
    host before the shuffle.
    """
    host = clean_company_url(F.col("url"))
    w = Window.partitionBy("company").orderBy("page_id")
    numbered = (
        table(spark, sf_dir, "pages")
        .select("page_id", host.alias("company"), *columns)
        .withColumn("page_no", F.row_number().over(w))
    )
    if upto is not None:
        numbered = numbered.where(F.col("page_no") <= upto)
    status = F.when(F.col("page_id") % 7 == 3, 404).otherwise(200)
    return numbered.withColumns(
        {"page_no": F.col("page_no").cast("bigint"), "status_code": status}
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product facts for the subjects of ``text_reviews``."""
    number = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), number).alias("subject"),
        F.concat(F.lit("Product "), number).alias("title"),
        F.col("text").alias("features"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word table for reviews without rating: +1 or -1 by the items a word occurs in."""
    side = F.when(F.col("item_id") % 2 == 0, 1).otherwise(-1)
    return (
        table(spark, sf_dir, "benchmark")
        .select(side.alias("side"), F.explode(terms(F.col("text"))).alias("word"))
        .groupBy("word")
        .agg(F.signum(F.sum("side")).cast("int").alias("weight"))
        .where(F.col("weight") != 0)
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company facts for the subjects of ``text_reviews``."""
    customers = (
        table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    )
    key = F.col("n_nationkey")
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(customers, key == F.col("c_nationkey"), "left")
        .join(suppliers, key == F.col("s_nationkey"), "left")
        .select(
            F.concat(F.lit("src"), key.cast("string")).alias("subject"),
            F.col("r_name").alias("business_type"),
            F.col("n_name").alias("core_offerings"),
            F.col("customers").cast("string").alias("customer_base"),
            F.col("suppliers").cast("string").alias("market_presence"),
        )
    )


def host_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company facts for the hosts of ``pages``."""
    host = clean_company_url(F.col("url"))
    return (
        table(spark, sf_dir, "pages")
        .select(
            host.alias("subject"),
            F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("heading"),
        )
        .groupBy("subject")
        .agg(
            F.min("lang").alias("business_type"),
            F.min("heading").alias("core_offerings"),
            F.count("*").cast("string").alias("customer_base"),
        )
        .withColumn("market_presence", F.split_part("subject", F.lit("."), F.lit(-1)))
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_terms(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '(\\p{{L}}{{{MIN_LETTERS},}})', 1))"


def sql_host(column: str) -> str:
    return (
        f"trim(split_part(replace(replace(replace(trim(lower({column})), 'http://', ''), "
        "'https://', ''), 'www.', ''), '/', 1))"
    )


def sql_title_case(value: str) -> str:
    runs = f"regexp_extract_all({value}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def sql_company_name(column: str) -> str:
    return sql_title_case(f"replace(split_part({sql_host(column)}, '.', 1), '-', ' ')")


_FOUND, _REQUIRED = INSUFFICIENT_TEXT.split("%d", 2)[0], INSUFFICIENT_TEXT.split("%d", 2)[1:]


def sql_insufficient(found: str, required: str) -> str:
    return f"{_q(_FOUND)} || {found} || {_q(_REQUIRED[0])} || {required} || {_q(_REQUIRED[1])}"


SQL_VIEWS = {
    "fx_metadata": """
        SELECT cast(p_partkey AS varchar) AS parent_asin, p_type AS main_category,
               p_name AS title, quantity / rating_number / 10 AS average_rating, rating_number,
               p_brand AS features, p_retailprice AS price
        FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS quantity, count(*) AS rating_number
                        FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "fx_reviews": """
        SELECT cast(l_partkey AS varchar) AS parent_asin,
               cast(1 + (l_linenumber + cast(l_quantity AS bigint)) % 5 AS double) AS rating,
               cast(l_quantity AS bigint) AS helpful_vote, l_shipdate AS "timestamp",
               l_returnflag || ' ' || l_linestatus || ' ' || l_orderkey AS "text",
               (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS id
        FROM lineitem""",
    "fx_text": """
        SELECT d.doc_id AS id, d.source AS subject,
               CASE WHEN toxic = 1 THEN 2.0::double WHEN quality = 0 THEN 1.0::double
                    WHEN quality = 1 THEN 5.0::double END AS rating,
               n_chars AS helpful_vote, d."text" AS "text"
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_raw": """
        SELECT value AS rating, event_type AS title, props AS "text",
               cast(user_id AS varchar) AS asin, cast(user_id % 20 AS varchar) AS parent_asin,
               CASE event_id % 50 WHEN 0 THEN -1 WHEN 1 THEN 4102444800 WHEN 2 THEN NULL
                    ELSE cast(floor(epoch(ts)) AS bigint) END AS epoch_s,
               event_id AS helpful_vote
        FROM events""",
    "fx_tasks": f"""
        SELECT cast(user_id AS varchar) AS task_id, 'subject-' || (user_id % 20) AS subject,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                    ELSE 'running' END AS status,
               CASE WHEN event_type = 'error' THEN
                 CASE event_id % 4 WHEN 0 THEN {sql_insufficient('(event_id % 50)', '50')}
                      WHEN 1 THEN {_q(NO_REVIEWS_TEXT)} WHEN 2 THEN {_q(FETCH_FAILED_TEXT % 404)}
                      ELSE {_q(OTHER_FAILURE_TEXT)} END END AS error,
               ts, value,
               CASE WHEN event_type = 'error' THEN
                 CASE event_id % 4 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'no_reviews' WHEN 2 THEN 'fetch_failed'
                      ELSE 'analysis_failed' END END AS error_code
        FROM events""",
    "fx_latest": """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC,
            status IN ('completed', 'failed') DESC, status DESC, coalesce(error, '') DESC) AS rn
          FROM fx_tasks) WHERE rn = 1""",
    "fx_pages": f"""
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY page_id) AS page_no,
               cast(CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS integer) AS status_code
        FROM (SELECT page_id, {sql_host('url')} AS company, html FROM pages)""",
    "fx_kept": """
        SELECT * EXCLUDE (rn, bad) FROM (
          SELECT *, row_number() OVER w AS rn,
                 sum(CASE WHEN status_code <> 200 THEN 1 ELSE 0 END) OVER w AS bad
          FROM fx_pages
          WINDOW w AS (PARTITION BY company ORDER BY page_no ROWS UNBOUNDED PRECEDING))
        WHERE rn = page_no AND bad = 0""",
    "fx_ads": """
        SELECT company, page_no, generate_subscripts(found, 1) - 1 AS pos,
               replace(trim(unnest(found)), '&amp;', '&') AS "text"
        FROM (SELECT company, page_no,
                     regexp_extract_all(html, '<div class="ad">(.*?)</div>', 1, 's') AS found
              FROM fx_kept)""",
    "fx_gate": f"""
        SELECT company, reviews_count, outcome,
               CASE outcome
                 WHEN 'fetch_failed' THEN 'Error scraping reviews: Failed to find URL on Trustpilot, please use alternative URL or search for another company. Status code: ' || first_status
                 WHEN 'no_reviews' THEN {_q(NO_REVIEWS_TEXT)}
                 WHEN 'insufficient' THEN {sql_insufficient('reviews_count', '2')} END AS message
        FROM (
          SELECT c.company, coalesce(n, 0) AS reviews_count, first_status,
                 CASE WHEN coalesce(pages_read, 0) < 1 THEN 'fetch_failed'
                      WHEN coalesce(n, 0) = 0 THEN 'no_reviews'
                      WHEN n < 2 THEN 'insufficient' ELSE 'ok' END AS outcome
          FROM (SELECT company, max(CASE WHEN page_no = 1 THEN status_code END) AS first_status
                FROM fx_pages GROUP BY company) c
          LEFT JOIN (SELECT company, count(*) AS pages_read FROM fx_kept GROUP BY company) k
            ON c.company = k.company
          LEFT JOIN (SELECT company, count(*) AS n FROM fx_ads GROUP BY company) a
            ON c.company = a.company)""",
    "fx_passed": """
        SELECT * FROM fx_ads WHERE company IN (SELECT company FROM fx_gate WHERE outcome = 'ok')""",
    "fx_words": f"""
        SELECT word, cast(sign(sum(side)) AS integer) AS weight
        FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 1 ELSE -1 END AS side,
                     unnest({sql_terms('"text"')}) AS word FROM benchmark)
        GROUP BY word HAVING sum(side) <> 0""",
    "fx_subjects": """
        SELECT 'src' || item_id AS subject, 'Product ' || item_id AS title, "text" AS features
        FROM benchmark""",
    "fx_profiles": """
        SELECT 'src' || n_nationkey AS subject, r_name AS business_type, n_name AS core_offerings,
               cast(customers AS varchar) AS customer_base,
               cast(suppliers AS varchar) AS market_presence
        FROM nation JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1)
          ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
          ON n_nationkey = s_nationkey""",
    "fx_host_profiles": f"""
        SELECT subject, min(regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS business_type,
               min(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS core_offerings,
               cast(count(*) AS varchar) AS customer_base,
               split_part(subject, '.', -1) AS market_presence
        FROM (SELECT {sql_host('url')} AS subject, html FROM pages) GROUP BY subject""",
    # The text of a product's prompt is its 50 most helpful reviews; mining reads all.
    "fx_capped": """
        SELECT subject, ord, rating, "text" FROM (
          SELECT *, row_number() OVER (PARTITION BY subject
                   ORDER BY helpful_vote DESC NULLS LAST, id, "text") AS ord FROM fx_text)
        WHERE ord <= 50""",
    "fx_all": """SELECT subject, id AS ord, rating, "text" FROM fx_text""",
    "fx_word_rated": f"""
        SELECT r.subject, r.ord, r."text", 3.0 + 2 * sign(coalesce(weight, 0)) AS rating
        FROM (SELECT subject, ord, "text" FROM fx_unrated) r
        LEFT JOIN (SELECT subject, ord, sum(w.weight) AS weight
                   FROM (SELECT subject, ord, unnest({sql_terms('"text"')}) AS word FROM fx_unrated) u
                   JOIN fx_words w ON u.word = w.word GROUP BY subject, ord) h
          ON r.subject = h.subject AND r.ord = h.ord""",
}


def sql_points(source: str, exclude: str = "") -> dict[str, str]:
    """CTEs that mine ``source``: fx_terms, fx_stats, fx_points."""
    return {
        "fx_terms": f"""
            SELECT subject, ord, rating >= 4 AS good, unnest({sql_terms('"text"')}) AS term
            FROM {source} WHERE rating >= 4 OR rating <= 2""",
        "fx_stats": f"""
            SELECT subject, term, count(*) FILTER (good) AS pos_df,
                   count(*) FILTER (NOT good) AS neg_df, min(ord) FILTER (good) AS pos_ord,
                   min(ord) FILTER (NOT good) AS neg_ord
            FROM fx_terms {exclude} GROUP BY subject, term""",
        "fx_points": f"""
            SELECT p.subject, kind, rnk, term, own_df, diff, s."text" AS quote FROM (
              SELECT *, row_number() OVER (PARTITION BY subject, kind
                       ORDER BY diff DESC, own_df DESC, term) AS rnk FROM (
                SELECT subject, term, CASE WHEN pos_df > neg_df THEN 'praise' ELSE 'pain' END AS kind,
                       greatest(pos_df, neg_df) AS own_df, abs(pos_df - neg_df) AS diff,
                       CASE WHEN pos_df > neg_df THEN pos_ord ELSE neg_ord END AS ord
                FROM fx_stats WHERE pos_df <> neg_df)) p
            LEFT JOIN {source} s ON p.subject = s.subject AND p.ord = s.ord
            WHERE rnk <= CASE WHEN kind = 'praise' THEN 4 ELSE 3 END""",
    }


_NEEDS = {
    "fx_latest": ("fx_tasks",),
    "fx_kept": ("fx_pages",),
    "fx_ads": ("fx_kept",),
    "fx_gate": ("fx_ads",),
    "fx_passed": ("fx_gate",),
    "fx_capped": ("fx_text",),
    "fx_all": ("fx_text",),
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` under the named views and all they build on; ``extra`` views come last."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in _NEEDS.get(name, ()):
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    views = {n: SQL_VIEWS[n] for n in ordered} | (extra or {})
    ctes = ",\n".join(f"{n} AS ({text})" for n, text in views.items())
    return f"WITH {ctes}\n{body}" if views else body
