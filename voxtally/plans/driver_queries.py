"""The registered queries: every operator over the given tables, each beside its SQL.

A query without SQL is a stream with timers or a source whose format SQL does not
read; the unit tests cover those.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally import schemas
from voxtally.functions import prompts as pr
from voxtally.functions import status as st
from voxtally.functions import text as tx
from voxtally.functions import times as tm
from voxtally.operators import catalog, clean, insights, market, mining, tasks
from voxtally.operators import pages as pg
from voxtally.operators import reviews as rv
from voxtally.plans import analysis
from voxtally.plans import driver_views as dv
from voxtally.plans import flows, load, service
from voxtally.plans.driver_views import table, with_views
from voxtally.session import configure, shared_folder
from voxtally.sources import readers, writers
from voxtally.streaming import ingest
from voxtally.streaming import tasks as live

# Executors get the stand-in model below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TITLE, SEARCH = "blue bolt", "ring"
MODEL_FAILURE = dv.OTHER_FAILURE_TEXT
AD = {"tag": "div", "css_class": "ad"}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def as_of() -> Column:
    return F.lit(dv.AS_OF).cast("timestamp")


def us(c: str) -> Column:
    return tm.epoch_micros(F.col(c)).alias(f"{c}_us")


def text(c: str) -> Column:
    """A number that may be missing, as text: no reader then turns it into a fraction."""
    return F.col(c).cast("string")


# ---- sources and sinks ------------------------------------------------------


@query(
    "s1_scan_category",
    "SELECT event_id, event_type, user_id, value FROM events",
)
def s1(spark, sf):
    schema = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value").schema
    return readers.scan_category(spark, f"{sf}/events.parquet", schema)


@query(
    "s2_scan_categories",
    """SELECT doc_id, 'documents' AS category FROM documents
       UNION ALL SELECT doc_id, 'labels' FROM labels""",
)
def s2(spark, sf):
    schema = table(spark, sf, "labels").select("doc_id").schema
    paths = [f"{sf}/{t}.parquet" for t in ("documents", "labels")]
    both = readers.scan_categories(spark, paths, schema)
    # The table's own name, whether it is one file or a folder of files.
    category = F.regexp_extract("source_path", r"/(documents|labels)\.parquet", 1)
    return both.select("doc_id", category.alias("category"))


_RAW_LOADED = """SELECT rating, title, "text", asin, parent_asin, epoch_s, helpful_vote FROM fx_raw
    WHERE epoch_s BETWEEN 0 AND 2147483647 AND epoch_s >= epoch(TIMESTAMP '2024-01-01')
      AND epoch_s < epoch(TIMESTAMP '2025-01-01')"""


def _epoch_out(df: DataFrame) -> DataFrame:
    seconds = F.unix_seconds("timestamp").alias("epoch_s")
    return df.select("rating", "title", "text", "asin", "parent_asin", seconds, "helpful_vote")


@query("s4_write_reviews", with_views(_RAW_LOADED, "fx_raw"))
def s4(spark, sf):
    out = shared_folder(spark, "reviews")
    loaded = clean.load_reviews(dv.raw_reviews(spark, sf), 2024)
    writers.write_reviews(writers.with_review_id(loaded), out)
    return _epoch_out(spark.read.parquet(out))


@query(
    "s4_write_metadata",
    with_views(
        """SELECT main_category, title, average_rating, rating_number, parent_asin, price,
                  '["' || features || '"]' AS features, '{"brand":"' || features || '"}' AS details
           FROM fx_metadata WHERE rating_number > 20""",
        "fx_metadata",
    ),
)
def s4_metadata(spark, sf):
    out = shared_folder(spark, "metadata")
    writers.write_metadata(clean.load_metadata(dv.raw_metadata(spark, sf), 20), out)
    return spark.read.parquet(out).select(
        "main_category", "title", "average_rating", "rating_number", "parent_asin", "price",
        "features", "details",
    )


# Ids of two runs over rows in another order: each row has one id, and no other row has it.
@query(
    "s5_review_ids",
    "SELECT event_id, count(*) AS id_rows, 1 AS ids, count(*) // 1 AS rows_of_id FROM events GROUP BY event_id",
)
def s5(spark, sf):
    events = table(spark, sf, "events")
    runs = writers.with_review_id(events).unionByName(writers.with_review_id(events.repartition(7, "user_id")))
    ids = runs.groupBy("event_id", "id").agg((F.count("*") / 2).cast("bigint").alias("n"))
    sharing = ids.groupBy("id").agg(F.sum("n").alias("rows_of_id"))
    return ids.join(sharing, "id").groupBy("event_id").agg(
        F.sum("n").alias("id_rows"), F.count("*").cast("int").alias("ids"), F.max("rows_of_id").alias("rows_of_id")
    )


@query(
    "s6_review_pages",
    f"""SELECT {dv.sql_host('url')} AS company, page_id % 4 + 1 AS page_no,
               cast(length(html) AS integer) AS html_chars FROM pages""",
)
def s6(spark, sf):
    out = shared_folder(configure(spark), "saved-pages")
    saved = table(spark, sf, "pages").select(
        F.col("url").alias("company"), (F.col("page_id") % 4 + 1).cast("int").alias("page_no"),
        F.lit(200).alias("status_code"), "html",
    )
    saved.write.parquet(out)
    pages = readers.read_review_pages(spark, out)
    return pages.select("company", F.col("page_no").cast("bigint").alias("page_no"), F.length("html").alias("html_chars"))


@query(
    "s7_user_reviews",
    with_views(
        'SELECT rating, title, "text", parent_asin, cast(epoch_s AS varchar) AS "timestamp", helpful_vote FROM fx_raw',
        "fx_raw",
    ),
)
def s7(spark, sf):
    out = shared_folder(spark, "user-reviews")
    names = {
        "rating": "Stars", "title": "Heading", "text": "Body", "parent_asin": "Product",
        "timestamp": "Posted", "helpful_vote": "Votes",
    }
    given = dv.raw_reviews(spark, sf).select(*(F.col(a).alias(b) for a, b in names.items()))
    given.write.option("header", "true").option("escape", '"').csv(out)
    read = readers.read_user_reviews(spark, out, names).select(*names)
    return read.withColumn("timestamp", text("timestamp"))


# Lines of a user's file with one fault or another, by the number of their event.
_FAULTS = {0: "rating", 1: "timestamp", 2: "both", 3: "cut"}
_FAULT = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items()) + " ELSE 'none' END"


def _faulty_lines(spark, sf) -> DataFrame:
    """The events as JSON lines of a user's own making, some of them broken."""
    fault = F.expr(_FAULT)
    stars = F.when(fault.isin("rating", "both"), "five").otherwise(F.col("value").cast("string"))
    posted = F.when(fault.isin("timestamp", "both"), "today").otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    line = F.to_json(F.struct(stars.alias("Stars"), posted.alias("Posted"), F.col("props").alias("Body"), F.col("event_id").alias("Votes")))
    cut = F.expr("left(line, length(line) - 5)")
    return table(spark, sf, "events").select(fault.alias("fault"), line.alias("line")).select(
        F.when(F.col("fault") == "cut", cut).otherwise(F.col("line")).alias("value")
    )


_USER_NAMES = {"rating": "Stars", "timestamp": "Posted", "text": "Body", "helpful_vote": "Votes"}


@query(
    "s7_user_file_outcomes",
    f"""SELECT outcome, bad_columns, count(*) AS row_count, sum(votes) AS votes FROM (
          SELECT CASE {_FAULT} WHEN 'none' THEN 'good' WHEN 'cut' THEN 'corrupt_record' ELSE 'bad_value' END AS outcome,
                 CASE {_FAULT} WHEN 'rating' THEN 'rating' WHEN 'timestamp' THEN 'timestamp'
                      WHEN 'both' THEN 'rating,timestamp' END AS bad_columns,
                 CASE {_FAULT} WHEN 'none' THEN event_id ELSE 0 END AS votes FROM events)
        GROUP BY outcome, bad_columns""",
)
def s7_outcomes(spark, sf):
    out = shared_folder(configure(spark), "user-lines")
    _faulty_lines(spark, sf).write.text(out)
    good, rejected = readers.split_user_reviews(readers.user_review_rows(spark, out, _USER_NAMES, "json"))
    both = good.select(F.lit("good").alias("outcome"), F.lit(None).cast("string").alias("bad_columns"), "helpful_vote").unionByName(
        rejected.select(F.col("bad_reason").alias("outcome"), F.array_join("bad_columns", ",").alias("bad_columns"), F.lit(0).cast("bigint").alias("helpful_vote"))
    )
    return both.groupBy("outcome", "bad_columns").agg(F.count("*").alias("row_count"), F.sum("helpful_vote").alias("votes"))


_EVENT_OUTCOME = """CASE WHEN epoch_s IS NULL THEN 'null_timestamp'
    WHEN epoch_s NOT BETWEEN 0 AND 2147483647 THEN 'timestamp_out_of_range'
    WHEN epoch_s >= epoch(TIMESTAMP '2024-01-01') AND epoch_s < epoch(TIMESTAMP '2025-01-01') THEN 'loaded'
    ELSE 'other_year' END"""


@query(
    "f8_load_report",
    with_views(
        f"""SELECT 'reviews' AS table_name, {_EVENT_OUTCOME} AS outcome, count(*) AS row_count FROM fx_raw GROUP BY 2
            UNION ALL SELECT 'metadata', CASE WHEN rating_number > 20 THEN 'loaded' ELSE 'unpopular' END, count(*)
            FROM fx_metadata GROUP BY 2""",
        "fx_raw",
        "fx_metadata",
    ),
)
def f8_report(spark, sf):
    paths = [shared_folder(spark, x) for x in ("reviews", "metadata", "rejects")]
    return load.load_tables(dv.raw_reviews(spark, sf), dv.raw_metadata(spark, sf), *paths[:2], 2024, 20, rejects_path=paths[2])


@query(
    "f8_load_rejects",
    with_views(
        f"""SELECT 'reviews' AS table_name, {_EVENT_OUTCOME} AS bad_reason, helpful_vote FROM fx_raw
            WHERE {_EVENT_OUTCOME} NOT IN ('loaded', 'other_year')""",
        "fx_raw",
    ),
)
def f8_rejects(spark, sf):
    paths = [shared_folder(spark, x) for x in ("reviews", "metadata", "rejects")]
    load.load_tables(dv.raw_reviews(spark, sf), dv.raw_metadata(spark, sf), *paths[:2], 2024, 20, rejects_path=paths[2])
    vote = F.get_json_object("raw", "$.helpful_vote").cast("bigint").alias("helpful_vote")
    return spark.read.parquet(paths[2]).select("table_name", "bad_reason", vote)


# Stored twice, the second time one year alone: a load that runs again adds no row.
@query(
    "s3_stored_tables",
    with_views(
        """SELECT r.id, r.parent_asin, r.rating, year(r."timestamp") AS year, m.title AS product_title, m.average_rating
           FROM fx_reviews r JOIN fx_metadata m ON r.parent_asin = m.parent_asin""",
        "fx_reviews",
        "fx_metadata",
    ),
)
def s3(spark, sf):
    folder = shared_folder(configure(spark), "catalogue")
    name = folder.rpartition("/")[2].replace("-", "_")
    schemas.ensure_tables(spark, name, folder)
    given = dv.reviews(spark, sf)
    writers.store_metadata(dv.metadata(spark, sf), name)
    for part in (given, given.where(tm.in_year(F.col("timestamp"), 1998))):
        writers.store_reviews(part, name)
    joined = rv.reviews_with_metadata(spark.table(f"{name}.reviews"), spark.table(f"{name}.metadata"))
    return joined.select("id", "parent_asin", "rating", F.col("year").cast("bigint").alias("year"), "product_title", "average_rating")


@query(
    "s8_load_audit",
    with_views(
        """SELECT 'reviews' AS table_name, count(*) AS row_count FROM fx_reviews
           UNION ALL SELECT 'metadata', count(*) FROM fx_metadata""",
        "fx_reviews",
        "fx_metadata",
    ),
)
def s8(spark, sf):
    return readers.load_audit(
        {"reviews": dv.reviews(spark, sf), "metadata": dv.metadata(spark, sf)}
    )


@query(
    "s9_company_page_urls",
    f"""SELECT company, cast(page_no AS integer) AS page_no,
               'https://www.trustpilot.com/review/' || company || '?page=' || page_no AS page_url
        FROM (SELECT DISTINCT {dv.sql_host('url')} AS company FROM pages),
             (SELECT unnest(range(1, 5)) AS page_no)""",
)
def s9(spark, sf):
    hosts = table(spark, sf, "pages").select(tx.clean_company_url(F.col("url")).alias("company"))
    return readers.company_page_urls(hosts.distinct())


# ---- projections, filters, predicates --------------------------------------


@query(
    "f1_valid_epoch",
    with_views(
        """SELECT helpful_vote, cast(epoch_s AS varchar) AS epoch_s,
                  cast(epoch_s BETWEEN 0 AND 2147483647 AS varchar) AS valid FROM fx_raw""",
        "fx_raw",
    ),
)
def f1(spark, sf):
    return dv.raw_reviews(spark, sf).select(
        "helpful_vote",
        text("timestamp").alias("epoch_s"),
        tm.valid_epoch(F.col("timestamp")).cast("string").alias("valid"),
    )


@query(
    "f2_epoch_to_ts",
    with_views("SELECT helpful_vote, cast(epoch_s * 1000000 AS varchar) AS ts_us FROM fx_raw", "fx_raw"),
)
def f2(spark, sf):
    ts = tm.epoch_to_ts(F.col("timestamp"))
    micros = F.unix_micros(ts).cast("string")
    return dv.raw_reviews(spark, sf).select("helpful_vote", micros.alias("ts_us"))


@query(
    "f3_in_year",
    with_views(
        """SELECT id, parent_asin, epoch_us("timestamp") AS timestamp_us FROM fx_reviews
           WHERE year("timestamp") = 1998""",
        "fx_reviews",
    ),
)
def f3(spark, sf):
    kept = dv.reviews(spark, sf).where(tm.in_year(F.col("timestamp"), 1998))
    return kept.select("id", "parent_asin", us("timestamp"))


@query("f4_load_reviews", with_views(_RAW_LOADED, "fx_raw"))
def f4(spark, sf):
    return _epoch_out(clean.load_reviews(dv.raw_reviews(spark, sf), 2024))


@query(
    "f5_popular_metadata",
    with_views("SELECT parent_asin, rating_number FROM fx_metadata WHERE rating_number > 40", "fx_metadata"),
)
def f5(spark, sf):
    kept = clean.popular_metadata(dv.metadata(spark, sf), 40)
    return kept.select("parent_asin", "rating_number")


@query(
    "f6_project_metadata",
    with_views(
        """SELECT main_category, title, average_rating, rating_number, features AS feature,
                  title AS described_as, price, parent_asin, main_category AS category,
                  features AS brand FROM fx_metadata""",
        "fx_metadata",
    ),
)
def f6(spark, sf):
    rows = clean.project_metadata(dv.raw_metadata(spark, sf))
    return rows.select(
        "main_category", "title", "average_rating", "rating_number",
        F.col("features")[0].alias("feature"), F.col("description")[0].alias("described_as"),
        clean.real_affinity(F.col("price")).alias("price"), "parent_asin",
        F.col("categories")[0].alias("category"), F.col("details")["brand"].alias("brand"),
    )


@query(
    "f7_nested_to_json",
    with_views(
        """SELECT parent_asin, '["' || features || '"]' AS features,
                  '["' || title || '","' || main_category || '"]' AS description,
                  '["' || main_category || '"]' AS categories,
                  '{"brand":"' || features || '"}' AS details FROM fx_metadata""",
        "fx_metadata",
    ),
)
def f7(spark, sf):
    rows = clean.nested_to_json(dv.raw_metadata(spark, sf))
    return rows.select("parent_asin", *clean.NESTED_FIELDS)


_BAD = """CASE WHEN epoch_s IS NULL THEN 'null_timestamp'
    WHEN epoch_s NOT BETWEEN 0 AND 2147483647 THEN 'timestamp_out_of_range' END"""


@query(
    "f8_bad_rows",
    with_views(
        f"SELECT helpful_vote, cast(epoch_s AS varchar) AS epoch_s, {_BAD} AS bad_reason FROM fx_raw WHERE {_BAD} IS NOT NULL",
        "fx_raw",
    ),
)
def f8(spark, sf):
    raw = dv.raw_reviews(spark, sf)
    _, bad = clean.split_bad_rows(raw, clean.review_problem(raw))
    return bad.select("helpful_vote", text("timestamp").alias("epoch_s"), "bad_reason")


@query(
    "f8_bad_row_counts",
    with_views(
        f"""SELECT coalesce({_BAD}, 'ok') AS bad_reason, count(*) AS row_count
            FROM fx_raw GROUP BY 1""",
        "fx_raw",
    ),
)
def f8_counts(spark, sf):
    raw = dv.raw_reviews(spark, sf)
    return clean.bad_row_counts(raw, clean.review_problem(raw))


@query(
    "f9_coerce_types",
    """SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS bigint) AS brand_no,
              try_cast(p_brand AS double) AS not_a_number, p_retailprice AS price FROM part""",
)
def f9(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        clean.integer_affinity(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_no"),
        clean.real_affinity(F.col("p_brand")).alias("not_a_number"),
        clean.real_affinity(F.col("p_retailprice").cast("string")).alias("price"),
    )


_BEST = f"""SELECT * FROM fx_metadata WHERE title = '{TITLE}'
    ORDER BY rating_number DESC NULLS LAST, parent_asin LIMIT 1"""


@query("f10_lookup_title", with_views(f"SELECT title, features FROM ({_BEST})", "fx_metadata"))
def f10(spark, sf):
    return catalog.lookup_title(dv.metadata(spark, sf), TITLE)


@query(
    "f11_title_contains",
    with_views(
        f"SELECT parent_asin, title FROM fx_metadata WHERE contains(lower(title), '{SEARCH}')",
        "fx_metadata",
    ),
)
def f11(spark, sf):
    return catalog.title_contains(dv.metadata(spark, sf), SEARCH.upper()).select(
        "parent_asin", "title"
    )


_REJECT = """CASE WHEN coalesce(raw, '') = '' THEN 'No company URL provided'
    WHEN company = '' OR NOT contains(company, '.') THEN 'Invalid company URL format' END"""


@query(
    "f12_valid_company",
    f"""SELECT page_id, company, {_REJECT} AS reject_reason FROM (
          SELECT *, {dv.sql_host('raw')} AS company FROM (
            SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '' ELSE 'https://' || page_id END AS raw
            FROM pages))""",
)
def f12(spark, sf):
    kind = F.col("page_id") % 3
    raw = (
        F.when(kind == 0, F.col("url")).when(kind == 1, "")
        .otherwise(F.concat(F.lit("https://"), F.col("page_id").cast("string")))
    )
    asked = table(spark, sf, "pages").select("page_id", raw.alias("company_url"))
    return pg.validate_companies(asked).drop("company_url")


_KEPT = with_views("SELECT page_id, company, page_no FROM fx_kept", "fx_kept")


@query("f13_page_prefix", _KEPT)
def f13(spark, sf):
    kept = pg.keep_page_prefix(dv.pages(spark, sf))
    return kept.select("page_id", "company", "page_no")


@query(
    "f14_min_review_gate",
    with_views("SELECT company, reviews_count, outcome, message FROM fx_gate", "fx_gate"),
)
def f14(spark, sf):
    saved = dv.pages(spark, sf, "html")
    return pg.min_review_gate(saved, pg.company_reviews(saved, **AD), pg.page_limits(saved), 2)


@query(
    "f15_product_card",
    with_views(
        f"""SELECT title, main_category, average_rating, rating_number, '$' || price AS price
            FROM ({_BEST})""",
        "fx_metadata",
    ),
)
def f15(spark, sf):
    return catalog.product_card(dv.metadata(spark, sf), TITLE)


@query(
    "f15_all_product_cards",
    with_views(
        """SELECT title, main_category, average_rating, rating_number, '$' || price AS price
           FROM fx_metadata""",
        "fx_metadata",
    ),
)
def f15_all(spark, sf):
    return catalog.as_card(dv.metadata(spark, sf))


_BUSY = """SELECT parent_asin FROM fx_reviews WHERE year("timestamp") = 1998
    GROUP BY parent_asin HAVING count(*) > 5"""


@query(
    "f16_demo_reviews",
    with_views(
        f"""SELECT id, parent_asin, rating FROM fx_reviews
            WHERE year("timestamp") = 1998 AND parent_asin IN ({_BUSY})""",
        "fx_reviews",
    ),
)
def f16(spark, sf):
    kept, _ = catalog.demo_subset(dv.reviews(spark, sf), dv.metadata(spark, sf), 5, 1998)
    return kept.select("id", "parent_asin", "rating")


@query(
    "f16_demo_metadata",
    with_views(
        f"SELECT parent_asin, title FROM fx_metadata WHERE parent_asin IN ({_BUSY})",
        "fx_reviews",
        "fx_metadata",
    ),
)
def f16_metadata(spark, sf):
    _, kept = catalog.demo_subset(dv.reviews(spark, sf), dv.metadata(spark, sf), 5, 1998)
    return kept.select("parent_asin", "title")


@query(
    "f17_completed_for_product",
    with_views(
        """SELECT task_id, epoch_us(ts) AS ts_us FROM fx_tasks
           WHERE status = 'completed' AND subject = 'subject-3'""",
        "fx_tasks",
    ),
)
def f17(spark, sf):
    return tasks.completed_for(dv.task_log(spark, sf), "subject-3").select("task_id", us("ts"))


@query(
    "f17_completed_for_company",
    with_views(
        """SELECT task_id, epoch_us(ts) AS ts_us FROM fx_tasks
           WHERE status = 'completed' AND subject = 'subject-3'""",
        "fx_tasks",
    ),
)
def f17_company(spark, sf):
    stored = dv.task_log(spark, sf).withColumn(
        "subject", F.concat(F.lit("HTTPS://www."), "subject", F.lit(".com/page"))
    )
    found = tasks.completed_for(stored, " http://Subject-3.com", company=True)
    return found.select("task_id", us("ts"))


# ---- joins ------------------------------------------------------------------


@query(
    "j1_reviews_with_metadata",
    with_views(
        """SELECT r.id, r.parent_asin, r.rating, m.title AS product_title, m.price
           FROM fx_reviews r JOIN fx_metadata m ON r.parent_asin = m.parent_asin""",
        "fx_reviews",
        "fx_metadata",
    ),
)
def j1(spark, sf):
    both = rv.reviews_with_metadata(dv.reviews(spark, sf), dv.metadata(spark, sf))
    return both.select("id", "parent_asin", "rating", "product_title", "price")


@query(
    "j1_reviews_of_listed_products",
    with_views(
        """SELECT id, parent_asin, rating FROM fx_reviews
           WHERE parent_asin IN (SELECT parent_asin FROM fx_metadata WHERE rating_number > 30)""",
        "fx_reviews",
        "fx_metadata",
    ),
)
def j1_semi(spark, sf):
    popular = clean.popular_metadata(dv.metadata(spark, sf), 30)
    kept = rv.reviews_with_metadata(dv.reviews(spark, sf), popular, dedup=True)
    return kept.select("id", "parent_asin", "rating")


@query(
    "j2_title_to_parent",
    with_views(f"SELECT parent_asin FROM ({_BEST})", "fx_metadata"),
)
def j2(spark, sf):
    return catalog.title_to_parent(dv.metadata(spark, sf), TITLE)


@query(
    "j2_titles_to_parent",
    with_views(
        """SELECT title, parent_asin FROM (
             SELECT title, parent_asin, row_number() OVER (PARTITION BY title
                    ORDER BY rating_number DESC NULLS LAST, parent_asin) AS rn FROM fx_metadata)
           WHERE rn = 1""",
        "fx_metadata",
    ),
)
def j2_all(spark, sf):
    return catalog.titles_to_parent(dv.metadata(spark, sf))


@query(
    "j4_task_status",
    with_views(
        """SELECT i.task_id, coalesce(status, 'not_found') AS status, error,
                  cast(epoch_us(ts) AS varchar) AS ts_us
           FROM (SELECT cast(o_custkey AS varchar) AS task_id FROM orders GROUP BY o_custkey) i
           LEFT JOIN fx_latest l ON i.task_id = l.task_id""",
        "fx_latest",
    ),
)
def j4(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("task_id"))
    state = tasks.latest_per_key(dv.task_log(spark, sf))
    found = tasks.task_status(ids.distinct(), state).select("task_id", "status", "error", us("ts"))
    return found.withColumn("ts_us", text("ts_us"))


@query(
    "j5_company_profile",
    with_views(
        """SELECT s.subject, business_type, core_offerings, customer_base, market_presence
           FROM (SELECT DISTINCT subject FROM fx_text) s
           LEFT JOIN fx_profiles p ON s.subject = p.subject""",
        "fx_text",
        "fx_profiles",
    ),
)
def j5(spark, sf):
    return mining.company_profile(dv.text_reviews(spark, sf), dv.profiles(spark, sf))


# ---- aggregations -----------------------------------------------------------


@query(
    "a1_distinct_titles",
    with_views("SELECT title, max(rating_number) AS rating_number FROM fx_metadata GROUP BY title", "fx_metadata"),
)
def a1(spark, sf):
    return catalog.distinct_titles(dv.metadata(spark, sf))


@query("a2_row_count", "SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem")
def a2(spark, sf):
    return readers.load_audit({"lineitem": table(spark, sf, "lineitem")})


_NUMBERED = """SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY helpful_vote DESC NULLS LAST,
    "timestamp" DESC NULLS LAST, id, "text") AS review_no FROM fx_reviews"""


@query(
    "a3_reviews_text_numbered",
    with_views(
        f"""SELECT parent_asin, string_agg('Review ' || review_no || ': ' || "text", chr(10)
                   ORDER BY review_no) AS reviews_text
            FROM ({_NUMBERED}) WHERE review_no <= 20 GROUP BY parent_asin""",
        "fx_reviews",
    ),
)
def a3(spark, sf):
    return rv.reviews_text_numbered(dv.reviews(spark, sf), k=20)


@query(
    "a4_reviews_text_plain",
    with_views(
        """SELECT company, string_agg('Review: ' || "text", chr(10) ORDER BY page_no, pos)
                  AS reviews_text FROM fx_ads WHERE page_no <= 4 GROUP BY company""",
        "fx_ads",
    ),
)
def a4(spark, sf):
    return rv.reviews_text_plain(pg.company_reviews(dv.pages(spark, sf, "html"), **AD))


@query(
    "a5_company_review_bundle",
    with_views(
        """SELECT company, coalesce(string_agg("text", chr(10) ORDER BY page_no, pos) FILTER (page_no <= 4), '') AS reviews,
                  count(*) AS reviews_count FROM fx_ads GROUP BY company""",
        "fx_ads",
    ),
)
def a5(spark, sf):
    found = pg.company_reviews(dv.pages(spark, sf, "html"), **AD)
    return rv.company_review_bundle(found).withColumn("reviews", F.array_join("reviews", "\n"))


_NEWEST_DONE = """SELECT subject, task_id, epoch_us(ts) AS ts_us, value FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, task_id) AS rn
    FROM fx_tasks WHERE status = 'completed') WHERE rn = 1"""


@query("a6_latest_completed", with_views(_NEWEST_DONE, "fx_tasks"))
def a6(spark, sf):
    done = tasks.latest_completed(dv.task_log(spark, sf))
    return done.select("subject", "task_id", us("ts"), "value")


@query(
    "a7_status_counts",
    with_views("SELECT status, count(*) AS task_count FROM fx_tasks GROUP BY status", "fx_tasks"),
)
def a7(spark, sf):
    return tasks.status_counts(dv.task_log(spark, sf))


def _points_sql(kind: str, source: str, exclude: str = "", extra: dict | None = None) -> str:
    needs = [source] if source in dv.SQL_VIEWS else []
    return with_views(
        f"""SELECT subject, cast(rnk AS integer) AS rank, term, own_df, diff, quote FROM fx_points
            WHERE kind = '{kind}'""",
        *needs,
        extra=(extra or {}) | dv.sql_points(source, exclude),
    )


def _mined(spark, sf):
    return mining.most_helpful(dv.text_reviews(spark, sf))


def _all(spark, sf):
    return mining.all_reviews(dv.text_reviews(spark, sf))


@query("a8_praised_features", _points_sql("praise", "fx_all"))
def a8(spark, sf):
    return mining.praised_features(_mined(spark, sf))


@query("a8_company_strengths", _points_sql("praise", "fx_all"))
def a8_company(spark, sf):
    return mining.praised_features(_all(spark, sf))


_UNRATED = {"fx_unrated": 'SELECT subject, id AS ord, "text" FROM fx_text'}


@query(
    "a8_strengths_by_word_table",
    with_views(
        """SELECT subject, cast(rnk AS integer) AS rank, term, own_df, diff, quote FROM fx_points
           WHERE kind = 'praise'""",
        "fx_text",
        "fx_words",
        extra=_UNRATED | {"fx_word_rated": dv.SQL_VIEWS["fx_word_rated"]}
        | dv.sql_points("fx_word_rated"),
    ),
)
def a8_words(spark, sf):
    rated = mining.rate_by_words(_all(spark, sf), dv.words(spark, sf))
    return mining.praised_features(rated)


@query("a9_pain_points", _points_sql("pain", "fx_all"))
def a9(spark, sf):
    return mining.pain_points(_mined(spark, sf))


@query("a9_company_challenges", _points_sql("pain", "fx_all"))
def a9_company(spark, sf):
    return mining.pain_points(_all(spark, sf))


_COMMON = f"""WHERE term NOT IN (SELECT term FROM (
    SELECT unnest({dv.sql_terms('"text"')}) AS term FROM fx_all) GROUP BY term
    HAVING count(*) > 0.05 * (SELECT count(*) FROM fx_all))"""


@query("a9_challenges_without_common_terms", _points_sql("pain", "fx_all", _COMMON))
def a9_rare(spark, sf):
    return mining.pain_points(_all(spark, sf), max_share=0.05)


_LINES = "string_agg(rnk || '. ' || term || ' (' || own_df || ')', chr(10) ORDER BY rnk)"
_LISTS = {
    "fx_praise": f"SELECT subject, {_LINES} AS praise FROM fx_points WHERE kind = 'praise' GROUP BY subject",
    "fx_pain": f"SELECT subject, {_LINES} AS pain FROM fx_points WHERE kind = 'pain' GROUP BY subject",
}
_BEST_CHANGE = {
    "fx_change": f"""
        SELECT p.subject, p.term, p.own_df, q."text" AS quote FROM (
          SELECT subject, term, neg_df AS own_df, neg_ord AS ord,
                 row_number() OVER (PARTITION BY subject ORDER BY neg_df - pos_df DESC, neg_df DESC, term) AS rn
          FROM fx_stats p WHERE neg_df > pos_df AND NOT EXISTS (
            SELECT 1 FROM (SELECT subject, unnest({dv.sql_terms('features')}) AS term FROM fx_subjects) f
            WHERE f.subject = p.subject AND f.term = p.term)) p
        LEFT JOIN fx_all q ON p.subject = q.subject AND p.ord = q.ord WHERE rn = 1"""
}


@query(
    "a10_improvement_candidate",
    with_views(
        """SELECT s.subject, s.title, c.term AS improve_term, cast(c.own_df AS varchar) AS evidence, c.quote,
                  pain, praise
           FROM fx_subjects s LEFT JOIN fx_change c ON s.subject = c.subject
           LEFT JOIN fx_praise a ON s.subject = a.subject LEFT JOIN fx_pain b ON s.subject = b.subject""",
        "fx_subjects",
        "fx_all",
        extra=dv.sql_points("fx_all") | _LISTS | _BEST_CHANGE,
    ),
)
def a10(spark, sf):
    products = dv.subjects(spark, sf)
    found = mining.improvement_candidate(mining.product_points(_mined(spark, sf), products), None, products)
    return found.select(
        "subject", "title", "improve_term", text("evidence").alias("evidence"), "quote",
        insights.point_text(F.col("pain")).alias("pain"),
        insights.point_text(F.col("praise")).alias("praise"),
    )


def _company_profiles(spark, sf):
    return mining.company_profile(dv.text_reviews(spark, sf), dv.profiles(spark, sf))


_COMPANY = {
    "fx_company": """SELECT s.subject, business_type, core_offerings, customer_base, market_presence
        FROM (SELECT DISTINCT subject FROM fx_text) s LEFT JOIN fx_profiles p ON s.subject = p.subject"""
}


@query(
    "a11_strategy_candidates",
    with_views(
        """SELECT t.subject, cast(t.rnk AS integer) AS rank, t.term AS improve_term, t.own_df AS evidence, t.quote,
                  praise AS strengths, pain AS challenges, business_type, market_presence
           FROM fx_points t LEFT JOIN fx_praise a ON t.subject = a.subject
           LEFT JOIN fx_pain b ON t.subject = b.subject
           LEFT JOIN fx_company p ON t.subject = p.subject
           WHERE t.kind = 'pain' AND t.rnk <= 2""",
        "fx_all",
        "fx_profiles",
        extra=dv.sql_points("fx_all") | _LISTS | _COMPANY,
    ),
)
def a11(spark, sf):
    lists = mining.point_lists(mining.mine_points(_all(spark, sf)))
    found = mining.strategy_candidates(lists, _company_profiles(spark, sf))
    return found.select(
        "subject", "rank", "improve_term", "evidence", "quote",
        insights.point_text(F.col("strengths")).alias("strengths"),
        insights.point_text(F.col("challenges")).alias("challenges"),
        "business_type", "market_presence",
    )


@query(
    "j3_with_context",
    with_views(
        """SELECT s.subject, s.title, praise FROM fx_subjects s
           LEFT JOIN fx_praise a ON s.subject = a.subject""",
        "fx_subjects",
        "fx_all",
        extra=dv.sql_points("fx_all") | _LISTS,
    ),
)
def j3(spark, sf):
    lists = mining.point_lists(mining.mine_points(_mined(spark, sf)))
    products = dv.subjects(spark, sf).select("subject", "title")
    joined = mining.with_context(products, lists.select("subject", "praise"))
    return joined.withColumn("praise", insights.point_text(F.col("praise")))


@query(
    "a12_product_insights",
    with_views(
        """SELECT s.subject, praise AS output_0, pain AS output_1, 'Improve ' || c.term AS output_2
           FROM fx_subjects s LEFT JOIN fx_change c ON s.subject = c.subject
           LEFT JOIN fx_praise a ON s.subject = a.subject LEFT JOIN fx_pain b ON s.subject = b.subject""",
        "fx_subjects",
        "fx_all",
        extra=dv.sql_points("fx_all") | _LISTS | _BEST_CHANGE,
    ),
)
def a12(spark, sf):
    return flows.product_insights(dv.text_reviews(spark, sf), dv.subjects(spark, sf))


_PROFILE_LINES = """concat_ws(chr(10), 'business type: ' || business_type,
    'core offerings: ' || core_offerings, 'customer base: ' || customer_base,
    'market presence: ' || market_presence)"""
_STRATEGY = {
    "fx_strategy": """SELECT subject, string_agg('Improve ' || term, chr(10) ORDER BY rnk) AS strategy
        FROM fx_points WHERE kind = 'pain' AND rnk <= 2 GROUP BY subject"""
}


@query(
    "a12_company_insights",
    with_views(
        f"""SELECT p.company AS subject, {_PROFILE_LINES} AS output_0, praise AS output_1,
                   pain AS output_2, strategy AS output_3
            FROM (SELECT company FROM fx_gate WHERE outcome = 'ok') p
            LEFT JOIN fx_host_profiles h ON p.company = h.subject
            LEFT JOIN fx_praise a ON p.company = a.subject
            LEFT JOIN fx_pain b ON p.company = b.subject
            LEFT JOIN fx_strategy s ON p.company = s.subject""",
        "fx_passed",
        "fx_words",
        "fx_host_profiles",
        extra={
            "fx_unrated": """SELECT company AS subject, (page_no << 32) + pos AS ord, "text"
                FROM fx_passed""",
            "fx_word_rated": dv.SQL_VIEWS["fx_word_rated"],
        }
        | dv.sql_points("fx_word_rated")
        | _LISTS
        | _STRATEGY,
    ),
)
def a12_company(spark, sf):
    return flows.company_insights(
        dv.pages(spark, sf, "html"), dv.words(spark, sf), dv.host_profiles(spark, sf),
        **AD, n=2,
    )


# ---- windows, top-k, unions -------------------------------------------------


@query(
    "w1_top_reviews_per_product",
    with_views(
        f"""SELECT parent_asin, cast(review_no AS integer) AS review_no, id, rating, "text" FROM ({_NUMBERED})
            WHERE review_no <= 50""",
        "fx_reviews",
    ),
)
def w1(spark, sf):
    return rv.top_reviews_per_product(dv.reviews(spark, sf)).select(
        "parent_asin", "review_no", "id", "rating", "text"
    )


@query(
    "w2_page_limits",
    with_views(
        """SELECT a.company, cast(count(k.page_id) AS integer) AS pages_read
           FROM (SELECT DISTINCT company FROM fx_pages) a
           LEFT JOIN fx_kept k ON a.company = k.company GROUP BY a.company""",
        "fx_kept",
    ),
)
def w2(spark, sf):
    return pg.page_limits(dv.pages(spark, sf)).select("company", "pages_read")


@query(
    "w3_number_reviews",
    with_views(
        f"SELECT parent_asin, id, cast(review_no AS integer) AS review_no FROM ({_NUMBERED}) WHERE review_no <= 10", "fx_reviews"
    ),
)
def w3(spark, sf):
    return rv.number_reviews(dv.reviews(spark, sf), k=10).select("parent_asin", "id", "review_no")


_STATE = """SELECT task_id, subject, status, error, epoch_us(ts) AS ts_us, value FROM fx_latest"""


@query("w4_latest_per_key", with_views(_STATE, "fx_latest"))
def w4(spark, sf):
    return tasks.latest_per_key(dv.task_log(spark, sf)).select(
        "task_id", "subject", "status", "error", us("ts"), "value"
    )


@query(
    "l1_suggest_titles",
    with_views(
        f"""SELECT title, max(rating_number) AS rating_number FROM fx_metadata
            WHERE contains(lower(title), '{SEARCH}') GROUP BY title
            ORDER BY 2 DESC, 1 LIMIT 10""",
        "fx_metadata",
    ),
)
def l1(spark, sf):
    return catalog.suggest_titles(dv.metadata(spark, sf), SEARCH)


@query(
    "l2_top_reviews",
    with_views(
        f"""SELECT rating, "text", epoch_us("timestamp") AS timestamp_us FROM (
              SELECT r.* FROM fx_reviews r JOIN fx_metadata m ON r.parent_asin = m.parent_asin
              WHERE m.parent_asin = (SELECT parent_asin FROM ({_BEST}))
              ORDER BY helpful_vote DESC NULLS LAST, "timestamp" DESC NULLS LAST, id, "text"
              LIMIT 50)""",
        "fx_reviews",
        "fx_metadata",
    ),
)
def l2(spark, sf):
    found = rv.top_reviews(dv.reviews(spark, sf), dv.metadata(spark, sf), TITLE)
    return found.select("rating", "text", us("timestamp"))


@query(
    "l3_first_row",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""",
)
def l3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return catalog.first_row(orders, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    "u1_union_categories",
    with_views(
        """SELECT title AS category, count(*) AS row_count, cast(sum(rating) > 0 AS integer) AS rated FROM fx_raw
           WHERE title IN ('click', 'view') GROUP BY title""",
        "fx_raw",
    ),
)
def u1(spark, sf):
    raw = dv.raw_reviews(spark, sf)
    both = readers.union_categories(
        {
            "click": raw.where(F.col("title") == "click"),
            "view": raw.where(F.col("title") == "view").drop("asin"),
        }
    )
    return both.groupBy("category").agg(
        F.count("*").alias("row_count"), (F.sum("rating") > 0).cast("int").alias("rated")
    )


@query(
    "u2_union_tasks",
    with_views(
        """SELECT task_id, status, subject AS product_title, NULL::varchar AS company_url,
                  epoch_us(ts) AS ts_us FROM fx_tasks WHERE status <> 'failed'
           UNION ALL
           SELECT task_id, status, NULL, subject, epoch_us(ts) FROM fx_tasks WHERE status = 'failed'""",
        "fx_tasks",
    ),
)
def u2(spark, sf):
    log = dv.task_log(spark, sf)
    rows = lambda d, name: d.select("task_id", "status", F.col("subject").alias(name), us("ts"))
    failed = F.col("status") == st.FAILED
    return tasks.union_tasks(
        rows(log.where(~failed), "product_title"), rows(log.where(failed), "company_url")
    )


# ---- scalar functions -------------------------------------------------------


@query("x1_lower", 'SELECT doc_id, md5(lower("text")) AS lowered FROM documents')
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.lower("text")).alias("lowered"))


@query(
    "x2_like_pattern",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE lower('%R_ng%')",
)
def x2(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return catalog.title_contains(parts, "R_ng", wildcards=True, column="p_name")


@query("x3_length_gate", "SELECT p_partkey FROM part WHERE length(p_name) >= 9")
def x3(spark, sf):
    return table(spark, sf, "part").where(F.char_length("p_name") >= 9).select("p_partkey")


@query(
    "x4_strip_whitespace",
    """SELECT doc_id, md5(regexp_replace("text", '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')) AS stripped
       FROM (SELECT doc_id, ' ' || chr(9) || "text" || chr(10) || ' ' AS "text" FROM documents)""",
)
def x4(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.strip_ws(padded)).alias("stripped")
    )


@query("x5_replace_all", "SELECT page_id, replace(url, '/', '|') AS replaced FROM pages")
def x5(spark, sf):
    replaced = F.replace(F.col("url"), F.lit("/"), F.lit("|")).alias("replaced")
    return table(spark, sf, "pages").select("page_id", replaced)


@query("x6_first_part", "SELECT page_id, split_part(url, '/', 3) AS host FROM pages")
def x6(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host")
    )


@query("x7_contains", """SELECT doc_id, cast(contains("text", '.') AS integer) AS has_dot FROM documents""")
def x7(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").contains(".").cast("int").alias("has_dot")
    )


@query("x8_clean_company_url", f"SELECT page_id, {dv.sql_host('url')} AS company FROM pages")
def x8(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.clean_company_url(F.col("url")).alias("company")
    )


@query("x9_company_name", f"SELECT page_id, {dv.sql_company_name('url')} AS name FROM pages")
def x9(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.company_name(F.col("url")).alias("name"))


@query("x10_year", "SELECT o_orderkey, cast(year(o_orderdate) AS integer) AS order_year FROM orders")
def x10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("order_year"))


@query("x11_json_encode", """SELECT event_id, replace(props, ': ', ':') AS json FROM events""")
def x11(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", tx.json_text(parsed).alias("json"))


def _sql_prompt(task: str, **fields: str) -> str:
    return " || ".join(
        f"coalesce({fields.get(text, 'NULL')}, '{pr.MISSING}')"
        if is_field
        else "'" + text.replace("'", "''") + "'"
        for text, is_field in pr.template_parts(task)
    )


def _sql_prompts(
    names: tuple[str, ...], source: str, context: dict[str, str], first: int = 0, **fields: str
) -> str:
    return " UNION ALL ".join(
        f"""SELECT subject, cast({i} AS integer) AS task_pos, '{t}' AS task,
                   '{pr.LARGE_MODEL if t in pr.LARGE_MODEL_TASKS else pr.SMALL_MODEL}' AS model,
                   {_sql_prompt(t, context=context.get(t, 'NULL'), **fields)} AS prompt FROM {source}"""
        for i, t in enumerate(names, first)
    )


@query(
    "x12_product_prompts",
    with_views(
        _sql_prompts(
            pr.PRODUCT_TASKS, "fx_found", title="title", features="features", reviews="reviews",
            context={"improvement": "context"},
        ),
        "fx_subjects",
        "fx_capped",
        "fx_all",
        extra=dv.sql_points("fx_all")
        | _LISTS
        | {
            "fx_lines": """SELECT subject, string_agg('Review ' || ord || ': ' || "text", chr(10)
                ORDER BY ord) AS reviews FROM fx_capped GROUP BY subject""",
            "fx_found": """SELECT s.subject, title, features, reviews,
                    concat_ws(chr(10), pain, praise) AS context
                FROM fx_subjects s LEFT JOIN fx_lines l ON s.subject = l.subject
                LEFT JOIN fx_praise a ON s.subject = a.subject
                LEFT JOIN fx_pain b ON s.subject = b.subject""",
        },
    ),
)
def x12(spark, sf):
    return flows.product_prompt_table(dv.text_reviews(spark, sf), dv.subjects(spark, sf))


@query(
    "x12_company_prompts",
    with_views(
        _sql_prompts(
            pr.COMPANY_TASKS, "fx_found", company="name", reviews="reviews",
            context={"strategy": "context", "strengths": "profile", "challenges": "profile"},
        ),
        "fx_ads",
        "fx_words",
        "fx_host_profiles",
        extra={
            "fx_unrated": 'SELECT company AS subject, (page_no << 32) + pos AS ord, "text" FROM fx_ads',
            "fx_word_rated": dv.SQL_VIEWS["fx_word_rated"],
        }
        | dv.sql_points("fx_word_rated")
        | _LISTS
        | {
            "fx_lines": """SELECT company AS subject, string_agg('Review: ' || "text", chr(10)
                ORDER BY page_no, pos) AS reviews FROM fx_ads WHERE page_no <= 4 GROUP BY company""",
            "fx_found": f"""SELECT h.subject, {dv.sql_company_name('h.subject')} AS name, reviews,
                    {_PROFILE_LINES} AS profile,
                    concat_ws(chr(10), {_PROFILE_LINES}, praise, pain) AS context
                FROM fx_host_profiles h LEFT JOIN fx_lines l ON h.subject = l.subject
                LEFT JOIN fx_praise a ON h.subject = a.subject
                LEFT JOIN fx_pain b ON h.subject = b.subject""",
        },
    ),
)
def x12_company(spark, sf):
    found = flows.parsed_company_reviews(dv.pages(spark, sf, "html"), **AD)
    points = flows.company_points(found, dv.words(spark, sf))
    return flows.company_prompt_table(
        found, mining.point_lists(points), dv.host_profiles(spark, sf)
    )


@query(
    "x13_default_when_missing",
    with_views("""SELECT id, coalesce(cast(rating AS varchar), 'Not available') AS shown FROM fx_text""", "fx_text"),
)
def x13(spark, sf):
    shown = F.coalesce(F.col("rating").cast("string"), F.lit(pr.MISSING)).alias("shown")
    return dv.text_reviews(spark, sf).select("id", shown)


@query(
    "x14_task_id",
    with_views("SELECT md5(subject || '|' || epoch_us(ts)) AS task_key, subject FROM fx_tasks", "fx_tasks"),
)
def x14(spark, sf):
    key = st.task_id(F.col("subject"), tm.epoch_micros(F.col("ts"))).alias("task_key")
    return dv.task_log(spark, sf).select(key, "subject")


@query(
    "x15_age",
    with_views(
        f"""SELECT task_id, epoch_us(ts) AS ts_us,
                   epoch_us(TIMESTAMP '{dv.AS_OF}') - epoch_us(ts) AS age_us FROM fx_tasks""",
        "fx_tasks",
    ),
)
def x15(spark, sf):
    age = tm.age_micros(F.col("ts"), as_of()).alias("age_us")
    return dv.task_log(spark, sf).select("task_id", us("ts"), age)


@query(
    "x16_count_message",
    f"""SELECT source, {dv.sql_insufficient('n', '50')} AS message
        FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""",
)
def x16(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.select(
        "source", st.insufficient_message(F.col("n"), F.lit(50)).alias("message")
    )


_FAILURES = f"""SELECT task_id, subject, epoch_us(ts) AS ts_us, error, error_code,
    CASE WHEN error_code = 'insufficient' THEN '{st.INSUFFICIENT_NOTICE}' ELSE error END AS user_message
    FROM fx_tasks WHERE status = 'failed'"""


@query(
    "x17_user_message",
    with_views(f"SELECT error_code, user_message, count(*) AS n FROM ({_FAILURES}) GROUP BY 1, 2", "fx_tasks"),
)
def x17(spark, sf):
    failed = tasks.failure_log(dv.task_log(spark, sf))
    return failed.groupBy("error_code", "user_message").agg(F.count("*").alias("n"))


@query(
    "x18_terminal_status",
    with_views(
        """SELECT cast(status IN ('completed', 'failed') AS integer) AS terminal, count(*) AS task_count
           FROM fx_tasks GROUP BY 1""",
        "fx_tasks",
    ),
)
def x18(spark, sf):
    terminal = st.is_terminal(F.col("status")).cast("int").alias("terminal")
    return dv.task_log(spark, sf).groupBy(terminal).agg(F.count("*").alias("task_count"))


# ---- HTML extraction --------------------------------------------------------

_FOUND_ROWS = """SELECT page_id, generate_subscripts(found, 1) - 1 AS pos,
    replace(trim(unnest(found)), '&amp;', '&') AS {name}
    FROM (SELECT page_id, regexp_extract_all(html, '{pattern}', 1, 's') AS found FROM pages)"""


@query(
    "h1_extract_blocks",
    _FOUND_ROWS.format(name='"text"', pattern='<div class="ad">(.*?)</div>'),
)
def h1(spark, sf):
    return pg.extract_blocks(table(spark, sf, "pages"), **AD)


@query(
    "h1_extract_list_items",
    _FOUND_ROWS.format(name='"text"', pattern='<li><a href="[^"]*">(.*?)</a></li>'),
)
def h1_items(spark, sf):
    return pg.extract_blocks(table(spark, sf, "pages"), "li", None)


@query(
    "h2_extract_links",
    _FOUND_ROWS.format(name="value", pattern='<a href="([^"]*)"'),
)
def h2(spark, sf):
    return pg.extract_attr(table(spark, sf, "pages"), "href", "a", None)


@query(
    "h3_company_reviews",
    with_views('SELECT company, page_no, pos, "text" FROM fx_passed', "fx_passed"),
)
def h3(spark, sf):
    saved = dv.pages(spark, sf, "html")
    found = flows.parsed_company_reviews(saved, **AD)
    return pg.passing_reviews(found, pg.min_review_gate(saved, found, pg.page_limits(saved), 2))


# ---- task state and streaming ----------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of four files in shuffled time order, one a batch."""
    events = table(spark, sf, "events")
    folder = shared_folder(spark, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
    return ingest.scan_stream(spark, f"{folder}/part=*", events.schema, files_per_trigger=1)


def _folders(spark: SparkSession, purpose: str) -> tuple[str, str]:
    root = shared_folder(configure(spark), purpose)
    return f"{root}/out", f"{root}/checkpoint"


@query("t1_ingest_stream", with_views(_RAW_LOADED, "fx_raw"))
def t1(spark, sf):
    out, checkpoint = _folders(spark, "ingest")
    raw = dv.raw_reviews_from(_event_stream(spark, sf))
    ingest.ingest_stream(
        raw, lambda d: clean.load_reviews(d, 2024), out, checkpoint
    ).awaitTermination()
    return _epoch_out(spark.read.parquet(out))


def _arrivals(spark: SparkSession, sf: str, parts: int = 4) -> tuple[DataFrame, str]:
    """The events as a stream that comes in roughly by time, and by how much rows can be late.

    Files are written one period after the other, so the stream reads them in that order;
    rows near the edge of a period come with the one before or after.
    """
    events = table(spark, sf, "events")
    time, jitter = F.unix_micros(F.col("ts").cast("timestamp")), 6 * 3600 * 1_000_000
    low, high = events.agg(F.min(time), F.max(time)).first()
    period = ((high or 0) - (low or 0)) // parts + 1
    moved = time + F.pmod(F.xxhash64("event_id"), F.lit(2 * jitter)) - jitter - (low or 0)
    part = F.least(F.greatest(F.floor(moved / period), F.lit(0)), F.lit(parts - 1))
    folder = shared_folder(spark, "events")
    for i in range(parts):
        events.where(part == i).write.mode("append").parquet(folder)
    # A period has a file per task that wrote it. Batches go by periods, so that their number does not grow with the table.
    files = max(1, len(spark.read.schema(events.schema).parquet(folder).inputFiles()) // parts)
    late = (period + 2 * jitter) // 1_000_000 + 1
    return ingest.scan_stream(spark, folder, events.schema, files_per_trigger=files), f"{late} seconds"


@query("t2_task_state_stream", with_views(_STATE, "fx_latest"))
def t2(spark, sf):
    out, checkpoint = _folders(spark, "task-state")
    events, late = _arrivals(spark, sf)
    live.run_task_state(dv.task_log_from(events), out, checkpoint, late).awaitTermination()
    return live.read_task_state(spark, out).select(
        "task_id", "subject", "status", "error", us("ts"), "value"
    )


@query("t3_latest_completed_stream", with_views(_NEWEST_DONE, "fx_tasks"))
def t3(spark, sf):
    out, checkpoint = _folders(spark, "latest-completed")
    live.run_latest_completed(
        dv.task_log_from(_event_stream(spark, sf)), out, checkpoint
    ).awaitTermination()
    return live.read_latest_completed(spark, out).select("subject", "task_id", us("ts"), "value")


_KEPT_TASKS = f"""SELECT task_id, status, epoch_us(ts) AS ts_us FROM fx_latest
    WHERE NOT (status IN ('completed', 'failed')
               AND epoch_us(TIMESTAMP '{dv.AS_OF}') - epoch_us(ts) > 3600000000)"""


@query("t4_expire_tasks", with_views(_KEPT_TASKS, "fx_latest"))
def t4(spark, sf):
    state = tasks.latest_per_key(dv.task_log(spark, sf))
    return tasks.expire_tasks(state, as_of()).select("task_id", "status", us("ts"))


# The stream's clock is the newest time it has seen.
@query(
    "t4_expiring_task_stream",
    with_views(
        """SELECT task_id, status, epoch_us(ts) // 1000 AS ts_ms FROM fx_latest
           WHERE NOT (status IN ('completed', 'failed')
                      AND (SELECT max(epoch_us(ts)) FROM fx_tasks) - epoch_us(ts) > 3600000000)""",
        "fx_latest",
    ),
)
def t4_stream(spark, sf):
    out, checkpoint = _folders(spark, "expiry")
    events, late = _arrivals(spark, sf)
    live.run_expiring_tasks(dv.task_log_from(events), out, checkpoint, late).awaitTermination()
    return live.read_live_tasks(spark, out)


@query(
    "t5_classify_timeouts",
    with_views(
        f"""SELECT l.task_id, epoch_us(first_ts) AS first_ts_us, epoch_us(l.ts) AS last_ts_us,
                   CASE WHEN status NOT IN ('completed', 'failed')
                         AND epoch_us(TIMESTAMP '{dv.AS_OF}') - epoch_us(first_ts) >= 180000000
                        THEN 'timeout' ELSE status END AS outcome
            FROM fx_latest l JOIN (SELECT task_id, min(ts) AS first_ts FROM fx_tasks GROUP BY 1) f
              ON l.task_id = f.task_id""",
        "fx_latest",
    ),
)
def t5(spark, sf):
    found = tasks.classify_timeouts(dv.task_log(spark, sf), as_of())
    return found.select("task_id", us("first_ts"), us("last_ts"), "outcome")


@query("t6_failure_log", with_views(_FAILURES, "fx_tasks"))
def t6(spark, sf):
    return tasks.failure_log(dv.task_log(spark, sf)).select(
        "task_id", "subject", us("ts"), "error", "error_code", "user_message"
    )


# ---- models -----------------------------------------------------------------


def _length_model():
    """A repeatable stand-in for a text model: it fails on every prompt of even length."""

    def answer(prompt: str, model: str | None) -> str:
        if len(prompt) % 2 == 0:
            raise ValueError(MODEL_FAILURE)
        return f"{model}: {len(prompt)}"

    return answer


_LENGTH_MODEL_SQL = f"""SELECT doc_id, CASE WHEN length("text") % 2 = 1
         THEN '{pr.SMALL_MODEL}: ' || length("text") END AS output,
       CASE WHEN length("text") % 2 = 0 THEN '{dv.OTHER_FAILURE_TEXT}' END AS error FROM documents"""


@query("p1_map_prompts", _LENGTH_MODEL_SQL)
def p1(spark, sf):
    asked = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("prompt"), pr.route_model(F.lit("pain_points")).alias("model")
    )
    return insights.map_prompts(asked, _length_model).select("doc_id", "output", "error")


def _digest_model():
    """A repeatable stand-in whose answer depends on all of the prompt; it fails on some."""
    from hashlib import md5

    def answer(prompt: str, model: str | None) -> str:
        digest = md5(prompt.encode()).hexdigest()
        if digest[0] == "0":
            raise ValueError(MODEL_FAILURE)
        return digest

    return answer


def _sql_stages(stages, source: str, **fields: str) -> dict[str, str]:
    """CTEs that run the stages with the digest model: fx_answers holds all answers."""
    ctes: dict[str, str] = {}
    seen: list[str] = []
    for n, stage in enumerate(stages):
        context = {t: "concat_ws(chr(10), " + ", ".join(pr.CONTEXT_TASKS[t]) + ")" for t in stage} if n else {}
        wide = ", ".join(f"max(output) FILTER (task = '{t}') AS {t}" for t in seen)
        ctes[f"fx_wait{n}"] = (
            f"""SELECT s.*, a.* EXCLUDE (subject) FROM {source} s JOIN (
                  SELECT subject, {wide} FROM fx_done{n - 1} GROUP BY subject
                  HAVING count(error) = 0) a ON s.subject = a.subject"""
            if n
            else f"SELECT * FROM {source}"
        )
        earlier = f"SELECT * FROM fx_done{n - 1} UNION ALL" if n else ""
        ctes[f"fx_done{n}"] = f"""{earlier}
            SELECT subject, task_pos, task,
                   CASE WHEN md5(prompt) NOT LIKE '0%' THEN md5(prompt) END AS output,
                   CASE WHEN md5(prompt) LIKE '0%' THEN '{MODEL_FAILURE}' END AS error
            FROM ({_sql_prompts(stage, f'fx_wait{n}', context, len(seen), **fields)})"""
        seen += stage
    outputs = ", ".join(f"max(output) FILTER (task_pos = {i}) AS output_{i}" for i in range(len(seen)))
    ctes["fx_answers"] = f"""SELECT subject, max(error) AS error,
            CASE WHEN count(error) = 0 THEN 'completed' ELSE 'failed' END AS status,
            CASE WHEN count(error) > 0 THEN 'analysis_failed' END AS error_code, {outputs}
        FROM fx_done{len(stages) - 1} GROUP BY subject"""
    return ctes


_PRODUCT_ANSWERS = {
    "fx_titles": """SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY title ORDER BY rating_number DESC NULLS LAST, parent_asin) AS rn
        FROM fx_metadata) WHERE rn = 1""",
    "fx_asked": f"""
        SELECT b.title AS subject, b.title, b.features, reviews FROM fx_titles b
        LEFT JOIN (SELECT parent_asin, string_agg('Review ' || review_no || ': ' || "text", chr(10)
                          ORDER BY review_no) AS reviews
                   FROM ({_NUMBERED}) WHERE review_no <= 50 GROUP BY parent_asin) t
          ON b.parent_asin = t.parent_asin""",
} | _sql_stages(pr.PRODUCT_STAGES, "fx_asked", title="title", features="features", reviews="reviews")

_COMPANY_ANSWERS = {
    "fx_asked": f"""SELECT company AS subject, {dv.sql_company_name('company')} AS name,
            string_agg('Review: ' || "text", chr(10) ORDER BY page_no, pos) AS reviews
        FROM fx_passed WHERE page_no <= 4 GROUP BY company"""
} | _sql_stages(pr.COMPANY_STAGES, "fx_asked", company="name", reviews="reviews")


@query("p1_analyze_products", with_views("SELECT * FROM fx_answers", "fx_metadata", "fx_reviews", extra=_PRODUCT_ANSWERS))
def p1_products(spark, sf):
    return analysis.analyze_products(
        dv.reviews(spark, sf), dv.metadata(spark, sf), _digest_model
    )


@query(
    "p1_analyze_companies",
    with_views(
        """SELECT * FROM fx_answers UNION ALL BY NAME
           SELECT company AS subject, 'failed' AS status, message AS error, outcome AS error_code FROM fx_gate
           WHERE message IS NOT NULL""",
        "fx_passed",
        extra=_COMPANY_ANSWERS,
    ),
)
def p1_companies(spark, sf):
    return analysis.analyze_companies(
        dv.pages(spark, sf, "html"), _digest_model, **AD, n=2
    )


# From request to page: the tasks are logged, and pages are read from the log.
@query(
    "p1_product_pages",
    with_views(
        """SELECT a.subject AS title, t.main_category, t.average_rating, t.rating_number, '$' || t.price AS price,
                  output_0, output_1, output_2
           FROM fx_answers a JOIN fx_titles t ON a.subject = t.title WHERE a.status = 'completed'""",
        "fx_metadata",
        "fx_reviews",
        extra=_PRODUCT_ANSWERS,
    ),
)
def p1_product_pages(spark, sf):
    log, products = shared_folder(spark, "analysis-log"), dv.metadata(spark, sf)
    service.run_product_analyses(products, dv.reviews(spark, sf), products, _digest_model, log, as_of())
    return service.product_pages(products, service.read_log(spark, log)).drop("ts")


def _company_log(spark, sf) -> DataFrame:
    """The log after all hosts of the pages table were asked for, by their raw addresses, and one unknown."""
    log, saved = shared_folder(spark, "analysis-log"), table(spark, sf, "pages")
    unknown = saved.agg(F.lit("https://www.nowhere.example/page").alias("company_url"))
    asked = saved.select(F.col("url").alias("company_url")).unionByName(unknown)
    service.run_company_analyses(asked, dv.pages(spark, sf, "html"), _digest_model, log, as_of(), **AD, n=2)
    return service.read_log(spark, log)


@query(
    "p1_company_pages",
    with_views(
        """SELECT subject AS company, output_0, output_1, output_2, output_3 FROM fx_answers
           WHERE status = 'completed'""",
        "fx_passed",
        extra=_COMPANY_ANSWERS,
    ),
)
def p1_company_pages(spark, sf):
    return service.company_pages(_company_log(spark, sf)).drop("ts")


@query(
    "t6_analysis_failures",
    with_views(
        f"""SELECT subject, error, error_code,
                   CASE WHEN error_code = 'insufficient' THEN '{st.INSUFFICIENT_NOTICE}' ELSE error END AS user_message
            FROM (SELECT subject, error, error_code FROM fx_answers WHERE status = 'failed'
                  UNION ALL SELECT company, message, outcome FROM fx_gate WHERE message IS NOT NULL
                  UNION ALL SELECT 'nowhere.example', '{st.FETCH_FAILED_TEXT % "None"}', 'fetch_failed')""",
        "fx_passed",
        extra=_COMPANY_ANSWERS,
    ),
)
def t6_analyses(spark, sf):
    states = tasks.latest_per_key(_company_log(spark, sf))
    return tasks.failure_log(states).select("subject", "error", "error_code", "user_message")


@query(
    "p2_route_model",
    f"""SELECT o_orderkey, task, CASE WHEN task IN ('improvement', 'strategy')
               THEN '{pr.LARGE_MODEL}' ELSE '{pr.SMALL_MODEL}' END AS model
        FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'improvement'
                     WHEN 1 THEN 'strategy' ELSE 'pain_points' END AS task FROM orders)""",
)
def p2(spark, sf):
    kind = F.col("o_orderkey") % 3
    task = F.when(kind == 0, "improvement").when(kind == 1, "strategy").otherwise("pain_points")
    rows = table(spark, sf, "orders").select("o_orderkey", task.alias("task"))
    return rows.withColumn("model", pr.route_model(F.col("task")))


# ---- market -----------------------------------------------------------------


@query(
    "e1_rating_trend",
    with_views(
        """SELECT parent_asin, cast("month" AS varchar) AS "month", avg_rating, review_count,
                  avg_rating - lag(avg_rating) OVER (PARTITION BY parent_asin ORDER BY "month") AS change
           FROM (SELECT parent_asin, cast(date_trunc('month', "timestamp") AS date) AS "month",
                        avg(rating) AS avg_rating, count(*) AS review_count
                 FROM fx_reviews GROUP BY 1, 2)""",
        "fx_reviews",
    ),
)
def e1(spark, sf):
    trend = market.rating_trend(dv.reviews(spark, sf))
    return trend.withColumn("month", F.col("month").cast("string"))


@query(
    "e2_review_keywords",
    with_views(
        """SELECT subject, cast(rnk AS integer) AS rank, term, tf, df, score FROM (
             SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, term) AS rnk FROM (
               SELECT t.subject, t.term, tf, df, round(tf * ln((SELECT count(DISTINCT subject) FROM fx_text) / df), 4) AS score
               FROM fx_tf t JOIN (SELECT term, count(*) AS df FROM fx_tf GROUP BY term) d ON t.term = d.term))
           WHERE rnk <= 10""",
        "fx_text",
        extra={
            "fx_tf": f"""SELECT subject, term, count(*) AS tf FROM (
                SELECT subject, unnest({dv.sql_terms('"text"')}) AS term FROM fx_text) GROUP BY 1, 2"""
        },
    ),
)
def e2(spark, sf):
    return market.review_keywords(dv.text_reviews(spark, sf))


_BANDS = """SELECT parent_asin, main_category, cast(floor((rank() OVER (PARTITION BY main_category ORDER BY price) - 1) * 4
    / count(*) OVER (PARTITION BY main_category)) AS integer) + 1 AS band FROM fx_metadata"""


@query(
    "e3_price_bands",
    with_views(_BANDS, "fx_metadata"),
)
def e3_bands(spark, sf):
    bands = market.price_bands(dv.metadata(spark, sf))
    return bands.select("parent_asin", "main_category", "band")


@query(
    "e3_price_feedback",
    with_views(
        f"""SELECT main_category, band, count(*) AS product_count, cast(sum(n) AS bigint) AS review_count,
                   sum(rating_sum) / sum(rated) AS avg_rating, sum(named) / sum(n) AS price_share
            FROM ({_BANDS}) b JOIN (
              SELECT parent_asin, count(*) AS n, sum(rating) AS rating_sum, count(rating) AS rated,
                     count(*) FILTER (regexp_matches(lower("text"), '\\b(r|o)\\b')) AS named
              FROM fx_reviews GROUP BY parent_asin) r ON b.parent_asin = r.parent_asin
            GROUP BY main_category, band""",
        "fx_metadata",
        "fx_reviews",
    ),
)
def e3(spark, sf):
    return market.price_feedback(
        dv.reviews(spark, sf), dv.metadata(spark, sf), price_words=("r", "o")
    )


@query(
    "e4_competitor_gap",
    with_views(
        """SELECT m.parent_asin, m.main_category, own_sum / own_n AS own_rating,
                  (all_sum - own_sum) / nullif(all_n - own_n, 0) AS other_rating,
                  own_sum / own_n - (all_sum - own_sum) / nullif(all_n - own_n, 0) AS gap
           FROM fx_metadata m JOIN fx_own o ON m.parent_asin = o.parent_asin
           JOIN (SELECT main_category, sum(own_sum) AS all_sum, cast(sum(own_n) AS bigint) AS all_n
                 FROM fx_metadata m2 JOIN fx_own o2 ON m2.parent_asin = o2.parent_asin
                 GROUP BY main_category) c ON m.main_category = c.main_category""",
        "fx_metadata",
        "fx_reviews",
        extra={
            "fx_own": """SELECT parent_asin, sum(rating) AS own_sum, count(rating) AS own_n
                FROM fx_reviews GROUP BY parent_asin"""
        },
    ),
)
def e4(spark, sf):
    return market.competitor_gap(dv.reviews(spark, sf), dv.metadata(spark, sf))
