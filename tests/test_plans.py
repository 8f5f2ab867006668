"""Physical plans that must not regress, and the market reports on small data."""

import re
from datetime import date, datetime

from pyspark.sql import functions as F

from __spark_entry__ import queries
from voxtally.operators import market, skew
from voxtally.operators import pages as pg
from voxtally.operators import reviews as rv
from voxtally.plans.driver_queries import QUERIES

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


def reuses_shuffle(text):
    return re.search(r"ReusedExchange [^\n]*\], Exchange hashpartitioning", text) is not None


def test_suggestions_are_a_top_k(spark):
    assert "TakeOrderedAndProject(limit=10" in plan(queries()["l1_suggest_titles"](spark, SF))


def test_year_filter_reaches_the_scan(spark):
    text = plan(queries()["f3_in_year"](spark, SF))
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


def test_scan_reads_only_needed_columns(spark):
    text = plan(queries()["a1_distinct_titles"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint>" in text


def test_no_query_needs_a_cross_join(spark):
    streams = ("t1", "t2", "t3", "t4", "s4", "s7", "h3", "a12_c", "x12_c")
    for name, fn in QUERIES.items():
        if not name.startswith(streams):
            text = plan(fn(spark, SF))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_texts_are_read_and_shuffled_once_for_keywords(spark):
    assert reuses_shuffle(run_plan(queries()["e2_review_keywords"](spark, SF)))


def test_ranks_of_points_are_bounded_before_the_shuffle(spark):
    text = run_plan(queries()["a8_praised_features"](spark, SF))
    assert "WindowGroupLimit" in text


def test_terms_are_hash_aggregated(spark):
    text = plan(queries()["a9_company_challenges"](spark, SF))
    # Only the few chosen points, folded to one quote each, may be sorted.
    sorted_keys = re.findall(r"SortAggregate\(key=\[([^\]]*)\]", text)
    assert "partial_count" in text and all("rank" in keys for keys in sorted_keys)


def test_hot_product_join_is_split(spark):
    """A product with a third of all reviews: its shuffle partition is cut into several tasks."""
    reviews = spark.range(200000, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9000).cast("string"))
        .alias("parent_asin"), F.repeat(F.col("id").cast("string"), 30).alias("text"),
    )
    names = F.when(F.col("id") == 9000, "hot").otherwise(F.col("id").cast("string"))
    meta = spark.range(9001).select(
        names.alias("parent_asin"), F.lit("t").alias("title"), F.lit(1.0).alias("price")
    )
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        joined = rv.reviews_with_metadata(reviews, meta)
        assert len(joined.collect()) == 200000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_salted_joins_keep_every_row(spark):
    """The same rows as the plain join, a hot key in many parts."""
    data = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k")
    )
    busy = data.groupBy("k").agg(F.count("*").alias("n")).where("n > 400")
    for how in ("inner", "left_semi", "left_anti", "left"):
        for weight in (None, "n"):
            plain = data.join(busy.drop(weight) if weight else busy, "k", how)
            salted = skew.salted_join(data, busy, ["k"], how, F.col("id"), weight)
            assert salted.columns == plain.columns
            assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def keyed_rows(spark, hot):
    key = F.when(F.col("id") % 3 < hot, "hot").otherwise((F.col("id") % 9001).cast("string"))
    rows = spark.range(90000).select("id", key.alias("k"))
    return rows, rows.groupBy("k").agg(F.count("*").alias("n"))


def test_a_third_of_all_rows_is_spread_over_the_tasks(spark, monkeypatch):
    """Found by exact weights, by a sketch, or by a sketch of some rows: no task has twice the median."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows, keyed = keyed_rows(spark, 1)
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        for kw in ({"weight": "n"}, {}, {"sample": rows.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0)}):
            joined = skew.salted_join(rows, keyed, ["k"], "inner", F.col("id"), **kw)
            sizes = sorted(r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect())
            assert sum(sizes) == 90000 and len(sizes) == 8 and sizes[-1] < 2 * sizes[4], (kw, sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nothing_is_repeated_where_no_key_is_heavy(spark):
    rows, keyed = keyed_rows(spark, 0)
    assert skew.heavy_keys(rows, ["k"], 8).isEmpty() and skew.weighty_keys(keyed, ["k"], "n", 8).isEmpty()
    rows, keyed = keyed_rows(spark, 1)
    for heavy in (skew.heavy_keys(rows, ["k"], 8), skew.weighty_keys(keyed, ["k"], "n", 8)):
        assert [r._parts for r in heavy.collect()] == [22]  # a third of all rows, in eighths of an eighth


def test_sketch_reads_the_key_alone(spark):
    reviews = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = plan(skew.heavy_keys(reviews, ["l_partkey"], 8))
    assert "ReadSchema: struct<l_partkey:bigint>" in text and "SortAggregate" not in text


def test_hot_product_of_demo_subset_is_spread(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()["f16_demo_reviews"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"hashpartitioning\(parent_asin#\d+, _part#\d+", text)) == 2


def test_price_bands_share_equal_prices(spark):
    prices = [1.0, 1.0, 1.0, 2.5, 3.25, 3.75, 9.0, 900.0]
    meta = spark.createDataFrame(
        [(str(i), "c", p) for i, p in enumerate(prices)] + [("n", "c", None)],
        "parent_asin string, main_category string, price double",
    )
    got = {r.parent_asin: r.band for r in market.price_bands(meta).collect()}
    assert got == {"0": 1, "1": 1, "2": 1, "3": 2, "4": 3, "5": 3, "6": 4, "7": 4}


def test_trend_and_gap(spark):
    reviews = spark.createDataFrame(
        [
            ("P1", 4.0, datetime(2023, 1, 5)), ("P1", 2.0, datetime(2023, 1, 9)),
            ("P1", 5.0, datetime(2023, 3, 1)), ("P2", 1.0, datetime(2023, 1, 1)),
        ],
        "parent_asin string, rating double, timestamp timestamp",
    )
    trend = market.rating_trend(reviews).where("parent_asin = 'P1'").orderBy("month").collect()
    assert [(r.month, r.avg_rating, r.change) for r in trend] == [
        (date(2023, 1, 1), 3.0, None), (date(2023, 3, 1), 5.0, 2.0),
    ]
    meta = spark.createDataFrame([("P1", "c"), ("P2", "c"), ("P3", "d")], "parent_asin string, main_category string")
    gap = {r.parent_asin: r.gap for r in market.competitor_gap(reviews, meta).collect()}
    assert gap == {"P1": 11 / 3 - 1.0, "P2": 1.0 - 11 / 3}


def test_lone_product_has_no_competitor(spark):
    reviews = spark.createDataFrame([("P1", 4.0)], "parent_asin string, rating double")
    meta = spark.createDataFrame([("P1", "c")], "parent_asin string, main_category string")
    row = market.competitor_gap(reviews, meta).first()
    assert (row.own_rating, row.other_rating, row.gap) == (4.0, None, None)


def test_price_words(spark):
    reviews = spark.createDataFrame(
        [("1", 5.0, "good Price!"), ("1", 1.0, "priceless"), ("2", 3.0, None)],
        "parent_asin string, rating double, text string",
    )
    meta = spark.createDataFrame(
        [("1", "c", 1.0), ("2", "c", 2.0)], "parent_asin string, main_category string, price double"
    )
    got = market.price_feedback(reviews, meta, bands=2).orderBy("band").collect()
    assert [(r.band, r.review_count, r.avg_rating, r.price_share) for r in got] == [
        (1, 2, 3.0, 0.5), (2, 1, 3.0, 0.0),
    ]


def test_texts_are_mined_once(spark):
    """All findings of a product come from one explode of its reviews' terms."""
    for name in ("a10_improvement_candidate", "a12_product_insights"):
        text = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        exploded = [x for x in text.splitlines() if "Generate explode(array_distinct" in x]
        assert len(exploded) == 2, name  # the reviews' terms, and those of the listed features


def test_pages_pass_the_rule_before_they_are_parsed(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr(
        "url company", "cast(page_id as int) page_no", "200 status_code", "html"
    )
    text = pg.company_reviews(pages, "div", "ad")._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInPandas") < text.index("Join LeftSemi")
