"""Sources, cleaning and stored tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtally import schemas
from voxtally.functions import times as tm
from voxtally.operators import catalog, clean
from voxtally.operators import reviews as rv
from voxtally.plans import load
from voxtally.sources import readers, writers


def epoch(*ymdhms):
    return int((datetime(*ymdhms) - datetime(1970, 1, 1)).total_seconds())


STAMPS = {
    -1: "timestamp_out_of_range",
    0: None,
    2147483647: None,
    2147483648: "timestamp_out_of_range",
    None: "null_timestamp",
}


@pytest.fixture
def raw(spark):
    stamps = [
        *STAMPS, epoch(2022, 12, 31, 23, 59, 59), epoch(2023, 1, 1), epoch(2023, 12, 31, 23, 59, 59),
        epoch(2024, 1, 1),
    ]
    data = [(4.0, "t", f"text {i}", "A", "P", s, None if i % 2 else i) for i, s in enumerate(stamps)]
    return spark.createDataFrame(data, schemas.RAW_REVIEW_SCHEMA)


def test_bad_rows_have_a_reason_and_none_is_lost(raw, rows):
    good, bad = clean.split_bad_rows(raw, clean.review_problem(raw))
    assert {r.timestamp: r.bad_reason for r in bad.collect()} == {
        k: v for k, v in STAMPS.items() if v
    }
    assert good.count() + bad.count() == raw.count()
    assert rows(clean.bad_row_counts(raw, clean.review_problem(raw))) == [
        ("null_timestamp", 1), ("ok", 6), ("timestamp_out_of_range", 2),
    ]


def test_load_keeps_the_year_only(raw):
    kept = {r.timestamp for r in clean.load_reviews(raw).collect()}
    assert kept == {datetime(2023, 1, 1), datetime(2023, 12, 31, 23, 59, 59)}


def test_load_in_milliseconds(raw):
    ms = raw.withColumn("timestamp", F.col("timestamp") * 1000)
    assert clean.load_reviews(ms, unit="ms").count() == 2
    assert clean.load_reviews(ms, year=None, unit="ms").count() == 6
    assert clean.load_reviews(raw, year=None).count() == 6


def test_year_filter_on_stored_reviews(spark, raw):
    stored = clean.load_reviews(raw, year=None)
    assert stored.where(tm.in_year(F.col("timestamp"), 2022)).count() == 1


META = [
    ("Toys", "Ring", 4.5, 50, ["a"], ["d"], "12.5", "P1", ["c"], {"k": "v"}),
    ("Toys", "Ring", 4.5, 51, ["é", None], ["d"], "None", "P2", [], {"k": None}),
    ("Toys", "Bolt", 4.5, None, None, None, None, "P3", None, None),
    ("Toys", "Bolt", 4.5, 99, ["a"], ["d"], "7", "P2", ["c"], {}),
]


def test_metadata_load(spark):
    meta = spark.createDataFrame(META, schemas.RAW_METADATA_SCHEMA)
    got = clean.load_metadata(meta).orderBy("rating_number").collect()
    assert [(r.parent_asin, r.rating_number, r.price) for r in got] == [("P2", 51, None), ("P2", 99, 7.0)]
    assert json.loads(got[0].features) == ["é", None]
    assert json.loads(got[0].details) in ({"k": None}, {})
    good, bad = clean.split_bad_rows(meta, clean.metadata_problem(meta))
    assert (good.count(), [r.bad_reason for r in bad.collect()]) == (3, ["null_rating_number"])


def test_json_columns_come_back(spark):
    meta = spark.createDataFrame(META, schemas.RAW_METADATA_SCHEMA)
    text = clean.nested_to_json(meta)
    back = clean.json_to_nested(text, {"features": "array<string>", "details": "map<string,string>"})
    assert sorted(map(str, (r.features for r in back.collect()))) == sorted(
        map(str, (r.features for r in meta.collect()))
    )
    plain = spark.createDataFrame([("x",)], "details string")
    assert clean.nested_to_json(plain, ("details",)).first().details == '"x"'


def test_affinity(spark):
    df = spark.createDataFrame([("3.0", "x"), ("7", "2.5"), ("", None)], "n string, r string")
    got = df.select(clean.integer_affinity(F.col("n")), clean.real_affinity(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(3, None), (7, 2.5), (None, None)]


def test_corrupt_json_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rating": 1.0, "timestamp": 5}\n{"rating": \n')
    raw = readers.scan_category(spark, str(tmp_path), schemas.RAW_REVIEW_SCHEMA, "json")
    reasons = {r.bad_reason for r in clean.tag_bad_rows(raw, clean.review_problem(raw)).collect()}
    assert reasons == {None, "corrupt_record"}


def test_categories_in_one_scan(spark, tmp_path, raw):
    for name in ("one", "two"):
        raw.coalesce(1).write.parquet(str(tmp_path / name))
    both = readers.scan_categories(
        spark, [str(tmp_path / "one"), str(tmp_path / "two")], schemas.RAW_REVIEW_SCHEMA
    )
    assert both.count() == 2 * raw.count()
    assert both.select("source_path").distinct().count() == 2


def test_user_file(spark, tmp_path):
    (tmp_path / "mine.csv").write_text('Stars,Body\n5,"good, ""really"""\nbad,plain\n')
    got = readers.read_user_reviews(
        spark, str(tmp_path / "mine.csv"), {"rating": "Stars", "text": "Body"}
    )
    assert [tuple(r) for r in got.select("rating", "text", "asin").collect()] == [
        (5.0, 'good, "really"', None), (None, "plain", None),
    ]


def test_ids_repeat_and_copies_share(spark, raw):
    twice = writers.with_review_id(raw.union(raw))
    assert twice.select("id").distinct().count() == raw.count()


def test_tables_are_created_once(spark):
    for _ in range(2):
        schemas.ensure_tables(spark, "shop")
    assert spark.table("shop.reviews").columns == [f.name for f in schemas.REVIEWS_SCHEMA] + ["year"]
    assert spark.table("shop.metadata").count() == 0


def test_load_flow_writes_both_tables(spark, tmp_path, raw):
    meta = spark.createDataFrame(META, schemas.RAW_METADATA_SCHEMA)
    out = str(tmp_path / "r"), str(tmp_path / "m")
    load.load_tables(raw, meta, *out)
    assert spark.read.parquet(out[0]).select("year").distinct().collect()[0][0] == 2023
    assert spark.read.parquet(out[1]).count() == 2


def test_hot_product_is_written_by_many_tasks(spark, tmp_path):
    """A third of all rows in one product still spread over the range partitions."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("parent_asin"),
        F.lit("t").alias("text"), F.lit(1.0).alias("rating"), F.lit("t").alias("title"),
        F.lit("a").alias("asin"), F.col("id").alias("helpful_vote"),
        F.lit(datetime(2023, 5, 1)).alias("timestamp"),
    )
    writers.write_reviews(writers.with_review_id(df), str(tmp_path / "r"), files_per_load=8)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 9000
    hot = back.where("parent_asin = 'hot'").select(F.input_file_name().alias("f")).distinct()
    assert hot.count() >= 2


def test_page_urls(spark, rows):
    got = readers.company_page_urls(spark.createDataFrame([("a.com",)], "company string"), 2)
    assert [r[2] for r in rows(got)] == [
        "https://www.trustpilot.com/review/a.com?page=1",
        "https://www.trustpilot.com/review/a.com?page=2",
    ]


def test_demo_subset_counts_strictly(spark):
    data = [("P1", datetime(2023, 1, 1))] * 3 + [("P2", datetime(2023, 1, 1))] * 2 + [
        ("P2", datetime(2022, 1, 1))
    ]
    reviews = spark.createDataFrame(data, "parent_asin string, timestamp timestamp")
    meta = spark.createDataFrame([("P1",), ("P2",)], "parent_asin string")
    kept, products = catalog.demo_subset(reviews, meta, 2)
    assert (kept.count(), [r[0] for r in products.collect()]) == (3, ["P1"])


BROKEN = [
    '5,"good, ""really""",7', "bad,plain,1", "4,too few", "4,too,many,fields", '3,"open quote,2', "x,two bad,y", ",,",
    "2,fine,12.0",
]
MINE = {"rating": "Stars", "text": "Body", "helpful_vote": "Votes"}


def test_lines_of_a_user_file_are_good_or_rejected(spark, tmp_path):
    (tmp_path / "mine.csv").write_text("\n".join(["Stars,Body,Votes", *BROKEN]) + "\n")
    rows = readers.user_review_rows(spark, str(tmp_path / "mine.csv"), MINE)
    good, rejected = readers.split_user_reviews(rows)
    assert good.columns == schemas.RAW_REVIEW_SCHEMA.names
    assert {tuple(r) for r in good.select("rating", "text", "helpful_vote").collect()} == {
        (5.0, 'good, "really"', 7), (None, None, None), (2.0, "fine", 12),
    }
    found = {(r.bad_reason, tuple(r.bad_columns or ())): r.raw for r in rejected.collect()}
    assert found["bad_value", ("rating",)] == '{"Stars":"bad","Body":"plain","Votes":"1"}'
    assert ("bad_value", ("rating", "helpful_vote")) in found
    assert rejected.where("bad_reason = 'corrupt_record'").count() == 3
    assert good.count() + rejected.count() == len(BROKEN)


def test_json_user_file_is_read_by_name_alone(spark, tmp_path):
    lines = ['{"Stars": 4, "Body": "b", "other": [1]}', '{"Stars": "four"}', '{"Stars": ', "{}"]
    (tmp_path / "mine.json").write_text("\n".join(lines) + "\n")
    rows = readers.user_review_rows(spark, str(tmp_path / "mine.json"), {"rating": "Stars", "text": "Body"}, "json")
    got = [(r.rating, r.text, r.bad_reason) for r in rows.collect()]
    assert got == [(4.0, "b", None), (None, None, "bad_value"), (None, None, "corrupt_record"), (None, None, None)]


def test_user_files_are_cut_unless_values_hold_line_breaks(spark, tmp_path):
    path = str(tmp_path / "long.csv")
    with open(path, "w") as f:
        f.write("Stars,Body,Votes\n" + "".join(f'{i % 5},"text of line {i}",{i}\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100KB")
    try:
        parts = [readers.user_review_rows(spark, path, MINE, multi_line=m).rdd.getNumPartitions() for m in (False, True)]
        assert parts[0] > 4 and parts[1] == 1
        assert readers.read_user_reviews(spark, path, MINE).agg(F.sum("helpful_vote")).first()[0] == sum(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "breaks.csv").write_text('Stars,Body,Votes\n5,"two\nlines",1\n')
    assert readers.read_user_reviews(spark, str(tmp_path / "breaks.csv"), MINE, multi_line=True).first().text == "two\nlines"


def test_unknown_column_of_a_user_file_is_an_error(spark, tmp_path):
    (tmp_path / "mine.csv").write_text("Stars,Body\n1,x\n")
    with pytest.raises(ValueError, match="Votes"):
        readers.user_review_rows(spark, str(tmp_path / "mine.csv"), MINE)


def test_user_file_load_accounts_for_every_line(spark, tmp_path):
    lines = [f"{i % 5},text {i},{epoch(2023, 1, 1 + i)}" for i in range(5)] + ["5,no time,", "5,late,99999999999", "x,y,1", "1,2"]
    (tmp_path / "mine.csv").write_text("\n".join(["Stars,Body,Posted", *lines]) + "\n")
    out, bad = str(tmp_path / "reviews"), str(tmp_path / "bad")
    names = {"rating": "Stars", "text": "Body", "timestamp": "Posted"}
    report = load.load_user_reviews(spark, str(tmp_path / "mine.csv"), names, out, bad)
    counts = {r.outcome: r.row_count for r in report.collect()}
    assert counts == {"loaded": 5, "null_timestamp": 1, "timestamp_out_of_range": 1, "bad_value": 1, "corrupt_record": 1}
    assert sum(counts.values()) == len(lines) and spark.read.parquet(out).count() == 5
    rejects = {r.bad_reason: r.raw for r in spark.read.parquet(bad).collect()}
    assert rejects.keys() == counts.keys() - {"loaded"} and "1,2" in rejects["corrupt_record"]


def test_load_reports_every_row_of_one_read(spark, tmp_path, raw):
    """Counts add up, rejects are kept with their reason, and the raw rows are read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    meta = spark.createDataFrame(META, schemas.RAW_METADATA_SCHEMA)
    read = raw.mapInArrow(count, raw.schema)
    paths = [str(tmp_path / x) for x in ("r", "m")]
    report = load.load_tables(read, meta, *paths, rejects_path=str(tmp_path / "bad"))
    assert seen.value == raw.count()
    assert {(r.table_name, r.outcome): r.row_count for r in report.collect()} == {
        ("reviews", "loaded"): 2, ("reviews", "other_year"): 4, ("reviews", "null_timestamp"): 1,
        ("reviews", "timestamp_out_of_range"): 2, ("metadata", "loaded"): 2, ("metadata", "unpopular"): 1,
        ("metadata", "null_rating_number"): 1,
    }
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.table_name, r.bad_reason) for r in bad.collect()) == [
        ("metadata", "null_rating_number"), ("reviews", "null_timestamp"),
        ("reviews", "timestamp_out_of_range"), ("reviews", "timestamp_out_of_range"),
    ]
    assert json.loads(bad.where("table_name = 'metadata'").first().raw)["parent_asin"] == "P3"


def test_milliseconds_show_as_rejected(spark, tmp_path, raw):
    ms = raw.where("timestamp > 0").withColumn("timestamp", F.col("timestamp") * 1000)
    meta = spark.createDataFrame([], schemas.RAW_METADATA_SCHEMA)
    report = load.load_tables(ms, meta, str(tmp_path / "r"), str(tmp_path / "m"))
    found = {(r.table_name, r.outcome): r.row_count for r in report.collect()}
    assert found == {("reviews", "loaded"): 0, ("reviews", "timestamp_out_of_range"): 6, ("metadata", "loaded"): 0}


@pytest.fixture
def shop(spark, tmp_path):
    """A catalogue with a product that holds a third of all reviews."""
    name = f"shop_{tmp_path.name}".replace("-", "_")
    schemas.ensure_tables(spark, name, str(tmp_path / "db"), 8)
    reviews = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("parent_asin"),
        F.lit("t").alias("text"), (F.col("id") % 5).cast("double").alias("rating"), F.lit("t").alias("title"),
        F.lit("a").alias("asin"), F.col("id").alias("helpful_vote"),
        F.timestamp_seconds(F.when(F.col("id") % 2 == 0, epoch(2022, 5, 1)).otherwise(epoch(2023, 5, 1))).alias("timestamp"),
    )
    reviews = writers.with_review_id(reviews)
    meta = reviews.select("parent_asin").distinct().select("parent_asin", F.lit("t").alias("title"), F.lit(1.0).alias("price"))
    writers.store_reviews(reviews, name)
    writers.store_metadata(meta, name)
    return name, reviews, meta


def test_stored_tables_join_and_rank_without_a_shuffle(spark, shop):
    name, reviews, meta = shop
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, products = spark.table(f"{name}.reviews"), spark.table(f"{name}.metadata")
        joined = rv.reviews_with_metadata(stored, products)
        ranked = rv.top_reviews_per_product(stored, 3)
        for df in (joined, ranked):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        want = rv.reviews_with_metadata(reviews, meta)
        assert joined.count() == 9000 and joined.select("id", "price").exceptAll(want.select("id", "price")).isEmpty()
        best = rv.top_reviews_per_product(reviews, 3).select("id", "review_no")
        assert ranked.select("id", "review_no").exceptAll(best).isEmpty() and ranked.count() == best.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_storing_again_replaces_the_years_it_has(spark, shop):
    name, reviews, meta = shop
    writers.store_reviews(reviews.where(F.year("timestamp") == 2023), name)
    writers.store_metadata(meta, name)
    assert (spark.table(f"{name}.reviews").count(), spark.table(f"{name}.metadata").count()) == (9000, meta.count())
    writers.store_reviews(reviews.where((F.year("timestamp") == 2023) & (F.col("id") > 0)), name)
    assert spark.table(f"{name}.reviews").where("year = 2022").count() == 4500
    assert spark.table(f"{name}.reviews").where("year = 2023").count() < 4500


def test_hot_product_is_stored_by_many_tasks(spark, shop):
    stored = spark.table(f"{shop[0]}.reviews").where("year = 2023")
    files = stored.groupBy(F.input_file_name().alias("f")).agg(F.count_if(F.col("parent_asin") == "hot").alias("hot"))
    assert sum(r.hot > 0 for r in files.collect()) >= 4


def test_catalogue_load_runs_again(spark, tmp_path, raw):
    schemas.ensure_tables(spark, "again", str(tmp_path / "db"), 4)
    meta = spark.createDataFrame(META, schemas.RAW_METADATA_SCHEMA)
    for _ in range(2):
        load.load_catalogue(raw, meta, "again")
    assert (spark.table("again.reviews").count(), spark.table("again.metadata").count()) == (2, 2)
