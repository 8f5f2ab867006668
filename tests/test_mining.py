"""Mining, context and insight tables against a plain count."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxtally.functions.prompts import PRODUCT_TASKS
from voxtally.operators import insights, mining
from voxtally.plans import analysis, flows

WORDS = "battery screen sound price colour strap cover hinge motor smell cable".split()


def make_reviews(n, seed=3):
    """A third of all reviews belong to one subject."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        subject = "hot" if i % 3 == 0 else f"s{rng.randrange(12)}"
        text = " ".join(rng.choices(WORDS, k=rng.randrange(0, 7)))
        out.append((i, subject, rng.choice([1.0, 2.0, 3.0, 4.0, 5.0, None]), rng.randrange(20), text))
    return out


def plain_points(data):
    """``data``: (subject, ord, rating, text). Brute-force statement of the rule."""
    good, bad, first = defaultdict(int), defaultdict(int), {}
    texts = {(s, o): t for s, o, _, t in data}
    for s, o, rating, text in data:
        if rating is None or 2 < rating < 4:
            continue
        side = good if rating >= 4 else bad
        for term in set(re.findall(r"[^\W\d_]{3,}", text.lower())):
            side[s, term] += 1
            key = (s, term, rating >= 4)
            first[key] = min(first.get(key, o), o)
    ranked = defaultdict(list)
    for s, term in set(good) | set(bad):
        diff = good[s, term] - bad[s, term]
        if diff:
            own = max(good[s, term], bad[s, term])
            quote = texts[s, first[s, term, diff > 0]]
            ranked[s, "praise" if diff > 0 else "pain"].append((-abs(diff), -own, term, quote))
    return sorted(
        (s, kind, i + 1, term, -own, -diff, quote)
        for (s, kind), items in ranked.items()
        for i, (diff, own, term, quote) in enumerate(sorted(items)[: 4 if kind == "praise" else 3])
    )


COLUMNS = ("subject", "kind", "rank", "term", "own_df", "diff", "quote")
SCHEMA = "id long, subject string, rating double, helpful_vote long, text string"


@pytest.fixture
def data():
    return make_reviews(900)


@pytest.fixture
def reviews(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_company_points_equal_plain_count(reviews, data, rows):
    want = plain_points([(s, i, r, t) for i, s, r, _, t in data])
    assert rows(mining.mine_points(mining.all_reviews(reviews)), *COLUMNS) == want


def test_product_points_use_the_most_helpful_only(reviews, data, rows):
    by_subject = defaultdict(list)
    for i, s, r, v, t in data:
        by_subject[s].append((-v, i, r, t))
    capped = [
        (s, n + 1, r, t)
        for s, items in by_subject.items()
        for n, (_, _, r, t) in enumerate(sorted(items, key=lambda x: x[:2])[:50])
    ]
    assert rows(mining.mine_points(mining.most_helpful(reviews, 50)), *COLUMNS) == plain_points(capped)


def test_shared_ids_give_one_quote(spark, reviews, data):
    copies = reviews.union(reviews)
    points = mining.mine_points(mining.all_reviews(copies))
    assert points.count() == len(plain_points([(s, i, r, t) for i, s, r, _, t in data]))


def test_common_terms_can_be_left_out(spark):
    data = [(i, "s", 5.0, 1, "always rare" if i == 0 else "always") for i in range(10)]
    df = mining.all_reviews(spark.createDataFrame(data, SCHEMA))
    assert [r.term for r in mining.praised_features(df).collect()] == ["always", "rare"]
    assert [r.term for r in mining.praised_features(df, max_share=0.5).collect()] == ["rare"]


def test_rating_from_words(spark, rows):
    df = spark.createDataFrame(
        [("s", 1, "great great awful"), ("s", 2, "great fine"), ("s", 3, "awful"), ("s", 4, None)],
        "subject string, ord long, text string",
    ).withColumn("rating", F.lit(None).cast("double"))
    words = spark.createDataFrame([("great", 1), ("fine", 1), ("awful", -1)], "word string, weight int")
    got = dict(rows(mining.rate_by_words(df, words), "ord", "rating"))
    assert got == {1: 3.0, 2: 5.0, 3: 1.0, 4: 3.0}


PRODUCTS = [("s", "Watch", "long battery life"), ("t", "Lamp", None), ("u", "None yet", "x")]
POINTS = [
    ("s", "pain", 1, "battery", 9, 9, "q1"), ("s", "pain", 2, "strap", 8, 8, "q2"),
    ("s", "praise", 1, "screen", 5, 5, "q3"), ("t", "pain", 1, "battery", 2, 2, "q4"),
]
POINT_SCHEMA = (
    "subject string, kind string, rank int, term string, own_df long, diff long, quote string"
)


def test_product_points_use_all_reviews(reviews, data, rows):
    want = plain_points([(s, i, r, t) for i, s, r, _, t in data])
    assert rows(mining.mine_points(mining.most_helpful(reviews)), *COLUMNS) == want


def test_short_words_count(spark):
    df = mining.all_reviews(spark.createDataFrame([(1, "s", 1.0, 1, "bad fan, no fit")], SCHEMA))
    assert sorted(r.term for r in mining.pain_points(df).collect()) == ["bad", "fan", "fit"]
    assert {r.term for r in mining.pain_points(df, k=9, min_length=2).collect()} == {"bad", "fan", "fit", "no"}


def test_copies_recommend_once(spark):
    twice = spark.createDataFrame([(1, "s", 1.0, 1, "broken hinge")] * 2, SCHEMA)
    lists = mining.point_lists(mining.mine_points(mining.all_reviews(twice)))
    assert [p.term for p in lists.first().pain] == ["broken", "hinge"]


BEST_SCHEMA = "subject string, best struct<term:string,own_df:long,quote:string>"
BEST = [("s", ("strap", 8, "q2")), ("t", ("battery", 2, "q4"))]


def test_unlisted_pain_lies_beyond_the_top_three(spark):
    texts = ["aaa bbb ccc ddd"] * 3 + ["aaa bbb ccc"] * 2
    df = mining.all_reviews(spark.createDataFrame([(i, "s", 1.0, 1, t) for i, t in enumerate(texts)], SCHEMA))
    products = spark.createDataFrame([("s", "Watch", "aaa bbb ccc"), ("x", "y", None)], "subject string, title string, features string")
    assert [tuple(r.best) for r in mining.unlisted_pain(df, products).collect()] == [("ddd", 3, texts[0])]


def test_improvement_skips_listed_features(spark):
    lists = mining.point_lists(spark.createDataFrame(POINTS, POINT_SCHEMA))
    products = spark.createDataFrame(PRODUCTS, "subject string, title string, features string")
    best = spark.createDataFrame(BEST, BEST_SCHEMA)
    got = {r.subject: r for r in mining.improvement_candidate(lists, best, products).collect()}
    assert [got[s].improve_term for s in "stu"] == ["strap", "battery", None]
    assert (got["s"].evidence, got["s"].quote, len(got["s"].pain)) == (8, "q2", 2)


def test_strategy_has_context(spark):
    lists = mining.point_lists(spark.createDataFrame(POINTS, POINT_SCHEMA))
    profiles = spark.createDataFrame([("s", "maker", "a", "b", "c")], "subject string, business_type string, core_offerings string, customer_base string, market_presence string")
    known = mining.company_profile(lists, profiles)
    got = mining.strategy_candidates(lists, known, 1).orderBy("subject").collect()
    assert [(r.subject, r["rank"], r.improve_term, r.business_type) for r in got] == [
        ("s", 1, "battery", "maker"), ("t", 1, "battery", None),
    ]
    assert [p.term for p in got[0].strengths] == ["screen"]


def test_bundle_by_position(spark):
    lists = mining.point_lists(spark.createDataFrame(POINTS, POINT_SCHEMA))
    products = spark.createDataFrame(PRODUCTS, "subject string, title string, features string")
    wide = insights.insight_bundle(flows.product_outputs(lists, spark.createDataFrame(BEST, BEST_SCHEMA), products), PRODUCT_TASKS)
    got = {r.subject: tuple(r)[1:] for r in wide.collect()}
    assert got["s"] == ("1. screen (5)", "1. battery (9)\n2. strap (8)", "Improve strap")
    assert got["u"] == (None, None, None)


def test_company_flow(spark):
    cls = "rev"
    html = "".join(f'<div class="{cls}">great motor {i}</div>' for i in range(3))
    pages = spark.createDataFrame(
        [("a.com", 1, 200, html), ("b.com", 1, 200, f'<div class="{cls}">awful</div>')],
        "company string, page_no int, status_code int, html string",
    )
    words = spark.createDataFrame([("great", 1), ("awful", -1)], "word string, weight int")
    profiles = spark.createDataFrame([("a.com", "maker", "motors", "all", "here")], "subject string, business_type string, core_offerings string, customer_base string, market_presence string")
    got = flows.company_insights(pages, words, profiles, css_class=cls, n=3).collect()
    assert len(got) == 1 and got[0].subject == "a.com"
    assert got[0].output_0.splitlines()[0] == "business type: maker"
    assert got[0].output_1 == "1. great (3)\n2. motor (3)" and got[0].output_3 is None


def test_prompts_and_models(spark):
    subjects = spark.createDataFrame(
        [("s", "Watch {reviews}", "Review 1: ok", None)],
        "subject string, title string, reviews string, features string",
    )
    got = {r.task: r for r in insights.prompt_table(subjects, PRODUCT_TASKS).collect()}
    assert [got[t].task_pos for t in PRODUCT_TASKS] == [0, 1, 2]
    assert "Review 1: ok" in got["pain_points"].prompt
    assert "Watch {reviews}" in got["improvement"].prompt
    assert "Features today: Not available" in got["improvement"].prompt
    assert (got["improvement"].model, got["pain_points"].model) == ("gpt-4o", "gpt-4o-mini")


def test_one_failing_prompt_leaves_the_rest(spark):
    def make():
        def answer(prompt, model):
            if prompt == "3":
                raise RuntimeError("no answer")
            if prompt == "5":
                raise KeyError
            return prompt * 2

        return answer

    df = spark.range(8).select("id", F.col("id").cast("string").alias("prompt"))
    got = insights.map_prompts(df, make, model_col=None, concurrency=2).orderBy("id").collect()
    assert [(r.output, r.error) for r in got if r.error] == [(None, "no answer"), (None, "KeyError")]
    assert [r.output for r in got if not r.error] == ["00", "11", "22", "44", "66", "77"]


def test_analysis_of_chosen_titles(spark):
    """A failed task fails its title; the others still run, each stage on the answers before."""

    def make():
        def answer(prompt, model):
            if "Lamp" in prompt or "dim" in prompt:
                raise RuntimeError("refused")
            return f"{model}<{prompt.splitlines()[0][:18]}|{'gpt' in prompt}>"

        return answer

    reviews = spark.createDataFrame(
        [(1, "P1", 5.0, 1, "bright"), (2, "P2", 1.0, 1, "dim"), (3, "P3", 1.0, 1, "big")],
        "id long, parent_asin string, rating double, helpful_vote long, text string",
    )
    meta = spark.createDataFrame(
        [("P1", "Watch", 9, "[]"), ("P2", "Lamp", 9, "[]"), ("P3", "Desk", 9, None)],
        "parent_asin string, title string, rating_number long, features string",
    )
    titles = spark.createDataFrame([("Watch",), ("Lamp",), ("no such",)], "title string")
    got = {r.subject: r for r in analysis.analyze_products(reviews, meta, make, titles).collect()}
    assert set(got) == {"Watch", "Lamp"}
    assert (got["Lamp"].status, got["Lamp"].error, got["Lamp"].output_2) == ("failed", "refused", None)
    assert got["Watch"].status == "completed"
    assert got["Watch"].output_2 == "gpt-4o<Propose the one ch|True>"


def test_one_pass_finds_lists_and_change(spark, reviews):
    """``product_points`` equals the lists and the unlisted pain point, each mined on its own."""
    mined = mining.most_helpful(reviews)
    subjects = sorted({r.subject for r in mined.select("subject").distinct().collect()})
    products = spark.createDataFrame(
        [(s, "t", " ".join(WORDS[i % 5 :: 3]) if i % 4 else None) for i, s in enumerate(subjects)],
        "subject string, title string, features string",
    )
    lists, best = mining.point_lists(mining.mine_points(mined)), mining.unlisted_pain(mined, products)
    want = lists.join(best, "subject", "left")
    got = mining.product_points(mined, products)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert any(r.best for r in got.collect())


def test_terms_rate_and_count_from_one_pass(spark, data):
    """``mine_unrated`` equals rating the reviews by words first and mining them then."""
    placed = spark.createDataFrame([(s, i, t) for i, s, _, _, t in data], "subject string, ord long, text string")
    words = spark.createDataFrame([(w, 1 if i % 2 else -1) for i, w in enumerate(WORDS[:8])], "word string, weight int")
    rated = mining.rate_by_words(placed.withColumn("rating", F.lit(None).cast("double")), words)
    want = mining.mine_points(mining.all_reviews(rated, ord_column="ord"))
    got = mining.mine_unrated(placed, words)
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, want.select(*COLUMNS).collect()))
