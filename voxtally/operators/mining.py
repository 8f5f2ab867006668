"""Most praised features and main pain points, for every subject in one job.

The method is a count of words, a defined statistic; it makes no claim to judge
text as a language model does. Input columns: ``subject, rating, text`` and
``ord``, a whole number unique within the subject that says which review is
quoted first (the position from the review cap, or the id where there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.functions.text import MIN_LETTERS, terms
from voxtally.operators.reviews import number_reviews
from voxtally.operators.skew import salted_join
from voxtally.session import materialize

PRAISE, PAIN, CHANGE = "praise", "pain", "change"
PRAISED_K, PAIN_K, STRATEGY_K = 4, 3, 2
#: One in so many reviews tells which words are common.
SAMPLED = 16


def most_helpful(reviews: DataFrame, k: int | None = None, subject: str = "subject") -> DataFrame:
    """Mining input for products: every review, or only the ``k`` most helpful of each.

    Without ``k`` the review with the smallest id is quoted first, with it the most helpful.
    """
    if k is None:
        return all_reviews(reviews, subject)
    return _shape(number_reviews(reviews, subject, k, "ord"), subject, F.col("ord"))


def all_reviews(
    reviews: DataFrame, subject: str = "subject", ord_column: str = "id"
) -> DataFrame:
    """Mining input for companies: every review."""
    return _shape(reviews, subject, F.col(ord_column))


def _shape(df: DataFrame, subject: str, order: Column) -> DataFrame:
    # Named here, so that both readers of this table share one shuffle.
    return df.where(F.col(subject).isNotNull()).select(
        F.col(subject).alias("subject"), order.cast("bigint").alias("ord"), "rating", "text"
    )


def page_position(page_no: Column, pos: Column) -> Column:
    """One number for (page, position on the page), in reading order."""
    return F.shiftleft(page_no.cast("bigint"), 32) + pos


def rate_by_words(
    reviews: DataFrame, words: DataFrame, subject: str = "subject", min_length: int = MIN_LETTERS
) -> DataFrame:
    """Ratings for reviews that carry none, from a table ``(word, weight)`` of +1 and -1.

    The sign of the summed weights gives 5, 1 or 3. Term rows carry no text; the
    sums go back to the reviews by key. Common words are found in a part of the reviews
    that their hash picks, and cut.
    """
    key = [F.col(subject), F.col("ord")]

    def words_of(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.explode(terms(F.col("text"), min_length)).alias("word"))

    some = words_of(reviews.where(F.pmod(F.xxhash64(*key), F.lit(SAMPLED)) == 0))
    hits = (
        salted_join(words_of(reviews), words, ["word"], "inner", F.struct(*key), sample=some)
        .groupBy(subject, "ord")
        .agg(F.sum("weight").alias("weight"))
    )
    sign = F.signum(F.coalesce(F.col("weight"), F.lit(0)))
    return (
        reviews.drop("rating")
        .join(hits, [subject, "ord"], "left")
        .withColumn("rating", F.lit(3.0) + 2 * sign)
        .drop("weight")
    )


def review_terms(reviews: DataFrame, min_length: int = MIN_LETTERS) -> DataFrame:
    """Each term of each review once: ``subject, ord, term``. No text comes along."""
    return reviews.select("subject", "ord", F.explode(terms(F.col("text"), min_length)).alias("term"))


def word_ratings(found: DataFrame, words: DataFrame) -> DataFrame:
    """``subject, ord, good`` for the reviews whose words (word, weight) do not balance.

    ``found`` comes from ``review_terms``.
    """
    key = F.struct("subject", "ord")
    some = found.where(F.pmod(F.xxhash64(key), F.lit(SAMPLED)) == 0)
    weights = words.withColumnRenamed("word", "term")
    hits = salted_join(found, weights, ["term"], "inner", key, sample=some)
    sums = hits.groupBy("subject", "ord").agg(F.sum("weight").alias("weight"))
    return sums.where(F.col("weight") != 0).select("subject", "ord", (F.col("weight") > 0).alias("good"))


def mine_unrated(
    reviews: DataFrame, words: DataFrame, praised_k: int = PRAISED_K, pain_k: int = PAIN_K, min_length: int = MIN_LETTERS
) -> DataFrame:
    """``mine_points`` for reviews that carry no rating, which a word table gives them.

    The texts are cut into terms once: the terms, written to the shared folder, rate the
    reviews and are then counted by those ratings.
    """
    found = materialize(review_terms(reviews, min_length), "terms")
    stats = _counted(found.join(word_ratings(found, words), ["subject", "ord"]))
    return with_quotes(rank_points(stats, praised_k, pain_k), reviews.select("subject", "ord", "text"))


def _polar(reviews: DataFrame) -> DataFrame:
    rating = F.col("rating")
    return reviews.where((rating >= 4) | (rating <= 2))


def term_stats(reviews: DataFrame, min_length: int = MIN_LETTERS) -> DataFrame:
    """Reviews for and against, per subject and term, with the first of each to quote.

    Buffers are whole numbers only, so this is a hash aggregate with map-side
    combine; the text itself is not shuffled.
    """
    return _counted(
        _polar(reviews).select(
            "subject", "ord", (F.col("rating") >= 4).alias("good"),
            F.explode(terms(F.col("text"), min_length)).alias("term"),
        )
    )


def _counted(rows: DataFrame) -> DataFrame:
    good, order = F.col("good"), F.col("ord")
    return rows.groupBy("subject", "term").agg(
        F.count_if(good).alias("pos_df"),
        F.count_if(~good).alias("neg_df"),
        F.min(F.when(good, order)).alias("pos_ord"),
        F.min(F.when(~good, order)).alias("neg_ord"),
    )


def common_terms(reviews: DataFrame, max_share: float, min_length: int = MIN_LETTERS) -> DataFrame:
    """Terms in more than ``max_share`` of all reviews, and in how many (``df``)."""
    total = reviews.agg(F.count("*")).scalar()
    counts = (
        reviews.select(F.explode(terms(F.col("text"), min_length)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return counts.where(F.col("df") > F.lit(max_share) * total)


def rank_points(
    stats: DataFrame, praised_k: int = PRAISED_K, pain_k: int = PAIN_K
) -> DataFrame:
    """Top terms per subject and kind. A term is praise or pain, never both.

    Rank by difference, then own count, then term. The rank bound lets every task
    drop all but a few rows of a subject before the shuffle. Where ``stats`` has a column
    ``listed``, the top pain point that is not listed comes too, as the one ``change``.
    """
    pos, neg = F.col("pos_df"), F.col("neg_df")
    praise = pos > neg
    kinds = F.array(F.when(praise, PRAISE).otherwise(PAIN))
    if "listed" in stats.columns:
        proposed = ~praise & ~F.coalesce("listed", F.lit(False))
        kinds = F.when(proposed, F.array(F.lit(PAIN), F.lit(CHANGE))).otherwise(kinds)
    points = stats.where(pos != neg).select(
        "subject",
        F.explode(kinds).alias("kind"),
        "term",
        F.when(praise, pos).otherwise(neg).alias("own_df"),
        F.abs(pos - neg).alias("diff"),
        F.when(praise, F.col("pos_ord")).otherwise(F.col("neg_ord")).alias("ord"),
    )
    w = Window.partitionBy("subject", "kind").orderBy(
        F.desc("diff"), F.desc("own_df"), F.asc("term")
    )
    limit = F.when(F.col("kind") == PRAISE, praised_k).when(F.col("kind") == PAIN, pain_k).otherwise(1)
    return (
        points.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(praised_k, pain_k))
        .where(F.col("rank") <= limit)
    )


def with_quotes(points: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds the quoted review's text to the few chosen points.

    An inner join, which lets Catalyst send the points to the texts when they are
    few: every point has its review. Exact copies of a review share an id; their
    equal quotes are folded to one.
    """
    rated = _polar(reviews) if "rating" in reviews.columns else reviews
    texts = rated.select("subject", "ord", F.col("text").alias("quote"))
    quoted = points.join(texts, ["subject", "ord"]).drop("ord")
    return quoted.dropDuplicates(["subject", "kind", "rank"])


def mine_points(
    reviews: DataFrame,
    praised_k: int = PRAISED_K,
    pain_k: int = PAIN_K,
    max_share: float | None = None,
    min_length: int = MIN_LETTERS,
) -> DataFrame:
    """``subject, kind, rank, term, own_df, diff, quote`` for both kinds in one pass."""
    stats = term_stats(reviews, min_length)
    if max_share is not None:
        common = common_terms(reviews, max_share, min_length)
        stats = salted_join(stats, common, ["term"], "left_anti", F.col("subject"), "df")
    return with_quotes(rank_points(stats, praised_k, pain_k), reviews)


def praised_features(reviews: DataFrame, k: int = PRAISED_K, **kw) -> DataFrame:
    """The ``k`` most praised terms per subject, good findings only."""
    return mine_points(reviews, praised_k=k, **kw).where(F.col("kind") == PRAISE).drop("kind")


def pain_points(reviews: DataFrame, k: int = PAIN_K, **kw) -> DataFrame:
    """The top ``k`` pain points per subject."""
    return mine_points(reviews, pain_k=k, **kw).where(F.col("kind") == PAIN).drop("kind")


def point_lists(points: DataFrame) -> DataFrame:
    """``subject, praise, pain``: each subject's points as two arrays in rank order.

    At most a handful of points per subject, so one small aggregate serves every
    later step and the mining runs once.
    """
    return points.groupBy("subject").agg(_of_kind(PRAISE).alias("praise"), _of_kind(PAIN).alias("pain"))


def _of_kind(kind: str) -> Column:
    point = F.struct("rank", "term", "own_df", "quote")
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, point)))


def product_points(
    reviews: DataFrame, products: DataFrame, praised_k: int = PRAISED_K, pain_k: int = PAIN_K, min_length: int = MIN_LETTERS
) -> DataFrame:
    """``subject, praise, pain, best``: the lists of ``point_lists`` and the change to propose.

    ``best`` is that of ``unlisted_pain``. One pass over the texts finds all three: a point
    that the product's ``features`` do not name is ranked twice, among all and among those.
    """
    named = terms(F.col("features"), min_length)
    listed = products.select("subject", F.explode(named).alias("term")).distinct().withColumn("listed", F.lit(True))
    stats = term_stats(reviews, min_length).join(listed, ["subject", "term"], "left")
    points = with_quotes(rank_points(stats, praised_k, pain_k), reviews)
    best = F.max(F.when(F.col("kind") == CHANGE, F.struct("term", "own_df", "quote")))
    return points.groupBy("subject").agg(_of_kind(PRAISE).alias("praise"), _of_kind(PAIN).alias("pain"), best.alias("best"))


def with_context(task: DataFrame, *contexts: DataFrame, key: str = "subject") -> DataFrame:
    """Adds outputs of earlier tasks; a subject without a finding keeps its row."""
    for context in contexts:
        task = task.join(context, key, "left")
    return task


def unlisted_pain(
    reviews: DataFrame, products: DataFrame, min_length: int = MIN_LETTERS
) -> DataFrame:
    """The top pain point of each subject among the terms its listed features do not name.

    Listed terms are taken out before ranking, so it may lie beyond the top pain points.
    """
    named = terms(F.col("features"), min_length)
    listed = products.select("subject", F.explode(named).alias("term")).distinct()
    stats = term_stats(reviews, min_length).join(listed, ["subject", "term"], "left_anti")
    best = with_quotes(rank_points(stats, 0, 1), reviews)
    return best.select("subject", F.struct("term", "own_df", "quote").alias("best"))


def improvement_candidate(lists: DataFrame, best: DataFrame | None, products: DataFrame) -> DataFrame:
    """The first pain point per product that its listed features do not name already.

    ``lists`` comes from ``point_lists`` and ``best`` from ``unlisted_pain``, or both from
    ``product_points`` as ``lists``; ``products`` holds ``subject, title, features`` (text).
    Every product gets a row, with nulls when nothing is left to propose; praised features
    and pain points come along as context.
    """
    contexts = (lists,) if best is None else (lists, best)
    named = with_context(products.select("subject", "title", "features"), *contexts)
    return named.select(
        "subject", "title", "features",
        F.col("best.term").alias("improve_term"),
        F.col("best.own_df").alias("evidence"),
        F.col("best.quote").alias("quote"),
        "pain", "praise",
    )


def strategy_candidates(
    lists: DataFrame, profiles: DataFrame, max_items: int = STRATEGY_K
) -> DataFrame:
    """Up to two recommendations per company: its top pain points, with context.

    ``lists`` comes from ``point_lists``, ``profiles`` from ``company_profile``;
    companies without a pain point have no recommendation.
    """
    top = F.inline(F.slice("pain", 1, max_items)).alias("rank", "improve_term", "evidence", "quote")
    found = lists.select(
        "subject", top, F.col("praise").alias("strengths"), F.col("pain").alias("challenges")
    )
    return with_context(found, profiles)


PROFILE_FIELDS = ("business_type", "core_offerings", "customer_base", "market_presence")


def company_profile(subjects: DataFrame, profiles: DataFrame, key: str = "subject") -> DataFrame:
    """Four profile fields per company from a user's table; null where unknown."""
    return subjects.select(key).distinct().join(profiles.select(key, *PROFILE_FIELDS), key, "left")
