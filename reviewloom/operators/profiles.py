"""Profiles of reviewers and products, accumulated from analyses in long form.

Input is one row an analysis (``analysis_id, request_id, reviewer_id, product_id, product_name, seq, label``) and one row a
keyword (``analysis_id, reviewer_id, product_id, seq, keyword, score``). Counting tables have one row a key and keyword, so
no map grows with a key; every aggregation combines before its shuffle, which keeps hot keys harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of sentiment, and keywords that speak for or against by themselves.
LABELS = {"positive": "positive", "negative": "negative", "neutral": "neutral", "正向": "positive", "负向": "negative", "中立": "neutral"}
NEGATIVE = ("差", "不好", "失望", "垃圾", "不满", "难用", "慢", "坏")
POSITIVE = ("好", "不错", "满意", "快", "赞", "喜欢", "推荐", "性价比")
DEFAULT_SCORE, TAGS, TOP, ISSUES = 0.5, 50, 20, 15


def label_of(label: Column) -> Column:
    """An unknown label is neutral, a null one stays null."""
    known = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    return F.when(label.isNotNull(), F.coalesce(F.try_element_at(known, label), F.lit("neutral")))


def review_counts(analyses: DataFrame, key: str) -> DataFrame:
    return analyses.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total_reviews"))


def keyword_frequency(keywords: DataFrame, key: str) -> DataFrame:
    """Every keyword row counts, repeated ones of a review too."""
    return keywords.where(F.col(key).isNotNull() & F.col("keyword").isNotNull()).groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def sentiment_distribution(analyses: DataFrame, key: str) -> DataFrame:
    label = label_of(F.col("label"))
    return analyses.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(label == x).alias(f"{x}_count") for x in ("positive", "negative", "neutral")])


def polarity(keyword: Column, label: Column) -> Column:
    """The review's label decides; else the keyword itself."""
    return F.when((label == "negative") | keyword.isin(*NEGATIVE), "negative").when((label == "positive") | keyword.isin(*POSITIVE), "positive")


def reviewer_tags(keywords: DataFrame, analyses: DataFrame, most: int = TAGS) -> DataFrame:
    """``reviewer_id, polarity, keyword, place``: the last ``most`` distinct tags by first use, oldest first."""
    labelled = keywords.join(analyses.select("analysis_id", label_of(F.col("label")).alias("l")), "analysis_id", "left")
    tagged = labelled.where(F.col("reviewer_id").isNotNull() & F.col("keyword").isNotNull()).withColumn("polarity", polarity(F.col("keyword"), F.col("l"))).where(F.col("polarity").isNotNull())
    first = tagged.groupBy("reviewer_id", "polarity", "keyword").agg(F.min("seq").alias("first_seq"))
    newest = Window.partitionBy("reviewer_id", "polarity").orderBy(F.col("first_seq").desc(), F.col("keyword").desc())
    kept = first.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most)
    oldest = Window.partitionBy("reviewer_id", "polarity").orderBy(F.col("age").desc())
    return kept.select("reviewer_id", "polarity", "keyword", F.row_number().over(oldest).alias("place"))


def replayed_tags(events: DataFrame, most: int = TAGS) -> DataFrame:
    """``reviewer_id, polarity, tags``: the exact fold, in which a tag that was pushed out may enter again.

    ``events`` has ``reviewer_id, polarity, seq, keyword``. Rows of one reviewer are folded in order; use it where a
    reviewer's history is bounded, else ``reviewer_tags``.
    """
    ordered = events.groupBy("reviewer_id", "polarity").agg(F.array_sort(F.collect_list(F.struct("seq", "keyword"))).alias("e"))
    add = lambda tags, e: F.when(F.array_contains(tags, e["keyword"]), tags).otherwise(F.slice(F.concat(tags, F.array(e["keyword"])), F.greatest(F.lit(1), F.size(tags) + 2 - most), F.lit(most)))
    return ordered.select("reviewer_id", "polarity", F.aggregate("e", F.array().cast("array<string>"), add).alias("tags"))


def product_keywords(keywords: DataFrame) -> DataFrame:
    """``product_id, keyword, n, score_sum, first_seq``; a missing score counts as 0.5. Sums are decimal, so order can't matter."""
    score = F.coalesce(F.nanvl(F.col("score"), F.lit(None).cast("double")), F.lit(DEFAULT_SCORE)).cast("decimal(18,6)")
    rows = keywords.where(F.col("product_id").isNotNull() & F.col("keyword").isNotNull())
    return rows.groupBy("product_id", "keyword").agg(F.count("*").alias("n"), F.sum(score).alias("score_sum"), F.min("seq").alias("first_seq"))


def top_keywords(counts: DataFrame, most: int = TOP) -> DataFrame:
    """``product_id, rank, keyword, n, avg_score``: by count, then by first use, then by keyword."""
    order = Window.partitionBy("product_id").orderBy(F.col("n").desc(), "first_seq", "keyword")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    # Half up, in whole millionths, so that no binary fraction decides a tie.
    rounded = F.expr("(2 * cast(score_sum * 1000000 AS bigint) + n * 10000) div (2 * n * 10000)") / 100
    return ranked.select("product_id", "rank", "keyword", "n", rounded.alias("avg_score"))


def issues_and_strengths(counts: DataFrame, pool: int = 30, least: int = 2, most: int = ISSUES, negative: tuple[str, ...] = NEGATIVE, positive: tuple[str, ...] = POSITIVE) -> DataFrame:
    """``product_id, polarity, place, keyword``: of the ``pool`` most frequent keywords, those that speak for or against."""
    order = Window.partitionBy("product_id").orderBy(F.col("n").desc(), "first_seq", "keyword")
    pooled = counts.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= pool) & (F.col("n") >= least))
    sided = pooled.withColumn("polarity", F.when(F.col("keyword").isin(*negative), "issue").when(F.col("keyword").isin(*positive), "strength")).where(F.col("polarity").isNotNull())
    placed = sided.withColumn("place", F.row_number().over(Window.partitionBy("product_id", "polarity").orderBy("rank")))
    return placed.where(F.col("place") <= most).select("product_id", "polarity", "place", "keyword")


def sentiment_rates(analyses: DataFrame) -> DataFrame:
    """Shares of all reviews of a product, those without sentiment included; 3 places, half up."""
    counts = sentiment_distribution(analyses, "product_id").join(review_counts(analyses, "product_id"), "product_id")
    return counts.select("product_id", "total_reviews", *[F.round(F.col(f"{x}_count") / F.greatest("total_reviews", F.lit(1)), 3).alias(f"{x}_rate") for x in ("positive", "negative", "neutral")])


def detail_level(total: Column) -> Column:
    return F.when(total.isNull() | (total < 5), "full").when(total <= 20, "standard").otherwise("delta")


def delta_keywords(keywords: DataFrame, reference: bool = False) -> DataFrame:
    """``analysis_id, keyword``: keywords that the reviewer hasn't used in an earlier review.

    The reference compares with a profile that already holds the review, so there it is always empty: ``reference=True``.
    """
    known = keywords.where(F.col("reviewer_id").isNotNull() & F.col("keyword").isNotNull())
    first = known.groupBy("reviewer_id", "keyword").agg(F.min("seq").alias("first_seq"))
    found = known.join(first, ["reviewer_id", "keyword"]).where((F.col("seq") == F.col("first_seq")) & ~F.lit(reference))
    return found.select("analysis_id", "keyword").distinct()


def global_summary(analyses: DataFrame) -> DataFrame:
    """Reviewers, products, and reviews that have a reviewer."""
    return analyses.agg(F.count_distinct("reviewer_id").alias("reviewers"), F.count_distinct("product_id").alias("products"), F.count("reviewer_id").alias("reviews"))


def reviewer_report(analyses: DataFrame, keywords: DataFrame, reviewer: str, most: int = TOP) -> DataFrame:
    """``section, place, name, value`` of one reviewer: distribution in per cent, top keywords, tags. The key is pushed to the scan."""
    mine, words = analyses.where(F.col("reviewer_id") == reviewer), keywords.where(F.col("reviewer_id") == reviewer)
    spread = sentiment_distribution(mine, "reviewer_id")
    total = F.greatest(sum(F.col(f"{x}_count") for x in ("positive", "negative", "neutral")), F.lit(1))
    shares = spread.select(F.explode(F.array(*[F.struct(F.lit("sentiment").alias("section"), F.lit(k).alias("place"), F.lit(x).alias("name"), F.round(F.col(f"{x}_count") * 100 / total, 1).alias("value")) for k, x in enumerate(("positive", "negative", "neutral"), 1)])).alias("r")).select("r.*")
    order = Window.partitionBy("reviewer_id").orderBy(F.col("n").desc(), "first_seq", "keyword")
    top = keyword_frequency(words, "reviewer_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    tags = reviewer_tags(words, mine).where(F.col("place") <= 15)
    return shares.unionByName(top.select(F.lit("keyword").alias("section"), "place", F.col("keyword").alias("name"), F.col("n").cast("double").alias("value"))).unionByName(
        tags.select(F.concat(F.col("polarity"), F.lit("_tag")).alias("section"), "place", F.col("keyword").alias("name"), F.lit(None).cast("double").alias("value"))
    )


def product_report(analyses: DataFrame, keywords: DataFrame, product: str, most: int = TOP) -> DataFrame:
    """``section, place, name, count, value`` of one product: labels with their per cent of all reviews, top keywords with their average
    score, strengths and issues. The key is pushed to the scan."""
    mine, words = analyses.where(F.col("product_id") == product), keywords.where(F.col("product_id") == product)
    both = sentiment_distribution(mine, "product_id").join(sentiment_rates(mine), "product_id")
    labels = F.array(*[F.struct(F.lit("sentiment").alias("section"), F.lit(k).alias("place"), F.lit(x).alias("name"), F.col(f"{x}_count").alias("count"), F.round(F.col(f"{x}_rate") * 100, 1).alias("value")) for k, x in enumerate(("positive", "negative", "neutral"), 1)])
    counts = product_keywords(words)
    top = top_keywords(counts, most).select(F.lit("keyword").alias("section"), F.col("rank").alias("place"), F.col("keyword").alias("name"), F.col("n").alias("count"), F.col("avg_score").alias("value"))
    sides = issues_and_strengths(counts).select(F.col("polarity").alias("section"), "place", F.col("keyword").alias("name"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("value"))
    return both.select(F.explode(labels).alias("r")).select("r.*").unionByName(top).unionByName(sides)


def profile_keys(profiles: DataFrame, key: str) -> DataFrame:
    """The keys of a profile table, each once, in order."""
    return profiles.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key)


def with_detail(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Results (``reviewer_id`` among their columns) with their reviewer's number of reviews and detail level; an unknown reviewer has ``full``.

    A left look-up: a profile table has one row a reviewer, so no row is lost or doubled. Rows without a reviewer have no level.
    """
    known = profiles.groupBy("reviewer_id").agg(F.max("total_reviews").alias("total_reviews"))
    level = F.when(F.col("reviewer_id").isNotNull(), detail_level(F.col("total_reviews")))
    return results.join(known, "reviewer_id", "left").withColumn("detail_level", level)
