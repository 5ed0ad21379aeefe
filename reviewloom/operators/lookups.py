"""Joins that the reference makes by look-up: stopwords, caches, profiles; and metrics of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
#: A dictionary is broadcast up to so many words, some 2 MB; a larger one is joined by shuffle.
MAX_DICTIONARY = 100_000


def without_words(keywords: DataFrame, words: DataFrame, column: str = "keyword") -> DataFrame:
    """Anti join with a one-column dictionary ``word``; its size decides how it is joined."""
    distinct = words.where(F.col("word").isNotNull()).distinct()
    small = distinct.limit(MAX_DICTIONARY + 1).count() <= MAX_DICTIONARY
    return keywords.join(F.broadcast(distinct) if small else distinct, F.col(column) == F.col("word"), "left_anti")


def cache_key(mode: Column, text: Column) -> Column:
    return F.md5(F.concat(mode, F.lit(":"), text))


def with_cache(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (``cache_key`` among their columns) with their cached result, where it hasn't expired; null elsewhere.

    ``cache`` has ``cache_key, result, expires_at``; of several live results the latest counts.
    """
    live = cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(F.max_by("result", "expires_at").alias("cached_result"))
    return requests.join(live, "cache_key", "left")


def distinct_requests(requests: DataFrame, mode: str, text: str) -> DataFrame:
    """``cache_key, n, first_id``: model calls are made once for each, and results joined back by key."""
    return requests.where(F.col(text).isNotNull()).groupBy(cache_key(F.lit(mode), F.col(text)).alias("cache_key")).agg(F.count("*").alias("n"), F.min("request_id").alias("first_id"))


def latency_bucket(seconds: Column) -> Column:
    """The least bound that isn't exceeded, as text; ``+Inf`` beyond all, null for null."""
    test = F.when(seconds.isNull(), F.lit(None).cast("string"))
    for bound in LATENCY_BOUNDS:
        test = test.when(seconds <= bound, str(bound))
    return test.otherwise("+Inf")


def request_metrics(rows: DataFrame, mode: str, seconds: Column) -> DataFrame:
    return rows.groupBy(F.col(mode).alias("mode"), latency_bucket(seconds).alias("bucket")).agg(F.count("*").alias("n"))


def batch_counters(results: DataFrame) -> DataFrame:
    """Completed, failed and the sum of elapsed time."""
    failed = F.col("error").isNotNull()
    return results.agg(F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"), F.round(F.sum("elapsed_ms"), 3).alias("elapsed_ms"))


def status_counters(results: DataFrame, mode: str = "mode", error: str = "error") -> DataFrame:
    """``mode, status, n``: requests by mode, and whether they ended in an error; a missing mode is ``unknown``."""
    status = F.when(F.col(error).isNull(), "success").otherwise("error")
    return results.groupBy(F.coalesce(F.col(mode), F.lit("unknown")).alias("mode"), status.alias("status")).agg(F.count("*").alias("n"))


def tool_counters(calls: DataFrame, tool: str, success: Column) -> DataFrame:
    """``tool, success, n``: tool calls by tool, and whether they gave a result."""
    return calls.groupBy(F.coalesce(F.col(tool), F.lit("unknown")).alias("tool"), success.alias("success")).agg(F.count("*").alias("n"))
