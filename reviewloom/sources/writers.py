"""Sinks: lines of JSON, keyed tables and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keys with null values stay in the lines."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_turns(df: DataFrame, path: str) -> None:
    """Partitioned by session, so that one session's turns are read without the others'."""
    df.write.mode("append").partitionBy("session_id").json(path)


def export(df: DataFrame, path: str, sessions: list[str] | None = None) -> int:
    """Write the sessions' samples, all of them if none are named, and return how many there are."""
    chosen = df.where(F.col("session_id").isin(sessions)) if sessions else df
    write_jsonl(chosen, path)
    return df.sparkSession.read.json(path).count() if not chosen.isEmpty() else 0


def cache_rows(results: DataFrame, key: Column, now: Column, seconds: int = 3600) -> DataFrame:
    """``cache_key, result, expires_at`` of a result table, to append to the cache."""
    return results.select(key.alias("cache_key"), F.to_json(F.struct(*[c for c in results.columns])).alias("result"), (now + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"))


def merge_counts(current: DataFrame, changes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Two tables of sums added by key; the base of the keyed upsert, for batch and stream alike."""
    both = current.select(*keys, *sums).unionByName(changes.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def session_summary(turns: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``session_id, turns, without_answer, started, ended``; with ``results`` (``session_id, index, keywords, sentiment, mode``) also
    ``keyword_count, label, mode`` of each session's last result, null where there is none."""
    counted = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(F.col("response.content").isNull()).alias("without_answer"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    if results is None:
        return counted
    last = results.groupBy("session_id").agg(F.max_by(F.struct(F.size("keywords").alias("keyword_count"), F.col("sentiment.label").alias("label"), "mode"), "index").alias("r"))
    return counted.join(last.select("session_id", "r.*"), "session_id", "left")


#: What a short record keeps of a result.
SUMMARY = ("analysis_complete", "keywords", "sentiment", "elapsed_ms", "mode", "steps", "warnings")


def result_records(results: DataFrame, full: bool = False, index: str = "index", text: str = "original_text", stamp: str = "timestamp") -> DataFrame:
    """``index, text, timestamp`` and ``result``, or ``result_summary`` of the fields in ``SUMMARY`` that there are."""
    kept = [c for c in results.columns if c not in (index, stamp)] if full else [c for c in SUMMARY if c in results.columns]
    return results.select(F.col(index).alias("index"), F.col(text).alias("text"), F.col(stamp).alias("timestamp"), F.struct(*kept).alias("result" if full else "result_summary"))


def append_results(results: DataFrame, path: str, full: bool = False) -> None:
    """Append a session's records; earlier ones are neither read nor written again."""
    result_records(results, full).write.mode("append").option("ignoreNullFields", False).json(path)


def session_meta(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row a session: its own columns, ``total`` and ``history_summary array<struct<index, text_preview, timestamp>>`` with 50 characters of each text.

    ``results`` has ``session_id, index, original_text, timestamp``; a session without results has total 0.
    """
    item = F.struct("index", F.substring("original_text", 1, 50).alias("text_preview"), "timestamp")
    told = results.groupBy("session_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(item)).alias("history_summary"))
    both = sessions.join(told, "session_id", "left")
    none = F.array().cast(told.schema["history_summary"].dataType)
    return both.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("history_summary", F.coalesce("history_summary", none))


def write_session_meta(results: DataFrame, sessions: DataFrame, path: str) -> None:
    """A line of JSON a session, in a folder of its own, as ``saved_sessions`` finds them."""
    session_meta(results, sessions).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("session_id").json(path)


def upsert_counts(spark, path: str, changes: DataFrame, keys: list[str], sums: list[str]) -> None:
    """Add a table of changes to the one at ``path``: read, merged and written to a new version, which counts once it is whole.

    Readers take ``current_counts``; a failed write leaves the old version in place, so nothing is lost or added twice.
    """
    version, old = _version(spark, path), current_counts(spark, path)
    merged = changes.select(*keys, *sums).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]) if old is None else merge_counts(old, changes, keys, sums)
    merged.write.mode("overwrite").parquet(f"{path}/v{version + 1}")


def current_counts(spark, path: str) -> DataFrame | None:
    """The latest whole version of an upserted table; None before the first."""
    version = _version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def _version(spark, path: str) -> int:
    """The latest version whose write has ended, by the marker that Spark leaves last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return max([int(x.getPath().getParent().getName()[1:]) for x in found or []], default=0)
