"""Saved sessions, batch tasks and the shape of results at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("pending", "processing", "completed", "failed")


def saved_sessions(spark: SparkSession, root: str) -> DataFrame:
    """``session_id, created_at, total, path`` of every ``session_meta.json`` below ``root``, the newest first; broken files are left out."""
    schema = "session_id string, created_at string, total bigint"
    meta = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "session_meta.json").json(root)
    return meta.where(F.col("session_id").isNotNull()).withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "/session_meta.json$", "")).orderBy(F.col("created_at").desc(), "session_id")


def resumed(spark: SparkSession, path: str) -> DataFrame:
    """A session's results, numbered anew: ``n, result``; the full result where it was saved, else its summary."""
    rows = spark.read.text(f"{path}/result*.json", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    listed = rows.select("file", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")).alias("items"))
    # One row a file, a session has a few: the numbers before each file come from the files' sizes, not from all results in one task.
    files = listed.select("file", F.size("items").alias("n"))
    before = files.alias("a").join(F.broadcast(files.alias("b")), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    each = listed.join(F.broadcast(before), "file").select("before", F.posexplode("items").alias("pos", "item"))
    result = F.coalesce(F.try_variant_get("item", "$.result", "variant"), F.try_variant_get("item", "$.result_summary", "variant"), F.col("item"))
    return each.where(F.col("item").isNotNull()).select((F.col("before") + F.col("pos") + 1).cast("int").alias("n"), F.to_json(result).alias("result"))


def history(results: DataFrame) -> DataFrame:
    """``index, preview, keywords, label``: 30 characters and the first five keywords of each result."""
    return results.select("index", F.substring("original_text", 1, 30).alias("preview"), F.array_join(F.slice(F.transform("keywords", lambda k: k["keyword"]), 1, 5), ", ").alias("keywords"), F.coalesce("sentiment.label", F.lit("-")).alias("label"))


def batch_table(results: DataFrame) -> DataFrame:
    """A batch's results as they are shown: number, preview, keywords, label, elapsed time in ms or s, state."""
    ms = F.col("elapsed_ms")
    elapsed = F.when(ms < 1000, F.concat(F.round(ms).cast("int").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit("s")))
    return history(results).join(results.select("index", elapsed.alias("elapsed"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("state")), "index")


def response(result: DataFrame) -> DataFrame:
    """Results under the names of the service's answer; missing flags are false and a missing mode is ``unknown``."""
    none = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in result.columns else F.lit(d)
    keep = lambda c, kind="string": F.col(c) if c in result.columns else F.lit(None).cast(kind)
    return result.select(
        none("analysis_complete", False).alias("analysis_complete"), none("original_text", "").alias("original_text"), keep("cleaned_text").alias("cleaned_text"), keep("keywords").alias("keywords"), keep("sentiment").alias("sentiment"), keep("agent_summary").alias("summary"),
        none("elapsed_ms", 0.0).alias("elapsed_ms"), none("mode", "unknown").alias("mode"), keep("steps", "int").alias("steps"), keep("error").alias("error"),
    )


def task_states(log: DataFrame) -> DataFrame:
    """The state of each task from its log (``task_id, seq, state, completed, failed, total``): the last entry and the counters' maxima."""
    return log.groupBy("task_id").agg(F.max_by("state", "seq").alias("state"), *[F.max(c).alias(c) for c in ("completed", "failed", "total")])


def task_entries(results: DataFrame, task: str, total: int, seq: int = 0) -> DataFrame:
    """A log of a batch's task from its results (``error``): created, running, and completed, or failed where every row failed."""
    counted = results.agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    ended = F.when((F.col("completed") == 0) & (F.col("failed") > 0), "failed").otherwise("completed")
    entry = lambda k, state, done, broken: F.struct(F.lit(seq + k).alias("seq"), state.alias("state"), done.cast("bigint").alias("completed"), broken.cast("bigint").alias("failed"))
    none = F.lit(0)
    log = F.array(entry(0, F.lit(STATES[0]), none, none), entry(1, F.lit(STATES[1]), none, none), entry(2, ended, F.col("completed"), F.col("failed")))
    return counted.select(F.explode(log).alias("e")).select(F.lit(task).alias("task_id"), "e.*", F.lit(total).cast("bigint").alias("total"))


def task_of(log: DataFrame, task: str, result_schema: str | None = None) -> DataFrame:
    """One task's state by its id; with a schema the JSON in its ``result`` column is read. The filter reaches the scan."""
    mine = log.where(F.col("task_id") == task)
    state = task_states(mine)
    if "result" not in log.columns:
        return state
    last = mine.groupBy("task_id").agg(F.max_by("result", F.when(F.col("result").isNotNull(), F.col("seq"))).alias("result"))
    both = state.join(last, "task_id")
    return both.withColumn("result", F.from_json("result", result_schema)) if result_schema else both


def task_progress(state: Column, completed: Column, failed: Column, total: Column) -> Column:
    return F.when(state == "completed", 1.0).otherwise(F.round((completed + failed) / F.greatest(total, F.lit(1)), 3))
