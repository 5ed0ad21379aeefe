"""Structured Streaming: profiles kept up to date, event windows, and analysis events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def product_counts(stream: DataFrame) -> DataFrame:
    """Running ``product_id, keyword, n, score_sum``; state has one row a product and keyword, never a growing map."""
    score = F.coalesce(F.nanvl(F.col("score"), F.lit(None).cast("double")), F.lit(0.5)).cast("decimal(18,6)")
    rows = stream.where(F.col("product_id").isNotNull() & F.col("keyword").isNotNull())
    return rows.groupBy("product_id", "keyword").agg(F.count("*").alias("n"), F.sum(score).alias("score_sum"))


def unique_items(stream: DataFrame, item: str = "item_id", event_time: str = "created_at", late: str = "14 days") -> DataFrame:
    """Repeated deliveries of an item count once; state of an item is dropped ``late`` after its time."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([item])


def event_windows(events: DataFrame, event_time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events, and the sum of their values, by type and window. An extension: the reference has no event time."""
    stamped = events.withColumn("at", F.col(event_time).cast("timestamp")).withWatermark("at", late)
    grouped = stamped.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


STATE, OUT = "tags array<string>, total bigint", "reviewer_id string, total bigint, tags array<string>"


def reviewer_state(stream: DataFrame, most: int = 50) -> DataFrame:
    """Per reviewer: the number of keywords so far and the last ``most`` distinct ones, in order; one row an update."""

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tags, total = state.get if state.exists else ([], 0)
        tags = list(tags)
        # Words come in order over all of a batch's frames; only the distinct ones in a row's worth of new words are looked at.
        words = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")["keyword"]
        total += len(words)
        known = dict.fromkeys(tags)
        for word in words[words.ne(words.shift())]:
            if word not in known:
                known[word] = None
                if len(known) > most:
                    del known[next(iter(known))]
        tags = list(known)
        state.update((tags, total))
        yield pd.DataFrame({"reviewer_id": [key[0]], "total": [total], "tags": [tags]})

    rows = stream.where(F.col("reviewer_id").isNotNull() & F.col("keyword").isNotNull()).select("reviewer_id", "seq", "keyword")
    return rows.groupBy("reviewer_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


STEPS = {"offline": ("preprocess", "fallback_extract", "validate"), "fast": ("preprocess", "keyword_extract", "validate", "sentiment_analyze")}


def analysis_events(results: DataFrame, key: str) -> DataFrame:
    """``key, seq, type, step, payload``: start, the mode's steps each begun and done, result and done of every analysis, in order.

    A result with an error has one ``error`` event between start and done; a missing column gives no payload. It works on streams as on tables.
    """
    event = lambda kind, step=None, payload=None: F.struct(F.lit(kind).alias("type"), F.lit(step).cast("string").alias("step"), (F.lit(None).cast("string") if payload is None else payload).alias("payload"))
    output = {step: F.to_json(F.struct(c)) for step, c in (("preprocess", "cleaned_text"), ("sentiment_analyze", "sentiment"), ("validate", "keywords")) if c in results.columns}
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    steps = {m: F.array(*[e for n in names for e in (event("step_start", n), event("step_done", n, output.get(n)))]) for m, names in STEPS.items()}
    told = F.concat(F.when(F.col("mode") == "fast", steps["fast"]).otherwise(steps["offline"]), F.array(event("result", None, F.to_json(F.struct("analysis_complete", "mode")))))
    failed = F.array(event("error", None, F.to_json(F.struct(error.alias("error")))))
    events = F.concat(F.array(event("start")), F.when(error.isNull(), told).otherwise(failed), F.array(event("done")))
    return results.select(key, F.posexplode(events).alias("p", "e")).select(key, (F.col("p") + 1).alias("seq"), "e.*")


def agent_events(rows: DataFrame, key: str) -> DataFrame:
    """``key, seq, type, content`` of agent rows: start, the steps of the dialogue, reflection rounds, result and done, in order."""
    event = lambda kind, content=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if content is None else content).alias("content"))
    rounds = F.transform(F.sequence(F.lit(1), F.col("rounds")), lambda k: F.struct(F.lit("reflection_supplement").alias("type"), k.cast("string").alias("content"))) if "rounds" in rows.columns else None
    reflected = [F.when(F.col("rounds") > 0, rounds).otherwise(F.array().cast("array<struct<type:string,content:string>>"))] if rounds is not None else []
    events = F.concat(F.array(event("start")), F.col("trace"), *reflected, F.array(event("result", F.to_json(F.struct("keywords", "sentiment"))), event("done")))
    return rows.select(key, F.posexplode(events).alias("p", "e")).select(key, (F.col("p") + 1).alias("seq"), "e.*")


def merged_deltas(deltas: DataFrame) -> DataFrame:
    """Tool calls of a token stream, whose parts come one after the other: ``message_id, index, id, name, arguments``.

    ``deltas`` has ``message_id, seq, index, id, name, arguments``; the first id and name of an index hold, its arguments are
    joined in order of ``seq``.
    """
    grouped = deltas.groupBy("message_id", "index").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("id", "name")], F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))).alias("parts"))
    return grouped.select("message_id", "index", "id", "name", F.array_join(F.transform("parts", lambda p: p["a"]), "").alias("arguments"))


def sse_lines(events: DataFrame, key: str) -> DataFrame:
    """``key, seq, value``: each event as the text of a server-sent event, its type as the name and its other fields as JSON."""
    others = [c for c in events.columns if c not in (key, "seq", "type")]
    return events.select(key, "seq", F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.to_json(F.struct(*others)), F.lit("\n\n")).alias("value"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there and stop: a stream's result as an in-memory table, for tests and back-fills."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A file sink with its checkpoint in the shared folder; exactly once."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
