"""Whole pipelines: one plan from text to validated keywords, sentiment, reflection and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import preprocess_result, preprocess_tool, squeeze_space
from ..functions.jsonx import SENTIMENT, keyword_list
from ..functions.keywords import KEYWORDS, STOPWORDS, normalize_keywords, post_process, route, strip, validate
from ..operators.agent import agent_rows, keyword_rows, reflect_rows
from ..operators.extract import document_frequencies, extract, placed_by
from ..operators.models import RuleBackend, sentiment
from ..operators.profiles import with_detail
from ..operators.tools import Registry, Tool
from ..session import cut_lineage
from ..sources.readers import Settings

FAILED_SENTIMENT = ("unknown", 0.0, "分析失败")



def _cleaned(df: DataFrame, key: str, text: str, strict: bool) -> DataFrame:
    """``key, original_text, cleaned_text, error``, cleaned once, written once and placed by key.

    A blank text can't be cleaned; its cleaned text is empty and its error says so.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("original_text"))
    blank = F.col("original_text").isNull() | (squeeze_space(F.col("original_text")) == "")
    told = rows.withColumn("error", F.when(blank, "empty text"))
    cleaned = F.when(F.col("error").isNull(), preprocess_tool(F.col("original_text"), strict=strict)).otherwise(F.when(F.col("original_text").isNotNull(), ""))
    return placed_by(told.select("key", "original_text", cleaned.alias("cleaned_text"), "error"), "key")


def _validated(rows: DataFrame, strict: bool) -> DataFrame:
    """``keywords`` that stand in the cleaned text, and ``removed`` with the reasons."""
    judged = rows.withColumn("v", validate(F.coalesce("keywords", F.array().cast(KEYWORDS)), F.coalesce("cleaned_text", F.lit("")), stopwords=STOPWORDS if strict else []))
    return judged.withColumn("keywords", F.col("v.valid_keywords")).withColumn("removed", F.col("v.removed_keywords")).drop("v")


def _result(rows: DataFrame, key: str, felt: Column, mode: Column) -> DataFrame:
    return rows.select(F.col("key").alias(key), "original_text", "cleaned_text", "keywords", "removed", F.lit(True).alias("analysis_complete"), felt.alias("sentiment"), mode.alias("mode"), "error")


def run_offline(df: DataFrame, key: str, text: str, method: str = "tfidf", top_k: int = 8, strict: bool = False, **options) -> DataFrame:
    """Clean, extract, validate; sentiment stays null. One row a text, keys single; a blank text has no keywords and an error.

    ``key, original_text, cleaned_text, keywords, removed, analysis_complete, sentiment, mode, error``. The analysis counts
    as complete whatever it found, as in the reference. Without ``strict`` stopwords aren't applied, as there.

    Texts are cleaned once and placed by key; counting, ranking and the meeting of texts and keywords stay where they are.
    """
    base = _cleaned(df, key, text, strict)
    found = extract(_keep_place(base, base.where(F.col("error").isNull())), "key", "cleaned_text", method, top_k, **options).withColumnRenamed("doc", "key")
    # Both sides are as long as the input and lie by key already, so they are merged, never broadcast.
    both = base.join(found.hint("merge"), "key", "left")
    return _result(_validated(both, strict), key, F.lit(None).cast(SENTIMENT), F.lit("offline"))


def _keep_place(base: DataFrame, rows: DataFrame) -> DataFrame:
    rows._placed_by = base._placed_by
    return rows


def model_keywords(texts: DataFrame, key: str, text: str, make=RuleBackend, settings: Settings = Settings(), **options) -> DataFrame:
    """``key, keywords, thinking`` of the texts whose model gave any keyword: parsed, made uniform and post-processed."""
    asked = keyword_rows(texts, key, text, make, **options)
    parsed = asked.where(F.col("found").isNotNull()).select(key, "thinking", normalize_keywords(keyword_list(F.col("found"))).alias("k")).join(texts.select(key, text), key)
    done = parsed.select(key, "thinking", post_process_by(settings, F.col("k"), F.col(text)).alias("keywords"))
    return done.where(F.size("keywords") > 0)


def post_process_by(settings: Settings, ks: Column, text: Column) -> Column:
    """The keyword pipeline with a configuration's limits and switches."""
    return post_process(ks, text, top_n=settings.top_n, max_length=settings.keyword_length, min_score=settings.min_score, latin=settings.latin, stopwords=STOPWORDS if settings.stopwords else [], contained=settings.contained, times=settings.times, dates=settings.dates, aligned=settings.aligned)


def run_fast(df: DataFrame, key: str, text: str, make=RuleBackend, method: str = "tfidf", top_k: int = 8, strict: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Clean, ask the model for keywords, fall back to extraction where that fails, validate, ask for the sentiment.

    The columns are those of ``run_offline`` and ``source``: ``model``, ``fallback`` or null for texts without keywords. Equal
    cleaned texts are asked once. A text whose sentiment can't be told has the label ``unknown``. Extraction sees only the
    texts that need it; its frequencies are those of all texts.
    """
    base = _cleaned(df, key, text, strict).withColumn("h", F.md5("cleaned_text"))
    asked = base.where(F.col("error").isNull()).groupBy("h").agg(F.min("cleaned_text").alias("t"))
    answered = cut_lineage(model_keywords(asked, "h", "t", make, settings))
    rest = cut_lineage(asked.join(answered.select("h"), "h", "left_anti"))
    sources = answered.select("h", "keywords", F.lit("model").alias("source"))
    if not rest.isEmpty():
        options = {"idf": document_frequencies(base.where(F.col("error").isNull()), "key", "cleaned_text").select("token", "idf")} if method not in ("textrank", "pos") else {}
        fallen = extract(rest, "h", "t", method, top_k, **options).select(F.col("doc").alias("h"), "keywords", F.lit("fallback").alias("source"))
        sources = sources.unionByName(fallen)
    felt = sentiment(asked, "h", "t", make)
    both = base.join(sources, "h", "left").join(felt, "h", "left").drop("h")
    unknown = F.struct(*[F.lit(x).alias(n) for n, x in zip(("label", "confidence", "reasoning"), FAILED_SENTIMENT, strict=True)])
    done = _validated(both, strict)
    return _result(done, key, F.coalesce("sentiment", unknown), F.lit("fast")).join(done.select(F.col("key").alias(key), "source"), key)


def run(df: DataFrame, key: str, text: str, make=RuleBackend, backend: str = "cloud_api", fast: bool = False, profiles: DataFrame | None = None, reviewer: str | None = None, rounds: int = 5, threshold: float = 0.7, **options) -> DataFrame:
    """The router: an offline backend gives the offline pipeline, ``fast`` the fast one, else short texts go the fast way and the others to the agent.

    Extraction, where the fast way falls back to it, counts frequencies over the texts that go the fast way.

    The agent's result is assembled from its tools and reflected on; where its context overflows, the text falls back to the
    fast pipeline with the mode ``agent-native-fallback-fast`` and a warning. Every row has a ``trace_id``, its key and text
    digested. With ``profiles`` (``reviewer_id, total_reviews``) and a ``reviewer`` column rows get their detail level.
    """
    trace = df.select(F.col(key).alias("k"), F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256).substr(1, 32).alias("trace_id"))
    none = [F.lit(None).cast("string").alias("warnings"), F.lit(None).cast("int").alias("steps"), F.lit(None).cast("int").alias("rounds")]
    if backend == "offline":
        done = run_offline(df, key, text, **options).select("*", *none)
    elif fast:
        done = run_fast(df, key, text, make, **options).drop("source").select("*", *none)
    else:
        done = _routed(df, key, text, make, rounds, threshold, none, options)
    traced = done.join(trace.withColumnRenamed("k", key), key, "left")
    if profiles is None or reviewer is None:
        return traced
    return with_detail(traced.join(df.select(F.col(key), F.col(reviewer).alias("reviewer_id")), key, "left"), profiles)


def _routed(df: DataFrame, key: str, text: str, make, rounds: int, threshold: float, none: list[Column], options: dict) -> DataFrame:
    way = df.withColumn("way", F.when(strip(F.coalesce(F.col(text), F.lit(""))) == "", "fast").otherwise(route(F.col(text))))
    told = cut_lineage(agent_rows(way.where("way = 'agent'").select(key, text), key, text, make))
    short = way.where("way = 'fast'").select(key, text)
    overflown = told.where("ended = 'overflow'").select(key, F.col("original_text").alias(text))
    quick = run_fast(short.withColumn("over", F.lit(False)).unionByName(overflown.withColumn("over", F.lit(True))), key, text, make, **options).drop("source")
    over = quick.join(overflown.select(key, F.lit(True).alias("over")), key, "left")
    warned = over.withColumn("mode", F.when(F.col("over"), "agent-native-fallback-fast").otherwise(F.col("mode"))).withColumn("warnings", F.when(F.col("over"), "context full: fast pipeline")).drop("over").select("*", *none[1:])
    reflected = reflect_rows(told.where("ended <> 'overflow'"), key, "original_text", "keywords", "sentiment", make, rounds, threshold)
    empty = F.array().cast("array<struct<keyword:string,reason:string>>")
    agent = reflected.select(key, "original_text", "cleaned_text", "keywords", empty.alias("removed"), "analysis_complete", "sentiment", "mode", "error", none[0], "steps", "rounds")
    return agent.unionByName(warned)


def run_batch(df: DataFrame, text: str, order: str, fast: bool = True, **options) -> DataFrame:
    """Results with the rows' own order as ``batch_index``; a row's failure is that row's error and ends nothing else."""
    rows = df.select(F.col(order).alias("batch_index"), F.col(text))
    return (run_fast if fast else run_offline)(rows, "batch_index", text, **options)


TOOLS = Registry()
for _tool in (
    Tool("preprocess", "Clean a text column", lambda df, text="text": df.withColumn("preprocessed", preprocess_result(F.col(text)))),
    Tool("fallback_extract", "Keywords by TF-IDF, TextRank or parts of speech", lambda df, key="id", text="text", **o: extract(df, key, text, **o)),
    Tool("keyword_extract", "Keywords by a model", lambda df, key="id", text="text", make=RuleBackend, **o: model_keywords(df, key, text, make, **o)),
    Tool("validate", "Keep keywords that stand in the text", lambda df, keywords="keywords", text="text": df.withColumn("validated", validate(F.col(keywords), F.col(text)))),
    Tool("sentiment_analyze", "Sentiment of a text column", lambda df, key="id", text="text", make=RuleBackend: sentiment(df, key, text, make)),
    Tool("analyze_offline", "The whole pipeline without a model", lambda df, key="id", text="text", **o: run_offline(df, key, text, **o)),
    Tool("analyze_fast", "The whole pipeline with a model", lambda df, key="id", text="text", **o: run_fast(df, key, text, **o)),
):
    TOOLS.add(_tool)
