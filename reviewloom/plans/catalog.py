"""Queries of the reference's own operators and their SQL oracles. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, jsonx, timex
from ..functions import keywords as kw
from ..operators import agent, extract, lookups, profiles, reflect, sessions, training
from ..operators.models import BLAME, PRAISE, fill_template
from ..session import read_table, scratch
from ..sources import readers, writers
from ..streaming import streams
from . import oracles as o
from . import pipeline


def _reviews(spark, sf) -> DataFrame:
    return read_table(spark, f"{sf}/reviews.parquet")


def _analyses(spark, sf) -> DataFrame:
    """One row an analysis, with its request's reviewer and product."""
    a = read_table(spark, f"{sf}/analyses.parquet").select("analysis_id", "request_id", F.col("analysis_id").alias("seq"), F.col("sentiment.label").alias("label"), "elapsed_ms", "error")
    r = _reviews(spark, sf).select("request_id", "reviewer_id", "product_id")
    return a.join(r, "request_id", "left")


def _items(spark, sf) -> DataFrame:
    """Single deliveries of keyword rows."""
    rows = read_table(spark, f"{sf}/keyword_items.parquet").select("item_id", "analysis_id", "request_id", "product_id", "keyword", "reasoning", "score")
    return rows.dropDuplicates(["item_id"])  # repeated deliveries are equal


def _product_items(spark, sf) -> DataFrame:
    """Single deliveries with what product counts need; the table has the product itself."""
    rows = read_table(spark, f"{sf}/keyword_items.parquet").select("item_id", "product_id", F.col("analysis_id").alias("seq"), "keyword", "score")
    return rows.where(F.col("product_id").isNotNull() & F.col("keyword").isNotNull()).dropDuplicates(["item_id"])


def _keywords(spark, sf) -> DataFrame:
    known = _analyses(spark, sf).select("analysis_id", "reviewer_id")
    return _items(spark, sf).join(known, "analysis_id", "left").withColumn("seq", F.col("analysis_id"))


def _turns(spark, sf) -> DataFrame:
    return read_table(spark, f"{sf}/tool_turns.parquet")


def _cleaned(fn):
    return lambda spark, sf: _reviews(spark, sf).select("request_id", fn(F.col("text")).alias("value"))


_CLEANERS = {
    "clean_urls": (clean.remove_urls, o.urls),
    "clean_phones": (clean.remove_phone_numbers, o.phones),
    "clean_emojis": (clean.remove_emojis, o.emojis),
    "clean_garbled": (clean.remove_garbled, o.garbled),
    "clean_symbols": (clean.remove_special_symbols, o.symbols),
    "clean_numbers": (clean.normalize_numbers, o.numbers),
    "clean_line_breaks": (clean.remove_line_breaks, o.line_breaks),
    "clean_chinese_only": (clean.keep_chinese_only, o.chinese_only),
    "clean_entities": (clean.unescape_entities, o.entities),
    "clean_latin": (clean.remove_latin, o.latin),
    "clean_control": (clean.remove_control, o.control),
    "clean_punctuation": (clean.collapse_punctuation, o.collapse),
    "clean_space": (clean.squeeze_space, o.squeeze),
    "clean_truncated": (lambda c: clean.truncate(c, 40), lambda x: f"substr({x}, 1, 40)"),
    "clean_date_expressions": (timex.remove_date_expressions, o.date_expressions),
    "clean_emails": (clean.remove_emails, o.emails),
    "clean_chinese_punctuation": (clean.collapse_chinese_punctuation, o.collapse_chinese),
    "clean_time_expressions": (timex.remove_time_expressions, o.time_expressions),
    "clean_dates": (timex.remove_dates, lambda x: o.date_expressions(o.time_expressions(x))),
}
def preprocess_comment(spark, sf):
    return _cleaned(clean.preprocess_comment)(spark, sf)


def advanced_preprocess(spark, sf):
    return _cleaned(clean.advanced_preprocess)(spark, sf)


def preprocess_tool(spark, sf):
    done = _reviews(spark, sf).select("request_id", clean.preprocess_result(F.col("text")).alias("p"))
    return done.select("request_id", "p.success", "p.cleaned_text", "p.original_length", "p.cleaned_length")


def keyword_predicates(spark, sf):
    words = read_table(spark, f"{sf}/keyword_items.parquet").select("keyword").where(F.col("keyword").isNotNull()).distinct()
    c = F.col("keyword")
    return words.select(
        "keyword", kw.is_filled(c).alias("filled"), kw.is_time_keyword(c).alias("is_time"), kw.is_date_keyword(c).alias("is_date"), kw.has_latin(c).alias("latin"), kw.is_stopword(c).alias("stopword"), kw.contains_stopword(c).alias("holds_stopword"), (F.length(c) <= kw.MAX_LENGTH).alias("short")
    )


def _with_text(spark, sf):
    return _items(spark, sf).join(_reviews(spark, sf).select("request_id", "text"), "request_id")


def alignment_span(spark, sf):
    rows = _with_text(spark, sf).where(F.col("keyword").isNotNull())
    return rows.select("item_id", kw.min_span(F.col("keyword"), F.col("text")).alias("span"), kw.is_aligned(F.col("keyword"), F.col("text")).alias("aligned"))


def _lists(spark, sf):
    """Keyword lists of analyses, in the order of their items; an analysis has a handful."""
    rows = _items(spark, sf).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    item = F.struct("item_id", F.coalesce("reasoning", F.lit("")).alias("reasoning"), "keyword", "score")
    # Texts join the grouped lists, so that no keyword row carries its text through a shuffle.
    grouped = rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(item)).alias("k"), F.min("request_id").alias("request_id"))
    texts = _reviews(spark, sf).select("request_id", "text")
    return grouped.join(texts, "request_id").select("analysis_id", "text", F.transform("k", lambda k: F.struct(k["reasoning"].alias("reasoning"), k["keyword"].alias("keyword"), k["score"].alias("score"))).alias("keywords"))


def _joined(c):
    return F.array_join(F.transform(c, lambda k: k["keyword"]), "|")


def keyword_validation(spark, sf):
    judged = _lists(spark, sf).select("analysis_id", kw.validate(F.transform("keywords", lambda k: F.struct(k["reasoning"].alias("reasoning"), F.coalesce(k["keyword"], F.lit("")).alias("keyword"), k["score"].alias("score"))), F.col("text")).alias("v"))
    removed = F.array_join(F.transform("v.removed_keywords", lambda r: F.concat(r["keyword"], F.lit(":"), r["reason"])), "|")
    return judged.select("analysis_id", _joined("v.valid_keywords").alias("kept"), removed.alias("removed"))


def keyword_top_n(spark, sf):
    return _lists(spark, sf).select("analysis_id", _joined(kw.post_process(F.col("keywords"), F.col("text"))).alias("keywords"))


def keyword_filters(spark, sf):
    """The keyword pipeline with every filter on: least score, no Latin letters, no stopword within, six of them."""
    return _lists(spark, sf).select("analysis_id", _joined(kw.post_process(F.col("keywords"), F.col("text"), top_n=6, min_score=0.5, latin=False, contained=True)).alias("keywords"))


def reflection_delta(spark, sf):
    """A critic's delta applied to every list: two keywords go, words of praise come in."""
    add = F.array(*[F.struct(F.lit("").alias("reasoning"), F.lit(w).alias("keyword"), F.lit(0.9).alias("score")) for w in PRAISE[:4]])
    rows = _lists(spark, sf).select("analysis_id", F.filter("keywords", lambda k: k["keyword"].isNotNull()).alias("keywords"))
    return rows.select("analysis_id", _joined(reflect.apply_delta(F.col("keywords"), F.array(F.lit("质量"), F.lit("物流")), add)).alias("keywords"))


def issue_fingerprints(spark, sf):
    """Analyses' errors and missing parts read as issues; those of high severity make the fingerprint."""
    a = read_table(spark, f"{sf}/analyses.parquet")
    issue = lambda kind, detail, severity: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), F.lit(severity).alias("severity"))
    issues = F.array(issue("failed", F.coalesce("error", F.lit("none")), "high"), issue("mode", F.coalesce("mode", F.lit("none")), "low"), issue("text", F.coalesce("cleaned_text", F.lit("none")), "high"), issue("failed", F.coalesce("error", F.lit("none")), "high"))
    return a.select("analysis_id", F.array_join(reflect.fingerprints(issues), "|").alias("fingerprint"))


def keyword_reflection(spark, sf):
    """One round by rule; the proposals are the words that the rule backend finds in the text."""
    words = F.array(*[F.struct(F.lit("").alias("reasoning"), F.lit(w).alias("keyword"), F.lit(0.9 if w in PRAISE else 0.6).alias("score")) for w in (*PRAISE, *BLAME)])
    rows = _lists(spark, sf)
    return rows.select("analysis_id", _joined(reflect.reflect_once(F.filter("keywords", lambda k: k["keyword"].isNotNull()), words, F.col("text"))).alias("keywords"), reflect.needs_reflection(F.col("keywords"), F.col("text")).alias("needs_model"))


def reflection_rounds(spark, sf):
    """Reflection with the rule backend: it removes keywords that aren't in the text and proposes words of praise and blame."""
    rows = _lists(spark, sf).select("analysis_id", "text", F.filter("keywords", lambda k: k["keyword"].isNotNull()).alias("keywords"), F.lit(None).cast(jsonx.SENTIMENT).alias("sentiment"))
    return agent.reflect_rows(rows, "analysis_id", "text", "keywords", "sentiment").select("analysis_id", _joined("keywords").alias("keywords"), "rounds", "passed")


def routing(spark, sf):
    c = F.col("text")
    return _reviews(spark, sf).select("request_id", kw.route(c).alias("mode"), kw.short_prompt(c).alias("short_prompt"), kw.minimum_keywords(c).alias("minimum"))


def tfidf(spark, sf):
    return extract.tf_idf(_reviews(spark, sf), "request_id", "text").select(F.col("doc").alias("request_id"), "token", "weight", "rank")


def cooccurrence(spark, sf):
    return extract.cooccurrence(_reviews(spark, sf), "request_id", "text").withColumnRenamed("doc", "request_id")


def textrank(spark, sf):
    return extract.text_rank(_reviews(spark, sf), "request_id", "text").withColumnRenamed("doc", "request_id")


def lexicon_keywords(spark, sf):
    """The aspects that product profiles count, in small letters as the tokens are, stand in for a dictionary of nouns."""
    words = spark.read.parquet(f"{sf}/product_profiles.parquet").select(F.explode(F.map_keys("keyword_counts")).alias("word")).select(F.lower("word").alias("word")).distinct().withColumn("pos", F.lit("n"))
    return extract.pos_keywords(_reviews(spark, sf), "request_id", "text", words).select(F.col("doc").alias("request_id"), "token", "rank")


def run_offline(spark, sf):
    done = pipeline.run_offline(_reviews(spark, sf), "request_id", "text")
    return done.select("request_id", "cleaned_text", _joined("keywords").alias("keywords"), "analysis_complete", "mode", "error")


def run_fast(spark, sf):
    """The fast pipeline with the rule backend: its keywords where it has some, else the fallback's."""
    done = pipeline.run_fast(_reviews(spark, sf), "request_id", "text")
    return done.select("request_id", "cleaned_text", _joined("keywords").alias("keywords"), "source", F.col("sentiment.label").alias("label"), F.col("sentiment.confidence").alias("confidence"), "mode")


def run_routed(spark, sf):
    """The router: short texts by the fast pipeline, the others by the agent with reflection; each with its reviewer's detail level."""
    reviews = _reviews(spark, sf)
    known = reviews.where(F.col("reviewer_id").isNotNull()).groupBy("reviewer_id").agg(F.count("*").alias("total_reviews"))
    done = pipeline.run(reviews, "request_id", "text", profiles=known, reviewer="reviewer_id")
    return done.select("request_id", "mode", _joined("keywords").alias("keywords"), F.col("sentiment.label").alias("label"), "steps", "rounds", "detail_level")


def agent_dialogues(spark, sf):
    """The agent over all reviews, with the rule backend."""
    done = agent.agent_rows(_reviews(spark, sf), "request_id", "text")
    return done.select("request_id", _joined("keywords").alias("keywords"), F.col("sentiment.label").alias("label"), "steps", "ended", F.size("trace").alias("told"), "analysis_complete")


def run_batch(spark, sf):
    """All reviews as a batch in the order of their ids."""
    done = pipeline.run_batch(_reviews(spark, sf), "text", "request_id")
    return done.select("batch_index", _joined("keywords").alias("keywords"), F.col("sentiment.label").alias("label"), "mode", "error")


def agent_event_rows(spark, sf):
    """The events of every agent dialogue."""
    return streams.agent_events(agent.agent_rows(_reviews(spark, sf), "request_id", "text"), "request_id").select("request_id", "seq", "type")


def inline_calls(spark, sf):
    """Tool calls written into text: each turn's skill as a call, with a broken one and one without a name around it."""
    text = F.concat(F.lit('<tool_call>{"name": "'), F.coalesce("skill_name", F.lit("")), F.lit('", "arguments": {"turn": '), F.col("turn_id").cast("string"), F.lit('}}</tool_call> then <tool_call>{"arguments": {}}</tool_call><tool_call>broken</tool_call>'))
    rows = _turns(spark, sf).select("turn_id", text.alias("t"))
    return rows.select("turn_id", F.explode_outer(jsonx.tool_calls(F.col("t"))).alias("c"), jsonx.without_tool_calls(F.col("t")).alias("rest")).select("turn_id", "c.name", "c.arguments", "rest")


def result_blocks(spark, sf):
    """Results of tools told in one text, read back."""
    text = F.concat(F.lit("[工具 preprocess 结果]\n"), F.lit('{"id": '), F.col("turn_id").cast("string"), F.lit("}\n[工具 "), F.coalesce("skill_name", F.lit("none")), F.lit(' 结果]\n{"ok": true}'))
    return _turns(spark, sf).select("turn_id", F.posexplode(jsonx.result_blocks(text)).alias("place", "b")).select("turn_id", "place", "b.tool", "b.result")


def json_keywords(spark, sf):
    """Keyword objects of model answers, with the text before them."""
    rows = _turns(spark, sf).where(F.col("skill_name").startswith("keyword")).select("turn_id", jsonx.keyword_object(F.col("response.content")).alias("j"))
    parsed = rows.select("turn_id", F.length("j.thinking").alias("thinking"), kw.normalize_keywords(jsonx.keyword_list(F.col("j.json"))).alias("k"))
    return parsed.select("turn_id", "thinking", F.size("k").alias("n"), _joined("k").alias("keywords"))


def json_sentiment(spark, sf):
    rows = _turns(spark, sf).where(F.col("skill_name") == "sentiment_analyze").select("turn_id", jsonx.parse_sentiment(F.col("response.content")).alias("s"))
    return rows.select("turn_id", "s.label", "s.confidence", "s.reasoning")


def json_repair(spark, sf):
    return _turns(spark, sf).where(F.col("skill_name").startswith("keyword")).select("turn_id", jsonx.repair_json(F.col("response.content")).alias("repaired"))


def reviewer_profile(spark, sf):
    a = _analyses(spark, sf)
    return profiles.review_counts(a, "reviewer_id").join(profiles.sentiment_distribution(a, "reviewer_id"), "reviewer_id").withColumn("detail", profiles.detail_level(F.col("total_reviews")))


def reviewer_keywords(spark, sf):
    return profiles.keyword_frequency(_keywords(spark, sf), "reviewer_id")


def reviewer_tags(spark, sf):
    return profiles.reviewer_tags(_keywords(spark, sf), _analyses(spark, sf))


def product_keywords(spark, sf):
    return profiles.product_keywords(_product_items(spark, sf)).withColumn("score_sum", F.col("score_sum").cast("double"))


def product_top_keywords(spark, sf):
    return profiles.top_keywords(profiles.product_keywords(_product_items(spark, sf)))


#: Aspects of the test tables that speak for themselves; the reference's own single words don't occur in them.
ISSUE_WORDS = ("土", "没有诚意", "色差大", "卡不进去", "丢过件", "发暗", "先涨后降", "清洗费水", "味道太冲", "价格不值")
STRENGTH_WORDS = ("显白", "公道", "舒服", "简单", "可靠", "清楚", "主动跟进", "没有破损", "味道清淡", "颜色耐看")


def product_issues(spark, sf):
    return profiles.issues_and_strengths(profiles.product_keywords(_product_items(spark, sf)), negative=ISSUE_WORDS, positive=STRENGTH_WORDS)


def reviewer_report(spark, sf):
    """The report of the first reviewer by its key."""
    reviewer = _reviews(spark, sf).agg(F.min("reviewer_id")).first()[0] or ""
    return profiles.reviewer_report(_analyses(spark, sf), _keywords(spark, sf), reviewer)


def product_report(spark, sf):
    """The report of the first product by its key."""
    product = read_table(spark, f"{sf}/product_profiles.parquet").agg(F.min("product_id")).first()[0] or ""
    return profiles.product_report(_analyses(spark, sf), _keywords(spark, sf), product)


def profile_keys(spark, sf):
    return profiles.profile_keys(read_table(spark, f"{sf}/product_profiles.parquet"), "product_id")


def review_detail(spark, sf):
    """Every review with its reviewer's profile."""
    known = profiles.review_counts(_analyses(spark, sf), "reviewer_id")
    return profiles.with_detail(_reviews(spark, sf).select("request_id", "reviewer_id"), known)


def product_rates(spark, sf):
    return profiles.sentiment_rates(_analyses(spark, sf))


def delta_keywords(spark, sf):
    return profiles.delta_keywords(_keywords(spark, sf))


def global_summary(spark, sf):
    return profiles.global_summary(_analyses(spark, sf))


def tool_sft(spark, sf):
    s = training.tool_sft(_turns(spark, sf))
    return s.select("session_id", "seq", "skill_name", "model", F.size("messages").alias("messages"), F.element_at("messages", -1)["content"].alias("answer"))


def _as_agent(spark, sf):
    """Tool turns read as turns of an agent: those that didn't stop by themselves stand for tool calls."""
    return _turns(spark, sf).select("session_id", "seq", F.lit("agent_llm").alias("type"), F.when(F.col("seq") % 2 == 1, F.col("messages")).alias("snapshot"), F.col("response.content").alias("content"), (F.coalesce("response.finish_reason", F.lit("")) != "stop").alias("has_tool_calls"))


def agent_sft(spark, sf):
    s = training.agent_sft(_as_agent(spark, sf))
    return s.select("session_id", "seq", F.size("messages").alias("messages"), F.element_at("messages", 2)["content"].alias("question"), F.element_at("messages", -1)["content"].alias("answer"))


def tool_supervision(spark, sf):
    return training.tool_supervision(None, _turns(spark, sf)).select("session_id", "tool_name", "input", "result", "model")


def recorded_turns(spark, sf):
    """Turns taken apart into calls, recorded again, written as lines and read back; then the samples they make."""
    first = lambda role: F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(1))["content"]
    calls = _turns(spark, sf).select("session_id", "seq", "skill_name", first("system").alias("system"), first("user").alias("prompt"), "response.content", "response.finish_reason", "response.model", F.nanvl("elapsed_ms", F.lit(None).cast("double")).alias("elapsed_ms"), "ts")
    path = scratch(spark, "turns")
    writers.write_jsonl(training.recorded_turns(calls).drop("ts"), path)
    back = readers.read_jsonl(spark, path)
    return back.select("session_id", "seq", "skill_name", F.size("messages").alias("messages"), F.element_at("messages", -1)["content"].alias("prompt"), F.col("response.content").alias("answer"), F.col("response.finish_reason").alias("finish_reason"))


def csv_reviews(spark, sf):
    """Reviews written as CSV, with quotation marks and line breaks in them, and read back."""
    path = scratch(spark, "reviews.csv")
    _reviews(spark, sf).select("request_id", F.translate("text", "\r", "").alias("text")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.read_reviews(spark, path, column="text")


def txt_reviews(spark, sf):
    """Reviews written a line each and read back; blank lines are dropped."""
    path = scratch(spark, "reviews.txt")
    _reviews(spark, sf).select(F.translate("text", "\r\n", "  ").alias("value")).write.text(path)
    return readers.read_reviews(spark, path)


def dictionary_words(spark, sf):
    """Profile keys written as a dictionary with padding and comments, and read back."""
    path = scratch(spark, "words")
    keys = read_table(spark, f"{sf}/product_profiles.parquet").select(F.explode(F.map_keys("keyword_counts")).alias("k"))
    keys.select(F.translate("k", "\r\n", "  ").alias("value")).unionByName(keys.select(F.concat(F.lit("# "), "k").alias("value")).where("value NOT LIKE '%\n%'")).write.text(path)
    return readers.read_dictionary(spark, path)


def trajectory_stats(spark, sf):
    return training.trajectory_stats(_turns(spark, sf))


def skill_distribution(spark, sf):
    return training.skill_distribution(_turns(spark, sf))


def _messages(spark, sf):
    return _turns(spark, sf).select("session_id", F.col("turn_id").alias("seq"), F.when(F.col("skill_name").startswith("keyword"), "tool").otherwise("assistant").alias("role"), F.col("response.content").alias("content"))


def _executions(spark, sf):
    """Keyword turns read as tools that an agent ran."""
    turns = _turns(spark, sf).where(F.col("skill_name").startswith("keyword"))
    return turns.select("session_id", "seq", F.lit("tool_execution").alias("type"), F.col("skill_name").alias("tool_name"), F.col("turn_id").cast("string").alias("tool_call_id"), F.coalesce(training.last_user_message(F.col("messages")), F.lit("")).alias("arguments"), F.col("response.content").alias("result"), F.col("ts").alias("timestamp"))


def full_supervision(spark, sf):
    """Executed tools and tool turns together."""
    done = training.tool_supervision(training.tool_executions(_executions(spark, sf)), _turns(spark, sf).where("skill_name NOT LIKE 'keyword%'"))
    return done.select("session_id", "tool_name", "input", "result", "model")


def session_streams(spark, sf):
    turns = _turns(spark, sf).select("session_id", "seq", F.col("skill_name").alias("name"), F.col("response.content").alias("content"))
    return training.session_streams(turns.where("name LIKE 'keyword%'"), turns.where("name IS NULL OR name NOT LIKE 'keyword%'"))


def call_results(spark, sf):
    """Tool calls of answers with their results; the turn before a keyword turn stands for the answer that called it."""
    call = F.struct(F.col("tool_call_id").alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool_name").alias("name"), F.col("arguments").alias("arguments")).alias("function"))
    ran = _executions(spark, sf)
    called = ran.select("session_id", (F.col("seq") - 1).alias("seq"), F.lit("agent_llm").alias("type"), F.struct(F.array(call).alias("tool_calls")).alias("response"))
    whole = called.unionByName(ran.where("seq % 3 > 0"), allowMissingColumns=True)
    return training.call_results(whole).select("session_id", "seq", "tool_call_id", "tool_name", "result")


def assembled(spark, sf):
    """Keyword and sentiment turns of a session read as its tools' results, the last of each tool counting."""
    tool = F.when(F.col("skill_name").startswith("keyword"), "keyword_extract").when(F.col("skill_name") == "sentiment_analyze", "sentiment_analyze")
    events = _turns(spark, sf).select("session_id", F.col("turn_id").alias("seq"), tool.alias("tool"), F.when(F.col("skill_name").startswith("keyword"), F.lit('{"keywords": [["r", "质量", 0.9], ["r", "物流", 0.8], ["s", "质量", 0.7]]}')).otherwise(F.col("response.content")).alias("result"))
    done = training.assemble_results(events.where("tool IS NOT NULL"))
    return done.select("session_id", _joined("final_keywords").alias("keywords"), F.length("sentiment").alias("sentiment"), "complete")


def error_kinds(spark, sf):
    c = F.col("error")
    return read_table(spark, f"{sf}/analyses.parquet").select("analysis_id", kw.is_retryable(c).alias("retryable"), kw.is_context_full(c).alias("context_full"))


def backends(spark, sf):
    """What the pages' addresses would be as a model's."""
    return read_table(spark, f"{sf}/documents.parquet").select("doc_id", kw.backend_of(F.col("url")).alias("backend"))


def status_counters(spark, sf):
    return lookups.status_counters(read_table(spark, f"{sf}/analyses.parquet"))


def tool_counters(spark, sf):
    return lookups.tool_counters(_turns(spark, sf), "skill_name", F.coalesce(F.col("response.content"), F.lit("")) != "")


def _results(spark, sf) -> DataFrame:
    """Analyses as results of one session, with the keywords of their items."""
    lists = _lists(spark, sf).select("analysis_id", "keywords")
    a = read_table(spark, f"{sf}/analyses.parquet").select("analysis_id", "request_id", "sentiment", "error", F.nanvl(F.coalesce("elapsed_ms", F.lit(0.0)), F.lit(0.0)).alias("elapsed_ms"))
    texts = _reviews(spark, sf).select("request_id", F.col("text").alias("original_text"))
    whole = a.join(lists, "analysis_id", "left").join(texts, "request_id", "left")
    return whole.select(F.col("analysis_id").alias("index"), "original_text", F.coalesce("keywords", F.array().cast(kw.KEYWORDS)).alias("keywords"), "sentiment", "error", "elapsed_ms")


def session_history(spark, sf):
    """A session's history: each result's preview, first five keywords and label."""
    return sessions.history(_results(spark, sf))


def result_records(spark, sf):
    """Short records of results, as a session appends them."""
    records = writers.result_records(_results(spark, sf).withColumn("timestamp", F.lit("t")))
    return records.select("index", "text", _joined("result_summary.keywords").alias("keywords"), F.col("result_summary.sentiment.label").alias("label"), F.col("result_summary.elapsed_ms").alias("elapsed_ms"))


def session_meta(spark, sf):
    """Products read as sessions and their reviews as results."""
    r = _reviews(spark, sf).where(F.col("product_id").isNotNull()).select(F.col("product_id").alias("session_id"), F.col("request_id").alias("index"), F.col("text").alias("original_text"), F.col("ts").cast("string").alias("timestamp"))
    known = read_table(spark, f"{sf}/product_profiles.parquet").select(F.col("product_id").alias("session_id"))
    meta = writers.session_meta(r, known)
    return meta.select("session_id", "total", F.array_join(F.transform("history_summary", lambda h: h["text_preview"]), "|").alias("previews"))


def session_summary(spark, sf):
    turns = _turns(spark, sf)
    modes = turns.where(F.col("response.content").isNotNull()).select("session_id", F.col("turn_id").alias("index"), F.array(F.lit("k")).alias("keywords"), F.struct(F.col("skill_name").alias("label")).alias("sentiment"), F.col("type").alias("mode"))
    return writers.session_summary(turns, modes).select("session_id", "turns", "without_answer", "keyword_count", "label", "mode")


def task_states(spark, sf):
    """The log of a batch's task, from the analyses as its results."""
    a = read_table(spark, f"{sf}/analyses.parquet")
    return sessions.task_states(sessions.task_entries(a, "batch", 100).unionByName(sessions.task_entries(a.where("error IS NOT NULL"), "broken", 7)))


def merged_counts(spark, sf):
    """Keyword counts of two halves of the products, added up."""
    counts = streams.product_counts(_product_items(spark, sf)).select("product_id", "keyword", "n")
    return writers.merge_counts(counts, counts.where("n > 1"), ["product_id", "keyword"], ["n"])


def streamed_counts(spark, sf):
    """What the stream of keyword rows adds up to."""
    return streams.product_counts(_product_items(spark, sf)).withColumn("score_sum", F.col("score_sum").cast("double"))


def batch_table(spark, sf):
    return sessions.batch_table(_results(spark, sf))


def analysis_events(spark, sf):
    """The events of all analyses of the offline pipeline."""
    a = read_table(spark, f"{sf}/analyses.parquet").select("analysis_id", "cleaned_text", "sentiment", "analysis_complete", "mode", "error", F.array().cast(kw.KEYWORDS).alias("keywords"))
    return streams.analysis_events(a, "analysis_id").select("analysis_id", "seq", "type", "step")


def memory_compact(spark, sf):
    return training.compact_memory(_messages(spark, sf))


def context_chars(spark, sf):
    return training.context_chars(_messages(spark, sf))


def stopword_anti(spark, sf):
    words = spark.createDataFrame([(w,) for w in kw.STOPWORDS], "word string")
    return lookups.without_words(_items(spark, sf).select("item_id", "keyword"), words)


def stopword_contained(spark, sf):
    return _items(spark, sf).where(F.col("keyword").isNotNull() & ~kw.contains_stopword(F.col("keyword"))).select("item_id", "keyword")


def cache_keys(spark, sf):
    return lookups.distinct_requests(_reviews(spark, sf), "fast", "text")


def cache_lookup(spark, sf):
    """Reviews against a cache that holds those texts which were sent more than once."""
    r = _reviews(spark, sf).select("request_id", lookups.cache_key(F.lit("fast"), F.col("text")).alias("cache_key"))
    sent = r.groupBy("cache_key").agg(F.count("*").alias("n"), F.min("request_id").alias("first")).where("n > 1")
    cache = sent.select("cache_key", F.col("first").cast("string").alias("result"), F.timestamp_micros(F.lit(4_000_000_000_000_000)).alias("expires_at"))
    return lookups.with_cache(r, cache, F.timestamp_micros(F.lit(3_000_000_000_000_000))).select("request_id", "cached_result")


def request_metrics(spark, sf):
    return lookups.request_metrics(spark.read.parquet(f"{sf}/events.parquet"), "event_type", F.col("value"))


def batch_counters(spark, sf):
    return lookups.batch_counters(read_table(spark, f"{sf}/analyses.parquet").select("error", F.nanvl("elapsed_ms", F.lit(0.0)).alias("elapsed_ms")))


def event_windows(spark, sf):
    return streams.event_windows(spark.read.parquet(f"{sf}/events.parquet")).select("window_start", "event_type", "n", F.round("total", 3).alias("total"))


def session_preview(spark, sf):
    """The latest review of each product, as a list of sessions shows it."""
    latest = Window.partitionBy("product_id").orderBy(F.col("request_id").desc())
    rows = _reviews(spark, sf).where(F.col("product_id").isNotNull()).withColumn("n", F.row_number().over(latest)).where("n = 1")
    return rows.select("product_id", "request_id", F.substring("text", 1, 30).alias("preview"))


#: A prompt for short texts and one for others: system and user text with variables.
PROMPTS = {
    "short": ("你从短评论里找关键词，只给出JSON。", "短评：{{text}}\n最多{{most}}个关键词。"),
    "long": ("你从评论里找关键词，先说理由，再给出JSON。", "评论：{{text}}\n至少{{least}}个、最多{{most}}个关键词。｜{{other}}"),
}


def prompts(spark, sf):
    """Each text's prompt by its length, filled; a variable without a value stays."""
    short = kw.short_prompt(F.col("text"))
    pick = lambda place: F.when(short, PROMPTS["short"][place]).otherwise(PROMPTS["long"][place])
    user = fill_template(pick(1), text=F.col("text"), least=kw.minimum_keywords(F.col("text")).cast("string"), most=F.lit("8"))
    return _reviews(spark, sf).select("request_id", pick(0).alias("system"), user.alias("prompt"))


_PLAIN = (
    preprocess_comment, advanced_preprocess, preprocess_tool, keyword_predicates, alignment_span, keyword_validation, keyword_top_n, keyword_filters, keyword_reflection, reflection_rounds, reflection_delta, issue_fingerprints, routing, tfidf, cooccurrence, textrank, lexicon_keywords, run_offline, run_fast, run_routed, run_batch, agent_dialogues, agent_event_rows, inline_calls, result_blocks, json_keywords, json_sentiment, json_repair,
    reviewer_profile, reviewer_keywords, reviewer_tags, product_keywords, product_top_keywords, product_issues, reviewer_report, product_report, profile_keys, review_detail, product_rates, delta_keywords, global_summary, tool_sft, agent_sft, tool_supervision, full_supervision, session_streams, call_results, assembled, recorded_turns, csv_reviews, txt_reviews, dictionary_words,
    trajectory_stats, skill_distribution, memory_compact, context_chars, stopword_anti, stopword_contained, cache_keys, cache_lookup, request_metrics, error_kinds, backends, status_counters, tool_counters, batch_counters, event_windows, session_preview, session_history, result_records, session_meta, session_summary, task_states, merged_counts, streamed_counts, batch_table, analysis_events, prompts,
)


def queries():
    found = {name: _cleaned(fn) for name, (fn, _) in _CLEANERS.items()}
    return found | {fn.__name__: fn for fn in _PLAIN}


_TOKENS = r"""
    runs AS (SELECT request_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}|[\x{4e00}-\x{9fff}]+')) AS run FROM reviews),
    grams AS (
        SELECT request_id, run AS token FROM runs WHERE regexp_matches(run, '^[a-z]')
        UNION ALL
        SELECT request_id, substr(run, p::INT, n::INT) FROM (SELECT request_id, run, unnest(range(1, length(run) + 1)) AS p FROM runs WHERE NOT regexp_matches(run, '^[a-z]')), (VALUES (2), (3), (4)) AS sizes(n)
        WHERE p + n - 1 <= length(run))
"""
_WORDS = r"""
    words AS (SELECT request_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}|[\x{4e00}-\x{9fff}]{2}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{2,}|[\x{4e00}-\x{9fff}]{2}'), 1) AS pos FROM reviews)
"""
_REASON = f"""
    listed AS (
        SELECT o.analysis_id, o.item_id, coalesce(o.keyword, '') AS keyword, CASE WHEN isnan(o.score) THEN NULL ELSE o.score END AS score, coalesce(o.reasoning, '') AS reasoning, min(r.text) OVER (PARTITION BY o.analysis_id) AS text,
            row_number() OVER (PARTITION BY o.analysis_id, coalesce(o.keyword, '') ORDER BY o.item_id) AS nth, o.keyword IS NULL AS missing
        FROM once o JOIN reviews r ON o.request_id = r.request_id),
    spanned AS (SELECT *, {o.span('keyword', 'text')} AS span FROM listed)
"""
_FAILS = f"""
    CASE WHEN {o.strip('keyword')} = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN length(keyword) > 6 THEN 'too_long' WHEN {o.is_time('keyword')} THEN 'time' WHEN {o.is_date('keyword')} THEN 'date'
        WHEN {o.is_stop('keyword')} THEN 'stopword' WHEN text <> '' AND NOT (span >= 0 AND span <= 2 * length(replace(keyword, ' ', ''))) THEN 'not_in_text' END
"""


#: Lists of single deliveries with what reflection asks of them, and the rule backend's words as proposals.
_KEPT = f"""
    listed AS (SELECT o.analysis_id, o.item_id, o.keyword, CASE WHEN isnan(o.score) THEN NULL ELSE o.score END AS score, min(r.text) OVER (PARTITION BY o.analysis_id) AS text FROM once o JOIN reviews r ON o.request_id = r.request_id),
    kept AS (SELECT *, coalesce(score, 1.0) >= 0.7 AS high, CASE WHEN length(text) < 20 THEN 2 WHEN length(text) < 60 THEN 5 WHEN length(text) < 120 THEN 8 ELSE 10 END AS least FROM listed),
    lists AS (SELECT analysis_id, min(text) AS text, min(least) AS least, count(*) FILTER (high AND keyword IS NOT NULL) AS n, count(*) FILTER (high) AS every, coalesce(list(keyword) FILTER (high AND keyword IS NOT NULL), []) AS names FROM kept GROUP BY analysis_id),
    proposals(place, keyword, score, rule_score) AS (VALUES {", ".join(f"({k}, {o.q(w)}, {0.9 if w in PRAISE else 0.6}, {0.9 if w in PRAISE else 0.8})" for k, w in enumerate((*PRAISE, *BLAME)))})
"""


#: Analyses with their keyword lists, as a session's results, and its history.
_HISTORY = """
    res AS (SELECT a.analysis_id, r.text, a.sentiment.label AS label, a.error, coalesce(CASE WHEN isnan(a.elapsed_ms) THEN 0 ELSE a.elapsed_ms END, 0) AS ms FROM analyses a LEFT JOIN reviews r ON a.request_id = r.request_id),
    once AS (SELECT DISTINCT item_id, analysis_id, request_id, keyword FROM keyword_items), numbered AS (SELECT o.analysis_id, o.keyword, row_number() OVER (PARTITION BY o.analysis_id ORDER BY o.item_id) AS place FROM once o JOIN reviews r ON o.request_id = r.request_id),
    first_five AS (SELECT analysis_id, string_agg(keyword, ', ' ORDER BY place) AS keywords FROM numbered WHERE place <= 5 GROUP BY analysis_id),
    history AS (SELECT res.analysis_id AS index, substr(text, 1, 30) AS preview, coalesce(keywords, '') AS keywords, coalesce(label, '-') AS label FROM res LEFT JOIN first_five f ON res.analysis_id = f.analysis_id)
"""


def _pipelines():
    """SQL of the pipelines: the cleaning tool, extraction or the rule backend's words, validation, sentiment and routing."""
    label, confidence = o.felt("c.cleaned")
    blank = f"{o.squeeze('r.text')} = '' OR r.text IS NULL"
    head = f"WITH {o.CLEANED}"
    fast = f"{head}, {o.rule_words('cleaned', 'cleaned')}, asked AS (SELECT request_id FROM cleaned WHERE request_id NOT IN (SELECT request_id FROM ruled)), {o.ranked_tfidf('fallen', 'asked')}, " + """
        worded AS (SELECT request_id, string_agg(keyword, '|' ORDER BY score DESC, place) AS keywords FROM ruled GROUP BY request_id), tokened AS (SELECT DISTINCT request_id FROM grams)"""
    told = f"""SELECT r.request_id, coalesce(c.cleaned, CASE WHEN r.text IS NOT NULL THEN '' END) AS cleaned_text, coalesce(w.keywords, f.keywords, '') AS keywords,
        CASE WHEN w.keywords IS NOT NULL THEN 'model' WHEN c.cleaned IS NOT NULL AND t.request_id IS NOT NULL THEN 'fallback' END AS source, CASE WHEN c.cleaned IS NULL THEN 'unknown' ELSE {label} END AS label, CASE WHEN c.cleaned IS NULL THEN 0.0 ELSE {confidence} END AS confidence, 'fast' AS mode
        FROM reviews r LEFT JOIN cleaned c USING (request_id) LEFT JOIN worded w USING (request_id) LEFT JOIN fallen f USING (request_id) LEFT JOIN tokened t USING (request_id)"""
    short = f"({o.strip('r.text')} = '' OR length(r.text) < 30)"
    # Of the router's texts only the short ones are extracted from, with frequencies over these.
    quick = fast.replace(o.ranked_tfidf("fallen", "asked"), f"quick AS (SELECT c.* FROM cleaned c JOIN reviews r USING (request_id) WHERE {short}), {o.ranked_tfidf('fallen', 'asked', corpus='quick')}")
    least = "CASE WHEN length(r.text) < 20 THEN 2 WHEN length(r.text) < 60 THEN 5 WHEN length(r.text) < 120 THEN 8 ELSE 10 END"
    # The agent's keywords that aren't in the original go in reflection, and words of the original come in.
    reflected = f"""agent AS (SELECT r.request_id, r.text, {least} AS least, (SELECT count(*) FROM ruled u WHERE u.request_id = r.request_id) AS n FROM reviews r WHERE NOT {short}),
        left_over AS (SELECT a.request_id, u.place, u.keyword, u.score FROM agent a JOIN ruled u USING (request_id) WHERE a.n >= a.least OR contains(a.text, u.keyword)),
        proposed AS (SELECT a.request_id, 1000 + w.place AS place, w.keyword, w.score FROM agent a, words w WHERE a.n < a.least AND contains(a.text, w.keyword) AND NOT EXISTS (SELECT 1 FROM left_over x WHERE x.request_id = a.request_id AND x.keyword = w.keyword)),
        joined AS (SELECT * FROM left_over UNION ALL SELECT * FROM proposed), counted AS (SELECT a.*, (SELECT count(*) FROM joined j WHERE j.request_id = a.request_id) AS now, (SELECT count(*) FROM proposed p WHERE p.request_id = a.request_id) AS came FROM agent a),
        summed AS (SELECT request_id, string_agg(keyword, '|' ORDER BY score DESC, place) AS keywords FROM joined GROUP BY request_id),
        known AS (SELECT reviewer_id, count(*) AS total FROM reviews WHERE reviewer_id IS NOT NULL GROUP BY 1)"""
    level = "CASE WHEN r.reviewer_id IS NULL THEN NULL WHEN k.total IS NULL OR k.total < 5 THEN 'full' WHEN k.total <= 20 THEN 'standard' ELSE 'delta' END"
    return {
        "preprocess_tool": f"{head} SELECT r.request_id, c.cleaned IS NOT NULL AS success, c.cleaned AS cleaned_text, length(r.text) AS original_length, length(c.cleaned) AS cleaned_length FROM reviews r LEFT JOIN cleaned c USING (request_id)",
        "run_offline": f"{head}, {o.ranked_tfidf('found', 'cleaned')} SELECT r.request_id, coalesce(c.cleaned, CASE WHEN r.text IS NOT NULL THEN '' END) AS cleaned_text, coalesce(f.keywords, '') AS keywords, true AS analysis_complete, 'offline' AS mode, CASE WHEN {blank} THEN 'empty text' END AS error FROM reviews r LEFT JOIN cleaned c USING (request_id) LEFT JOIN found f USING (request_id)",
        "run_fast": f"{fast} {told}",
        "run_batch": f"{fast}, told AS ({told}) SELECT r.request_id AS batch_index, t.keywords, t.label, t.mode, CASE WHEN {blank} THEN 'empty text' END AS error FROM reviews r JOIN told t USING (request_id)",
        "run_routed": f"""{quick}, told AS ({told}), {reflected} SELECT r.request_id, CASE WHEN {short} THEN 'fast' ELSE 'agent-prompt' END AS mode, CASE WHEN {short} THEN t.keywords ELSE coalesce(s.keywords, '') END AS keywords, t.label,
            CASE WHEN NOT {short} THEN 2 END AS steps, CASE WHEN {short} THEN NULL WHEN z.n >= z.least THEN 0 WHEN z.now >= z.least OR z.came = 0 THEN 1 ELSE 2 END AS rounds, {level} AS detail_level
            FROM reviews r JOIN told t USING (request_id) LEFT JOIN counted z USING (request_id) LEFT JOIN summed s USING (request_id) LEFT JOIN known k ON r.reviewer_id = k.reviewer_id""",
        "agent_dialogues": f"""{head}, {o.rule_words('cleaned', 'cleaned')}, worded AS (SELECT request_id, string_agg(keyword, '|' ORDER BY score DESC, place) AS keywords FROM ruled GROUP BY request_id)
            SELECT r.request_id, coalesce(w.keywords, '') AS keywords, coalesce({label}, 'neutral') AS label, 2 AS steps, 'answer' AS ended, 2 AS told, true AS analysis_complete FROM reviews r LEFT JOIN cleaned c USING (request_id) LEFT JOIN worded w USING (request_id)""",
    }


def oracle_sql():
    found = {name: f"SELECT request_id, {fn('text')} AS value FROM reviews" for name, (_, fn) in _CLEANERS.items() if name != "clean_punctuation"}
    found["clean_punctuation"] = f"SELECT request_id, x AS value FROM ({o.steps('reviews', o.collapse)})"
    found["advanced_preprocess"] = f"SELECT request_id, x AS value FROM ({o.steps('reviews', o.garbled, o.urls, o.emails, o.phones, o.emojis, o.symbols, o.numbers)})"
    found["preprocess_comment"] = f"SELECT request_id, x AS value FROM ({o.steps('reviews', o.line_breaks, o.time_expressions, o.date_expressions, o.chinese_only, o.squeeze)})"
    found |= _pipelines()
    c = "keyword"
    base = "WITH " + o.BASE
    return found | {
        "keyword_predicates": f"""SELECT DISTINCT keyword, {o.strip(c)} <> '' AS filled, {o.is_time(c)} AS is_time, {o.is_date(c)} AS is_date, regexp_matches(keyword, '[a-zA-Z]') AS latin, {o.is_stop(c)} AS stopword,
            {' OR '.join(f"contains(keyword, {o.q(w)})" for w in kw.STOPWORDS)} AS holds_stopword, length(keyword) <= 6 AS short FROM keyword_items WHERE keyword IS NOT NULL""",
        "alignment_span": f"WITH once AS (SELECT DISTINCT item_id, analysis_id, request_id, product_id, keyword, reasoning, score FROM keyword_items), s AS (SELECT item_id, keyword, {o.span('keyword', 'text')} AS span FROM once JOIN reviews USING (request_id) WHERE keyword IS NOT NULL) SELECT item_id, span, span >= 0 AND span <= 2 * length(replace(keyword, ' ', '')) AS aligned FROM s",
        "keyword_validation": f"{base}, {_REASON}, judged AS (SELECT *, {_FAILS} AS reason FROM spanned) SELECT analysis_id, coalesce(string_agg(keyword, '|' ORDER BY item_id) FILTER (reason IS NULL), '') AS kept, coalesce(string_agg(keyword || ':' || reason, '|' ORDER BY item_id) FILTER (reason IS NOT NULL), '') AS removed FROM judged GROUP BY analysis_id",
        "keyword_top_n": f"""{base}, {_REASON}, ranked AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, keyword ORDER BY coalesce(score, 0) DESC, item_id) AS copy FROM spanned),
            good AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY coalesce(score, 0) DESC, item_id) AS place FROM ranked WHERE copy = 1 AND NOT missing AND {o.strip('keyword')} <> '' AND length(keyword) <= 6 AND NOT {o.is_time('keyword')} AND NOT {o.is_date('keyword')}
                AND NOT {o.is_stop('keyword')} AND (text = '' OR (span >= 0 AND span <= 2 * length(replace(keyword, ' ', '')))))
            SELECT x.analysis_id, coalesce(string_agg(g.keyword, '|' ORDER BY g.place) FILTER (g.place <= 8), '') AS keywords FROM (SELECT DISTINCT analysis_id FROM listed) x LEFT JOIN good g ON x.analysis_id = g.analysis_id GROUP BY x.analysis_id""",
        "routing": f"SELECT request_id, CASE WHEN length(text) < 30 THEN 'fast' ELSE 'agent' END AS mode, length({o.strip('text')}) < 10 AS short_prompt, CASE WHEN length(text) < 20 THEN 2 WHEN length(text) < 60 THEN 5 WHEN length(text) < 120 THEN 8 ELSE 10 END AS minimum FROM reviews",
        "tfidf": f"""WITH {_TOKENS}, counts AS (SELECT request_id, token, count(*) AS n FROM grams GROUP BY ALL), sized AS (SELECT *, sum(n) OVER (PARTITION BY request_id) AS total FROM counts),
            idf AS (SELECT token, ln((SELECT count(DISTINCT request_id) FROM reviews) / count(*)) AS idf FROM counts GROUP BY token),
            weighted AS (SELECT request_id, token, round(n / total * idf, 6) AS weight FROM sized JOIN idf USING (token))
            SELECT request_id, token, weight, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, token) AS rank FROM weighted QUALIFY rank <= 8""",
        "cooccurrence": f"WITH {_WORDS} SELECT a.request_id, least(a.token, b.token) AS a, greatest(a.token, b.token) AS b, count(*) AS weight FROM words a JOIN words b ON a.request_id = b.request_id AND b.pos > a.pos AND b.pos < a.pos + 5 WHERE a.token <> b.token GROUP BY ALL",
        "lexicon_keywords": r"""WITH runs AS (SELECT request_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}|[\x{4e00}-\x{9fff}]+')) AS run, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{2,}|[\x{4e00}-\x{9fff}]+'), 1) AS i FROM reviews),
            grams AS (SELECT request_id, i, 0 AS p, 0 AS n, run AS token FROM runs WHERE regexp_matches(run, '^[a-z]')
                UNION ALL SELECT request_id, i, p, n, substr(run, p::INT, n::INT) FROM (SELECT request_id, i, run, unnest(range(1, length(run) + 1)) AS p FROM runs WHERE NOT regexp_matches(run, '^[a-z]')), (VALUES (2), (3), (4)) AS sizes(n) WHERE p + n - 1 <= length(run)),
            lexicon AS (SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(map_keys(keyword_counts)) AS w FROM product_profiles)),
            found AS (SELECT request_id, token, min(i * 100000 + p * 10 + n) AS place FROM grams SEMI JOIN lexicon USING (token) GROUP BY ALL)
            SELECT request_id, token, row_number() OVER (PARTITION BY request_id ORDER BY place, token) AS rank FROM found QUALIFY rank <= 20""",
        "keyword_reflection": f"""{base}, {_KEPT}, proposed AS (SELECT l.analysis_id, 1000000000 + p.place AS item_id, p.keyword, p.score FROM lists l, proposals p WHERE p.score >= 0.7 AND contains(l.text, p.keyword) AND NOT list_contains(l.names, p.keyword)),
            joined AS (SELECT k.analysis_id, item_id, keyword, score, l.n >= l.least AS enough FROM kept k JOIN lists l USING (analysis_id) WHERE high AND keyword IS NOT NULL UNION ALL SELECT p.*, false FROM proposed p JOIN lists l USING (analysis_id) WHERE l.n < l.least)
            SELECT l.analysis_id, coalesce(string_agg(j.keyword, '|' ORDER BY CASE WHEN enough THEN 0 ELSE -coalesce(j.score, 0) END, j.item_id) FILTER (j.keyword IS NOT NULL), '') AS keywords, min(l.every) < min(l.least) AS needs_model FROM lists l LEFT JOIN joined j USING (analysis_id) GROUP BY l.analysis_id""",
        "reflection_rounds": f"""{base}, {_KEPT}, left_over AS (SELECT k.* FROM kept k JOIN lists l USING (analysis_id) WHERE high AND keyword IS NOT NULL AND (l.n >= l.least OR contains(l.text, keyword))),
            proposed AS (SELECT l.analysis_id, 1000000000 + p.place AS item_id, p.keyword, p.rule_score AS score FROM lists l, proposals p WHERE l.n < l.least AND contains(lower(l.text), p.keyword) AND contains(l.text, p.keyword)
                AND NOT EXISTS (SELECT 1 FROM left_over x WHERE x.analysis_id = l.analysis_id AND x.keyword = p.keyword)),
            joined AS (SELECT analysis_id, item_id, keyword, score FROM left_over UNION ALL SELECT * FROM proposed),
            sized AS (SELECT l.analysis_id, l.n >= l.least AS enough, l.least, count(j.keyword) AS now, (SELECT count(*) FROM proposed p WHERE p.analysis_id = l.analysis_id) AS came FROM lists l LEFT JOIN joined j USING (analysis_id) GROUP BY ALL)
            SELECT z.analysis_id, coalesce(string_agg(j.keyword, '|' ORDER BY CASE WHEN enough THEN 0 ELSE -coalesce(j.score, 0) END, j.item_id) FILTER (j.keyword IS NOT NULL), '') AS keywords,
                CASE WHEN enough THEN 0 WHEN now >= least OR came = 0 THEN 1 ELSE 2 END AS rounds, enough OR now >= least AS passed FROM sized z LEFT JOIN joined j USING (analysis_id) GROUP BY z.analysis_id, enough, now, least, came""",
        "reviewer_profile": f"{base} SELECT reviewer_id, count(*) AS total_reviews, count(*) FILTER (label = 'positive') AS positive_count, count(*) FILTER (label = 'negative') AS negative_count, count(*) FILTER (label = 'neutral') AS neutral_count, CASE WHEN count(*) < 5 THEN 'full' WHEN count(*) <= 20 THEN 'standard' ELSE 'delta' END AS detail FROM a WHERE reviewer_id IS NOT NULL GROUP BY reviewer_id",
        "reviewer_keywords": f"{base} SELECT reviewer_id, keyword, count(*) AS n, min(seq) AS first_seq FROM k WHERE reviewer_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL",
        "reviewer_tags": f"""{base}, t AS (SELECT k.reviewer_id, k.keyword, k.seq, CASE WHEN a.label = 'negative' OR k.keyword IN ({', '.join(map(o.q, profiles.NEGATIVE))}) THEN 'negative' WHEN a.label = 'positive' OR k.keyword IN ({', '.join(map(o.q, profiles.POSITIVE))}) THEN 'positive' END AS polarity FROM k LEFT JOIN a ON k.analysis_id = a.analysis_id),
            f AS (SELECT reviewer_id, polarity, keyword, min(seq) AS s FROM t WHERE polarity IS NOT NULL AND reviewer_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL),
            kept AS (SELECT *, row_number() OVER (PARTITION BY reviewer_id, polarity ORDER BY s DESC, keyword DESC) AS age FROM f QUALIFY age <= 50)
            SELECT reviewer_id, polarity, keyword, row_number() OVER (PARTITION BY reviewer_id, polarity ORDER BY age DESC) AS place FROM kept""",
        "product_keywords": f"{base} SELECT product_id, keyword, count(*) AS n, sum(coalesce(score, 0.5)::DECIMAL(18,6))::DOUBLE AS score_sum, min(seq) AS first_seq FROM k WHERE product_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL",
        "product_top_keywords": f"""{base}, c AS (SELECT product_id, keyword, count(*) AS n, (sum(coalesce(score, 0.5)::DECIMAL(18,6)) * 1000000)::BIGINT AS s, min(seq) AS first_seq FROM k WHERE product_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL)
            SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, first_seq, keyword) AS rank, keyword, n, ((2 * s + n * 10000) // (2 * n * 10000)) / 100 AS avg_score FROM c QUALIFY rank <= 20""",
        "product_issues": f"""{base}, c AS (SELECT product_id, keyword, count(*) AS n, min(seq) AS first_seq FROM k WHERE product_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, first_seq, keyword) AS rank FROM c QUALIFY rank <= 30),
            s AS (SELECT *, CASE WHEN keyword IN ({', '.join(map(o.q, ISSUE_WORDS))}) THEN 'issue' WHEN keyword IN ({', '.join(map(o.q, STRENGTH_WORDS))}) THEN 'strength' END AS polarity FROM r WHERE n >= 2)
            SELECT product_id, polarity, row_number() OVER (PARTITION BY product_id, polarity ORDER BY rank) AS place, keyword FROM s WHERE polarity IS NOT NULL QUALIFY place <= 15""",
        "product_rates": f"{base} SELECT product_id, count(*) AS total_reviews, round(count(*) FILTER (label = 'positive') / count(*), 3) AS positive_rate, round(count(*) FILTER (label = 'negative') / count(*), 3) AS negative_rate, round(count(*) FILTER (label = 'neutral') / count(*), 3) AS neutral_rate FROM a WHERE product_id IS NOT NULL GROUP BY product_id",
        "delta_keywords": f"{base}, f AS (SELECT reviewer_id, keyword, min(seq) AS s FROM k WHERE reviewer_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL) SELECT DISTINCT analysis_id, keyword FROM k JOIN f USING (reviewer_id, keyword) WHERE seq = s",
        "global_summary": f"{base} SELECT count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT product_id) AS products, count(reviewer_id) AS reviews FROM a",
        "json_sentiment": o.sentiment_answers("(SELECT * FROM tool_turns WHERE skill_name = 'sentiment_analyze')"),
        "textrank": o.text_rank(_WORDS),
        "product_report": f"""{base}, mine AS (SELECT min(product_id) AS product_id FROM product_profiles), pa AS (SELECT a.* FROM a JOIN mine USING (product_id)), pk AS (SELECT k.* FROM k JOIN mine USING (product_id) WHERE keyword IS NOT NULL),
            c AS (SELECT keyword, count(*) AS n, (sum(coalesce(score, 0.5)::DECIMAL(18,6)) * 1000000)::BIGINT AS s, min(seq) AS first_seq FROM pk GROUP BY keyword), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_seq, keyword) AS rank FROM c),
            sided AS (SELECT *, CASE WHEN keyword IN ({', '.join(map(o.q, profiles.NEGATIVE))}) THEN 'issue' WHEN keyword IN ({', '.join(map(o.q, profiles.POSITIVE))}) THEN 'strength' END AS side FROM r WHERE rank <= 30 AND n >= 2)
            SELECT 'sentiment' AS section, place, name, count(*) FILTER (label = name) AS count, round(round(count(*) FILTER (label = name) / count(*), 3) * 100, 1) AS value FROM pa, (VALUES (1, 'positive'), (2, 'negative'), (3, 'neutral')) AS l(place, name) GROUP BY place, name
            UNION ALL SELECT 'keyword', rank, keyword, n, ((2 * s + n * 10000) // (2 * n * 10000)) / 100 FROM r WHERE rank <= 20
            UNION ALL SELECT side, row_number() OVER (PARTITION BY side ORDER BY rank), keyword, NULL, NULL FROM sided WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY side ORDER BY rank) <= 15""",
        "profile_keys": "SELECT DISTINCT product_id FROM product_profiles WHERE product_id IS NOT NULL",
        "review_detail": f"{base}, p AS (SELECT reviewer_id, count(*) AS total_reviews FROM a WHERE reviewer_id IS NOT NULL GROUP BY 1) SELECT r.request_id, r.reviewer_id, p.total_reviews, CASE WHEN r.reviewer_id IS NULL THEN NULL WHEN p.total_reviews IS NULL OR p.total_reviews < 5 THEN 'full' WHEN p.total_reviews <= 20 THEN 'standard' ELSE 'delta' END AS detail_level FROM reviews r LEFT JOIN p ON r.reviewer_id = p.reviewer_id",
        "full_supervision": "SELECT session_id, skill_name AS tool_name, coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '') AS input, CASE WHEN starts_with(skill_name, 'keyword') THEN response.content ELSE coalesce(response.content, '') END AS result, CASE WHEN NOT starts_with(skill_name, 'keyword') THEN response.model END AS model FROM tool_turns WHERE skill_name LIKE 'keyword%' OR (type = 'tool_llm' AND skill_name NOT LIKE 'keyword%')",
        "session_streams": "SELECT session_id, CASE WHEN starts_with(coalesce(skill_name, ''), 'keyword') THEN 'agent' ELSE 'tool' END AS stream, seq, skill_name AS name, response.content AS content FROM tool_turns",
        "call_results": "SELECT session_id, seq - 1 AS seq, turn_id::VARCHAR AS tool_call_id, skill_name AS tool_name, CASE WHEN seq % 3 > 0 THEN response.content END AS result FROM tool_turns WHERE skill_name LIKE 'keyword%'",
        "assembled": """WITH e AS (SELECT session_id, skill_name LIKE 'keyword%' AS words, last_value(response.content) OVER (PARTITION BY session_id, skill_name LIKE 'keyword%' ORDER BY response.content IS NOT NULL, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM tool_turns WHERE skill_name LIKE 'keyword%' OR skill_name = 'sentiment_analyze')
            SELECT session_id, CASE WHEN bool_or(words) THEN '质量|物流' ELSE '' END AS keywords, length(any_value(last) FILTER (NOT words)) AS sentiment, bool_or(words) OR any_value(last) FILTER (NOT words) IS NOT NULL AS complete FROM e GROUP BY session_id""",
        "status_counters": "SELECT coalesce(mode, 'unknown') AS mode, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM analyses GROUP BY ALL",
        "tool_counters": "SELECT coalesce(skill_name, 'unknown') AS tool, coalesce(response.content, '') <> '' AS success, count(*) AS n FROM tool_turns GROUP BY ALL",
        "session_history": f"WITH {_HISTORY} SELECT * FROM history",
        "batch_table": f"WITH {_HISTORY} SELECT h.*, CASE WHEN ms < 1000 THEN round(ms)::INT || 'ms' ELSE format('{{:.1f}}', ms / 1000) || 's' END AS elapsed, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS state FROM history h JOIN res ON h.index = res.analysis_id",
        "analysis_events": """WITH steps(mode, k, step) AS (VALUES ('fast', 1, 'preprocess'), ('fast', 2, 'keyword_extract'), ('fast', 3, 'validate'), ('fast', 4, 'sentiment_analyze'), ('other', 1, 'preprocess'), ('other', 2, 'fallback_extract'), ('other', 3, 'validate')),
            good AS (SELECT analysis_id, CASE WHEN mode = 'fast' THEN 'fast' ELSE 'other' END AS m FROM analyses WHERE error IS NULL)
            SELECT analysis_id, 1 AS seq, 'start' AS type, NULL AS step FROM analyses UNION ALL SELECT analysis_id, 2 * k, 'step_start', step FROM good JOIN steps ON m = steps.mode UNION ALL SELECT analysis_id, 2 * k + 1, 'step_done', step FROM good JOIN steps ON m = steps.mode
            UNION ALL SELECT analysis_id, CASE WHEN m = 'fast' THEN 10 ELSE 8 END, 'result', NULL FROM good UNION ALL SELECT analysis_id, CASE WHEN m = 'fast' THEN 11 ELSE 9 END, 'done', NULL FROM good
            UNION ALL SELECT analysis_id, 2, 'error', NULL FROM analyses WHERE error IS NOT NULL UNION ALL SELECT analysis_id, 3, 'done', NULL FROM analyses WHERE error IS NOT NULL""",
        "recorded_turns": "WITH m AS (SELECT *, list_filter(messages, lambda x: x.role = 'system')[1].content AS system, list_filter(messages, lambda x: x.role = 'user')[1].content AS prompt FROM tool_turns) SELECT session_id, seq, skill_name, CASE WHEN coalesce(system, '') = '' THEN 1 ELSE 2 END AS messages, prompt, response.content AS answer, response.finish_reason AS finish_reason FROM m",
        "csv_reviews": f"SELECT x AS text FROM (SELECT {o.strip(chr(39) * 2 + ' || replace(text, chr(13), ' + chr(39) * 2 + ')')} AS x FROM reviews) WHERE x <> ''",
        "txt_reviews": f"SELECT x AS text FROM (SELECT {o.strip('translate(text, chr(13) || chr(10), ' + chr(39) + '  ' + chr(39) + ')')} AS x FROM reviews) WHERE x <> ''",
        "dictionary_words": f"SELECT DISTINCT x AS word FROM (SELECT {o.strip('translate(k, chr(13) || chr(10), ' + chr(39) + '  ' + chr(39) + ')')} AS x FROM (SELECT unnest(map_keys(keyword_counts)) AS k FROM product_profiles)) WHERE x <> '' AND NOT starts_with(x, '#')",
        "tool_sft": "SELECT session_id, seq, skill_name, response.model AS model, len(messages) + 1 AS messages, response.content AS answer FROM tool_turns WHERE type = 'tool_llm' AND len(messages) > 0 AND coalesce(response.content, '') <> ''",
        "agent_sft": """WITH t AS (SELECT session_id, seq, CASE WHEN seq % 2 = 1 THEN messages END AS snapshot, response.content AS content, coalesce(response.finish_reason, '') <> 'stop' AS calls FROM tool_turns),
            c AS (SELECT *, last_value(snapshot IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM t),
            g AS (SELECT *, count(*) FILTER (NOT calls) OVER (PARTITION BY session_id) AS finals, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM c WHERE coalesce(content, '') <> '' AND context IS NOT NULL)
            SELECT session_id, seq, len(context) + 1 AS messages, context[2].content AS question, content AS answer FROM g WHERE NOT calls OR (finals = 0 AND back = 1)""",
        "tool_supervision": "SELECT session_id, skill_name AS tool_name, coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '') AS input, coalesce(response.content, '') AS result, response.model AS model FROM tool_turns WHERE type = 'tool_llm'",
        "trajectory_stats": "SELECT count(DISTINCT session_id) AS sessions, count(*) FILTER (type IN ('agent_llm', 'tool_execution')) AS agent_turns, count(*) FILTER (type = 'tool_llm') AS tool_turns FROM tool_turns",
        "skill_distribution": "SELECT coalesce(skill_name, 'unknown') AS skill, count(*) AS n FROM tool_turns GROUP BY 1",
        "memory_compact": """WITH m AS (SELECT session_id, turn_id AS seq, CASE WHEN starts_with(skill_name, 'keyword') THEN 'tool' ELSE 'assistant' END AS role, response.content AS content FROM tool_turns),
            n AS (SELECT *, row_number() OVER (PARTITION BY session_id, role = 'tool' ORDER BY seq DESC) AS back FROM m) SELECT session_id, seq, role, CASE WHEN role = 'tool' AND back > 2 THEN '[compacted]' ELSE content END AS content FROM n""",
        "context_chars": "SELECT session_id, sum(length(coalesce(response.content, '')))::BIGINT AS chars, count(*) AS messages FROM tool_turns GROUP BY session_id",
        "stopword_anti": f"WITH once AS (SELECT DISTINCT item_id, analysis_id, request_id, product_id, keyword, reasoning, score FROM keyword_items) SELECT item_id, keyword FROM once WHERE keyword IS NULL OR NOT {o.is_stop('keyword')}",
        "stopword_contained": f"WITH once AS (SELECT DISTINCT item_id, analysis_id, request_id, product_id, keyword, reasoning, score FROM keyword_items) SELECT item_id, keyword FROM once WHERE keyword IS NOT NULL AND NOT ({' OR '.join(f'contains(keyword, {o.q(w)})' for w in kw.STOPWORDS)})",
        "cache_keys": "SELECT md5('fast:' || text) AS cache_key, count(*) AS n, min(request_id) AS first_id FROM reviews WHERE text IS NOT NULL GROUP BY 1",
        "cache_lookup": "WITH r AS (SELECT request_id, md5('fast:' || text) AS h FROM reviews), c AS (SELECT h, min(request_id)::VARCHAR AS first FROM r GROUP BY h HAVING count(*) > 1) SELECT request_id, first AS cached_result FROM r LEFT JOIN c USING (h)",
        "request_metrics": f"SELECT event_type AS mode, CASE WHEN value IS NULL THEN NULL {' '.join(f'WHEN value <= {b} THEN {o.q(str(b))}' for b in lookups.LATENCY_BOUNDS)} ELSE '+Inf' END AS bucket, count(*) AS n FROM events GROUP BY ALL",
        "batch_counters": "SELECT count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (error IS NOT NULL) AS failed, round(sum(CASE WHEN isnan(elapsed_ms) THEN 0 ELSE elapsed_ms END), 3) AS elapsed_ms FROM analyses",
        "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
        "session_preview": "SELECT product_id, request_id, substr(text, 1, 30) AS preview FROM reviews WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY request_id DESC) = 1",
        "prompts": f"""SELECT request_id, CASE WHEN length({o.strip('text')}) < 10 THEN {o.q(PROMPTS['short'][0])} ELSE {o.q(PROMPTS['long'][0])} END AS system,
            replace(replace(replace(CASE WHEN length({o.strip('text')}) < 10 THEN {o.q(PROMPTS['short'][1])} ELSE {o.q(PROMPTS['long'][1])} END, '{{{{text}}}}', coalesce(text, '')), '{{{{least}}}}', CASE WHEN length(text) < 20 THEN '2' WHEN length(text) < 60 THEN '5' WHEN length(text) < 120 THEN '8' ELSE '10' END), '{{{{most}}}}', '8') AS prompt FROM reviews""",
        "keyword_filters": f"""{base}, {_REASON}, ranked AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, keyword ORDER BY coalesce(score, 0) DESC, item_id) AS copy FROM spanned),
            good AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY coalesce(score, 0) DESC, item_id) AS place FROM ranked WHERE copy = 1 AND NOT missing AND {o.strip('keyword')} <> '' AND coalesce(score >= 0.5, false) AND NOT regexp_matches(keyword, '[a-zA-Z]') AND length(keyword) <= 6 AND NOT {o.is_time('keyword')} AND NOT {o.is_date('keyword')}
                AND NOT {o.is_stop('keyword')} AND NOT ({' OR '.join(f"contains(keyword, {o.q(w)})" for w in kw.STOPWORDS)}) AND (text = '' OR (span >= 0 AND span <= 2 * length(replace(keyword, ' ', '')))))
            SELECT x.analysis_id, coalesce(string_agg(g.keyword, '|' ORDER BY g.place) FILTER (g.place <= 6), '') AS keywords FROM (SELECT DISTINCT analysis_id FROM listed) x LEFT JOIN good g ON x.analysis_id = g.analysis_id GROUP BY x.analysis_id""",
        "reflection_delta": f"""{base}, listed AS (SELECT o.analysis_id, o.item_id, o.keyword FROM once o JOIN reviews r ON o.request_id = r.request_id), rest AS (SELECT * FROM listed WHERE keyword IS NOT NULL AND keyword NOT IN ('质量', '物流')),
            added(place, keyword) AS (VALUES {", ".join(f"({k}, {o.q(w)})" for k, w in enumerate(PRAISE[:4]))}), whole AS (SELECT analysis_id, item_id AS place, keyword FROM rest UNION ALL SELECT l.analysis_id, 1000000000 + a.place, a.keyword FROM (SELECT DISTINCT analysis_id FROM listed) l, added a WHERE NOT EXISTS (SELECT 1 FROM rest x WHERE x.analysis_id = l.analysis_id AND x.keyword = a.keyword))
            SELECT analysis_id, string_agg(keyword, '|' ORDER BY place) AS keywords FROM whole GROUP BY analysis_id""",
        "issue_fingerprints": "SELECT analysis_id, array_to_string(list_sort(list_distinct(['failed:' || substr(coalesce(error, 'none'), 1, 30), 'text:' || substr(coalesce(cleaned_text, 'none'), 1, 30)])), '|') AS fingerprint FROM analyses",
        "agent_event_rows": "SELECT request_id, seq, type FROM reviews, (VALUES (1, 'start'), (2, 'thought_and_action'), (3, 'final_summary'), (4, 'result'), (5, 'done')) AS e(seq, type)",
        "inline_calls": """SELECT turn_id, nullif(skill_name, '') AS name, CASE WHEN coalesce(skill_name, '') <> '' THEN '{"turn":' || turn_id || '}' END AS arguments, 'then <tool_call>broken</tool_call>' AS rest FROM tool_turns""",
        "result_blocks": """SELECT turn_id, 0 AS place, 'preprocess' AS tool, '{"id": ' || turn_id || '}' AS result FROM tool_turns UNION ALL SELECT turn_id, 1, coalesce(skill_name, 'none'), '{"ok": true}' FROM tool_turns""",
        "reviewer_report": f"""{base}, mine AS (SELECT min(reviewer_id) AS reviewer_id FROM reviews), pa AS (SELECT a.* FROM a JOIN mine USING (reviewer_id)), pk AS (SELECT k.* FROM k JOIN mine USING (reviewer_id) WHERE keyword IS NOT NULL),
            labels AS (SELECT place, name, count(*) FILTER (label = name) AS n FROM pa, (VALUES (1, 'positive'), (2, 'negative'), (3, 'neutral')) AS l(place, name) GROUP BY place, name),
            top AS (SELECT keyword, count(*) AS n, min(seq) AS first_seq FROM pk GROUP BY keyword), t AS (SELECT pk.keyword, pk.seq, CASE WHEN pa.label = 'negative' OR pk.keyword IN ({', '.join(map(o.q, profiles.NEGATIVE))}) THEN 'negative' WHEN pa.label = 'positive' OR pk.keyword IN ({', '.join(map(o.q, profiles.POSITIVE))}) THEN 'positive' END AS polarity FROM pk LEFT JOIN pa ON pk.analysis_id = pa.analysis_id),
            f AS (SELECT polarity, keyword, min(seq) AS s FROM t WHERE polarity IS NOT NULL GROUP BY ALL), kept AS (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY s DESC, keyword DESC) AS age FROM f QUALIFY age <= 50), placed AS (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY age DESC) AS place FROM kept)
            SELECT 'sentiment' AS section, place, name, round(n * 100 / greatest((SELECT sum(n) FROM labels), 1), 1) AS value FROM labels UNION ALL SELECT 'keyword', row_number() OVER (ORDER BY n DESC, first_seq, keyword), keyword, n FROM top QUALIFY row_number() OVER (ORDER BY n DESC, first_seq, keyword) <= 20 UNION ALL SELECT polarity || '_tag', place, keyword, NULL FROM placed WHERE place <= 15""",
        "error_kinds": f"SELECT analysis_id, coalesce(regexp_matches(lower(error), {o.q(kw.RETRYABLE)}), false) AS retryable, coalesce(regexp_matches(lower(error), {o.q(kw.CONTEXT_FULL)}), false) AS context_full FROM analyses",
        "backends": f"SELECT doc_id, CASE WHEN {o.strip(chr(39) * 2 + ' || coalesce(lower(url), ' + chr(39) * 2 + ')')} IN ('', 'none', 'offline') THEN 'offline' WHEN {' OR '.join(f'contains(lower(url), {o.q(h)})' for h in kw.CLOUD_HOSTS)} THEN 'cloud_api' WHEN {' OR '.join(f'contains(lower(url), {o.q(h)})' for h in kw.LOCAL_HOSTS)} THEN 'local_model' WHEN regexp_matches(lower(url), '^https?://') THEN 'cloud_api' ELSE 'local_model' END AS backend FROM documents",
        "result_records": """WITH once AS (SELECT DISTINCT item_id, analysis_id, request_id, keyword FROM keyword_items), l AS (SELECT o.analysis_id, string_agg(o.keyword, '|' ORDER BY o.item_id) AS keywords FROM once o JOIN reviews r ON o.request_id = r.request_id GROUP BY o.analysis_id)
            SELECT a.analysis_id AS index, r.text, coalesce(l.keywords, '') AS keywords, a.sentiment.label AS label, coalesce(CASE WHEN isnan(a.elapsed_ms) THEN 0 ELSE a.elapsed_ms END, 0) AS elapsed_ms FROM analyses a LEFT JOIN reviews r ON a.request_id = r.request_id LEFT JOIN l ON a.analysis_id = l.analysis_id""",
        "session_meta": "WITH r AS (SELECT product_id, count(*) AS total, string_agg(substr(text, 1, 50), '|' ORDER BY request_id) AS previews FROM reviews GROUP BY product_id) SELECT p.product_id AS session_id, coalesce(total, 0) AS total, coalesce(previews, '') AS previews FROM product_profiles p LEFT JOIN r USING (product_id)",
        "session_summary": "SELECT session_id, count(*) AS turns, count(*) FILTER (response.content IS NULL) AS without_answer, CASE WHEN count(response.content) > 0 THEN 1 END AS keyword_count, arg_max(skill_name, turn_id) FILTER (response.content IS NOT NULL) AS label, arg_max(type, turn_id) FILTER (response.content IS NOT NULL) AS mode FROM tool_turns GROUP BY session_id",
        "task_states": "SELECT 'batch' AS task_id, CASE WHEN count(*) FILTER (error IS NULL) = 0 AND count(*) > 0 THEN 'failed' ELSE 'completed' END AS state, count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (error IS NOT NULL) AS failed, 100 AS total FROM analyses UNION ALL SELECT 'broken', CASE WHEN count(*) > 0 THEN 'failed' ELSE 'completed' END, 0, count(*), 7 FROM analyses WHERE error IS NOT NULL",
        "merged_counts": f"{base}, c AS (SELECT product_id, keyword, count(*) AS n FROM k WHERE product_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL) SELECT product_id, keyword, CASE WHEN n > 1 THEN 2 * n ELSE n END AS n FROM c",
        "streamed_counts": f"{base} SELECT product_id, keyword, count(*) AS n, sum(coalesce(score, 0.5)::DECIMAL(18,6))::DOUBLE AS score_sum FROM k WHERE product_id IS NOT NULL AND keyword IS NOT NULL GROUP BY ALL",
    }
