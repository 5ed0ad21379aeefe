"""Recorded model conversations reshaped into training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keywords import distinct_keywords, normalize_keywords

MESSAGE = "struct<role:string,content:string>"
COMPACTED = "[compacted]"


def _answered(messages: Column, content: Column, fields: StructType | None = None) -> Column:
    """The messages and an answer of the assistant, with nulls in the other fields that the messages have."""
    told = {"role": F.lit("assistant"), "content": content}
    names = [(f.name, f.dataType) for f in fields] if fields else [(n, None) for n in told]
    return F.concat(messages, F.array(F.struct(*[told.get(n, F.lit(None).cast(t) if t else None).alias(n) for n, t in names])))


def tool_sft(turns: DataFrame) -> DataFrame:
    """``session_id, seq, skill_name, model, messages`` of every tool turn with messages and an answer."""
    content = F.col("response.content")
    good = turns.where((F.col("type") == "tool_llm") & (F.size("messages") > 0) & (F.coalesce(content, F.lit("")) != ""))
    return good.select("session_id", "seq", "skill_name", F.col("response.model").alias("model"), _answered(F.col("messages"), content).alias("messages"))


def agent_sft(turns: DataFrame) -> DataFrame:
    """``session_id, seq, messages``: the conversation up to each final answer of an agent.

    ``turns`` has ``session_id, seq, type, snapshot array<message>, content, has_tool_calls``. The latest snapshot carries
    forward within its session; a turn with an answer and no tool call is a sample. A session without any gives its last
    agent turn with an answer instead.
    """
    agent = turns.where(F.col("type") == "agent_llm")
    so_far = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = agent.withColumn("context", F.last("snapshot", ignorenulls=True).over(so_far)).where((F.coalesce("content", F.lit("")) != "") & F.col("context").isNotNull())
    whole = Window.partitionBy("session_id")
    marked = carried.withColumn("finals", F.count_if(~F.col("has_tool_calls")).over(whole)).withColumn("last", F.row_number().over(whole.orderBy(F.col("seq").desc())))
    chosen = marked.where((~F.col("has_tool_calls")) | ((F.col("finals") == 0) & (F.col("last") == 1)))
    return chosen.select("session_id", "seq", _answered(F.col("context"), F.col("content"), turns.schema["snapshot"].dataType.elementType).alias("messages"))


def agent_turns(turns: DataFrame) -> DataFrame:
    """Turns as ``readers.AGENT_TURN`` has them, in the form that ``agent_sft`` takes; messages keep their tool calls."""
    calls = F.coalesce(F.size("response.tool_calls"), F.lit(0)) > 0
    return turns.select("session_id", "seq", "type", F.col("messages_snapshot").alias("snapshot"), F.col("response.content").alias("content"), calls.alias("has_tool_calls"))


def tool_executions(turns: DataFrame) -> DataFrame:
    """``session_id, seq, tool_name, tool_call_id, arguments, result, ts`` of an agent's turns that ran a tool."""
    ran = turns.where(F.col("type") == "tool_execution")
    return ran.select("session_id", "seq", "tool_name", "tool_call_id", "arguments", "result", F.col("timestamp").alias("ts"))


def call_results(turns: DataFrame) -> DataFrame:
    """Every tool call of an agent's answers with its result, by session and call id; ``result`` is null where none came."""
    called = turns.where(F.col("type") == "agent_llm").select("session_id", "seq", F.explode("response.tool_calls").alias("c"))
    calls = called.select("session_id", "seq", F.col("c.id").alias("tool_call_id"), F.col("c.function.name").alias("tool_name"), F.col("c.function.arguments").alias("arguments"))
    results = tool_executions(turns).where(F.col("tool_call_id").isNotNull()).groupBy("session_id", "tool_call_id").agg(F.max_by("result", "seq").alias("result"))
    return matched_calls(calls, results)


def recorded_turns(calls: DataFrame) -> DataFrame:
    """Model calls as turns to append to a session: ``readers.TURN`` and ``ts``.

    ``calls`` has ``session_id, seq, skill_name, system, prompt, content, finish_reason, model, elapsed_ms, ts``. A call without
    a system text has one message; one that failed has a null answer and is recorded like the others.
    """
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    messages = F.when(F.coalesce("system", F.lit("")) == "", F.array(message("user", "prompt"))).otherwise(F.array(message("system", "system"), message("user", "prompt")))
    usage = F.lit(None).cast("struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
    response = F.struct("content", "finish_reason", "model", usage.alias("usage"))
    return calls.select("session_id", "seq", F.lit("tool_llm").alias("type"), F.col("ts").cast("string").alias("timestamp"), "skill_name", messages.alias("messages"), response.alias("response"), "elapsed_ms", "ts")


def session_streams(agent: DataFrame, tool: DataFrame) -> DataFrame:
    """Both streams of every session as one table, ``session_id, stream, seq, name, content``, the agent's turns first within a place.

    ``agent`` and ``tool`` have ``session_id, seq, name, content``; a session of one stream only stays.
    """
    return agent.select("session_id", F.lit("agent").alias("stream"), "seq", "name", "content").unionByName(tool.select("session_id", F.lit("tool").alias("stream"), "seq", "name", "content"))


def last_user_message(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def tool_supervision(executions: DataFrame | None, turns: DataFrame) -> DataFrame:
    """``session_id, tool_name, input, result, ts, model``: executed tools and tool turns as one table."""
    from_turns = turns.where(F.col("type") == "tool_llm").select(
        "session_id", F.col("skill_name").alias("tool_name"), F.coalesce(last_user_message(F.col("messages")), F.lit("")).alias("input"), F.coalesce("response.content", F.lit("")).alias("result"), F.col("ts"), F.col("response.model").alias("model")
    )
    if executions is None:
        return from_turns
    run = executions.select("session_id", "tool_name", F.col("arguments").alias("input"), "result", F.col("ts"))
    return run.unionByName(from_turns, allowMissingColumns=True)


def trajectory_stats(turns: DataFrame) -> DataFrame:
    """Sessions, agent turns (tool executions among them) and tool turns."""
    return turns.agg(F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("type").isin("agent_llm", "tool_execution")).alias("agent_turns"), F.count_if(F.col("type") == "tool_llm").alias("tool_turns"))


def skill_distribution(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.coalesce("skill_name", F.lit("unknown")).alias("skill")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "skill")


def compact_memory(messages: DataFrame, keep: int = 2) -> DataFrame:
    """Tool messages but the last ``keep`` of each session lose their content to a placeholder; the rest stays."""
    newest = Window.partitionBy("session_id", F.col("role") == "tool").orderBy(F.col("seq").desc())
    old = (F.col("role") == "tool") & (F.row_number().over(newest) > keep)
    return messages.withColumn("old", old).withColumn("content", F.when(F.col("old"), COMPACTED).otherwise(F.col("content"))).drop("old")


def context_chars(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.count("*").alias("messages"))


def matched_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with their results, by session and call id; calls without a result have null."""
    return calls.join(results, ["session_id", "tool_call_id"], "left")


def assemble_results(events: DataFrame) -> DataFrame:
    """The last result of each tool in a session: ``session_id, cleaned, keywords, fallback, validated, sentiment``, last writer wins.

    ``events`` has ``session_id, seq, tool, result``, results being JSON as tools give it. ``final_keywords`` are read from
    the validated ones, if a validation ran, even where it kept none; else from the extracted, else from the fallback's; each
    keyword once. A session is complete with keywords or a sentiment.
    """
    tools = {"preprocess": "cleaned", "keyword_extract": "keywords", "fallback_extract": "fallback", "validate": "validated", "sentiment_analyze": "sentiment"}
    last = events.groupBy("session_id").agg(*[F.max_by(F.when(F.col("tool") == t, F.col("result")), F.when((F.col("tool") == t) & F.col("result").isNotNull(), F.col("seq"))).alias(n) for t, n in tools.items()])
    lists = {n: F.try_variant_get(F.try_parse_json(n), path, "array<variant>") for n, path in (("validated", "$.valid_keywords"), ("keywords", "$.keywords"), ("fallback", "$.keywords"))}
    found = normalize_keywords(F.coalesce(*[F.when(F.size(c) > 0, c) if n != "validated" else c for n, c in lists.items()], F.array().cast("array<variant>")))
    return last.withColumn("final_keywords", distinct_keywords(found)).withColumn("complete", (F.size("final_keywords") > 0) | F.col("sentiment").isNotNull())
