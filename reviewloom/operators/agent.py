"""Bounded model loops over rows: keyword extraction, reflection and the tool-calling agent.

These are no relations: each row is a small dialogue. They run in ``mapInPandas`` with one backend a partition, and only for
rows that a cheap column test has let through. A row whose dialogue fails gets a result that says so.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import preprocess_tool
from ..functions.jsonx import SENTIMENT, extract, keyword_list, sentiment_of, truncate_result
from ..functions.keywords import CONTEXT_FULL, KEYWORDS, by_score, minimum_keywords, normalize_keywords, post_process, split_by_score
from .models import AGENT_TASK, KEYWORD_TASK, REFLECT_TASK, SENTIMENT_TASK, ModelBackend, Reply, RuleBackend, keyword_attempts, whole_answer
from .reflect import ROUNDS, THRESHOLD, needs_reflection

STEPS, SECONDS, CONTEXT, KEEP = 10, 1200.0, 12_000, 2
_CALL = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.DOTALL)


def keyword_rows(df: DataFrame, key: str, text: str, make: Callable[[], ModelBackend] = RuleBackend, system: str = KEYWORD_TASK) -> DataFrame:
    """``key, found, thinking, error``: the first keyword object of up to four attempts; null where there is none."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                try:
                    rows.append((k, *keyword_attempts(backend, system, t or ""), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((k, None, "", str(error)[:500]))
            yield pd.DataFrame(rows, columns=[key, "found", "thinking", "error"]).astype({"found": object, "thinking": object, "error": object})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, found string, thinking string, error string")


def reflect_reply(content: str | None) -> dict:
    """A reflection answer; whatever can't be read passes, as a broken critic must not spoil a result."""
    found = extract(content or "")
    value = json.loads(found) if found else None
    if not isinstance(value, dict):
        return {"passed": True, "issues": [{"type": "parse_error", "detail": "", "severity": "low"}], "add_keywords": [], "remove_keywords": [], "corrected_sentiment": None}
    return {"passed": bool(value.get("passed", True)), "issues": value.get("issues") or [], "add_keywords": value.get("add_keywords") or [], "remove_keywords": value.get("remove_keywords") or [], "corrected_sentiment": value.get("corrected_sentiment")}


def _fingerprints(issues: list[dict]) -> set[str]:
    return {f"{i.get('type', '')}:{str(i.get('detail', ''))[:30]}" for i in issues if i.get("severity") == "high"}


def reflect_until_stable(backend: ModelBackend, text: str, keywords: list[dict], sentiment: dict | None, rounds: int = 2) -> dict:
    """Revise until the critic passes the result, finds the same grave issues again, or the rounds are over."""
    before: set[str] = set()
    reply: dict = {"passed": True}
    for done in range(1, rounds + 1):
        prompt = json.dumps({"text": text, "keywords": keywords, "sentiment": sentiment}, ensure_ascii=False)
        try:
            reply = reflect_reply(whole_answer(backend, "reflect", prompt, 42).content)
        except Exception:  # noqa: BLE001
            reply = reflect_reply(None)
        now = _fingerprints(reply["issues"])
        if reply["passed"] or (now and now == before):
            break
        before = now
        keywords = [k for k in keywords if k["keyword"] not in reply["remove_keywords"]]
        known = {k["keyword"] for k in keywords}
        keywords = keywords + [k for k in reply["add_keywords"] if k.get("keyword") not in known]
        sentiment = reply["corrected_sentiment"] or sentiment
    return {"keywords": keywords, "sentiment": sentiment, "rounds": done if rounds else 0, "passed": reply["passed"]}


def tool_calls_in(content: str) -> list[tuple[str, dict]]:
    """Inline calls in order; broken objects and calls without a name are skipped."""
    found = []
    for body in _CALL.findall(content):
        try:
            value = json.loads(body)
        except ValueError:
            continue
        if isinstance(value, dict) and value.get("name"):
            found.append((value["name"], value.get("arguments") or {}))
    return found


def _is_full(error: Exception) -> bool:
    return bool(re.search(CONTEXT_FULL, str(error).lower()))


def run_agent(backend: ModelBackend, system: str, question: str, tools: dict[str, Callable[..., object]], steps: int = STEPS, seconds: float = SECONDS, context: int = CONTEXT) -> dict:
    """Ask, call the tools the answer names, tell their results, until an answer names none or a limit is met.

    Calls come as the service's own (``tool_calls``, with an id that the result repeats) or inline in the text. When the
    dialogue outgrows its context, all but the last results are dropped from it; if the service itself says that the
    context is full, the dialogue ends in ``overflow``, and any other failure of a call in ``error``. A failing tool's
    result is its error.
    """
    began, results, told, trace = time.monotonic(), [], [question], []
    done = lambda answer, step, ended, error=None: {"answer": answer, "steps": step, "results": results, "ended": ended, "error": error, "trace": trace}
    for step in range(1, steps + 1):
        if time.monotonic() - began > seconds:
            return done(None, step - 1, "timeout")
        try:
            reply: Reply = whole_answer(backend, system, "\n".join(told), 42)
        except Exception as error:  # noqa: BLE001
            trace.append(("error", str(error)[:500]))
            return done(None, step, "overflow" if _is_full(error) else "error", str(error)[:500])
        native = [(c.id, c.name, _arguments(c.arguments)) for c in reply.tool_calls]
        calls = native or [(None, name, arguments) for name, arguments in tool_calls_in(reply.content)]
        if not calls:
            trace.append(("final_summary", reply.content))
            return done(reply.content, step, "answer")
        trace.append(("thought_and_action", ",".join(name for _, name, _ in calls)))
        for call, name, arguments in calls:
            try:
                value = {"success": True, "data": tools[name](**arguments), "error": None}
            except Exception as error:  # noqa: BLE001
                value = {"success": False, "data": None, "error": f"{type(error).__name__}: {error}"}
            body = truncate_result(json.dumps(value, ensure_ascii=False, default=str))
            results.append((name, body))
            told.append(f"[工具 {name} 结果]{f' {call}' if call else ''}\n{body}")
        if sum(map(len, told)) > context:
            told = [told[0], *["(compacted)"] * max(0, len(told) - 1 - KEEP), *told[1:][-KEEP:]]
    return done(None, steps, "steps")


def _arguments(text: str) -> dict:
    """A native call's arguments; what can't be read is none, as the tool's own defaults may do."""
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _told(results: list[tuple[str, str]], tool: str) -> object:
    """The data of a tool's last successful result; the last writer wins."""
    for name, body in reversed(results):
        if name == tool:
            try:
                value = json.loads(body)
            except ValueError:
                continue
            if value.get("success"):
                return value.get("data")
    return None


def agent_rows(df: DataFrame, key: str, text: str, make: Callable[[], ModelBackend] = RuleBackend, steps: int = STEPS, seconds: float = SECONDS) -> DataFrame:
    """The tool-calling agent over a table: ``key, original_text, cleaned_text, keywords, sentiment, analysis_complete, summary, steps, ended, mode, trace, error``.

    One dialogue a row, one backend a partition. Cleaning, and what makes keywords uniform, are the JVM's, before and after
    the dialogue; the tools within ask the backend. ``trace`` lists the steps as ``type, content``. A row is complete if it
    has keywords or a sentiment.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(text).alias("original_text"), preprocess_tool(F.coalesce(F.col(text), F.lit(""))).alias("cleaned_text"))
    schema = f"{key} {kind}, original_text string, cleaned_text string, found string, felt string, summary string, steps int, ended string, mode string, trace array<struct<type:string,content:string>>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        mode = f"agent-{ModeProbe().mode(backend)}"
        for pdf in frames:
            out = []
            for k, original, cleaned in zip(pdf[key], pdf["original_text"], pdf["cleaned_text"], strict=True):
                tools = {
                    "preprocess": lambda c=cleaned, **_: {"cleaned_text": c},
                    "keyword_extract": lambda c=cleaned, **_: keyword_attempts(backend, KEYWORD_TASK, c)[0],
                    "sentiment_analyze": lambda c=cleaned, **_: sentiment_of(whole_answer(backend, SENTIMENT_TASK, c, 42).content),
                }
                said = run_agent(backend, AGENT_TASK, original or "", tools, steps, seconds)
                felt = _told(said["results"], "sentiment_analyze")
                out.append((k, original, cleaned, _told(said["results"], "keyword_extract"), json.dumps(felt, ensure_ascii=False) if felt else None, said["answer"], said["steps"], said["ended"], mode, said["trace"], said["error"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"found": object, "felt": object, "summary": object, "error": object})

    told = rows.mapInPandas(run, schema)
    ks = post_process(F.coalesce(normalize_keywords(keyword_list(F.col("found"))), F.array().cast(KEYWORDS)), F.col("cleaned_text"))
    felt = F.from_json("felt", SENTIMENT)
    done = told.withColumn("keywords", ks).withColumn("sentiment", felt)
    complete = (F.size("keywords") > 0) | F.col("sentiment").isNotNull()
    return done.select(key, "original_text", "cleaned_text", "keywords", "sentiment", complete.alias("analysis_complete"), "summary", "steps", "ended", "mode", "trace", "error")


def reflect_rows(df: DataFrame, key: str, text: str, keywords: str, sentiment: str, make: Callable[[], ModelBackend] = RuleBackend, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Reflection by rule and model over a table: the other columns, ``keywords`` revised, and ``rounds, passed``.

    Low scores go. A list that is then long enough for its text keeps its order and sees no model (0 rounds). For the others,
    up to ``rounds`` times: the model names keywords to remove, and proposes some, which come in if they are new, score high
    enough and stand in the text; it ends when there are enough, or when nothing came in. They are sorted by score. Only
    these rows go to Python; a failing call ends the row's rounds and passes.
    """
    kept = split_by_score(F.coalesce(F.col(keywords), F.array().cast(KEYWORDS)), threshold)["kept"]
    original = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in df.columns if c != keywords]
    enough = df.where(~needs_reflection(F.coalesce(F.col(keywords), F.array().cast(KEYWORDS)), original, threshold)).select(*rest, kept.alias(keywords), F.lit(0).alias("rounds"), F.lit(True).alias("passed"))
    asked = df.where(needs_reflection(F.coalesce(F.col(keywords), F.array().cast(KEYWORDS)), original, threshold)).select(*rest, kept.alias(keywords), minimum_keywords(original).alias("least_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "least_") + ", rounds int, passed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in frames:
            told = [_supplemented(backend, t or "", [dict(k) for k in ks], s, least, rounds, threshold) for t, ks, s, least in zip(pdf[text], pdf[keywords], pdf[sentiment], pdf["least_"], strict=True)]
            out = pdf.drop(columns="least_")
            out[keywords] = [ks for ks, *_ in told]
            yield out.assign(rounds=[n for _, n, _ in told], passed=[p for *_, p in told])

    revised = asked.mapInPandas(run, schema).withColumn(keywords, by_score(F.col(keywords)))
    return enough.unionByName(revised)


def _supplemented(backend: ModelBackend, text: str, keywords: list[dict], sentiment: object, least: int, rounds: int, threshold: float) -> tuple[list[dict], int, bool]:
    done = 0
    for done in range(1, rounds + 1):
        felt = dict(sentiment) if isinstance(sentiment, dict) else sentiment.asDict() if hasattr(sentiment, "asDict") else None
        prompt = json.dumps({"text": text, "keywords": keywords, "sentiment": felt}, ensure_ascii=False, default=str)
        try:
            reply = reflect_reply(whole_answer(backend, REFLECT_TASK, prompt, 42).content)
        except Exception:  # noqa: BLE001  a broken critic must not spoil a result
            return keywords, done, True
        keywords = [k for k in keywords if k["keyword"] not in reply["remove_keywords"]]
        names, came = {k["keyword"] for k in keywords}, False
        for k in reply["add_keywords"]:
            name, score = str(k.get("keyword", "")), float(k.get("score", 0.0) or 0.0)
            if name not in names and score >= threshold and name in text:
                keywords.append({"reasoning": str(k.get("reasoning", "")), "keyword": name, "score": score})
                names.add(name)
                came = True
        if len(keywords) >= least or not came:
            break
    return keywords, done, len(keywords) >= least


class ModeProbe:
    """Whether a backend calls tools by itself; asked once a worker."""

    def __init__(self) -> None:
        self._mode: str | None = None

    def mode(self, backend: ModelBackend) -> str:
        if self._mode is None:
            try:
                self._mode = "native" if getattr(backend, "native_tools", False) and backend.complete("", "ping", 42) else "prompt"
            except Exception:  # noqa: BLE001
                self._mode = "prompt"
        return self._mode
