"""Model-backed operators behind a small contract, with retry inside the partition.

Calls leave the JVM once: a batch of prompts goes through ``mapInPandas`` to a backend that is built once a partition. The
default backend is deterministic and needs no network; a failure of one row is a result of that row and ends no job.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import SENTIMENT, extract_with_thinking, repair_truncated, sentiment_of
from ..functions.keywords import RETRYABLE

ATTEMPTS = 3
#: From this attempt on the seed moves, so that a model that failed twice answers differently.
VARY_FROM = 2


class Call(NamedTuple):
    """A tool call as a model service gives it: its id, the tool and its arguments as JSON."""

    id: str
    name: str
    arguments: str


class Reply(NamedTuple):
    content: str
    finish_reason: str = "stop"
    tool_calls: tuple[Call, ...] = ()


# What the tasks' system prompts begin with; the rule backend tells its tasks by them.
KEYWORD_TASK, SENTIMENT_TASK, REFLECT_TASK, AGENT_TASK = "提取关键词", "判断评论的情感倾向", "reflect", "agent"


class ModelBackend(Protocol):
    def complete(self, system: str, user: str, seed: int) -> Reply: ...


# Words that the rule backend takes for praise or complaint.
PRAISE = "好 不错 满意 快 赞 喜欢 推荐 值得 耐心 舒服 精致 清晰 划算 贴心 good great love fast recommend handy solid kind".split()
BLAME = "差 不好 失望 垃圾 慢 坏 破 脏 贵 刺 难 漏 踩雷 bad poor awful slow broken refund rude worst".split()


class RuleBackend:
    """Answers by looking for words; for tests, for offline work and as a fallback.

    Keywords are the words of praise and blame that the text holds; a text without any gets an answer without an object. A
    reflection removes keywords that aren't in the text and proposes such words. An agent calls each tool once.
    """

    def complete(self, system: str, user: str, seed: int) -> Reply:
        if system.startswith(KEYWORD_TASK):
            found = rule_keywords(user)
            return Reply(json.dumps({"keywords": found}, ensure_ascii=False) if found else "没有关键词")
        if system.startswith(REFLECT_TASK):
            asked = json.loads(user)
            names = [k["keyword"] for k in asked["keywords"]]
            add = [{"reasoning": r, "keyword": w, "score": s} for r, w, s in rule_keywords(asked["text"]) if w not in names]
            return Reply(json.dumps({"passed": not add, "issues": [], "add_keywords": add, "remove_keywords": [n for n in names if n not in asked["text"]]}, ensure_ascii=False))
        if system.startswith(AGENT_TASK):
            if "结果]" in user:
                return Reply("分析完成")
            return Reply("".join(f'<tool_call>{{"name": "{t}", "arguments": {{}}}}</tool_call>' for t in ("preprocess", "keyword_extract", "sentiment_analyze")))
        low = user.lower()
        good, bad = (sum(low.count(w) for w in words) for words in (PRAISE, BLAME))
        label = "正向" if good > bad else "负向" if bad > good else "中立"
        confidence = round(0.5 + min(0.49, abs(good - bad) / 10), 2)
        return Reply(f'{{"sentiment": ["{good} / {bad}", "{label}", {confidence}]}}')


def rule_keywords(text: str) -> list[tuple[str, str, float]]:
    low = text.lower()
    return [(reason, w, score) for reason, words, score in (("praise", PRAISE, 0.9), ("blame", BLAME, 0.8)) for w in words if w in low]


def with_retry(call: Callable[[int], Reply], tries: int = ATTEMPTS, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """Repeat a call that failed for a passing reason, with growing and jittered waits; other errors rise at once."""
    for attempt in range(tries + 1):
        try:
            return call(attempt)
        except Exception as error:
            if attempt == tries or not re.search(RETRYABLE, str(error).lower()):
                raise
            sleep(base * 2**attempt + random.uniform(0, 1))
    raise AssertionError("unreachable")


def whole_answer(backend: ModelBackend, system: str, user: str, seed: int) -> Reply:
    """An answer that ended at the length limit is continued once and joined."""
    first = with_retry(lambda k: backend.complete(system, user, seed))
    if first.finish_reason != "length":
        return first
    more = with_retry(lambda k: backend.complete(system, f"{user}\n{first.content}", seed))
    return Reply(first.content + more.content, more.finish_reason, more.tool_calls)


def fill_template(template: Column, **values: Column) -> Column:
    """``{{name}}`` by value; unknown placeholders stay, a null value gives an empty string."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def call_model(df: DataFrame, key: str, system: str, prompt: str, make: Callable[[], ModelBackend] = RuleBackend, seed: int = 42) -> DataFrame:
    """``key, content, finish_reason, error`` for every row. Prompts that are equal cost one call a partition."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, known = make(), {}
        for pdf in frames:
            rows = []
            for k, s, p in zip(pdf[key], pdf[system], pdf[prompt], strict=True):
                if (s, p) not in known:
                    try:
                        known[s, p] = (*whole_answer(backend, s or "", p or "", seed)[:2], None)
                    except Exception as error:  # noqa: BLE001  a row's failure is that row's result
                        known[s, p] = (None, None, str(error)[:500])
                    if len(known) > 10_000:
                        known = {(s, p): known[s, p]}
                rows.append((k, *known[s, p]))
            yield pd.DataFrame(rows, columns=[key, "content", "finish_reason", "error"]).astype({"content": object, "finish_reason": object, "error": object})

    return df.select(key, system, prompt).mapInPandas(run, f"{key} {kind}, content string, finish_reason string, error string")


def keyword_attempts(backend: ModelBackend, system: str, user: str, seed: int = 42, tries: int = ATTEMPTS) -> tuple[str | None, str]:
    """The keyword object of the first attempt that has one, and the text before it; a cut answer is mended first."""
    thinking = ""
    for attempt in range(tries + 1):
        reply = with_retry(lambda k, a=attempt: backend.complete(system, user, seed + a if a >= VARY_FROM else seed))
        found, thinking = extract_with_thinking(reply.content)
        if found is None and reply.finish_reason == "length":
            found = repair_truncated(reply.content)
        if found is not None:
            return found, thinking
    return None, thinking


def sentiment(df: DataFrame, key: str, text: str, make: Callable[[], ModelBackend] = RuleBackend) -> DataFrame:
    """``key, sentiment struct<label, confidence, reasoning>``; a row whose call fails has the label ``unknown``."""
    asked = df.select(key, F.lit(SENTIMENT_TASK).alias("system"), F.col(text).alias("prompt"))
    answered = call_model(asked, key, "system", "prompt", make)

    @F.pandas_udf(SENTIMENT)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([(sentiment_of(x) if isinstance(x, str) else None) or {"label": "unknown", "confidence": 0.0, "reasoning": ""} for x in s], columns=["label", "confidence", "reasoning"], dtype=object)

    return answered.select(key, parse(F.col("content")).alias("sentiment"))
