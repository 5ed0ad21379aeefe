"""JSON in model output: extraction, repair and the shapes it takes.

Strictness matters here: what follows an object makes it no JSON, and the JVM's parsers accept such a tail. So finding and
mending runs on Python's parser, in Arrow batches; reading the found object's fields stays in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

_HEAD = re.compile(r'\{\s*"keywords"\s*:\s*\[')
_ARRAY = re.compile(r'"keywords"\s*:\s*\[')
SENTIMENT_OBJECT = re.compile(r'\{[^{}]*"sentiment"\s*:\s*\[.*?\]\s*\}', re.DOTALL)
SENTIMENT = StructType().add("label", StringType()).add("confidence", DoubleType()).add("reasoning", StringType())
_FULL_WIDTH = str.maketrans("，：", ",:")
# Labels of sentiment in either language.
LABELS = {"正向": "positive", "负向": "negative", "中立": "neutral", "positive": "positive", "negative": "negative", "neutral": "neutral"}


def _valid(s: str) -> bool:
    try:
        json.loads(s)
    except ValueError:
        return False
    return True


def _marks(s: str, start: int = 0) -> Iterator[tuple[int, str]]:
    """Brackets and braces outside of strings, with their places."""
    quoted = skip = False
    for k in range(start, len(s)):
        c = s[k]
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}[]":
            yield k, c


def matching_brace(s: str, start: int) -> int:
    """The place of the brace that closes the one at ``start``; -1 if none does."""
    depth = 0
    for k, c in _marks(s, start):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return k
    return -1


def sanitize(s: str) -> str:
    """Full-width commas and colons become ASCII ones; a keyword list with a broken end is closed after its last whole element."""
    fixed = s.translate(_FULL_WIDTH)
    found = None if _valid(fixed) else _ARRAY.search(fixed)
    if not found:
        return fixed
    depth, begun, good = 0, -1, -1
    for k, c in _marks(fixed, found.end() - 1):
        if c == "[":
            depth += 1
            if depth == 2:
                begun = k
        elif c == "]":
            depth -= 1
            if depth == 1 and begun >= 0:
                good = k if _valid(fixed[begun : k + 1]) else good
                begun = -1
            elif depth == 0:
                break
    if good > 0:
        closed = fixed[: good + 1] + "\n  ]\n}"
        if _valid(closed):
            return closed
    return fixed


def loadable(s: str) -> str | None:
    """The text itself if it is JSON, else its sanitized form if that is, else None."""
    if _valid(s):
        return s
    fixed = sanitize(s)
    return fixed if _valid(fixed) else None


def _braced(raw: str, from_right: bool) -> Iterator[tuple[int, str]]:
    last = raw.rfind("}")
    places = [k for k, c in enumerate(raw) if c == "{"] if last >= 0 else []
    for k in reversed(places) if from_right else places:
        yield k, raw[k : last + 1]


def extract(raw: str | None, pattern: re.Pattern | None = None) -> str | None:
    """The JSON in a model's output: the whole without fences, what the pattern finds, or from a first brace to the last."""
    if raw is None:
        return None
    s = raw.strip()
    if s.startswith("```"):
        s = (s.replace("```json", "") if s.startswith("```json") else s).replace("```", "").strip()
    candidates = [s]
    if pattern and (m := pattern.search(raw)):
        candidates.append(m[0])
    for c in candidates:
        if _valid(c):
            return c
    return next((c for _, c in _braced(raw, False) if _valid(c)), None)


def extract_with_thinking(raw: str | None) -> tuple[str | None, str]:
    """The JSON, mended if need be, and the text before it."""
    if raw is None:
        return None, ""
    s = raw.strip()
    bare = s.removeprefix("```json") if s.startswith("```json") else s.removeprefix("```")
    for c in dict.fromkeys((s, bare.removesuffix("```").strip())):
        if (found := loadable(c)) is not None:
            return found, ""
    if (m := _HEAD.search(raw)) and (end := matching_brace(raw, m.start())) >= 0 and (found := loadable(raw[m.start() : end + 1])) is not None:
        return found, raw[: m.start()].strip()
    for k, c in _braced(raw, True):
        if (found := loadable(c)) is not None:
            return found, raw[:k].strip()
    return None, s


def repair_truncated(raw: str | None) -> str | None:
    """A keyword object that was cut, closed after what is whole of it; None if nothing can be saved."""
    m = _HEAD.search(raw or "")
    if not m:
        return None
    s = raw[m.start() :]
    depth = {"{": 0, "[": 0}
    for _, c in _marks(s):
        if c in depth:
            depth[c] += 1
        else:
            depth["{" if c == "}" else "["] -= 1
    ends = [k for k in range(len(s) - 1, m.end() - m.start() - 1, -1) if s[k] == "]"]
    if "]" not in s:
        tries = [s[: s.rfind("[") + 1] + "]}"]
    else:
        tries = [s[: s.rfind("]") + 1] + "]}"] + [s[: k + 1] + tail for k in ends for tail in ("}", "]}")]
        tries.append(s.rstrip().removesuffix(",") + "]" * max(0, depth["["]) + "}" * max(0, depth["{"]))
    return next((t for t in tries if _valid(t)), None)


def truncate_result(s: str, limit: int = 2048) -> str:
    """A tool's result within ``limit`` characters: a long thinking field is shortened first, as the data matter more."""
    if len(s) <= limit:
        return s
    cut = s[: limit - 20] + '...(截断)"}'
    try:
        found = json.loads(s)
    except ValueError:
        return cut
    inner = found.get("data") if isinstance(found, dict) else None
    if isinstance(inner, dict) and isinstance(inner.get("thinking"), str) and len(inner["thinking"]) > 200:
        for text in (inner["thinking"][:200] + "...(截断)", "(已截断)"):
            inner["thinking"] = text
            shorter = json.dumps(found, ensure_ascii=False)
            if len(shorter) <= limit or text == "(已截断)":
                return shorter
    whole = json.dumps(found, ensure_ascii=False)
    return whole if len(whole) <= limit else cut


def sentiment_of(raw: str | None) -> dict | None:
    """``label, confidence, reasoning`` of a sentiment answer in any of its shapes; None if there is no object."""
    found = extract(raw, SENTIMENT_OBJECT)
    value = json.loads(found) if found else None
    if not isinstance(value, dict):
        return None
    data = value.get("sentiment")
    if isinstance(data, list) and data:
        triple = data[0] if isinstance(data[0], list) else data
        if len(triple) >= 3 and (isinstance(data[0], list | str)):
            return {"label": LABELS.get(str(triple[1]), "neutral"), "confidence": _number(triple[2]), "reasoning": str(triple[0])}
    label = LABELS.get(data, data) if isinstance(data, str) else LABELS.get(str(value.get("label", "neutral")), "neutral")
    return {"label": label, "confidence": _number(value.get("confidence", 0.5)), "reasoning": str(value.get("reasoning") or "")}


def _number(x: object) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.5


@F.pandas_udf(StringType())
def extract_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(extract, na_action="ignore")


@F.pandas_udf(StringType())
def repair_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(repair_truncated, na_action="ignore")


@F.pandas_udf(StructType().add("json", StringType()).add("thinking", StringType()))
def _with_thinking(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([extract_with_thinking(x if isinstance(x, str) else None) for x in s], columns=["json", "thinking"], dtype=object)


@F.pandas_udf(SENTIMENT)
def parse_sentiment(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        found = [sentiment_of(x if isinstance(x, str) else None) or {} for x in s]
        yield pd.DataFrame(found, columns=["label", "confidence", "reasoning"], index=range(len(found)), dtype=object)


@F.pandas_udf(StringType())
def shorten_result(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(truncate_result, na_action="ignore")


def keyword_object(raw: Column) -> Column:
    """``STRUCT<json, thinking>`` in one Arrow hop."""
    return _with_thinking(raw)


def tool_calls(content: Column) -> Column:
    """Inline tool calls ``<tool_call>{...}</tool_call>`` as ``array<struct<name, arguments>>``; broken ones are dropped."""
    parts = F.regexp_extract_all(content, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    calls = F.transform(parts, lambda p: F.struct(F.get_json_object(p, "$.name").alias("name"), F.coalesce(F.get_json_object(p, "$.arguments"), F.lit("{}")).alias("arguments")))
    return F.filter(calls, lambda c: F.coalesce(c["name"] != "", F.lit(False)))


def without_tool_calls(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, r"(?s)<tool_call>\s*\{.*?\}\s*</tool_call>", ""))


def result_blocks(content: Column) -> Column:
    """The objects of ``[工具 X 结果]`` blocks as ``array<struct<tool, result>>``."""
    block = r"(?s)\[工具 ([^\]\s]+) 结果\]\n(\{.*?\})(?=\n\[工具 |\s*\z)"
    names = F.regexp_extract_all(content, F.lit(block), F.lit(1))
    bodies = F.regexp_extract_all(content, F.lit(block), F.lit(2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("tool"), b.alias("result")))


def keyword_list(found: Column) -> Column:
    """The keyword lists of an object, ``关键词`` before ``keywords``, as ``array<variant>``; empty if it has none."""
    value = F.try_parse_json(found)
    lists = F.coalesce(F.try_variant_get(value, "$['关键词']", "array<variant>"), F.try_variant_get(value, "$.keywords", "array<variant>"))
    return F.coalesce(lists, F.array().cast("array<variant>"))
