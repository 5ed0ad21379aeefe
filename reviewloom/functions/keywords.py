"""Predicates and array expressions over keywords, and their alignment with the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timex import is_date_keyword, is_time_keyword

# Words that are no keywords.
STOPWORDS = (
    "啥 咋 嘛 呗 哈 哦 嗯 呃 额 觉得 感觉 好像 似乎 可能 也许 大概 应该 东西 东东 这个 那个 什么 怎么 哪个 如何 很 非常 特别 十分 极其 相当 比较 有点 时候 时间 "
    "现在 以前 之前 以后 后来 一会 方面 问题 情况 事情 地方 不是 等 到 月 半多 平时 超级 看着 得起 还 元 你们 他们 我们 买个 这说 又 没多 用时 深深"
).split()
MAX_LENGTH, TOP_N, SPAN_RATIO = 6, 8, 2
KEYWORDS = "array<struct<reasoning:string,keyword:string,score:double>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used; lambdas would compute it anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_filled(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def has_latin(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def is_stopword(c: Column, words: list[str] | None = None) -> Column:
    return c.isin(STOPWORDS if words is None else words)


def contains_stopword(c: Column, words: list[str] | None = None) -> Column:
    found = STOPWORDS if words is None else words
    return c.rlike("|".join(rf"\Q{w}\E" for w in found)) if found else F.lit(False)


def min_span(keyword: Column, text: Column) -> Column:
    """The length of the shortest window of ``text`` that holds the keyword's characters in order; -1 if there is none.

    From every place of the first character the others are taken at their next place; spaces in the keyword don't count.
    A keyword that stands in the text as it is needs no search, as no window is shorter, and one with a character that the
    text lacks has none; only for others the text is split into characters, once.
    """
    kw = F.replace(keyword, F.lit(" "), F.lit(""))
    size = F.length(kw)
    others = F.transform(F.sequence(F.lit(2), size), lambda k: F.substr(kw, k, F.lit(1)))
    first = F.substr(kw, F.lit(1), F.lit(1))
    places = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == first, i + 1)), lambda p: p.isNotNull())
    last = F.transform(places, lambda s: F.struct(s.alias("s"), F.aggregate(others, s, lambda p, c: F.when(p == 0, 0).otherwise(F.call_function("locate", c, text, p + 1))).alias("e")))
    spans = F.transform(F.filter(last, lambda x: x["e"] > 0), lambda x: x["e"] - x["s"] + 1)
    lacking = F.exists(others, lambda c: ~text.contains(c))
    return F.when((size == 0) | (F.length(text) == 0), -1).when(text.contains(kw), size).when((size == 1) | ~text.contains(first) | lacking, -1).otherwise(F.coalesce(F.array_min(spans), F.lit(-1)))


def is_aligned(keyword: Column, text: Column, ratio: int = SPAN_RATIO) -> Column:
    """Whether the keyword's characters stand close together and in order; false for an empty keyword or text."""
    most = F.length(F.replace(keyword, F.lit(" "), F.lit(""))) * ratio
    return let(min_span(keyword, text), lambda span: (span >= 0) & (span <= most))


def minimum_keywords(text: Column) -> Column:
    """How many keywords a text of this length should have."""
    size = F.length(text)
    return F.when(size < 20, 2).when(size < 60, 5).when(size < 120, 8).otherwise(10)


def route(text: Column) -> Column:
    return F.when(F.length(text) < 30, "fast").otherwise("agent")


def short_prompt(text: Column) -> Column:
    return F.length(strip(text)) < 10


def indexed(ks: Column) -> Column:
    return F.transform(ks, lambda k, i: F.struct(k["reasoning"].alias("reasoning"), k["keyword"].alias("keyword"), k["score"].alias("score"), i.alias("place")))


def by_score(ks: Column) -> Column:
    """Highest score first; equal scores keep their order; a missing score counts as 0. One sort on a struct, no comparator."""
    keyed = F.transform(ks, lambda k, i: F.struct((-F.coalesce(k["score"], F.lit(0.0))).alias("a"), i.alias("b"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda x: x["k"])


def distinct_keywords(ks: Column) -> Column:
    """The first of equal keywords stays."""
    named = F.struct(ks.alias("ks"), F.transform(ks, lambda k: k["keyword"]).alias("names"))
    return let(named, lambda x: F.filter(x["ks"], lambda k, i: F.array_position(x["names"], k["keyword"]) == i + 1))


def normalize_keywords(raw: Column, old_format: bool = False) -> Column:
    """Positional ``array<variant>`` lists to keyword structs.

    New form: (reasoning, keyword, score) or (keyword, score). Old form: (keyword, score, reason). The keyword must be a
    string; a score that isn't a number is 0.5; lists of other lengths are dropped.
    """

    def one(v):
        items = F.try_variant_get(v, "$", "array<variant>")
        n = F.size(items)
        at = lambda k, kind: F.try_variant_get(v, f"$[{k}]", kind)
        text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$[{k}]", "variant")) == "STRING", at(k, "string"))
        score = lambda k: F.coalesce(at(k, "double"), F.lit(0.5))
        make = lambda r, k, s: F.struct(r.alias("reasoning"), k.alias("keyword"), s.alias("score"))
        if old_format:
            return F.when(n >= 2, make(F.coalesce(at(2, "string"), F.lit("")), text(0), score(1)))
        return F.when(n == 3, make(F.coalesce(at(0, "string"), F.lit("")), text(1), score(2))).when(n == 2, make(F.lit(""), text(0), score(1)))

    return F.filter(F.transform(raw, one), lambda k: k.isNotNull() & k["keyword"].isNotNull())


def post_process(ks: Column, text: Column, top_n: int = TOP_N, max_length: int = MAX_LENGTH, min_score: float | None = None, latin: bool = True, stopwords: list[str] | None = None, contained: bool = False, times: bool = True, dates: bool = True, aligned: bool = True) -> Column:
    """The keyword pipeline, in its fixed order: filled, by score, distinct, score, letters, stopwords, time, date, length, alignment, top N.

    ``latin`` keeps keywords with Latin letters; ``contained`` also drops those that hold a stopword. An empty text passes
    all keywords through the alignment; ``top_n`` or ``max_length`` 0 means no limit. Null keywords give null.
    """
    ks = distinct_keywords(by_score(F.filter(ks, lambda k: is_filled(k["keyword"]))))

    def good(k):
        c, keep = k["keyword"], F.lit(True)
        if min_score is not None:
            keep = keep & F.coalesce(k["score"] >= min_score, F.lit(False))
        if not latin:
            keep = keep & ~has_latin(c)
        if stopwords is None or stopwords:
            keep = keep & ~is_stopword(c, stopwords)
        if contained:
            keep = keep & ~contains_stopword(c, stopwords)
        if times:
            keep = keep & ~is_time_keyword(c)
        if dates:
            keep = keep & ~is_date_keyword(c)
        if max_length > 0:
            keep = keep & (F.length(c) <= max_length)
        if aligned:
            keep = keep & ((F.coalesce(text, F.lit("")) == "") | is_aligned(c, text))
        return keep

    ks = F.filter(ks, good)
    return F.slice(ks, 1, top_n) if top_n > 0 else ks


def validate(ks: Column, text: Column, max_length: int = MAX_LENGTH, stopwords: list[str] | None = None) -> Column:
    """``STRUCT<valid_keywords, removed_keywords array<struct<keyword, reason>>>``: the first reason that applies.

    In order: blank, duplicate, too_long, time, date, stopword, not_in_text. Kept keywords stay in their order.
    """
    def reason(names, k, i):
        c = k["keyword"]
        test = F.when(~is_filled(c), "blank").when(F.array_position(names, c) < i + 1, "duplicate").when(F.length(c) > max_length, "too_long")
        test = test.when(is_time_keyword(c), "time").when(is_date_keyword(c), "date").when(is_stopword(c, stopwords), "stopword")
        return F.struct(k.alias("k"), test.when((F.coalesce(text, F.lit("")) != "") & ~is_aligned(c, text), "not_in_text").alias("reason"))

    def parts(judged):
        kept = F.transform(F.filter(judged, lambda x: x["reason"].isNull()), lambda x: x["k"])
        removed = F.transform(F.filter(judged, lambda x: x["reason"].isNotNull()), lambda x: F.struct(x["k"]["keyword"].alias("keyword"), x["reason"].alias("reason")))
        return F.struct(kept.alias("valid_keywords"), removed.alias("removed_keywords"), F.size(kept).alias("valid_count"), F.size(removed).alias("removed_count"))

    judged = let(F.transform(ks, lambda k: k["keyword"]), lambda names: F.transform(ks, lambda k, i: reason(names, k, i)))
    return let(judged, parts)


def split_by_score(ks: Column, threshold: float = 0.7) -> Column:
    """``STRUCT<kept, removed>``; a missing score counts as 1."""
    high = lambda k: F.coalesce(k["score"], F.lit(1.0)) >= threshold
    return F.struct(F.filter(ks, high).alias("kept"), F.filter(ks, lambda k: ~high(k)).alias("removed"))


# Parts of error messages worth another try, and of those of a full context.
RETRYABLE = "rate limit|429|502|503|529|overloaded|service unavailable|connection|timeout|timed out"
CONTEXT_FULL = "maximum context length|max_model_len|context length|too many tokens|token limit"


def is_retryable(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(RETRYABLE), F.lit(False))


def is_context_full(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(CONTEXT_FULL), F.lit(False))


# Parts of addresses of public model services, and of this machine or a private network.
CLOUD_HOSTS = ("api.openai.com", "api.anthropic.com", "api.deepseek.com", "dashscope.aliyuncs.com", "api.moonshot.cn", "api.siliconflow.cn", "api.zhipuai.cn", "open.bigmodel.cn")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "192.168.", "10.")


def backend_of(url: Column) -> Column:
    """``offline``, ``cloud_api`` or ``local_model``: public services first, then local addresses, then any web address."""
    low = F.lower(F.coalesce(url, F.lit("")))
    holds = lambda parts: low.rlike("|".join(rf"\Q{p}\E" for p in parts))
    test = F.when(strip(low).isin("", "none", "offline"), "offline").when(holds(CLOUD_HOSTS), "cloud_api").when(holds(LOCAL_HOSTS), "local_model")
    return test.when(low.rlike("^https?://"), "cloud_api").otherwise("local_model")
