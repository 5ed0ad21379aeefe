"""Expressions of time and date in text: their deletion, and keywords that are nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals, day parts and words of time and date.
NUMERALS = "零一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两"
DAY_PARTS = "早上 上午 中午 下午 晚上 夜里 凌晨 深夜 早晨 傍晚 黄昏"
FUZZY = "刚才 刚刚 现在 此刻 当前 目前 马上 立刻 立即 立马 即刻 稍后 待会 一会儿 过会 等会 随后 之后 然后 接着 紧接着"
DAYS = "昨天 今天 明天 前天 后天 大前天 大后天 昨日 今日 明日"
KEYWORD_DAYS = "今天 今日 今儿 昨天 昨日 昨儿 明天 明日 明儿 前天 前日 后天 后日"
PERIODS = "上周 本周 下周 这周 上星期 本星期 下星期 这星期 上月 本月 下月 这月 上个月 这个月 下个月 去年 今年 明年 前年 后年"
FREE_DAYS = "工作日 周末 双休"
WEEKDAYS = "一二三四五六日天"

_ZH = f"[{NUMERALS}]+"
_ANY = rf"(?:[{NUMERALS}〇]+|\d+)"

# What is deleted, in this order. Later rules see what earlier ones left.
TIME_RULES = (
    r"\d{1,2}:\d{1,2}(:\d{1,2})?",
    r"(?<!\d)\d{1,2}\.\d{1,2}(\.\d{1,2})?(?!\d)",
    r"\d+\s*点\s*\d+\s*分\s*\d+\s*秒",
    r"\d+\s*点\s*\d+\s*分",
    r"\d+\s*点\s*\d+(?![分秒])",
    r"\d+\s*[点时]\s*钟?",
    r"\d+\s*分\s*钟?",
    r"\d+\s*秒\s*钟?",
    _ZH + r"\s*[点时]\s*钟?",
    _ZH + r"\s*分\s*钟?",
    _ZH + r"\s*秒\s*钟?",
    "[早上中下晚夜凌深][上午里晨间夜]",
)
DATE_RULES = (
    r"\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}[日号]?",
    r"\d{1,2}[-/月.]\d{1,2}[日号]?",
    r"\d+\s*年",
    r"\d+\s*月",
    r"\d+\s*[日号]",
    _ZH + r"\s*年",
    _ZH + r"\s*月",
    _ZH + r"\s*[日号]",
)
CYCLE_RULES = (f"第{_ZH}[天周月年]", r"第\d+[天周月年]", f"{_ZH}[天周月年][前后]", r"\d+[天周月年][前后]", f"[星期周][{WEEKDAYS}]", f"礼拜[{WEEKDAYS}]")


def _delete(c: Column, rules: tuple[str, ...]) -> Column:
    for rule in rules:
        c = F.regexp_replace(c, "(?U)" + rule, "")
    return c


def _delete_words(c: Column, words: str, longest_first: bool) -> Column:
    found = words.split()
    if longest_first:
        return F.regexp_replace(c, "|".join(sorted(found, key=len, reverse=True)), "")
    for word in found:
        c = F.replace(c, F.lit(word), F.lit(""))
    return c


def remove_time_expressions(c: Column, strict: bool = False) -> Column:
    """Rules whose matches an earlier rule has already deleted are left out, as they can't apply.

    Words go one after the other, which leaves the rest of a longer word that holds a shorter one; ``strict`` deletes the
    longest word first.
    """
    return _delete_words(_delete(c, TIME_RULES), FUZZY, strict)


def remove_date_expressions(c: Column, strict: bool = False) -> Column:
    c = _delete_words(_delete(c, DATE_RULES), DAYS, strict)
    c = _delete_words(c, PERIODS, strict)
    rules = tuple("星期" + r[len("[星期周]") :] if strict and r.startswith("[星期周]") else r for r in CYCLE_RULES)
    return _delete(c, rules + ((f"周[{WEEKDAYS}]",) if strict else ()))


def remove_dates(c: Column, strict: bool = False) -> Column:
    """Times first, as one may stand inside a date."""
    return remove_date_expressions(remove_time_expressions(c, strict), strict)


#: A keyword is of time if it holds one of these; longer forms, as an hour with minutes, hold one of them too.
TIME_KEYWORD = "|".join(
    (r"\d{1,2}:\d{1,2}", r"(?<!\d)\d{1,2}\.\d{1,2}(?:\.\d{1,2})?(?!\d)", _ANY + r"\s*[点时分秒]", f"差\\s*[{NUMERALS}〇]+\\s*刻\\s*{_ANY}\\s*[点时]", *DAY_PARTS.split(), *FUZZY.split())
)
DATE_KEYWORD = "|".join(
    (
        _ANY + r"\s*[年月号日]",
        "^[号日]$",
        r"\d{1,2}[./-]\d{1,2}",
        f"(?:周|星期|礼拜)[{WEEKDAYS}]",
        *FREE_DAYS.split(),
        *KEYWORD_DAYS.split(),
        "月[初中末底]",
        "[上中下](?s:.*)旬|旬(?s:.*)[上中下]",
        _ANY + r"\s*季度",
        r"[Qq]\d+",
    )
)


def is_time_keyword(c: Column) -> Column:
    """Null is no keyword of time."""
    return F.coalesce(c.rlike("(?U)" + TIME_KEYWORD), F.lit(False))


def is_date_keyword(c: Column) -> Column:
    return F.coalesce(c.rlike("(?U)" + DATE_KEYWORD.replace("^[号日]$", r"\A[号日]\z")), F.lit(False))


def as_re2(pattern: str) -> str:
    """The same pattern without look-around, for a search in RE2; digits are Unicode's."""
    p = pattern.replace(r"(?<!\d)", r"(?:^|[^\d])").replace(r"(?!\d)", r"(?:$|[^\d])")
    p = re.sub(r"\[\^\\d\]", r"[^\\p{Nd}]", p)
    return p.replace(r"\d", r"\p{Nd}").replace("(?s:.*)", r"[\s\S]*")
