"""Text cleaning as column expressions: every function maps a string column to a string column, null to null.

All of them stay in the JVM and fuse into one projection. Classes are Unicode-aware where the reference semantics are, so
``(?U)`` stands before every use of ``\\d``, ``\\s``, ``\\S`` and ``\\b``.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code point ranges of emoji, and of symbol blocks, that cleaning deletes.
EMOJI_RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x1F000, 0x1F02F), (0x1F0A0, 0x1F0FF))
SYMBOL_RANGES = ((0x2190, 0x21FF), (0x2200, 0x22FF), (0x2300, 0x23FF), (0x2500, 0x257F), (0x2580, 0x259F), (0x25A0, 0x25FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x2B00, 0x2BFF), (0x20A0, 0x20CF))
# Single symbols, mojibake words, and invisible or private characters that cleaning deletes.
SYMBOLS = "™®©§¶†‡•◦‣"
ZERO_WIDTH = "​‌‍﻿⁠"
MOJIBAKE = ("锟斤拷", "烫烫烫", "屯屯屯", "�")
GARBLED_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x200E, 0x200F), (0x202A, 0x202E), (0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
# The punctuation whose runs collapse, and the Chinese punctuation that the Chinese-only filter keeps.
COLLAPSED = "!！？?。.，,、；;：:\"'（）()【】[]《》<>…~～@#￥$%^&*_+-=｜|/\\"
CHINESE_PUNCTUATION = "，。！？；：\"（）【】《》、…—·"
# Entities of the built-in form of unescaping.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&#39;": "'", "&amp;": "&"}
LINE_BREAKS = "\r\n\t\x0b\x0c"


def ranges(pairs) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in pairs)


def escaped(chars: str) -> str:
    """The characters for use inside a Java or RE2 character class."""
    return "".join("\\" + c if c in "\\[]^-&~" else c for c in chars)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+|ftp://\S+", ""), r"(?U)www\.\S+", "")


def remove_emails(c: Column) -> Column:
    """Word boundaries are Unicode's, so an address glued to a Chinese character stays."""
    return F.regexp_replace(c, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "")


def remove_phone_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)1[3-9]\d{9}", "")


def remove_emojis(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ranges(EMOJI_RANGES)}]+", "")


def remove_garbled(c: Column) -> Column:
    """Zero-width characters go first, so that a mojibake word split by one is still found."""
    words = F.regexp_replace(F.translate(c, ZERO_WIDTH, ""), "|".join(MOJIBAKE), "")
    return F.regexp_replace(words, f"[{ranges(GARBLED_RANGES)}]", "")


def remove_special_symbols(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, f"[{ranges(SYMBOL_RANGES)}]", ""), SYMBOLS, "")


def normalize_numbers(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def remove_line_breaks(c: Column) -> Column:
    """Deletes breaks and tabs; words on both sides are joined."""
    return F.translate(c, LINE_BREAKS, "")


def keep_chinese_only(c: Column, numbers: bool = True, punctuation: bool = True) -> Column:
    kept = r"\x{4E00}-\x{9FFF} " + (escaped(CHINESE_PUNCTUATION) if punctuation else "") + (r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒" if numbers else "")
    return F.regexp_replace(c, f"[^{kept}]", "")


def unescape_entities(c: Column) -> Column:
    """The entities of ``ENTITIES``, ampersands last; tags stay. JVM-side; ``unescape_html`` knows every entity."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(StringType())
def unescape_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


def remove_latin(c: Column) -> Column:
    return F.regexp_replace(c, "[a-zA-Z]+", "")


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", "")


def collapse_punctuation(c: Column) -> Column:
    """A run of one punctuation mark becomes a single one."""
    return F.regexp_replace(c, f"([{escaped(COLLAPSED)}])\\1+", "$1")


def collapse_chinese_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"([{escaped(CHINESE_PUNCTUATION)}])\\1+", "$1")


def squeeze_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def truncate(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def clean_text(c: Column, latin: bool = True, punctuation: bool = True, entities: bool = True, space: bool = True, control: bool = True) -> Column:
    """Each flag turns one step on; ``latin`` deletes Latin letters."""
    for wanted, step in ((entities, unescape_entities), (latin, remove_latin), (control, remove_control), (punctuation, collapse_punctuation), (space, squeeze_space)):
        c = step(c) if wanted else c
    return c


def preprocess_comment(c: Column, latin: bool = True, dates: bool = True, chinese_only: bool = True, max_length: int | None = None, strict: bool = False) -> Column:
    """Line breaks, dates, then the Chinese-only filter or ``clean_text``, runs, space and length.

    With ``strict`` runs of Chinese punctuation collapse in the Chinese-only form too; the reference leaves them.
    """
    from .timex import remove_dates

    c = remove_line_breaks(c)
    c = remove_dates(c) if dates else c
    c = keep_chinese_only(c) if chinese_only else collapse_punctuation(clean_text(c, latin=latin))
    c = collapse_chinese_punctuation(c) if chinese_only and strict else c
    c = squeeze_space(c)
    return truncate(c, max_length) if max_length else c


def advanced_preprocess(c: Column) -> Column:
    for step in (remove_garbled, remove_urls, remove_emails, remove_phone_numbers, remove_emojis, remove_special_symbols, normalize_numbers):
        c = step(c)
    return c


def preprocess_tool(c: Column, max_length: int = 512, strict: bool = False) -> Column:
    """The cleaning tool: letters and dates stay. In ``strict`` mode links go before runs collapse, and space is squeezed last."""
    c = remove_urls(c) if strict else c
    c = advanced_preprocess(preprocess_comment(c, latin=False, dates=False, chinese_only=False, max_length=max_length))
    return squeeze_space(c) if strict else c


def preprocess_result(c: Column, strict: bool = False) -> Column:
    """``STRUCT<success, cleaned_text, original_length, cleaned_length, error>``; blank and null texts fail."""
    blank = c.isNull() | (squeeze_space(c) == "")
    parts = lambda cleaned: F.struct((~blank).alias("success"), cleaned.alias("cleaned_text"), F.length(c).alias("original_length"), F.length(cleaned).alias("cleaned_length"), F.when(blank, "empty text").alias("error"))
    # The cleaned text is computed once for both of its uses.
    return F.element_at(F.transform(F.array(F.when(~blank, preprocess_tool(c, strict=strict))), parts), 1)
