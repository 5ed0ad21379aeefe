"""Problem 1: records that are the same but for spacing, case, punctuation or the order of their labelled sections."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import map_batches, pick
from .confusables import table
from .lookalike import _FOREIGN, consistent_form

#: A key is hot from this number of rows on: so many ids and keys, 24 bytes each, are one task's at most.
HOT_LEAST = 100_000
#: There are never more hot keys than this, whose table is broadcast (about 50 MB); beyond 10^11 rows the limit rises.
HOT_KEYS = 1_000_000
SALTS = 64

#: Signs that say something: a decimal point, a number's sign, per cent and degree, a plus or number sign after a letter
#: (C++, C#), currencies, and pictures. All other signs, spaces and invisible characters are formatting.
_SAYING = r"(?<=\d)[.](?=\d)|(?<![\p{L}\p{N}\p{M}\-−+])[\-−+±](?=\d)|(?<=[\p{L}\p{N}+])\+|(?<=\p{Latin})#|(?<=\d ?)[%‰°]|\p{Sc}|[\p{So}&&\p{Extended_Pictographic}]|[\U0001F1E6-\U0001F1FF]"
_FORMATTING = regex.compile(rf"(?:(?!{_SAYING})[^\p{{L}}\p{{N}}\p{{M}}]|\p{{Default_Ignorable_Code_Point}})+", regex.V1)
#: All signs, for texts without any that may say something.
_SIGNS = regex.compile(r"(?:[^\p{L}\p{N}\p{M}]|\p{Default_Ignorable_Code_Point})+")
_MAY_SAY = regex.compile(r"[.\-−+±#%‰°\p{Sc}\p{Extended_Pictographic}\U0001F1E6-\U0001F1FF]")
_ALIKE = str.maketrans("−￥﹩＄", "-¥$$")
_LABEL = r"(\p{L}[\p{L}\p{M}\p{N}_ ]{0,23}?)"
_BRACKETED = regex.compile(rf"[【\[]\s*{_LABEL}\s*[】\]]\s*[:：]?")
#: A label stands at the start of a line or after a separator, and is followed by a colon, an equals sign or a dash between spaces.
_MARKED = regex.compile(rf"(?:(?<![^\n;；/|,，。.、!！])|(?<=[;；/|,，。.、!！\n]\s+)|\A\s*)[*#•·>\-]*\s*{_LABEL}\s*(?:[:：=]|\s[-–—]\s)")
_GAP = regex.compile(r"(?<=\p{Han})[^\S\n]+(?=\p{Han})")


_ANY_LABEL = regex.compile(r"[:：=\]】]|\s[-–—]\s")


def _plain(text: str) -> str:
    """Letters and digits in lower case with look-alikes on their prototypes, and the signs that say something."""
    if _MAY_SAY.search(text):
        plain = _FORMATTING.sub("", text).lower().translate(_ALIKE)
    else:
        plain = _SIGNS.sub("", text).lower()
    if plain.isascii() or not _FOREIGN.search(plain):
        return plain
    inside = table().inside_latin
    return "".join(inside.get(c, c) for c in plain)


def _flat(value: object) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else "" if value is None else str(value)


def sections(text: str) -> list[tuple[str, str]] | None:
    """The labelled sections that make up the whole of ``text``, or None. JSON objects, bracketed and marked labels."""
    if not _ANY_LABEL.search(text):
        return None
    s = text.strip()
    if s[:1] == "{" and s[-1:] == "}":
        try:
            found = json.loads(s)
        except ValueError:
            found = None
        if isinstance(found, dict) and len(found) > 1:
            return [(k, _flat(v)) for k, v in found.items()]
    s = _GAP.sub("", s)
    for pattern in (_BRACKETED, _MARKED) if "】" in s or "]" in s else (_MARKED,):
        marks = list(pattern.finditer(s))
        if len(marks) > 1 and not _plain(s[: marks[0].start()]):
            ends = [m.start() for m in marks[1:]] + [len(s)]
            return [(m[1], s[m.end() : e]) for m, e in zip(marks, ends, strict=True)]
    return None


def canonical(text: str) -> str:
    """Equal for two texts exactly if they are the same record but for formatting.

    Labelled texts give their sorted sections, other texts their letters and digits; a text without any gives itself.
    """
    s = consistent_form(text)
    found = sections(s)
    if found:
        parts = sorted(f"{_plain(k)}\x1f{_plain(v)}" for k, v in found)
        if all(not p.startswith("\x1f") for p in parts):
            return "\x1e".join(parts)
    plain = _plain(s)
    return plain or "\x1d" + s


def keyed(df: DataFrame, record: str, text: str) -> DataFrame:
    """``id, copy_key``: a 128-bit digest of the canonical text; rows with null id or text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(canonical(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["id", "copy_key"])

    rows = pick(df, id=record, text=text).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return map_batches(rows, run, "id bigint, copy_key binary")


def copy_groups(df: DataFrame, record: str, text: str) -> DataFrame:
    """``id, first_id, copies`` for every row with text: its group's smallest id and its group's number of distinct ids.

    A row given twice counts once. Null texts are in no group; empty texts and texts of signs alone group when equal.

    Hot keys are found exactly, from counts that every task adds up before the shuffle. Only they are aggregated in two
    levels, over salts, and their few results are broadcast back (at most HOT_KEYS rows); all other keys take one
    shuffle, in which no group is larger than the hot limit.
    """
    rows = cut_lineage(keyed(df, record, text))
    counts = rows.groupBy("copy_key").agg(F.count("*").alias("n"))
    limit = max(HOT_LEAST, rows.count() // HOT_KEYS)
    hot = cut_lineage(counts.where(F.col("n") > limit).select("copy_key"))
    within = Window.partitionBy("copy_key")
    if not hot.count():
        return _small(rows, within)
    cold = _small(rows.join(F.broadcast(hot), "copy_key", "left_anti"), within)
    warm = rows.join(F.broadcast(hot), "copy_key", "left_semi")
    salted = warm.groupBy("copy_key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id").agg(F.lit(1).alias("one")).groupBy("copy_key", "salt").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    firsts = salted.groupBy("copy_key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    members = warm.join(F.broadcast(firsts), "copy_key").select("id", "first_id", "copies").groupBy("id").agg(F.min("first_id").alias("first_id"), F.max("copies").alias("copies"))
    return cold.unionByName(members)


def _small(rows: DataFrame, within) -> DataFrame:
    once = rows.repartition("copy_key").groupBy("copy_key", "id").agg(F.lit(1).alias("one"))
    return once.select("id", F.min("id").over(within).alias("first_id"), F.count("*").over(within).alias("copies"))
