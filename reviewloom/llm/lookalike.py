"""Problem 3: one consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_batches, pick, text_column
from .confusables import table

_PICTURE = r"\p{Extended_Pictographic}[️\U0001F3FB-\U0001F3FF]*"
_EMOJI = rf"{_PICTURE}(?:‍{_PICTURE})*|[0-9#*]️?⃣|\U0001F3F4[\U000E0020-\U000E007F]+"
_HIDDEN = r"[\p{Default_Ignorable_Code_Point}￹-￻[\p{Cc}--[\t\n\r\x0b\x0c\x85]]]"
_INVISIBLE = regex.compile(rf"({_EMOJI})|{_HIDDEN}+", regex.V1)
_SPACE = regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
_BREAK = regex.compile(r"[  \x0b\x0c\x85]")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: A word of any alphabet; Chinese, Japanese and Korean characters don't make words with letters.
_NOT_ALPHABETIC = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}ー々〆"
_WORD = regex.compile(rf"[[\p{{L}}\p{{Nl}}]--[{_NOT_ALPHABETIC}〇]][[\p{{L}}\p{{M}}\p{{Nl}}]--[{_NOT_ALPHABETIC}〇]]*", regex.V1)
_FOREIGN = regex.compile(rf"[[\p{{L}}\p{{Nl}}]--[\p{{Latin}}{_NOT_ALPHABETIC}〇]]|[ɐ-ʯᴀ-ᶿ\p{{Nl}}&&\p{{Latin}}]", regex.V1)
_LATIN = regex.compile(r"\p{Latin}")
#: Texts of these characters only are in the consistent form already; nearly all texts stop here.
_PLAIN = regex.compile(r"[\t\n\r -~一-鿿，。！？；：、…“”‘’（）【】《》—·￥]*")


@lru_cache(maxsize=65536)
def _ordinary(c: str) -> str:
    """The ordinary letter, digit or ideograph that ``c`` is a width, font or radical form of; else ``c``."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind not in ("<wide>", "<narrow>", "<font>", "<compat>"):
        return c
    category = unicodedata.category(c)
    if category[0] == "L" or category == "Nd" or "⺀" <= c <= "⿟":
        return unicodedata.normalize("NFKC", c)
    return c


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def _one_alphabet(word: str, foreign_text: bool = False) -> str:
    """A word that mixes alphabets, written by the letters of one of them that have the same prototypes.

    It is Latin if each of its other letters looks like a Latin one, unless all its Latin letters look like letters of
    the other alphabet, too, and the text has words truly of that (``foreign_text``). Else it is of the alphabet of its
    letters without a look-alike. Phonetic letters count as ordinary ones where they stand among them.
    """
    t = table()
    foreign = [c for c in word if _FOREIGN.match(c)]
    latin = [c for c in word if _LATIN.match(c) and c not in foreign]
    if not latin or not foreign:
        scripts = {_script(c) for c in foreign}
        if {"GREEK", "CYRILLIC"} <= scripts:
            return "".join(t.back["CYRILLIC"].get(t.latin.get(c, ""), c) if _script(c) == "GREEK" else c for c in word)
        return word
    own = [c for c in foreign if c not in t.inside_latin]
    back = t.back.get(_script((own or foreign)[0]), {})
    returns = bool(back) and all(c in back for c in latin)
    if not own and not (foreign_text and returns):
        return "".join(t.inside_latin.get(c, c) for c in word)
    if not back:
        return word
    if own and not returns and len(latin) > len(foreign):
        return "".join(t.latin.get(c, c) for c in word)
    return "".join(back.get(c, c) for c in word)


def consistent_form(text: str) -> str:
    """``text`` in the consistent form. Idempotent; punctuation, symbols and emoji stay; an empty text stays empty."""
    if _PLAIN.fullmatch(text):
        return text
    s = _INVISIBLE.sub(lambda m: m[1] or "", text)
    s = _BREAK.sub("\n", _SPACE.sub(" ", s))
    s = "".join(map(_ordinary, s))
    s = _LETTERS.sub(lambda m: unicodedata.normalize("NFC", m[0]), s)
    if not _FOREIGN.search(s):
        return s
    t = table()
    words = [w for w in _WORD.findall(s) if _FOREIGN.search(w)]
    own = any(_FOREIGN.match(c) and c not in t.latin for w in words if not _LATIN.search(w) for c in w)
    s = _WORD.sub(lambda m: unicodedata.normalize("NFC", _one_alphabet(m[0], own)), s)
    # A word made of look-alikes alone is taken for Latin only where nothing else in the text is truly of its alphabet.
    words = [w for w in _WORD.findall(s) if _FOREIGN.search(w)]
    if words and _LATIN.search(s) and all(c in t.latin for w in words for c in w):
        s = _WORD.sub(lambda m: unicodedata.normalize("NFC", "".join(t.latin.get(c, c) for c in m[0])), s)
    return s


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again: equal for texts that look the same.

    It is the skeleton of the consistent form, so that small letters in the shape of a small capital agree as well.
    """
    s = unicodedata.normalize("NFD", consistent_form(text))
    prototypes = table().prototypes
    return unicodedata.normalize("NFD", "".join(prototypes.get(c, c) for c in s))


def normalized(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record_id, text, consistent, changed``: every value in the consistent form.

    Null text gives null with ``changed`` false; empty text stays empty; repeated rows come out as often as they are.
    Narrow: values pass one Arrow hop and no shuffle.
    """
    rows = pick(df, record_id=record, text=text)
    both = rows.withColumn("source", F.col("text"))
    out = map_batches(both, text_column(consistent_form, "source", "consistent", pa.string()), "record_id bigint, text string, consistent string")
    return out.withColumn("changed", F.coalesce(F.col("text") != F.col("consistent"), F.lit(False)))


def changed_ids(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record_id`` of the values that the consistent form changes; only ids leave the Python side."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array([t is not None and consistent_form(t) != t for t in texts], pa.bool_()))], ["record_id"])

    return map_batches(pick(df, record_id=record, text=text), run, "record_id bigint")


def look_alike_groups(df: DataFrame, record: str, text: str) -> DataFrame:
    """``skeleton_key, variants, records, first_id``: originals grouped by equal skeleton, where they are written in two ways or more."""
    return look_alike_groups_across([(text, df, record, text)]).select("skeleton_key", "variants", "records", "first_id")


def look_alike_groups_across(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``field_name, skeleton_key, variants, records, field_variants, field_records, first_id`` for (field's name, table, record, text) parts.

    Originals of all fields are grouped together by equal skeleton, where they are written in two ways or more, be it in one
    field or across them. A row for each field that holds any of a group: ``variants`` and ``records`` are the whole group's,
    the others that field's, whose ids ``first_id`` is one of. The same text in two fields is one variant. Null texts are in no
    group; repeated rows and null ids count as records.

    Keys are 128-bit digests. Variants are counted after a shuffle by (skeleton, text), so that a text held by a third of
    all rows is one pre-aggregated row a task; the second aggregation sees one row a variant.
    """
    rows = None
    for k, (_, df, record, text) in enumerate(parts):
        part = pick(df, record_id=record, text=text).where(F.col("text").isNotNull()).select("record_id", F.lit(k).alias("field"), "text", F.md5("text").alias("text_key"))
        rows = part if rows is None else rows.unionByName(part)
    keyed = map_batches(rows, text_column(skeleton, "text", "skeleton", pa.string()), "record_id bigint, field int, text_key string, skeleton string")
    fields = range(len(parts))
    held = [F.col("field") == k for k in fields]
    variants = keyed.groupBy(F.md5("skeleton").alias("skeleton_key"), "text_key").agg(
        *[F.count_if(held[k]).alias(f"n{k}") for k in fields], *[F.min(F.when(held[k], F.col("record_id"))).alias(f"first{k}") for k in fields]
    )
    groups = variants.groupBy("skeleton_key").agg(
        F.count("*").alias("variants"),
        *[F.count_if(F.col(f"n{k}") > 0).alias(f"variants{k}") for k in fields],
        *[F.sum(f"n{k}").alias(f"n{k}") for k in fields],
        *[F.min(f"first{k}").alias(f"first{k}") for k in fields],
    )
    by_field = [
        F.struct(F.lit(name).alias("field_name"), F.col(f"variants{k}").alias("field_variants"), F.col(f"n{k}").alias("field_records"), F.col(f"first{k}").alias("first_id"))
        for k, (name, *_) in enumerate(parts)
    ]
    records = sum((F.col(f"n{k}") for k in fields), F.lit(0)).alias("records")
    found = groups.where("variants > 1").select("skeleton_key", "variants", records, F.inline(F.array(*by_field))).where("field_records > 0")
    return found.select("field_name", "skeleton_key", "variants", "records", "field_variants", "field_records", "first_id")
