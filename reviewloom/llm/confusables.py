"""The public table of characters that look alike, read from the Unicode data that comes with Spark's own ICU library.

Nothing of it is in the repository. The driver reads it once and tasks get it as a broadcast of about 100 kB, a fixed size.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from typing import NamedTuple

import numpy as np
from pyspark import find_spark_home
from pyspark.sql import SparkSession

ENTRY = "com/ibm/icu/impl/data/icudata/confusables.cfu"
MAGIC = 0x3845FDEF


def read_prototypes(jar: str | None = None) -> dict[str, str]:
    """Each character that looks like another, with its prototype of one or more characters.

    The file has a header, then sorted keys (a code point and, above it, the prototype's length less one), a value for each
    (the prototype itself, or its place in a string), and that string, all in big-endian order.
    """
    jar = jar or sorted(glob.glob(os.path.join(find_spark_home._find_spark_home(), "jars", "icu4j-*.jar")))[-1]
    with zipfile.ZipFile(jar) as z:
        raw = z.read(ENTRY)
    data = raw[struct.unpack(">H", raw[:2])[0] :]
    magic, _, _, keys_at, keys, values_at, values, text_at, text_size = struct.unpack(">9I", data[:36])
    if magic != MAGIC or keys != values:
        raise ValueError(f"{jar} has no table of confusables in the known form")
    codes, places = np.frombuffer(data, ">u4", keys, keys_at).tolist(), np.frombuffer(data, ">u2", keys, values_at).tolist()
    text = data[text_at : text_at + 2 * text_size]
    found = {}
    for code, place in zip(codes, places, strict=True):
        units = (code >> 24) + 1
        found[chr(code & 0xFFFFFF)] = chr(place) if units == 1 else text[2 * place : 2 * (place + units)].decode("utf-16-be")
    return found


class Alphabets(NamedTuple):
    """The prototypes, and what follows from them for words that mix alphabets."""

    prototypes: dict[str, str]
    #: Letters beside ASCII's that have an ASCII letter's prototype, with that letter.
    latin: dict[str, str]
    #: The same, with small letters whose capital looks like a Latin capital: inside a Latin word they stand for it.
    inside_latin: dict[str, str]
    #: By alphabet: ASCII letters, with the letter of that alphabet that looks like them.
    back: dict[str, dict[str, str]]


#: The letters of the two alphabets that Latin look-alikes are turned back into: the common ones, the first by preference.
_OWN = {"CYRILLIC": [*range(0x410, 0x450), *range(0x400, 0x410), *range(0x450, 0x460)], "GREEK": range(0x391, 0x3CA)}


def alphabets(prototypes: dict[str, str]) -> Alphabets:
    ascii_letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    by_prototype: dict[str, list[str]] = {}
    for c in ascii_letters:
        by_prototype.setdefault(prototypes.get(c, c), []).append(c)

    def as_ascii(c: str) -> str | None:
        same = by_prototype.get(prototypes.get(c, ""), ())
        # Capital I and small l have one prototype; the letter's own case tells which is meant.
        return next((x for x in same if x.isupper() == c.isupper()), same[0] if same else None)

    letters = [c for c in prototypes if not c.isascii() and (c.isalpha() or unicodedata.category(c) == "Nl")]
    latin = {c: x for c in letters if (x := as_ascii(c))}
    inside = dict(latin)
    # Every letter that changes case with one of these, and every capital of theirs, as a small capital has its shape.
    for c in {x for k in latin for x in (k.lower(), k.upper()) if len(x) == 1} - set(latin):
        known = latin.get(c.upper()) if c.islower() else latin.get(c.lower())
        if known:
            inside[c] = known.lower() if c.islower() else known.upper()
    back: dict[str, dict[str, str]] = {}
    for name, codes in _OWN.items():
        back[name] = {}
        for c in map(chr, codes):
            if c in latin and unicodedata.name(c, "").startswith(name):
                back[name].setdefault(latin[c], c)
    return Alphabets(prototypes, latin, inside, back)


_known: Alphabets | None = None


def table() -> Alphabets:
    """The process's table: in a task what the driver sent, else what this machine's Spark carries."""
    global _known
    if _known is None:
        _known = alphabets(read_prototypes())
    return _known


def install(prototypes: dict[str, str]) -> None:
    global _known
    if _known is None:
        _known = alphabets(prototypes)


def shared(spark: SparkSession):
    """The broadcast of the prototypes, made once a context."""
    context = spark.sparkContext
    if getattr(context, "_reviewloom_confusables", None) is None:
        context._reviewloom_confusables = context.broadcast(table().prototypes)
    return context._reviewloom_confusables
