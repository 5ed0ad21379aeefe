"""Problem 4: text cut off by field limits, by a backward character n-gram model of where texts may end."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import map_batches, pick
from .lookalike import consistent_form
from .structure import DECISIVE, is_shell, open_structure

#: Lengths of the contexts, in characters before the position.
ORDERS = (1, 2, 3, 4, 6, 9)
#: Up to so many contexts of open ends are sent to the tasks that count, 16 MB; beyond it they count all and the ends are joined.
CONTEXTS = 2_000_000
#: Up to so many open ends and their contexts are broadcast to be looked up; beyond it the same comes by shuffle.
MAX_BROADCAST_ENDS = 500_000
#: Contexts seen less often than this in all say no more than shorter ones.
LEAST_SEEN = 4
#: A task adds up so many counters before it sends them.
LOCAL_COUNTERS = 1 << 21

#: Sources whose limits are broadcast; each is one short row.
MAX_BROADCAST_SOURCES = 100_000

_ENDS = "。！？!?.…;；\n”\"』」"
_PAUSES = "，,、:：/-—【"
_CUT_MARK = regex.compile(r"(?:(?:…+|\.{2,})\s*(?:[\[(（【]?\s*(?:展开|更多|全文|查看全文|查看更多|阅读全文|more|read more|see more|show more|continue reading|truncated)\s*[\])）】]?)|[\[(（【]\s*(?:truncated|cut|more|未完|未完待续|截断)\s*[\])）】])\s*$", regex.I)
#: A broken character, or a broken escape, tag or entity, at the very end.
_BROKEN = regex.compile("(?:[\ufffd\u200d]|" + r"\\(?:u[0-9A-Fa-f]{0,3})?|<[/!]?[A-Za-z]{0,10}|&(?:#\d{0,5}|amp?|lt?|gt?|quo?t?|nbs?p?)?" + r")\s*$")
_SINGLE_ELLIPSIS = regex.compile(r"(?<![….。])…\s*$")
_TERMINAL = frozenset("。！？!?.…”’\"'』」）)》】]}`~～\ufe0f")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\U0001F3FB-\U0001F3FF]")
_PAUSED = frozenset("，,、；;：:-—/（(“‘【[《<「『@#")
_SUSPECT, _MARKS = frozenset("\\<&"), frozenset("….[(（【")
_FULL_STOPS = tuple("。！？!?.")
_BLANKS = " \t\n\r\u3000\xa0\u200b\ufeff"
_SPACES = re.compile(r"(?<=[一-鿿])\s+(?=[一-鿿，。！？；：、…])|(?<=[，。！？；：、…])[^\S\n]+")
_CODE = re.compile(r"(?<![a-z])([a-z]{0,4})-?(\d+)")
_RUN = re.compile(r"[^\S\n]+")
_BREAKS = re.compile(r"\s*\n\s*")
_WHITE = re.compile(r"\s")

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _code(m: re.Match) -> str:
    return chr(0xE100 + 16 * min(len(m[1]), 15) + min(len(m[2]), 15)) if m[1] else chr(0xE000 + min(len(m[2]), 63))


def plain(text: str) -> str:
    """The form the model reads: consistent characters, lower case, white space squeezed.

    A number or a code of letters and digits becomes one character that keeps only its lengths, so that a number cut short
    is another context than a whole one.
    """
    s = consistent_form(text).strip().lower()
    if _WHITE.search(s):
        s = _BREAKS.sub("\n", _RUN.sub(" ", _SPACES.sub("", s)))
    return _CODE.sub(_code, s)


def _hashes(codes: np.ndarray, place: int) -> np.ndarray:
    """A key for the context of ``ORDERS[place]`` characters that ends at each position; its lowest two bits are free."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(ORDERS[place] - 1, -1, -1):
        shifted = np.zeros_like(codes)
        shifted[k:] = codes[: len(codes) - k] if k else codes
        h = (h ^ shifted) * _STEP
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(6)) << np.uint64(5)).astype(np.int64) | (place << 2)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys, added up; the keys in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


_KINDS = np.zeros(0x110000, np.int8)  # 0 letter or digit, 1 end, 2 pause, 3 space; by code point
for _c in range(0x110000):
    if _c < 0x80 and not chr(_c).isalnum():
        _KINDS[_c] = 1
for _c in _ENDS:
    _KINDS[ord(_c)] = 1
for _c in _PAUSES + "（(《<‘'“":
    _KINDS[ord(_c)] = 2
_KINDS[ord("'")] = 0
_KINDS[ord("-")] = 2
_KINDS[0x2190:0x2C00] = 1
_KINDS[0x1F000:0x1FB00] = 1
_KINDS[ord(" ")] = 3


class Wanted:
    """A set of contexts to count, with a table of bits that tells most others apart at once."""

    def __init__(self, contexts: np.ndarray) -> None:
        self.contexts = np.sort(contexts)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._place(contexts)] = True

    def _place(self, contexts: np.ndarray) -> np.ndarray:
        return (contexts >> 5) & (len(self.bits) - 1)

    def holds(self, contexts: np.ndarray) -> np.ndarray:
        found = self.bits[self._place(contexts)]
        some = contexts[found]
        if len(some):
            at = np.minimum(np.searchsorted(self.contexts, some), len(self.contexts) - 1)
            found[found] = self.contexts[at] == some
        return found


def count_contexts(texts: list[str], wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, counts)``: how often each context is followed by a letter (key + 0), an end (+ 1) or a pause (+ 2).

    Every position counts but the last of each text; with ``wanted``, contexts outside of it are left out.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(texts), 4000):
        joined = "".join(f"\x00{t}\x03" for t in texts[start : start + 4000])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        kinds = _KINDS[codes.astype(np.int64)]
        following = np.r_[kinds[1:], 0]
        space = following == 3
        following[space] = np.r_[kinds[2:], 0, 0][space]
        following[following == 3] = 0
        last = np.r_[codes[1:] == 3, True]  # nothing is known about what would follow a text's last character
        begun = codes == 0
        since = np.arange(len(codes)) - np.maximum.accumulate(np.where(begun, np.arange(len(codes)), 0))
        usable = (kinds == 0) & (codes > 3) & ~last
        for place, order in enumerate(ORDERS):
            at = usable & (since >= order)
            keys, after = _hashes(codes, place)[at], following[at]
            if wanted is not None:
                held = wanted.holds(keys)
                keys, after = keys[held], after[held]
            parts.append(np.unique(keys | after, return_counts=True))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def end_contexts(tails: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(tail, place, context)``: the contexts at the end of each text, by its number and the place in ``ORDERS``."""
    sizes = np.array([len(t) for t in tails], np.int64)
    codes = np.frombuffer("".join(f"\x00{t}" for t in tails).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    last = np.cumsum(sizes + 1) - 1
    parts = [(at, np.full(len(at), place, np.int32), _hashes(codes, place)[last[at]]) for place, order in enumerate(ORDERS) for at in [np.flatnonzero(sizes >= order)]]
    tail, places, contexts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tail, places, contexts


class Model(NamedTuple):
    keys: np.ndarray
    counts: np.ndarray

    def following(self, context: str) -> tuple[float, float]:
        """P(end), P(pause) after the context: longer contexts refine shorter ones by their counts."""
        end, pause = UNKNOWN_END, UNKNOWN_PAUSE
        tail = context[-max(ORDERS) :]
        codes = np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for place, order in enumerate(ORDERS):
            if order > len(codes):
                break
            key = _hashes(codes[-order:], place)[-1]
            at = int(np.searchsorted(self.keys, key))
            if at >= len(self.keys) or self.keys[at] != key:
                break
            total, ends, pauses = (int(x) for x in self.counts[at])
            end, pause = (ends + 2 * end) / (total + 2), (pauses + 2 * pause) / (total + 2)
        return end, pause


def count_following(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``context, n, ends, pauses`` of a table of ``text``: what follows the contexts, all of them or the wanted ones.

    Each task adds up its own contexts and sends all of them; Spark adds them over all tasks, and only then do contexts
    seen less than ``LEAST_SEEN`` times go. So the counts are the same however the rows lie.
    """
    shared = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else Wanted(shared.value)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["key", "n"])

        for batch in batches:
            more = count_contexts([plain(t) for t in batch.column(0).to_pylist()], known)
            keys, counts = _summed(np.r_[keys, more[0]], np.r_[counts, more[1]])
            if len(keys) > LOCAL_COUNTERS:
                yield from sent()
                keys, counts = keys[:0], counts[:0]
        yield from sent()

    texts = texts.where(F.col("text").isNotNull() & (F.length("text") > 0))
    what = F.col("key").bitwiseAND(F.lit(3))
    rows = map_batches(texts, run, "key bigint, n bigint").groupBy((F.col("key") - what).alias("context"))
    rows = rows.agg(F.sum("n").alias("n"), F.sum(F.when(what == 1, F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(what == 2, F.col("n")).otherwise(0)).alias("pauses"))
    return rows.where(F.col("n") >= LEAST_SEEN)


#: Evidence beside the model, as log-odds of a cut: a text just as long as its source allows, a single ellipsis at its end,
#: and a quotation or a bracket that isn't closed.
AT_LIMIT, ELLIPSIS, OPEN_QUOTATION, OPEN_BRACKET = 6.0, 3.0, 4.0, 1.0
#: What the model says of a context it knows nothing about, end and pause, and the log-odds of a cut that this makes.
UNKNOWN_END, UNKNOWN_PAUSE = 0.1, 0.15
UNKNOWN_ODDS = float(np.log((1.0 - UNKNOWN_END - UNKNOWN_PAUSE + 0.1 * UNKNOWN_PAUSE) / (UNKNOWN_END + 0.5 * UNKNOWN_PAUSE + 1e-3)))
#: Bins of log-odds for each unit, from which thresholds are learned.
BINS = 4


def learned_threshold(odds: np.ndarray, weights: np.ndarray, rounds: int = 100) -> float:
    """The least log-odds of a cut for a column's open ends in one language, from the log-odds of all of them.

    Each end's log-odds, less those of an unknown context, are the logarithm of how much likelier its context is before a
    cut than before an end. The share of cuts that explains them best is found by expectation and maximization; where
    cuts are likelier than ends, a smaller likelihood suffices. One cut and one end are supposed beforehand.
    """
    likelihood = np.clip(odds - UNKNOWN_ODDS, -30, 30)
    share, total = 0.5, weights.sum()
    for _ in range(rounds):
        cut = share * np.exp(likelihood)
        share = float(((weights * cut / (cut + 1 - share)).sum() + 1) / (total + 2))
    return UNKNOWN_ODDS - float(np.log(share / (1 - share)))


class OpenEnd(NamedTuple):
    """A text that the model decides on: its last characters as the model reads them, and the prior log-odds of a cut."""

    tail: str
    prior: float


def settle(text: str, at_limit: bool = False) -> float | OpenEnd:
    """The log-odds of a cut where marks decide, else the open end.

    Marks left by a cut, a broken character and open mark-up decide by themselves; a final full stop, closing quotation
    or picture says that it ends.
    """
    if text[-1:] in _FULL_STOPS and not any(c in text for c in "{[`<*|") and not (text[-2:-1].isdigit() and "\n" in text):
        return -9.0  # whether it holds anything or not, as nothing decisive can be open; nearly all values end here
    if is_shell(text):
        return -9.0
    tail = text[-60:].rstrip(_BLANKS)
    if (tail[-1] in "\ufffd\u200d" or not _SUSPECT.isdisjoint(tail[-12:])) and _BROKEN.search(tail):
        return 9.0
    if not _MARKS.isdisjoint(tail[-24:]) and _CUT_MARK.search(tail):
        return 9.0
    opened = open_structure(text)
    if opened in DECISIVE:
        return 9.0
    prior = (AT_LIMIT if at_limit else 0.0) + {"quotation": OPEN_QUOTATION, "bracket": OPEN_BRACKET}.get(opened, 0.0)
    if tail[-1] == "…" and (m := _SINGLE_ELLIPSIS.search(tail)):
        tail, prior = tail[: m.start()], prior + ELLIPSIS
        if is_shell(tail):
            return -9.0
    elif tail[-1] in _TERMINAL or _PICTURE.match(tail[-1]) or (tail[-1] == "|" and tail.rpartition("\n")[2].lstrip().startswith("|")):
        return -9.0  # a whole row of a table ends as well
    if tail[-1] in _PAUSED:
        return 9.0
    # The model looks back no further than its longest context, so the tail is all it reads.
    return OpenEnd(plain(tail)[-max(ORDERS) :], prior)


def log_odds(text: str, model: Model, at_limit: bool = False) -> float:
    """How much likelier it is that the text was cut at its end than that it ends there; ``settled`` does it for tables.

    What marks decide has -9 or 9.

    Where marks don't decide, the continuation likelihood of the final context is held against that of an end.
    """
    found = settle(text, at_limit)
    if isinstance(found, float):
        return found
    end, pause = model.following(found.tail)
    going = max(1e-6, 1.0 - end - pause)
    # Many writers leave out the last full stop, so a pause may be an end as well; a cut falls on one only by chance.
    return float(np.log((going + 0.1 * pause) / (end + 0.5 * pause + 1e-3)) + found.prior)


#: What a task says of each text: log-odds or an open end, and the language of its end.
SETTLED = "odds double, tail string, prior double, language string"


def settle_all(texts: list[str | None], at_limit: list[bool]) -> list[pa.Array]:
    """The columns of ``SETTLED``; a null or empty text is never cut."""
    found = [settle(t, full) if t else -np.inf for t, full in zip(texts, at_limit, strict=True)]
    ends = [f if isinstance(f, OpenEnd) else None for f in found]
    odds = pa.array([None if e else float(f) for e, f in zip(ends, found, strict=True)], pa.float64())
    language = pa.array([script_of(t) if e else None for e, t in zip(ends, texts, strict=True)], pa.string())
    return [odds, pa.array([e and e.tail for e in ends], pa.string()), pa.array([e and e.prior for e in ends], pa.float64()), language]


SETTLED_NAMES = ("odds", "tail", "prior", "language")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tail, place, context = end_contexts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tail)), pa.array(place), pa.array(context)], ["tail", "place", "context"])


def settled(rows: DataFrame, texts: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """``rows`` with ``SETTLED`` replaced by ``cut``, by what follows the ends' contexts in all of ``texts``.

    Only contexts at an open end are looked up, so only these need counting. Up to ``contexts`` of them are sent to the
    counting tasks; if there are more, the tasks count all contexts. The counts, and so the verdicts, are the same.
    """
    rows = cut_lineage(rows)
    keyed = cut_lineage(map_batches(rows.where(F.col("tail").isNotNull()).select("tail").distinct(), _keyed, "tail string, place int, context bigint"))
    needed = keyed.select("context").distinct()
    number = needed.count()
    wanted = needed.toArrow().column("context").to_numpy() if number <= contexts else None
    seen, small = count_following(texts, wanted), number <= min(contexts, MAX_BROADCAST_ENDS)
    # A context is seen at least as often as a longer one, so none is missing before one that is found.
    listed = keyed.join(F.broadcast(seen) if small else seen, "context").groupBy("tail").agg(F.array_sort(F.collect_list(F.struct("place", "n", "ends", "pauses"))).alias("known"))

    def refined(at, more):
        return F.struct(*[((more[counted] + 2 * at[share]) / (more["n"] + 2)).alias(share) for share, counted in (("end", "ends"), ("pause", "pauses"))])

    told = listed.select("tail", F.aggregate("known", F.struct(F.lit(UNKNOWN_END).alias("end"), F.lit(UNKNOWN_PAUSE).alias("pause")), refined).alias("told"))
    told = cut_lineage(told)
    open_ends = rows.where(F.col("tail").isNotNull()).join(F.broadcast(told) if small else told, "tail", "left")
    end, pause = F.coalesce(F.col("told.end"), F.lit(UNKNOWN_END)), F.coalesce(F.col("told.pause"), F.lit(UNKNOWN_PAUSE))
    odds = F.ln((F.greatest(F.lit(1e-6), 1.0 - end - pause) + 0.1 * pause) / (end + 0.5 * pause + 1e-3)) + F.col("prior")
    kept = [c for c in rows.columns if c not in SETTLED_NAMES]
    weighed = open_ends.select(*kept, "language", odds.alias("odds"))
    decided = rows.where(F.col("tail").isNull()).select(*kept, (F.col("odds") > 0).alias("cut"))
    return decided.unionByName(weighed.select(*kept, (F.col("odds") > least_odds(weighed)).alias("cut")))


def least_odds(weighed: DataFrame) -> Column:
    """The learned threshold of each row's language; the driver gets a count of each bin, some hundred rows a language."""
    bins = weighed.groupBy("language", F.round(F.greatest(F.lit(-12.0), F.least(F.lit(24.0), F.col("odds"))) * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    found = F.lit(UNKNOWN_ODDS)
    for language in sorted({r["language"] for r in bins}):
        mine = [(r["bin"] / BINS, r["n"]) for r in bins if r["language"] == language]
        least = learned_threshold(*(np.array(x, float) for x in zip(*mine, strict=True)))
        found = F.when(F.col("language") == language, least).otherwise(found)
    return found


_LAST_LETTER = regex.compile(r"(?r)\p{L}")
_SCRIPTS = tuple((name, regex.compile(p)) for name, p in (("han", r"\p{Han}"), ("latin", r"\p{Latin}"), ("cyrillic", r"\p{Cyrillic}")))


def script_of(text: str) -> str:
    """The alphabet of a text's last letter stands for its language."""
    last = _LAST_LETTER.search(text[-40:])
    return next((name for name, p in _SCRIPTS if last and p.match(last[0])), "other")


#: A source's limit: a length that so many texts have at least, and so many times as many as a usual length just below it,
#: while at most one in so many texts of that number is longer.
LIMIT_TEXTS, LIMIT_PEAK, LIMIT_BEYOND = 5, 8, 8


def limits(df: DataFrame, text: str, source: str | Column) -> DataFrame:
    """``source, characters, bytes``: the lengths at which a source cuts, where it does.

    A limit shows as a length held by far more texts than the lengths just below it, with hardly any texts beyond; a few
    longer texts, from before the limit was set, don't hide it. Of several the longest counts. Texts with a broken
    character aren't measured in bytes, as it is longer than what it replaced. Both units come from one scan.
    """
    rows = pick(df, text=text, source=source).where(F.col("text").isNotNull())
    whole = F.when(~F.col("text").contains("\ufffd"), F.octet_length("text"))
    units = F.array(F.struct(F.lit("characters").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), whole.alias("size")))
    sizes = rows.select(F.col("source"), F.explode(units).alias("u")).where(F.col("u.size").isNotNull()).groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("n"))
    # One row a source, unit and length: no more rows a source than its longest text has bytes, however many texts it has.
    by_size = Window.partitionBy("source", "unit").orderBy(F.col("size").desc())
    reached = sizes.withColumn("beyond", F.sum("n").over(by_size) - F.col("n"))
    peaks = reached.where((F.col("n") >= LIMIT_TEXTS) & (F.col("beyond") * LIMIT_BEYOND <= F.col("n"))).select(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("size").alias("peak"), F.col("n").alias("held"))
    same = F.col("s").eqNullSafe(F.col("source")) & (F.col("u") == F.col("unit"))
    near = peaks.join(sizes, same & (F.col("size") < F.col("peak")) & (F.col("size") >= F.col("peak") * 0.8), "left")
    usual = near.groupBy("s", "u", "peak", "held").agg((F.coalesce(F.sum("n"), F.lit(0)) / (F.col("peak") * 0.2)).alias("usual"))
    longest = usual.where(F.col("held") > LIMIT_PEAK * F.col("usual")).groupBy("s").agg(*[F.max(F.when(F.col("u") == unit, F.col("peak"))).alias(unit) for unit in ("characters", "bytes")])
    return longest.withColumnRenamed("s", "source")


def cut_values(df: DataFrame, record: str, text: str, source: str | Column, contexts: int = CONTEXTS) -> DataFrame:
    """``record_id, source, cut`` for every row with a record id: whether its text was cut so that it ends within something.

    Null, empty and blank texts are never cut; a repeated row comes out as often as it is; an empty table gives no rows.
    A column's thresholds are learned from all its open ends, one a language. The corpus passes Python twice, once to
    settle and once to count contexts; only counters and open ends are shuffled.
    """
    rows = pick(df, record_id=record, text=text, source=source).where(F.col("record_id").isNotNull())
    known = cut_lineage(limits(df, text, source))
    if known.count() <= MAX_BROADCAST_SOURCES:
        known = F.broadcast(known)
    full = F.coalesce(F.length("text") == F.col("characters"), F.lit(False)) | F.coalesce(F.octet_length("text") == F.col("bytes"), F.lit(False))
    marked = rows.join(known.withColumnRenamed("source", "known_source"), F.col("source").eqNullSafe(F.col("known_source")), "left").select("record_id", "source", "text", full.alias("at_limit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = settle_all(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["record_id", "source", *SETTLED_NAMES])

    rows = map_batches(marked, run, f"record_id bigint, source string, {SETTLED}")
    return settled(rows, pick(df, text=text), contexts).select("record_id", "source", "cut")


def cut_shares(values: DataFrame) -> DataFrame:
    """``source, records, cut, share``: how often each source cuts; a null source is a source of its own."""
    counts = values.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("cut").cast("bigint")).alias("cut"))
    return counts.withColumn("share", F.col("cut") / F.col("records"))
