"""Problem 7: how often every distinct term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keyword_form, map_batches, pick

#: A term is heavy if it may make up one in so many rows; so there are never more than about so many heavy terms.
HEAVY_SHARE = 256
#: Counters of the detector; DataSketches' error is 1/0.75 of rows/counters, far below the share above.
TRACKED = 8192
WORD = 62  # bits of a mask's word that are used


def heavy_terms(terms: DataFrame, share: int = HEAVY_SHARE) -> list[str]:
    """Candidates for heavy terms, by a mergeable sketch: at most ``share`` terms reach the driver, whatever the input."""
    found = terms.where(F.col("term").isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(term, {share}, {TRACKED})").alias("top")).first()
    return sorted(x["item"] for x in (found["top"] or []) if x["count"] * share >= found["n"])


def _count_bits(width: int):
    """Local counter arrays: how many records of the partition have each heavy term, and how often the terms occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, total = np.zeros(width, np.int64), 0
        for batch in batches:
            total += len(batch)
            for word in range(batch.num_columns):
                bits = batch.column(word).to_numpy(zero_copy_only=False)
                for k in range(word * WORD, min(width, (word + 1) * WORD)):
                    records[k] += np.count_nonzero(bits & (1 << (k - word * WORD)))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(width), -1], pa.int32()), pa.array(np.r_[records, total], pa.int64())], ["slot", "records"])

    return run


def _count_rows(heavy: list[str]):
    """Local counter arrays over the raw rows of heavy terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences = np.zeros(len(heavy), np.int64)
        values = pa.array(heavy, pa.string())
        for batch in batches:
            slots = pc.drop_null(pc.index_in(batch.column(0), values)).to_numpy(zero_copy_only=False)
            occurrences += np.bincount(slots, minlength=len(heavy))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(heavy)), pa.int32()), pa.array(occurrences, pa.int64())], ["slot", "occurrences"])

    return run


def term_counts(df: DataFrame, term: str, record: str, occurrence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(counts, size)``: counts has ``term, occurrences, records``; size has one row with the number of ``records``.

    Terms are trimmed and lower-cased; null and blank ones count for nothing, but their records count in ``size``. A
    record is a distinct non-null value of ``record``. With ``occurrence``, rows that repeat its value count once (rows
    with null there all count); without it every row is an occurrence. An empty table gives no counts and size 0.

    Heavy terms never travel: their rows are counted in each task's own array, and their records by bit masks, one a
    record, that are combined before the shuffle. Only light terms are shuffled, by term and record, so no key is hot.
    """
    rows = pick(df, term=keyword_form(df[f"`{term}`"]), record=record, **({"occ": occurrence} if occurrence else {}))
    if occurrence:
        once = rows.where(F.col("occ").isNotNull()).groupBy("occ").agg(F.min(F.struct("term", "record")).alias("x"))
        rows = once.select("x.term", "x.record").unionByName(rows.where(F.col("occ").isNull()).drop("occ"))
    heavy = heavy_terms(rows)
    slots = df.sparkSession.createDataFrame(list(zip(heavy, range(len(heavy)), strict=True)), "term string, slot int")  # at most HEAVY_SHARE rows
    words = range(max(1, -(-len(heavy) // WORD)))
    marked = rows.where(F.col("record").isNotNull()).join(F.broadcast(slots), "term", "left").select("record", "slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("slot"), F.lit(WORD)))
    masks = marked.groupBy("record").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("slot") / WORD) == w, bit)), F.lit(0).cast("bigint")).alias(f"m{w}") for w in words]).drop("record")
    by_slot = map_batches(masks, _count_bits(len(heavy)), "slot int, records bigint").groupBy("slot").agg(F.sum("records").alias("records"))
    size = by_slot.where("slot = -1").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    light_rows = rows.where(F.col("term").isNotNull() & ~F.col("term").isin(heavy)) if heavy else rows.where(F.col("term").isNotNull())
    pairs = light_rows.groupBy("term", "record").agg(F.count("*").alias("n"))
    light = pairs.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    if not heavy:
        return light, size
    occurrences = map_batches(rows.where(F.col("term").isin(heavy)).select("term"), _count_rows(heavy), "slot int, occurrences bigint").groupBy("slot").agg(F.sum("occurrences").alias("occurrences"))
    named = F.element_at(F.array(*map(F.lit, heavy)), F.col("slot") + 1)
    # Two tables of at most HEAVY_SHARE rows each.
    hot = F.broadcast(occurrences).join(by_slot.where("slot >= 0"), "slot").where("occurrences > 0").select(named.alias("term"), "occurrences", "records")
    return hot.unionByName(light), size


def _count_lists(heavy: list[str]):
    """Local counter arrays over whole records, given as lists of their terms and numbers; slot -1 counts the records."""
    width = len(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, records, total = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        values = pa.array(heavy, pa.string())
        for batch in batches:
            total += len(batch)
            terms, numbers = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            found = pc.index_in(terms.flatten(), values)
            held = found.is_valid().to_numpy(zero_copy_only=False)
            slots = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(occurrences, slots, numbers.flatten().to_numpy(zero_copy_only=False)[held])
            # Keys of one record that are one term count it once.
            records += np.bincount(np.unique(row[held] * max(1, width) + slots) % max(1, width), minlength=width)[:width]
        counted = [pa.array(np.r_[np.arange(width), -1], pa.int32()), pa.array(np.r_[occurrences, 0], pa.int64()), pa.array(np.r_[records, total], pa.int64())]
        yield pa.RecordBatch.from_arrays(counted, ["slot", "occurrences", "records"])

    return run


def map_key_counts(df: DataFrame, counts: str) -> tuple[DataFrame, DataFrame]:
    """The same for a map column: every row is a record; occurrences are the sum of the map's values.

    Keys of one map that become equal by trimming and lower-casing are one key of that record; null values count 0.
    Null and empty maps hold no keys, but their rows are records. A record is whole where it lies, so heavy terms are counted
    in one pass over the maps, and light ones send one row a term and task.
    """
    rows = pick(df, counts=counts)
    pairs = F.transform(F.map_entries("counts"), lambda e: F.struct(keyword_form(e["key"]).alias("term"), F.coalesce(e["value"].cast("bigint"), F.lit(0).cast("bigint")).alias("n"), F.lit(0).alias("held")))
    entries = rows.select(F.coalesce(pairs, F.array().cast("array<struct<term:string,n:bigint,held:int>>")).alias("entries"))
    heavy = heavy_terms(entries.select(F.explode("entries.term").alias("term")))
    local = map_batches(entries.select(F.col("entries.term").alias("terms"), F.col("entries.n").alias("numbers")), _count_lists(heavy), "slot int, occurrences bigint, records bigint")
    by_slot = local.groupBy("slot").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    size = by_slot.where("slot = -1").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    # Each distinct term of the map stands once more, for the record; array_distinct keeps this linear in the map's size.
    holds = F.transform(F.array_distinct(F.transform("entries", lambda e: e["term"])), lambda t: F.struct(t.alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("held")))
    each = entries.select(F.explode(F.concat("entries", holds)).alias("e")).where(F.col("e.term").isNotNull())
    light_rows = each.where(~F.col("e.term").isin(heavy)) if heavy else each
    light = light_rows.groupBy("e.term").agg(F.sum("e.n").alias("occurrences"), F.sum("e.held").cast("bigint").alias("records"))
    if not heavy:
        return light, size
    named = F.element_at(F.array(*map(F.lit, heavy)), F.col("slot") + 1)
    hot = by_slot.where("slot >= 0 AND records > 0").select(named.alias("term"), "occurrences", "records")
    return hot.unionByName(light), size


def with_mark(counts: DataFrame, size: DataFrame, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``rare_below`` records, else ``common`` above the share of all records, else null."""
    common = F.col("records") > size.select("records").scalar() * F.lit(common_share)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))
