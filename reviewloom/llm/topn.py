"""Problem 6: the N best items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import map_batches, pick

#: Bounds are broadcast up to this many groups (about 40 bytes each, so 20 MB); beyond it they are joined by shuffle.
MAX_BROADCAST_GROUPS = 500_000


def valid_items(df: DataFrame, group: str, item: str, score: str, low: float, high: float) -> DataFrame:
    """Rows that can rank at all, under internal names; pushed down to the scan."""
    rows = pick(df, grp=group, item=item, score=score)
    # In Spark NaN is larger than any number, so the upper limit drops it as well; said once more for the reader.
    return rows.where(
        F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(low, high)
    )


def _nth_best(n: int):
    """Over rows sorted by group, score (the highest first) and item: each group's n-th best distinct item, where it has so many.

    One pass, batch by batch. What is kept from one batch to the next is the last group and its best items, n at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen = None, np.zeros(0, np.int64)  # the group that the last batch ended in, and its best distinct items so far
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0)
            codes = groups.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.r_[True, codes[1:] != codes[:-1]]
            run_of, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
            scores, items = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            # An item's first row is its best; later ones of the same group don't count.
            order = np.lexsort((np.arange(len(items)), items, run_of))
            again = np.r_[False, (run_of[order][1:] == run_of[order][:-1]) & (items[order][1:] == items[order][:-1])]
            fresh = np.ones(len(items), bool)
            fresh[order[again]] = False
            known = len(seen) if groups[0].as_py() == name else 0
            if known:
                fresh[: first[1] if len(first) > 1 else len(items)] &= ~np.isin(items[: first[1] if len(first) > 1 else len(items)], seen)
            total = np.cumsum(fresh)
            rank = total - np.r_[0, total][first][run_of] + np.where(run_of == 0, known, 0)
            hits = np.flatnonzero(fresh & (rank == n))
            if len(hits):
                yield pa.RecordBatch.from_arrays([groups.take(pa.array(hits)), pa.array(scores[hits], pa.float64()), pa.array(-items[hits], pa.int64())], ["grp", "low", "negated"])
            last = items[first[-1] :][fresh[first[-1] :]]
            name, seen = groups[len(items) - 1].as_py(), (np.r_[seen, last] if known and len(first) == 1 else last)[:n]

    return run


def partition_bounds(rows: DataFrame, n: int) -> DataFrame:
    """The largest lower bound of each group's n-th best score, over all partitions.

    A partition's own n-th best distinct item is no better than the group's, so the maximum is still valid. Bounds hold
    the item besides the score, so that a million ties at the top score don't survive together. Spark sorts each
    partition, spilling where it must, and one pass reads off the bounds, so time grows with the rows and not with the
    groups, and no task holds more than a batch. One row a group and partition is shuffled, partial maxima combined first.
    """
    placed = rows.select("grp", "score", "item").sortWithinPartitions(F.col("grp"), F.col("score").desc(), F.col("item"))
    local = map_batches(placed, _nth_best(n), "grp string, low double, negated bigint")
    return local.groupBy("grp").agg(F.max(F.struct("low", "negated")).alias("bound"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The ``n`` best rows of every group: ``(group, item, score, rank)``, highest score first, then smallest item.

    Rows with a null group or item, or with a score that is null, NaN or outside low..high, don't count; repeated rows
    of an item count once (an item given with several scores ranks by its best one). Groups with fewer than ``n`` items
    give all of them; an empty table gives no rows; extra columns are ignored. Group keys are compared exactly.

    Lower bounds found partition by partition remove nearly all rows of the large groups before the shuffle; the
    survivors are placed by group once, which serves both the removal of repeats and the ranking. A hot group therefore
    sends few rows, however many it has.
    """
    rows = valid_items(df, group, item, score, low, high).select(
        F.col("grp").cast("string").alias("grp"), F.col("item").cast("bigint").alias("item"), (F.col("score").cast("double") + F.lit(0.0)).alias("score")
    )
    bounds = cut_lineage(partition_bounds(rows, n))
    if bounds.count() <= MAX_BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    beyond = (F.col("score") > F.col("bound.low")) | ((F.col("score") == F.col("bound.low")) & (F.col("item") <= -F.col("bound.negated")))
    survivors = rows.join(bounds, "grp", "left").where(F.col("bound").isNull() | beyond).drop("bound")
    single = survivors.repartition("grp").groupBy("grp", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item"))
    ranked = single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
