"""Problem 8: texts into containers of fixed capacity: by patterns of sizes planned on their table, or by harmonic classes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import map_batches, pick

#: Items of one size are ranked in so many parts, so that a size held by a third of all items is no single task's.
SALTS = 64


class Plan(NamedTuple):
    """Where the items of each size go: ranks ``start``.. of a size fill containers ``base``.. with ``each`` a container."""

    size: np.ndarray
    start: np.ndarray
    base: np.ndarray
    each: np.ndarray
    containers: int


def pattern_plan(capacity: int, counts: dict[int, int]) -> Plan:
    """Containers for ``counts[size]`` items of each size up to ``capacity``: patterns of a fixed number of items of each size.

    The largest size left decides a container's class: size s in (capacity/(j+1), capacity/j] means j items of it. What
    such a container leaves is filled the same way from smaller classes, again by a fixed number of items. Containers of
    one make are counted together, so the work depends on the number of different sizes, at most ``capacity``, and not on
    the number of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    used = dict.fromkeys(sizes, 0)
    rows: list[tuple[int, int, int, int]] = []
    base = 0
    while sizes:
        make: list[tuple[int, int]] = []
        room, upper = capacity, len(sizes)
        while room and (upper := bisect_right(sizes, room, 0, upper)):
            s = sizes[upper - 1]
            each = min(room // s, left[s])
            make.append((s, each))
            room -= each * s
            upper -= 1
        times = min(left[s] // each for s, each in make)
        for s, each in make:
            rows.append((s, used[s], base, each))
            used[s] += each * times
            left[s] -= each * times
        base += times
        for s, _ in make:
            if not left[s]:
                del sizes[bisect_right(sizes, s) - 1]
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], base)


def _place(plans: dict[str, Plan]):
    """Containers of a batch, by binary search in each plan's table; a key of size and rank puts the table in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specs = np.array(batch.column(0).to_pylist(), dtype=object)
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            container = np.zeros(len(batch), np.int64)
            for name, plan in plans.items():
                here = np.flatnonzero(specs == name)
                if not len(here):
                    continue
                first = np.searchsorted(plan.size, size[here], "left")
                last = np.searchsorted(plan.size, size[here], "right")
                at = first.copy()
                while True:  # at most log2 of a size's rows in the plan
                    middle = (at + last) // 2
                    further = (last - at > 1) & (plan.start[np.minimum(middle, len(plan.start) - 1)] <= rank[here])
                    shrink = (last - at > 1) & ~further
                    if not (further.any() or shrink.any()):
                        break
                    at, last = np.where(further, middle, at), np.where(shrink, middle, last)
                container[here] = plan.base[at] + (rank[here] - plan.start[at]) // plan.each[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(container), batch.column(1), batch.column(2), batch.column(3)], ["spec_name", "container_id", "record_id", "part", "tokens"])

    return run


PACKED = "spec_name string, container_id bigint, record_id bigint, part int, tokens int"


def _items(sizes: DataFrame, record: str, tokens: str, specs: list[tuple[str, int]], salts: int) -> DataFrame | None:
    """``spec_name, capacity, record_id, part, size, salt``: every text under every spec, long ones in parts; None without specs."""
    if len({n for n, _ in specs}) != len(specs) or any(c < 1 for _, c in specs):
        raise ValueError("specs need distinct names and positive capacities")
    if not specs:
        return None
    rows = pick(sizes, record_id=record, tokens=tokens).where(F.col("tokens") > 0)
    each = F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).alias("capacity")) for n, c in specs])
    wide = rows.select("record_id", "tokens", F.explode(each).alias("s")).select("record_id", "tokens", "s.spec_name", "s.capacity")
    parts = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))
    return parts.select("spec_name", "capacity", "record_id", "part", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).cast("int").alias("size"), F.pmod(F.xxhash64("record_id", "part"), F.lit(salts)).cast("int").alias("salt"))


def pack(sizes: DataFrame, record: str, tokens: str, specs: list[tuple[str, int]], salts: int = SALTS) -> DataFrame:
    """``spec_name, container_id, record_id, part, tokens``: every text's place under every spec.

    A text of at most the capacity is one part, numbered 0, in one container. A longer one is split into parts of just the
    capacity, which fill containers of their own, and a rest that is packed like a short text. Texts without tokens (null,
    empty) take no place; a repeated row is packed again as a text of its own; equal sizes are placed by record id. No
    specs or no texts give no rows. Spec names must be distinct and capacities positive.

    The driver gets the number of items of each size: at most the capacity's number of rows for each spec. Ranks within a
    size come from ``salts`` parts with summed offsets, so a hot size is spread.
    """
    items = _items(sizes, record, tokens, specs, salts)
    if items is None:
        return sizes.sparkSession.createDataFrame([], PACKED)
    counts = cut_lineage(items.groupBy("spec_name", "size", "salt").agg(F.count("*").alias("n")))
    totals: dict[str, dict[int, int]] = {}
    for row in counts.groupBy("spec_name", "size").agg(F.sum("n").alias("n")).toLocalIterator():
        totals.setdefault(row["spec_name"], {})[row["size"]] = row["n"]
    capacities = dict(specs)
    plans = {name: pattern_plan(capacities[name], found) for name, found in totals.items()}
    before = Window.partitionBy("spec_name", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec_name", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # At most salts x capacity rows a spec, as the counts above.
    within = Window.partitionBy("spec_name", "size", "salt").orderBy("record_id", "part")
    ranked = items.withColumn("place", F.row_number().over(within)).join(offsets, ["spec_name", "size", "salt"])
    keyed = ranked.select("spec_name", "record_id", "part", "size", (F.col("offset") + F.col("place") - 1).alias("rank"))
    return map_batches(keyed, _place(plans), PACKED)


def pack_harmonic(sizes: DataFrame, record: str, tokens: str, specs: list[tuple[str, int]], salts: int = SALTS) -> DataFrame:
    """The columns of ``pack`` by pure harmonic packing: class j holds the items of more than capacity/(j+1) and up to capacity/j tokens.

    A container takes j items of its class and no others. Each of ``salts`` workers fills the containers of its own items, so
    nothing is planned, nothing reaches the driver, and no worker needs another; at most one container a class and worker is
    not full. Long texts are split as in ``pack``. Small classes leave much space: use ``pack`` for a high fill.
    """
    items = _items(sizes, record, tokens, specs, salts)
    if items is None:
        return sizes.sparkSession.createDataFrame([], PACKED)
    classed = items.withColumn("each", F.floor(F.col("capacity") / F.col("size")).cast("int"))
    within = Window.partitionBy("spec_name", "each", "salt").orderBy("record_id", "part")
    nth = F.floor((F.row_number().over(within) - 1) / F.col("each"))
    # Class and worker stand in the upper bits, so that containers of different workers never meet.
    container = F.call_function("shiftleft", F.col("each").cast("bigint") * salts + F.col("salt"), F.lit(32)) + nth
    return classed.select("spec_name", container.alias("container_id"), "record_id", "part", F.col("size").alias("tokens"))


def fill_report(packed: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """``spec_name, capacity, containers, tokens, fill``: how much of the containers' space is used."""
    capacity = F.element_at(F.create_map(*[F.lit(x) for s in specs for x in s]), F.col("spec_name"))
    by_container = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("tokens"))
    found = by_container.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return found.withColumn("capacity", capacity).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
