"""Problem 9: sources mixed to target shares of all tokens, by the cube method."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import pick

#: Documents of one block; a block is one task's, whatever the source's size.
BLOCK = 5000
#: A block leaves at most two documents undecided, so so many blocks go into one block of the next level; the first one
#: takes a whole block of decided documents along.
FAN_IN = BLOCK // 2
TINY = 1e-9


def flight(chance: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the inclusion chances through the null space of (tokens, documents) until at most two aren't 0 or 1.

    Every step takes three undecided documents, the direction that keeps their expected tokens and number, and goes along
    it to the next wall on either side, each with the chance that keeps the expectation.
    """
    p = chance.astype(float).copy()
    open_ = [k for k in range(len(p)) if TINY < p[k] < 1 - TINY]
    work, rest = open_[:3], iter(open_[3:])
    while len(work) == 3:
        a, b, c = (float(sizes[k]) for k in work)
        u = (b - c, c - a, a - b)  # orthogonal to (a, b, c) and to (1, 1, 1)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / x if x > 0 else p[k] / -x) for k, x in zip(work, u, strict=True) if x)
        down = min((p[k] / x if x > 0 else (1 - p[k]) / -x) for k, x in zip(work, u, strict=True) if x)
        step = up if rng.random() < down / (up + down) else -down
        still = []
        for k, x in zip(work, u, strict=True):
            p[k] += step * x
            if p[k] < TINY:
                p[k] = 0.0
            elif p[k] > 1 - TINY:
                p[k] = 1.0
            else:
                still.append(k)
        while len(still) < 3 and (k := next(rest, None)) is not None:
            still.append(k)
        work = still
    return p


def landing(chance: np.ndarray, before: np.ndarray, sizes: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
    """Decide the at most two documents that are left, then exchange a few to meet the expected tokens.

    One of the two may be long, so rounding alone can miss by half its tokens. What is missing or too much is made up by
    the longest documents that fit, from the longest down: a number of them that grows with the logarithm of the gap.
    ``before`` holds the chances before the flight; ``free`` says which documents may be exchanged, by default those that
    weren't certain then.
    """
    p = chance.copy()
    free = (before > TINY) & (before < 1 - TINY) if free is None else free
    left = [k for k in range(len(p)) if TINY < p[k] < 1 - TINY]
    wanted = sum(p[k] * sizes[k] for k in left)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda xs: (abs(sum(x * sizes[k] for x, k in zip(xs, left, strict=True)) - wanted), xs))
    for x, k in zip(best, left, strict=True):
        p[k] = x
    gap = float((before * sizes).sum() - (p * sizes).sum())
    for k in np.lexsort((np.arange(len(p)), -sizes)):
        if abs(gap) < 1:
            break
        if free[k] and k not in left and p[k] == (0.0 if gap > 0 else 1.0) and abs(gap - np.sign(gap) * sizes[k]) < abs(gap) and sizes[k] <= abs(gap):
            gap -= np.sign(gap) * sizes[k]
            p[k] = 1.0 - p[k]
    return p


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """The flight over one block; where it is its source's only one, the landing as well."""
    pdf = pdf.sort_values(["record_id", "tokens"], kind="stable", ignore_index=True)
    seed = np.random.default_rng([int(pdf["block"].iloc[0]) & 0x7FFFFFFF, *(ord(c) for c in str(pdf["source"].iloc[0]))])
    sizes = pdf["tokens"].to_numpy()
    # The largest first, so that what the flight leaves to the landing is small; equal sizes in random order.
    order = np.lexsort((seed.random(len(pdf)), -sizes))
    p = np.empty(len(pdf))
    before, first = pdf["chance"].to_numpy(), pdf["first"].to_numpy()
    p[order] = flight(before[order], sizes[order], seed)
    if int(pdf["blocks"].iloc[0]) == 1:
        p = landing(p, before, sizes, (first > TINY) & (first < 1 - TINY))
    return pdf.assign(chance=p)


SCHEMA = "record_id bigint, source string, tokens int, base int, chance double, first double, block bigint, blocks bigint"


def plan_mix(totals: list[tuple[str, int, int]], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """How often each source's tokens go into the largest mix that has the shares and keeps the repeat limits.

    A target without a share, without repeats or without tokens in the data is left out, and the other shares stand in
    their proportion.
    """
    tokens = {s: t for s, t, _ in totals}
    usable = [(s, share, limit) for s, share, limit in targets if share and share > 0 and limit and limit > 0 and tokens.get(s, 0) > 0]
    if not usable:
        return {}
    size = min(limit * tokens[s] / share for s, share, limit in usable)
    return {s: min(float(limit), share * size / tokens[s]) for s, share, limit in usable}


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], record: str = "record_id", tokens: str = "tokens", source: str = "source", block: int = BLOCK) -> DataFrame:
    """``record_id, source, tokens, copies``: the documents of the mix and how often each is used, one row a document.

    Each source is used floor(m) times as a whole, and once more a balanced sample of it, m being the source's tokens in
    the largest mix that the repeat limits allow, over those it has. Documents without a source, of sources not listed or
    without tokens stay out; an empty table gives no rows; a repeated row is a document of its own. Of a target given
    twice the shares add up and the smaller limit holds.

    The flight runs in blocks of ``block`` documents, hashed by id, so a source with a third of all documents is many
    tasks; what blocks leave undecided, two documents at most, goes into blocks of the next level, until a source is one
    block, whose at most two documents are its landing problem. The first block's decided documents come along to it, so
    that a large source has documents to exchange as a small one has. The driver sees one row a target.
    """
    spark = sizes.sparkSession
    merged: dict[str, tuple[float, int]] = {}
    for s, share, limit in targets:
        if s is not None and share is not None and limit is not None:
            old = merged.get(s)
            merged[s] = (share + old[0], min(limit, old[1])) if old else (share, limit)
    wanted = [(s, *x) for s, x in merged.items()]
    rows = pick(sizes, record_id=record, source=source, tokens=tokens).where((F.col("tokens") > 0) & F.col("source").isin([s for s, *_ in wanted]))
    totals = [(r["source"], r["tokens"], r["n"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()]
    times = plan_mix(totals, wanted)
    if not times:
        return spark.createDataFrame([], "record_id bigint, source string, tokens int, copies int")
    blocks = {s: max(1, -(-n // block)) for s, _, n in totals}
    entry = F.create_map(*[x for s, m in times.items() for x in (F.lit(s), F.struct(F.lit(int(m)).alias("base"), F.lit(m - int(m)).alias("chance"), F.lit(blocks[s]).alias("blocks")))])
    placed = rows.withColumn("e", F.try_element_at(entry, F.col("source"))).where(F.col("e").isNotNull())
    share, blocks_of = F.col("e.chance"), F.col("e.blocks").cast("bigint")
    current = placed.select("record_id", "source", F.col("tokens").cast("int"), F.col("e.base").alias("base"), share.alias("chance"), share.alias("first"), F.pmod(F.xxhash64("record_id"), blocks_of).alias("block"), blocks_of.alias("blocks"))
    decided, most = [], max(blocks.values())
    while True:
        after = cut_lineage(current.groupBy("source", "block").applyInPandas(_decide, SCHEMA))
        if most == 1:
            decided.append(after)
            break
        goes_on = (F.col("blocks") > 1) & ((F.col("block") == 0) | (F.col("chance") > TINY) & (F.col("chance") < 1 - TINY))
        decided.append(after.where(~goes_on))
        current = after.where(goes_on).withColumns({"block": F.floor(F.col("block") / FAN_IN), "blocks": F.ceil(F.col("blocks") / FAN_IN)})
        most = -(-most // FAN_IN)
    whole = decided[0]
    for part in decided[1:]:
        whole = whole.unionByName(part)
    return whole.select("record_id", "source", "tokens", (F.col("base") + F.round("chance").cast("int")).alias("copies")).where("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_copies`` for every target, reached or not."""
    wanted = pick(targets, source="source", target_share="target_share", max_repeats="max_repeats")
    found = mixed.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    both = wanted.join(found, "source", "left")
    whole = found.agg(F.sum("tokens").alias("tokens")).scalar()
    return both.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
