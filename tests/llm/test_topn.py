import math
import random
import time

import pyarrow as pa
import pytest

from reviewloom.llm import topn

from .helpers import table, tuples

SCHEMA = "product_id string, item_id bigint, score double"


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s) and 0 <= s <= 1:
            best[g, i] = max(s, best.get((g, i), -1.0))
    out = []
    for group in {g for g, _ in best}:
        ranked = sorted((-s, i) for (g, i), s in best.items() if g == group)[:n]
        out += [(group, i) for _, i in ranked]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(topn, "MAX_BROADCAST_GROUPS", broadcast)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 60)}", rng.randint(0, 900), rng.choice([0.0, 0.25, 0.5, 1.0, 1.0, 1.2, -0.1, None, float("nan")])) for _ in range(4000)]
    rows += rows[:300] + [(None, 1, 0.5), ("n", None, 0.5), ("", 5, 0.5), ("z", 1, -0.0), ("z", 2, 0.0)]
    df = table(spark, rows, SCHEMA).repartition(7)
    got = topn.top_n(df, "product_id", "item_id", "score", 5)
    assert tuples(got, "product_id", "item_id") == brute(rows, 5)
    assert max(r["rank"] for r in got.collect()) == 5


def test_empty(spark):
    df = table(spark, [], SCHEMA)
    assert topn.top_n(df, "product_id", "item_id", "score").count() == 0


def batches_of(rows, size):
    for k in range(0, len(rows), size):
        g, i, s = zip(*rows[k : k + size])
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s, pa.float64()), pa.array(i, pa.int64())], ["grp", "score", "item"])


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_bounds_of_a_sorted_partition(size):
    """Groups and repeats that go over batches; an item with several scores counts by its best one."""
    rng = random.Random(size)
    rows = [(rng.choice("abcde"), rng.randint(0, 12), rng.choice([0.1, 0.2, 0.9])) for _ in range(200)] + [("f", k, 0.5) for k in range(3)]
    rows.sort(key=lambda r: (r[0], -r[2], r[1]))
    got = {(g, low, -i) for b in topn._nth_best(4)(batches_of(rows, size)) for g, low, i in zip(*(c.to_pylist() for c in b.columns))}
    wanted = set()
    for group in "abcde":
        best = {}
        for g, i, s in rows:
            if g == group:
                best[i] = max(s, best.get(i, 0))
        s, i = sorted((-s, i) for i, s in best.items())[3]
        wanted.add((group, -s, i))
    assert got == wanted


def test_time_grows_with_rows_and_not_with_groups():
    def took(n):
        rows = list(batches_of([(f"g{k // 8:07d}", k, 0.5) for k in range(n)], 10_000))
        began = time.perf_counter()
        assert sum(len(b) for b in topn._nth_best(5)(iter(rows))) == n // 8
        return time.perf_counter() - began

    once = min(took(200_000) for _ in range(3))
    assert min(took(400_000) for _ in range(3)) < 2.5 * max(once, 0.02)
