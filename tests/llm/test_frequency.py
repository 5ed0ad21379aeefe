import random
from collections import Counter, defaultdict

import pytest

from reviewloom.llm import frequency as fr

from .helpers import table, tuples


def brute(rows, once):
    seen, occurrences, records = set(), Counter(), defaultdict(set)
    for item, record, term in rows:
        if once and item is not None:
            if item in seen:
                continue
            seen.add(item)
        t = (term or "").strip().lower()
        if t:
            occurrences[t] += 1
            if record is not None:
                records[t].add(record)
    return sorted((t, n, len(records[t])) for t, n in occurrences.items())


@pytest.mark.parametrize("share", [2, 200])
@pytest.mark.parametrize("once", [False, True])
def test_equals_brute_force(spark, monkeypatch, share, once):
    monkeypatch.setattr(fr, "HEAVY_SHARE", share)
    monkeypatch.setattr(fr.heavy_terms, "__defaults__", (share,))
    rng = random.Random(1)
    words = ["质量"] * 30 + ["  Good ", "good", "物流"] * 5 + [f"w{k}" for k in range(80)] + [None, "", "  ", "　"]
    rows = [(k, rng.choice([None, *range(200)]), rng.choice(words)) for k in range(1500)]
    rows += rows[:200]
    df = table(spark, rows, "item_id bigint, analysis_id bigint, keyword string").repartition(5)
    counts, size = fr.term_counts(df, "keyword", "analysis_id", "item_id" if once else None)
    assert tuples(counts, "term", "occurrences", "records") == brute(rows, once)
    assert size.first()["records"] == len({r for _, r, _ in rows if r is not None})


def test_maps(spark):
    rows = [({"a": 2, " A": 3, "b": None},), (None,), ({},), ({"a": 1, "": 4},)]
    counts, size = fr.map_key_counts(table(spark, rows, "keyword_counts map<string,bigint>"), "keyword_counts")
    assert tuples(counts, "term", "occurrences", "records") == [("a", 6, 2), ("b", 0, 1)]
    assert size.first()["records"] == 4


@pytest.mark.parametrize("share", [2, 200])
def test_maps_equal_brute_force(spark, monkeypatch, share):
    """Heavy and light keys alike; a hot key of every map, keys that become equal, null values, null and empty maps."""
    monkeypatch.setattr(fr.heavy_terms, "__defaults__", (share,))
    rng = random.Random(2)
    rows = [({"Hot": rng.randint(1, 9), **{f"k{rng.randint(0, 60)}": rng.choice([None, 1, 5]) for _ in range(4)}, **({" k1 ": 3} if k % 5 == 0 else {})},) for k in range(300)] + [(None,), ({},), ({" ": 5},)]
    total, held = Counter(), Counter()
    for (m,) in rows:
        for k, v in (m or {}).items():
            total[k.strip().lower()] += v or 0
        held.update({k.strip().lower() for k in (m or {})})
    counts, size = fr.map_key_counts(table(spark, rows, "keyword_counts map<string,bigint>").repartition(5), "keyword_counts")
    assert tuples(counts, "term", "occurrences", "records") == sorted((t, n, held[t]) for t, n in total.items() if t)
    assert size.first()["records"] == len(rows)


def test_marks_and_empty(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("b", 9, 9), ("c", 5, 5)], "term string, occurrences bigint, records bigint")
    size = spark.createDataFrame([(100,)], "records bigint")
    assert [(r["term"], r["mark"]) for r in fr.with_mark(counts, size).orderBy("term").collect()] == [("a", "rare"), ("b", "common"), ("c", None)]
    empty, none = fr.term_counts(table(spark, [], "item_id bigint, analysis_id bigint, keyword string"), "keyword", "analysis_id")
    assert empty.count() == 0 and none.first()["records"] == 0
