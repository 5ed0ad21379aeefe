import random
from collections import Counter, defaultdict

import pytest

from reviewloom.llm import packing
from reviewloom.llm.tokens import token_counts, tokenizer

from .helpers import TRICKY, table


def test_plan_places_all():
    rng = random.Random(2)
    for capacity in (1, 7, 100, 512):
        counts = Counter(rng.randint(1, capacity) for _ in range(500))
        plan = packing.pattern_plan(capacity, counts)
        load, placed = Counter(), Counter()
        ends = {}
        for k in range(len(plan.size)):
            same = [j for j in range(len(plan.size)) if plan.size[j] == plan.size[k] and plan.start[j] > plan.start[k]]
            end = min((plan.start[j] for j in same), default=counts[plan.size[k]])
            ends[k] = end
            for rank in range(plan.start[k], end):
                load[plan.base[k] + (rank - plan.start[k]) // plan.each[k]] += plan.size[k]
                placed[plan.size[k]] += 1
        assert placed == counts and max(load.values()) <= capacity and set(load) == set(range(plan.containers))


@pytest.mark.parametrize("salts", [1, 8])
def test_pack(spark, salts):
    rng = random.Random(4)
    rows = [(k, rng.choice([5, 5, 5, rng.randint(1, 40), rng.randint(90, 350)])) for k in range(700)] + [(1000, 0), (1001, None), (1, 5), (None, 7)]
    specs = [("a", 100), ("b", 33)]
    got = packing.pack(table(spark, rows, "doc bigint, tokens int"), "doc", "tokens", specs, salts).collect()
    for name, capacity in specs:
        mine = [r for r in got if r["spec_name"] == name]
        load, parts, total = Counter(), defaultdict(list), Counter()
        for r in mine:
            load[r["container_id"]] += r["tokens"]
            parts[r["record_id"]].append(r["part"])
            total[r["record_id"]] += r["tokens"]
        assert max(load.values()) <= capacity
        want = Counter()
        for i, t in rows:
            want[i] += t or 0
        assert total == Counter({i: t for i, t in want.items() if t})
        single = {i: t for i, t in rows if t and i not in (1, None)}
        assert all(sorted(parts[i]) == list(range(-(-t // capacity))) for i, t in single.items())
        assert sum(load.values()) / (len(load) * capacity) > 0.97
    report = {r["spec_name"]: r for r in packing.fill_report(packing.pack(table(spark, rows, "doc bigint, tokens int"), "doc", "tokens", specs), specs).collect()}
    assert report["a"]["fullest"] <= 100 and report["a"]["fill"] <= 1


@pytest.mark.parametrize("salts", [1, 8])
def test_pure_harmonic_classes(spark, salts):
    rng = random.Random(5)
    rows = [(k, rng.choice([5, rng.randint(1, 40), rng.randint(51, 100), rng.randint(90, 350)])) for k in range(2000)] + [(3000, 0), (3001, None)]
    df = table(spark, rows, "doc bigint, tokens int")
    got = packing.pack_harmonic(df, "doc", "tokens", [("a", 100)], salts).collect()
    held = defaultdict(list)
    for r in got:
        held[r["container_id"]].append(r["tokens"])
    # One class a container, never more than fit, and at most one container a class and worker that isn't full.
    assert all(len({100 // t for t in ts}) == 1 and sum(ts) <= 100 and len(ts) <= 100 // ts[0] for ts in held.values())
    assert sum(len(ts) < 100 // ts[0] for ts in held.values()) <= salts * len({100 // ts[0] for ts in held.values()})
    assert sum(map(sum, held.values())) == sum(t or 0 for _, t in rows) and packing.pack_harmonic(df, "doc", "tokens", []).count() == 0


def test_edges(spark):
    empty = table(spark, [], "doc bigint, tokens int")
    assert packing.pack(empty, "doc", "tokens", [("a", 10)]).count() == 0
    assert packing.pack(empty, "doc", "tokens", []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, "doc", "tokens", [("a", 10), ("a", 20)])


def test_token_counts(spark):
    got = token_counts(table(spark, TRICKY, "doc bigint, text string"), "doc", "text").collect()
    model = tokenizer("/opt/tokenizers/piece_bpe_32k.model")
    assert sorted((r["record_id"] or 0, r["tokens"]) for r in got) == sorted((i or 0, len(model.encode(t or ""))) for i, t in TRICKY)
