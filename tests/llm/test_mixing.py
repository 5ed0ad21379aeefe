import numpy as np
import pytest

from reviewloom.llm import mixing

from .helpers import table


def test_flight_keeps_balance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 5000, 400)
        chance = rng.random(400) * (rng.random(400) > 0.1)
        p = mixing.flight(chance, sizes, rng)
        assert ((p > mixing.TINY) & (p < 1 - mixing.TINY)).sum() <= 2
        assert abs(p.sum() - chance.sum()) < 1e-5 and abs((p * sizes).sum() - (chance * sizes).sum()) < 1e-2
        landed = mixing.landing(p, chance, sizes)
        assert set(landed) <= {0.0, 1.0} and abs((landed * sizes).sum() - (chance * sizes).sum()) < 200
        assert not landed[chance == 0].any()


def test_flight_is_unbiased():
    sizes, total = np.array([10, 20, 30, 40, 50, 60]), np.zeros(6)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        total += mixing.flight(np.full(6, 0.5), sizes, rng)
    assert np.allclose(total / 4000, 0.5, atol=0.03)


def sizes(spark, repeat=1):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.lognormal(4, 1)) + 1, "ABC"[0 if k % 3 else k % 2 + 1]) for k in range(3000)] * repeat
    return table(spark, [*rows, (9001, 50, None), (9002, 50, "other"), (9003, 0, "A"), (9004, None, "B")], "record_id bigint, tokens int, source string", clash=False)


@pytest.mark.parametrize("block", [5000, 40])
def test_shares(spark, block):
    df = sizes(spark).withColumnsRenamed({}).selectExpr("*", "1 AS base", "0.5 AS chance", "3 AS block")
    targets = [("A", 0.5, 1), ("B", 0.3, 4), ("C", 0.2, 2), ("none", 0.0, 3), ("missing", 0.1, 2), (None, 0.1, 1)]
    got = mixing.mix(df, targets, block=block).collect()
    total = sum(r["tokens"] * r["copies"] for r in got)
    for s, share, limit in targets[:3]:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["tokens"] * r["copies"] for r in mine) / total - share) < 0.004
        assert max(r["copies"] for r in mine) <= limit
    assert {r["source"] for r in got} == {"A", "B", "C"} and len({r["record_id"] for r in got}) == len(got)
    again = mixing.mix(df, targets, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_report_and_empty(spark):
    targets = spark.createDataFrame([("A", 0.5, 1), ("missing", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes(spark), [("A", 0.5, 1), ("missing", 0.5, 2)])
    report = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    assert report["A"]["actual_share"] == 1.0 and report["missing"]["documents"] == 0
    assert mixing.mix(sizes(spark).where("false"), [("A", 1.0, 1)]).count() == 0
    assert mixing.mix(sizes(spark), []).count() == 0


def test_large_sources_land_as_exactly_as_small_ones(spark):
    """Sources of many blocks, of one block, and with a very long document; each meets its share to a few tokens."""
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.lognormal(4, 1)) + 1, "A" if k % 10 else "B") for k in range(4000)] + [(9000, 20_000, "A"), (9001, 9_000, "B")]
    df = table(spark, rows, "record_id bigint, tokens int, source string", clash=False)
    got = mixing.mix(df, [("A", 0.7, 1), ("B", 0.3, 1)], block=200).collect()
    total = {s: sum(t for _, t, x in rows if x == s) for s in "AB"}
    m = mixing.plan_mix([(s, n, 0) for s, n in total.items()], [("A", 0.7, 1), ("B", 0.3, 1)])
    for s in "AB":
        assert abs(sum(r["tokens"] * r["copies"] for r in got if r["source"] == s) - m[s] * total[s]) < 60
