from collections import defaultdict

import pytest

from reviewloom.llm import copies

from .helpers import TRICKY, table, tuples

SAME = [
    ["手感：整体舒服；价格：低；型号：QD1。", "型号: qd1\n价格: 低\n手感: 整体舒服", "手感 - 整体舒服 / 型号 - QD1 / 价格 - 低", "【价格】低【型号】QD1【手感】整体 舒服", '{"价格": "低", "手感": "整体舒服", "型号": "QD1"}'],
    ["Тhe price is FAIR!", "the  price…is fair", "ｔｈｅ price is fa​ir"],
    ["size: fits. model: A1. price: ok.", "MODEL - A1 / PRICE - OK / SIZE - FITS"],
    ["!!!", "!!!"],
]
DIFFERENT = ["手感：整体舒服；价格：不低；型号：QD1。", "the price is not fair", "the price is fair 2", "!!!!", "size: fits. model: A2. price: ok."]


#: Signs that say something keep records apart; decoration, brackets and dashes between words don't.
APART = [("3.5", "35"), ("-5", "5"), ("50%", "50"), ("C++", "C"), ("C#", "C"), ("好👍", "好👎"), ("$5", "€5"), ("a 3.5", "a 35"), ("20°", "20"), ("A+", "A")]
TOGETHER = [("好，用", "好用"), ("a-b", "a b"), ("K-2831", "K2831"), ("1,000", "1000"), ("(5)", "5"), ("~5~", "5"), ("好…", "好"), ("❤️好", "❤好"), ("￥5", "¥5"), ("**a**", "a"), ("a.b", "ab"), ("5。", "5"), ("−5", "-5")]


def test_signs():
    assert all(copies.canonical(a) != copies.canonical(b) for a, b in APART)
    assert all(copies.canonical(a) == copies.canonical(b) for a, b in TOGETHER)


def test_canonical():
    keys = [{copies.canonical(t) for t in group} for group in SAME]
    assert all(len(k) == 1 for k in keys)
    assert len(set.union(*keys) | {copies.canonical(t) for t in DIFFERENT}) == len(SAME) + len(DIFFERENT)


@pytest.mark.parametrize("least", [1, 100_000])
def test_groups_equal_brute_force(spark, monkeypatch, least):
    """With the low limit nearly every key is hot and takes the salted way."""
    monkeypatch.setattr(copies, "HOT_LEAST", least)
    rows = [(k * 10 + j, t) for k, group in enumerate(SAME) for j, t in enumerate(group)] + [(900 + k, t) for k, t in enumerate(DIFFERENT)] + [(1000 + k, SAME[1][k % 3]) for k in range(60)]
    rows += rows[:5]
    groups = defaultdict(set)
    for i, t in rows:
        groups[copies.canonical(t)].add(i)
    expected = sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    got = copies.copy_groups(table(spark, rows, "request_id bigint, text string"), "request_id", "text")
    assert tuples(got, "id", "first_id", "copies") == expected


def test_tricky_rows(spark):
    df = table(spark, TRICKY, "request_id bigint, text string")
    got = {i: (f, n) for i, f, n in tuples(copies.copy_groups(df, "request_id", "text"), "id", "first_id", "copies")}
    assert got[6] == (1, 2) and 2 not in got and None not in got and got[3] == (3, 1)
    assert copies.copy_groups(df.where("false"), "request_id", "text").count() == 0
