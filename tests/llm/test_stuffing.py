import argparse
import calendar
import decimal
import doctest
import heapq
import inspect
import os
import pdb
import random
import textwrap
import unittest

import numpy as np
import pytest

from reviewloom.llm import stuffing as sf

from .helpers import TRICKY, table, tuples

ASPECTS = "质量 物流 包装 手感 价格 说明书 续航 颜色 尺寸 安装".split()
WORDS = "可靠 精美 舒服 简单 很慢 粗糙 好看 合适 耐用 清楚".split()
JOINS = "不过 而且 另外 就是 再说".split()


def prose(rng):
    said = lambda: f"{rng.choice(JOINS)}{rng.choice(ASPECTS)}{rng.choice(['真的', '一直', '还是很', '算是'])}{rng.choice(WORDS)}"
    return "。".join(f"用了{rng.randint(2, 90)}天之后，{said()}，{said()}，我们都觉得可以" for _ in range(rng.randint(3, 9))) + "。"


def english(rng):
    one = lambda: f"The {rng.choice('price size smell noise manual colour'.split())} is {rng.choice('fair handy mild low clear rich'.split())} and I would buy it again from this {rng.choice('shop store place'.split())}"
    return ". ".join(one() for _ in range(rng.randint(3, 8))) + "."


def lists(rng):
    item = lambda: rng.choice(["正品", "包邮", "特价", "批发"]) + rng.choice(["充电宝", "榨汁杯", "不粘锅"]) + rng.choice(["价格", "厂家", "旗舰店", "哪家好"])
    kind = rng.randint(0, 4)
    if kind == 0:
        return rng.choice([", ", " / ", "\n", " "]).join(item() for _ in range(60))
    if kind == 1:
        return " ".join(f"#{item()}#" for _ in range(40))
    if kind == 2:
        return "\n".join(f"{item()} - http://shop{k}.test/p/{k}" for k in range(30))
    if kind == 3:
        w = item()
        return "".join(f"想买{w}就来{w}专区，{w}认准{w}。" for _ in range(12))
    return prose(rng)[:40] + "\n" + "\n".join(f"相关：{item()}" for _ in range(40))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    good = [prose(rng) for _ in range(250)] + [english(rng) for _ in range(120)]
    good += [prose(rng) + "\n#充电宝 #好物" for _ in range(20)] + ["沐禾 台灯\n接口：圆孔\n容量：760毫升\n电压：5伏\n产地：澜岸市\n适用：邻居\n材质：食品级\n重量：321克\n" + prose(rng) for _ in range(20)]
    return good, [lists(rng) for _ in range(60)]


def test_held_out(spark, corpus):
    good, bad = corpus
    df = table(spark, list(enumerate(good + bad)), "doc_id bigint, text string")
    found = {r[0] for r in tuples(sf.stuffed_pages(df, "doc_id", "text"), "record_id")}
    assert len([i for i in found if i >= len(good)]) >= 0.95 * len(bad)
    assert len([i for i in found if i < len(good)]) <= 2


def test_parts_add_up(corpus):
    good, bad = corpus
    texts = good[:30] + bad[:10]
    assert (sf.count_classes(texts) == sum(sf.count_classes([t]) for t in texts)).all()
    model = sf.fit(sf.count_classes(good))
    whole = sf.abnormal_shares(texts, model)
    assert abs(whole - [sf.abnormal_shares([t], model)[0] for t in texts]).max() < 1e-9


def test_tricky(spark):
    df = table(spark, TRICKY, "doc_id bigint, text string")
    shares = sf.stuffed_shares(df, "doc_id", "text")
    assert shares.count() == len(TRICKY) and shares.where("record_id IN (2, 3) AND share > 0").count() == 0
    assert sf.stuffed_pages(df.where("false"), "doc_id", "text").count() == 0


def test_words_of_a_short_period_are_repeated():
    for text, size in (("手机" * 40, sf.GRAM_HAN), ("phone " * 40, sf.GRAM_OTHER), ("好" * 40, sf.GRAM_HAN), ("a " * 40, sf.GRAM_OTHER)):
        codes = np.array([ord(c) for c in text])
        every = np.ones(len(text), bool)
        found = sf._repeated(codes, np.zeros(len(text), np.int64), size, every)
        # By brute force: runs that stand once more, without overlap, within BACK characters before.
        runs = [k for k in range(len(text) - size + 1) if text[k : k + size] in text[max(0, k - sf.BACK) : k]]
        expected = {j for k in runs for j in range(k, k + size)}
        assert set(np.flatnonzero(found).tolist()) == expected and len(expected) > 0.5 * len(text), text[:12]


def stdlib(*names):
    folder = os.path.dirname(os.__file__)
    return [open(os.path.join(folder, n), encoding="utf-8").read() for n in names if os.path.exists(os.path.join(folder, n))]


def test_pages_of_other_kinds_are_no_lists(corpus):
    """A model trained on the corpus alone is held against wrapped prose, a licence, manuals, code and lists of a kind it hasn't seen."""
    model = sf.fit(sf.count_classes(corpus[0]))
    manuals = [inspect.cleandoc(m.__doc__) for m in (argparse, heapq, doctest, random, unittest, decimal, calendar, pdb) if len(m.__doc__ or "") > 150]
    code = stdlib("argparse.py", "heapq.py", "csv.py", "queue.py", "shutil.py", "textwrap.py", "tempfile.py", "zipfile/__init__.py", "json/decoder.py", "logging/__init__.py")
    wrapped = [textwrap.fill(english(random.Random(k)), w) for k, w in enumerate((60, 72, 80, 100))]
    wrapped += [textwrap.fill("Permission is hereby granted to any person who obtains a copy of this work to use it without restriction, and to permit others to do so, as long as this notice is kept in all copies. The work is provided as it is, and the authors are not liable for any claim.", 70)]
    good = [*manuals, *code, *wrapped, *stdlib("LICENSE.txt")]
    towns, goods = ["Aberdale", "Northwick", "Eastbury", "Millford"], ["plumber", "locksmith", "dentist", "florist"]
    bad = [", ".join(f"cheap {g} {t}" for t in towns for g in goods), "\n".join(f"http://site{k}.test/{g}/{k}" for k in range(30) for g in goods[:1]), " ".join(f"#{g}{t}" for t in towns for g in goods), "\n".join(["best casino bonus"] * 50), " | ".join(f"{t} {g} near me" for t in towns for g in goods)]
    bad += ["Need a plumber? Our plumber is the best plumber, and a plumber near you is the plumber you want when you call a plumber. " * 4]
    flagged_good = [t[:60] for t in good if sf.abnormal_shares([t], model)[0] > sf.MOST]
    flagged_bad = [t for t in bad if sf.abnormal_shares([t], model)[0] > sf.MOST]
    assert len(good) >= 20 and len(flagged_bad) >= len(bad) - 1 and len(flagged_bad) >= 0.9 * (len(flagged_bad) + len(flagged_good)), flagged_good


def test_wraps_are_no_line_ends():
    t = sf.tokenize(["a line that is long enough to be a wrapped one, it\ngoes on here and has\n  an indent as well.", "cheap phone\nbuy phone\n"])
    assert [(t.classes[t.text == k] == sf.BREAK).sum() for k in (0, 1)] == [1, 2]
