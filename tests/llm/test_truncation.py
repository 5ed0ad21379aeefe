import random

import numpy as np
import pytest

from reviewloom.llm import truncation as tr
from reviewloom.llm.structure import is_shell, open_structure

from .helpers import TRICKY, table, tuples

CLAUSES = ["质量真的可靠", "物流次日就到", "包装很精美", "手感舒服", "价格比实体店低", "值得入手", "说明书一看就懂", "续航够用三天"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    texts = ["，".join(rng.sample(CLAUSES, 4)) + "。" + "。".join(rng.sample(CLAUSES, 2)) + "。" for _ in range(1500)]
    whole = [t[:-1] for t in texts[:100]]
    cut = [t[: rng.randint(8, len(t) - 3)] for t in texts[100:300]]
    cut = [t for t in cut if not t.endswith(("。", *CLAUSES))]
    return texts, whole, cut


def test_held_out(spark, corpus):
    texts, whole, cut = corpus
    rows = [(k, t, "s") for k, t in enumerate(texts + whole + cut)]
    df = table(spark, rows, "request_id bigint, text string, channel string")
    found = {i for i, c in tuples(tr.cut_values(df, "request_id", "text", "channel"), "record_id", "cut") if c}
    first = len(texts) + len(whole)
    assert len([i for i in found if i >= first]) >= 0.97 * len(cut)
    assert len([i for i in found if i < first]) <= 2


def test_marks():
    empty = tr.Model(tr.np.zeros(0, tr.np.int64), tr.np.zeros((0, 3), tr.np.int32))
    for text in ("好的…展开", "好的…[查看全文]", "坏�", '{"a": ["b', "```json\n{\"a\": 1}", "看（", "去掉<b", "去掉\\u4e", "一半，"):
        assert tr.log_odds(text, empty) == 9.0, text
    for text in ("好。", "好……", "", "  ", '{"a": 1}', "好😊", "null", "Done.", "他说“好”"):
        assert tr.log_odds(text, empty) == -9.0, text


def test_counting_in_parts_is_counting_whole():
    texts = [tr.plain(t) for t in ("质量很好。物流QD1128快，ok", "价格 12 元", "")]
    whole = tr.count_contexts(texts)
    parts = [tr.count_contexts([t]) for t in texts]
    keys, counts = tr._summed(tr.np.concatenate([k for k, _ in parts]), tr.np.concatenate([c for _, c in parts]))
    assert (whole[0] == keys).all() and (whole[1] == counts).all()


def test_limits(spark):
    rows = [(k, "字" * (20 if k % 3 else k % 20), "sms") for k in range(300)] + [(k, "字" * (k % 40), "web") for k in range(300)] + [(1, None, None)]
    df = table(spark, rows, "request_id bigint, text string, channel string")
    assert tuples(tr.limits(df, "text", "channel"), "source", "characters", "bytes") == [("sms", 20, 60)]
    # A few older texts beyond the limit don't hide it, and a null source has limits of its own.
    longer = df.unionByName(table(spark, [(k, "字" * (25 + 3 * k), "sms") for k in range(3)], "request_id bigint, text string, channel string"))
    assert tuples(tr.limits(longer, "text", "channel"), "source", "characters", "bytes") == [("sms", 20, 60)]
    nameless = df.withColumn("channel", tr.F.lit(None).cast("string")).where("request_id % 3 > 0 AND length(text) = 20")
    assert tuples(tr.limits(nameless, "text", "channel"), "source", "characters") == [(None, 20)]


def test_tricky(spark):
    df = table(spark, [(i, t, None if i == 1 else "c") for i, t in TRICKY], "request_id bigint, text string, channel string")
    values = tr.cut_values(df, "request_id", "text", "channel")
    assert values.count() == len(TRICKY) - 1
    assert values.where("record_id IN (2, 3, 4) AND cut").count() == 0
    assert {r["source"] for r in tr.cut_shares(values).collect()} == {None, "c"}
    assert tr.cut_values(df.where("false"), "request_id", "text", "channel").count() == 0


def test_structure():
    assert open_structure('{"a": [1, 2') == "object" and open_structure('说 {"a": 1}') is None
    assert open_structure("```\ncode") == "fence" and open_structure("```\ncode\n```") is None
    assert open_structure('{"a": "}') == "object" and open_structure(r'{"a": "\""}') is None
    assert open_structure("1. 好\n2.") == "list" and open_structure("<b>好") == "tag" and open_structure("看[1]和(2)") is None
    assert all(map(is_shell, [None, "", " 　​", "{}", '""', "null", "```json\n```", '{"keywords": []}', "。", '{"a": [null, ""]}', "<p></p>"]))
    assert not any(map(is_shell, ["好", "{bad", '{"a": 0}', "nullable", "5"]))


def test_lists_cut_after_a_full_stop():
    empty = tr.Model(tr.np.zeros(0, tr.np.int64), tr.np.zeros((0, 3), tr.np.int32))
    for text in ('["好用。', '[["原文说物流快。', '结果：["好用。', '结果\n["Good.", "Fast.'):
        assert tr.log_odds(text, empty) == 9.0, text
    for text in ('["好用。"]', '结果：["好用。"]。', "见[1]。", "【好评】不错。"):
        assert tr.log_odds(text, empty) == -9.0, text


def test_open_list_items_and_tags_are_cuts():
    empty = tr.Model(tr.np.zeros(0, tr.np.int64), tr.np.zeros((0, 3), tr.np.int32))
    for text in ("要点：\n1. 好。\n2. 快。\n3.", "1. 好。\n2)", "- 好。\n-", "<b>好用。", "<div><div>好。</div>", "<answer>\n好。", '<span class="x">（好）', "<ul><li>好。</ul><b>快。"):
        assert tr.log_odds(text, empty) == 9.0, text
    for text in ("1. 好。\n2. 快。", "一共\n花了 3.", "<b>好</b>用。", "<p>好。", "<ul><li>好。</ul>快。", "电话 <PHONE>。", "写信给 <me@example.com>。", "用 List<String> 存。", "```\n<div>\n```\n好。", "写 `<b>` 就行。", '{"a": "<b>"}', "3 < 5。"):
        assert tr.log_odds(text, empty) == -9.0, text


def test_counts_do_not_depend_on_partitions(spark):
    texts = spark.createDataFrame([("甲乙丙丁戊己庚辛壬癸子。",)] * 24, "text string")
    counts = [tuples(tr.count_following(texts.repartition(p)), "context", "n", "ends", "pauses") for p in (1, 4, 64)]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == sum(12 - o for o in tr.ORDERS) and {c[1] for c in counts[0]} == {24}


@pytest.mark.parametrize("contexts", [0, tr.CONTEXTS])
def test_tables_are_scored_as_single_texts(spark, corpus, contexts):
    texts = corpus[0][:300] + corpus[1] + corpus[2]
    keys, counts = tr.count_contexts([tr.plain(t) for t in texts])
    found = sorted(set((keys >> 2 << 2).tolist()))
    at, sums = np.searchsorted(found, keys >> 2 << 2), np.zeros((len(found), 3), np.int32)
    np.add.at(sums[:, 0], at, counts)
    for kind in (1, 2):
        np.add.at(sums[:, kind], at[keys & 3 == kind], counts[keys & 3 == kind])
    often = sums[:, 0] >= tr.LEAST_SEEN
    model = tr.Model(np.array(found)[often], sums[often])
    df = table(spark, [(k, t, str(k)) for k, t in enumerate(texts)], "request_id bigint, text string, channel string").repartition(7)
    got = tuples(tr.cut_values(df, "request_id", "text", "channel", contexts=contexts), "record_id", "cut")
    odds = [tr.log_odds(t, model) for t in texts]
    bins = np.floor(np.array([o for o, t in zip(odds, texts) if isinstance(tr.settle(t), tr.OpenEnd)]) * tr.BINS + 0.5) / tr.BINS
    least = tr.learned_threshold(bins, np.ones(len(bins)))
    assert got == [(k, o > (least if isinstance(tr.settle(t), tr.OpenEnd) else 0)) for k, (o, t) in enumerate(zip(odds, texts))] and 0 < sum(c for _, c in got) < len(texts)


def test_thresholds_follow_the_share_of_cuts():
    ends, cuts = np.full(100, -3.0), np.full(100, 6.0)
    few = tr.learned_threshold(np.r_[ends, cuts[:5]], np.ones(105))
    many = tr.learned_threshold(np.r_[ends[:5], cuts], np.ones(105))
    assert -3 < many < tr.UNKNOWN_ODDS < few < 6
    assert tr.learned_threshold(np.zeros(0), np.zeros(0)) == pytest.approx(tr.UNKNOWN_ODDS)
    # Equal to what each end by itself would give.
    assert tr.learned_threshold(np.array([-3.0, 6.0]), np.array([100.0, 5.0])) == pytest.approx(few)


def test_the_model_finds_cuts_at_letters(spark, corpus):
    """Held-out cuts between two characters, without any mark: the model finds them, and without counts nothing does."""
    texts, whole, cut = corpus
    rows = [(k, t, "s") for k, t in enumerate(texts + whole + cut)]
    df = table(spark, rows, "request_id bigint, text string, channel string")
    first = len(texts) + len(whole)
    found = {i for i, c in tuples(tr.cut_values(df, "request_id", "text", "channel"), "record_id", "cut") if c and i >= first}
    alone = tr.cut_values(df.where(f"request_id >= {len(texts)}"), "request_id", "text", "channel")
    empty = tr.Model(np.zeros(0, np.int64), np.zeros((0, 3), np.int32))
    marks = [t for t in cut if tr.log_odds(t, empty) > tr.UNKNOWN_ODDS + 1e-9]
    assert len(found) >= 0.9 * len(cut) and len(marks) <= 0.5 * len(cut) and alone.count() == len(whole) + len(cut)


def test_open_emphasis_rows_and_quotations():
    empty = tr.Model(np.zeros(0, np.int64), np.zeros((0, 3), np.int32))
    for text in ("**思考", "要点：**质量好", "| 名称 | 值 |\n| 质量 | 好 |\n| 物流", "```\n{\"a\": 1}\n```\n结论：{\"b\": [1"):
        assert tr.log_odds(text, empty) == 9.0, text
    for text in ("**思考**：好。", "| 名称 | 值 |\n| 质量 | 好 |", "5 ** 2 = 25。"):
        assert tr.log_odds(text, empty) == -9.0, text
    assert tr.settle("他说“质量很好").prior == tr.OPEN_QUOTATION and tr.settle("质量很好（物流").prior == tr.OPEN_BRACKET and tr.settle("他说“好”真").prior == 0
