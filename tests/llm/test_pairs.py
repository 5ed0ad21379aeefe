import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import pairs
from reviewloom.llm.truncation import Model

from .helpers import EXTRA

ZH, EN = "用两三句话概括评论要点。", "Sum up the review."
REVIEW = "概括一下：入手 QC8651 这款，声音很刺耳，不过售后一直爽快，包装很精美。"
EMPTY = Model(np.zeros(0, np.int64), np.zeros((0, 3), np.int32))
CASES = [
    (ZH, REVIEW, "买家认为声音刺耳，而售后爽快。", None), (ZH, REVIEW, None, "empty"), (ZH, REVIEW, "```json\n```", "empty"), (ZH, REVIEW, '{"keywords": []}', "empty"), (ZH, REVIEW, "抱歉，我无法完成这个请求。", "refusal"), (EN, "Sum: it is good.", "I must decline to answer this one.", "refusal"),
    (EN, "Sum: it is good.", "We can't change the shipping fee but we can refund 77.", None), (ZH, REVIEW, "我们不能改变运费规则，但可以补一张券。", None), (ZH, REVIEW, REVIEW, "copy"), (ZH, REVIEW, "好的：入手 QC8651 这款，声音很刺耳，，不过售后一直爽快\n包装很精美", "copy"), (ZH, REVIEW, '{"a": ["提到声', "truncated"), (ZH, REVIEW, "对声音的评价是刺耳，", "truncated"),
    (ZH, REVIEW, "The buyer says the noise is unbearable and the support was kind.", "language"), (ZH, REVIEW, "El comprador está contento.", "language"), (ZH, REVIEW, "購入者は満足しています。", "language"), (EN, "Sum: the noise is bad.", "El precio parece justo. La calidad deja dudas.", "language"), (EN, "Sum: the noise is bad.", "Покупатель доволен.", "language"),
    ("把评论译成指定语言，只给译文。", "请翻译成英文：声音很刺耳。", "The noise is unbearable.", None), ("把评论译成指定语言，只给译文。", "请翻译成英文：声音很刺耳。", "买家认为外观大方，物流也很给力。", "language"), ("", "", "好的。", None), (ZH, REVIEW, '{"sentiment": ["提到外观老气", "负向", 0.7]}', None),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[2])[:24])
def test_defects(case):
    assert pairs.defect_of(*case[:3], EMPTY) == case[3]


def test_tiling():
    assert pairs.tiled("abcdefgh", "xxabcdyyefgh", 4) == 8 and pairs.tiled("abc", "abc", 4) == 0 and pairs.tiled("", "abc", 2) == 0
    # A tile is marked on both sides: one passage covers one repeat.
    assert pairs.tiled("abcdef" * 5, "xxabcdefyy", 6) == 6 and pairs.tiled("abcdef" * 5, "abcdef" * 2, 6) == 12
    # The longer of two tiles goes first, and what it leaves is tiled as well.
    assert pairs.tiled("abcdefghijklXmnop", "mnopYabcdefghijkl", 4) == 16


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.integers(2, 6))
def test_tiles_are_disjoint_and_bounded(a, b, least):
    covered = pairs.tiled(a, b, least)
    assert 0 <= covered <= min(len(b), pairs.common_bound(a, b, least))
    shared = any(a[k : k + least] in b for k in range(len(a) - least + 1))
    assert (covered >= least) == shared


def test_tiling_is_linear_on_repetitive_texts():
    def took(n):
        began = time.perf_counter()
        assert pairs.tiled("ab" * n, "ab" * n + "c", 6) == 2 * n
        return time.perf_counter() - began

    assert min(took(40_000) for _ in range(3)) < 8 * max(0.01, min(took(10_000) for _ in range(3)))


REFUSALS = [
    "很抱歉，这个我做不到。", "恕我无法作答。", "对不起，我不能为您翻译这段内容。", "该请求超出了我的处理范围。", "我拒绝回答这类问题。", "这个问题我没办法判断。", "抱歉，我无权评论此事。", "爱莫能助。",
    "Sorry, no.", "I'm afraid I can't assist with that.", "As an AI, I am unable to evaluate reviews.", "I would rather not answer this.", "This request cannot be processed.", "I do not feel comfortable summarizing this.", "It is against my guidelines.",
    "Je suis désolé, je ne peux pas répondre à cette demande.", "Il m'est impossible de traduire ce texte.", "Je refuse de commenter cet avis.", "К сожалению, я не могу помочь с этим.", "Извините, я не могу ответить на этот вопрос.", "Вынужден отказать.",
]
NO_REFUSALS = [
    "如果仍然无法使用，请联系店里换新。", "这款产品不能翻译中文菜单。", "卖家拒绝回复我的问题。", "客服不回复，无法退货。", "质量好，不会再买别家。", "We can't change the shipping fee but we can refund 27.", "I can't recommend this enough!", "The seller refused to answer.",
    "If you cannot answer, call us.", "Je ne regrette pas mon achat.", "La poignée ne tient pas.", "Не понравилась упаковка.", "Не могу нарадоваться покупке.", "屏幕无法显示内容。", "If it still fails we can not help but refund you.",
]


@pytest.mark.parametrize("answer", REFUSALS + NO_REFUSALS)
def test_refusals_that_stand_in_no_table(answer):
    assert pairs.refuses(answer) == (answer in REFUSALS)


def test_languages():
    texts = {"fr": "Le client dit que la poignée est cassée et qu'il est déçu.", "es": "El comprador dice que el sonido es malo.", "de": "Der Kunde ist mit der Lieferung sehr zufrieden.", "pt": "O cliente não está satisfeito com a entrega.", "it": "Il cliente non è soddisfatto della consegna.", "en": "The noise is bad.", "ru": "Покупатель доволен.", "zh": "买家很满意。", "ja": "購入者は満足しています。", "ko": "구매자는 만족합니다."}
    assert {k: pairs.written_in(v) for k, v in texts.items()} == {k: k for k in texts}
    question = "Résume cet avis en une phrase : la poignée est cassée."
    assert pairs.defect_of("", question, "Le client dit que la poignée ne tient pas.", EMPTY) is None
    assert pairs.defect_of("", question, "The client says that the handle is broken.", EMPTY) == "language"


def test_a_text_given_back_twice_is_a_copy():
    text = REVIEW.partition("：")[2]
    assert pairs.gives_back(REVIEW, f"{text}\n{text}") and pairs.gives_back(REVIEW, text * 2)
    assert not pairs.gives_back(REVIEW, "声音很刺耳，" + "但是我们已经改进了这个问题并且补发了一张新的优惠券给您，" * 2)


def test_table(spark):
    schema = "turn_id bigint, messages array<struct<role:string,content:string>>, response struct<content:string,finish_reason:string>"
    rows = [(k, [("system", s), ("user", q)], (a, "stop")) for k, (s, q, a, _) in enumerate(CASES)]
    rows += [(100, None, ("好的。", None)), (101, [("user", None)], None), (102, [], ("", None)), (None, [], None), (0, *rows[0][1:]), (103, [("system", ZH), ("user", REVIEW)], ("长" * 100_000 + "。", "stop"))]
    df = spark.createDataFrame(rows, schema)
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS {name}")
    got = {r["turn_id"]: r["defect"] for r in pairs.defective_pairs(df).collect()}
    assert {k: got.get(k) for k in range(len(CASES))} == {k: c[3] for k, c in enumerate(CASES)}
    assert got[101] == got[102] == "empty" and 100 not in got and 103 not in got
    assert pairs.defective_pairs(df.where("false")).count() == 0
