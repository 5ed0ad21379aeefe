import re
import unicodedata

from reviewloom.functions import clean, timex

TEXTS = [
    "看这里 http://x.cn/a?b=1 和 www.shop.test/p 好", "发到 a.b+c@mail.example 吧", "邮箱ab@c.example没人理", "电话13800138000，还有213800138000123", "好😀评🎉👨‍👩‍👧", "锟​斤拷ok烫烫烫�️", "→☆™®好", "２０２４年", "一\r\n二\t三\x0b四", "Hello你好 123，。“引”", "真的!!!好。。。～～～", " a 　 b\n\nc ", "", "&amp;&copy;&nbsp;好&quot;", "a\x01b‍c", "价格8.40元，8:40到，十分满意，一点不差", "2024年11月10日买的，星期一到，大前天，紧接着",
]


def python(fn):
    return [fn(t) for t in TEXTS]


def test_cleaners_equal_python(apply):
    assert apply(clean.remove_urls, *TEXTS) == python(lambda t: re.sub(r"www\.\S+", "", re.sub(r"https?://\S+|ftp://\S+", "", t)))
    assert apply(clean.remove_emails, *TEXTS) == python(lambda t: re.sub(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "", t))
    assert apply(clean.remove_phone_numbers, *TEXTS) == python(lambda t: re.sub(r"1[3-9]\d{9}", "", t))
    assert apply(clean.squeeze_space, *TEXTS) == python(lambda t: re.sub(r"\s+", " ", t).strip())
    assert apply(clean.remove_latin, *TEXTS) == python(lambda t: re.sub("[a-zA-Z]+", "", t))
    assert apply(clean.remove_control, *TEXTS) == python(lambda t: "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\r\t"))
    assert apply(clean.remove_line_breaks, *TEXTS) == python(lambda t: t.translate(dict.fromkeys(map(ord, "\r\n\t\x0b\x0c"))))
    assert apply(clean.collapse_punctuation, *TEXTS) == python(lambda t: re.sub("([" + re.escape(clean.COLLAPSED) + r"])\1+", r"\1", t))


def test_sets_of_characters(apply):
    assert apply(clean.remove_emojis, "好😀评🎉") == ["好评"]
    assert apply(clean.remove_garbled, "锟​斤拷ok烫烫烫�️") == ["ok"]
    assert apply(clean.remove_special_symbols, "→☆™®好$￥") == ["好$￥"]
    assert apply(clean.normalize_numbers, "２０２４") == ["2024"]
    assert apply(clean.keep_chinese_only, "Hello你好 12３，。“引”!") == ["你好 12３，。引"]
    assert apply(clean.unescape_entities, "&amp;&copy;&nbsp;好&quot;") == ["&©\xa0好\""]
    assert apply(clean.unescape_html, "&amp;&eacute;", None) == ["&é", None]


def test_time_and_date_deletion(apply):
    cases = {"8:40到": "到", "8点半": "半", "8.40元": "元", "十分满意": "满意", "上午好": "好", "紧接着走": "紧走", "18.405": "18.405"}
    assert apply(timex.remove_time_expressions, *cases) == list(cases.values())
    cases = {"2024年11月10日买": "买", "星期一到": "星到", "大前天": "大", "第三天": "", "三天前": ""}
    assert apply(timex.remove_date_expressions, *cases) == list(cases.values())
    assert apply(lambda c: timex.remove_dates(c, strict=True), "星期一到", "大前天来", "紧接着走") == ["到", "来", "走"]


def test_pipelines(apply):
    got = apply(clean.preprocess_tool, "看  http://x.cn 好!!!", "a" * 600, None)
    assert got == ["看 http:/x.cn 好!", "a" * 512, None]
    assert apply(lambda c: clean.preprocess_tool(c, strict=True), "看  http://x.cn 好!!!") == ["看 好!"]
    assert apply(clean.preprocess_comment, "Hi 昨天 很好！！ok") == ["很好！！"]
    assert apply(lambda c: clean.preprocess_comment(c, strict=True), "很好！！") == ["很好！"]
    got = apply(clean.preprocess_result, "  ", "好的", None)
    assert [r["success"] for r in got] == [False, True, False] and got[1]["cleaned_length"] == 2 and got[0]["error"]
