import random

from pyspark.sql import functions as F

from reviewloom.functions import keywords as kw
from reviewloom.functions import timex

TRIPLES = "id int, text string, keywords array<struct<reasoning:string,keyword:string,score:double>>"


def brute_span(keyword, text):
    keyword, best = keyword.replace(" ", ""), None
    if not keyword or not text:
        return -1
    for s in (k for k, c in enumerate(text) if c == keyword[0]):
        at = s
        for c in keyword[1:]:
            at = text.find(c, at + 1)
            if at < 0:
                break
        if at >= 0:
            best = min(best or 10**9, at - s + 1)
    return best or -1


def test_span_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("甲乙丙 ", k=rng.randint(0, 4))), "".join(rng.choices("甲乙丙丁", k=rng.randint(0, 14)))) for _ in range(400)]
    rows += [("不粘肉", "衣服不怎么粘肉"), ("没退货", "已经退货")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = df.select("k", "t", kw.min_span(df["k"], df["t"]).alias("s")).collect()
    assert [r["s"] for r in got] == [brute_span(r["k"], r["t"]) for r in got]
    assert [r["s"] for r in got[-2:]] == [5, -1]


def test_time_and_date_keywords(apply):
    words = ["十分", "一点", "百分百", "8.40", "8:40", "上午", "刚才", "质量", "差一刻9点", None]
    assert apply(timex.is_time_keyword, *words) == [True, True, True, True, True, True, True, False, True, False]
    words = ["周末", "Q3", "上旬", "号", "大前天", "五月", "11-15", "月底", "三季度", "口号", "质量"]
    assert apply(timex.is_date_keyword, *words) == [True] * 9 + [False, False]


def lists(spark, *rows):
    return spark.createDataFrame([(k, t, [("r", w, s) for w, s in ks]) for k, (t, ks) in enumerate(rows)], TRIPLES)


def names(df, c):
    return [r["v"] for r in df.select("id", F.transform(c, lambda k: k["keyword"]).alias("v")).orderBy("id").collect()]


def test_post_process(spark):
    text = "这个商品质量好，快递快，包装好，性价比高"
    df = lists(spark, (text, [("质量好", 0.95), ("快递快", 0.9), ("包装好", 0.85), ("质量好", 0.75), ("不存在词", 0.99), (" ", 1.0), ("性价比高", None)]), ("", [("任意词", 0.5)]))
    c = lambda **o: kw.post_process(df["keywords"], df["text"], **o)
    assert names(df, c()) == [["质量好", "快递快", "包装好", "性价比高"], ["任意词"]]
    assert names(df, c(top_n=2))[0] == ["质量好", "快递快"]
    assert names(df, c(min_score=0.88, aligned=False))[0] == ["不存在词", "质量好", "快递快"]
    assert names(df, c(max_length=3, aligned=False))[0] == ["质量好", "快递快", "包装好"]
    assert names(df, c(stopwords=["好"], contained=True))[0] == ["快递快", "性价比高"]


def test_sort_keeps_order_of_ties(spark):
    df = lists(spark, ("", [("a", 0.5), ("b", 0.5), ("c", None), ("d", 0.9)]))
    assert names(df, kw.by_score(df["keywords"])) == [["d", "a", "b", "c"]]


def test_validate_reasons(spark):
    df = lists(spark, ("质量好快递快", [("质量好", 1.0), (" ", 1.0), ("质量好", 0.5), ("质量好快递快呀", 1.0), ("十分", 1.0), ("周末", 1.0), ("感觉", 1.0), ("没退货", 1.0)]))
    v = df.select(kw.validate(df["keywords"], df["text"]).alias("v")).first()["v"]
    assert [k["keyword"] for k in v["valid_keywords"]] == ["质量好"]
    assert [r["reason"] for r in v["removed_keywords"]] == ["blank", "duplicate", "too_long", "time", "date", "stopword", "not_in_text"]
    assert (v["valid_count"], v["removed_count"]) == (1, 7)


def test_normalize(spark):
    raw = '[["r","词",0.9],["词二","0.4"],"bare",["x",5,0.3],["a","b","bad"],["a","b",1,2]]'
    df = spark.createDataFrame([(raw,)], "j string").select(F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>").alias("v"))
    got = df.select(kw.normalize_keywords(df["v"]).alias("k")).first()["k"]
    assert [(k["keyword"], k["score"]) for k in got] == [("词", 0.9), ("词二", 0.4), ("b", 0.5)]
    old = df.select(kw.normalize_keywords(df["v"], old_format=True).alias("k")).first()["k"]
    assert old[0]["keyword"] == "r" and old[0]["score"] == 0.5


def test_small_predicates(apply):
    assert apply(kw.is_retryable, "Rate limit", "HTTP 503", "bad request", None) == [True, True, False, False]
    assert apply(kw.is_context_full, "maximum context length is", "auth") == [True, False]
    assert apply(kw.backend_of, None, "http://localhost:8000", "https://api.openai.com/v1", "https://x.example", "10.1.2.3", "offline", "box") == ["offline", "local_model", "cloud_api", "cloud_api", "local_model", "offline", "local_model"]
    assert apply(kw.minimum_keywords, "短", "长" * 59, "长" * 119, "长" * 120) == [2, 5, 8, 10]
    assert apply(kw.route, "短", "长" * 30) == ["fast", "agent"]


def test_spans_equal_brute_force(spark):
    """The shortest window over all starts, for repetitive texts, exact matches, missing characters, spaces and pictures."""
    import random

    from reviewloom.functions.keywords import min_span

    def brute(kw, text):
        kw, best = kw.replace(" ", ""), -1
        if not kw or not text:
            return -1
        for start in [k for k, c in enumerate(text) if c == kw[0]]:
            at = start
            for c in kw[1:]:
                at = text.find(c, at + 1)
                if at < 0:
                    break
            if at >= 0:
                best = at - start + 1 if best < 0 else min(best, at - start + 1)
        return best

    rng = random.Random(5)
    rows = [("".join(rng.choices("ab好😀", k=rng.randint(0, 4))), "".join(rng.choices("ab好😀c", k=rng.randint(0, 12)))) for _ in range(400)]
    rows += [("不粘肉", "衣服不怎么粘肉"), ("没退货", "已经退货"), ("a b", "ab"), ("", "a"), ("a", ""), (".*", "a.b*")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, kw string, text string")
    got = {r["id"]: r["span"] for r in df.select("id", min_span(df["kw"], df["text"]).alias("span")).collect()}
    assert [got[k] for k in range(len(rows))] == [brute(*r) for r in rows]
