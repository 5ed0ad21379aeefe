from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import extract, lookups, models, profiles, reflect, sessions, training
from reviewloom.plans import catalog, pipeline


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tokens(apply):
    assert apply(extract.tokens_of, "Good 质量好", "", None) == [["good", "质量", "质量好", "量好"], [], None]


def test_bag_holds_the_same_tokens(apply):
    texts = ["Good 质量好呀x质", "", "abc好def一二三四五六 一", "很"]
    assert [sorted(t) for t in apply(extract.bag_of, *texts)] == [sorted(t) for t in apply(extract.tokens_of, *texts)]


def test_tf_idf_by_hand(spark):
    df = spark.createDataFrame([(1, "ab cd ab"), (2, "cd"), (3, "")], "id int, text string")
    got = {(r["doc"], r["token"]): r["weight"] for r in extract.tf_idf(df, "id", "text").collect()}
    assert got[1, "ab"] == pytest.approx(2 / 3 * 1.098612, abs=1e-5) and got[2, "cd"] == pytest.approx(0.405465, abs=1e-5)


def test_graph(spark):
    df = spark.createDataFrame([(1, "aa bb cc aa")], "id int, text string")
    assert rows(extract.cooccurrence(df, "id", "text"), "a", "b", "weight") == [("aa", "bb", 2), ("aa", "cc", 2), ("bb", "cc", 1)]
    ranked = extract.text_rank(df, "id", "text").orderBy("rank").collect()
    assert ranked[0]["token"] == "aa" and ranked[0]["weight"] == 1.0
    assert extract.text_rank(df.where("id = 9"), "id", "text").count() == 0


def test_lexicon(spark):
    df = spark.createDataFrame([(1, "质量很好，物流快")], "id int, text string")
    words = spark.createDataFrame([("质量", "n"), ("物流", "n"), ("很好", "d")], "word string, pos string")
    assert [r["token"] for r in extract.pos_keywords(df, "id", "text", words).orderBy("rank").collect()] == ["质量", "物流"]


def test_whole_lexicon(spark, tmp_path):
    texts = ["这款保温杯质量很好，保温杯也轻", "USB 接口松，wifi 稳定", "性价比高", "", None]
    keys = ["质量", "保温杯", "很不错", "性价比高", "wifi", "USB", "接口", "杯", "扫地机TQ2001"]
    spark.createDataFrame(list(enumerate(texts)), "request_id int, text string").write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame([({k: 1},) for k in keys] + [(None,)], "keyword_counts map<string,int>").write.parquet(f"{tmp_path}/product_profiles.parquet")
    expected = []
    for k, t in enumerate(texts):
        # Every word of two letters or more that the text holds, by its first place: all these keys are tokens but the last.
        places = sorted((t.lower().find(w.lower()), w.lower()) for w in keys if t and len(w) > 1 and w.lower() in t.lower())
        expected += [(k, w, n) for n, (_, w) in enumerate(places, 1)]
    assert rows(catalog.queries()["lexicon_keywords"](spark, str(tmp_path)), "request_id", "token", "rank") == sorted(expected)
    assert {"保温杯", "wifi", "usb", "性价比高"} <= {w for _, w, _ in expected}


@pytest.fixture
def base(spark):
    analyses = spark.createDataFrame([(k, f"r{k % 2}", "p", k, lab) for k, lab in enumerate(["正向", "negative", None, "odd", "positive"])], "analysis_id bigint, reviewer_id string, product_id string, seq bigint, label string")
    words = [(0, "好", 0.9), (0, "快", None), (1, "差", 0.2), (2, "好", 0.4), (4, "好", 0.5), (4, "慢", 0.1), (3, "差", 0.3)]
    keywords = spark.createDataFrame([(a, f"r{a % 2}", "p", a, w, s) for a, w, s in words], "analysis_id bigint, reviewer_id string, product_id string, seq bigint, keyword string, score double")
    return analyses, keywords


def test_profiles(base):
    analyses, keywords = base
    assert rows(profiles.sentiment_distribution(analyses, "product_id"), "positive_count", "negative_count", "neutral_count") == [(2, 1, 1)]
    counts = profiles.product_keywords(keywords)
    assert rows(profiles.top_keywords(counts), "rank", "keyword", "n", "avg_score") == [(1, "好", 3, 0.6), (2, "差", 2, 0.25), (3, "快", 1, 0.5), (4, "慢", 1, 0.1)]
    assert rows(profiles.issues_and_strengths(counts), "polarity", "keyword") == [("issue", "差"), ("strength", "好")]
    assert rows(profiles.sentiment_rates(analyses), "positive_rate", "negative_rate", "neutral_rate") == [(0.4, 0.2, 0.2)]
    assert rows(profiles.delta_keywords(keywords), "analysis_id", "keyword") == [(0, "好"), (0, "快"), (1, "差"), (4, "慢")]
    assert profiles.delta_keywords(keywords, reference=True).count() == 0
    assert ("r0", "positive", "好") in rows(profiles.reviewer_tags(keywords, analyses), "reviewer_id", "polarity", "keyword")
    report = profiles.reviewer_report(analyses, keywords, "r0")
    assert {r["section"] for r in report.collect()} >= {"sentiment", "keyword", "positive_tag"}
    assert profiles.global_summary(analyses).first().asDict() == {"reviewers": 2, "products": 1, "reviews": 5}


def test_tags_fold_with_reentry(spark):
    seen = ["a", "b", "c", "a", "d", "a"]
    events = spark.createDataFrame([("r", "positive", k, w) for k, w in enumerate(seen)], "reviewer_id string, polarity string, seq bigint, keyword string")
    tags: list[str] = []
    for w in seen:
        tags = tags if w in tags else [*tags, w][-3:]
    assert profiles.replayed_tags(events, most=3).first()["tags"] == tags


def test_detail(apply):
    assert [profiles.detail_level is not None] and apply(lambda c: profiles.detail_level(c.cast("int")), None, "4", "5", "20", "21") == ["full", "full", "standard", "standard", "delta"]


MESSAGES = [("system", "s"), ("user", "u1"), ("user", "u2")]


def test_training(spark):
    schema = "session_id string, seq bigint, type string, ts string, skill_name string, messages array<struct<role:string,content:string>>, response struct<content:string,model:string>"
    turns = spark.createDataFrame([("a", 1, "tool_llm", "t", "k", MESSAGES, ("x", "m")), ("a", 2, "tool_llm", "t", None, MESSAGES, ("", "m")), ("b", 1, "tool_llm", "t", "k", None, ("y", "m"))], schema)
    assert training.tool_sft(turns).count() == 1
    assert rows(training.tool_supervision(None, turns), "session_id", "input", "result") == [("a", "u2", ""), ("a", "u2", "x"), ("b", "", "y")]
    runs = spark.createDataFrame([("c", "tool", "{}", "r", "t")], "session_id string, tool_name string, arguments string, result string, ts string")
    assert training.tool_supervision(runs, turns).count() == 4
    assert training.trajectory_stats(turns).first().asDict() == {"sessions": 2, "agent_turns": 0, "tool_turns": 3}
    assert [tuple(r) for r in training.skill_distribution(turns).collect()] == [("k", 2), ("unknown", 1)]


def test_agent_samples(spark):
    agent = [("a", 1, MESSAGES, "draft", True), ("a", 2, None, "final", False), ("b", 1, MESSAGES, "first", True), ("b", 2, MESSAGES, "last", True), ("c", 1, None, "nothing before", False)]
    turns = spark.createDataFrame([(s, n, "agent_llm", m, c, t) for s, n, m, c, t in agent], "session_id string, seq bigint, type string, snapshot array<struct<role:string,content:string>>, content string, has_tool_calls boolean")
    got = training.agent_sft(turns).collect()
    assert sorted((r["session_id"], r["messages"][-1]["content"], len(r["messages"])) for r in got) == [("a", "final", 4), ("b", "last", 4)]


def test_memory(spark):
    m = spark.createDataFrame([("s", k, "tool" if k % 2 else "user", "x" * 5) for k in range(8)], "session_id string, seq bigint, role string, content string")
    compact = training.compact_memory(m)
    assert compact.where(F.col("content") == training.COMPACTED).count() == 2
    assert training.context_chars(m).first()["chars"] == 40
    listed = lambda *ws: '{"keywords": [' + ", ".join(f'["r", "{w}", 0.9]' for w in ws) + "]}"
    told = [("s", 1, "keyword_extract", listed("a")), ("s", 2, "keyword_extract", listed("b", "b")), ("s", 3, "sentiment_analyze", "c"), ("t", 1, "validate", '{"valid_keywords": []}'), ("t", 0, "keyword_extract", listed("x"))]
    told += [("u", 1, "keyword_extract", listed()), ("u", 2, "fallback_extract", listed("f")), ("v", 1, "sentiment_analyze", "c"), ("w", 1, "preprocess", "p"), ("w", 2, "keyword_extract", "broken")]
    got = training.assemble_results(spark.createDataFrame(told, "session_id string, seq bigint, tool string, result string"))
    named = got.withColumn("n", F.array_join(F.transform("final_keywords", lambda k: k["keyword"]), "|"))
    assert rows(named, "session_id", "n", "complete") == [("s", "b", True), ("t", "", False), ("u", "f", True), ("v", "", True), ("w", "", False)]


def test_reflection(spark):
    k = "struct<reasoning:string,keyword:string,score:double>"
    df = spark.createDataFrame([([("", "好", 0.9), ("", "差", 0.3)], ["差"], [("", "质量", 0.8), ("", "好", 0.9)], "质量好")], f"ks array<{k}>, gone array<string>, more array<{k}>, text string")
    names = lambda c: [x["keyword"] for x in df.select(c.alias("v")).first()["v"]]
    assert names(reflect.apply_delta(df["ks"], df["gone"], df["more"])) == ["好", "质量"]
    assert names(reflect.reflect_once(df["ks"], df["more"], df["text"])) == ["好", "质量"]
    issues = spark.createDataFrame([([("a", "d" * 40, "high"), ("b", "x", "low"), ("a", "d" * 40, "high")],)], "i array<struct<type:string,detail:string,severity:string>>")
    assert issues.select(reflect.fingerprints(issues["i"]).alias("f")).first()["f"] == ["a:" + "d" * 30]


def test_lookups(spark):
    words = spark.createDataFrame([("很",), (None,)], "word string")
    ks = spark.createDataFrame([("很",), ("好",), (None,)], "keyword string")
    assert Counter(r[0] for r in lookups.without_words(ks, words).collect()) == Counter(["好", None])
    now = F.lit("2024-01-02").cast("timestamp")
    cache = spark.createDataFrame([("k", "old", "2024-01-01"), ("k", "new", "2024-01-03"), ("k", "newer", "2024-01-04")], "cache_key string, result string, e string").withColumn("expires_at", F.to_timestamp("e"))
    asked = spark.createDataFrame([("k",), ("z",)], "cache_key string")
    assert rows(lookups.with_cache(asked, cache, now).fillna("-"), "cache_key", "cached_result") == [("k", "newer"), ("z", "-")]


class Flaky:
    def __init__(self):
        self.calls = 0

    def complete(self, system, user, seed):
        self.calls += 1
        if user == "bad":
            raise ValueError("auth")
        if self.calls == 1:
            raise TimeoutError("timed out")
        return models.Reply("half", "length") if user == "long" and self.calls == 2 else models.Reply("ok")


def test_models(spark):
    assert models.with_retry(lambda k, b=Flaky(): b.complete("", "x", 1), sleep=lambda s: None).content == "ok"
    with pytest.raises(ValueError):
        models.with_retry(lambda k: Flaky().complete("", "bad", 1), sleep=lambda s: None)
    flaky = Flaky()
    flaky.calls = 1
    assert models.whole_answer(flaky, "", "long", 1).content == "halfok"
    df = spark.createDataFrame([(1, "很好 推荐"), (2, "差 慢"), (3, None)], "id int, text string")
    got = {r["id"]: r["sentiment"]["label"] for r in models.sentiment(df, "id", "text").collect()}
    assert got == {1: "positive", 2: "negative", 3: "neutral"}
    t = spark.createDataFrame([("a {{x}} {{y}}", "1")], "t string, x string")
    assert t.select(models.fill_template(t["t"], x=t["x"])).first()[0] == "a 1 {{y}}"


def test_offline_pipeline(spark):
    df = spark.createDataFrame([(1, "质量很好，物流很快，质量可靠"), (2, "  "), (3, None), (4, "包装破了")], "id int, text string")
    got = {r["id"]: r for r in pipeline.run_offline(df, "id", "text").collect()}
    assert got[1]["analysis_complete"] and got[2]["error"] and got[3]["error"] and got[1]["sentiment"] is None and len(got) == 4
    fast = {r["id"]: r for r in pipeline.run_fast(df, "id", "text").collect()}
    assert fast[1]["sentiment"]["label"] == "positive" and fast[2]["sentiment"]["label"] == "unknown" and fast[2]["error"]
    assert pipeline.TOOLS.names() == ["analyze_fast", "analyze_offline", "fallback_extract", "keyword_extract", "preprocess", "sentiment_analyze", "validate"]
    assert pipeline.TOOLS.run("preprocess", df).count() == 4
    with pytest.raises(KeyError):
        pipeline.TOOLS.run("none", df)


class Spoken:
    """A model that finds the word for quality, fails for texts with a bad word, and is full for long ones."""

    def complete(self, system, user, seed):
        if "坏" in user and not system.startswith(models.SENTIMENT_TASK):
            raise ValueError("auth")
        if system.startswith(models.KEYWORD_TASK):
            return models.Reply('思考 {"keywords": [["r", "质量", 0.9], ["r", "不在文中", 0.9]]}' if "质量" in user else "没有")
        if system.startswith(models.SENTIMENT_TASK):
            return models.Reply("没有" if "物流" in user else '{"sentiment": ["r", "正向", 0.9]}')
        if system.startswith(models.REFLECT_TASK):
            return models.Reply('{"passed": false, "add_keywords": [{"keyword": "做工", "score": 0.8}, {"keyword": "屏幕", "score": 0.9}, {"keyword": "外观", "score": 0.1}], "remove_keywords": []}')
        if "满" in user:
            raise ValueError("maximum context length is 8")
        if "结果]" in user:
            return models.Reply("完成")
        return models.Reply("", "tool_calls", (models.Call("c1", "keyword_extract", "{}"), models.Call("c2", "sentiment_analyze", "bad json"), models.Call("c3", "none", "{}")))


def test_fast_pipeline_falls_back(spark):
    df = spark.createDataFrame([(1, "质量可以"), (2, "物流拖延"), (3, "坏了"), (4, "质量可以"), (5, None)], "id int, text string")
    got = {r["id"]: r for r in pipeline.run_fast(df, "id", "text", Spoken).collect()}
    names = lambda r: [k["keyword"] for k in r["keywords"]]
    assert len(got) == 5 and names(got[1]) == names(got[4]) == ["质量"] and got[1]["source"] == "model" and got[1]["sentiment"]["label"] == "positive"
    assert got[2]["source"] == "fallback" and "物流" in names(got[2]) and got[2]["sentiment"]["label"] == "unknown" and got[3]["source"] == "fallback"
    assert got[5]["source"] is None and got[5]["error"] and got[5]["sentiment"]["label"] == "unknown"
    assert pipeline.run_fast(df.where("false"), "id", "text", Spoken).count() == 0
    batch = pipeline.run_batch(df.withColumn("n", F.col("id") * 10), "text", "n", make=Spoken)
    assert sorted(r["batch_index"] for r in batch.collect()) == [10, 20, 30, 40, 50]


def test_router(spark):
    long = "质量可以，做工一般，" + "就这样吧没有别的了" * 4
    df = spark.createDataFrame([(1, "质量可以", "a"), (2, long, "a"), (3, long + "满", "b"), (4, long + "坏", None)], "id int, text string, reviewer_id string")
    known = spark.createDataFrame([("a", 9)], "reviewer_id string, total_reviews bigint")
    got = {r["id"]: r for r in pipeline.run(df, "id", "text", Spoken, profiles=known, reviewer="reviewer_id").collect()}
    names = lambda r: [k["keyword"] for k in r["keywords"]]
    assert len(got) == 4 and got[1]["mode"] == "fast" and got[2]["mode"] == "agent-prompt" and got[3]["mode"] == "agent-native-fallback-fast" and got[3]["warnings"]
    # One word of the text comes in; what isn't in it or scores low doesn't, and a round without news ends it.
    assert names(got[2]) == ["质量", "做工"] and got[2]["rounds"] == 2 and got[2]["steps"] == 2 and got[2]["sentiment"]["label"] == "positive"
    assert got[4]["error"] and not got[4]["analysis_complete"] and len({r["trace_id"] for r in got.values()}) == 4
    assert [got[k]["detail_level"] for k in (1, 2, 3, 4)] == ["standard", "standard", "full", None]
    offline = pipeline.run(df, "id", "text", Spoken, backend="offline").collect()
    assert {r["mode"] for r in offline} == {"offline"} and {r["mode"] for r in pipeline.run(df, "id", "text", Spoken, fast=True).collect()} == {"fast"}


def test_tokens_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["质量很好", "质量可靠 ok", "物流很快 ok", "好"])], "id int, text string")
    whole = rows(extract.tf_idf(df, "id", "text"), "doc", "token", "weight", "rank")
    monkeypatch.setattr(extract, "MAX_VOCABULARY", 3)
    assert rows(extract.tf_idf(df, "id", "text"), "doc", "token", "weight", "rank") == whole
    given = spark.createDataFrame([(t, float(k)) for k, t in enumerate(sorted({t for _, t, *_ in whole}))], "token string, idf double")
    few = rows(extract.tf_idf(df, "id", "text", idf=given), "doc", "token", "weight", "rank")
    monkeypatch.setattr(extract, "MAX_VOCABULARY", 1_000_000)
    assert rows(extract.tf_idf(df, "id", "text", idf=given), "doc", "token", "weight", "rank") == few


def test_methods(spark):
    df = spark.createDataFrame([(1, "质量很好"), (2, "  "), (3, None)], "id int, text string")
    words = spark.createDataFrame([("质量", "n")], "word string, pos string")
    assert [(r["doc"], [k["keyword"] for k in r["keywords"]]) for r in extract.extract(df, "id", "text", "pos", lexicon=words).collect()] == [(1, ["质量"])]
    assert extract.extract(df, "id", "text", "pos").count() == 0 and extract.extract(df, "id", "text", "unknown").count() == 1


def test_reports_and_details(spark, base):
    analyses, keywords = base
    report = profiles.product_report(analyses, keywords, "p").collect()
    assert [(r["name"], r["count"], r["value"]) for r in report if r["section"] == "sentiment"] == [("positive", 2, 40.0), ("negative", 1, 20.0), ("neutral", 1, 20.0)]
    assert [r["name"] for r in report if r["section"] == "keyword"][0] == "好" and [r["name"] for r in report if r["section"] == "issue"] == ["差"] and [r["name"] for r in report if r["section"] == "strength"] == ["好"]
    assert profiles.product_report(analyses, keywords, "none").count() == 0
    table = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "product_id string")
    assert [r[0] for r in profiles.profile_keys(table, "product_id").collect()] == ["a", "b"]


def test_counters_and_tasks(spark):
    df = spark.createDataFrame([("fast", None), ("fast", "e"), (None, None)], "mode string, error string")
    assert rows(lookups.status_counters(df), "mode", "status", "n") == [("fast", "error", 1), ("fast", "success", 1), ("unknown", "success", 1)]
    assert rows(lookups.tool_counters(df, "mode", F.col("error").isNull()), "tool", "success", "n") == [("fast", False, 1), ("fast", True, 1), ("unknown", True, 1)]
    log = sessions.task_entries(df, "t", 3)
    assert [r["state"] for r in log.orderBy("seq").collect()] == ["pending", "processing", "completed"]
    assert sessions.task_of(log, "t").first().asDict() == {"task_id": "t", "state": "completed", "completed": 2, "failed": 1, "total": 3}
    assert sessions.task_of(log, "u").count() == 0 and sessions.task_entries(df.where("error IS NOT NULL"), "t", 1).where("state = 'failed'").count() == 1
    told = log.withColumn("result", F.when(F.col("seq") == 1, F.lit('{"a": 1}')))
    assert sessions.task_of(told, "t", "a int").first()["result"]["a"] == 1
