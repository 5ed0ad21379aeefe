import json

import pytest
from pyspark.sql import functions as F

from reviewloom.__main__ import main
from reviewloom.operators import sessions, training
from reviewloom.sources import readers, writers
from reviewloom.streaming import streams


def texts(df):
    return sorted(r[0] for r in df.collect())


def test_review_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 好评 \n\n　\n差评\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text('id,review_text\n1,好评\n2,"  "\n3,"一\n二"\n', encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"text": "好"}, {"text": 5}, "x", {"text": " "}], ensure_ascii=False), encoding="utf-8")
    assert texts(readers.read_reviews(spark, str(tmp_path / "a.txt"))) == ["好评", "差评"]
    assert texts(readers.read_reviews(spark, str(tmp_path / "a.csv"), column="review_text")) == ["一\n二", "好评"]
    assert texts(readers.read_reviews(spark, str(tmp_path / "a.json"), field="text")) == ["好"]
    for bad in ({"column": "none"}, {}):
        with pytest.raises(readers.ReadError):
            readers.read_reviews(spark, str(tmp_path / "a.csv"), **bad)
    with pytest.raises(readers.ReadError):
        readers.read_reviews(spark, "a.xml")
    (tmp_path / "b.txt").write_text("\n", encoding="utf-8")
    with pytest.raises(readers.ReadError):
        readers.read_reviews(spark, str(tmp_path / "b.txt"))


def test_sessions(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "tool_trajectory.jsonl").write_text('{"seq": 1, "type": "tool_llm"}\nbroken\n\n', encoding="utf-8")
    turns = readers.read_sessions(spark, str(tmp_path))
    assert [r[0] for r in readers.list_sessions(turns).collect()] == ["s1", "s2"] and turns.count() == 2


def test_dictionary_template_settings(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n很\n\n很\n 还 \n", encoding="utf-8")
    assert texts(readers.read_dictionary(spark, str(tmp_path / "w.txt"))) == ["很", "还"]
    text = "---\nname: n\ndescription: d\n---\n## system\na {{x}}\n## rules\nb\n## user\n{{y}}\n"
    t = readers.parse_template(text)
    assert (t.name, t.variables) == ("n", ("x", "y")) and "## rules" in t.system
    assert readers.parse_template(text, strict=False).system == "a {{x}}"
    assert readers.render(t, x="1", y="2")[1] == "2"
    with pytest.raises(ValueError):
        readers.render(t, x="1")
    (tmp_path / "c").write_text("top_n: 3\nthreshold: bad\nstrict: yes\n", encoding="utf-8")
    s = readers.load_settings(str(tmp_path / "c"), {"REVIEWLOOM_TOP_N": "4"})
    assert (s.top_n, s.threshold, s.strict) == (4, 0.7, True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "session_id string, n int")
    assert writers.export(df, str(tmp_path / "o"), []) == 2
    assert writers.export(df, str(tmp_path / "o"), ["a"]) == 1
    line = next(p for p in (tmp_path / "o").glob("part-*") if p.stat().st_size).read_text()
    assert '"n":null' in line
    merged = writers.merge_counts(df.fillna(0), df.fillna(5), ["session_id"], ["n"])
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 5), ("b", 2)]
    cached = writers.cache_rows(df, F.col("session_id"), F.current_timestamp())
    assert cached.where(F.col("expires_at") > F.current_timestamp()).count() == 2


def test_streams_equal_batch(spark, tmp_path):
    items = spark.createDataFrame([("p", "好", 0.5, k) for k in range(20)] + [("q", "差", float("nan"), 20), (None, "x", 0.1, 21)], "product_id string, keyword string, score double, item_id bigint").repartition(4)
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_available(streams.product_counts(stream), "counts", str(tmp_path / "c1")).stop()
    expected = sorted(map(tuple, streams.product_counts(items).collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == expected


def test_reviewer_state(spark, tmp_path):
    rows = [("r", k, w) for k, w in enumerate(["a", "b", "a", "c"])]
    df = spark.createDataFrame(rows, "reviewer_id string, seq bigint, keyword string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.reviewer_state(stream, most=2), "tags", str(tmp_path / "c2"), "update").stop()
    got = spark.table("tags").collect()
    assert got[-1]["total"] == 4 and list(got[-1]["tags"]) == ["b", "c"]


def test_windows_and_events(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.event_windows(stream), "windows", str(tmp_path / "c3")).stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streams.event_windows(df).collect()))
    results = spark.createDataFrame([(1, "t", "k", True, "fast")], "id int, cleaned_text string, keywords string, analysis_complete boolean, mode string")
    told = [(r["type"], r["step"]) for r in streams.analysis_events(results, "id").orderBy("seq").collect()]
    assert told == [("start", None), *[(t, s) for s in streams.STEPS["fast"] for t in ("step_start", "step_done")], ("result", None), ("done", None)]
    lines = [r["value"] for r in streams.sse_lines(streams.analysis_events(results, "id"), "id").orderBy("seq").collect()]
    assert lines[0] == "event: start\ndata: {}\n\n" and lines[1] == 'event: step_start\ndata: {"step":"preprocess"}\n\n'
    failed = results.selectExpr("*", "'timeout' AS error")
    assert [r["type"] for r in streams.analysis_events(failed, "id").orderBy("seq").collect()] == ["start", "error", "done"]
    results.write.parquet(str(tmp_path / "results"))
    live = spark.readStream.schema(results.schema).parquet(str(tmp_path / "results"))
    streams.run_available(streams.analysis_events(live, "id"), "told", str(tmp_path / "c4"), "append").stop()
    assert sorted((r["seq"], r["type"]) for r in spark.table("told").collect()) == [(k, t) for k, (t, _) in enumerate(told, 1)]


def test_agent_events_and_deltas(spark):
    rows = spark.createDataFrame([(1, [("thought_and_action", "a"), ("final_summary", "b")], 2, ["k"], "s")], "id int, trace array<struct<type:string,content:string>>, rounds int, keywords array<string>, sentiment string")
    got = [(r["seq"], r["type"], r["content"]) for r in streams.agent_events(rows, "id").orderBy("seq").collect()]
    assert [t for _, t, _ in got] == ["start", "thought_and_action", "final_summary", "reflection_supplement", "reflection_supplement", "result", "done"] and got[4][2] == "2"
    parts = [("m", 2, 0, None, None, "1}"), ("m", 1, 0, "c1", "add", '{"a":'), ("m", 1, 1, "c2", "none", None), ("n", 1, 0, "c3", "x", "{}")]
    df = spark.createDataFrame(parts, "message_id string, seq int, index int, id string, name string, arguments string")
    assert sorted(map(tuple, streams.merged_deltas(df).collect())) == [("m", 0, "c1", "add", '{"a":1}'), ("m", 1, "c2", "none", ""), ("n", 0, "c3", "x", "{}")]


def test_reading_agents_and_rejects(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    call = {"id": "c1", "type": "function", "function": {"name": "add", "arguments": "{}"}}
    turns = [{"seq": 1, "type": "agent_llm", "messages_snapshot": [{"role": "user", "content": "q"}], "response": {"content": "", "tool_calls": [call]}}, {"seq": 2, "type": "tool_execution", "tool_name": "add", "tool_call_id": "c1", "arguments": "{}", "result": "3", "timestamp": "t"}]
    turns.append({"seq": 3, "type": "agent_llm", "messages_snapshot": [{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [call]}, {"role": "tool", "content": "3", "tool_call_id": "c1"}], "response": {"content": "done"}})
    (tmp_path / "s1" / readers.AGENT_FILE).write_text("\n".join(map(json.dumps, turns)) + "\nbroken\n\n")
    agent = readers.read_agent_sessions(spark, str(tmp_path))
    (sample,) = training.agent_sft(training.agent_turns(agent)).collect()
    assert sample["session_id"] == "s1" and [m["role"] for m in sample["messages"]] == ["user", "assistant", "tool", "assistant"] and sample["messages"][1]["tool_calls"][0]["id"] == "c1" and sample["messages"][-1]["content"] == "done"
    assert [(r["tool_call_id"], r["result"]) for r in training.call_results(agent).collect()] == [("c1", "3")]
    assert [r["value"] for r in readers.rejected_lines(spark, str(tmp_path / "s1" / readers.AGENT_FILE), readers.AGENT_TURN).collect()] == ["broken"]
    assert main(["export", "openai", str(tmp_path), "--out", str(tmp_path / "out")]) == 0 and spark.read.json(str(tmp_path / "out")).count() == 1
    assert main(["export", "tool-supervision", str(tmp_path), "--out", str(tmp_path / "out2")]) == 0 and spark.read.json(str(tmp_path / "out2")).first()["result"] == "3"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.skill.md").write_text("---\ndescription: d\n---\n## system\nyou\n## user\n{{x}}\n")
    assert readers.read_templates(spark, str(tmp_path / "p"))["a"].variables == ("x",)


def test_settings_in_sections(tmp_path, monkeypatch):
    (tmp_path / "reviewloom.yaml").write_text("# all\npreprocess:\n  max_length: 99  # cut\npostprocess:\n  max_length: 4\n  top_n: 'x'\n  min_score: 0.5\nreflection:\n  threshold: 0.8\nstrict: yes\nmethod: textrank\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    path = readers.find_settings(str(tmp_path / "a" / "b"))
    s = readers.load_settings(path, {"REVIEWLOOM_ROUNDS": "2"})
    assert (s.max_length, s.keyword_length, s.top_n, s.min_score, s.threshold, s.strict, s.method, s.rounds) == (99, 4, 8, 0.5, 0.8, True, "textrank", 2)
    (tmp_path / ".env").write_text("export REVIEWLOOM_TOP_N=3\nOTHER=1\n")
    assert readers.load_settings(str(tmp_path / ".env"), {}).top_n == 3


def test_sessions_are_written_and_found(spark, tmp_path):
    results = spark.createDataFrame([("s", k, "字" * 60, f"t{k}", True, "fast", 1.0) for k in (1, 2)], "session_id string, index bigint, original_text string, timestamp string, analysis_complete boolean, mode string, elapsed_ms double")
    known = spark.createDataFrame([("s", "2024"), ("u", "2023")], "session_id string, created_at string")
    meta = {r["session_id"]: r for r in writers.session_meta(results, known).collect()}
    assert meta["s"]["total"] == 2 and len(meta["s"]["history_summary"][0]["text_preview"]) == 50 and meta["u"]["total"] == 0 and meta["u"]["history_summary"] == []
    for k in (1, 2):
        writers.append_results(results.where(f"index = {k}"), str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r"))
    assert back.count() == 2 and set(back.columns) == {"index", "text", "timestamp", "result_summary"} and set(back.select("result_summary.*").columns) == {"analysis_complete", "elapsed_ms", "mode"}
    changes = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n bigint")
    for _ in range(2):
        writers.upsert_counts(spark, str(tmp_path / "counts"), changes, ["k"], ["n"])
    (tmp_path / "counts" / "v9").mkdir()  # a write that didn't end
    assert sorted(map(tuple, writers.current_counts(spark, str(tmp_path / "counts")).collect())) == [("a", 8), ("b", 4)]


def test_json_arrays_over_many_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"text": "好评", "id": 1}, {"text": 5}, {"text": " "}, "x", {"text": " 差评 "}], indent=2, ensure_ascii=False), encoding="utf-8")
    assert sorted(r["text"] for r in readers.read_reviews(spark, str(tmp_path / "r.json"), field="text").collect()) == ["好评", "差评"]
    (tmp_path / "s").mkdir()
    for name, records in (("result.json", [{"result": {"a": 1}}, {"result_summary": {"b": 2}}]), ("result_2.json", {"c": 3})):
        (tmp_path / "s" / name).write_text(json.dumps(records, indent=2))
    assert [(r["n"], r["result"]) for r in sessions.resumed(spark, str(tmp_path / "s")).orderBy("n").collect()] == [(1, '{"a":1}'), (2, '{"b":2}'), (3, '{"c":3}')]


def test_reports_from_the_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "r", "p", 1, "positive")], "analysis_id bigint, reviewer_id string, product_id string, seq bigint, label string").write.parquet(f"{tmp_path}/analyses.parquet")
    spark.createDataFrame([(1, "r", "p", 1, "质量", 0.9)], "analysis_id bigint, reviewer_id string, product_id string, seq bigint, keyword string, score double").write.parquet(f"{tmp_path}/keywords.parquet")
    for kind, key in (("reviewer", "r"), ("product", "p")):
        assert main([kind, key, str(tmp_path)]) == 0 and "质量" in capsys.readouterr().out
    assert main(["product", "none", str(tmp_path)]) == 1
    spark.createDataFrame([("好评", [("质量", 0.9)], ("positive",))], "original_text string, keywords array<struct<keyword:string,score:double>>, sentiment struct<label:string>").write.json(f"{tmp_path}/results")
    assert main(["history", f"{tmp_path}/results"]) == 0 and "positive" in capsys.readouterr().out
