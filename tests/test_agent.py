import json

from reviewloom.__main__ import main
from reviewloom.operators import agent, sessions
from reviewloom.operators.models import Call, Reply


class Script:
    native_tools = True

    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def complete(self, system, user, seed):
        self.seen.append((user, seed))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r if isinstance(r, Reply) else Reply(r)


def test_agent_calls_tools_until_it_answers():
    call = '<tool_call>{"name": "add", "arguments": {"a": 1, "b": 2}}</tool_call>'
    script = Script("think " + call, '<tool_call>{"name": "none"}</tool_call> <tool_call>{bad}</tool_call>', "done")
    got = agent.run_agent(script, "s", "q", {"add": lambda a, b: a + b})
    assert (got["answer"], got["steps"], got["ended"]) == ("done", 3, "answer")
    assert json.loads(got["results"][0][1])["data"] == 3 and not json.loads(got["results"][1][1])["success"]
    assert agent.run_agent(Script(*[call] * 3), "s", "q", {"add": lambda a, b: 0}, steps=3)["ended"] == "steps"
    assert agent.run_agent(Script(), "s", "q", {}, seconds=-1)["ended"] == "timeout"
    long = Script(*[call] * 9, "end")
    assert agent.run_agent(long, "s", "q", {"add": lambda a, b: "x" * 1900})["answer"] == "end"
    assert max(len(u) for u, _ in long.seen) < 16_000


def test_reflection_loop():
    issue = {"type": "missing", "detail": "d", "severity": "high"}
    revise = json.dumps({"passed": False, "issues": [issue], "add_keywords": [{"keyword": "质量", "score": 0.9}], "remove_keywords": ["差"]})
    got = agent.reflect_until_stable(Script(revise, revise, revise), "t", [{"keyword": "好"}, {"keyword": "差"}], None, rounds=5)
    assert [k["keyword"] for k in got["keywords"]] == ["好", "质量"] and got["rounds"] == 2 and not got["passed"]
    assert agent.reflect_until_stable(Script(ValueError("auth")), "t", [], None)["passed"]
    assert agent.reflect_reply("no object")["passed"]


def test_keyword_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    make = lambda: Script('t {"keywords": []}', ValueError("auth"))
    got = {r["id"]: r for r in agent.keyword_rows(df.coalesce(1), "id", "text", make).collect()}
    assert got[1]["found"] == '{"keywords": []}' and got[2]["found"] is None and got[2]["error"]
    assert agent.ModeProbe().mode(Script("pong")) == "native" and agent.ModeProbe().mode(Script(ValueError("x"))) == "prompt"


def test_sessions(spark, tmp_path):
    for k, day in enumerate(("2024-01-01", "2024-01-02")):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "session_meta.json").write_text(json.dumps({"session_id": f"s{k}", "created_at": day, "total": 1}))
    (tmp_path / "s0" / "result.json").write_text(json.dumps([{"result": {"a": 1}}, {"result_summary": {"b": 2}}]))
    assert [r["session_id"] for r in sessions.saved_sessions(spark, str(tmp_path)).collect()] == ["s1", "s0"]
    assert [(r["n"], r["result"]) for r in sessions.resumed(spark, str(tmp_path / "s0")).orderBy("n").collect()] == [(1, '{"a":1}'), (2, '{"b":2}')]
    log = spark.createDataFrame([("t", 1, "pending", 0, 0, 3), ("t", 3, "completed", 2, 1, 3), ("t", 2, "processing", 1, 0, 3)], "task_id string, seq int, state string, completed int, failed int, total int")
    s = sessions.task_states(log)
    assert s.first()["state"] == "completed" and s.select(sessions.task_progress(*[s[c] for c in ("state", "completed", "failed", "total")])).first()[0] == 1.0
    k = "array<struct<keyword:string>>"
    results = spark.createDataFrame([(1, "长" * 40, [(w,) for w in "abcdef"], ("positive",), 1500.0, None), (2, "短", [], None, 12.0, "bad")], f"index int, original_text string, keywords {k}, sentiment struct<label:string>, elapsed_ms double, error string")
    shown = {r["index"]: r for r in sessions.batch_table(results).collect()}
    assert shown[1]["keywords"] == "a, b, c, d, e" and shown[1]["elapsed"] == "1.5s" and shown[2]["elapsed"] == "12ms" and shown[2]["state"] == "failed"
    assert sessions.response(results).first()["mode"] == "unknown"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.txt").write_text("质量很好，物流很快\n", encoding="utf-8")
    assert main(["analyze", str(tmp_path / "r.txt"), "--out", str(tmp_path / "o")]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 1
    (tmp_path / "t" / "s1").mkdir(parents=True)
    turn = {"seq": 1, "type": "tool_llm", "skill_name": "k", "messages": [{"role": "user", "content": "q"}], "response": {"content": "a"}}
    (tmp_path / "t" / "s1" / "tool_trajectory.jsonl").write_text(json.dumps(turn) + "\n")
    for kind in ("tool-sft", "tool-supervision"):
        assert main(["export", kind, str(tmp_path / "t"), "--out", str(tmp_path / kind)]) == 0
    assert main(["stats", str(tmp_path / "t")]) == 0 and "1" in capsys.readouterr().out


def test_native_calls_and_overflow():
    call = Call("c1", "add", '{"a": 1, "b": 2}')
    script = Script(Reply("", "tool_calls", (call, Call("c2", "add", "not json"))), "done")
    got = agent.run_agent(script, "s", "q", {"add": lambda a=0, b=0: a + b})
    assert [json.loads(b)["data"] for _, b in got["results"]] == [3, 0] and "c1" in script.seen[1][0] and got["trace"][0] == ("thought_and_action", "add,add")
    full = agent.run_agent(Script(ValueError("maximum context length")), "s", "q", {})
    assert full["ended"] == "overflow" and agent.run_agent(Script(ValueError("auth")), "s", "q", {})["ended"] == "error"


def test_agent_over_a_table(spark):
    df = spark.createDataFrame([(1, "质量很好"), (2, None), (3, "ok 没有")], "id int, text string")
    got = {r["id"]: r for r in agent.agent_rows(df, "id", "text").collect()}
    assert [k["keyword"] for k in got[1]["keywords"]] == ["好"] and got[1]["sentiment"]["label"] == "positive" and got[1]["steps"] == 2 and got[1]["analysis_complete"]
    assert got[2]["keywords"] == [] and len(got) == 3 and agent.agent_rows(df.where("id = 9"), "id", "text").count() == 0
    assert [(t["type"]) for t in got[3]["trace"]] == ["thought_and_action", "final_summary"]


class Critic:
    """Proposes one more word of the text a round, one that isn't in it, and one with a low score; fails for some texts."""

    def complete(self, system, user, seed):
        asked = json.loads(user)
        if "坏" in asked["text"]:
            raise ValueError("auth")
        have = {k["keyword"] for k in asked["keywords"]}
        more = [w for w in ("质量", "物流", "包装", "手感") if w in asked["text"] and w not in have][:1]
        add = [{"keyword": w, "score": 0.9} for w in more] + [{"keyword": "不在", "score": 0.9}, {"keyword": "手感", "score": 0.2}]
        return Reply(json.dumps({"passed": False, "add_keywords": add, "remove_keywords": ["外观"]}, ensure_ascii=False))


def test_reflection_over_a_table(spark):
    k = "array<struct<reasoning:string,keyword:string,score:double>>"
    low, kept, gone = ("", "差", 0.1), ("", "价格", 0.95), ("", "外观", 0.8)
    rows = [(1, "质量物流包装手感价格很好很好很好很好很好很好", [low, kept, gone], None), (2, "短", [kept, gone, low], None), (3, "坏坏坏坏", [kept], None), (4, "没有词没有词", None, None), (5, None, [kept], None)]
    df = spark.createDataFrame(rows, f"id int, text string, keywords {k}, sentiment struct<label:string,confidence:double,reasoning:string>")
    got = {r["id"]: r for r in agent.reflect_rows(df, "id", "text", "keywords", "sentiment", Critic).collect()}
    assert [x["keyword"] for x in got[1]["keywords"]] == ["价格", "质量", "物流", "包装", "手感"] and got[1]["rounds"] == 4 and got[1]["passed"]
    assert [x["keyword"] for x in got[2]["keywords"]] == ["价格", "外观"] and got[2]["rounds"] == 0 and got[2]["passed"]
    assert got[3]["rounds"] == 1 and got[3]["passed"] and got[4]["keywords"] == [] and got[4]["rounds"] == 1 and len(got) == 5
    capped = {r["id"]: r for r in agent.reflect_rows(df, "id", "text", "keywords", "sentiment", Critic, rounds=2).collect()}
    assert capped[1]["rounds"] == 2 and len(capped[1]["keywords"]) == 3
