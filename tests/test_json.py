import json

from reviewloom.functions import jsonx


def test_braces():
    assert jsonx.matching_brace('{"a": 1}', 0) == 7
    assert jsonx.matching_brace('x{"k": 1}y', 1) == 8
    assert jsonx.matching_brace('{"a": "}', 0) == -1
    assert jsonx.matching_brace(r'{"a": "\"}"}', 0) == 11


def test_extract():
    assert jsonx.extract('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert jsonx.extract('so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert jsonx.extract("none") is None and jsonx.extract(None) is None
    assert jsonx.extract('{"a":1} tail') == '{"a":1}'


def test_thinking_and_repair():
    found, thinking = jsonx.extract_with_thinking('思考……\n{"keywords": [["r", "词", 0.9]]}')
    assert json.loads(found)["keywords"][0][1] == "词" and thinking == "思考……"
    found, _ = jsonx.extract_with_thinking('{"keywords"：[["r"，"词"，0.9]]}')
    assert json.loads(found)["keywords"] == [["r", "词", 0.9]]
    found, _ = jsonx.extract_with_thinking('{"keywords": [["r1", "kw1", 0.9], ["r2", "kw2", bad_value]]}')
    assert len(json.loads(found)["keywords"]) == 1
    assert len(json.loads(jsonx.repair_truncated('{"keywords": [["r1", "kw1", 0.9], ["r2", "kw2", 0.8],'))["keywords"]) == 2
    assert json.loads(jsonx.repair_truncated('{"keywords": [')) == {"keywords": []}
    assert jsonx.repair_truncated("text") is None


def test_sentiment_shapes():
    assert jsonx.sentiment_of('{"sentiment": [["r", "正向", 0.9]]}') == {"label": "positive", "confidence": 0.9, "reasoning": "r"}
    assert jsonx.sentiment_of('{"sentiment": ["r", "负向", "x"]}')["confidence"] == 0.5
    assert jsonx.sentiment_of('{"sentiment": "mixed"}')["label"] == "mixed"
    assert jsonx.sentiment_of('{"label": "negative", "confidence": 0.7}')["label"] == "negative"
    assert jsonx.sentiment_of("nothing") is None


def test_truncate():
    long = json.dumps({"data": {"thinking": "t" * 3000, "n": 1}})
    assert json.loads(jsonx.truncate_result(long))["data"]["thinking"].startswith("t" * 200)
    assert len(jsonx.truncate_result("x" * 3000)) <= 2048
    assert jsonx.truncate_result("short") == "short"


def test_columns(apply, spark):
    assert apply(jsonx.extract_json, '{"a": 1}', None, "no") == ['{"a": 1}', None, None]
    got = apply(jsonx.parse_sentiment, '{"sentiment": ["r", "中立", 0.5]}', None)
    assert got[0]["label"] == "neutral" and got[1]["label"] is None
    calls = apply(jsonx.tool_calls, 'a <tool_call>{"name": "x", "arguments": {"k": 1}}</tool_call> <tool_call>{bad}</tool_call>', "none")
    assert [c["name"] for c in calls[0]] == ["x"] and calls[1] == []
    assert apply(jsonx.without_tool_calls, 'a <tool_call>{"name": "x"}</tool_call>') == ["a"]
    assert [b["tool"] for b in apply(jsonx.result_blocks, '[工具 x 结果]\n{"a": 1}\n[工具 y 结果]\n{"b": 2}')[0]] == ["x", "y"]
    got = apply(lambda c: jsonx.keyword_object(c), 't {"keywords": []}', None)
    assert got[0]["thinking"] == "t" and got[1]["json"] is None
