import json

import pytest

from chronolith.functions.jsontext import _parse_deep, parse, written
from chronolith.operators.nested import flatten_objects, flatten_tables


def unwrap(v):
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return v


def brute(id_, text):
    out = []

    def go(v, path, item, element):
        v = unwrap(v)
        if isinstance(v, dict):
            if element:
                out.append((id_, path, item))
                item = path
            for k, x in v.items():
                go(x, f"{path}.{k}" if path else k, item, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", item, True)

    go(text, "", "", False)
    return out


CASES = [
    '{"a":' * 60 + '[{"b":[[{"c":1}]]}]' + "}" * 60,
    json.dumps(json.dumps([{"x": json.dumps([{"y": []}, json.dumps(json.dumps([{}]))])}])),
    '{"a":[{"x":1}]} trailing', "[1] [2]", '{"a":[{}],"a":[{},{}]}', "", " ", "null", "12", '"plain"', '"[{}]"', ' \n[{"a.b":[{}],"c[0]":[{}]}]',
    '[{"k":"[{}, 1"},{"v":[{}]}]', '{"a":[{}]}}', "[" * 40 + "{}" + "]" * 40, '{"a":[null,true,{"b":null}]}', '{"kind": ', "[" + ",".join(['{"x":[{}]}'] * 500) + "]",
]


def test_matches_brute_force(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate(CASES)] + [(98, None, "", ""), (99, CASES[0], "", ""), (99, CASES[0], "", "")]
    got = sorted(tuple(r) for r in flatten_objects(spark.createDataFrame(rows, "id long, payload string, item_path string, t string")).collect())
    assert got == sorted(x for i, t, *_ in rows if t is not None for x in brute(i, t))


def test_values_and_empty(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":1},{"c":[{"d":"x"}]}]}')], "id long, payload string")
    got = {r["item_path"]: json.loads(r["object"]) for r in flatten_objects(df, values=True).collect()}
    assert got == {"a[0]": {"b": 1}, "a[1]": {"c": [{"d": "x"}]}, "a[1].c[0]": {"d": "x"}}
    assert flatten_objects(df.filter("false")).count() == 0


def test_plan_has_no_shuffle_and_one_inline(spark):
    df = spark.createDataFrame([(1, "[]")], "id long, payload string")
    plan = flatten_objects(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1


def deep(n):
    return '{"a":[' * n + "1" + "]}" * n


def test_deeper_than_the_parser_goes(spark):
    texts = [deep(499), deep(600), json.dumps({"k": deep(700)}), '{"a":[' * 600, deep(600) + "x", deep(1500), '[{"x":' * 1100 + "[{}]" + "}]" * 1100]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    got = {r["event_id"]: r["count"] for r in flatten_objects(df).groupBy("event_id").count().collect()}
    assert got == {0: 498, 1: 599, 2: 699, 5: 1499, 6: 1101}
    rows = flatten_objects(df.filter("id = 2"), values=True).collect()
    assert max(rows, key=lambda r: len(r["item_path"]))["object"] == '{"a":[1]}'


def test_many_elements_are_linear(spark):
    import time

    df = spark.createDataFrame([(1, json.dumps({"a": [{"b": i} for i in range(100_000)]}))], "id long, payload string")
    began = time.time()
    assert flatten_objects(df).count() == 100_000
    assert time.time() - began < 60


def test_related_tables(spark):
    text = json.dumps({"a": [{"x": 1, "s": "t", "b": [{"y": 1.5, "ok": True}, {"y": "no", "z": None}]}, {"x": "7", "b": {"y": 3}}]})
    rows = [(1, text), (2, json.dumps({"k": deep(600), "a": [{"x": 9, "b": [{"y": 2, "ok": False}]}]})), (3, None), (4, "[")]
    spec = {"a": ("a[]", {"x": "bigint", "s": "string", "b": "string"}), "b": ("a[].b[]", {"y": "double", "ok": "boolean", "z": "string"})}
    out = flatten_tables(spark.createDataFrame(rows, "id long, payload string"), spec)
    assert sorted(map(tuple, out["a"].collect())) == [(1, "a[0]", "", 0, 1, "t", None), (1, "a[1]", "", 1, 7, None, None), (2, "a[0]", "", 0, 9, None, None)]
    assert sorted(map(tuple, out["b"].collect())) == [(1, "a[0].b[0]", "a[0]", 0, 1.5, True, None), (1, "a[0].b[1]", "a[0]", 1, None, None, None), (2, "a[0].b[0]", "a[0]", 0, 2.0, False, None)]
    assert flatten_tables(spark.createDataFrame([], "id long, payload string"), spec)["a"].count() == 0


def test_parser_keeps_to_the_grammar():
    for text in ["[1,]", "{,}", '{"a" 1}', "[1 2]", "nul", "[NaN]", "01", '"a', "", "{} {}", '["\\x"]', "[" * 2000, "]", '{"a":1,}', "-", "[1.]"]:
        for f in (parse, _parse_deep):
            with pytest.raises(ValueError):
                f(text)
    for text in ['{"a":[1,2.50,{"b":null}],"a":3,"c":{}}', ' [ ] ', '"x"', "1e5", "true", '[[],[{}],"\\u00e9"]']:
        assert parse(text) == _parse_deep(text)
    assert written(parse('{"a":[1,2.50,{"b":null}],"c":"é"}')) == '{"a":[1,2.50,{"b":null}],"c":"é"}'


def test_brackets_and_quotes_written_as_escapes(spark):
    escape = lambda s: "".join(f"\\u{ord(c):04x}" if c in '[]{}"\\' else c for c in s)
    once = '"' + escape("[" * 40 + '{"a":[{"b":1}]}' + "]" * 40) + '"'
    again = '[{"a":1}]'
    for _ in range(6):  # each round one array and one string, with no bracket to be seen
        again = '"' + escape(f"[{again}]") + '"'
    rows = [(1, once), (2, again), (3, once.replace("\\u005b", "\\u005B"))]
    want = sorted(x for id_, text in rows for x in brute(id_, text))
    assert len(want) == 5
    assert sorted(map(tuple, flatten_objects(spark.createDataFrame(rows, "id long, payload string")).collect())) == want
