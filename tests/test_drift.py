import datetime as dt
import json

from chronolith.operators import drift

FILES = "file_id long, file_name string, producer string, exported_at timestamp, n_lines int"


def make(spark, files):
    """files: (file_id, producer, [record or text])."""
    t0 = dt.datetime(2020, 1, 1)
    f = spark.createDataFrame([(i, f"f{i}", p, t0 + dt.timedelta(days=n), 0) for n, (i, p, _) in enumerate(files)], FILES)
    lines = [(i, n, r if isinstance(r, str) or r is None else json.dumps(r)) for i, _, rs in files for n, r in enumerate(rs)]
    rows = drift.lines(spark.createDataFrame(lines, "file_id long, line_no int, record string")).cache()
    schema = drift.field_types(rows)
    return rows, schema, drift.versions(schema, f)


def span(n, **fields):
    return {"trace_id": "t", "span_id": f"s{n}"} | fields


def changes(spark, files):
    return {tuple(r) for r in drift.changes(*make(spark, files)).select("file_id", "change_kind", "field_path", "new_path").collect()}


def test_renamed_removed_added_retyped(spark):
    files = [
        (7, "p", [span(1, a=1, gone="x", num=1, q={"z": True}), span(2, a=2, num=2, q={"z": False})]),
        (3, "p", [span(1, b=1, num=1.5, q={"y": True}), span(2, b=2, fresh=[1], num=2, q={"y": False}), "# end", "", None, "[1]", '{"trace_id":"t"} x']),
        (5, "other", [span(1, k=1)]),
    ]
    assert changes(spark, files) == {(3, "renamed", "a", "b"), (3, "removed", "gone", ""), (3, "added", "fresh", ""), (3, "retyped", "num", ""), (3, "renamed", "q.z", "q.y")}


def test_no_rename_if_values_differ_types_differ_or_no_span_is_shared(spark):
    assert changes(spark, [(1, "p", [span(1, a=1), span(2, a=2)]), (2, "p", [span(1, b=1), span(2, b=3)])]) == {(2, "removed", "a", ""), (2, "added", "b", "")}
    assert changes(spark, [(1, "p", [span(1, a=1)]), (2, "p", [span(1, b="1")])]) == {(2, "removed", "a", ""), (2, "added", "b", "")}
    assert changes(spark, [(1, "p", [span(1, a=1)]), (2, "p", [span(9, b=1)])]) == {(2, "removed", "a", ""), (2, "added", "b", "")}


def test_nulls_are_absent_and_missing_ids_are_allowed(spark):
    files = [(1, "p", [span(1, a=None, c="v"), span(2, a="w"), {"a": "u", "span_id": "s"}]), (2, "p", [span(1, b=None, c="v"), span(2, b="w"), span(3, b="z")])]
    assert changes(spark, files) == {(2, "renamed", "a", "b")}


def test_numbers_compare_by_value_and_types_mix(spark):
    rows, schema, _ = make(spark, [(1, "p", [span(1, a=2.0, b=10**25, c=1, d="x"), span(2, a=2, c=1.5, d=True)])])
    types = {r["field_path"]: r["type"] for r in schema.collect()}
    assert types == {"trace_id": "string", "span_id": "string", "a": "fraction", "b": "whole", "c": "fraction", "d": "boolean"}
    assert {x["text"] for r in rows.collect() for x in r["leaf"] if x["path"] == "a"} == {"2"}
    assert changes(spark, [(1, "p", [span(1, a=2.0, z=0.5)]), (2, "p", [span(1, b=2.0, z=0.5)]), (3, "p", [span(1, c="2.0", z=0.5)])]) == {(2, "renamed", "a", "b"), (3, "removed", "b", ""), (3, "added", "c", "")}


def test_very_deep_and_odd_records(spark):
    deep = '{"trace_id":"t","span_id":"s","a":' + '{"b":' * 1500 + "1" + "}" * 1501
    rows, schema, _ = make(spark, [(1, "p", [deep, '{"a":"\\ud800","k":[1,{"x":null}]}', '{"a":1,"a":2}', '{"a":NaN}', '  {"z":1e400}'])])
    got = {(r["line_no"], x["path"][-3:], x["type"], x["text"]) for r in rows.collect() for x in r["leaf"]}
    assert (0, "b.b", "whole", "1") in got and (1, "k", "array", '[1,{"x":null}]') in got and (2, "a", "whole", "2") in got and {x[0] for x in got} == {0, 1, 2, 4}


def test_equal_fingerprints_are_not_compared_and_share_their_steps(spark):
    files = [(1, "p", [span(1, a=1)]), (2, "p", [span(1, a=2)]), (3, "p", [span(1, b=2)]), (4, "q", [span(5, b=3)]), (5, "q", [])]
    rows, schema, version = make(spark, files)
    v = {r["file_id"]: r for r in version.collect()}
    assert v[1]["fingerprint"] == v[2]["fingerprint"] != v[3]["fingerprint"] == v[4]["fingerprint"] and v[5]["n_fields"] == 0
    change = drift.changes(rows, schema, version)
    out = {tuple(r) for r in drift.migrations(change, version).select("producer", "from_version", "to_version", "op", "field_path", "new_path").collect()}
    assert out == {("p", 2, 3, "rename", "a", "b"), *(("q", 1, 2, "drop", f, "") for f in ("b", "trace_id", "span_id"))}
    step = drift.steps(schema, version, change)
    assert step.count() == 3 * 3
    assert {(r["op"], r["source_path"]) for r in step.filter("field = 'a'").collect()} == {("keep", "a"), ("rename", "b"), ("default", None)}
    wide = drift.wide_table(rows, version, step)
    assert wide.columns == ["file_id", "line_no", "producer", "a", "span_id", "trace_id"]
    assert sorted((r["file_id"], int(r["a"])) for r in wide.collect()) == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_chained_renames(spark):
    names = ["a", "b", "c", "d", "e"]
    rows = one_table(spark, [(i, "p", [span(1, **{n: 4}), span(2, **{n: 5})]) for i, n in enumerate(names)])
    found = [r for r in rows if r["value"] in ("4", "5")]
    assert len(found) == 10 and len({r["field"] for r in found}) == 1


def one_table(spark, files):
    rows, schema, version = make(spark, files)
    return drift.one_table(rows, version, drift.steps(schema, version, drift.changes(rows, schema, version))).collect()


def test_one_table_over_all_producers(spark):
    files = [
        (1, "p", [span(1, kind="a", status=5), span(2, kind="b", status=6)]),
        (2, "p", [span(1, spanKind="a", status=5), span(2, spanKind="b", status=6)]),
        (3, "q", [span(7, spanKind="c", status='x "y"', num=1), {}, {"num": None}, "# no record"]),
        (4, "q", [span(8, kind="d", status=[1, "1"], num=2.5, flag=True, big=2**70)]),
        (9, "r", [span(9, kind="e", num=2**53 + 1)]),
    ]
    rows = one_table(spark, files)
    at = {(r["file_id"], r["line_no"], r["field"]): r for r in rows}
    fields = {"trace_id", "span_id", "kind", "status", "num", "flag", "big"}
    records = {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0), (9, 0)}
    assert len(rows) == len(at) and set(at) == {(*r, f) for r in records for f in fields}
    assert len({(r["field"], r["type"]) for r in rows}) == len(fields)
    assert [at[i, 0, "kind"]["value"] for i in (1, 2, 3, 4, 9)] == ["a", "a", "c", "d", "e"]  # renamed at p, so one field at q too
    assert [at[i, 0, "status"]["value"] for i in (1, 3, 4)] == ["5", 'x "y"', '[1,"1"]'] and at[1, 0, "status"]["typed"]["string"] == "5"
    assert at[3, 0, "num"]["typed"]["fraction"] == 1.0 and at[4, 0, "num"]["typed"]["fraction"] == 2.5 and at[3, 0, "num"]["ok"]
    assert not at[9, 0, "num"]["ok"] and at[9, 0, "num"]["source_text"] == str(2**53 + 1)
    assert at[4, 0, "flag"]["typed"]["boolean"] is True and at[4, 0, "big"]["typed"]["whole"] == 2**70
    lacking = [r for r in rows if r["defaulted"]]
    assert at[3, 1, "status"] in lacking and at[1, 0, "flag"] in lacking
    assert all(r["ok"] and r["value"] is None and all(v is None for v in r["typed"]) for r in lacking)


def test_one_table_keeps_fields_apart_that_a_file_holds_side_by_side(spark):
    files = [(1, "p", [span(1, a=4)]), (2, "p", [span(1, b=4)]), (3, "q", [span(2, a=1, b=2), '{"c.d":1,"c":{"d":2}}'])]
    at = sorted((r["file_id"], r["line_no"], r["field"], r["value"]) for r in one_table(spark, files) if not r["defaulted"] and r["field"] in ("a", "b", "c.d"))
    assert at == [(1, 0, "a", "4"), (2, 0, "b", "4"), (3, 0, "a", "1"), (3, 0, "b", "2"), (3, 1, "c.d", "1"), (3, 1, "c.d", "2")]


def test_one_table_empty(spark):
    assert one_table(spark, [(1, "p", [None, "x"])]) == []


def test_empty(spark):
    assert changes(spark, [(1, "p", []), (2, "p", [])]) == set()
