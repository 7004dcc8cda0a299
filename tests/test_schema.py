"""Parsers, renderers, inference and comparison against stated results."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.operators import infer
from schemaloom.plans import dialect, render
from schemaloom.sources import fields, parsers, records


def flat(fs, prefix=""):
    out = {}
    for f in fs:
        path = f"{prefix}{f.name}"
        out[path] = (f.type, f.mode)
        out |= flat(f.fields, path + ".")
    return out


def test_json_schema():
    text = json.dumps({"type": "object", "required": ["id", "user"], "properties": {"id": {"type": "integer"}, "ts": {"type": ["string", "null"], "format": "date-time"}, "tags": {"type": "array", "items": {"type": "string"}}, "user": {"type": "object", "required": ["id"], "properties": {"id": {"oneOf": [{"type": "integer"}, {"type": "null"}]}, "n": {"type": "number"}}}}})
    assert flat(parsers.json_schema(text)) == {"id": ("INT64", "REQUIRED"), "ts": ("TIMESTAMP", "NULLABLE"), "tags": ("STRING", "REPEATED"), "user": ("RECORD", "REQUIRED"), "user.id": ("INT64", "NULLABLE"), "user.n": ("FLOAT64", "NULLABLE")}


def test_spark_tree_round_trip():
    spec = fields.parse_spec("id:INT64!, tags:STRING*, items:RECORD*(qty:INT64, meta:RECORD(tag:STRING, ts:TIMESTAMP)), price:NUMERIC")
    back = parsers.spark_tree(render.spark(spec))
    assert flat(back) == flat(spec) | {"price": ("FLOAT64", "NULLABLE")}


def test_sql():
    text = "CREATE OR REPLACE TABLE `p.d.people` (id INT64 NOT NULL, price DECIMAL(10,2) DEFAULT 1, tags ARRAY<STRING> NOT NULL, meta STRUCT<created DATETIME, n ARRAY<STRUCT<a INT64, b STRING>>> OPTIONS(description=\"m\"), PRIMARY KEY (id)); CREATE TABLE b (x TEXT[])"
    found = flat(parsers.sql_schema(text, "people")) if "people" in parsers.sql_tables(text) else flat(parsers.sql_tables(text)["p.d.people"])
    assert found == {"id": ("INT64", "REQUIRED"), "price": ("FLOAT64", "NULLABLE"), "tags": ("STRING", "REPEATED"), "meta": ("RECORD", "NULLABLE"), "meta.created": ("TIMESTAMP", "NULLABLE"), "meta.n": ("RECORD", "REPEATED"), "meta.n.a": ("INT64", "NULLABLE"), "meta.n.b": ("STRING", "NULLABLE")}
    assert flat(parsers.sql_schema(text, "b")) == {"x": ("STRING", "REPEATED")}
    with pytest.raises(parsers.SchemaError):
        parsers.sql_schema(text, "c")


def test_dbt():
    manifest = json.dumps({"metadata": {}, "nodes": {"model.p.m": {"name": "m", "columns": {"id": {"data_type": "BIGINT", "constraints": [{"type": "not_null"}]}, "note": {}}}}})
    assert flat(parsers.dbt_manifest(manifest, "m")) == {"id": ("INT64", "REQUIRED"), "note": ("ANY", "NULLABLE")}
    assert parsers.guess_kind("x.json", manifest) == "dbt_manifest"
    assert [f.name for f in parsers.dbt_model("select a, t.b as the_b, sum(c) as total -- x\nfrom {{ ref('z') }} as t")] == ["a", "the_b", "total"]


def test_proto():
    text = 'syntax = "proto2"; package foo.bar; message Outer { required int64 id = 1; enum Kind { A = 0; } optional Kind k = 2; message Inner { required string code = 1; optional Inner next = 2; } repeated Inner inner = 3; map<string, int32> counts = 4; oneof x { string a = 5; } }'
    assert flat(parsers.proto_schema(text)) == {"id": ("INT64", "REQUIRED"), "k": ("STRING", "NULLABLE"), "inner": ("RECORD", "REPEATED"), "inner.code": ("STRING", "REQUIRED"), "inner.next": ("JSON", "NULLABLE"), "counts": ("JSON", "NULLABLE"), "a": ("STRING", "NULLABLE")}


def test_bigquery_and_wrappers():
    spec = fields.parse_spec("id:INT64!, skills:RECORD(list:RECORD*(element:RECORD(id:INT64, name:STRING)))")
    again = parsers.bigquery_json(render.bigquery_json(spec))
    assert flat(again) == flat(spec)
    assert flat(parsers.unwrap(again)) == {"id": ("INT64", "REQUIRED"), "skills": ("RECORD", "REPEATED"), "skills.id": ("INT64", "NULLABLE"), "skills.name": ("STRING", "NULLABLE")}


@pytest.mark.parametrize("form", render.RENDERERS)
def test_rendered_texts_are_sound(form):
    spec = fields.parse_spec('id:INT64!"the key", a:STRING*, r:RECORD(x:FLOAT64, y:BOOLEAN), d:DATE')
    text = render.render(spec, form)
    assert render.check(text, form) == []
    back = {"json_schema": parsers.json_schema, "openapi": parsers.json_schema, "bigquery_json": parsers.bigquery_json, "spark": parsers.spark_tree, "bigquery_ddl": parsers.sql_schema}.get(form)
    if back:
        assert flat(back(text)) == flat(spec)


def test_formats_and_references():
    assert parsers.parse_format("spark") == ("spark", "json") and parsers.parse_format("spark-tree") == ("spark", "tree")
    assert parsers.table_ref("p:d.t") == ("p", "d", "t")
    for bad in ("a.b.c", "a:b:c.d", "x y.z"):
        with pytest.raises(parsers.SchemaError):
            parsers.table_ref(bad)
    assert records.split_object("https://storage.googleapis.com/b/a%20b.json") == ("b", "a b.json")
    assert records.is_ndjson('{"a":1}\n\n{"a":2}') and not records.is_ndjson("[1]")


def test_read_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"i":1}\n{"i":2}\nnot json\n')
    (tmp_path / "b.json").write_text('[{"i":1},{"i":null}]')
    a = records.read_records(spark, str(tmp_path / "a.json"))
    assert a.where("rec is null").count() == 1 and a.count() == 3
    b = infer.infer(records.read_records(spark, str(tmp_path / "b.json")), 3)
    assert {r.path: r.type_repr for r in b.collect()} == {"i": "union(int|missing)"}


def fold(docs):
    """The merge of the records one by one, as the reference result."""

    def tree(v):
        if isinstance(v, dict):
            return {k: tree(x) for k, x in v.items()} or {"empty_object"}
        if isinstance(v, list):
            return [tree(v[0])] if v else {"empty_array"}
        return {"missing" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "empty_string" if v == "" else "str"}

    def names(t):
        return {"object"} if isinstance(t, dict) else {"array"} if isinstance(t, list) else t

    def merge(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: merge(a.get(k, {"missing"}), b.get(k, {"missing"})) for k in {**a, **b}}
        if isinstance(a, list) and isinstance(b, list):
            return [merge(a[0], b[0])]
        for x, y in ((a, b), (b, a)):
            if isinstance(x, list) and y == {"empty_array"}:
                return x
        return names(a) | names(b)

    out = None
    for d in docs:
        out = tree(d) if out is None else merge(out, tree(d))

    def flatten(t, path, into):
        if isinstance(t, dict):
            if path:
                into[path] = "object"
            for k, x in t.items():
                flatten(x, f"{path}.{k}" if path else k, into)
        elif isinstance(t, list):
            into[path] = "array"
            flatten(t[0], path + "[0]", into)
        else:
            atoms = sorted({{"empty_string": "str", "empty_object": "object", "empty_array": "array"}.get(a, a) for a in t})
            into[path] = atoms[0] if len(atoms) == 1 else f"union({'|'.join(atoms)})"
        return into

    return flatten(out, "", {})


VALUE = st.recursive(st.none() | st.booleans() | st.integers(0, 9) | st.sampled_from(["", "x"]), lambda kids: st.lists(kids, max_size=2) | st.dictionaries(st.sampled_from("ab"), kids, min_size=1, max_size=2), max_leaves=5)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("pq"), VALUE, min_size=1, max_size=2), min_size=1, max_size=5))
def test_inference_equals_the_fold(spark, docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").selectExpr("try_parse_json(j) as rec")
    assert {r.path: r.type_repr for r in infer.infer(df, 8).collect()} == fold(docs)


def test_dialect_rewrites_nested_calls():
    assert dialect.for_duckdb("replace_all(replace_all(a, '(', ''), 'b', 'c')") == "regexp_replace(regexp_replace(a, '(', '', 'g'), 'b', 'c', 'g')"


def test_atoms_of_odd_values(spark):
    texts = ["[]", "[null]", "{}", "null", '""', "1.0", "12345678901234567890123", "1e3", '[[null,1],2]', '{"a":{"b":[{"c":true},{"d":1}]}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").selectExpr("i", "try_parse_json(j) as rec")
    found = {(r["i"], r["path"]): r["atom"] for r in infer.paths_with(rows, ["i"], 5).collect()}
    assert [found[i, ""] for i in range(8)] == ["empty_array", "array", "empty_object", "missing", "empty_string", "float", "int", "float"]
    assert {p: a for (i, p), a in found.items() if i == 1} == {"": "array", "[0]": "missing"}
    assert {p: a for (i, p), a in found.items() if i == 8} == {"": "array", "[0]": "array", "[0][0]": "missing"}
    assert {p: a for (i, p), a in found.items() if i == 9} == {"": "object", "a": "object", "a.b": "array", "a.b[0]": "object", "a.b[0].c": "bool"}
    assert len(found) == 7 + 2 + 3 + 5
