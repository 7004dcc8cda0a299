"""Queries over schema texts, renderings, checks, reports and sources, with their results stated as VALUES.

What is stated here was worked out by hand from the rules of each format, not
by running the code, so every row can fail.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import errors, support
from schemaloom.operators import compare, infer, rules, texts
from schemaloom.plans import dialect, fixtures, render, report
from schemaloom.sources import dialects, fields, parsers, records, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _stated(key: str, columns: str, rows: list[tuple], query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[key] = query
    ORACLE_SQL[key] = "select * from " + dialect.values(columns.split(), rows) + " as stated"


def _table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    kinds = {bool: "boolean", int: "int"}
    names = columns.split()
    shown = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(k, 'string')}" for n, k in zip(names, shown)))


def _calls(key: str, columns: str, cases: list[tuple], call: Callable) -> None:
    """cases: (arguments, results); the row is the argument as text and what call gives, errors as `error`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for given, _ in cases:
            try:
                got = call(given)
            except ValueError:
                got = "error"
            got = got if isinstance(got, tuple) else (got,)
            rows.append((str(given), *[x if isinstance(x, bool | int) or x is None else str(x) for x in got], *[None] * (len(columns.split()) - 1 - len(got))))
        return _table(spark, columns, rows)

    width = len(columns.split()) - 1
    _stated(key, columns, [(str(g), *(r if isinstance(r, tuple) else (r,) + (None,) * (width - 1))) for g, r in cases], query)


# ---------------------------------------------------------------- schema texts

_TEXTS = "name string, kind string, text string, selection string"


def _parses(key: str, cases: dict[str, tuple], expected: dict[str, str]) -> None:
    """cases: name to (kind, text[, selection]); expected: name to lines `path TYPE MODE`."""
    given = [(n, c[0], c[1], c[2] if len(c) > 2 else None) for n, c in cases.items()]
    rows = [(n, *line.split()) for n, block in expected.items() for line in block.strip().splitlines()]
    _stated(key, "name path native_type mode", rows, lambda spark, sf_dir: texts.parse_texts(spark.createDataFrame(given, _TEXTS)).select("name", "path", "native_type", "mode"))


def _requires(key: str, cases: dict[str, tuple], expected: list[tuple[str, str]], arrays: bool = False) -> None:
    given = [(n, c[0], c[1], c[2] if len(c) > 2 else None) for n, c in cases.items()]
    _stated(key, "name path", expected, lambda spark, sf_dir: texts.required_paths(texts.parse_texts(spark.createDataFrame(given, _TEXTS)), arrays))


_B1 = json.dumps({"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["id", "name"], "properties": {"id": {"type": "integer"}, "name": {"type": "string"}, "ts": {"type": "string", "format": "date-time"}, "tags": {"type": "array", "items": {"type": "string"}}, "size": {"enum": ["s", "m"]}, "any": {}}})
_B2 = json.dumps({"type": "object", "required": ["id", "ts"], "properties": {"id": {"type": "integer"}, "ts": {"type": ["string", "null"], "format": "date-time"}, "n": {"oneOf": [{"type": "null"}, {"type": "number"}]}}})
_B3 = json.dumps({"type": "object", "required": ["user"], "properties": {"user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "name": {"type": "string"}}}, "rows": {"type": "array", "items": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "string"}, "n": {"type": "boolean"}}}}}})
_parses("parse_jsonschema", {"flat": ("json_schema", _B1), "nullable": ("json_schema", _B2), "nested": ("json_schema", _B3)}, {
    "flat": "id INT64 REQUIRED\nname STRING REQUIRED\nts TIMESTAMP NULLABLE\ntags STRING REPEATED\nsize STRING NULLABLE\nany ANY NULLABLE",
    "nullable": "id INT64 REQUIRED\nts TIMESTAMP NULLABLE\nn FLOAT64 NULLABLE",
    "nested": "user RECORD REQUIRED\nuser.id INT64 REQUIRED\nuser.name STRING NULLABLE\nrows RECORD REPEATED\nrows.sku STRING REQUIRED\nrows.n BOOLEAN NULLABLE",
})
_requires("parse_jsonschema_req", {"nested": ("json_schema", _B3), "flat": ("json_schema", _B1)}, [("nested", "user"), ("nested", "user.id"), ("flat", "id"), ("flat", "name")])
_FORMATS = json.dumps({"type": "object", "properties": {k: {"type": "string", "format": f} for k, f in (("a", "date-time"), ("b", "date"), ("c", "time"), ("d", "email"))} | {"e": {"type": "string"}}})
_parses("parse_jsonschema_fmt", {"formats": ("json_schema", _FORMATS)}, {"formats": "a TIMESTAMP NULLABLE\nb DATE NULLABLE\nc TIME NULLABLE\nd STRING NULLABLE\ne STRING NULLABLE"})

_TREE = "root\n |-- id: long (nullable = false)\n |-- ts: timestamp (nullable = true)\n |-- tags: array (nullable = true)\n |    |-- element: string (containsNull = true)\n"
_ITEMS = "root\n |-- items: array (nullable = true)\n |    |-- element: struct (containsNull = true)\n |    |    |-- qty: integer (nullable = false)\n |    |    |-- meta: struct (nullable = true)\n |    |    |    |-- tag: string (nullable = true)\n |    |    |    |-- ts: timestamp (nullable = true)\n |-- after: date (nullable = true)\n"
_PROFILE = "root\n |-- id: integer (nullable = false)\n |-- profile: struct (nullable = false)\n |    |-- bio: string (nullable = true)\n |    |-- age: integer (nullable = true)\n |-- counts: map (nullable = true)\n |    |-- key: string\n |    |-- value: long (valueContainsNull = true)\n |-- last: boolean (nullable = true)\n"
_parses("parse_spark_tree", {"tree": ("spark", _TREE)}, {"tree": "id INT64 REQUIRED\nts TIMESTAMP NULLABLE\ntags STRING REPEATED"})
_parses("parse_spark_elem", {"items": ("spark", _ITEMS)}, {"items": "items RECORD REPEATED\nitems.qty INT64 REQUIRED\nitems.meta RECORD NULLABLE\nitems.meta.tag STRING NULLABLE\nitems.meta.ts TIMESTAMP NULLABLE\nafter DATE NULLABLE"})
_parses("parse_spark_struct", {"profile": ("spark", _PROFILE)}, {"profile": "id INT64 REQUIRED\nprofile RECORD REQUIRED\nprofile.bio STRING NULLABLE\nprofile.age INT64 NULLABLE\ncounts JSON NULLABLE\nlast BOOLEAN NULLABLE"})
_INLINE = "root\n |-- a: array<string> (nullable = true)\n |-- b: struct<x:int,y:array<struct<z:double>>> (nullable = true)\n |-- c: map<string,int> (nullable = true)\n |-- d: decimal(10,2) (nullable = true)\n |-- e: interval (nullable = true)\n"
_parses("parse_spark_dtype", {"inline": ("spark", _INLINE), "ddl": ("spark_ddl", "a ARRAY<STRING>, b STRUCT<x: INT, y: DOUBLE> NOT NULL, c LONG")}, {
    "inline": "a STRING REPEATED\nb RECORD NULLABLE\nb.x INT64 NULLABLE\nb.y RECORD REPEATED\nb.y.z FLOAT64 NULLABLE\nc JSON NULLABLE\nd FLOAT64 NULLABLE\ne ANY NULLABLE",
    "ddl": "a STRING REPEATED\nb RECORD REQUIRED\nb.x INT64 NULLABLE\nb.y FLOAT64 NULLABLE\nc INT64 NULLABLE",
})

_PEOPLE = "CREATE TABLE public.people (\n  id BIGINT NOT NULL, -- the key\n  full_name TEXT NOT NULL,\n  created_at TIMESTAMP WITH TIME ZONE DEFAULT now(),\n  tags TEXT[],\n  price DECIMAL(10, 2),\n  PRIMARY KEY (id)\n);\nCREATE TABLE public.other (id TEXT PRIMARY KEY, n DOUBLE PRECISION);"
_parses("parse_sql_ddl", {"first": ("sql", _PEOPLE, "people"), "second": ("sql", _PEOPLE, "public.other"), "least": ("sql", _PEOPLE), "loose": ("sql", "id INT64 NOT NULL, note STRING"), "line": ("sql", "CREATE TABLE t (name STRING DEFAULT 'x' NOT NULL, g GEOGRAPHY)")}, {
    "first": "id INT64 REQUIRED\nfull_name STRING REQUIRED\ncreated_at TIMESTAMP NULLABLE\ntags STRING REPEATED\nprice FLOAT64 NULLABLE",
    "second": "id STRING REQUIRED\nn FLOAT64 NULLABLE",
    "least": "id STRING REQUIRED\nn FLOAT64 NULLABLE",
    "loose": "id INT64 REQUIRED\nnote STRING NULLABLE",
    "line": "name STRING REQUIRED\ng STRING NULLABLE",
})
_parses("parse_sql_struct", {"events": ("sql", "CREATE TABLE `p.myds.events` (tags ARRAY<STRING> NOT NULL, metrics ARRAY<NUMERIC>, meta STRUCT<created DATETIME, tz STRING NOT NULL>, nested ARRAY<STRUCT<a INT64, b STRING>>, flags STRUCT<on BOOL OPTIONS(description=\"x, y\"), note STRING> OPTIONS(description=\"m\"))")}, {
    "events": "tags STRING REPEATED\nmetrics FLOAT64 REPEATED\nmeta RECORD NULLABLE\nmeta.created TIMESTAMP NULLABLE\nmeta.tz STRING REQUIRED\nnested RECORD REPEATED\nnested.a INT64 NULLABLE\nnested.b STRING NULLABLE\nflags RECORD NULLABLE\nflags.on BOOLEAN NULLABLE\nflags.note STRING NULLABLE",
})
_parses("parse_sql_multiline", {"lines": ("sql", "create or replace table x.y\n(\n  a struct<\n    b int64,\n    c array<struct<\n      d string /* deep, down */\n    >>\n  >,\n  e date\n)\npartition by e;")}, {"lines": "a RECORD NULLABLE\na.b INT64 NULLABLE\na.c RECORD REPEATED\na.c.d STRING NULLABLE\ne DATE NULLABLE"})

_MANIFEST = json.dumps({"metadata": {"dbt_version": "1"}, "nodes": {"model.p.my_model": {"name": "my_model", "alias": "mine", "resource_type": "model", "columns": {"id": {"data_type": "BIGINT", "constraints": [{"type": "not_null"}]}, "tags": {"data_type": "TEXT[]"}, "ts": {"data_type": "TIMESTAMP WITH TIME ZONE", "tests": ["not_null", "unique"]}, "note": {}}}, "model.p.second": {"name": "second", "columns": {"tags": {"data_type": "ARRAY<STRING>"}}}, "test.p.t": {"resource_type": "test", "columns": {"x": {}}}}})
_SCHEMA_YML = 'version: 2\n\nmodels:\n  - name: orders   # the first\n    description: >\n      All of\n      them.\n    columns:\n      - name: id\n        data_type: bigint\n        tests:\n          - not_null\n          - unique\n      - name: "note"\n        description: \'a: b\'\n        meta: {owner: [x, y], level: 2}\n      - name: at\n        data_type: timestamp with time zone\n        data_tests: [not_null]\n  - name: others\n    columns:\n    - name: k\n      data_type: text[]\n      constraints:\n      - type: not_null\n'
_parses("parse_dbt_manifest", {"by name": ("dbt_manifest", _MANIFEST, "my_model"), "by alias": ("dbt_manifest", _MANIFEST, "mine"), "by node": ("dbt_manifest", _MANIFEST, "model.p.second")}, {
    n: "id INT64 REQUIRED\ntags STRING REPEATED\nts TIMESTAMP REQUIRED\nnote ANY NULLABLE" for n in ("by name", "by alias")} | {"by node": "tags STRING REPEATED"})
_parses("parse_dbt_yml", {"orders": ("dbt_yaml", _SCHEMA_YML, "orders"), "others": ("dbt_yaml", _SCHEMA_YML, "others"), "guessed/schema.yml": (None, _SCHEMA_YML)}, {
    n: "id INT64 REQUIRED\nnote ANY NULLABLE\nat TIMESTAMP REQUIRED" for n in ("orders", "guessed/schema.yml")} | {"others": "k STRING REPEATED"})
_parses("parse_dbt_model", {"model": ("dbt_model", "{{ config(materialized='table') }}\nwith src as (select z from {{ ref('s') }})\nselect a, t.b as the_b, sum(c) total, -- x\n  coalesce(d, 0) as d2\nfrom src as t")}, {"model": "a ANY NULLABLE\nthe_b ANY NULLABLE\ntotal ANY NULLABLE\nd2 ANY NULLABLE"})

_USER = 'syntax = "proto3";\npackage demo;\nimport "google/protobuf/timestamp.proto";\nmessage Address { string city = 1; string country = 2; }\nmessage User {\n  int64 id = 1; // key\n  string name = 2;\n  repeated string tags = 3;\n  google.protobuf.Timestamp created_at = 4;\n  Address addr = 5;\n  map<string, int32> counts = 6;\n  bool on = 7 [deprecated = true];\n}\n'
_PERSON = 'syntax = "proto2";\nmessage P { required string code = 1; optional string note = 2; }\nmessage Person { required int32 id = 1; optional string name = 2; required P p = 3; repeated P others = 4; }\n'
_OUTER = 'syntax = "proto2";\npackage foo.bar;\nmessage Outer {\n  enum Kind { A = 0; B = 1; }\n  message Inner {\n    message Child { optional double x = 1; }\n    required Child child = 1;\n    optional .foo.bar.Other other = 2;\n  }\n  optional Kind kind = 1;\n  optional Inner inner = 2;\n  oneof pick { string a = 3; int32 b = 4; }\n  optional Outer again = 5;\n}\nmessage Other { optional bytes x = 1; }\n'
_parses("parse_proto", {"user": ("protobuf", _USER, "demo.User")}, {"user": "id INT64 NULLABLE\nname STRING NULLABLE\ntags STRING REPEATED\ncreated_at TIMESTAMP NULLABLE\naddr RECORD NULLABLE\naddr.city STRING NULLABLE\naddr.country STRING NULLABLE\ncounts JSON NULLABLE\non BOOLEAN NULLABLE"})
_parses("parse_proto_struct", {"outer": ("protobuf", _OUTER, "Outer")}, {"outer": "kind STRING NULLABLE\ninner RECORD NULLABLE\ninner.child RECORD REQUIRED\ninner.child.x FLOAT64 NULLABLE\ninner.other RECORD NULLABLE\ninner.other.x STRING NULLABLE\na STRING NULLABLE\nb INT64 NULLABLE\nagain JSON NULLABLE"})
_requires("parse_proto_req", {"person": ("protobuf", _PERSON, "Person")}, [("person", "id"), ("person", "p"), ("person", "p.code")])
_parses("parse_proto_ref", {"scope": ("protobuf", 'syntax = "proto3"; package a.b; message M { message T { int32 in = 1; } T near = 1; .a.b.T far = 2; b.T half = 3; Nowhere gone = 4; } message T { string out = 1; }', "M")}, {"scope": "near RECORD NULLABLE\nnear.in INT64 NULLABLE\nfar RECORD NULLABLE\nfar.out STRING NULLABLE\nhalf RECORD NULLABLE\nhalf.out STRING NULLABLE\ngone JSON NULLABLE"})
_stated("parse_proto_list", "message", [("foo.bar.Outer",), ("foo.bar.Outer.Inner",), ("foo.bar.Outer.Inner.Child",), ("foo.bar.Other",)], lambda spark, sf_dir: _table(spark, "message", [(k,) for k, v in parsers.proto_messages(_OUTER).items() if v is not None]))

_API = json.dumps({"kind": "bigquery#table", "schema": {"fields": [{"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "name", "type": "STRING", "policyTags": {"names": ["p"]}}, {"name": "active", "type": "BOOL"}, {"name": "user", "type": "RECORD", "fields": [{"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "email", "type": "STRING"}]}, {"name": "rows", "type": "STRUCT", "mode": "REPEATED", "fields": [{"name": "k", "type": "FLOAT", "mode": "REQUIRED"}]}]}})
_parses("parse_bq_json", {"api": ("bigquery", _API), "guessed/t.json": (None, _API)}, {n: "id INTEGER REQUIRED\nname STRING NULLABLE\nactive BOOLEAN NULLABLE\nuser RECORD NULLABLE\nuser.id INTEGER REQUIRED\nuser.email STRING NULLABLE\nrows RECORD REPEATED\nrows.k FLOAT REQUIRED" for n in ("api", "guessed/t.json")})
_calls("parse_bq_json_is", "text yes", [(_API, True), ('{"kind": "bigquery#table"}', False), ('{"schema": {"fields": []}}', False), ("[1]", False), ("{", False)], parsers.is_bigquery_json)
_requires("parse_bq_schema", {"api": ("bigquery", _API)}, [("api", "id"), ("api", "user.id"), ("api", "rows[].k")], arrays=True)

_CROSS = "CREATE TABLE [dbo].[t] ([id] BIGINT NOT NULL, [name] NVARCHAR(50), [ok] BIT, [at] DATETIME2)"
_TRINO = 'CREATE TABLE "c"."s"."t" (id bigint NOT NULL, tags array(varchar), pos row(x double, y array(row(z integer))), at timestamp)'
_CLICK = "CREATE TABLE db.t (`id` UInt64, `n` Nullable(Float64), `tags` Array(LowCardinality(String)), `p` Tuple(a Int32, b String))"
_stated("parse_sqlglot", "dialect path native_type mode", [
    ("tsql", "id", "INT64", "REQUIRED"), ("tsql", "name", "STRING", "NULLABLE"), ("tsql", "ok", "BOOLEAN", "NULLABLE"), ("tsql", "at", "TIMESTAMP", "NULLABLE"),
    ("trino", "id", "INT64", "REQUIRED"), ("trino", "tags", "STRING", "REPEATED"), ("trino", "pos", "RECORD", "NULLABLE"), ("trino", "pos.x", "FLOAT64", "NULLABLE"), ("trino", "pos.y", "RECORD", "REPEATED"), ("trino", "pos.y.z", "INT64", "NULLABLE"), ("trino", "at", "TIMESTAMP", "NULLABLE"),
    ("clickhouse", "id", "INT64", "NULLABLE"), ("clickhouse", "n", "FLOAT64", "NULLABLE"), ("clickhouse", "tags", "STRING", "REPEATED"), ("clickhouse", "p", "RECORD", "NULLABLE"), ("clickhouse", "p.a", "INT64", "NULLABLE"), ("clickhouse", "p.b", "STRING", "NULLABLE"),
    ("spark", "id", "INT64", "NULLABLE"), ("spark", "s", "RECORD", "NULLABLE"), ("spark", "s.a", "STRING", "NULLABLE"), ("spark", "k", "JSON", "NULLABLE"),
], lambda spark, sf_dir: _table(spark, "dialect path native_type mode", [(d, r[1], r[6], r[7]) for d, t in (("tsql", _CROSS), ("trino", _TRINO), ("clickhouse", _CLICK), ("spark", "create table t (id bigint, s struct<a: string>); create table u (k map<string,int>)")) for r in fields.rows(d, dialects.dialect_schema(t, d))]))
_calls("sqlglot_translate", "target text", [
    ("postgres", 'CREATE TABLE "p"."t" (\n  "id" BIGINT NOT NULL,\n  "tags" TEXT[],\n  "m" JSONB,\n  "at" TIMESTAMP\n);'),
    ("trino", 'CREATE TABLE "p"."t" (\n  "id" BIGINT NOT NULL,\n  "tags" ARRAY(VARCHAR),\n  "m" ROW(a DOUBLE),\n  "at" TIMESTAMP\n);'),
    ("spark", "CREATE TABLE `p`.`t` (\n  `id` BIGINT NOT NULL,\n  `tags` ARRAY<STRING>,\n  `m` STRUCT<a: DOUBLE>,\n  `at` TIMESTAMP\n);"),
    ("tsql", "CREATE TABLE [p].[t] (\n  [id] BIGINT NOT NULL,\n  [tags] NVARCHAR(MAX),\n  [m] NVARCHAR(MAX),\n  [at] DATETIMEOFFSET\n);"),
    ("cobol", "error"),
], lambda target: dialects.translate("CREATE TABLE p.t (id INT64 NOT NULL, tags ARRAY<STRING>, m STRUCT<a FLOAT64>, at TIMESTAMP)", "bigquery", target).replace("TIMESTAMPTZ", "TIMESTAMP"))
_calls("sqlglot_validate", "text sound", [("select 1", True), ("CREATE TABLE t (a INT64, b ARRAY<STRING>);", True), ("CREATE TABLE `x` (nonsense here);", False), ("select (1", False), ("selec 1", False), ("select 'x", False), ("", False), ("-- only a remark", False), ("select ')' as a; with x as (select 1) select * from x", True)], lambda t: dialects.check_sql(t)[0])
_stated("sqlglot_dialects", "dialect", [(d,) for d in "bigquery postgres mysql sqlite snowflake redshift spark hive presto trino clickhouse databricks duckdb oracle tsql athena".split()], lambda spark, sf_dir: _table(spark, "dialect", [(d,) for d in dialects.DIALECTS]))
_calls("ident_unquote", "name bare", [("`a b`", "a b"), ('"a"', "a"), ("[a]", "a"), ("'a'", "a"), (" a ", "a"), ("`", "`"), ("a`", "a`")], parsers.unquoted)
_calls("tree_coerce", "given fields", [
    ('[{"name": "id", "type": "int"}, {"name": "x", "dataType": "str"}, {"name": "y"}]', '{"id": "int", "x": "str", "y": "any"}'), ('[{"id": "int"}, {"name": "str"}]', '{"id": "int", "name": "str"}'), ('[{"a": 1, "b": 2}]', '[{"a": 1, "b": 2}]'), ("[]", "[]"), ('{"a": 1}', '{"a": 1}'), ('[{"a": 1}, 2]', '[{"a": 1}, 2]'),
], lambda text: json.dumps(parsers.list_of_fields(json.loads(text))))

# ---------------------------------------------------------------- formats and kinds

_calls("fmt_resolve", "format family form", [("spark", ("spark", "json")), ("Spark:Tree", ("spark", "tree")), (" bigquery ", ("bq", "table")), ("bq-api-json", ("bq", "api-json")), ("ndjson", ("data", "jsonl")), ("dbt", ("dbt", "manifest")), ("dbt-yaml", ("dbt", "yml")), ("proto", ("proto", "sdl")), ("protobuf", ("proto", "sdl")), ("json-schema", ("jsonschema", "json")), ("sql:ddl", ("sql", "ddl")), ("sql:tree", ("error", None)), ("xml", ("error", None)), ("", ("error", None))], parsers.parse_format)
_calls("fmt_family", "format family", [("spark:tree", "spark"), ("bq:table", "bq"), ("data", "data")], parsers.family_of)
_stated("fmt_all", "format", [(f,) for f in "bigquery bigquery-api-json bigquery-json bq-api-json bq-ddl bq-json bq-table bq:api-json bq:ddl bq:json bq:table csv data data:csv data:json data:jsonl data:orc data:parquet dbt-manifest dbt-model dbt-yaml dbt-yml dbt:manifest dbt:model dbt:yml json json-schema json_schema jsonl jsonschema jsonschema:json ndjson orc parquet proto:sdl protobuf spark spark-ddl spark-json spark-tree spark:ddl spark:json spark:tree sql sql-ddl sql:ddl".split()], lambda spark, sf_dir: _table(spark, "format", [(f,) for f in parsers.all_formats()]))
_calls("src_factory", "format kind", [("spark:tree", "spark"), ("spark", "spark_json"), ("bq:api-json", "bigquery"), ("sql", "sql"), ("dbt:yml", "dbt_yaml"), ("jsonschema", "json_schema"), ("proto", "protobuf"), ("parquet", "data:parquet")], parsers.kind_of)
_KIND_CASES = [(("a/b.sql", "select 1 from {{ ref('x') }}"), "dbt_model"), (("b.SQL", "create table t (a int)"), "sql"), (("c.yml", ""), "dbt_yaml"), (("c.yaml", ""), "dbt_yaml"), (("d.txt", ""), "spark"), (("e.proto", ""), "protobuf"), (("f.json", _API), "bigquery"), (("g.json", _MANIFEST), "dbt_manifest"), (("h.json", _B1), "json_schema"), (("i.json", '{"a": 1}'), "data"), (("j.jsonl", '{"a": 1}\n{"a": 2}'), "data"), (("k.json.gz", "[1]"), "data"), (("proj:ds.tbl", ""), "live"), (("x:y.json", "{}"), "data"), (("plain", ""), "data")]
_stated("sniff_kind", "name kind", [(n, k) for (n, _), k in _KIND_CASES], lambda spark, sf_dir: _table(spark, "name kind", [(n, parsers.guess_kind(n, t)) for (n, t), _ in _KIND_CASES]))
_LONG = '{"$schema": "x", "note": "' + "x" * 140_000 + '"}'
_JSON_CASES = [("empty", "", "data"), ("lines", '{"a":1}\n{"a":2}', "data"), ("array", '[{"name":"a","type":"b"}]', "data"), ("cut", _LONG, "data"), ("api", _API, "bigquery"), ("manifest", '{"nodes": {}}', "dbt_manifest"), ("map", '{"child_map": 1}', "dbt_manifest"), ("version", '{"metadata": {"dbt_version": "1"}}', "dbt_manifest"), ("schema", '{"$schema": "x"}', "json_schema"), ("object", '{"type": "object", "properties": {}}', "json_schema"), ("defs", '{"$defs": {}}', "json_schema"), ("data", '{"type": "object"}', "data"), ("text", "hello", "data")]
_stated("sniff_json", "name kind", [(n, k) for n, _, k in _JSON_CASES], lambda spark, sf_dir: _table(spark, "name kind", [(n, parsers.sniff_json(t)) for n, t, _ in _JSON_CASES]))
_calls("sniff_sql", "text kind", [("create or replace table t (a int) as select 1", "sql"), ("select 1", "dbt_model"), ("{{ config() }}", "dbt_model"), ("-- create table\nselect 1", "dbt_model"), ("/* select */ alter table t add x int", "sql"), ("a int, b text", "sql"), ("", "sql")], parsers.sniff_sql)

# ---------------------------------------------------------------- sources

_calls("src_gcs_path", "path yes", [("gs://b/o", True), ("https://storage.cloud.google.com/b/o", True), ("https://storage.googleapis.com/b/o", True), ("s3://b/o", False), ("/tmp/gs", False), ("https://example.com/b/o", False)], records.is_object_store)
_calls("src_gcs_parse", "path bucket object", [("gs://b/a/o.json", ("b", "a/o.json")), ("https://storage.cloud.google.com/b/a%20b/o", ("b", "a b/o")), ("https://storage.googleapis.com/b/o%2Bx", ("b", "o+x")), ("gs://b", ("error", None)), ("gs:///o", ("error", None)), ("/b/o", ("error", None))], records.split_object)
_calls("src_gcs_local", "path local", [("gs://b/a/o.json", "data/b_a_o.json"), ("https://storage.googleapis.com/b/a%20b/o", "data/b_a b_o"), ("b/o", "error")], stores.local_name)
_calls("src_bq_ref", "reference project dataset name", [("p:d.t", ("p", "d", "t")), ("d.t", (None, "d", "t")), ("a.b.c", ("error", None, None)), ("a:b:c.d", ("error", None, None)), (":d.t", ("error", None, None)), ("p:d.", ("error", None, None)), ("p q:d.t", ("error", None, None)), ("t", ("error", None, None))], parsers.table_ref)
_calls("src_bq_dsref", "reference project dataset", [("p:d", ("p", "d")), ("d", (None, "d")), ("p:d.t", ("error", None)), ("a:b:c", ("error", None)), ("", ("error", None)), (" d", ("error", None))], parsers.dataset_ref)


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write and read."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top.rstrip('/') if top else 'file://' + tempfile.gettempdir()}/schemaloom-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(content))
    out.close()


def _nations(spark: SparkSession, sf_dir: str) -> list[dict]:
    """All rows of nation, a table of fixed size."""
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def _read_back(form: Callable[[list[dict]], dict[str, bytes]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark)
        for name, content in form(_nations(spark, sf_dir)).items():
            _put(spark, f"{folder}/{name}", content)
        found = records.read_records(spark, folder)
        return found.selectExpr("variant_get(rec, '$.n_nationkey', 'bigint') as n_nationkey", "variant_get(rec, '$.n_name', 'string') as n_name", "variant_get(rec, '$.n_regionkey', 'bigint') as n_regionkey")

    return query


def _lines(rows: list[dict]) -> bytes:
    return "\n".join(json.dumps(r) for r in rows).encode()


_ALL_NATIONS = "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation"
for _name, _form in {
    # lines, an array, single objects and lines with a byte-order mark, side by side in one folder
    "src_records": lambda rows: {"a.json": _lines(rows[:9]), "b.json": json.dumps(rows[9:15], indent=1).encode(), "c.json": json.dumps(rows[15], indent=2).encode(), "d.json": b"\xef\xbb\xbf" + _lines(rows[16:]), "e.json": b"", "f.json": b" \n\n"},
    "src_gzip_text": lambda rows: {"a.json.gz": gzip.compress(_lines(rows[:20])), "b.json": _lines(rows[20:])},
    "src_gzip_bin": lambda rows: {"a.json": gzip.compress(b"\xef\xbb\xbf" + _lines(rows[:9])), "b.dat": gzip.compress(json.dumps(rows[9:]).encode())},
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _read_back(_form), _ALL_NATIONS
_calls("src_ndjson_sniff", "sample yes", [('{"a":1}\n{"b":2}', True), ('\n {"a":1}\n\n{"b":2}', True), ('{"a":1}', False), ("[1]\n[2]", False), ('{"a":1}\n2', False), ("", False)], records.is_ndjson)
_EVENT_ATOMS = "select path, type_repr from (select 'event_id' as path, 'int' as type_repr union all select 'event_type', 'str' union all select 'user_id', 'int' union all select 'value', 'float') as t"
QUERIES["src_dataparser"] = lambda spark, sf_dir: infer.infer(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("try_parse_json(to_json(struct(event_id, event_type, user_id, value))) as rec"), 2).select("path", "type_repr")
ORACLE_SQL["src_dataparser"] = _EVENT_ATOMS
QUERIES["src_bq_live"] = lambda spark, sf_dir: _live(spark, sf_dir)
ORACLE_SQL["src_bq_live"] = "select * from (values ('n_name', 'STRING', 'NULLABLE'), ('n_nationkey', 'INT64', 'NULLABLE'), ('n_regionkey', 'INT64', 'NULLABLE')) as t(path, native_type, mode)"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("schemaloom_live")
    return _table(spark, "path native_type mode", [(r[1], r[6], r[7]) for r in fields.rows("t", stores.live_fields(spark, "schemaloom_live"))])


_stated("ddl_location", "dataset location", [("sales", "europe-west1"), ("none", "US"), ("blank", "US")], lambda spark, sf_dir: _table(spark, "dataset location", [(d, stores.dataset_location(_table(spark, "schema_name location", [("sales", "europe-west1"), ("blank", None)]), d)) for d in ("sales", "none", "blank")]))
QUERIES["sample_strategy"] = lambda spark, sf_dir: _strategies(spark, sf_dir)
ORACLE_SQL["sample_strategy"] = "select * from (select 'first' as strategy, cast(1 as bigint) as n, cast(0 as bigint) as outside union all select 'all', count(*), 0 from orders union all select 'sample', least(count(*), 100), 0 from orders) as t"


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each strategy takes, and how many of them are no records of the input."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    picks = {"first": records.choose(orders, first=True, all_records=True), "all": records.choose(orders, all_records=True), "sample": records.choose(orders, k=100, seed=7)}
    counted = [p.select(F.lit(n).alias("strategy"), "o_orderkey").join(orders.withColumn("known", F.lit(1)), "o_orderkey", "left").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("outside")) for n, p in picks.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


QUERIES["sample_fmt_field"] = lambda spark, sf_dir: records.sample_lines(*(_shown(spark, sf_dir, t, k, c) for t, k, c in (("orders", "o_orderkey", "o_orderstatus"), ("lineitem", "l_orderkey * 10 + l_linenumber", "l_linestatus"))))


def _shown(spark: SparkSession, sf_dir: str, table: str, key: str, column: str) -> DataFrame:
    values = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} as ordinal", "'status' as path", f"{column} as value")
    return records.field_samples(values).select("path", "turn", records.format_sample(F.lit("str"), F.col("value")).alias("shown"))


_LISTED = "(select '[' || string_agg('\"' || v || '\"', ', ' order by seen, v) || ']' as s from (select {c} as v, min({k}) as seen from {t} where {c} is not null group by {c} order by seen, v limit 5) as u)"
ORACLE_SQL["sample_fmt_field"] = f"select 'status' as path, {_LISTED.format(c='o_orderstatus', k='o_orderkey', t='orders')} as left_samples, {_LISTED.format(c='l_linestatus', k='l_orderkey * 10 + l_linenumber', t='lineitem')} as right_samples"
_stated("sample_fmt_table", "shown", [("    ───────────────────\n    │ old   │ New    │\n    ───────────────────\n    │ \"a\"   │ 1      │\n    │ \"bcd\" │ 22     │\n    │       │ \"long\" │\n    ───────────────────".replace("───────────────────", "─" * 18),)], lambda spark, sf_dir: _table(spark, "shown", [(render.sample_table("p", {"p": ['"a"', '"bcd"']}, {"p": ["1", "22", '"long"']}, ("old", "New")),)]))
_calls("fmt_deepdiff", "path shown", [("root['a']['b']", "a.b"), ("root['a'][0]['b']", "a[0].b"), ("['x']", "x"), ("root", ""), ("a.b", "a.b")], compare.plain_path)

# ---------------------------------------------------------------- renderings

_DOC = "name:STRING!, email:STRING!, age:INT64, tags:STRING*, home:RECORD(city:STRING!, lat:FLOAT64), on:BOOLEAN, born:DATE, at:TIMESTAMP"
_RENDERED = {
    "json_schema": '{\n  "$schema": "http://json-schema.org/draft-07/schema#",\n  "type": "object",\n  "properties": {\n    "id": {\n      "type": "integer",\n      "description": "the \\"key\\""\n    },\n    "tags": {\n      "type": "array",\n      "items": {\n        "type": "string"\n      }\n    },\n    "home": {\n      "type": "object",\n      "properties": {\n        "at": {\n          "type": "string",\n          "format": "date-time"\n        }\n      },\n      "required": [\n        "at"\n      ]\n    }\n  },\n  "required": [\n    "id"\n  ]\n}',
    "openapi": '{\n  "type": "object",\n  "properties": {\n    "id": {\n      "type": "integer",\n      "description": "the \\"key\\""\n    },\n    "tags": {\n      "type": "array",\n      "items": {\n        "type": "string"\n      }\n    },\n    "home": {\n      "type": "object",\n      "properties": {\n        "at": {\n          "type": "string",\n          "format": "date-time"\n        }\n      },\n      "required": [\n        "at"\n      ]\n    }\n  },\n  "required": [\n    "id"\n  ]\n}',
    "bigquery_json": '[\n  {\n    "name": "id",\n    "type": "INT64",\n    "mode": "REQUIRED",\n    "description": "the \\"key\\""\n  },\n  {\n    "name": "tags",\n    "type": "STRING",\n    "mode": "REPEATED"\n  },\n  {\n    "name": "home",\n    "type": "RECORD",\n    "mode": "NULLABLE",\n    "fields": [\n      {\n        "name": "at",\n        "type": "TIMESTAMP",\n        "mode": "REQUIRED"\n      }\n    ]\n  }\n]',
    "spark": "root\n |-- id: long (nullable = false)\n |-- tags: array (nullable = true)\n |    |-- element: string (containsNull = true)\n |-- home: struct (nullable = true)\n |    |-- at: timestamp (nullable = false)\n",
    "sql_ddl": 'CREATE TABLE t (\n  "id" INTEGER NOT NULL,\n  "tags" TEXT[],\n  "home_at" TIMESTAMP NOT NULL\n);',
    "bigquery_ddl": 'CREATE OR REPLACE TABLE `t` (\n  `id` INT64 NOT NULL OPTIONS(description="the \\"key\\""),\n  `tags` ARRAY<STRING>,\n  `home` STRUCT<\n    `at` TIMESTAMP NOT NULL\n  >\n);',
}
_SMALL = [fields.Field("id", "INT64", "REQUIRED", 'the "key"'), fields.Field("tags", "STRING", "REPEATED"), fields.Field("home", "RECORD", "NULLABLE", None, [], [fields.Field("at", "TIMESTAMP", "REQUIRED")])]


def _renders(key: str, *forms: str) -> None:
    _stated(key, "table_name form text", [("t", f, _RENDERED[f]) for f in forms], lambda spark, sf_dir: texts.render_texts(fields.catalog(spark, {"t": _SMALL}), *forms))


_renders("gen_dispatch", *_RENDERED)
for _f in ("json_schema", "spark", "bigquery_json", "openapi"):
    _renders(f"gen_{_f}", _f)
_stated("gen_formats", "form", [(f,) for f in ("json_schema", "sql_ddl", "bigquery_ddl", "spark", "bigquery_json", "openapi")], lambda spark, sf_dir: _table(spark, "form", [(f,) for f in render.FORMATS]))


def _checks(form: str, cases: dict[str, str], problems: list[tuple[str, str]], key: str | None = None) -> None:
    given = [(n, form, t) for n, t in cases.items()]
    _stated(key or f"val_{form}", "name problem", problems, lambda spark, sf_dir: texts.check_texts(spark.createDataFrame(given, "name string, form string, text string")).select("name", "problem"))


_checks("json_schema", {"sound": _RENDERED["json_schema"], "bare": '{"type": "object"}', "odd": '{"$schema": "http://json-schema.org/x", "type": "thing"}', "list": "[]"}, [("bare", "no $schema of a known version"), ("odd", "unknown type thing"), ("list", "no top-level type")])
_checks("openapi", {"sound": _RENDERED["openapi"], "bare": "{}", "null": '{"type": "null"}', "odd": '{"type": "object", "properties": []}'}, [("bare", "no top-level type"), ("null", "unknown type null"), ("odd", "properties are no object")])
_checks("bigquery_json", {"sound": _RENDERED["bigquery_json"], "object": "{}", "lacks": '[{"type": "STRING"}, {"name": "a"}]', "odd": '[{"name": "a", "type": "TEXT"}]', "deep": '[{"name": "r", "type": "RECORD", "fields": [{"name": "x", "type": "?"}]}]'}, [("object", "not a list of fields"), ("lacks", "field 0 has no name"), ("lacks", "field 1 has no type"), ("odd", "field 0 has the unknown type TEXT"), ("deep", "r: field 0 has the unknown type ?")])
_checks("spark", {"sound": _RENDERED["spark"], "rootless": " |-- a: long (nullable = true)", "odd": "root\n |-- a: text (nullable = true)\n - b"}, [("rootless", "no root line"), ("odd", "unknown type text"), ("odd", "not a field: ' - b'")])
_checks("sql_ddl", {"sound": _RENDERED["sql_ddl"], "open": "CREATE TABLE t (a INT", "nonsense": "CREATE TABLE t (nonsense here);", "other": "SELECT 1;"}, [("open", "unbalanced ()"), ("open", "no semicolon"), ("nonsense", "unknown type of nonsense"), ("other", "no CREATE TABLE")])
_checks("bigquery_ddl", {"sound": _RENDERED["bigquery_ddl"], "bare": "CREATE TABLE t (a INT64);", "angle": "CREATE TABLE `t` (a ARRAY<INT64);", "nonsense": "CREATE TABLE `x` (nonsense here);"}, [("bare", "the table's name has no backticks"), ("angle", "unbalanced <>"), ("nonsense", "unknown type of nonsense")])
_stated("val_dispatch", "form sound", [(f, True) for f in _RENDERED] + [("xml", False)], lambda spark, sf_dir: _table(spark, "form sound", [(f, _sound(t, f)) for f, t in [*_RENDERED.items(), ("xml", "<a/>")]]))


def _sound(text: str, form: str) -> bool:
    try:
        return not render.check(text, form)
    except ValueError:
        return False


_calls("ddl_struct", "spec text", [("r:RECORD(a:INT64!, b:RECORD(c:STRING))", "STRUCT<\n    `a` INT64 NOT NULL,\n    `b` STRUCT<\n      `c` STRING\n    >\n  >"), ("x:BOOLEAN", "BOOL"), ("x:DATE*", "ARRAY<DATE>")], lambda spec: render._bq_type(fields.parse_spec(spec)[0]))
_calls("ddl_array_struct", "spec text", [("r:RECORD*(a:INT64, b:RECORD*(c:STRING))", "ARRAY<STRUCT<\n      `a` INT64,\n      `b` ARRAY<STRUCT<\n          `c` STRING\n        >\n      >\n    >\n  >")], lambda spec: render._bq_type(fields.parse_spec(spec)[0]))
_calls("ddl_col_options", "given text", [("none", ""), ("text", ' OPTIONS(description="a \\"b\\" \\\\ c\\nd")'), ("tags", ' OPTIONS(policy_tags=["p", "q"])'), ("both", ' OPTIONS(description="x", policy_tags=["p"])')], lambda case: render.column_options({"none": fields.Field("a"), "text": fields.Field("a", description='a "b" \\ c\nd'), "tags": fields.Field("a", tags=["p", "q"]), "both": fields.Field("a", description="x", tags=["p"])}[case]))
_calls("ddl_options", "given text", [("none", ""), ("all", 'OPTIONS(description="d", require_partition_filter=TRUE, partition_expiration_days=30, labels=[("a","1"), ("b","2")])')], lambda case: render.table_options({} if case == "none" else {"description": "d", "require_partition_filter": True, "partition_expiration_days": 30, "labels": {"b": "2", "a": "1"}}))
_calls("ddl_partition", "given text", [((None,), "PARTITION BY _PARTITIONDATE"), (("d",), "PARTITION BY `d`"), (("ts", "TIMESTAMP"), "PARTITION BY DATE(`ts`)"), (("n", "INT64", (0, 100, 10)), "PARTITION BY RANGE_BUCKET(`n`, GENERATE_ARRAY(0, 100, 10))")], lambda given: render.partition_clause(*given))
_calls("ddl_cluster", "columns text", [([], ""), (["a", "b c"], "CLUSTER BY `a`, `b c`")], render.cluster_clause)
_calls("ddl_pretty", "text shown", [("CREATE TABLE `t` (\n  `a` INT64\n);\nALTER TABLE `t` ADD PRIMARY KEY (`a`) NOT ENFORCED;", "CREATE TABLE `t` (\n  `a` INT64\n);\n\nALTER TABLE `t`\n  ADD PRIMARY KEY (`a`) NOT ENFORCED;"), ("ALTER TABLE t ADD x", "ALTER TABLE t ADD x")], render.pretty)
_calls("ddl_color", "mode shown", [("never", "SELECT `a` -- b"), ("always", "\x1b[96mSELECT\x1b[0m \x1b[92m`a`\x1b[0m \x1b[93m-- b\x1b[0m")], lambda mode: render.colored("SELECT `a` -- b", mode))
_calls("model_from_tree", "spec paths", [("a:INT64!, r:RECORD(x:STRING, y:RECORD(z:DATE)), l:RECORD*(q:INT64)", "a,r.x,r.y.z,l")], lambda spec: ",".join(fields.leaves(fields.parse_spec(spec))))
_calls("model_to_tree", "spec tree", [("a:INT64!, r:RECORD(x:STRING!, y:BOOLEAN), l:RECORD*(q:FLOAT64), t:STRING*", '{"a": "INT64", "r": {"x": "STRING", "y": "BOOLEAN"}, "l": [{"q": "FLOAT64"}], "t": ["STRING"]} a,r.x')], lambda spec: f"{json.dumps(fields.tree(fields.parse_spec(spec)))} {','.join(fields.required(fields.parse_spec(spec)))}")

# ---------------------------------------------------------------- reports

_DIFF = [("a", "only_left", None, None), ("b", "only_right", None, None), ("c", "type_mismatch", "int", "str"), ("d", "presence", "str", "union(missing|str)"), ("e", "common", None, None), ("b2", "only_right", None, None)]
_MOVED = [{"name": "n", "shared": ["x.n"], "left": ["items[0].n"], "right": []}]
_REPORT = "-- Only in left: L -- (1)\n  a\n-- Only in right: R -- (2)\n  b\n  b2\n-- Type mismatches -- (1)\n  c: int -> str\n-- Presence -- (1)\n  d: str -> union(missing|str)\n-- Common -- (1)\n  e"
_stated("rep_text", "text", [(_REPORT,)], lambda spark, sf_dir: _table(spark, "text", [(render.report(_DIFF, "L", "R"),)]))
_stated("rep_paths", "text", [("-- Path changes -- (1)\n  n:\n    in both: x.n\n    only in L: items[].n",)], lambda spark, sf_dir: _table(spark, "text", [(render.report([], "L", "R", _MOVED),)]))
_stated("mig_parse", "path section a b", _DIFF, lambda spark, sf_dir: _table(spark, "path section a b", render.read_report(render.report(_DIFF, "L", "R", _MOVED))))
_IMPACT = {"verdict": "breaking", "removed": 2, "critical_removed": 1, "added": 3, "mismatches": 1, "presence": 0, "common": 4}
_MARKDOWN = "# Migration from L to R\n\nBreaking changes need work before migration.\n\n| | |\n|-|-|\n| removed | 2 |\n| critical removed | 1 |\n| added | 3 |\n| mismatches | 1 |\n| presence | 0 |\n| common | 4 |"
_stated("mig_markdown", "text", [(_MARKDOWN,)], lambda spark, sf_dir: _table(spark, "text", [(render.migration_markdown(_IMPACT, "L", "R"),)]))
_calls("mig_report", "form text", [("markdown", _MARKDOWN), ("text", "Migration from L to R: breaking\n  removed: 2\n  critical removed: 1\n  added: 3\n  mismatches: 1\n  presence: 0\n  common: 4"), ("json", '{"source": "L", "target": "R", "verdict": "breaking", "removed": 2, "critical_removed": 1, "added": 3, "mismatches": 1, "presence": 0, "common": 4}'), ("xml", "error")], lambda form: render.migration_report(_IMPACT, "L", "R", form))
_FOUND = {"Complexity": [{"table_name": "t", "fields": 2}], "Findings": [], "Types": [{"t": "INT64", "n": 1}, {"t": "STRING", "n": 1}]}
_stated("cli_text", "text", [("== Complexity ==\n  table_name=t  fields=2\n\n== Types ==\n  t=INT64  n=1\n  t=STRING  n=1",)], lambda spark, sf_dir: _table(spark, "text", [(report.as_text(_FOUND),)]))
_stated("cli_md", "text", [("## Complexity\n\n| table_name | fields |\n|-|-|\n| t | 2 |\n\n## Types\n\n| t | n |\n|-|-|\n| INT64 | 1 |\n| STRING | 1 |",)], lambda spark, sf_dir: _table(spark, "text", [(report.as_markdown(_FOUND),)]))
_stated("agg_report", "section", [("Complexity",), ("Types",), ("Patterns",), ("Categories",), ("Policy tags",), ("Findings",)], lambda spark, sf_dir: _table(spark, "section", [(line[3:],) for line in report.as_markdown(report.sections(fields.catalog(spark, {"users": fixtures.TABLES["users"]}))).splitlines() if line.startswith("## ")]))


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two schema texts of unlike formats, compared."""
    left = compare.profile(spark, parsers.json_schema(_B3))
    right = compare.profile(spark, parsers.sql_schema("CREATE TABLE t (user STRUCT<id STRING NOT NULL, name STRING> NOT NULL, rows ARRAY<STRUCT<sku STRING NOT NULL, n BOOL>>, extra DATE)"))
    return compare.diff(left, right).toDF("path", "section", "a", "b")


_stated("diff_unified", "path section a b", [
    ("user.id", "type_mismatch", "int", "str"), ("extra", "only_right", None, "date|missing"), ("user.name", "common", "missing|str", "missing|str"), ("rows[0].sku", "common", "str", "str"), ("rows[0].n", "common", "bool|missing", "bool|missing"),
], _unified)


_ONE_TABLE = {
    "dim_item": "item_key:INT64!, tags:STRING*, weight:FLOAT64",
    "dim_state": "state_key:INT64!, status_code:STRING, status_text:STRING",
    "fact_stock": "stock_key:INT64!, snapshot_date:DATE, balance:INT64!",
    "fact_line": "order_id:INT64!, line_id:INT64!, amount:NUMERIC, amount_unit:STRING",
    "dim_brand": "brand_code:STRING!, label:STRING",
    "dim_rapid": "rapid_key:INT64!, mail_status:STRING, vip_flag:BOOLEAN, view_setting:STRING",
    "plain": "id:INT64!, tags:STRING*, weight:FLOAT64",
}
_SEVERAL = {
    "fact_sale": "sale_key:INT64!, order_date_key:INT64, ship_date_key:INT64, item_key:INT64!, gone_key:INT64, amount:NUMERIC",
    "fact_back": "back_key:INT64!, item_key:STRING!",
    "customer_group": "customer_key:INT64!, group_key:INT64!, share:NUMERIC",
    "dim_item": "item_key:INT64!, brand_key:INT64!",
    "dim_brand": "brand_key:INT64!, maker_key:INT64!",
    "dim_maker": "maker_key:INT64!",
    "dim_date": "date_key:INT64!, year:INT64",
    "dim_group": "group_key:INT64!",
    "dim_customer": "customer_key:INT64!",
}
_SEVERAL_KEYS = [("fact_sale", "order_date_key", "dim_date"), ("fact_sale", "ship_date_key", "dim_date"), ("fact_sale", "item_key", "dim_item"), ("fact_sale", "gone_key", "dim_gone"), ("fact_back", "item_key", "dim_item"), ("customer_group", "customer_key", "dim_customer"), ("customer_group", "group_key", "dim_group"), ("dim_item", "brand_key", "dim_brand"), ("dim_brand", "maker_key", "dim_maker")]


def _dimensional(single: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = fields.catalog(spark, {t: fields.parse_spec(x) for t, x in (_ONE_TABLE if single else _SEVERAL).items()})
        keys = spark.createDataFrame([] if single else _SEVERAL_KEYS, "table_name string, col string, ref_table string")
        return rules.find_dimensional(spark, catalog, single, fk=keys, pk=spark.createDataFrame([], "table_name string, col string, pos int")).select("table_name", "pattern").distinct()

    return query


_stated("dim_single", "table_name pattern", [
    ("dim_item", "dimension_with_arrays"), ("dim_item", "missing_unit_of_measure"), ("dim_state", "code_value_antipattern"), ("fact_stock", "snapshot_date_nullable"), ("fact_stock", "snapshot_with_semi_additive"),
    ("fact_line", "mixed_grain_fact"), ("dim_brand", "dimension_missing_surrogate_key"), ("dim_rapid", "mini_dimension_rapid"), ("plain", "missing_unit_of_measure"),
], _dimensional(True))
_stated("dim_advanced", "table_name pattern", [
    ("customer_group", "bridge_by_fk"), ("dim_item", "snowflake_depth_excessive"), ("dim_item", "conformed_dim_type_inconsistency"), ("fact_back", "fact_too_denormalized"),
    ("fact_sale", "late_arriving_fact_risk"), ("fact_sale", "orphan_fk_risk"), ("dim_date", "incomplete_date_dimension"),
], _dimensional(False))

# ---------------------------------------------------------------- driver-side support


def _attempts(fails: int) -> tuple[str, str]:
    """What a call that fails so many times gives in three attempts, and the waits between them."""
    waits, calls = [], []

    @support.retrying(3, 1.0, 2.0, OSError, sleep=waits.append)
    def call() -> str:
        calls.append(1)
        if len(calls) <= fails:
            raise OSError("not yet")
        return f"done after {len(calls)}"

    try:
        return call(), str(waits)
    except OSError as e:
        return f"{e} after {len(calls)}", str(waits)


def _remembered(case: str) -> int:
    """How often the function behind a memory ran."""
    runs, memory = [], support.Memory(seconds=0.0 if case == "too old" else None)
    call = memory.remember(lambda *a, **k: runs.append(a) or len(runs))
    call(1, k=2)
    if case == "cleared":
        memory.clear()
    if case == "too old":
        memory.held = {k: (made - 1, v) for k, (made, v) in memory.held.items()}
    call(1, k=3) if case == "another argument" else call(1, k=2)
    return len(runs)


def _logged(level: str) -> str:
    """What a log of a level takes in."""
    lines = []
    logger = logging.Logger("apart", level)
    handler = logging.Handler()
    handler.emit = lambda record: lines.append(record.levelname)
    logger.addHandler(handler)
    for n in ("debug", "info", "warning", "error"):
        getattr(logger, n)("x")
    return ",".join(lines)


def _error(case: str) -> tuple[str, str]:
    inner = KeyError("k")
    made = {"plain": errors.EngineError("bad"), "details": errors.SchemaError("bad", path="a.sql", line=3, column=None), "own": errors.wrapped(errors.StoreError("gone", path="p")), "other": errors.wrapped(ValueError("odd")), "named": errors.wrapped(inner, "unreadable", errors.SettingError, option="x")}[case]
    return str(made), type(made).__name__


_calls("inf_errors", "given text kind", [("plain", ("bad", "EngineError")), ("details", ("bad (path=a.sql, line=3)", "SchemaError"))], _error)
_calls("inf_wrap", "given text kind", [("own", ("gone (path=p)", "StoreError")), ("other", ("odd", "EngineError")), ("named", ("unreadable (option=x)", "SettingError"))], _error)
_calls("inf_retry", "fails result waits", [(0, ("done after 1", "[]")), (2, ("done after 3", "[1.0, 2.0]")), (5, ("not yet after 3", "[1.0, 2.0]"))], _attempts)
_calls("inf_bq_retry", "error transient", [("429 too many requests", True), ("500 oops", True), ("backend: 503", True), ("request timed out", True), ("404 not found", False), ("5000 rows", False)], lambda text: support.is_transient(RuntimeError(text)))
_calls("inf_cache", "given runs", [("same", 1), ("another argument", 2), ("cleared", 2), ("too old", 2)], _remembered)
_calls("inf_cache_deco", "name kept", [("f", "f")], lambda name: support.Memory().remember(_named(name)).__name__)
_calls("inf_timing", "value same", [(5, 5), (0, 0)], lambda v: support.timed(_named("f"))(v))
_calls("inf_exists", "path found", [("/no/such/file", "error"), ("/etc/hosts", "found")], lambda path: support.needs_file(lambda p: "found")(path))
_calls("inf_logging", "level lines", [("DEBUG", "DEBUG,INFO,WARNING,ERROR"), ("WARNING", "WARNING,ERROR"), ("ERROR", "ERROR")], _logged)
_calls("inf_config", "color codes", [(True, 5), (False, 1)], lambda color: len(set(support.Settings(color=color).colors())))


def _named(name: str) -> Callable:
    def call(value=None):
        return value

    call.__name__ = name
    return call


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file copied by Spark's file systems: once, again without force after it changed, and with it."""
    source, local = f"{shared_folder(spark)}/a.json", tempfile.mkdtemp()
    rows = []
    for step, content, force in (("first", b"1", False), ("kept", b"2", False), ("forced", b"3", True)):
        _put(spark, source, content)
        with open(stores.fetch(spark, source, f"{local}/x/a.json", force), "rb") as f:
            rows.append((step, f.read().decode()))
    try:
        stores.fetch(spark, source + ".none", f"{local}/none")
    except errors.StoreError as e:
        rows.append(("missing", e.message))
    return _table(spark, "step content", rows)


_stated("src_gcs_download", "step content", [("first", "1"), ("kept", "1"), ("forced", "3"), ("missing", "no such object")], _fetched)
_stated("src_gcs_status", "scheme ready", [("file", True), ("nowhere", False)], lambda spark, sf_dir: _table(spark, "scheme ready", [(s, stores.store_status(spark, f"{s}:///x")[0]) for s in ("file", "nowhere")]))
_stated("src_resolve", "path local", [("/a/b.json", "/a/b.json"), ("s3a://b/o", "s3a://b/o")], lambda spark, sf_dir: _table(spark, "path local", [(p, stores.resolve(spark, p)) for p in ("/a/b.json", "s3a://b/o")]))


def _project(given: str) -> str:
    held = {n: os.environ.pop(n, None) for n in stores.PROJECT_VARIABLES}
    try:
        os.environ.update(dict(x.split("=") for x in given.split()))
        return stores.default_project()
    finally:
        for n, value in held.items():
            os.environ.pop(n, None)
            if value is not None:
                os.environ[n] = value


_calls("src_bq_defproj", "environment project", [("GCP_PROJECT=b", "b"), ("GOOGLE_CLOUD_PROJECT=a GCP_PROJECT=b", "a"), ("", "error")], _project)
_stated("src_bq_client", "outcome", [("the session has no connector to the warehouse",)], lambda spark, sf_dir: _table(spark, "outcome", [(_connector(spark),)]))


def _connector(spark: SparkSession) -> str:
    try:
        stores.warehouse_reader(spark, "p")
    except errors.WarehouseError as e:
        return e.message
    return "ready"


def _written(name: str) -> str:
    with tempfile.TemporaryDirectory() as top:
        path = render.write_output("text\n", name, "reports", top)
        return f"{path.relative_to(top)}: {path.read_text().strip()}"


_calls("out_write", "name written", [("a.md", "reports/a.md: text"), ("b/c.txt", "reports/b/c.txt: text")], _written)


def _command(*args: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a command prints about two small inputs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from schemaloom import cli  # the commands import what these queries are about

        with tempfile.TemporaryDirectory() as top:
            for name, text in (("a.json", _B3), ("b.sql", "CREATE TABLE t (user STRUCT<id STRING NOT NULL, name STRING> NOT NULL, extra DATE);")):
                with open(f"{top}/{name}", "w") as f:
                    f.write(text)
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                code = cli.main([x.replace("@", f"{top}/") for x in args], spark)
        return _table(spark, "code line", [(code, x.replace(f"{top}/", "")) for x in out.getvalue().splitlines()])

    return query


_COMPARED = ["-- Only in left: a.json -- (1)", "  rows", "-- Only in right: b.sql -- (1)", "  extra", "-- Type mismatches -- (1)", "  user.id: int -> str"]
_stated("cli_compare", "code line", [(0, x) for x in _COMPARED], _command("compare", "@a.json", "@b.sql", "--no-color"))
_stated("cli_generate", "code line", [(0, x) for x in ['CREATE TABLE t (', '  "user_id" TEXT NOT NULL,', '  "user_name" TEXT,', '  "extra" DATE', ");"]], _command("generate", "@b.sql", "--format", "sql_ddl", "--name", "t"))
_stated("cli_ddl", "code line", [(0, x) for x in ["CREATE OR REPLACE TABLE `t` (", "  `user` STRUCT<", "    `id` STRING NOT NULL,", "    `name` STRING", "  > NOT NULL,", "  `extra` DATE", ");"]], _command("ddl", "@b.sql", "--name", "t", "--no-color"))
QUERIES["cli_analyze"] = lambda spark, sf_dir: _command("analyze", "@b.sql", "--format", "markdown")(spark, sf_dir).where("line like '## %'")
ORACLE_SQL["cli_analyze"] = "select * from (values (0, '## Complexity'), (0, '## Types'), (0, '## Patterns'), (0, '## Categories'), (0, '## Policy tags'), (0, '## Findings')) as t(code, line)"
QUERIES["cli_config"] = lambda spark, sf_dir: _command("config", "--store", "nowhere:///x")(spark, sf_dir).where("line like 'store %' or line like 'renders %'").selectExpr("code", "split(line, ':')[0] as line")
ORACLE_SQL["cli_config"] = "select * from (values (0, 'store missing'), (0, 'renders json_schema sql_ddl bigquery_ddl spark bigquery_json openapi')) as t(code, line)"
_stated("src_loader", "path native_type mode", [("user", "RECORD", "REQUIRED"), ("user.id", "INT64", "REQUIRED"), ("user.name", "STRING", "NULLABLE"), ("rows", "RECORD", "REPEATED"), ("rows.sku", "STRING", "REQUIRED"), ("rows.n", "BOOLEAN", "NULLABLE")], lambda spark, sf_dir: _loaded(spark, "a.json", _B3))
_stated("src_unified", "path native_type mode", [("i", "INT64", "REQUIRED"), ("s", "STRING", "NULLABLE")], lambda spark, sf_dir: _loaded(spark, "a.jsonl", '{"i": 1, "s": "x"}\n{"i": 2}\n'))


def _loaded(spark: SparkSession, name: str, text: str) -> DataFrame:
    from schemaloom import cli

    with tempfile.TemporaryDirectory() as top:
        with open(f"{top}/{name}", "w") as f:
            f.write(text)
        return _table(spark, "path native_type mode", [(r[1], r[6], r[7]) for r in fields.rows("t", cli.load(spark, f"{top}/{name}"))])
