"""Fields to schema texts (JSON Schema, SQL, BigQuery DDL and JSON, Spark, OpenAPI), and their checks."""

from __future__ import annotations

import json
import os
import re
import sys
from pathlib import Path

from pyspark.sql import types as T

from schemaloom.functions.errors import RenderError, SchemaError
from schemaloom.functions.support import COLORS
from schemaloom.sources import parsers
from schemaloom.sources.fields import Field

FORMATS = {"json_schema": "JSON Schema draft-07", "sql_ddl": "PostgreSQL CREATE TABLE", "bigquery_ddl": "BigQuery CREATE TABLE", "spark": "Spark schema tree", "bigquery_json": "BigQuery field list", "openapi": "OpenAPI 3.0 schema"}
_JSON = {"INT64": {"type": "integer"}, "FLOAT64": {"type": "number"}, "NUMERIC": {"type": "number"}, "BOOLEAN": {"type": "boolean"}, "DATE": {"type": "string", "format": "date"}, "TIME": {"type": "string", "format": "time"}, "TIMESTAMP": {"type": "string", "format": "date-time"}, "DATETIME": {"type": "string", "format": "date-time"}, "JSON": {"type": "object"}, "ANY": {}}
_SQL = {"INT64": "INTEGER", "FLOAT64": "REAL", "NUMERIC": "NUMERIC", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP", "JSON": "JSONB"}
INDENT = "  "
_BQ = {"BOOLEAN": "BOOL", "ANY": "JSON"}
_SPARK = {"INT64": T.LongType(), "FLOAT64": T.DoubleType(), "NUMERIC": T.DecimalType(38, 9), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampNTZType(), "BYTES": T.BinaryType()}


def _object(fields: list[Field]) -> dict:
    out: dict = {"type": "object", "properties": {f.name: _json(f) for f in fields}}
    if wanted := [f.name for f in fields if f.mode == "REQUIRED" or f.required]:
        out["required"] = wanted
    return out


def _json(f: Field) -> dict:
    node = _object(f.fields) if f.type == "RECORD" else dict(_JSON.get(f.type, {"type": "string"}))
    if f.mode == "REPEATED":
        node = {"type": "array", "items": node}
    if f.description:
        node["description"] = f.description
    return node


def json_schema(fields: list[Field]) -> str:
    return json.dumps({"$schema": "http://json-schema.org/draft-07/schema#"} | _object(fields), indent=2)


def openapi(fields: list[Field]) -> str:
    return json.dumps(_object(fields), indent=2)


def sql_ddl(fields: list[Field], table: str = "my_table") -> str:
    """Nested members become columns joined by an underscore."""
    lines = []

    def walk(fields: list[Field], prefix: str) -> None:
        for f in fields:
            if f.type == "RECORD" and f.mode != "REPEATED":
                walk(f.fields, f"{prefix}{f.name}_")
                continue
            kind = "JSONB" if f.type == "RECORD" else _SQL.get(f.type, "TEXT") + ("[]" if f.mode == "REPEATED" else "")
            lines.append(f'  "{prefix}{f.name}" {kind}' + (" NOT NULL" if f.mode == "REQUIRED" or f.required else ""))

    walk(fields, "")
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _bq_type(f: Field, level: int = 1) -> str:
    """A type; members of a record stand on lines of their own, indented by their level."""
    if f.type != "RECORD":
        kind = _BQ.get(f.type, f.type)
        return f"ARRAY<{kind}>" if f.mode == "REPEATED" else kind
    own = level + (f.mode == "REPEATED")
    members = ",\n".join(f"{INDENT * (own + 1)}`{k.name}` {_bq_type(k, own + 1)}{' NOT NULL' if k.mode == 'REQUIRED' else ''}{column_options(k)}" for k in f.fields)
    kind = f"STRUCT<\n{members}\n{INDENT * own}>"
    return f"ARRAY<{kind}\n{INDENT * level}>" if f.mode == "REPEATED" else kind


def column_options(f: Field) -> str:
    parts = [f"description={_quoted(f.description)}"] if f.description else []
    if f.tags:
        parts.append("policy_tags=[" + ", ".join(map(_quoted, f.tags)) + "]")
    return f" OPTIONS({', '.join(parts)})" if parts else ""


def partition_clause(column: str | None = None, kind: str = "DATE", bounds: tuple[int, int, int] | None = None) -> str:
    """By integer ranges (start, end, interval), by a date, by the day of another column, or by the day of loading."""
    if column is None:
        return "PARTITION BY _PARTITIONDATE"
    if bounds:
        return f"PARTITION BY RANGE_BUCKET(`{column}`, GENERATE_ARRAY({bounds[0]}, {bounds[1]}, {bounds[2]}))"
    return f"PARTITION BY `{column}`" if kind == "DATE" else f"PARTITION BY DATE(`{column}`)"


def cluster_clause(columns: list[str]) -> str:
    return "CLUSTER BY " + ", ".join(f"`{c}`" for c in columns) if columns else ""


def table_options(options: dict) -> str:
    """OPTIONS(...): labels as sorted pairs, other values in the order given."""
    def shown(key, value) -> str:
        if key == "labels":
            return "[" + ", ".join(f"({_quoted(k)},{_quoted(v)})" for k, v in sorted(value.items())) + "]"
        return ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value) if isinstance(value, int | float) else _quoted(str(value))

    return "OPTIONS(" + ", ".join(f"{k}={shown(k, v)}" for k, v in options.items()) + ")" if options else ""


def constraint(table: str, name: str | None, columns: list[str], other: str | None = None, keys: list[str] | None = None) -> str:
    """An ALTER TABLE that adds a primary key or, with another table, a foreign one."""
    ticked = lambda names: ", ".join(f"`{x}`" for x in names)
    head = f"ALTER TABLE `{table}` ADD " + (f"CONSTRAINT `{name}` " if name else "")
    body = f"FOREIGN KEY ({ticked(columns)}) REFERENCES `{other}`({ticked(keys or [])})" if other else f"PRIMARY KEY ({ticked(columns)})"
    return f"{head}{body} NOT ENFORCED;"


def bigquery_ddl(fields: list[Field], table: str = "my_table", partition: str | None = None, cluster: list[str] | None = None, options: dict | None = None, primary: list[str] | None = None, foreign: list[tuple[str, str, str]] | None = None) -> str:
    """CREATE TABLE with partitioning, clustering, options and constraints."""
    lines = [f"{INDENT}`{f.name}` {_bq_type(f)}" + (" NOT NULL" if f.mode == "REQUIRED" else "") + column_options(f) for f in fields]
    parts = [f"CREATE OR REPLACE TABLE `{table}` (", ",\n".join(lines), ")", partition and (partition if partition.startswith("PARTITION") else f"PARTITION BY {partition}"), cluster_clause(cluster or []), table_options(options or {})]
    out = ["\n".join(p for p in parts if p) + ";"]
    if primary:
        out.append(constraint(table, None, primary))
    out += [constraint(table, None, [column], other, [key]) for column, other, key in foreign or []]
    return "\n".join(out)


def pretty(ddl: str) -> str:
    """A blank line before each ALTER TABLE behind a table's body, and its ADD on a line of its own."""
    out: list[str] = []
    closed = False
    for line in map(str.rstrip, ddl.splitlines()):
        closed |= line.strip() in (")", ");")
        if closed and line.startswith("ALTER TABLE"):
            if out and out[-1]:
                out.append("")
            head, add, rest = line.partition(" ADD ")
            out += [head, f"{INDENT}ADD {rest}"] if add else [line]
        else:
            out.append(line)
    return "\n".join(out)


_SQL_PART = re.compile(r"(?P<comment>--[^\n]*)|(?P<quoted>`[^`]*`|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<word>\b[A-Z][A-Z_0-9]+\b)")


def colored(sql: str, mode: str = "auto") -> str:
    """SQL with ANSI colours; auto colours on a terminal unless NO_COLOR is set."""
    if mode == "never" or mode == "auto" and (not sys.stdout.isatty() or os.environ.get("NO_COLOR")):
        return sql
    red, green, yellow, cyan, end = COLORS
    tints = {"comment": yellow, "quoted": green, "word": cyan}
    return _SQL_PART.sub(lambda m: f"{tints[m.lastgroup]}{m[0]}{end}", sql)


def bigquery_json(fields: list[Field]) -> str:
    build = lambda fs: [{"name": f.name, "type": _BQ.get(f.type, f.type), "mode": f.mode} | ({"description": f.description} if f.description else {}) | ({"fields": build(f.fields)} if f.fields else {}) for f in fs]
    return json.dumps(build(fields), indent=2)


def struct(fields: list[Field]) -> T.StructType:
    def kind(f: Field) -> T.DataType:
        inner = struct(f.fields) if f.type == "RECORD" else T.MapType(T.StringType(), T.StringType()) if f.type == "JSON" else _SPARK.get(f.type, T.StringType())
        return T.ArrayType(inner) if f.mode == "REPEATED" else inner

    return T.StructType([T.StructField(f.name, kind(f), f.mode != "REQUIRED", {"description": f.description} if f.description else None) for f in fields])


def spark(fields: list[Field]) -> str:
    return struct(fields).treeString()


RENDERERS = {"json_schema": json_schema, "sql_ddl": sql_ddl, "bigquery_ddl": bigquery_ddl, "spark": spark, "bigquery_json": bigquery_json, "openapi": openapi}


def render(fields: list[Field], form: str, table: str = "my_table") -> str:
    if form not in RENDERERS:
        raise RenderError("unknown format", format=form, known=" ".join(RENDERERS))
    return RENDERERS[form](fields, table) if form in ("sql_ddl", "bigquery_ddl") else RENDERERS[form](fields)


# Types that a checked text may name.
_ROOTS = ["object", "array", "string", "number", "integer", "boolean"]
_FIELD_TYPES = ["STRING", "INT64", "FLOAT64", "BOOL", "DATE", "DATETIME", "TIME", "TIMESTAMP", "BYTES", "RECORD", "INTEGER", "FLOAT", "BOOLEAN", "STRUCT", "NUMERIC", "BIGNUMERIC", "JSON", "GEOGRAPHY", "INTERVAL"]
_TREE_TYPES = ["string", "long", "double", "boolean", "array", "struct", "timestamp", "timestamp_ntz", "date", "integer", "short", "byte", "float", "binary", "map", "variant", "void"]


def _check_json(text: str, form: str) -> list[str]:
    data = json.loads(text)
    if form == "bigquery_json":
        if not isinstance(data, list):
            return ["not a list of fields"]
        out = []
        for i, x in enumerate(data):
            lacking = ["name", "type"] if not isinstance(x, dict) else [k for k in ("name", "type") if k not in x]
            out += [f"field {i} has no {k}" for k in lacking]
            if not lacking and x["type"] not in _FIELD_TYPES:
                out.append(f"field {i} has the unknown type {x['type']}")
            if not lacking and x.get("fields"):
                out += [f"{x['name']}: {p}" for p in _check_json(json.dumps(x["fields"]), form)]
        return out
    if not isinstance(data, dict) or "type" not in data:
        return ["no top-level type"]
    out = [] if data["type"] in _ROOTS + ["null"] * (form == "json_schema") else [f"unknown type {data['type']}"]
    if form == "json_schema" and not str(data.get("$schema", "")).startswith("http://json-schema.org/"):
        out.append("no $schema of a known version")
    if not isinstance(data.get("properties", {}), dict):
        out.append("properties are no object")
    return out


def _check_tree(text: str) -> list[str]:
    lines = text.strip().splitlines()
    out = [] if lines and lines[0].strip() == "root" else ["no root line"]
    for line in lines[1:]:
        m = re.match(r"^[ |]*\|-- .+: (\S.*) \(\w+ = (true|false)\)$", line)
        if not m:
            out.append(f"not a field: {line!r}")
        elif m[1].split("(")[0].split("<")[0].strip() not in [*_TREE_TYPES, "decimal"]:
            out.append(f"unknown type {m[1]}")
    return out


def _check_ddl(text: str, form: str) -> list[str]:
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)
    out = [] if re.match(r"\s*create\s+(or\s+replace\s+)?table\b", bare, re.I) else ["no CREATE TABLE"]
    out += [f"unbalanced {a}{b}" for a, b in ("()", "<>", "[]") if bare.count(a) != bare.count(b)]
    if not bare.rstrip().endswith(";"):
        out.append("no semicolon")
    if form == "bigquery_ddl" and not re.search(r"table\s+`[^`]+`", bare, re.I):
        out.append("the table's name has no backticks")
    if out:
        return out
    try:
        tables = parsers.sql_tables(text)
    except SchemaError as e:
        return [str(e)]
    if "" in tables or not all(tables.values()):
        return ["no columns"]
    return [f"unknown type of {f.name}" for own in tables.values() for f in parsers.walk(own) if f.type == "ANY"]


def check(text: str, form: str) -> list[str]:
    """What is wrong with a schema text; nothing if it is sound."""
    if form not in FORMATS:
        raise RenderError("unknown format", format=form, known=" ".join(FORMATS))
    try:
        return _check_json(text, form) if form in ("json_schema", "openapi", "bigquery_json") else _check_tree(text) if form == "spark" else _check_ddl(text, form)
    except ValueError as e:
        return [str(e)]


_TITLES = {"only_left": "Only in left: ", "only_right": "Only in right: ", "type_mismatch": "Type mismatches", "presence": "Presence", "common": "Common", "paths": "Path changes"}


def report(rows: list[tuple[str, str, str | None, str | None]], left: str, right: str, moved: list[dict] | None = None, colors: tuple[str, ...] = ("",) * 5) -> str:
    """A diff (path, section, left, right) as text, and names that stand at other paths (name, shared, left, right)."""
    red, green, yellow, cyan, end = colors
    titles = _TITLES | {"only_left": f"Only in left: {left}", "only_right": f"Only in right: {right}"}
    out = []
    for key in ("only_left", "only_right", "type_mismatch", "presence", "common"):
        mine = sorted(r for r in rows if r[1] == key)
        if mine:
            out.append(f"{yellow}-- {titles[key]} -- ({len(mine)}){end}")
            out += [f"  {cyan}{p}{end}: {red}{a}{end} -> {green}{b}{end}" if key in ("type_mismatch", "presence") else f"  {cyan}{p}{end}" for p, _, a, b in mine]
    if moved:
        out.append(f"{yellow}-- {titles['paths']} -- ({len(moved)}){end}")
        for m in sorted(moved, key=lambda m: m["name"]):
            out.append(f"  {cyan}{m['name']}{end}:")
            for key, title in (("shared", "in both"), ("left", f"only in {left}"), ("right", f"only in {right}")):
                if m.get(key):
                    out.append(f"    {title}: " + ", ".join(p.lstrip(".").replace("[0]", "[]") for p in m[key]))
    return "\n".join(out)


def read_report(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """The rows of a report's text again: path, section, left, right."""
    keys = {title: key for key, title in _TITLES.items()}
    out, section = [], None
    for line in re.sub(r"\x1b\[[0-9;]*m", "", text).splitlines():
        if m := re.match(r"-- (.*) -- \(\d+\)$", line):
            section = next((k for t, k in keys.items() if m[1].startswith(t)), None)
        elif section and section != "paths" and line.startswith("  "):
            path, arrow, change = line.strip().partition(": ")
            a, _, b = change.partition(" -> ")
            out.append((path, section, a, b) if arrow and section in ("type_mismatch", "presence") else (line.strip(), section, None, None))
    return out


def write_output(content: str, name: str, folder: str | None = None, top: str = "output") -> Path:
    """Write a text below ./output, in a folder of it if named."""
    target = Path(top) / (folder or "") / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content, encoding="utf-8")
    return target


def sample_line(path: str, left: dict[str, list[str]], right: dict[str, list[str]]) -> str:
    """Up to five shown samples of a path from each side, a line a side."""
    return "\n".join(f"    Samples ({side}):{' ' * (6 - len(side))} [{', '.join(values[path][:5])}]" for side, values in (("left", left), ("right", right)) if values.get(path))


def sample_table(path: str, left: dict[str, list[str]], right: dict[str, list[str]], names: tuple[str, str] = ("Left", "Right"), widest: int = 50) -> str:
    """The samples of a path side by side."""
    columns = [left.get(path, [])[:5], right.get(path, [])[:5]]
    if not any(columns):
        return ""
    rows = [names] + [tuple(c[i] if i < len(c) else "" for c in columns) for i in range(max(map(len, columns)))]
    wide = [min(widest, max(len(r[k]) for r in rows)) for k in (0, 1)]
    rule = "    " + "─" * (sum(wide) + 7)
    lines = ["    │ " + " │ ".join(r[k][: wide[k]].ljust(wide[k]) for k in (0, 1)) + " │" for r in rows]
    return "\n".join([rule, lines[0], rule, *lines[1:], rule])


_COUNTS = ("removed", "critical_removed", "added", "mismatches", "presence", "common")


def migration_report(row: dict, source: str, target: str, form: str = "markdown") -> str:
    """The counts of mig_analyze as markdown, text or json."""
    if form == "json":
        return json.dumps({"source": source, "target": target, "verdict": row["verdict"]} | {k: row[k] for k in _COUNTS})
    if form == "text":
        return "\n".join([f"Migration from {source} to {target}: {row['verdict']}", *(f"  {k.replace('_', ' ')}: {row[k]}" for k in _COUNTS)])
    if form != "markdown":
        raise RenderError("unknown form of a report", form=form)
    return migration_markdown(row, source, target)


def migration_markdown(row: dict, source: str, target: str) -> str:
    """The counts of mig_analyze as a report."""
    verdict = {"breaking": "Breaking changes need work before migration.", "review": "Compatible after review.", "compatible": "Compatible."}[row["verdict"]]
    lines = [f"# Migration from {source} to {target}", "", verdict, "", "| | |", "|-|-|"]
    return "\n".join(lines + [f"| {k.replace('_', ' ')} | {row[k]} |" for k in _COUNTS])
