"""Schema texts to fields: JSON Schema, Spark trees, SQL DDL, dbt, protobuf and BigQuery JSON.

Every parser returns Field trees whose types are canonical (INT64, STRING,
RECORD, ...). One text is parsed where it is asked for; operators/texts.py
parses tables of them on the executors.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import types as T

from schemaloom.functions.errors import SchemaError, SettingError
from schemaloom.functions.lexicon import SPARK_TYPES, SQL_TYPES
from schemaloom.sources.fields import Field, from_struct
from schemaloom.sources.yaml_text import read_yaml

_NATIVE = {"int": "INT64", "float": "FLOAT64", "bool": "BOOLEAN", "str": "STRING", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "any": "ANY", "object": "JSON", "missing": "ANY"}


def walk(fields: list[Field]):
    """All fields, parents before children."""
    for f in fields:
        yield f
        yield from walk(f.fields)


def unquoted(name: str) -> str:
    """A name without the quotes around it."""
    name = name.strip()
    return name[1:-1] if len(name) > 1 and name[0] in "'\"`[" and name[-1] in "'\"`]" else name


# ---------------------------------------------------------------- JSON Schema


def _json_node(name: str, node: dict, required: bool) -> Field:
    kinds = node.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    optional = "null" in kinds
    kinds = [k for k in kinds if k != "null"]
    for key in ("oneOf", "anyOf", "allOf"):
        if not kinds and node.get(key):
            parts = [x for x in node[key] if x.get("type") != "null"]
            optional |= len(parts) < len(node[key])
            if parts:
                inner = _json_node(name, parts[0], required)
                inner.mode = "NULLABLE" if optional and inner.mode == "REQUIRED" else inner.mode
                return inner
    mode = "REQUIRED" if required and not optional else "NULLABLE"
    kind = kinds[0] if kinds else "object" if "properties" in node else "string" if "enum" in node else "any"
    note = node.get("description")
    if kind == "object" and node.get("properties"):
        wanted = set(node.get("required", []))
        return Field(name, "RECORD", mode, note, [], [_json_node(k, v, k in wanted) for k, v in node["properties"].items()])
    if kind == "array":
        inner = _json_node(name, node.get("items") or {}, False)
        return Field(name, inner.type, "REPEATED", note, [], inner.fields, required and not optional)
    formats = {"date-time": "TIMESTAMP", "date": "DATE", "time": "TIME"}
    native = {"integer": "INT64", "number": "FLOAT64", "boolean": "BOOLEAN", "object": "JSON", "string": formats.get(node.get("format"), "STRING")}.get(kind, "ANY")
    return Field(name, native, mode, note)


def json_schema(text: str) -> list[Field]:
    root = json.loads(text)
    return _json_node("", root, True).fields


# ---------------------------------------------------------------- Spark


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
_MARKS = re.compile(rf"{_QUOTED}|[<>(),]")
_ROUND = re.compile(rf"{_QUOTED}|[()]")


def _split(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    if "<" not in text and "(" not in text and "'" not in text and '"' not in text:
        return [x for x in map(str.strip, text.split(",")) if x]
    out, deep, last = [], 0, 0
    for m in _MARKS.finditer(text):
        mark = m[0]
        if mark == ",":
            if not deep:
                out.append(text[last : m.start()])
                last = m.end()
        elif mark in "<(":
            deep += 1
        elif mark in ">)":
            deep -= 1
    out.append(text[last:])
    return [x for x in map(str.strip, out) if x]


def _closed(text: str, at: int) -> int:
    """Behind the parenthesis that closes the one before `at`."""
    deep = 1
    for m in _ROUND.finditer(text, at):
        deep += (m[0] == "(") - (m[0] == ")")
        if not deep:
            return m.end()
    return len(text) + 1


def spark_type(name: str, text: str, mode: str = "NULLABLE") -> Field:
    """An inline type such as array<struct<a:int>>."""
    text = text.strip()
    low = text.lower()
    if low.startswith("array<"):
        inner = spark_type(name, text[6:-1])
        return Field(name, inner.type, "REPEATED", None, [], inner.fields)
    if low.startswith("struct<"):
        return Field(name, "RECORD", mode, None, [], [spark_type(*x.split(":", 1)) for x in _split(text[7:-1])])
    if low.startswith("map<"):
        return Field(name, "JSON", mode)
    return Field(name, _NATIVE[SPARK_TYPES.get(low.split("(")[0], "any")], mode)


_TREE = re.compile(r"^((?:\s|\|)*)\|--\s*(.+?):\s*(\S.*?)\s*\((?:nullable|containsNull|valueContainsNull)\s*=\s*(true|false)\)\s*$")


def spark_tree(text: str) -> list[Field]:
    """The text of printSchema."""
    root = Field("", "RECORD")
    stack: list[tuple[int, Field]] = [(-1, root)]
    for line in text.splitlines():
        m = _TREE.match(line)
        if not m:
            continue
        indent, name, kind, maybe = len(m[1]), m[2], m[3], m[4] == "true"
        while stack[-1][0] >= indent:
            stack.pop()
        above = stack[-1][1]
        if name in ("element", "key", "value") and above.type in ("ARRAY", "JSON"):
            if above.type == "JSON":
                stack.append((indent, Field("", "JSON")))
                continue
            f = spark_type(above.name, kind) if kind not in ("struct", "array", "map") else Field(above.name, {"struct": "RECORD", "array": "ARRAY", "map": "JSON"}[kind])
            above.type, above.fields, above.mode = f.type, f.fields, "REPEATED"
            stack.append((indent, above))
            continue
        f = spark_type(name, kind) if kind not in ("struct", "array", "map") else Field(name, {"struct": "RECORD", "array": "ARRAY", "map": "JSON"}[kind])
        if f.mode == "NULLABLE" and not maybe:
            f.mode = "REQUIRED"
        above.fields.append(f)
        stack.append((indent, f))
    return root.fields


# ---------------------------------------------------------------- SQL

_CREATE = re.compile(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([`\"\w.\-]+)\s*\(", re.I)
_STOP = re.compile(r"\s+(?:not\s+null|null|default|collate|references|generated|identity|options|primary|unique|check|constraint|on\s+(?:update|delete))\b.*$", re.I | re.S)


_CONSTRAINT = re.compile(r"(primary|foreign|unique|constraint|check)\b", re.I)
_REMARK = re.compile(r"--.*?$|/\*.*?\*/", re.M | re.S)
_COLUMN = re.compile(r"\s*(`[^`]+`|\"[^\"]+\"|[\w$]+)\s+(.*)$", re.S)
_ANGLES = re.compile(r"[<>]")
_NOTE = re.compile(r"description\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_NEEDED = re.compile(r"not\s+null|primary\s+key", re.I)
_PRECISION = re.compile(r"\s*\([^)]*\)")
_AROUND = re.compile(r"\s*([<>])\s*")
_MANY = re.compile(r"(?:\[\])*")


def sql_type(name: str, text: str, mode: str = "NULLABLE", names: dict[str, str] = SQL_TYPES) -> Field:
    text = text.strip()
    if "<" in text:
        text = _AROUND.sub(r"\1", text)
    low = text.lower()
    if low.startswith("array<") and text.endswith(">"):
        inner = sql_type(name, text[6:-1], "NULLABLE", names)
        return Field(name, inner.type, "REPEATED", None, [], inner.fields)
    if low.startswith("struct<") and text.endswith(">"):
        return Field(name, "RECORD", mode, None, [], [_sql_column(x, names) for x in _split(text[7:-1])])
    if low.startswith("map<"):
        return Field(name, "JSON", mode)
    if text.endswith("[]"):
        inner = sql_type(name, text[:-2], "NULLABLE", names)
        return Field(name, inner.type, "REPEATED", None, [], inner.fields)
    return Field(name, _NATIVE[names.get(_PRECISION.sub("", low) if "(" in low else low, "any")], mode)


def _sql_column(text: str, names: dict[str, str] = SQL_TYPES) -> Field:
    m = _COLUMN.match(text)
    if not m:
        raise SchemaError(f"no column in {text!r}")
    name, rest = unquoted(m[1]), m[2].strip()
    if "<" in rest and rest[:6].lower().startswith(("array", "struct", "map")):
        deep = cut = 0
        for mark in _ANGLES.finditer(rest):
            deep += 1 if mark[0] == "<" else -1
            if not deep:
                cut = mark.end()
                break
        cut = _MANY.match(rest, cut).end()
        kind, tail = rest[:cut], rest[cut:]
    elif " " in rest or "\n" in rest or "\t" in rest:
        kind = _STOP.sub("", " " + rest).strip()
        tail = rest[len(kind) :]
    else:
        kind, tail = rest, ""
    f = sql_type(name, kind, "NULLABLE", names)
    if tail:
        note = _NOTE.search(tail)
        f.description = (note[1] or note[2]) if note else None
        f.required = _NEEDED.search(tail) is not None
        if f.required and f.mode == "NULLABLE":
            f.mode = "REQUIRED"
    return f


def sql_tables(text: str, names: dict[str, str] = SQL_TYPES) -> dict[str, list[Field]]:
    """Every CREATE TABLE of a text by name; a loose column list has the name ''."""
    if "--" in text or "/*" in text:
        text = _REMARK.sub("", text)
    out = {}
    for m in _CREATE.finditer(text):
        columns = [x for x in _split(text[m.end() : _closed(text, m.end()) - 1]) if not _CONSTRAINT.match(x)]
        out[m[1].replace("`", "").replace('"', "")] = [_sql_column(x, names) for x in columns]
    if not out and text.strip():
        out[""] = [_sql_column(x.rstrip(","), names) for x in _split(text.strip().rstrip(";"))]
    return out


def sql_schema(text: str, table: str | None = None) -> list[Field]:
    """One table: by full or short name, else the first by name."""
    found = sql_tables(text)
    for name in sorted(found):
        if table is None or name == table or name.split(".")[-1] == table:
            return found[name]
    raise SchemaError(f"no table {table!r}")


# ---------------------------------------------------------------- dbt


def _dbt_columns(columns: list[dict]) -> list[Field]:
    out = []
    for col in columns:
        tests = [t if isinstance(t, str) else next(iter(t), "") for t in [*(col.get("tests") or []), *(col.get("data_tests") or [])]]
        rules = [c.get("type") for c in col.get("constraints") or []]
        f = sql_type(col["name"], col["data_type"]) if col.get("data_type") else Field(col["name"], "ANY")
        if f.mode == "NULLABLE" and ("not_null" in tests or "not_null" in rules):
            f.mode = "REQUIRED"
        f.description = col.get("description")
        out.append(f)
    return out


def dbt_manifest(text: str, model: str | None = None) -> list[Field]:
    nodes = {k: v for k, v in json.loads(text).get("nodes", {}).items() if v.get("resource_type", "model") == "model"}
    for key, node in nodes.items():
        if model is None or model in (key, node.get("name"), node.get("alias"), key.split(".")[-1]):
            return _dbt_columns([{"name": k} | v for k, v in (node.get("columns") or {}).items()])
    raise SchemaError(f"no model {model!r}")


def dbt_yaml(text: str | dict, model: str | None = None) -> list[Field]:
    """A schema.yml, as text or already read."""
    document = read_yaml(text) if isinstance(text, str) else text
    for m in (document or {}).get("models") or []:
        if model is None or m.get("name") == model:
            return _dbt_columns(m.get("columns") or [])
    raise SchemaError(f"no model {model!r}")


def dbt_model(text: str) -> list[Field]:
    """The output columns of the last SELECT of a model's text."""
    text = re.sub(r"--.*?$|/\*.*?\*/|\{#.*?#\}", "", text, flags=re.M | re.S)
    lists = re.findall(r"\bselect\b(?:\s+distinct\b)?(.*?)\bfrom\b", text, re.I | re.S)
    if not lists:
        raise SchemaError("no SELECT")
    out = []
    for item in _split(lists[-1]):
        m = re.search(r"(?:\bas\s+)?[`\"]?([A-Za-z_]\w*)[`\"]?\s*$", item, re.I)
        if m and not item.endswith("*"):
            out.append(Field(m[1], "ANY"))
    return out


# ---------------------------------------------------------------- protobuf

_PROTO = {"double": "FLOAT64", "float": "FLOAT64", "bool": "BOOLEAN", "string": "STRING", "bytes": "STRING", "google.protobuf.Timestamp": "TIMESTAMP"} | {f"{a}{b}": "INT64" for a in ("int", "uint", "sint", "fixed", "sfixed") for b in ("32", "64")}
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\w.]+|[{}=;<>,\[\]()]')


def proto_messages(text: str) -> dict[str, list[tuple[str, str, str]]]:
    """Fully qualified messages to (label, type, name); enums appear as keys with the value None."""
    tokens = _TOKEN.findall(re.sub(r"//.*?$|/\*.*?\*/", "", text, flags=re.M | re.S))
    out: dict = {}
    scope: list[str] = []
    package, i = "", 0
    while i < len(tokens):
        t = tokens[i]
        if t == "package":
            package, i = tokens[i + 1], i + 3
        elif t in ("message", "enum") and tokens[i + 2] == "{":
            scope.append(tokens[i + 1])
            name = ".".join(filter(None, [package, *[s for s in scope if s]]))
            out[name] = [] if t == "message" else None
            i += 3
            if t == "enum":
                while tokens[i] != "}":
                    i += 1
        elif t == "oneof":
            scope.append("")
            i += 3
        elif t == "}":
            if scope:
                scope.pop()
            i += 1
        elif any(scope) and t not in ("option", "reserved", "extensions"):
            label = ""
            if t in ("repeated", "optional", "required"):
                label, i = t, i + 1
            kind = tokens[i]
            if kind == "map":
                while tokens[i] != ">":
                    i += 1
            name = ".".join(filter(None, [package, *[s for s in scope if s]]))
            out[name].append((label, kind, tokens[i + 1]))
            while tokens[i] != ";":
                i += 1
            i += 1
        else:
            while i < len(tokens) and tokens[i] not in (";", "{"):
                i += 1
            i += 1
    return out


def proto_schema(text: str, message: str | None = None) -> list[Field]:
    """One message (by full or short name, else the first), references resolved from the inner scope outwards."""
    known = proto_messages(text)
    names = [k for k, v in known.items() if v is not None]
    root = next((k for k in names if message is None or k == message or k.split(".")[-1] == message), None)
    if root is None:
        raise SchemaError(f"no message {message!r}")

    def resolve(kind: str, scope: str) -> str | None:
        if kind.startswith("."):
            return kind[1:] if kind[1:] in known else None
        parts = scope.split(".")
        for k in range(len(parts), -1, -1):
            if (full := ".".join([*parts[:k], kind])) in known:
                return full
        return None

    def build(name: str, seen: tuple[str, ...]) -> list[Field]:
        out = []
        for label, kind, leaf in known[name]:
            mode = {"repeated": "REPEATED", "required": "REQUIRED"}.get(label, "NULLABLE")
            target = resolve(kind, name)
            if kind in _PROTO:
                out.append(Field(leaf, _PROTO[kind], mode))
            elif kind == "map" or target is None or target in seen:
                out.append(Field(leaf, "JSON", mode))  # a recursive message stops here
            elif known[target] is None:
                out.append(Field(leaf, "STRING", mode))
            else:
                out.append(Field(leaf, "RECORD", mode, None, [], build(target, (*seen, target))))
        return out

    return build(root, (root,))


# ---------------------------------------------------------------- BigQuery JSON


def bigquery_json(text: str) -> list[Field]:
    """A field list, or the table resource of the API that holds one."""
    data = json.loads(text)
    items = data if isinstance(data, list) else data.get("schema", {}).get("fields", data.get("fields"))
    if items is None:
        raise SchemaError("no fields")
    build = lambda xs: [Field(x["name"], {"STRUCT": "RECORD", "BOOL": "BOOLEAN"}.get(x["type"].upper(), x["type"].upper()), x.get("mode", "NULLABLE").upper(), x.get("description"), list((x.get("policyTags") or {}).get("names", [])), build(x.get("fields", []))) for x in xs]
    return build(items)


def unwrap(fields: list[Field]) -> list[Field]:
    """{list: [{element: X}]} becomes a repeated X, at every level."""
    out = []
    for f in fields:
        while len(f.fields) == 1 and f.fields[0].name == "list" and f.fields[0].mode == "REPEATED" and len(f.fields[0].fields) == 1 and f.fields[0].fields[0].name == "element":
            inner = f.fields[0].fields[0]
            f = Field(f.name, inner.type, "REPEATED", f.description, f.tags, inner.fields)
        f.fields = unwrap(f.fields)
        out.append(f)
    return out


# ---------------------------------------------------------------- kinds

def spark_json(text: str) -> list[Field]:
    """The JSON of a Spark schema."""
    return from_struct(T.StructType.fromJson(json.loads(text)))


def spark_ddl(text: str) -> list[Field]:
    """A Spark schema as DDL: a column list, or CREATE TABLE with one."""
    found = sql_tables(re.sub(r"([<,]\s*)(`[^`]+`|\w+)\s*:\s*", r"\1\2 ", text), SQL_TYPES | SPARK_TYPES)
    return found[sorted(found)[0]]


def list_of_fields(document) -> dict | object:
    """[{name, type}, ...] or [{name: type}, ...] as {name: type}; anything else as it is."""
    if isinstance(document, list) and document and all(isinstance(x, dict) for x in document):
        if all("name" in x for x in document):
            return {str(x["name"]): next((x[k] for k in ("type", "dataType", "dtype") if k in x), "any") for x in document}
        if all(len(x) == 1 for x in document):
            return {str(k): v for x in document for k, v in x.items()}
    return document


PARSERS = {"json_schema": json_schema, "spark": spark_tree, "spark_json": spark_json, "spark_ddl": spark_ddl, "sql": sql_schema, "dbt_manifest": dbt_manifest, "dbt_yaml": dbt_yaml, "dbt_model": dbt_model, "protobuf": proto_schema, "bigquery": bigquery_json}
#: Kinds whose texts hold several tables, models or messages.
SELECTING = {"sql", "dbt_manifest", "dbt_yaml", "protobuf"}


def register(kind: str, parser, selecting: bool = False) -> None:
    """Add a parser: text (and a selection, if selecting) to fields."""
    PARSERS[kind] = parser
    if selecting:
        SELECTING.add(kind)


# How much of a file is looked at, and words by which SQL files are told apart.
JSON_PEEK, SQL_PEEK = 131072, 8192
DDL_WORDS = ["create table", "create or replace table", "create schema", "alter table", "drop table"]
MODEL_WORDS = ["select", "{{", "ref(", "source(", "config(", "var("]


def sniff_sql(text: str) -> str:
    """sql or dbt_model: any word of DDL decides, then any of a model."""
    low = re.sub(r"--.*?$|/\*.*?\*/", "", text[:SQL_PEEK].lower(), flags=re.M | re.S)
    return "dbt_model" if not any(w in low for w in DDL_WORDS) and any(w in low for w in MODEL_WORDS) else "sql"


def sniff_json(text: str) -> str:
    """bigquery, dbt_manifest, json_schema or data, from the beginning of a JSON text. A text cut off is data."""
    try:
        data = json.loads(text[:JSON_PEEK].lstrip("\ufeff"))
    except ValueError:
        return "data"
    if not isinstance(data, dict):
        return "data"
    inner = lambda key: data.get(key) if isinstance(data.get(key), dict) else {}
    if str(data.get("kind", "")).startswith("bigquery#") and "fields" in inner("schema"):
        return "bigquery"
    if isinstance(data.get("nodes"), dict) or isinstance(data.get("sources"), dict) or "child_map" in data or "dbt_version" in inner("metadata"):
        return "dbt_manifest"
    if data.get("$schema") or data.get("type") == "object" and isinstance(data.get("properties"), dict) or any(k in data for k in ("oneOf", "anyOf", "allOf", "definitions", "$defs", "items")):
        return "json_schema"
    return "data"


def is_bigquery_json(text: str) -> bool:
    """A table resource of the warehouse's API."""
    try:
        data = json.loads(text)
    except ValueError:
        return False
    return isinstance(data, dict) and str(data.get("kind", "")).startswith("bigquery#") and isinstance(data.get("schema"), dict) and "fields" in data["schema"]


_LIVE = re.compile(r"[^:/]+:[^:./][^:/]*\.[^:/]*[^:./]")


def guess_kind(name: str, text: str) -> str:
    """The kind of an input from its name and, for SQL and JSON, its contents; data if nothing else fits."""
    suffixes = [x.lower() for x in Path(name).suffixes]
    last = next((x for x in reversed(suffixes) if x != ".gz"), "")
    by_name = {".proto": "protobuf", ".yml": "dbt_yaml", ".yaml": "dbt_yaml", ".txt": "spark"}
    if last in by_name:
        return by_name[last]
    if last == ".sql":
        return sniff_sql(text)
    if last not in (".json", ".ndjson", ".jsonl") and ".gz" not in suffixes and _LIVE.fullmatch(name):
        return "live"
    return sniff_json(text)


# Families of formats with their representations, the default ones, other names, and the parsers that read them.
FORMATS = {
    "spark": ["json", "ddl", "tree"],
    "bq": ["table", "json", "ddl", "api-json"],
    "sql": ["ddl"],
    "dbt": ["manifest", "yml", "model"],
    "jsonschema": ["json"],
    "proto": ["sdl"],
    "data": ["json", "jsonl", "parquet", "orc", "csv"],
}
DEFAULTS = {"spark": "json", "bq": "table", "sql": "ddl", "dbt": "manifest", "jsonschema": "json", "proto": "sdl", "data": "json"}
ALIASES = {
    "spark": "spark:json", "spark-tree": "spark:tree", "spark-json": "spark:json", "spark-ddl": "spark:ddl",
    "bigquery": "bq:table", "bq-table": "bq:table", "bq-json": "bq:json", "bq-api-json": "bq:api-json", "bq-ddl": "bq:ddl", "bigquery-json": "bq:json", "bigquery-api-json": "bq:api-json",
    "sql": "sql:ddl", "sql-ddl": "sql:ddl", "jsonschema": "jsonschema:json", "json_schema": "jsonschema:json", "json-schema": "jsonschema:json", "protobuf": "proto:sdl",
    "dbt-manifest": "dbt:manifest", "dbt-yml": "dbt:yml", "dbt-yaml": "dbt:yml", "dbt-model": "dbt:model",
    "data": "data:json", "json": "data:json", "ndjson": "data:jsonl", "jsonl": "data:jsonl", "parquet": "data:parquet", "orc": "data:orc", "csv": "data:csv",
}
KINDS = {
    "spark:json": "spark_json", "spark:ddl": "spark_ddl", "spark:tree": "spark", "bq:table": "live", "bq:json": "bigquery", "bq:ddl": "sql", "bq:api-json": "bigquery", "sql:ddl": "sql",
    "dbt:manifest": "dbt_manifest", "dbt:yml": "dbt_yaml", "dbt:model": "dbt_model", "jsonschema:json": "json_schema", "proto:sdl": "protobuf",
    "data:json": "data", "data:jsonl": "data", "data:parquet": "data:parquet", "data:orc": "data:orc", "data:csv": "data:csv",
}


def parse_format(text: str) -> tuple[str, str]:
    """family:representation, with defaults and other names."""
    low = text.strip().lower()
    family, _, form = ALIASES.get(low, low).partition(":")
    family, form = family.strip(), form.strip() or DEFAULTS.get(family.strip(), "")
    if family not in FORMATS:
        raise SettingError("unknown family of formats", format=text, known=" ".join(sorted(FORMATS)))
    if form not in FORMATS[family]:
        raise SettingError("unknown representation", format=text, known=" ".join(FORMATS[family]))
    return family, form


def family_of(text: str) -> str:
    """The part before the colon."""
    return text.partition(":")[0]


def kind_of(text: str) -> str:
    """The parser's kind for a format."""
    return KINDS[":".join(parse_format(text))]


def all_formats() -> list[str]:
    return sorted({*ALIASES, *(f"{f}:{x}" for f, xs in FORMATS.items() for x in xs)})


def table_ref(text: str, project: str | None = None) -> tuple[str | None, str, str]:
    """project:dataset.table or dataset.table, which belongs to the given project."""
    m = re.fullmatch(r"(?:([^\s:.]+):)?([^\s:.]+)\.([^\s:.]+)", text)
    if not m:
        raise SchemaError(f"not a table reference: {text!r}")
    return m[1] or project, m[2], m[3]


def dataset_ref(text: str, project: str | None = None) -> tuple[str | None, str]:
    m = re.fullmatch(r"(?:([^\s:.]+):)?([^\s:.]+)", text)
    if not m:
        raise SchemaError(f"not a dataset reference: {text!r}")
    return m[1] or project, m[2]
