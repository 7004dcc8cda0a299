"""CREATE TABLE texts of many SQL dialects: reading, translating and checking them.

A text is brought into the spelling that parsers.sql_tables reads (angle
brackets, [] for arrays, blanks between names and types), parsed to fields, and
written again with the type names and the container spellings of a dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from schemaloom.functions.errors import SchemaError, SettingError
from schemaloom.functions.lexicon import SQL_TYPES
from schemaloom.sources import parsers
from schemaloom.sources.fields import Field

# The dialects, in this order.
DIALECTS = ["bigquery", "postgres", "mysql", "sqlite", "snowflake", "redshift", "spark", "hive", "presto", "trino", "clickhouse", "databricks", "duckdb", "oracle", "tsql", "athena"]

# Type names beyond SQL_TYPES, to atoms.
MORE_TYPES = {
    "mediumint": "int", "int16": "int", "int32": "int", "smallserial": "int", "bit": "bool", "clob": "str", "nvarchar": "str", "nchar": "str", "binary": "str",
    "varbinary": "str", "blob": "str", "datetime64": "timestamp", "number": "float", "varchar2": "str", "nvarchar2": "str", "binary_double": "float", "binary_float": "float", "super": "object",
    "variant": "object", "object": "object", "datetime2": "timestamp", "datetimeoffset": "timestamp", "timestamp_ntz": "timestamp", "timestamp_ltz": "timestamp", "timestamp_tz": "timestamp", "smalldatetime": "timestamp",
    "hugeint": "int", "uint8": "int", "uint16": "int", "uint32": "int", "uint64": "int", "float32": "float", "fixedstring": "str", "long": "int", "short": "int", "byte": "int", "money": "float", "row": "object", "record": "object",
    "timestamp with local time zone": "timestamp", "long raw": "str", "raw": "str", "varbyte": "str", "tinytext": "str", "mediumtext": "str", "longtext": "str", "uniqueidentifier": "str", "uhugeint": "int", "date32": "date", "map": "object",
}
TYPES = SQL_TYPES | {"json": "object", "jsonb": "object"} | MORE_TYPES

# How dialects name INT64, FLOAT64, NUMERIC, BOOLEAN, STRING, BYTES, DATE, TIME, TIMESTAMP, DATETIME, JSON.
_ORDER = ["INT64", "FLOAT64", "NUMERIC", "BOOLEAN", "STRING", "BYTES", "DATE", "TIME", "TIMESTAMP", "DATETIME", "JSON"]
NAMES = {
    "bigquery": ["INT64", "FLOAT64", "NUMERIC", "BOOL", "STRING", "BYTES", "DATE", "TIME", "TIMESTAMP", "DATETIME", "JSON"],
    "postgres": ["BIGINT", "DOUBLE PRECISION", "DECIMAL", "BOOLEAN", "TEXT", "BYTEA", "DATE", "TIME", "TIMESTAMPTZ", "TIMESTAMP", "JSONB"],
    "mysql": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "TEXT", "BLOB", "DATE", "TIME", "TIMESTAMP", "DATETIME", "JSON"],
    "sqlite": ["INTEGER", "REAL", "REAL", "INTEGER", "TEXT", "BLOB", "DATE", "TIME", "TIMESTAMP", "DATETIME", "JSON"],
    "snowflake": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "TEXT", "BINARY", "DATE", "TIME", "TIMESTAMPTZ", "TIMESTAMP_NTZ", "VARIANT"],
    "redshift": ["BIGINT", "DOUBLE PRECISION", "DECIMAL", "BOOLEAN", "VARCHAR(MAX)", "VARBYTE", "DATE", "TIME", "TIMESTAMPTZ", "TIMESTAMP", "SUPER"],
    "spark": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "STRING", "BINARY", "DATE", "STRING", "TIMESTAMP", "TIMESTAMP_NTZ", "STRING"],
    "hive": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "STRING", "BINARY", "DATE", "STRING", "TIMESTAMP", "TIMESTAMP", "STRING"],
    "presto": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "VARCHAR", "VARBINARY", "DATE", "TIME", "TIMESTAMP", "TIMESTAMP", "JSON"],
    "trino": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "VARCHAR", "VARBINARY", "DATE", "TIME", "TIMESTAMP", "TIMESTAMP", "JSON"],
    "clickhouse": ["Int64", "Float64", "Decimal", "Bool", "String", "String", "Date", "String", "DateTime64", "DateTime64", "JSON"],
    "databricks": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "STRING", "BINARY", "DATE", "STRING", "TIMESTAMP", "TIMESTAMP_NTZ", "STRING"],
    "duckdb": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "TEXT", "BLOB", "DATE", "TIME", "TIMESTAMPTZ", "TIMESTAMP", "JSON"],
    "oracle": ["INT", "BINARY_DOUBLE", "NUMBER", "NUMBER(1)", "CLOB", "BLOB", "DATE", "VARCHAR2(32)", "TIMESTAMP", "TIMESTAMP", "CLOB"],
    "tsql": ["BIGINT", "FLOAT", "NUMERIC", "BIT", "NVARCHAR(MAX)", "VARBINARY(MAX)", "DATE", "TIME", "DATETIMEOFFSET", "DATETIME2", "NVARCHAR(MAX)"],
    "athena": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "STRING", "BINARY", "DATE", "STRING", "TIMESTAMP", "TIMESTAMP", "STRING"],
}
#: Spellings of arrays and of records with (name type) members; dialects without one use their JSON type.
ARRAYS = {"bigquery": "ARRAY<{}>", "postgres": "{}[]", "spark": "ARRAY<{}>", "hive": "ARRAY<{}>", "databricks": "ARRAY<{}>", "athena": "ARRAY<{}>", "presto": "ARRAY({})", "trino": "ARRAY({})", "clickhouse": "Array({})", "duckdb": "{}[]"}
RECORDS = {"bigquery": ("STRUCT<{}>", " "), "spark": ("STRUCT<{}>", ": "), "hive": ("STRUCT<{}>", ": "), "databricks": ("STRUCT<{}>", ": "), "athena": ("STRUCT<{}>", ": "), "presto": ("ROW({})", " "), "trino": ("ROW({})", " "), "clickhouse": ("Tuple({})", " "), "duckdb": ("STRUCT({})", " ")}
QUOTES = {"bigquery": "``", "mysql": "``", "spark": "``", "hive": "``", "databricks": "``", "athena": "``", "clickhouse": "``", "tsql": "[]"}

_CONTAINER = re.compile(r"\b(array|row|struct|tuple|nullable|lowcardinality|record)\s*\(", re.I)


def known(dialect: str) -> str:
    if dialect.lower() not in DIALECTS:
        raise SettingError("unknown dialect", dialect=dialect, known=" ".join(DIALECTS))
    return dialect.lower()


def _close(text: str, at: int, pair: str = "()") -> int:
    """Where the bracket that opens before `at` closes."""
    deep = 1
    for i in range(at, len(text)):
        deep += (text[i] == pair[0]) - (text[i] == pair[1])
        if not deep:
            return i
    raise SchemaError("a bracket does not close", text=text[max(0, at - 20) : at + 20])


def common_spelling(text: str) -> str:
    """ARRAY(T), ROW(a T), Tuple(a T) and STRUCT<a: T> as ARRAY<T> and STRUCT<a T>; Nullable(T) as T; [a] as `a`."""
    text = re.sub(r"\[([A-Za-z_][\w ]*)\]", r"`\1`", text)
    while m := _CONTAINER.search(text):
        end, name = _close(text, m.end()), m[1].lower()
        inside = text[m.end() : end]
        if name in ("nullable", "lowcardinality"):
            made = inside
        elif name == "array":
            made = f"ARRAY<{inside}>"
        else:
            made = f"STRUCT<{inside}>"
        text = text[: m.start()] + made + text[end + 1 :]
    return re.sub(r"([<,]\s*)(`[^`]+`|\"[^\"]+\"|\w+)\s*:\s*", r"\1\2 ", text)


def tables(text: str, dialect: str = "bigquery") -> dict[str, list[Field]]:
    """Every CREATE TABLE of a text by name."""
    known(dialect)
    return parsers.sql_tables(common_spelling(text), TYPES)


def dialect_schema(text: str, dialect: str = "bigquery", table: str | None = None) -> list[Field]:
    """One table's fields; without a name those of all tables together, later ones first where names are shared."""
    found = tables(text, dialect)
    if table is not None:
        for name, own in found.items():
            if table in (name, name.split(".")[-1]):
                return own
        raise SchemaError("no such table", table=table)
    merged: dict[str, Field] = {}
    for own in found.values():
        merged |= {f.name: f for f in own}
    if not merged:
        raise SchemaError("no table", dialect=dialect)
    return list(merged.values())


def type_name(f: Field, dialect: str) -> str:
    """A field's type as the dialect writes it."""
    names = dict(zip(_ORDER, NAMES[dialect]))
    if f.type == "RECORD":
        if dialect not in RECORDS:
            return names["JSON"]
        shape, gap = RECORDS[dialect]
        kind = shape.format(", ".join(f"{k.name}{gap}{type_name(k, dialect)}" for k in f.fields))
    else:
        kind = names.get(f.type, names["STRING"])
    if f.mode != "REPEATED":
        return kind
    return ARRAYS[dialect].format(kind) if dialect in ARRAYS else names["JSON"]


def translate(text: str, source: str, target: str) -> str:
    """The CREATE TABLE statements of a text in another dialect; constraints but NOT NULL are left out."""
    known(source), known(target)
    a, b = QUOTES.get(target, '""')
    quoted = lambda name: ".".join(f"{a}{p}{b}" for p in name.split("."))
    out = []
    for name, own in tables(text, source).items():
        lines = [f"  {quoted(f.name)} {type_name(f, target)}" + (" NOT NULL" if f.mode == "REQUIRED" or f.required else "") for f in own]
        out.append(f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + "\n);")
    if not out:
        raise SchemaError("no table", dialect=source)
    return "\n\n".join(out)


# Words that a statement may begin with.
_VERBS = "alter analyze call comment commit copy create delete describe drop execute explain export grant insert load merge replace revoke rollback select set show truncate update use values with".split()


def statements(text: str) -> list[str]:
    """At semicolons outside quotes and comments; comments go."""
    out, now, i = [], [], 0
    while i < len(text):
        ch = text[i]
        if text.startswith("--", i) or ch == "#" and (not i or text[i - 1] == "\n"):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
        elif ch in "'\"`":
            end = i + 1
            while end < len(text) and text[end] != ch:
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                raise SchemaError("a quote does not close", at=i)
            now.append(text[i : end + 1])
            i = end + 1
        elif ch == ";":
            out.append("".join(now).strip())
            now, i = [], i + 1
        else:
            now.append(ch)
            i += 1
    return [s for s in [*out, "".join(now).strip()] if s]


def check_sql(text: str, dialect: str = "bigquery", spark: SparkSession | None = None) -> tuple[bool, str | None]:
    """(sound, what is wrong). For the Spark dialects a session's own parser decides.

    For others: quotes and brackets close, statements begin with a verb, and the
    columns of a CREATE TABLE have names and known types.
    """
    known(dialect)
    try:
        parts = statements(text)
        if not parts:
            return False, "no statement"
        for part in parts:
            if spark is not None and dialect in ("spark", "databricks"):
                try:
                    spark._jsparkSession.sessionState().sqlParser().parsePlan(part)
                except Exception as e:
                    return False, str(getattr(e, "desc", e)).strip().splitlines()[0]
                continue
            bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", part)
            if bare.split(None, 1)[0].lower().rstrip("(") not in _VERBS:
                return False, f"a statement begins with {bare.split(None, 1)[0]!r}"
            stack = []
            for ch in bare:
                if ch in "([{":
                    stack.append(ch)
                elif ch in ")]}" and (not stack or "([{".index(stack.pop()) != ")]}".index(ch)):
                    return False, f"a {ch} closes nothing"
            if stack:
                return False, f"a {stack[-1]} does not close"
            if re.match(r"create\s+(or\s+replace\s+)?(temp(orary)?\s+)?table\b", bare, re.I) and not re.search(r"\bas\s+select\b", bare, re.I):
                for name, own in tables(part, dialect).items():
                    if unknown := [f.name for f in parsers.walk(own) if f.type == "ANY"]:
                        return False, f"unknown types in {name}: {', '.join(unknown)}"
                if not tables(part, dialect):
                    return False, "no column list"
    except SchemaError as e:
        return False, str(e)
    return True, None
