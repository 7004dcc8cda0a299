"""Field catalogs: one row per field of a schema.

Columns: table_name, path, parent, leaf, depth, ordinal, native_type, mode,
description, tagged, n_children. Paths join names by dots; the mode is
NULLABLE, REQUIRED or REPEATED. A catalog is metadata: its size follows the
number of fields, not of rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = "table_name string, path string, parent string, leaf string, depth int, ordinal int, native_type string, mode string, description string, tagged boolean, n_children int"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass
class Field:
    """A node of a schema tree."""

    name: str
    type: str = "STRING"
    mode: str = "NULLABLE"
    description: str | None = None
    tags: list[str] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    required: bool = False


def rows(table: str, fields: list[Field], parent: str = "", depth: int = 0) -> list[tuple]:
    """Catalog rows, parents before children, in declaration order."""
    out = []
    for i, f in enumerate(fields):
        path = f"{parent}.{f.name}" if parent else f.name
        out.append((table, path, parent, f.name, depth, i, f.type, f.mode, f.description, bool(f.tags), len(f.fields)))
        out += rows(table, f.fields, path, depth + 1)
    return out


def leaves(fields: list[Field], prefix: str = "") -> list[str]:
    """Paths of fields that hold no record; arrays are not entered."""
    out = []
    for f in fields:
        inner = f.type == "RECORD" and f.mode != "REPEATED" and f.fields
        out += leaves(f.fields, f"{prefix}{f.name}.") if inner else [prefix + f.name]
    return out


def required(fields: list[Field], prefix: str = "") -> list[str]:
    """Paths of required fields outside arrays."""
    out = []
    for f in fields:
        if f.mode != "REPEATED":
            out += [prefix + f.name] * (f.mode == "REQUIRED" or f.required) + required(f.fields, f"{prefix}{f.name}.")
    return out


def tree(fields: list[Field]) -> dict:
    """Fields as nested dicts of types; arrays as lists of one element."""
    out = {}
    for f in fields:
        kind = tree(f.fields) if f.type == "RECORD" else f.type
        out[f.name] = [kind] if f.mode == "REPEATED" else kind
    return out


_PART = re.compile(r'\s*([^\s:,()]+)\s*:\s*(\w+)([!*]?)(?:"([^"]*)")?(#?)\s*(\(|,|\)|$)|\s*(\)),?')


def parse_spec(text: str) -> list[Field]:
    """Compact notation: `name:TYPE`, then ! (required) or * (repeated), "description", # (tagged), (children)."""
    root: list[Field] = []
    stack = [root]
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            if text[at] in ", ":
                at += 1
                continue
            raise ValueError(f"cannot read {text[at:at + 30]!r}")
        at = m.end()
        if m[7]:
            stack.pop()
            continue
        f = Field(m[1], m[2], {"!": "REQUIRED", "*": "REPEATED"}.get(m[3], "NULLABLE"), m[4], ["tag"] if m[5] else [])
        stack[-1].append(f)
        if m[6] == "(":
            stack.append(f.fields)
        elif m[6] == ")":
            stack.pop()
    return root


def from_struct(schema: T.StructType) -> list[Field]:
    """The fields of a Spark schema; arrays become REPEATED, structs RECORD, maps JSON."""
    out = []
    for f in schema.fields:
        kind, repeated = f.dataType, False
        while isinstance(kind, T.ArrayType):
            kind, repeated = kind.elementType, True
        names = {T.LongType: "INT64", T.IntegerType: "INT64", T.ShortType: "INT64", T.ByteType: "INT64", T.DoubleType: "FLOAT64", T.FloatType: "FLOAT64", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "DATETIME", T.BinaryType: "BYTES", T.DecimalType: "NUMERIC", T.StructType: "RECORD", T.MapType: "JSON"}
        mode = "REPEATED" if repeated else "NULLABLE" if f.nullable else "REQUIRED"
        out.append(Field(f.name, names.get(type(kind), "STRING"), mode, f.metadata.get("description"), list(f.metadata.get("policyTags", [])), from_struct(kind) if isinstance(kind, T.StructType) else []))
    return out


def catalog(spark: SparkSession, tables: dict[str, list[Field]]) -> DataFrame:
    """The catalog of several schemas."""
    return spark.createDataFrame([r for t, fields in tables.items() for r in rows(t, fields)], SCHEMA)


def catalog_of(spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """The catalog of DataFrames, by name; runs no job."""
    return catalog(spark, {name: from_struct(df.schema) for name, df in frames.items()})
