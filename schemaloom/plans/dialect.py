"""Query texts that both Spark and DuckDB can run.

A text names its inputs as {name}. Spark binds DataFrames to them; for the
oracle they become VALUES or table names, and four spellings that differ
between the engines are replaced. Catalyst plans the Spark side as any SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def words(items: Iterable[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def among(column: str, items: Iterable[str]) -> str:
    return f"({column} in ({words(items)}))"


def has(column: str, items: Iterable[str]) -> str:
    """Any item is part of the column."""
    return f"regexp_like({column}, '{'|'.join(items)}')"


def begins(column: str, items: Iterable[str]) -> str:
    return f"regexp_like({column}, '^({'|'.join(items)})')"


def ends(column: str, items: Iterable[str]) -> str:
    return f"regexp_like({column}, '({'|'.join(items)})$')"


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"cast({value!r} as double)"
    return "'" + str(value).replace("'", "''") + "'"


def values(names: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(select * from (values {body}) as t({', '.join(names)}))"


def _calls(text: str, name: str, build) -> str:
    """Rewrite the calls of a function, innermost first; quotes are respected."""
    while (at := text.rfind(name + "(")) >= 0:
        i, deep, quoted = at + len(name), 0, False
        while True:
            ch = text[i]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                deep += (ch == "(") - (ch == ")")
                if not deep:
                    break
            i += 1
        text = text[:at] + build(text[at + len(name) + 1 : i]) + text[i + 1 :]
    return text


def for_spark(text: str) -> str:
    text = text.replace("starts_with(", "startswith(")
    return re.sub(r"listagg\(((?:[^()]|\([^()]*\))*)\)", r"listagg(\1, ',') within group (order by \1)", text)


def for_duckdb(text: str, **inputs: str) -> str:
    text = text.replace("regexp_like(", "regexp_matches(")
    text = re.sub(r"listagg\(((?:[^()]|\([^()]*\))*)\)", r"string_agg(\1, ',' order by \1)", text)
    text = _calls(text, "replace_all", lambda inside: f"regexp_replace({inside}, 'g')")
    text = text.replace("$1_$2", r"\1_\2")
    for name, body in inputs.items():
        text = text.replace("{" + name + "}", body)
    return text


def run(spark: SparkSession, text: str, **inputs: DataFrame) -> DataFrame:
    """Run a text over DataFrames."""
    used = {k: v for k, v in inputs.items() if "{" + k + "}" in text}
    return spark.sql(for_spark(text).replace("replace_all(", "regexp_replace("), **used)
