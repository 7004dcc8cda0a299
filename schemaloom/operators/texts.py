"""Schema texts as tables: many files are parsed, rendered and checked on the executors.

A text is one file, so one row; a schema is as large as its fields, not as its
data. Parsing is row by row and needs no shuffle; rendering groups the rows of
a catalog by table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.errors import EngineError
from schemaloom.plans import render
from schemaloom.sources import fields, parsers

PARSED = "name string, path string, parent string, leaf string, depth int, ordinal int, native_type string, mode string, description string, tagged boolean, n_children int, error string"
_PARSED = [x.split() for x in PARSED.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def parse_text(text: str, kind: str, selection: str | None = None) -> list[fields.Field]:
    """The fields of one text; selection names a table, model or message."""
    if kind not in parsers.PARSERS:
        raise parsers.SchemaError("no parser of this kind", kind=kind)
    parse = parsers.PARSERS[kind]
    return parse(text, selection) if kind in parsers.SELECTING else parse(text)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            try:
                kind = row["kind"] or parsers.guess_kind(row["name"] or "", row["text"] or "")
                out += [(*r, None) for r in fields.rows(row["name"], parse_text(row["text"] or "", kind, row["selection"]))]
            except (EngineError, ValueError, KeyError, TypeError, AttributeError, IndexError) as e:  # one bad file does not end the job
                out.append((row["name"], *[None] * (len(_PARSED) - 2), f"{type(e).__name__}: {e}"))
        columns = list(zip(*out)) or [()] * len(_PARSED)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(columns, _PARSED)], names=[n for n, _ in _PARSED])


def parse_texts(texts: DataFrame) -> DataFrame:
    """name, kind (null: guessed), text, selection (null: the first) -> a catalog row per field, or one with the error.

    Texts without fields give no row; a null text is an empty one. Other columns are ignored.
    """
    plain = texts.select(*[F.col(x).cast("string").alias(x) if x in texts.columns else F.lit(None).cast("string").alias(x) for x in ("name", "kind", "text", "selection")])
    return plain.mapInArrow(_parse, PARSED)


def required_paths(parsed: DataFrame, arrays: bool = False) -> DataFrame:
    """name and path of required fields of parsed texts; members of arrays only if asked for, behind `[]`."""
    many = parsed.where("mode = 'REPEATED'").select(F.col("name").alias("n"), F.col("path").alias("above"))
    asked = parsed.where("mode = 'REQUIRED'").select("name", "path")
    inside = asked.join(many, (F.col("name").eqNullSafe(F.col("n"))) & F.startswith("path", F.concat("above", F.lit("."))), "left")
    marked = inside.groupBy("name", "path").agg(F.array_sort(F.collect_set("above")).alias("above"))  # as many as the path is deep
    if not arrays:
        return marked.where(F.size("above") == 0).select("name", "path")
    # from the innermost array outwards, so that the places of the others stay
    shown = F.aggregate(F.reverse("above"), F.col("path"), lambda p, a: F.concat(a, F.lit("[]"), F.substring(p, F.char_length(a) + 1, F.lit(1 << 20))))
    return marked.select("name", shown.alias("path"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as texts for parse_texts, their kinds to be guessed."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("value").alias("text"), F.lit(None).cast("string").alias("selection"))


def fields_of(rows: list[dict]) -> list[fields.Field]:
    """Catalog rows of one table back to fields."""
    made: dict[str, fields.Field] = {}
    root: list[fields.Field] = []
    for r in sorted(rows, key=lambda r: (r["depth"], r["ordinal"])):
        f = fields.Field(r["leaf"], r["native_type"], r["mode"], r["description"], ["tag"] if r["tagged"] else [])
        made[r["path"]] = f
        (made[r["parent"]].fields if r["parent"] else root).append(f)
    return root


def render_texts(catalog: DataFrame, *forms: str) -> DataFrame:
    """A catalog to table_name, form, text: each table in each format."""
    wanted = forms or tuple(render.FORMATS)

    def one(key, rows):
        import pandas as pd

        own = fields_of(rows.astype(object).where(rows.notna(), None).to_dict("records"))
        return pd.DataFrame([(key[0], f, render.render(own, f, key[0])) for f in wanted], columns=["table_name", "form", "text"])

    return catalog.groupBy("table_name").applyInPandas(one, "table_name string, form string, text string")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["name"], r["form"], p) for r in batch.to_pylist() for p in render.check(r["text"] or "", r["form"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["name", "form", "problem"])


def check_texts(texts: DataFrame) -> DataFrame:
    """name, form, text -> name, form, problem: a row for each thing that is wrong; a sound text has none."""
    return texts.select("name", "form", "text").mapInArrow(_check, "name string, form string, problem string")
