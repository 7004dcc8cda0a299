"""Commands: compare, generate, analyze, ddl, config. Inputs are schema files of any known kind, or JSON documents."""

from __future__ import annotations

import argparse
import gzip
import importlib
import json
import platform
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.support import COLORS, set_up_logging
from schemaloom.operators import compare, infer, texts
from schemaloom.plans import render, report
from schemaloom.sources import dialects, parsers, records, stores
from schemaloom.sources.fields import Field, catalog

_NATIVE = {"int": "INT64", "float": "FLOAT64", "bool": "BOOLEAN", "str": "STRING", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "object": "RECORD"}


def fields_of_profile(rows: list[tuple[str, str]]) -> list[Field]:
    """(path, type_repr) of an inferred profile to fields; conflicting kinds become ANY."""
    root = Field("", "RECORD")
    made = {"": root}
    for path, kind in sorted(rows, key=lambda r: (r[0].count(".") + r[0].count("[0]"), r[0])):
        atoms = kind.removeprefix("union(").removesuffix(")").split("|")
        known = [a for a in atoms if a != "missing"]
        if path.endswith("[0]"):
            above = made.get(path[:-3])
            if above is not None and len(known) == 1:
                above.type = _NATIVE.get(known[0], "ANY")
                made[path] = above
            continue
        parent, _, leaf = path.rpartition(".")
        if parent not in made:
            continue
        f = Field(leaf, _NATIVE.get(known[0], "ANY") if len(known) == 1 else "ANY", "REQUIRED" if "missing" not in atoms else "NULLABLE")
        if known == ["array"]:
            f.mode = "REPEATED"
        made[parent].fields.append(f)
        made[path] = f
    return root.fields


def read_text(spark: SparkSession, path: str) -> str:
    """A schema file; gzip is known by its first bytes."""
    raw = Path(stores.resolve(spark, path)).read_bytes()
    return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8-sig")


def documents(spark: SparkSession, path: str, kind: str = "data", record: int | None = None, first: bool = False, every: bool = True, k: int = 1000, seed: int | None = None) -> DataFrame:
    """The records to infer from: one by number, the first, all, or a sample."""
    if kind.startswith("data:"):
        form = kind.partition(":")[2]
        frame = (spark.read.option("header", True).option("inferSchema", True) if form == "csv" else spark.read).format(form).load(records.hadoop_path(path))
        found = frame.select(F.monotonically_increasing_id().alias("ordinal"), F.expr("try_parse_json(to_json(struct(*), map('ignoreNullFields', 'false')))").alias("rec"))
    else:
        found = records.read_records(spark, path)
    if record is not None:
        return records.nth(found, record, "ordinal")
    return records.choose(found, first, every, k, seed)


def load(spark: SparkSession, path: str, kind: str | None = None, table: str | None = None, depth: int = 8, infer_datetimes: bool = False, **sampling) -> list[Field]:
    """The fields of a schema file or of a table that the session knows, or those inferred from documents."""
    if kind is None or kind == "auto":
        there = Path(path).is_file()
        kind = parsers.guess_kind(path, read_text(spark, path)[: parsers.JSON_PEEK] if there and Path(path).suffix.lower() in (".sql", ".json", ".gz", ".ndjson", ".jsonl", "") else "")
        if kind == "live" and there:
            kind = "data"
    elif kind not in parsers.PARSERS and kind not in ("data", "live"):
        kind = parsers.kind_of(kind)
    if kind == "live":
        return stores.live_fields(spark, path)
    if kind in parsers.PARSERS:
        return texts.parse_text(read_text(spark, path), kind, table)
    found = documents(spark, path, kind, **sampling)
    return fields_of_profile([(r.path, r.type_repr) for r in infer.infer(found, depth, infer_datetimes).collect()])


def is_data(path: str, kind: str | None) -> bool:
    """Whether load would infer from documents."""
    if kind not in (None, "auto"):
        return (kind if kind in parsers.PARSERS or kind in ("data", "live") else parsers.kind_of(kind)).startswith("data")
    there = Path(path).is_file()
    guess = parsers.guess_kind(path, Path(path).read_bytes()[: parsers.JSON_PEEK].decode("utf-8", "replace") if there else "")
    return guess == "data" or guess == "live" and there


def require(fields: list[Field], wanted: set[str], prefix: str = "") -> None:
    """Exactly the wanted paths are required; repeated fields stay as they are."""
    for f in fields:
        path = prefix + f.name
        if f.mode != "REPEATED":
            f.mode = "REQUIRED" if path in wanted else "NULLABLE"
        f.required = path in wanted
        require(f.fields, wanted, path + ".")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="schemaloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("compare", help="differences between two schemas or documents")
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("--left-kind", help="format of the left input, if it should not be guessed")
    p.add_argument("--right-kind")
    p.add_argument("--right-table", help="the right input's table, model or message")
    p.add_argument("--fields", nargs="*", help="only these fields")
    p.add_argument("--json", action="store_true")
    p.add_argument("--json-out", help="write the rows here as JSON")
    p.add_argument("--migration", action="store_true", help="a migration report")
    p.add_argument("--show-common", action="store_true")
    p.add_argument("--only-common", action="store_true")
    p.add_argument("--show-samples", action="store_true", help="samples of fields that differ, from documents")
    for name, text in (("generate", "a schema text"), ("ddl", "a BigQuery CREATE TABLE")):
        p = sub.add_parser(name, help=text)
        p.add_argument("path", nargs="+" if name == "ddl" else None)
        p.add_argument("--format", default="json_schema" if name == "generate" else "bigquery_ddl", choices=sorted(render.FORMATS))
        p.add_argument("--name", default="my_table")
        p.add_argument("--no-validate", action="store_true")
    sub.choices["generate"].add_argument("--required-fields", nargs="*", help="exactly these paths are required")
    sub.choices["ddl"].add_argument("--all", action="store_true", help="every table of the inputs")
    sub.choices["ddl"].add_argument("--pretty", action="store_true")
    p = sub.add_parser("analyze", help="complexity, patterns, categories and rule findings")
    p.add_argument("path")
    p.add_argument("--format", default="text", choices=["text", "markdown", "json"])
    for p in sub.choices.values():
        p.add_argument("--kind", help="of the input, if it should not be guessed")
        p.add_argument("--table", help="the table, model or message")
        p.add_argument("--output", help="write below ./output under this name")
        p.add_argument("--infer-datetimes", action="store_true")
        p.add_argument("--record", type=int, help="infer from the document of this number")
        p.add_argument("--first-record", action="store_true")
        p.add_argument("--all-records", action="store_true", help="infer from all documents (the default without --sample-size)")
        p.add_argument("--sample-size", "-k", type=int)
        p.add_argument("--seed", type=int)
    p = sub.add_parser("config", help="versions, formats and stores")
    p.add_argument("--store", default="gs://bucket/object", help="a path whose file system is looked for")
    p.add_argument("--output")
    for p in sub.choices.values():
        p.add_argument("--no-color", action="store_true")
        p.add_argument("--log-level", default="WARNING")
    return top


def _sampled(a: argparse.Namespace) -> dict:
    return {"record": a.record, "first": a.first_record, "every": a.all_records or a.sample_size is None, "k": a.sample_size or 1000, "seed": a.seed, "infer_datetimes": a.infer_datetimes}


def samples_of(spark: SparkSession, path: str, kind: str, a: argparse.Namespace) -> dict[str, list[str]]:
    """Up to five shown values of each scalar path, from documents."""
    options = _sampled(a)
    options.pop("infer_datetimes")
    found = documents(spark, path, kind, **options)
    flat = found.lateralJoin(spark.tvf.variant_explode(F.col("rec").outer())).where("key is not null").select(F.col("ordinal"), F.col("key").alias("path"), F.expr("schema_of_variant(value)").alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("value"))
    plain = flat.where("kind not like 'OBJECT%' and kind not like 'ARRAY%'")
    text = {(r.path, r.value) for r in plain.where("kind = 'STRING'").select("path", "value").distinct().join(records.field_samples(plain), ["path", "value"]).select("path", "value").collect()}
    out: dict[str, list[str]] = {}
    for r in records.field_samples(plain).orderBy("path", "turn").collect():
        short = r.value if len(r.value) <= 40 else r.value[:40] + "..."
        out.setdefault(r.path, []).append(f'"{short}"' if (r.path, r.value) in text else short)
    return out


def _compare(a: argparse.Namespace, spark: SparkSession) -> str:
    kinds = (a.left_kind or a.kind, a.right_kind or a.kind)
    left, right = (compare.profile(spark, load(spark, x, kind, table, **_sampled(a))) for x, kind, table in zip((a.left, a.right), kinds, (a.table, a.right_table or a.table)))
    if a.fields:
        wanted = spark.createDataFrame([(f.replace("[0]", ""),) for f in a.fields], "path string")
        keep = lambda df: df.join(compare.compare(spark, "filter_fields", left=df, wanted=wanted).select("path"), "path", "left_semi")
        left, right = keep(left), keep(right)
    if a.migration:
        return render.migration_markdown(compare.compare(spark, "mig_analyze", left=left, right=right).first().asDict(), a.left, a.right)
    rows = sorted(tuple(r) for r in compare.diff(left, right).collect())
    if any(is_data(x, kind) for x, kind in zip((a.left, a.right), kinds)):  # what documents lack says nothing of a schema
        rows = [r for r in rows if r[1] != "presence"]
    rows = [r for r in rows if r[1] != "common" and not a.only_common]
    if a.show_common or a.only_common:  # paths of both, whether their types agree or not
        rows += sorted((r.path, "common", None, None) for r in compare.compare(spark, "diff_common", left=left, right=right).collect())
    as_json = json.dumps([dict(zip(("path", "section", "left", "right"), r)) for r in rows], indent=2)
    if a.json_out:
        Path(a.json_out).write_text(as_json, encoding="utf-8")
    if a.json:
        return as_json
    paths = lambda x: x.split(",") if x else []
    moved = [{"name": r.leaf, "shared": paths(r.shared), "left": paths(r.left_paths), "right": paths(r.right_paths)} for r in compare.compare(spark, "path_changes", left=left, right=right).collect()]
    plain = a.no_color or not sys.stdout.isatty()
    text = render.report(rows, a.left, a.right, moved, ("",) * len(COLORS) if plain else COLORS)
    if a.show_samples:
        sides = [samples_of(spark, x, "data", a) if (k or parsers.guess_kind(x, "")) in ("data", "data:json") else {} for x, k in zip((a.left, a.right), kinds)]
        text += "".join("\n" + found for p in sorted({r[0] for r in rows}) if (found := f"  {p}\n{render.sample_line(p, *sides)}") and p in {*sides[0], *sides[1]})
    return text


def _ddl(a: argparse.Namespace, spark: SparkSession) -> str:
    """One table, several (a path each), or with --all every table of the inputs; a table that fails gives a comment."""
    out = []
    for path in a.path:
        try:
            if a.all and (a.kind or parsers.guess_kind(path, read_text(spark, path))) == "sql":
                tables = parsers.sql_tables(read_text(spark, path))
            else:
                tables = {a.name if len(a.path) == 1 else Path(path).stem: load(spark, path, a.kind, a.table, **_sampled(a))}
            out += [render.render(own, a.format, name or a.name) for name, own in tables.items()]
        except (OSError, ValueError) as e:
            if len(a.path) == 1:
                raise
            out.append(f"-- {path}: {e}")
    return "\n\n".join(render.pretty(x) if a.pretty else x for x in out)


def _config(a: argparse.Namespace, spark: SparkSession) -> str:
    ready, store = stores.store_status(spark, a.store)
    lines = [f"python {sys.version.split()[0]}", f"spark {spark.version}", f"platform {platform.platform()}", f"folder {Path.cwd()}", f"store {'ready' if ready else 'missing'}: {store}", "formats " + " ".join(parsers.all_formats()), "renders " + " ".join(render.FORMATS), "dialects " + " ".join(dialects.DIALECTS)]
    for name in ("pyarrow", "pandas", "yaml", "google.cloud.bigquery"):
        try:
            lines.append(f"{name} {importlib.import_module(name).__version__}")
        except (ImportError, AttributeError):
            lines.append(f"{name} not installed")
    return "\n".join(lines)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    set_up_logging(a.log_level, color=False if a.no_color else None)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "compare":
            text = _compare(a, spark)
        elif a.command == "analyze":
            found = report.sections(catalog(spark, {Path(a.path).stem: load(spark, a.path, a.kind, a.table, **_sampled(a))}))
            text = {"text": report.as_text, "markdown": report.as_markdown, "json": lambda x: json.dumps(x, indent=2, default=str)}[a.format](found)
        elif a.command == "config":
            text = _config(a, spark)
        elif a.command == "ddl":
            text = _ddl(a, spark)
        else:
            fields = load(spark, a.path, a.kind, a.table, **_sampled(a))
            if a.required_fields is not None:
                require(fields, set(a.required_fields))
            text = render.render(fields, a.format, a.name)
        print(text if a.command != "ddl" else render.colored(text, "never" if a.no_color else "auto"))
        if a.output:
            render.write_output(text, a.output, a.command)
        if a.command in ("generate", "ddl") and not a.no_validate and (wrong := [p for part in (text.split("\n\n") if a.command == "ddl" and a.all else [text]) for p in render.check(part, a.format)]):
            print("warning: " + "; ".join(wrong), file=sys.stderr)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
