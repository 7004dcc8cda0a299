"""Registered queries over the fixture catalog and the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import text_queries
from schemaloom.operators import analytics, compare, infer, rules
from schemaloom.plans import dialect, findings, fixtures
from schemaloom.sources import fields, records

_FK = ["table_name", "col", "ref_table"]
_PK = ["table_name", "col", "pos"]
_STORAGE = ["table_name", "partition_column", "needs_filter", "cluster_column"]


def _catalog_rows() -> list[tuple]:
    return [r for t, f in fixtures.TABLES.items() for r in fields.rows(t, f)]


def fixture_frames(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "catalog": fields.catalog(spark, fixtures.TABLES),
        "fk": spark.createDataFrame(fixtures.FOREIGN_KEYS, "table_name string, col string, ref_table string"),
        "pk": spark.createDataFrame(fixtures.PRIMARY_KEYS, "table_name string, col string, pos int"),
        "storage": spark.createDataFrame(fixtures.STORAGE, "table_name string, partition_column string, needs_filter boolean, cluster_column string"),
    }


def fixture_values() -> dict[str, str]:
    return {"catalog": dialect.values(fields.NAMES, _catalog_rows()), "fk": dialect.values(_FK, fixtures.FOREIGN_KEYS), "pk": dialect.values(_PK, fixtures.PRIMARY_KEYS), "storage": dialect.values(_STORAGE, fixtures.STORAGE)}


def _rule(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rules.find(spark, name, **fixture_frames(spark))


def _key(name: str) -> str:
    if name in rules.FIELD_RULES:
        return f"ap_{name}"
    if name in rules.DIMENSIONAL_RULES:
        return f"dim_{name}"
    return f"ds_{name.removeprefix('dataset_')}" if name.startswith(("sharded", "dataset", "fk_")) else f"tbl_{name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {_key(n): _rule(n) for n in rules.RULES}
#: Stated findings, not the rule again; that both engines read a rule's text alike is a test of its own.
ORACLE_SQL: dict[str, str] = {_key(n): "select * from " + dialect.values(["table_name", "path", "pattern", "severity"], rows) + " as stated" for n, rows in findings.FINDINGS.items()}
SAME_TEXT: dict[str, str] = {_key(n): dialect.for_duckdb(rules.rule_text(n), **fixture_values()) for n in rules.RULES}

# ---------------------------------------------------------------- analytics over the fixture catalog

QUERIES |= {n: (lambda spark, sf_dir, n=n: analytics.analyse(spark, n, **fixture_frames(spark))) for n in analytics.TEXTS}
ORACLE_SQL |= {n: dialect.for_duckdb(t, **fixture_values()) for n, t in analytics.TEXTS.items()}

# ---------------------------------------------------------------- two profiles

_LEFT = [
    ("id", "scalar", "int", True), ("name", "scalar", "str", False), ("email", "scalar", "str", True), ("age", "scalar", "int", True), ("score", "scalar", "float", True), ("active", "scalar", "bool", True), ("born", "scalar", "date", True), ("note", "scalar", "any", True),
    ("status", "scalar", "int|str", True), ("contact", "object", "object", True), ("contact.email", "scalar", "str", True), ("contact.phone", "scalar", "missing|str", False), ("tags", "array", "array", False), ("items", "array", "array", True), ("items[0].sku", "scalar", "str", True), ("items[0].qty", "scalar", "int", True), ("void", "scalar", "empty_string", True), ("misc", "scalar", "any|int", True), ("legacy", "scalar", "str", True), ("created_at", "scalar", "timestamp", True),
    ("bag", "array", "array", True), ("pile", "array", "array", False), ("pile[0].k", "scalar", "str", True), ("code", "scalar", "int|str", False), ("gone", "scalar", "missing", True), ("both", "scalar", "int", True), ("mess", "scalar", "any|empty_string|int|str", True),
]
_RIGHT = [
    ("id", "scalar", "int", True), ("profile", "object", "object", True), ("profile.name", "scalar", "str", True), ("email", "scalar", "str", False), ("age", "scalar", "str", True), ("score", "scalar", "int", True), ("active", "scalar", "str", True), ("born", "scalar", "timestamp", True), ("note", "scalar", "int", True),
    ("status", "scalar", "int|str", True), ("contact", "object", "object", True), ("contact.phone", "scalar", "str", True), ("tags", "array", "array", True), ("items", "array", "array", True), ("items[0].sku", "scalar", "str", True), ("void", "scalar", "str", True), ("misc", "scalar", "int", True), ("created_at", "scalar", "timestamp", True), ("updated_at", "scalar", "timestamp", False), ("is_premium", "scalar", "bool", False), ("audit_log.entry.line", "scalar", "str", False),
    ("bag", "array", "array", True), ("bag[0].k", "scalar", "str", True), ("pile", "array", "array", True), ("code", "scalar", "int|str", True), ("gone", "scalar", "str", True), ("both", "scalar", "str", False), ("needed", "scalar", "int", True), ("mess", "scalar", "int|str", True),
]
_WANTED = [("name",), ("contact",), ("items.sku",), ("nowhere",)]


def profile_frames(spark: SparkSession) -> dict[str, DataFrame]:
    schema = "path string, kind string, atoms string, required boolean"
    return {"left": spark.createDataFrame(_LEFT, schema), "right": spark.createDataFrame(_RIGHT, schema), "wanted": spark.createDataFrame(_WANTED, "path string")}


_PROFILES = {"left": dialect.values(compare.PROFILE, _LEFT), "right": dialect.values(compare.PROFILE, _RIGHT), "wanted": dialect.values(["path"], _WANTED)}
QUERIES |= {n: (lambda spark, sf_dir, n=n: compare.compare(spark, n, **profile_frames(spark))) for n in compare.TEXTS}
ORACLE_SQL |= {n: dialect.for_duckdb(t, **_PROFILES) for n, t in compare.TEXTS.items()}

SAME_TEXT |= {n: ORACLE_SQL[n] for n in findings.RESULTS}
ORACLE_SQL |= {n: "select * from " + dialect.values(columns, rows) + " as stated" for n, (columns, rows) in findings.RESULTS.items()}

# ---------------------------------------------------------------- the driver's tables

_PREFIXED = "select replace_all(column_name, '^[a-z]+_', '') as name, data_type, column_name from information_schema.columns where table_name = "
_ATOM_OF = "case when data_type in ('BIGINT', 'INTEGER') then 'int' when data_type in ('DOUBLE', 'FLOAT') then 'float' when data_type = 'VARCHAR' then 'str' when data_type like 'TIMESTAMP%' then 'timestamp' else data_type end"


def _columns(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """name (without the table's prefix) and atom of a table's columns; reads the schema only."""
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    atom = {"bigint": "int", "int": "int", "double": "float", "float": "float", "string": "str", "timestamp_ntz": "timestamp", "timestamp": "timestamp"}
    rows = [(n.split("_", 1)[-1], atom.get(t, t)) for n, t in frame.dtypes]
    return spark.createDataFrame(rows, "name string, atom string")


def table_diff(spark: SparkSession, sf_dir: str, left: str = "customer", right: str = "supplier") -> DataFrame:
    """Which fields two tables share, and with which types."""
    a, b = _columns(spark, sf_dir, left).alias("a"), _columns(spark, sf_dir, right).alias("b")
    section = F.when(F.col("b.name").isNull(), "only_left").when(F.col("a.name").isNull(), "only_right").when(F.col("a.atom") != F.col("b.atom"), "type_mismatch").otherwise("common")
    return a.join(b, F.col("a.name") == F.col("b.name"), "full_outer").select(F.coalesce("a.name", "b.name").alias("name"), section.alias("section"), F.col("a.atom").alias("left_atom"), F.col("b.atom").alias("right_atom"))


QUERIES["table_diff"] = table_diff
ORACLE_SQL["table_diff"] = f"""
with a as (select regexp_replace(column_name, '^[a-z]+_', '') as name, {_ATOM_OF} as atom from information_schema.columns where table_name = 'customer'),
 b as (select regexp_replace(column_name, '^[a-z]+_', '') as name, {_ATOM_OF} as atom from information_schema.columns where table_name = 'supplier')
select coalesce(a.name, b.name) as name, case when b.name is null then 'only_left' when a.name is null then 'only_right' when a.atom <> b.atom then 'type_mismatch' else 'common' end as section, a.atom as left_atom, b.atom as right_atom
from a full outer join b on a.name = b.name"""

# ---------------------------------------------------------------- inference over documents

#: A document per order, whose members vary by key: union, null, absent, empty and nested values.
DOCUMENT = """concat('{"id":', cast(o_orderkey as string), ',"status":"', o_orderstatus, '","x":',
  case o_orderkey % 6 when 0 then '1' when 1 then '"a"' when 2 then 'null' when 3 then '""' when 4 then '2.5' else 'true' end,
  case when o_orderkey % 4 = 0 then '' else concat(',"sometimes":', cast(o_custkey as string)) end,
  ',"nested":{"a":{"b":', cast(o_custkey as string), case when o_orderkey % 5 = 0 then ',"c":null' else ',"c":"t"' end, '}}',
  case when o_orderkey % 7 = 0 then ',"torn":null' else ',"torn":{"k":1}' end,
  ',"lines":', case when o_orderkey % 3 = 0 then '[]' else concat('[{"n":', cast(o_custkey as string), ',"tag":["p"]},{"other":1}]') end,
  ',"mixed":', case when o_orderkey % 2 = 0 then '[1]' else '{"m":1}' end, ',"bare":{}}')"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(f"try_parse_json({DOCUMENT})").alias("rec"), "o_orderkey")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("try_parse_json(props)").alias("rec"), "event_id")


def _counts_sql(table: str, text: str) -> str:
    shown = "case when fullkey = '$' then '' else replace(regexp_replace(regexp_replace(fullkey, '^[$][.]?', ''), '\"', '', 'g'), '[#-1]', '') end"
    kind = "case type when 'NULL' then 'missing' when 'BOOLEAN' then 'bool' when 'BIGINT' then 'int' when 'UBIGINT' then 'int' when 'DOUBLE' then 'float' when 'VARCHAR' then case when atom::varchar in ('\"\"', '') then 'empty_string' else 'str' end when 'OBJECT' then case when value::varchar = '{}' then 'empty_object' else 'object' end when 'ARRAY' then case when value::varchar = '[]' then 'empty_array' else 'array' end end"
    return f"""(select path, parent, atom, cast(count(*) as bigint) as n from (select {shown} as path, case when regexp_matches({shown}, '[]]$') or fullkey = '$' then null else regexp_replace({shown}, '(^|[.])[^.]*$', '') end as parent, {kind} as atom
      from (select {text} as doc from {table}) as d, json_tree(d.doc) as t where not regexp_matches(fullkey, '[[][1-9]')) as z group by path, parent, atom)"""


def infer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of the odd and of the even orders, merged: all orders are read."""
    halves = [infer.counts(infer.paths(order_documents(spark, sf_dir).where(F.col("o_orderkey") % 2 == i), 5)) for i in (0, 1)]
    return infer.merge_profiles(*halves)


_DOC_DUCK = DOCUMENT.replace("as string)", "as varchar)")
_MERGED = {name: dialect.for_duckdb(infer.MERGE, counts=_counts_sql(t, x)) for name, t, x in (("orders", "orders", _DOC_DUCK), ("events", "events", "props"))}

QUERIES |= {
    "infer_atom": lambda spark, sf_dir: infer.counts(infer.paths(order_documents(spark, sf_dir), 5)).groupBy("atom").agg(F.sum("n").alias("n")),
    "infer_tree": lambda spark, sf_dir: infer.counts(infer.paths(order_documents(spark, sf_dir), 5)).select("path", "atom", "n"),
    "infer_merged": lambda spark, sf_dir: infer.infer(order_documents(spark, sf_dir), 5),
    "infer_events": lambda spark, sf_dir: infer.infer(event_documents(spark, sf_dir)),
    "infer_union": lambda spark, sf_dir: infer.infer(order_documents(spark, sf_dir), 5).where("type_repr like 'union%'").select("path", "type_repr"),
    "infer_merge": infer_merge,
    "infer_datetime": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("to_json(struct(date_format(o_orderdate, 'yyyy-MM-dd') as d, date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as t, o_orderpriority as p))").alias("j")).select(F.expr("try_parse_json(j)").alias("rec")).transform(lambda df: infer.infer(df, 2, datetimes=True)),
    "bad_records": lambda spark, sf_dir: infer.bad_records(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))), "props"),
    "sample_nth": lambda spark, sf_dir: records.nth(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), 7, "o_orderkey"),
    "sample_all": lambda spark, sf_dir: records.every(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).agg(F.count(F.lit(1)).alias("n")),
    "sample_reservoir": lambda spark, sf_dir: records.reservoir(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), 100, 42),
    "sample_keyed": lambda spark, sf_dir: records.keyed_sample(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 50),
    "sample_values": lambda spark, sf_dir: records.field_samples(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as ordinal", "stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) as (path, value)")),
    "sample_fmt": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", records.format_sample(F.lit("str"), F.col("p_name"), 8).alias("shown")),
}
ORACLE_SQL |= {
    "infer_atom": f"select atom, cast(sum(n) as bigint) as n from {_counts_sql('orders', _DOC_DUCK)} group by atom",
    "infer_tree": f"select path, atom, n from {_counts_sql('orders', _DOC_DUCK)}",
    "infer_merged": _MERGED["orders"],
    "infer_events": _MERGED["events"],
    "infer_union": f"select path, type_repr from ({_MERGED['orders']}) where type_repr like 'union%'",
    "infer_merge": _MERGED["orders"],
    "infer_datetime": "select * from (select 'd' as path, 'date' as type_repr, count(*) as n from orders union all select 't', 'timestamp', count(*) from orders union all select 'p', 'str', count(*) from orders)",
    "bad_records": "select cast(count(case when event_id % 10 = 0 then 1 end) as bigint) as bad_records, count(*) as records from events",
    "sample_nth": "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 1 offset 6",
    "sample_all": "select count(*) as n from orders",
    "sample_keyed": "select o_orderkey from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 50",
    "sample_values": "select path, turn, value from (select path, value, cast(row_number() over (partition by path order by seen, value) as int) as turn from (select path, value, min(o_orderkey) as seen from (select o_orderkey, 'status' as path, o_orderstatus as value from orders union all select o_orderkey, 'priority', o_orderpriority from orders) as u where value is not null group by path, value) as f) as r where turn <= 5",
    "sample_fmt": "select p_partkey, case when p_name is null then 'null' when length(p_name) > 8 then '\"' || substr(p_name, 1, 8) || '...\"' else '\"' || p_name || '\"' end as shown from part",
}

# ---------------------------------------------------------------- schema texts, renderings, reports and sources

QUERIES |= text_queries.QUERIES
ORACLE_SQL |= text_queries.ORACLE_SQL
