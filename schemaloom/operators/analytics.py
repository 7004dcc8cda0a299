"""Analytics over a field catalog: complexity, naming patterns, categories, sensitive names, type maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.functions import lexicon as w
from schemaloom.operators.rules import CANON, VIEW
from schemaloom.plans.dialect import among, begins, ends, has, run, values

_TOKENS = "lower(replace_all(replace_all(leaf, '([a-z0-9])([A-Z])', '$1_$2'), '[^0-9A-Za-z]+', '_'))"
_CATEGORY = f"""case when {among('nl', w.AUDIT)} then 'audit_fields' when {among('nl', w.TEMPORAL)} then 'temporal_fields' when {among('nl', w.TRACKING)} then 'tracking_identifiers' when {among('nl', w.SYSTEMS)} then 'system_references'
  when {among('nl', w.SCD)} then 'scd_fields' when {begins('nl', w.BOOLEAN_PREFIXES)} then 'boolean_fields' when {ends('nl', w.CLASS_SUFFIXES)} then 'classification_fields' when {ends('nl', w.METRIC_SUFFIXES)} then 'metric_fields'
  when {ends('nl', ['_id', '_key', '_sk'])} or {among('nl', w.FACT_KEYS)} then 'identifier_fields' end"""
_INDICATORS = values(["category", "indicator"], [(k, i) for k, v in w.PII.items() for i in v])
_MAP = lambda m: values(["native", "atom"], list(m.items()))
_BQ = _MAP(w.BQ_TYPES)


def _pattern(name: str, condition: str) -> str:
    return f"select distinct table_name, '{name}' as pattern, path as item from c where {condition}"


TEXTS: dict[str, str] = {
    "agg_complexity": f"with {VIEW} select table_name, count(*) as fields, cast(sum(case when mode = 'REQUIRED' then 1 else 0 end) as bigint) as required, cast(sum(case when is_record then 1 else 0 end) as bigint) as objects, cast(sum(case when mode = 'REPEATED' then 1 else 0 end) as bigint) as arrays, cast(sum(case when not is_record and mode <> 'REPEATED' then 1 else 0 end) as bigint) as scalars, cast(max(depth) + 1 as bigint) as max_depth, round(avg(depth + 1), 4) as avg_depth from c group by table_name",
    "agg_types": f"with {VIEW} select table_name, ct as type, count(*) as n from c group by table_name, ct",
    "agg_patterns": f"""with {VIEW} select table_name, 'repeated_field_names' as pattern, leaf as item from c group by table_name, leaf having count(*) > 1
      union all select table_name, 'common_prefixes' as pattern, parent as item from c where parent <> '' group by table_name, parent having count(*) > 2
      union all {_pattern('id_fields', "regexp_like(nl, 'id') and ct in ('INT64', 'STRING') and mode <> 'REPEATED'")}
      union all {_pattern('timestamp_fields', "regexp_like(nl, 'time|date|created|updated') or ct in ('TIMESTAMP', 'DATE', 'TIME')")}
      union all {_pattern('email_fields', "regexp_like(nl, '(^|[^a-z0-9_])e[-_ ]?mail($|[^a-z0-9_])')")}
      union all {_pattern('nested_objects', "parent <> '' and ct not in ('INT64', 'STRING', 'BOOLEAN', 'FLOAT64')")}
      union all {_pattern('array_of_objects', "is_record and mode = 'REPEATED'")}
      union all {_pattern('fields_with_policy_tags', 'tagged')}""",
    "agg_categories": f"with {VIEW}, k as (select {_CATEGORY} as category from c), g as (select category, count(*) as n from k where category is not null group by category) select category, n, cast(round(100.0 * n / sum(n) over (), 1) as double) as percent from g",
    "agg_policytags": f"with {VIEW}, p as (select table_name, tagged, {has('nl', [i for v in w.PII.values() for i in v])} as sensitive from c) select table_name, count(*) as fields, cast(sum(case when tagged then 1 else 0 end) as bigint) as tagged, cast(sum(case when sensitive and not tagged then 1 else 0 end) as bigint) as untagged_sensitive, cast(round(100.0 * sum(case when tagged then 1 else 0 end) / count(*), 2) as double) as coverage from p group by table_name",
    "agg_suggest": f"with {VIEW} select table_name, case when max(depth) + 1 > 5 then 'flatten' when count(*) > 50 then 'split' when sum(case when mode = 'REQUIRED' then 1 else 0 end) = 0 then 'require' else 'none' end as suggestion from c group by table_name",
    "pii_tokens": f"with {VIEW} select distinct leaf, {_TOKENS} as tokens from c",
    "pii_classify": f"""with {VIEW}, t as (select distinct leaf, concat('_', {_TOKENS}, '_') as tokens from c)
      select t.leaf, i.category, listagg(i.indicator) as indicators from t join {_INDICATORS} as i on regexp_like(t.tokens, concat('_', split_part(i.indicator, '_', 1), '_'))
       and (split_part(i.indicator, '_', 2) = '' or regexp_like(t.tokens, concat('_', split_part(i.indicator, '_', 2), '_'))) and (split_part(i.indicator, '_', 3) = '' or regexp_like(t.tokens, concat('_', split_part(i.indicator, '_', 3), '_')))
      group by t.leaf, i.category""",
    "canon_type": f"select distinct native_type, {CANON} as canonical from {{catalog}} as q",
    "parse_bq_type": f"select distinct q.native_type, coalesce(m.atom, lower(q.native_type)) as atom from {{catalog}} as q left join {_BQ} as m on m.native = upper(q.native_type)",
    "ddl_scalar": "select distinct native_type, case upper(native_type) when 'FLOAT' then 'FLOAT64' when 'INTEGER' then 'INT64' when 'BOOLEAN' then 'BOOL' else upper(native_type) end as ddl_type from {catalog} as q where native_type <> 'RECORD'",
    "ddl_column": f"with {VIEW}, x as (select table_name, ordinal, concat('`', leaf, '` ', case when mode = 'REPEATED' then concat('ARRAY<', case ct when 'BOOLEAN' then 'BOOL' else ct end, '>') else case ct when 'BOOLEAN' then 'BOOL' else ct end end, case when mode = 'REQUIRED' then ' NOT NULL' else '' end, case when coalesce(description, '') <> '' then concat(' OPTIONS(description=\"', description, '\")') else '' end) as line from c where top and not is_record) select table_name, ordinal, line from x",
    "ddl_columns": f"with {VIEW} select table_name, listagg(concat('`', leaf, '` ', ct)) as columns from c where top and not is_record and mode <> 'REPEATED' group by table_name",
    "ddl_table": f"with {VIEW} select table_name, concat('CREATE TABLE `', table_name, '` (', listagg(concat('`', leaf, '` ', ct, case when mode = 'REQUIRED' then ' NOT NULL' else '' end)), ');') as ddl from c where top and not is_record and mode <> 'REPEATED' group by table_name",
    "ddl_dataset": f"with {VIEW}, t as (select table_name, count(*) as columns, min(ordinal) as first from c where top group by table_name) select cast(count(*) as bigint) as tables, cast(sum(columns) as bigint) as columns, listagg(table_name) as names from t",
    "ddl_constraints": "select f.table_name, f.col, f.ref_table, p.col as ref_col from {fk} as f join {pk} as p on p.table_name = f.ref_table and p.pos = 1",
    "ddl_constraints_batch": "select table_name, 'fk' as kind, col, ref_table from {fk} as f union all select table_name, 'pk' as kind, listagg(col) as col, '' as ref_table from {pk} as p group by table_name",
    "gen_sql_ddl": f"with {VIEW} select table_name, replace_all(path, '[.]', '_') as column_name, case ct when 'INT64' then 'INTEGER' when 'FLOAT64' then 'REAL' when 'BOOLEAN' then 'BOOLEAN' when 'DATE' then 'DATE' when 'TIMESTAMP' then 'TIMESTAMP' when 'DATETIME' then 'TIMESTAMP' when 'NUMERIC' then 'NUMERIC' else 'TEXT' end as column_type, mode = 'REQUIRED' as not_null from c where not is_record",
    "gen_bigquery_ddl": f"with {VIEW} select table_name, path, case when mode = 'REPEATED' and is_record then 'ARRAY<STRUCT>' when is_record then 'STRUCT' when mode = 'REPEATED' then concat('ARRAY<', ct, '>') else ct end as column_type from c",
    "flatten_catalog": f"with {VIEW} select table_name, path, depth from c where n_children = 0",
}
TEXTS["parse_sql_dtype"] = f"select t.native, m.atom from {values(['native'], [(k,) for k in [*w.SQL_TYPES, 'money']])} as t left join {_MAP(w.SQL_TYPES)} as m on m.native = t.native"
TEXTS["parse_spark_scalar"] = f"select t.native, coalesce(m.atom, 'any') as atom from {values(['native'], [(k,) for k in [*w.SPARK_TYPES, 'interval']])} as t left join {_MAP(w.SPARK_TYPES)} as m on m.native = t.native"
TEXTS["parse_dbt_dtype"] = f"select t.native, coalesce(m.atom, 'any') as atom from {values(['native'], [('bigint',), ('text',), ('timestamp with time zone',), ('float64',), ('super',)])} as t left join {_MAP(w.SQL_TYPES)} as m on m.native = t.native"
TEXTS["parse_sql_wrapper"] = "select table_name, path, replace_all(path, '[.]list[.]element', '[0]') as unwrapped from {catalog} as q where regexp_like(path, '[.]list[.]element')"


def analyse(spark: SparkSession, name: str, catalog: DataFrame, **more: DataFrame) -> DataFrame:
    return run(spark, TEXTS[name], catalog=catalog, **more)
