"""Schema inference: documents to a typed path profile, as one grouped aggregation.

Merging record types pairwise is commutative and associative, so a profile is a
group-by: explode each record to (path, atom) rows, count them by path, then
apply the collapse rule. Records are read once; children are unfolded level by
level without a shuffle, so the only one carries one partial row per path and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.errors import SchemaError

# ISO 8601 shapes of timestamps, dates and times.
TIMESTAMP = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME = "^[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$"


NODES = "array<struct<path:string,parent:string,atom:string>>"


def atom(v: str, kind: str, datetimes: bool = False) -> Column:
    """The atom of a VARIANT column whose schema text stands in column kind."""
    kind, text = F.col(kind), F.expr(f"try_variant_get({v}, '$', 'string')")
    plain = F.when(text == "", "empty_string")
    if datetimes:
        trimmed = F.trim(text)
        plain = plain.when(trimmed.rlike(TIMESTAMP), "timestamp").when(trimmed.rlike(DATE), "date").when(trimmed.rlike(TIME), "time")
    bare = F.expr(f"variant_get({v}, '$[0]') is null")  # [] and [null] have one schema text
    whole = kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")  # shorter whole numbers are BIGINT
    return (
        F.when(kind == "STRING", plain.otherwise("str")).when(kind == "BIGINT", "int").when(kind == "OBJECT<>", "empty_object").when(kind.startswith("OBJECT"), "object")
        .when(kind.isNull() | (kind == "VOID"), "missing").when(kind == "BOOLEAN", "bool").when(whole, "int").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind == "ARRAY<VOID>", F.when(bare, "empty_array").otherwise("array")).when(kind.startswith("ARRAY"), "array").otherwise("any")
    )


def depth_of(records: DataFrame) -> int:
    """How deep the records nest, from one aggregate over them."""
    text = records.agg(F.expr("schema_of_variant_agg(rec)").alias("s")).first()["s"] or ""
    deep = most = 0
    for ch in text:
        deep += (ch == "<") - (ch == ">")
        most = max(most, deep)
    return max(most, 1) + 1


def paths(records: DataFrame, depth: int | None = None, datetimes: bool = False) -> DataFrame:
    """(path, parent, atom) for every node of every record (rec: VARIANT); of arrays, the first element.

    Values whose kinds conflict across records read as VARIANT in the merged
    schema, so the depth is a lower bound there; pass depth for such data.
    """
    levels = (depth_of(records) + 2) if depth is None else depth
    return paths_with(records, [], levels, datetimes)


def paths_with(records: DataFrame, keep: list[str], levels: int, datetimes: bool = False) -> DataFrame:
    """The same with columns of the record kept; runs on streams too.

    Each level is one variant_explode, so a record is parsed once and its values
    are cut, not copied. A node travels down with its first child until the
    last level, where all nodes of a row are unfolded. Objects and arrays that
    stand there and hold more have the atoms object+ and array+.
    """
    unfold, none = records.sparkSession.tvf.variant_explode_outer, F.array().cast(NODES)
    now = records.select(*keep, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.col("rec").alias("v"), none.alias("above"))

    def named(df: DataFrame) -> DataFrame:
        df = df.withColumn("kind", F.when(F.col("path").isNotNull(), F.expr("schema_of_variant(v)")))  # a column of its own is evaluated once
        own = F.array(F.struct("path", "parent", atom("v", "kind", datetimes).alias("atom")))
        return df.select(*keep, "path", "v", F.when(F.col("path").isNull(), F.col("above")).otherwise(F.concat("above", own)).alias("nodes"))

    for _ in range(levels):
        grown = named(now).lateralJoin(unfold(F.col("v").outer())).where("pos is null or pos = 0 or key is not null")
        member = F.col("key").isNotNull()
        path = F.when(member, F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))).when(F.col("pos").isNotNull(), F.concat("path", F.lit("[0]")))
        now = grown.select(*keep, path.alias("path"), F.when(member, F.col("path")).alias("parent"), F.col("value").alias("v"), F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("nodes")).otherwise(none).alias("above"))
    last = now.withColumn("kind", F.when(F.col("path").isNotNull(), F.expr("schema_of_variant(v)"))).withColumn("atom", atom("v", "kind", datetimes))
    marked = F.when(F.col("atom").isin("object", "array"), F.concat("atom", F.lit("+"))).otherwise(F.col("atom"))
    nodes = F.when(F.col("path").isNull(), F.col("above")).otherwise(F.concat("above", F.array(F.struct("path", "parent", marked.alias("atom")))))
    return last.select(*keep, F.explode(nodes).alias("n")).select(*keep, "n.path", "n.parent", "n.atom")


#: From counts (path, parent, atom, n) to the merged profile (path, type_repr, n), as SQL; merge() is the same as one aggregate and two joins.
MERGE = """
with raw as (select path, min(parent) as parent, sum(n) as n from {counts} group by path),
 objects as (select path, sum(n) as n from {counts} where atom in ('object', 'empty_object') group by path),
 atoms as (select path, atom from {counts}
   union select r.path, 'missing' as atom from raw as r join objects as o on o.path = r.parent where r.path <> '' and r.n < o.n),
 kinds as (select path, count(*) as k, sum(case when atom = 'object' then 1 else 0 end) as o, sum(case when atom = 'array' then 1 else 0 end) as a, sum(case when atom in ('array', 'empty_array') then 1 else 0 end) as ea,
   sum(case when atom <> 'any' then 1 else 0 end) as known from atoms group by path),
 closed as (select path from kinds where not (k = 1 and o = 1) and not (a = 1 and ea = k)),
 base as (select distinct a.path, case a.atom when 'empty_string' then 'str' when 'empty_object' then 'object' when 'empty_array' then 'array' else a.atom end as atom
   from atoms as a join kinds as k on k.path = a.path where a.atom <> 'any' or k.known = 0)
select b.path, case when count(*) = 1 then min(b.atom) else concat('union(', replace_all(listagg(b.atom), ',', '|'), ')') end as type_repr, cast(max(r.n) as bigint) as n
from base as b join raw as r on r.path = b.path
where b.path <> '' and not exists (select 1 from closed as c where c.path <> '' and (starts_with(b.path, concat(c.path, '.')) or starts_with(b.path, concat(c.path, '[0]'))))
group by b.path
"""


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path", "parent", "atom").agg(F.count(F.lit(1)).alias("n"))


_held: list[DataFrame] = []
#: Levels that documents may have; deeper ones are an error, not a shorter profile.
MOST_LEVELS = 512


def release() -> None:
    """Let go of the small tables that plans keep in memory; what is not yet read is then worked out again."""
    while _held:
        _held.pop().unpersist()


def kept(found: DataFrame) -> DataFrame:
    """A small table that several joins read, kept until release()."""
    _held.append(found.cache())
    return found


def full_counts(records: DataFrame, depth: int | None = None, datetimes: bool = False) -> DataFrame:
    """Counts of all nodes: while some level holds more below it, the records are unfolded twice as deep."""
    levels = (depth_of(records) + 2) if depth is None else depth
    while True:
        found = kept(counts(paths(records, levels, datetimes)))
        if found.where(F.col("atom").endswith("+")).isEmpty():
            return found
        if levels >= MOST_LEVELS:
            raise SchemaError("documents nest too deep", levels=levels)
        _held.pop().unpersist()
        levels = min(MOST_LEVELS, 2 * levels)


def merge(found: DataFrame) -> DataFrame:
    """Counts (path, parent, atom, n) to the merged profile: path, type_repr, n.

    A member that fewer records have than have its object is also missing. Below
    a path of several kinds nothing is listed.
    """
    container = F.col("atom").isin("object", "empty_object")
    per = kept(found.groupBy("path").agg(F.min("parent").alias("parent"), F.sum("n").alias("n"), F.sum(F.when(container, F.col("n"))).alias("objects"), F.collect_set("atom").alias("atoms")))  # one row per path
    owner = per.where("objects is not null").select(F.col("path").alias("parent"), F.col("objects").alias("have"))
    full = per.join(owner, "parent", "left").withColumn("atoms", F.when((F.col("path") != "") & (F.col("n") < F.col("have")), F.array_union("atoms", F.array(F.lit("missing")))).otherwise(F.col("atoms")))
    only = lambda *kinds: F.size(F.array_except("atoms", F.array(*map(F.lit, kinds)))) == 0
    closed = full.where(~only("object") & ~(only("array", "empty_array") & F.array_contains("atoms", "array")) & (F.col("path") != "")).select(F.col("path").alias("above"))
    ends = "filter(sequence(1, char_length(path)), i -> substr(path, i, 1) = '.' or substr(path, i, 3) = '[0]')"
    hidden = per.where("path <> ''").select("path", F.explode(F.expr(f"transform({ends}, i -> substr(path, 1, i - 1))")).alias("above")).join(closed, "above").select("path").distinct()
    names = F.transform("atoms", lambda a: F.when(a == "empty_string", "str").when(a == "empty_object", "object").when(a == "empty_array", "array").otherwise(a))
    known = F.when(only("any"), names).otherwise(F.array_remove(names, "any"))
    shown = full.where("path <> ''").join(hidden, "path", "left_anti").select("path", F.array_sort(F.array_distinct(known)).alias("kinds"), "n")
    text = F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise(F.concat(F.lit("union("), F.array_join("kinds", "|"), F.lit(")")))
    return shown.select("path", text.alias("type_repr"), F.col("n").cast("bigint").alias("n"))


def merge_profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two profiles as counts (path, parent, atom, n) to the merged profile of all their records.

    Counts are what merges without loss: a finished profile no longer tells an
    empty array from a full one, nor what stands below a path of several kinds.
    """
    return merge(left.unionByName(right).groupBy("path", "parent", "atom").agg(F.sum("n").alias("n")))


def infer(records: DataFrame, depth: int | None = None, datetimes: bool = False) -> DataFrame:
    """The merged profile of records (rec: VARIANT): path, type_repr, n. depth is where unfolding starts; it goes on as deep as the records do."""
    return merge(full_counts(records, depth, datetimes))


def bad_records(df: DataFrame, column: str) -> DataFrame:
    """How many texts are no JSON (repeated keys and NaN included); they are counted, never dropped silently."""
    return df.agg(F.count_if(F.expr(f"{column} is not null and try_parse_json({column}) is null")).alias("bad_records"), F.count(F.lit(1)).alias("records"))
