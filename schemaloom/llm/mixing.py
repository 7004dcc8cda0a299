"""Mixing sources to target weights by a time-varying curriculum.

Shares: sources in code-point order (null last) have the weights 3, 1, 2,
repeating, and share `budget` (150 %) of all words. A source's target stops at
`most` (2) times its size and the excess goes to the others by weight until
none is above: the level is found on the sorted caps, one row a source, by
running sums over ranges, so sources may be as many as documents.

Schedule: over training time t in [0, 1] a source's share changes linearly,
w(t) = target * (1 + slope * (2t - 1)), with slopes 0.5, 0, -0.5 by the same
turn as the weights. Its integral D(t) = target * ((1 - slope) t + slope t**2)
is the source's cumulative demand in words; it ends at the target.

Positions: the documents of a source stand in the order of md5(id); the word
offset at which a document begins is its cumulative supply, and the time at
which demand reaches that offset, D**-1(offset), is its training position. A
second pass over the source begins at the source's size. The document in which
the demand ends is taken in part, so that a source gives its target exactly.

Offsets are distributed prefix sums: words by (source, bucket), where buckets
are ranges of the md5 order, then running sums inside a bucket. The buckets
split a source that holds most rows; their number follows the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
#: Rows that a bucket of a prefix sum should hold.
BUCKET_ROWS = 200_000

ADDED = ("size", "source_size", "target", "taken", "position", "position_again")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD)), F.lit(0)).cast("bigint")


def _pick(values: tuple, turn: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (turn % len(values) + 1).cast("int"))


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with exclusive running sums over a total order of its rows.

    Rows are range-partitioned; the sums of whole ranges, one row each, are
    added up apart, and inside a range a window does the rest.
    """
    placed = c.spool(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("_range").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    starts = whole.select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(starts, "_range")
    return joined.withColumns({n: F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_{n}") for n, x in sums.items()}).select(*df.columns, *sums)


def source_targets(sizes: DataFrame, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) -> with weight, slope, target. One row a source, of which there may be many."""
    ranked = running(sizes, [F.col("source").asc_nulls_last()], turn=F.lit(1))
    ranked = ranked.withColumn("weight", _pick(WEIGHTS, F.col("turn"))).withColumn("slope", _pick(SLOPES, F.col("turn")))
    ranked = ranked.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("bigint")).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = c.spool(running(ranked, [F.col("ratio").asc(), F.col("turn").asc()], full_caps=F.col("cap"), full_weight=F.col("weight")), "caps")
    sums = fill.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = F.lit(sums["size"] or 0) * F.lit(float(budget))
    # with every smaller ratio capped, the level that the rest would reach; the first that does not rise above its own cap holds
    level = (total - F.col("full_caps")) / (F.lit(sums["weight"] or 0) - F.col("full_weight"))
    chosen = fill.select("ratio", "turn", level.alias("level")).where("level <= ratio").agg(F.min(F.struct("ratio", "turn", "level"))).first()[0]
    capped = F.col("cap").cast("double")
    target = capped if chosen is None else F.when(F.col("ratio") < chosen["level"], capped).otherwise(F.lit(chosen["level"]) * F.col("weight"))
    return fill.withColumn("target", F.least(target, capped)).select("source", "source_size", "weight", "slope", "target")


def _time(offset: Column, target: Column, slope: Column) -> Column:
    """D**-1: when cumulative demand reaches offset."""
    part = offset / target
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, part).otherwise(root)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: int = 2, size: Column | None = None) -> DataFrame:
    """df's columns without the text, with size, source_size, target, taken, position and position_again.

    taken counts words, repeats included (0: not in the mix); position is the
    time in [0, 1] at which the document begins, position_again that of its
    second pass (null: no such pass). A null text has size 0 and takes nothing,
    a null source is a source of its own; a row without an id stands where the
    md5 of its text would be. Rows with equal ids follow each other by size,
    then by a hash of their text. Input columns with the added
    names are replaced; an empty table gives an empty table.
    """
    if most != 2:
        raise ValueError("two passes are laid out")
    size = word_count(F.col(text_col).cast("string")) if size is None else size
    base = df.withColumn("_size", size)
    rest = [x for x in df.columns if x != text_col and x.lower() not in ADDED]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in df.columns else F.lit("")
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary"))).cast("binary"))  # rows without an id are dealt by their texts
    base = base.select(*[F.col(f"`{x}`") for x in rest], F.col("_size"), F.col(source_col).cast("string").alias("_src"), order.alias("_order"), F.xxhash64(text).alias("_tie"))
    base = c.spool(base, "sizes")
    digits = max(1, math.ceil(math.log(max(1, base.count() / BUCKET_ROWS), 16)) + 1)
    base = base.withColumn("_bucket", F.substring("_order", 1, digits))
    sums = base.groupBy("_src", "_bucket").agg(F.sum("_size").alias("words"))
    sources = source_targets(sums.groupBy(F.col("_src").alias("source")).agg(F.sum("words").alias("source_size")), budget, most)
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = starts.join(sources, F.col("_src").eqNullSafe(F.col("source"))).select(F.coalesce("_src", F.lit("")).alias("_s"), F.col("_src").isNull().alias("_n"), "_bucket", "_before", "source_size", "target", F.col("slope").alias("_slope"))
    inside = Window.partitionBy("_src", "_bucket").orderBy("_order", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_at", F.coalesce(F.sum("_size").over(inside), F.lit(0))).withColumns({"_s": F.coalesce("_src", F.lit("")), "_n": F.col("_src").isNull()})
    placed = placed.join(starts, ["_s", "_n", "_bucket"])
    offset, want = F.col("_at") + F.col("_before"), F.floor("target").cast("bigint")

    def took(start: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_size"), want - start))

    again = offset + F.col("source_size")
    return placed.select(
        *rest, F.col("_size").alias("size"), "source_size", "target", (took(offset) + took(again)).alias("taken"),
        F.when(took(offset) > 0, _time(offset, F.col("target"), F.col("_slope"))).alias("position"),
        F.when(took(again) > 0, _time(again, F.col("target"), F.col("_slope"))).alias("position_again"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time that a document is taken, range-sorted by its position."""
    both = mixed.withColumn("position", F.explode(F.filter(F.array("position", "position_again"), lambda p: p.isNotNull())))
    return both.drop("position_again").repartitionByRange(F.col("position")).sortWithinPartitions("position")


def op4(spark, sf_dir: str) -> DataFrame:
    """The op4 query over all documents: a row each, range-sorted by training position (those not in the mix last)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    begins = [F.col(x).asc_nulls_last() for x in ("position", "position_again", "doc_id")]  # the id splits what has no position
    return mix(docs).repartitionByRange(*begins).sortWithinPartitions(*begins).select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")


OP4_SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as o from documents),
 s as (select source, sum(size)::bigint as source_size from d group by source),
 r as (select *, row_number() over (order by source asc nulls last) - 1 as turn from s),
 w as (select *, case turn % 3 when 0 then 3 when 1 then 1 else 2 end as weight,
         case turn % 3 when 0 then 0.5::double when 1 then 0.0::double else -0.5::double end as slope, 2 * source_size as cap from r),
 f as (select *, cap::double / weight as ratio from w),
 l as (select *, (sum(source_size) over ()::double * 1.5 - coalesce(sum(cap) over b, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as lvl
       from f window b as (order by ratio, turn rows between unbounded preceding and 1 preceding)),
 c as (select (select lvl from l where lvl <= ratio order by ratio, turn limit 1) as chosen),
 t as (select source, source_size, slope, case when chosen is null or ratio < chosen then cap::double else chosen * weight end as target from l, c),
 p as (select d.*, source_size, slope, least(target, 2.0 * source_size) as target, coalesce(sum(size) over (partition by d.source order by o, size rows between unbounded preceding and 1 preceding), 0)::bigint as a
       from d join t on d.source is not distinct from t.source),
 q as (select *, greatest(0, least(size, floor(target)::bigint - a)) as once, greatest(0, least(size, floor(target)::bigint - a - source_size)) as again,
         a::double / target as x, (a + source_size)::double / target as y from p)
select doc_id, size, source_size, target, cast(once + again as bigint) as taken,
  case when once > 0 then case when slope = 0 then x else (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) end end as position,
  case when again > 0 then case when slope = 0 then y else (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) end end as position_again
from q
"""
