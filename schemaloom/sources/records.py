"""Record sources: JSON lines, arrays, objects and gzip files as one VARIANT column, and samples of them."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HTTPS = (re.compile(r"^https?://storage\.(?:cloud\.google|googleapis)\.com/([^/]+)/(.+)$"), re.compile(r"^https?://([^./]+)\.storage\.googleapis\.com/(.+)$"))


def is_object_store(path: str) -> bool:
    return path.startswith("gs://") or any(p.match(path) for p in _HTTPS)


def split_object(path: str) -> tuple[str, str]:
    """Bucket and object of gs:// or HTTPS addresses of the same store."""
    if path.startswith("gs://"):
        bucket, _, name = path[5:].partition("/")
        if not bucket or not name:
            raise ValueError(f"no bucket or object in {path!r}")
        return bucket, name
    for p in _HTTPS:
        if m := p.match(path):
            return m[1], unquote(m[2].split("?")[0])
    raise ValueError(f"not an object address: {path!r}")


def hadoop_path(path: str) -> str:
    """A path that Spark's file systems read."""
    return "gs://{}/{}".format(*split_object(path)) if is_object_store(path) and not path.startswith("gs://") else path


def is_ndjson(sample: str) -> bool:
    """The first two lines with text both open an object."""
    lines = [x.strip() for x in sample.lstrip("﻿").splitlines() if x.strip()][:2]
    return bool(lines) and len(lines) == 2 and all(x.startswith("{") for x in lines)


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind) of every file with text: lines, whole, or packed (gzip by its first bytes, without the suffix).

    Only the first two lines with text of each file reach the shuffle.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    packed = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)) == "1F8B"
    full = lines.withColumn("packed", packed).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    turn = F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))
    head = full.withColumn("turn", turn).where("turn <= 2")
    opens = F.ltrim("value").startswith("{")
    found = head.groupBy("file").agg(F.count_if(opens).alias("opens"), F.bool_or(F.col("packed") & (F.col("turn") == 1)).alias("packed"))
    return found.select("file", F.when(F.col("packed"), "packed").when(F.col("opens") == 2, "lines").otherwise("whole").alias("kind"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gzip bytes (all members) to texts."""
    for batch in batches:
        for content in batch.column(0):
            text = gzip.decompress(content.as_py()).decode("utf-8-sig")
            yield pa.RecordBatch.from_arrays([pa.array([text])], names=["raw"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ordinal, rec (VARIANT), and raw where the text is no JSON.

    Each file below the path is taken for what it is: JSON lines are split by
    Spark, a file that is one object or one array (or has a single line) is read
    whole, once, as is a gzip file without the suffix (at most 2 GB packed). If
    its first line is JSON by itself, or the whole is none, its lines are tried
    one by one. A byte-order mark is dropped.
    """
    path = hadoop_path(path)
    # the driver lists the files anyway; of those that are no JSON lines it takes the names
    rest = file_kinds(spark, path).where("kind <> 'lines'").collect()
    odd = {k: [unquote(r.file) for r in rest if r.kind == k] for k in ("whole", "packed")}
    lines = spark.read.text(path)
    if rest:
        others = spark.createDataFrame([(r.file,) for r in rest], "file string")
        lines = lines.withColumn("file", F.col("_metadata.file_path")).join(others, "file", "left_anti")
    lines = lines.select(F.regexp_replace("value", "^\ufeff", "").alias("raw"), F.monotonically_increasing_id().alias("ordinal")).where(F.trim("raw") != "")
    out = lines.select("ordinal", F.expr("try_parse_json(raw)").alias("rec"), "raw")
    texts = []
    if odd["whole"]:
        texts.append(spark.read.text(odd["whole"], wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("raw")))
    if odd["packed"]:
        texts.append(spark.read.format("binaryFile").load(odd["packed"]).select("content").mapInArrow(_unpack, "raw string"))
    for whole in texts:
        # a parser stops behind the first value, so what follows a first line that is JSON by itself would be lost
        full = whole.where(F.trim("raw") != "").select("raw", F.expr("filter(split(raw, '\\r?\\n'), x -> trim(x) <> '')").alias("full"))
        alone = F.expr("size(full) > 1 and try_parse_json(full[0]) is not null")
        parsed = full.select("full", F.when(~alone, F.expr("try_parse_json(raw)")).alias("v"))
        many = "transform(cast(v as array<variant>), x -> struct(x as rec, cast(null as string) as raw))"
        each = "transform(full, x -> struct(try_parse_json(x) as rec, x as raw))"
        items = F.expr(f"case when v is null then {each} when schema_of_variant(v) like 'ARRAY%' then {many} else array(struct(v as rec, cast(null as string) as raw)) end")
        out = out.unionByName(parsed.select(F.posexplode(items).alias("ordinal", "item")).select(F.col("ordinal").cast("bigint").alias("ordinal"), "item.rec", "item.raw"))
    return out


def nth(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The n-th record (from 1) in the given order; none if n is out of range."""
    if n < 1:
        return df.limit(0)
    return df.orderBy(*order).offset(n - 1).limit(1)


def every(df: DataFrame, cap: int | None = None) -> DataFrame:
    return df if cap is None else df.limit(cap)


def reservoir(df: DataFrame, k: int = 1000, seed: int | None = None) -> DataFrame:
    """A uniform sample of k records (a bounded top-k of random keys)."""
    return df.orderBy(F.rand(seed)).limit(k)


def keyed_sample(df: DataFrame, key: str, k: int = 1000) -> DataFrame:
    """A sample that depends on the keys only: the k smallest hashes."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(k)


def choose(df: DataFrame, first: bool = False, all_records: bool = False, k: int = 1000, seed: int | None = None) -> DataFrame:
    """First record, all records, or a sample, in this order of precedence."""
    return df.limit(1) if first else df if all_records else reservoir(df, k, seed)


def field_samples(values: DataFrame, most: int = 5) -> DataFrame:
    """values (ordinal, path, value) -> the first `most` distinct non-null values of each path, in order of first sight."""
    first = values.where("value is not null").groupBy("path", "value").agg(F.min("ordinal").alias("seen"))
    turn = Window.partitionBy("path").orderBy("seen", "value")
    return first.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("path", "turn", "value")


def format_sample(kind: Column, value: Column, longest: int = 40) -> Column:
    """A sample as text: strings quoted and cut, null, containers summarised."""
    cut = F.when(F.char_length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("..."))).otherwise(value)
    return F.when(value.isNull(), "null").when(kind == "str", F.concat(F.lit('"'), cut, F.lit('"'))).when(kind == "bool", F.lower(value)).otherwise(cut)


def sample_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples (path, turn, shown) of two sides to path, left_samples, right_samples: shown values in their order, joined by commas."""
    def joined(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("turn", "shown")))  # a handful of samples a path
        return df.groupBy("path").agg(F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda x: x["shown"]), ", "), F.lit("]")).alias(name))

    return joined(left, "left_samples").join(joined(right, "right_samples"), "path", "full_outer")
