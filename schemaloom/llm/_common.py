"""Shared helpers: the shared folder, column handling, text buffers and hashes.

Texts are handled as UTF-8 bytes in blocks of a bounded number of bytes (or
one document, if that is longer), so that the working memory of a Python
worker depends on the longest document and never on the size of a partition.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once in a Python worker.
BLOCK_BYTES = 1 << 20
#: The same where arrays are sorted or many times as wide as the text, so that they stay in a cache.
SMALL_BLOCK = 1 << 18

#: The words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local folder stands in only where everything runs in this one process;
    on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loom_shared", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark._loom_shared = "file://" + tempfile.mkdtemp(prefix="loom-")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Remove spooled tables (all of this driver's, if none is named)."""
    with contextlib.suppress(Exception):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths or list(_written):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            if path in _written:
                _written.remove(path)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def drop_spool(*frames: DataFrame) -> None:
    """Remove spooled tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_loom_path", None):
            release(df.sparkSession, path)


@contextlib.contextmanager
def spools_of_a_step(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, what was spooled inside but for the paths put into the list that it gives."""
    before, keep = set(_written), []
    yield keep
    if gone := [p for p in _written if p not in before and p not in keep]:
        release(spark, *gone)


def parts_for(df: DataFrame, each: int) -> int:
    """Partitions of about `each` bytes by the optimiser's estimate of the input, spark.sql.shuffle.partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, estimate // each if estimate < 1 << 60 else 0)  # without statistics the estimate is the greatest number


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without the columns that an operator is about to add; input columns of those names are replaced."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def schema_of(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df with columns added at its end."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, t, True) for n, t in added]])


def with_arrays(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with more columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], names=[*batch.schema.names, *arrays])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `most` bytes (one row at least): first row, end row, bytes, offsets from 0."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, lo + 16384, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


# ---------------------------------------------------------------- hashes

_rng = np.random.default_rng(20240601)
#: A random 64-bit value for each byte, for two independent hashes.
BYTE_VALUES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
#: Odd bases of the polynomial hashes modulo 2**64: of bytes in a word, of words in a run.
BYTE_BASE = _rng.integers(2**40, 2**63, size=2, dtype=np.uint64) | np.uint64(1)
RUN_BASE = _rng.integers(2**40, 2**63, size=2, dtype=np.uint64) | np.uint64(1)
RUN_INVERSE = np.array([pow(int(b), -1, 2**64) for b in RUN_BASE], dtype=np.uint64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(key := (int(base), 0))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of a block, and the offset of each row's first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_space[data]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | first[:n]))
    follows = np.empty(n, bool)
    follows[-1] = False
    follows[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~follows | first[1:])) + 1 if n else starts
    if len(ends) != len(starts):  # the end of the block ends a word as well
        ends = np.append(ends, n)
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each word; which: 0 or 1, two independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    length = ends - starts
    span = np.diff(np.append(starts, hi))
    place = np.arange(lo, hi) - np.repeat(starts, span)
    value = BYTE_VALUES[which][part] * powers(BYTE_BASE[which], int(span.max()))[place]
    value[place >= np.repeat(length, span)] = 0
    return mix(np.add.reduceat(value, starts - lo) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_sums(hashes: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which run_hash gives the hash of any run of words."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(RUN_BASE[which], len(hashes)), dtype=np.uint64, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The hash of the words start..end-1 of each run."""
    back = powers(RUN_INVERSE[which], len(sums))[start]
    return mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))
