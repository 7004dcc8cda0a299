"""Order MinHash document fingerprints.

k-mers are runs of K code points, each numbered by how often it has occurred
before in the text, so that all are distinct. For each of `SKETCHES` hash
functions the L smallest numbered k-mers are selected, put back into text order
and hashed as a tuple; a signature is one 16-bit value per function. Two texts
agree at a position when they select the same k-mers in the same order, so the
share of equal positions falls with edit distance, moves included, where plain
MinHash sees only the set.

The order of a function is a 32-bit multiplicative hash of a well mixed 64-bit
k-mer hash; every k-mer of the text takes part in each.

To meet its neighbour a document needs the next one in descending id order.
Texts are range-partitioned by id (rows of one id by a hash of their text) once;
a task streams its sorted range and keeps one document in hand. The last
document of a range waits for the first of the next: only these, two a
partition, are joined afterwards, by the number of the range that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

K, L, SKETCHES = 10, 2, 64
_rng = np.random.default_rng(7)
MULTIPLIERS = (_rng.integers(1, 2**32, size=SKETCHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
POINT_BASE = np.uint64(0x9E3779B97F4A7C15)
POINT_INVERSE = np.uint64(pow(int(POINT_BASE), -1, 2**64))
POINT_VALUES = c.mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
#: Hashes that are worked on at once: functions times k-mers.
CELLS = 1 << 18
#: Bytes of input that a range of documents should hold.
RANGE_BYTES = 64 << 20
EMPTY = "0" * (4 * SKETCHES)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(cp: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers in text order. A text shorter than K is one k-mer."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(K, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(POINT_VALUES[cp] * c.powers(POINT_BASE, n), out=sums[1:])
    raw = (sums[k:] - sums[:-k]) * c.powers(POINT_INVERSE, n)[: n - k + 1]
    return c.mix(raw + np.uint64(k))


def numbered(base: np.ndarray) -> np.ndarray:
    """The hashes with the number of earlier occurrences mixed in."""
    n = len(base)
    if n < 2:
        return base
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = np.sort(((base >> bits) << bits) | np.arange(n, dtype=np.uint64))
    high = packed >> bits
    same = np.flatnonzero(high[1:] == high[:-1]) + 1
    if not len(same):
        return base
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if int(bits) > 24:  # so few bits are left of the hash that they could collide: sort in full
        place = np.argsort(base, kind="stable")
        same = np.flatnonzero(base[place][1:] == base[place][:-1]) + 1
    fresh = np.ones(n, bool)
    fresh[same] = False
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out = base.copy()
    again = same
    out[place[again]] = c.mix(base[place[again]] + (again - lead[again]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def signature(base: np.ndarray) -> np.ndarray:
    """The 16-bit values of one text from its k-mer hashes."""
    n = len(base)
    if n == 0:
        return np.zeros(SKETCHES, np.uint16)
    ids = numbered(base)
    low = (ids >> np.uint64(32)).astype(np.uint32)
    tuples = np.zeros((SKETCHES, min(L, n)), np.int64)
    step = max(1, CELLS // n)
    for lo in range(0, SKETCHES, step):
        order = MULTIPLIERS[lo : lo + step, None] * low[None, :]
        rows = np.arange(len(order))
        for j in range(tuples.shape[1]):
            tuples[lo : lo + step, j] = order.argmin(axis=1)  # ties: the earlier k-mer
            order[rows, tuples[lo : lo + step, j]] = 2**32 - 1
    tuples.sort(axis=1)  # back into text order
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1)
    for j in range(tuples.shape[1]):
        out = c.mix(out * POINT_BASE + ids[tuples[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def text_of(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class _Doc:
    __slots__ = ("base", "doc_id", "points", "sign")

    def __init__(self, doc_id, text: str):
        self.doc_id, self.points = doc_id, points(text)
        self.base = kmers(self.points)
        self.sign = signature(self.base)

    def against(self, after: _Doc) -> tuple:
        """The result row, given the next document."""
        n = len(self.points)
        take = after.points[: n // 2]
        edited = np.concatenate((self.points[: n - n // 2], take))
        sign = signature(kmers(edited)) if len(edited) else self.sign * 0
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, n, digest, text_of(self.sign), text_of(sign), likeness(self.sign, sign), likeness(self.sign, after.sign)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one range to results; its first and last texts come out too (edge: 1 first, 2 last, 3 both)."""
    rows: list[tuple] = []
    before: _Doc | None = None
    held = first = None

    def out(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[i] for r in rows] + [e[0] if i == 0 else None for e in edges], kind) for i, kind in enumerate(_KINDS)]
        cols += [pa.array([None] * len(rows) + [e[1] for e in edges], pa.string()), pa.array([0] * len(rows) + [e[2] for e in edges], pa.int32()), pa.array([0] * len(rows) + [e[3] for e in edges], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=[*_NAMES, "text", "edge", "part"])

    for batch in batches:
        for doc_id, text, part in zip(batch.column(0), batch.column(1), batch.column(2)):
            text = text.as_py() or ""
            now = _Doc(doc_id.as_py(), text)
            held = (now.doc_id, text, 2, part.as_py())
            if before is None:
                first = (now.doc_id, text, 1, part.as_py())
            else:
                rows.append(before.against(now))
            before = now
            if len(rows) >= 512:
                yield out(rows, [])
                rows = []
    yield out(rows, [first, held] if first else [])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            row = _Doc(r["doc_id"], r["text"]).against(_Doc(r["next_id"], r["next_text"]))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS)], names=_NAMES)


def fingerprints_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses (columns of RESULT).

    Documents follow each other by descending id; rows with equal ids by their
    text, rows without an id come last. The last is followed by the first, so
    a single row follows itself. A null text counts as empty; two empty texts
    are alike (1.0). Other columns are ignored; an empty table gives none.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(c.parts_for(slim, RANGE_BYTES), *order).sortWithinPartitions(*order)
    done = dealt.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(_stream, RESULT + ", text string, edge int, part int")
    done = c.spool(done, "order-minhash")
    edges = done.where("edge > 0").select("doc_id", "text", "edge", "part")
    heads = edges.where("edge = 1").select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("part").alias("after"))
    # the numbers of the ranges alone, one row each, say which one follows; the very first follows the very last
    turn = Window.partitionBy(F.lit(0)).orderBy("after")
    every = Window.partitionBy(F.lit(0))
    follows = heads.select("after").select(F.col("after").alias("part"), F.coalesce(F.lead("after").over(turn), F.min("after").over(every)).alias("after"))
    last = edges.where("edge = 2").select("doc_id", "text", "part").join(follows, "part").join(heads, "after").select("doc_id", "text", "next_id", "next_text").mapInArrow(_pairs, RESULT)
    return done.where("edge = 0").select(*_NAMES).unionByName(last)


def op3(spark, sf_dir: str) -> DataFrame:
    """The op3 query over all documents."""
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
