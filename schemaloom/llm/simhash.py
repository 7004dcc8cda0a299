"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at `radius` (3) or fewer differing bits. The bits
are split into three blocks. Of three differing bits at least one lies in some
block, so after leaving out that block two fingerprints differ in at most two
of the 42 or 43 bits kept, and their balls of radius 1 (half of 2) meet. Every
distinct fingerprint therefore emits, for each block left out, itself and all
its one-bit variants: 3 + 128 rows instead of the 2,081 that balls over all
64 bits would need, while unrelated fingerprints still meet only with a chance
of about 2**-32 per pair. The rows are shuffled on the variant; colliding
fingerprints are verified on all 64 bits, and a group gives a spanning forest
of its links, never all its pairs. Components of the links are found by star
contraction (components.py).

Equal fingerprints are one row before any of this, so thousands of copies or
a third of all documents with one text cost no more than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .components import connected_components

SEED = 42
BITS = 64
#: The three blocks of bits, as masks.
BLOCKS = [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in ((0, 21), (21, 42), (42, 64))]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text; bytes.lower and bytes.split treat ASCII only, as the contract asks."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    step = np.cumsum([len(w) + 1 for w in words])
    n = len(words) - shingle + 1
    starts = np.concatenate(([0], step[: n - 1])).tolist()
    ends = (step[shingle - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for lo in range(0, n, 8192):
        part = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[lo : lo + 8192], ends[lo : lo + 8192])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(text_at: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, data, at in c.blocks(batch.column(text_at)):
                raw = data.tobytes()
                for i in range(hi - lo):
                    out[lo + i] = fingerprint(raw[at[i] : at[i + 1]], shingle)
            rest = pa.RecordBatch.from_arrays([x for i, x in enumerate(batch.columns) if i != text_at], names=[x for i, x in enumerate(batch.schema.names) if i != text_at])
            yield c.with_arrays(rest, _fp=pa.array(out.view(np.int64)))

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's variants, by block left out; the block's number stands in its place."""
    flips = [np.array([0, *(1 << b for b in range(BITS) if not int(m) >> b & 1)], np.uint64) for m in BLOCKS]
    marks = [np.uint64(i << b) for i, b in ((1, 0), (2, 21), (3, 42))]
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(fps), 4096):
            part = fps[lo : lo + 4096]
            keys = np.concatenate([(((part & ~m) | mark)[:, None] ^ f[None, :]).ravel() for m, f, mark in zip(BLOCKS, flips, marks)])
            fp = np.concatenate([np.repeat(part, len(f)) for f in flips])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64))], names=["variant", "fp"])


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; memory stays linear in their number."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    tree, edges, todo = np.zeros(n, bool), [], []
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            for y in left[near].tolist():
                edges.append((x, y))
                todo.append(y)
            left = left[~near]
    return edges


def _links(radius: int):
    """Groups of equal variants (rows come sorted by variant) to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_v, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def solve(v: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero(np.diff(v)) + 1
            start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(v)]))
            many = np.flatnonzero(end - start > 1)
            start, end = start[many], end[many]
            pairs = end - start == 2
            a, b = f[start[pairs]], f[start[pairs] + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
            left, right = [a[near]], [b[near]]
            for s, e in zip(start[~pairs].tolist(), end[~pairs].tolist()):
                group = f[s:e]
                if found := _forest(group.view(np.uint64), radius):
                    x, y = np.array(found).T
                    left.append(group[x])
                    right.append(group[y])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            return None

        for batch in batches:
            v = np.concatenate((held_v, batch.column(0).to_numpy()))
            f = np.concatenate((held_f, batch.column(1).to_numpy()))
            cut = int(np.searchsorted(v, v[-1], side="left")) if len(v) else 0
            if cut and (found := solve(v[:cut], f[:cut])) is not None:
                yield found
            held_v, held_f = v[cut:], f[cut:]
        if len(held_v) and (found := solve(held_v, held_f)) is not None:
            yield found

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (fp) at `radius` <= 3 differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("three blocks and balls of radius 1 cover a radius of 3 at most")
    balls = fps.select("fp").mapInArrow(_balls, "variant bigint, fp bigint")
    dealt = balls.repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(_links(radius), "a bigint, b bigint")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """df's columns without the text, with fingerprint (16 hex digits) and component_id.

    component_id is the smallest id in the document's component, itself
    included. A null or empty text has fingerprint zero and is linked like any
    other. Rows without an id are linked too but never name a component: it is
    null where no row of the component has an id. Repeated rows share one
    component. Input columns named fingerprint or component_id are replaced.
    """
    df = c.without(df, "fingerprint", "component_id", "_fp")
    rest = [x for x in df.columns if x != text_col]
    slim = df.select(*[F.col(f"`{x}`") for x in rest], F.col(text_col).cast("string").alias(text_col))
    schema = T.StructType([*[f for f in slim.schema.fields if f.name != text_col], T.StructField("_fp", T.LongType())])
    marked = c.spool(slim.mapInArrow(_fingerprints(len(rest), shingle), schema), "fingerprints")
    fps = c.spool(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.col(id_col)).alias("least")), "distinct-fingerprints")
    root = connected_components(fingerprint_links(fps, radius))
    rooted = fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, "_fp", "left").select(*rest, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7(spark, sf_dir: str) -> DataFrame:
    """The op7 query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")
