"""Approximate nearest neighbours by multi-index hashing.

Codes. Rotations of the space are learned by iterative quantisation on a
bounded sample; the signs of a rotated vector are its bits, and several
rotations together give BITS bits. For inner products of vectors of unequal
length a coordinate is added that makes all candidates equally long (a query
has 0 there), so that the largest product is the smallest angle.

Index. A code is cut into SUBSTRINGS of 8 bits. If two codes differ in at most
r bits, then for radii that sum to r - SUBSTRINGS + 1 some piece differs by at
most its radius: probing all values within these radii finds every code within
r (pigeonhole). The index of a piece therefore holds, for each of its 256
values, a bitmap of the rows whose piece lies within the radius; a query takes
one bitmap for each piece and joins them. Found codes are verified on all bits,
then reranked by the exact product in double precision. r is learned on the
sample, for RECALL of its true neighbours; of a sample of n from N rows the
nearest k * n / N stand for the k nearest of all, so r falls as the table grows.

Layout. Every vector is indexed, in shards of up to SHARD_ROWS rows that live
only while a block of at most QUERY_BLOCK queries is held against them. A task
keeps the nearest of each query over all its shards and gives them once; those
of the tasks merge by a grouped top-k. A query that finds fewer than k rows is
asked again with a radius of all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

BITS, SAMPLE, RECALL = 256, 4096, 0.97
SHARD_ROWS, QUERY_BLOCK = 32_768, 8192
FOUND = "query bigint, vec_id bigint, score double, own boolean"
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def learn_rotations(x: np.ndarray, bits: int = BITS, rounds: int = 15, seed: int = 11) -> np.ndarray:
    """Rotations (dimensions by bits) whose signs lose little of the sample x (iterative quantisation)."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    for _ in range(math.ceil(bits / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def lengthen(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the coordinate that makes them all `longest` long."""
    return np.concatenate((x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))[:, None]), axis=1)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Rows of bytes."""
    return np.packbits(x @ rotations > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of a and one code b, both viewed as 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn_radius(x: np.ndarray, code: np.ndarray, query_code: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The radius within which `recall` of the k true neighbours in the sample lie."""
    n, seen = len(x), []
    for i in range(0, n, max(1, n // 1024)):
        score = x @ x[i]
        score[i] = -np.inf
        top = np.argpartition(-score, min(k, n - 1) - 1)[: min(k, n - 1)] if n > 1 else []
        seen.append(hamming(code[top], query_code[i]))
    seen = np.concatenate(seen) if seen else np.zeros(0)
    return int(np.quantile(seen, recall, method="higher")) if len(seen) else code.shape[1] * 64


class Shard:
    """The index of one shard: for each byte of the codes and each of its values, a bitmap of the rows near it."""

    def __init__(self, code: np.ndarray, radius: int):
        n, m = code.shape
        self.n, self.radius = n, radius
        self.words = [np.ascontiguousarray(w) for w in np.ascontiguousarray(code).view(np.uint64).T]
        base, more = divmod(radius - m + 1, m)
        wide = -(-n // 64) * 8
        self.near = np.zeros((m, 256, wide), np.uint8)
        for j in range(m):
            rows = NEAR[code[:, j]] <= base + (j < more)  # rows by values
            self.near[j, :, : -(-n // 8)] = np.packbits(rows.T, axis=1)
        self.near = self.near.view(np.uint64)
        self.pieces = np.arange(m)

    def within(self, query: np.ndarray) -> np.ndarray:
        """All rows whose code differs from query (bytes) in at most `radius` bits."""
        probed = np.bitwise_or.reduce(self.near[self.pieces, query], axis=0)
        mine = query.view(np.uint64)
        if int(np.bitwise_count(probed).sum()) * 4 < self.n:
            rows = np.flatnonzero(np.unpackbits(probed.view(np.uint8), count=self.n))
            words = [w[rows] for w in self.words]
        else:
            rows, words = None, self.words
        differ = np.bitwise_count(words[0] ^ mine[0]).astype(np.uint16)
        for w, q in zip(words[1:], mine[1:]):
            differ += np.bitwise_count(w ^ q)
        close = np.flatnonzero(differ <= self.radius)
        if rows is not None:
            return rows[close]
        there = np.unpackbits(probed.view(np.uint8), count=self.n) if len(close) else close
        return close[there[close] > 0]


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: of the commonest length, whole, finite and not zero."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = df.where(good).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    first = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("v") == (first["d"] if first else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _merge(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of largest score, ties to smaller ids."""
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        top = np.flatnonzero(scores >= edge)  # with all ties at the edge
        top = top[np.lexsort((ids[top], -scores[top]))][:k]
        ids, scores, own = ids[top], scores[top], own[top]
    return ids, scores, own


def _search(keys, queries, query_codes, rotations, longest: float, radius: int, k: int):
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        best = [none] * len(keys)  # of each query over the shards of this task

        def solve() -> None:
            ids, key, x = (np.concatenate(z) for z in zip(*held))
            held.clear()
            for lo in range(0, len(ids), SHARD_ROWS):
                part = slice(lo, lo + SHARD_ROWS)
                i, y, z = ids[part], key[part], x[part]
                shard = Shard(codes(lengthen(z, longest), rotations), radius)
                for q in range(len(keys)):
                    found = shard.within(query_codes[q])
                    if len(found):
                        new = i[found], z[found] @ queries[q], y[found] == keys[q]
                        best[q] = _merge(*(np.concatenate(p) for p in zip(best[q], new)), k)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), d)))
            if sum(len(h[0]) for h in held) >= SHARD_ROWS:
                solve()
        if held:
            solve()
        for lo in range(0, len(keys), 1024):
            ids, scores, own = (np.concatenate(p) for p in zip(*best[lo : lo + 1024]))
            which = np.repeat(keys[lo : lo + 1024], [len(b[0]) for b in best[lo : lo + 1024]])
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (which, ids, scores, own)], names=["query", "vec_id", "score", "own"])

    return run


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """The k nearest found of every row for which is_query holds: query_id, rank, vec_id, score.

    Candidates are all other rows; score is the inner product in double
    precision, ties go to the smaller id. Rows without an id, null vectors, and
    vectors that are zero, hold null or non-finite components or have another
    length than most take no part. Rows that share an id are candidates of each
    other, and repeated query rows are answered each. Other columns are ignored.
    Fewer candidates than k give that many rows; an empty table gives none.
    """
    spark = df.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    marked = df.select(F.col(id_col), F.col(vec_col), F.coalesce(is_query, F.lit(False)).alias("_q"))
    good = vectors(marked, id_col, vec_col).withColumn("key", F.xxhash64("vec_id", "v")).select("vec_id", "key", "v")
    asked = vectors(marked.where("_q"), id_col, vec_col).withColumn("key", F.xxhash64("vec_id", "v"))
    shape = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not shape["n"]:
        return nothing
    longest, d = math.sqrt(shape["m"]), shape["d"]
    asked = asked.where(F.size("v") == d).groupBy("key").agg(F.first("vec_id").alias("query_id"), F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    asked = c.spool(asked, "queries")
    sample = np.array([r["v"] for r in good.orderBy("key").limit(SAMPLE).select("v").collect()])
    full = lengthen(sample, longest)
    rotations = learn_rotations(full)
    share = max(1, math.ceil(k * len(sample) / shape["n"]))
    radius = learn_radius(sample, codes(full, rotations).view(np.uint64), codes(np.pad(sample, ((0, 0), (0, 1))), rotations).view(np.uint64), share)

    def ask(queries: DataFrame, radius: int) -> DataFrame | None:
        n = queries.count()
        blocks, parts = math.ceil(n / QUERY_BLOCK), []
        for b in range(blocks):  # each block is a bounded number of rows, about QUERY_BLOCK
            block = queries.where(F.pmod("key", F.lit(blocks)) == b).select("key", "v").toArrow().combine_chunks()
            if not block.num_rows:
                continue
            keys, x = block.column("key").to_numpy(), _matrix(block.column("v").chunk(0), d)
            run = _search(keys, x, codes(np.pad(x, ((0, 0), (0, 1))), rotations), rotations, longest, radius, k + 1)
            parts.append(c.spool(good.mapInArrow(run, FOUND), "nearest"))
        if not parts:
            return None
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        order = [F.desc("score"), F.asc("vec_id")]
        # the query's own row, once, is no candidate
        mine = F.col("own") & (F.row_number().over(Window.partitionBy("query", "own").orderBy(*order)) == 1)
        others = found.withColumn("mine", mine).where("not mine")
        out = others.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        out = c.spool(out.select("query", "rank", "vec_id", "score"), "nearest-k")
        c.drop_spool(*parts)
        return out

    found = ask(asked, radius)
    if found is None:
        return nothing
    whole = min(k, shape["n"] - 1)
    short = asked.join(found.where(F.col("rank") == whole).select(F.col("query").alias("key")), "key", "left_anti") if whole else asked.limit(0)
    again = ask(short, rotations.shape[1])
    if again is not None:
        found = found.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionByName(again)
    answers = found.join(asked.select(F.col("key").alias("query"), "query_id", "times"), "query")
    return answers.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, times)")).alias("_copy")).drop("_copy")


def op2(spark, sf_dir: str) -> DataFrame:
    """The op2 query: rows of embeddings whose id is divisible by 20 against all others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % 20 == 0)
