"""Near copies at exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sources. Fingerprints of five-word shingles that
differ in 3 bits or fewer meet by ball hashing (simhash.py); but at similarity
0.8 fingerprints differ in about ten bits, which no ball of bearable size
reaches. So each text also has 12 keys, each of 4 minima of its shingles'
hashes; texts of similarity 0.8 share no key with a chance of 0.002. Texts
that share a key of up to SMALL texts are all paired.

A larger key is settled in two steps, and no link between its texts is lost.
First each text is paired with the one that has most company over all its
keys, and with one text that shares two of its keys, so that groups of near
copies become components at a cost linear in the rows. Then the texts of keys
that still hold several components are joined exactly: in an order of all
shingles, rare ones first, two texts of similarity 0.8 or more share a shingle
among the first fifth of each, and only texts of different components meet
there. A shingle of many texts is dealt to tasks by pairs of blocks of texts.

Every candidate is verified by the shingle sets themselves (as 64-bit hashes),
and components of the verified links are found by star contraction. Texts that
are equal but for ASCII case and white space are one row before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from . import simhash
from .components import connected_components

SHINGLE = 5
LEAST = 0.8
KEYS, MINIMA = 12, 4
#: Texts of one key that are paired with each other without further ado.
SMALL = 16
#: Texts below one shingle that meet in one group; more are dealt to pairs of blocks.
BLOCK = 512
#: Bits of the table that counts shingles; it only orders them, so collisions cost time but no link.
TALLY_BITS = 18
#: Pairs that are looked at at once.
AT_ONCE = 1 << 17

_SALTS = np.random.default_rng(20240705).integers(1, 2**63, size=KEYS * MINIMA, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block: a hash of its words, and the sorted hashes of its distinct shingles (of a shorter text, the whole; of none, nothing)."""
    starts, ends, first = c.words_of(data, at)
    sums = c.run_sums(c.word_hashes(_LOWER[data], starts, ends, 0), 0)
    n = len(starts)
    whole = c.run_hash(sums, np.minimum(first[:-1], n), first[1:], 0)
    runs = c.run_hash(sums, np.arange(max(0, n - SHINGLE + 1)), np.arange(SHINGLE, n + 1), 0) if n >= SHINGLE else np.zeros(0, np.uint64)
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        found = np.unique(runs[lo : hi - SHINGLE + 1]) if hi - lo >= SHINGLE else whole[i : i + min(1, hi - lo)]
        yield int(whole[i].view(np.int64)), found


def keys_of(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; a text without words has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 4096):
        least = np.minimum(least, c.mix(found[None, lo : lo + 4096] ^ _SALTS[:, None]).min(axis=1))
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for j in range(MINIMA):
        out = c.mix(out ^ least.reshape(KEYS, MINIMA)[:, j])
    return out.view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _row, _rest, text) to (doc_id, _row, _rest, _text, _fp, _keys)."""
    for batch in batches:
        for lo, hi, data, at in c.blocks(batch.column(3), c.SMALL_BLOCK):
            raw, text, fp, keys = data.tobytes(), [], np.zeros(hi - lo, np.uint64), []
            for i, (whole, found) in enumerate(shingles(data, at)):
                text.append(whole)
                fp[i] = simhash.fingerprint(raw[at[i] : at[i + 1]], SHINGLE)
                keys.append(keys_of(found))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(text, pa.int64()), pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", *ROW, "_text", "_fp", "_keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, text) to (t, set)."""
    for batch in batches:
        for lo, hi, data, at in c.blocks(batch.column(1), c.SMALL_BLOCK):
            found = [x.view(np.int64) for _, x in shingles(data, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, pa.list_(pa.int64()))], names=["t", "set"])


def _shared(texts: DataFrame) -> DataFrame:
    """(t, key, n) of texts (t, fp, keys): the keys of n > 1 texts."""
    keys = texts.select("t", F.explode("keys").alias("key"))
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key").select("t", "key", "n")


def _pairs(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of texts (t, fp, keys): all of small keys, stars of larger ones, close fingerprints."""
    few = shared.where(F.col("n") <= SMALL)
    small = few.select("key", F.col("t").alias("x")).join(few.select("key", F.col("t").alias("y")), "key").where("x < y").select("x", "y")
    company = shared.groupBy("t").agg(F.sum("n").alias("company"))
    many = shared.where(F.col("n") > SMALL).join(company, "t")
    centre = many.groupBy("key").agg(F.max(F.struct("company", "t"))["t"].alias("y"))
    large = many.join(centre, "key").select(F.col("t").alias("x"), "y")
    two = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("keys")[i], F.col("keys")[i + 1]) for i in range(0, KEYS, 2)]))
    finer = texts.join(many.select("t").distinct(), "t", "left_semi").select("t", two.alias("key"))
    finer = finer.join(finer.groupBy("key").agg(F.min("t").alias("y")), "key").select(F.col("t").alias("x"), "y")

    fps = c.spool(texts.groupBy("fp").agg(F.min("t").alias("least")), "distinct-fingerprints")
    same = texts.join(fps, "fp").select(F.col("t").alias("x"), F.col("least").alias("y"))
    left, right = (fps.select(F.col("fp").alias(e), F.col("least").alias(n)) for e, n in (("a", "x"), ("b", "y")))
    close = simhash.fingerprint_links(fps).join(left, "a").join(right, "b").select("x", "y")
    every = small.unionByName(large).unionByName(finer).unionByName(same).unionByName(close).where("x <> y")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity LEAST or more, by sets (t, set)."""
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("i") >= LEAST * (F.col("n") - F.col("i"))).select("a", "b")


def _unsettled(shared: DataFrame, root: DataFrame) -> DataFrame:
    """(t, root) of the texts in keys of more than SMALL texts that are not all of one component."""
    many = shared.where(F.col("n") > SMALL).select("t", "key").join(root, "t", "left").withColumn("root", F.coalesce("root", "t"))
    mixed = many.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    return many.join(mixed, "key").select("t", "root").distinct()


def _place(shingle: np.ndarray) -> np.ndarray:
    """The place of shingles in the table of counts."""
    return (c.mix(shingle) >> np.uint64(64 - TALLY_BITS)).astype(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the offsets of its rows from 0."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(np.uint64), at - at[0]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, root, set) to (place, n): how many shingles fall on each place of the table."""
    count = np.zeros(1 << TALLY_BITS, np.int64)
    for batch in batches:
        count += np.bincount(_place(_flat(batch.column(2))[0]), minlength=len(count))
    place = np.flatnonzero(count)
    if len(place):
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(count[place])], names=["place", "n"])


def _first_shingles(count: np.ndarray):
    """(t, root, set) to (s, t, root, size, p): the shingles that a text of similarity LEAST can be the first to share, p their rank by (count, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _flat(batch.column(2))
            for lo in range(0, batch.num_rows, 256):
                found, size = [], np.diff(at[lo : lo + 257]).astype(np.int64)
                first = size - (4 * size + 4) // 5 + 1
                for x, y, k in zip(at[lo : lo + 256].tolist(), at[lo + 1 : lo + 257].tolist(), first.tolist()):
                    mine = values[x:y]
                    found.append(mine[np.lexsort((mine, count[_place(mine)]))[:k]])
                taken = np.array([len(x) for x in found], np.int64)
                row = np.repeat(np.arange(len(found)), taken)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
                rows = pa.array(row + lo)
                s = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(size[row].astype(np.int32)), pa.array(rank.astype(np.int32))], names=["s", "t", "root", "size", "p"])

    return run


def _met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups; rows: the columns s, i, j, root, b, t, size, p, sorted by the first four."""
    s, i, j, root, block, t, size, p = rows
    if not len(s):
        return
    other = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    ends = [np.append(np.flatnonzero(e) + 1, len(s)) for e in (other, other | (root[1:] != root[:-1]))]
    end, after = (np.repeat(e, np.diff(e, prepend=0)) for e in ends)
    partners = np.cumsum(end - after)  # rows of the group with a greater root
    lo, done = 0, 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(partners, done + AT_ONCE, side="right")))
        n = (end - after)[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        y = after[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        need = (4 * (size[x] + size[y]) + 8) // 9  # shingles in common at similarity 0.8
        near = (p[x] <= size[x] - need) & (p[y] <= size[y] - need) & ((i[x] == j[x]) | (block[x] != block[y]))
        if near.any():
            a, b = t[x[near]], t[y[near]]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
        lo, done = hi, int(partners[hi - 1])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows (sorted by s, i, j and root) to pairs; a group has about two blocks at most."""
    held = np.zeros((8, 0), np.int64)
    for batch in batches:
        held = np.concatenate((held, np.stack([x.to_numpy().astype(np.int64) for x in batch.columns])), axis=1)
        if not held.shape[1]:
            continue
        last = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from _met(held[:, :cut])
        held = held[:, cut:]
    yield from _met(held)


def exact_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of sets (t, root, set) with different roots; all of similarity LEAST or more are among them."""
    found = sets.mapInArrow(_tally, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # of bounded size
    count = np.zeros(1 << TALLY_BITS, np.int64)
    count[found.column(0).to_numpy()] = found.column(1).to_numpy()
    first = c.spool(sets.mapInArrow(_first_shingles(count), "s bigint, t bigint, root bigint, size int, p int"), "first-shingles")
    several = first.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("least < most")
    rows = first.join(several.select("s", "blocks"), "s").withColumn("b", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "root", "b", "t", "size", "p")
    dealt = rows.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "root")
    return dealt.mapInArrow(_meetings, "a bigint, b bigint").distinct()


ROW = ["_row", "_rest"]


def with_row(docs: DataFrame) -> DataFrame:
    """docs with _row and _rest, two hashes of a row's id and text (128 bits, so that unlike rows stay apart)."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return docs.withColumns({"_row": F.xxhash64(*parts), "_rest": F.xxhash64(F.lit(1), *parts)})


def kept_rows(docs: DataFrame) -> DataFrame:
    """doc_id, _row and _rest of one row of each component: the least by (doc_id, null last; _row).

    docs: doc_id, text. Rows without an id count by their texts like any other,
    and rows that share an id but not a text count apart. Texts without words
    are one component.
    """
    docs = with_row(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in (*ROW, "_text", "_fp")], T.StructField("_keys", T.ArrayType(T.LongType()))])
    marked = c.spool(docs.select("doc_id", *ROW, "text").mapInArrow(_marks, schema), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW, F.col("_fp").alias("fp"), F.col("_keys").alias("keys")))
    texts = c.spool(marked.groupBy(F.col("_text").alias("t")).agg(first.alias("f")).select("t", "f.*"), "texts")
    c.drop_spool(marked)
    worded = texts.where(F.size("keys") > 0).select("t", "fp", "keys")
    shared = c.spool(_shared(worded), "shared-keys")
    pairs = c.spool(_pairs(worded, shared), "pairs")
    # written first, its size is known: Spark broadcasts it where that is small, so that the other texts need not move
    wanted = c.spool(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct().join(texts, "t").select("t", *ROW), "texts-in-pairs")
    read = docs.select(*ROW, "text").join(wanted, ROW).dropDuplicates(ROW).select("t", "text")
    sets = c.spool(read.mapInArrow(_sets, "t bigint, set array<bigint>"), "shingle-sets")
    links = c.spool(_verified(pairs, sets), "links")
    c.drop_spool(pairs, wanted)
    root = connected_components(links).withColumnRenamed("node", "t")
    rest = c.spool(_unsettled(shared, root), "unsettled")
    if not rest.isEmpty():
        met = c.spool(exact_pairs(c.spool(sets.join(rest, "t").select("t", "root", "set"), "unsettled-sets")), "pairs")
        links = c.spool(links.unionByName(_verified(met, sets)), "links")
        root = connected_components(links).withColumnRenamed("node", "t")
    c.drop_spool(sets, shared)
    rooted = texts.join(root, "t", "left").withColumn("root", F.coalesce("root", "t"))
    return rooted.groupBy("root").agg(F.min(F.struct("none", "doc_id", *ROW)).alias("f")).select("f.doc_id", "f._row", "f._rest")
