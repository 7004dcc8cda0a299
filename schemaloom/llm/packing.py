"""Best-fit packing by linear grouping.

Documents become pieces of at most `capacity` tokens. What the plan needs is
how many pieces have which length: a histogram of at most `capacity` rows, the
only thing the driver reads, whatever the size of the corpus.

1. Grouping. Large lengths are sorted and cut into groups of equal
   cardinality; a group counts as the largest length in it.
2. Configurations. Over these few sizes the fewest sequences are a linear
   programme over configurations, solved by column generation: the shadow
   prices of the sizes ask a knapsack for a configuration worth more than a
   sequence, until there is none. Each is used the whole number of times below
   its value. What is left, a few sequences for each size, is filled one after
   the other: the largest size, completed by the knapsack that fits best.
3. Substitution. The slots of a group receive its actual lengths in order, so
   sequences fall into runs of equal content whose true room is known.
4. Best fit. Small lengths, longest first, go where they leave least room,
   whole runs at a time; new sequences are opened when none has room.

The plan is a list of intervals: pieces of a length with ranks lo..hi-1 go to
consecutive sequences at one offset. Ranks are distributed: counts by length
and bucket, their running sums, and row numbers inside a bucket.
"""

from __future__ import annotations

import bisect
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .token_counts import tokenizer_path
from .wordbpe import WordBpe

CAPACITY, END, GROUPS = 4096, 1, 64
#: Lengths above this share of the capacity are grouped; the others are best-fitted one length at a time.
LARGE = 1 / 8
BUCKET_ROWS = 100_000


# ---------------------------------------------------------------- the plan


def _groups(counts: dict[int, int], n: int) -> list[dict]:
    """Equal-cardinality groups of the large lengths, longest first; a length may be split between two. As few lengths as that need no rounding."""
    if len(counts) <= n:
        return [{"size": x, "items": [[x, counts[x]]], "n": counts[x]} for x in sorted(counts, reverse=True)]
    total, groups, left = sum(counts.values()), [], 0
    size = max(1, -(-total // n))
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            if not left:
                groups.append({"size": length, "items": [], "n": 0})
                left = size
            take = min(todo, left)
            groups[-1]["items"].append([length, take])
            groups[-1]["n"] += take
            todo, left = todo - take, left - take
    return groups


def _complete(groups: list[dict], left: list[int], lead: int, room: int) -> list[int]:
    """The slots (group numbers) that fill `room` best beside one of group `lead`; larger sizes are preferred."""
    best = np.full(room + 1, -1, np.int64)  # the group whose slot reached this fill last
    before = np.zeros(room + 1, np.int64)
    best[0] = -2
    for g in range(lead, len(groups)):
        size = groups[g]["size"]
        most = min(left[g] - (g == lead), room // size)
        for _ in range(most):
            reached = np.flatnonzero(best[: room + 1 - size] != -1)
            fresh = reached[best[reached + size] == -1]
            if not len(fresh):
                break
            best[fresh + size], before[fresh + size] = g, fresh
        if best[room] != -1:
            break
    at = int(np.flatnonzero(best != -1)[-1])
    slots = []
    while at > 0:
        slots.append(int(best[at]))
        at = int(before[at])
    return slots


def _richest(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of most worth (an unbounded knapsack, one more item at a time)."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        now, pick = best.copy(), np.full(capacity + 1, -1, np.int16)
        for g, size in enumerate(sizes):
            if worth[g] > 0:
                with_it = best[: capacity + 1 - size] + worth[g]
                better = np.flatnonzero(with_it > now[size:] + 1e-12)
                now[size + better], pick[size + better] = with_it[better], g
        picks.append(pick)
        best = now
    room, out = capacity, np.zeros(len(sizes))
    for pick in reversed(picks):
        if (g := int(pick[room])) >= 0:
            out[g] += 1
            room -= sizes[g]
    return out


def _programme(groups: list[dict], capacity: int, rounds: int = 4000) -> list[tuple[list[int], int]]:
    """Configurations and whole numbers of times, from the linear programme; they take no more than there is."""
    m = len(groups)
    if not m:
        return []
    sizes, need = [g["size"] for g in groups], np.array([g["n"] for g in groups], float)
    each = np.array([capacity // s for s in sizes], float)
    basis, inverse, times = np.diag(each), np.diag(1 / each), need / each
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        new = _richest(sizes, worth, capacity)
        if worth @ new <= 1 + 1e-7:
            break
        step = inverse @ new
        able = np.flatnonzero(step > 1e-9)
        out = int(able[np.argmin(times[able] / step[able])])
        gain = times[out] / step[out]
        times -= gain * step
        times[out] = gain
        inverse[out] /= step[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(step[rest], inverse[out])
        basis[:, out] = new
    found, left = [], need.copy()
    for k in range(m):
        pattern = basis[:, k]
        used = pattern > 0
        n = int(min(np.floor(times[k] + 1e-6), (left[used] // pattern[used]).min()))
        if n > 0:
            left -= n * pattern
            found.append(([g for g in range(m) for _ in range(int(pattern[g]))], n))
    return found


def _configurations(groups: list[dict], capacity: int) -> list[tuple[list[int], int]]:
    out, lead = _programme(groups, capacity), 0
    left = [g["n"] for g in groups]
    for slots, times in out:
        for g in slots:
            left[g] -= times
    while lead < len(groups):
        if not left[lead]:
            lead += 1
            continue
        slots = sorted([lead, *_complete(groups, left, lead, capacity - groups[lead]["size"])])
        used = {g: slots.count(g) for g in set(slots)}
        for g in list(used):
            while used[g] > left[g]:  # a slot chain may pass a group more often than it has pieces
                slots.remove(g)
                used[g] -= 1
        times = min(left[g] // k for g, k in used.items() if k)
        for g, k in used.items():
            left[g] -= times * k
        out.append((slots, times))
    return out


def _substitute(groups: list[dict], configs: list[tuple[list[int], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Actual lengths for the slots: (lengths, number of sequences) runs."""
    queue = [[list(x) for x in g["items"]][::-1] for g in groups]
    out = []
    for slots, times in configs:
        runs = []
        for g in slots:
            need, mine = times, []
            while need:
                length, have = queue[g][-1]
                take = min(need, have)
                mine.append((length, take))
                need -= take
                if take == have:
                    queue[g].pop()
                else:
                    queue[g][-1][1] -= take
            runs.append(mine)
        at = [0] * len(runs)
        rest = [r[0][1] for r in runs]
        done = 0
        while done < times:
            step = min(rest)
            out.append((tuple(r[i][0] for r, i in zip(runs, at)), step))
            done += step
            for k in range(len(runs)):
                rest[k] -= step
                if not rest[k] and done < times:
                    at[k] += 1
                    rest[k] = runs[k][at[k]][1]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Intervals (length, lo, hi, first sequence, offset), sorted by length and lo."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    large = {x: n for x, n in histogram.items() if capacity * LARGE < x < capacity and n}
    small = {x: n for x, n in histogram.items() if x <= capacity * LARGE and n}
    grouped = _groups(large, groups)
    runs = _substitute(grouped, _configurations(grouped, capacity))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in runs:
        open_.setdefault(capacity - sum(lengths), []).append((lengths, n))
    rooms = sorted(open_)
    for length in sorted(small, reverse=True):
        todo = small[length]
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                whole, rest = divmod(todo, fit)
                for k, n in ((fit, whole), (rest, 1 if rest else 0)):
                    if n:
                        room = capacity - k * length
                        if room not in open_:
                            bisect.insort(rooms, room)
                        open_.setdefault(room, []).append(((length,) * k, n))
                break
            room = rooms[i]
            lengths, n = open_[room].pop()
            take = min(todo, n)
            todo -= take
            if take < n:
                open_[room].append((lengths, n - take))
            if not open_[room]:
                del open_[room]
                del rooms[i]
            if room - length not in open_:
                bisect.insort(rooms, room - length)
            open_.setdefault(room - length, []).append(((*lengths, length), take))
    rank: dict[int, int] = {}
    out, sequence = [], 0
    full = histogram.get(capacity, 0)
    for lengths, n in [*([((capacity,), full)] if full else []), *[x for room in rooms for x in open_[room]]]:
        offset = 0
        for length in lengths:
            lo = rank.get(length, 0)
            out.append((length, lo, lo + n, sequence, offset))
            rank[length] = lo + n
            offset += length
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    # the number of runs follows the number of distinct lengths, never that of pieces
    if len(table) > 256 * capacity:
        raise RuntimeError(f"the plan has {len(table)} intervals")
    return table


# ---------------------------------------------------------------- pieces


@functools.cache
def encoder(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def _pieces(text_at: int, path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            rest = pa.RecordBatch.from_arrays([x for i, x in enumerate(batch.columns) if i != text_at], names=[x for i, x in enumerate(batch.schema.names) if i != text_at])
            for lo, hi, data, at in c.blocks(batch.column(text_at)):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, mine in enumerate(bpe.encode_block(data, at)):
                    mine = np.append(mine, END).astype("<u4")
                    for k in range(0, len(mine), capacity):
                        part = mine[k : k + capacity]
                        row.append(r)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part)
                more = {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}
                yield c.with_arrays(rest.slice(lo, hi - lo).take(pa.array(row, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), **more)

    return run


def _placed(table: np.ndarray, at: int):
    """Adds sequence_id and offset to rows whose length and rank stand in columns at, at + 1."""
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(at + 1).to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            keep = [j for j in range(batch.num_columns) if j not in (at, at + 1)]
            rest = pa.RecordBatch.from_arrays([batch.column(j) for j in keep], names=[batch.schema.names[j] for j in keep])
            yield c.with_arrays(rest, sequence_id=pa.array(table[i, 3] + rank - table[i, 1]), offset=pa.array(table[i, 4]))

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece with the end token alone. Repeated rows
    and rows without an id are packed like any other. Other columns are
    ignored; an empty table gives none. Only documents of more than `capacity`
    tokens are cut. Sequences are filled without gaps from offset 0.
    """
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = c.schema_of(slim.select("_id"), *fields)
    pieces = c.spool(slim.mapInArrow(_pieces(1, path or tokenizer_path(), capacity, with_ids), schema), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = plan(histogram, capacity)
    buckets = max(8, math.ceil(sum(histogram.values()) / BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("_row", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
    out = ranked.select(*pieces.columns, F.col("length").alias("_l"), (F.col("_row") - 1 + F.col("_before")).cast("bigint").alias("_r"))
    done = out.mapInArrow(_placed(table, len(pieces.columns)), c.schema_of(pieces, ("sequence_id", T.LongType()), ("offset", T.LongType())))
    return done.withColumnRenamed("_id", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    """The op6 query over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
