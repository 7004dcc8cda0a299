"""Substring dedup by seed and extend.

Goal: a word goes if it is covered by a window of `length` consecutive words
that also starts in a document with a smaller id. All windows are judged on
the input.

1. Seeds. Every window of `length` words picks one anchor by winnowing: the
   leftmost smallest hash among its word k-grams (k + w - 1 = length). Equal
   windows pick the same anchor at the same place, so windows need only be
   compared below a common anchor. Consecutive windows that pick the same
   anchor form one segment: the anchor extended to the left and right as far
   as it stays their seed. There are about 2 / (w + 1) segments a word.
2. Join on anchors. (anchor, segment hash) is aggregated to its smallest
   document before anything is joined, so a passage that a third of all
   documents share is one row per task. A segment that equals one of a smaller
   document goes whole. Only the first document of each distinct segment,
   below anchors that have several, needs more.
3. Extend. Those documents send the windows of such segments; the smallest
   document of each window decides how far the match reaches.
4. The overlapping removed windows of a document merge to its maximal repeats.

Segments and windows are compared by 128-bit hashes. Every step is a grouped
minimum or a join with one row per key on one side, which adaptive execution
can split on the other side; no step gathers a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

ID, KEY = "_doc", "_key"


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the leftmost smallest of the next `width` values (by doubling)."""
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(values[left] <= values[right], left, right)
        span *= 2
    if span < width:
        left, right = best[: len(best) - (width - span)], best[width - span :]
        best = np.where(values[left] <= values[right], left, right)
    return best


def segments(data: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The segments of a block: row, anchor, s1, s2, start (word of the row), n (windows)."""
    starts, ends, first = c.words_of(data, at)
    total, k = len(starts), max(1, length // 3)
    per_row = np.diff(first)
    windows = np.maximum(per_row - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return {"row": none, "anchor": none, "s1": none, "s2": none, "start": none, "n": none}
    sums = [c.run_sums(c.word_hashes(data, starts, ends, i), i) for i in (0, 1)]
    grams = np.arange(total - k + 1)
    value = c.run_hash(sums[0], grams, grams + k, 0)
    pick = _leftmost_minimum(value, length - k + 1)
    row = np.repeat(np.arange(len(per_row)), windows)
    begin = np.cumsum(windows) - windows
    place = np.arange(int(windows.sum())) - np.repeat(begin, windows)
    window = place + np.repeat(first[:-1], windows)
    anchor = pick[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(window)))
    a, b = window[lead], window[lead] + n - 1 + length
    # the place of the anchor is part of the key: it fixes which windows the segment stands for
    s = [c.run_hash(sums[i], a, b, i) ^ c.mix((anchor[lead] - a).astype(np.uint64) + np.uint64(i)) for i in (0, 1)]
    return {"row": row[lead], "anchor": value[anchor[lead]].view(np.int64), "s1": s[0].view(np.int64), "s2": s[1].view(np.int64), "start": place[lead], "n": n}


def _segment_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, _, data, at in c.blocks(batch.column(2)):
                s = segments(data, at, length)
                if len(s["row"]):
                    rows = pa.array(s["row"] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), keys.take(rows), *(pa.array(s[x]) for x in ("anchor", "s1", "s2")), *(pa.array(s[x].astype(np.int32)) for x in ("start", "n"))],
                        names=[ID, KEY, "anchor", "s1", "s2", "start", "n"],
                    )

    return run


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, runs = batch.column(0), batch.column(1), batch.column(3)
            for lo, hi, data, at in c.blocks(batch.column(2)):
                starts, ends, first = c.words_of(data, at)
                sums = [c.run_sums(c.word_hashes(data, starts, ends, i), i) for i in (0, 1)]
                mine = runs.slice(lo, hi - lo)
                flat = mine.flatten()
                row = np.repeat(np.arange(hi - lo), np.diff(mine.offsets.to_numpy()))
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                which = np.repeat(np.arange(len(n)), n)
                place = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                window = place + first[row[which]]
                rows = pa.array(row[which] + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), keys.take(rows), *(pa.array(c.run_hash(sums[i], window, window + length, i).view(np.int64)) for i in (0, 1)), pa.array(place.astype(np.int32))],
                    names=[ID, KEY, "w1", "w2", "start"],
                )

    return run


def kept_words(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The words outside the runs (first word, number of words), joined by one space; words, removed words."""
    words = text.split()
    if not gone:
        return b" ".join(words), len(words), 0
    keep = np.ones(len(words) + 1, np.int64)
    edge = np.zeros(len(words) + 2, np.int64)
    for start, n in gone:
        edge[start] += 1
        edge[min(start + n, len(words))] -= 1
    keep = np.cumsum(edge)[: len(words)] == 0
    left = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(left), len(words), len(words) - len(left)


def _finish(text_at: int, runs_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(text_at), batch.column(runs_at)
            step = 256
            for lo in range(0, batch.num_rows, step):
                raw, at = c.utf8(texts.slice(lo, step))
                view = raw.tobytes() if len(raw) and at[0] == 0 and at[-1] == len(raw) else raw[at[0] : at[-1]].tobytes()
                at = at - at[0]
                kept, n, removed = [], [], []
                for i, gone in enumerate(runs.slice(lo, step).to_pylist()):
                    k, words, less = kept_words(view[at[i] : at[i + 1]], [(g["start"], g["len"]) for g in gone or ()])
                    kept.append(k)
                    n.append(words)
                    removed.append(less)
                rest = batch.slice(lo, step)
                rest = pa.RecordBatch.from_arrays([x for i, x in enumerate(rest.columns) if i != runs_at], names=[x for i, x in enumerate(rest.schema.names) if i != runs_at])
                yield c.with_arrays(rest, n_words=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept_text=pa.array(kept, pa.binary()).cast(pa.string()))

    return run


def repeated_runs(docs: DataFrame, length: int = 50) -> DataFrame:
    """The removed runs (_doc, _key, start, len in words) of docs (_doc, _key, _text). They may overlap."""
    spark = docs.sparkSession
    rows = "_doc bigint, _key bigint, "
    found = c.spool(docs.mapInArrow(_segment_rows(length), rows + "anchor bigint, s1 bigint, s2 bigint, start int, n int"), "segments")
    distinct = found.groupBy("anchor", "s1", "s2").agg(F.min(ID).alias("least"), F.max(ID).alias("most"))
    distinct = c.spool(distinct, "distinct-segments")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("anchor", F.lit(True).alias("several"))
    useful = distinct.join(several, "anchor", "left").where("least < most or several").select("anchor", "s1", "s2", "least", F.coalesce("several", F.lit(False)).alias("several"))
    hits = found.join(useful, ["anchor", "s1", "s2"]).where("_doc > least or several")
    hits = c.spool(hits.select(ID, KEY, "start", "n", (F.col(ID) > F.col("least")).alias("whole")), "seed-hits")
    whole = hits.where("whole").select(ID, KEY, "start", (F.col("n") + (length - 1)).alias("len"))

    # sets: rows that repeat a document give its runs once, not once for each of them
    extend = hits.where("not whole").groupBy(ID, KEY).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = docs.join(extend, [ID, KEY]).select(ID, KEY, "_text", "runs").mapInArrow(_window_rows(length), rows + "w1 bigint, w2 bigint, start int")
    windows = c.spool(windows, "windows")
    first = windows.groupBy("w1", "w2").agg(F.min(ID).alias("least"), F.max(ID).alias("most")).where("least < most").drop("most")
    partly = windows.join(first, ["w1", "w2"]).where("_doc > least").select(ID, KEY, "start", F.lit(length).alias("len"))
    out = c.spool(whole.unionByName(partly), "repeats")
    c.drop_spool(found, distinct, hits, windows)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove repeated passages; returns df's columns with n_words, n_removed and kept_text.

    Input columns named like one of these three are replaced. A null text has
    no words (kept_text is empty). A row without an id is left as it is and
    takes nothing from others. Rows with equal ids are no smaller than each
    other, so they take nothing from each other; a document shorter than
    `length` words has no window. Empty tables give empty tables.
    """
    df = c.without(df, "n_words", "n_removed", "kept_text", ID, KEY, "_runs")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(ID), key.alias(KEY), F.col(text_col).cast("string").alias("_text"))
    # a document's runs together hold at most a few entries a word, as the document itself does
    runs = repeated_runs(docs, length).groupBy(ID, KEY).agg(F.collect_set(F.struct("start", "len")).alias("_runs"))
    joined = df.withColumns({ID: F.col(id_col).cast("bigint"), KEY: key}).join(runs, [ID, KEY], "left").select(*df.columns, "_runs")
    schema = c.schema_of(df, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    return joined.mapInArrow(_finish(df.columns.index(text_col), len(df.columns)), schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """The op1 query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select rowid_ as r, doc_id, w, len(w) as n from (
             select row_number() over () as rowid_, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
 win as (select r, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) as h
         from (select r, doc_id, w, unnest(range(1, n - 48)) as i from d where n >= 50)),
 least_ as (select h, min(doc_id) as m from win group by h),
 hit as (select r, i from win join least_ using (h) where doc_id > m),
 gone as (select distinct r, i + k as p from hit, (select unnest(range(0, 50)) as k)),
 word as (select r, unnest(range(1, n + 1)) as p, unnest(w) as t from d),
 kept as (select word.r, string_agg(t, ' ' order by word.p) as k, count(*) as c from word anti join gone on word.r = gone.r and word.p = gone.p group by word.r)
select d.doc_id, cast(d.n as bigint) as n_words, cast(d.n - coalesce(c, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""
