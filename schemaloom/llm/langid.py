"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to 3 code points,
lower case, blanks at word ends) in order of frequency. A document's profile is
held against each language's: an n-gram costs the difference of its two ranks,
or the profile length if the language lacks it. The language with the smallest
sum wins.

Language profiles are counted over a bounded, documented sample of the labelled
documents: SAMPLE documents of each language, those whose hashed ids are
smallest, with their whole texts (rows of one id count once each). Predictions read every whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

SAMPLE, LANGUAGE_GRAMS, DOCUMENT_GRAMS = 1000, 400, 300
UNKNOWN = "und"
MOST_LANGUAGES = 1000
#: Bits of a code point in an n-gram; no letter lies beyond.
BITS = 18
ADDED = ("held_out", "lang_pred", "score")


@functools.cache
def _letters() -> np.ndarray:
    """Code point to its lower-case one, 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for p in range(1 << BITS):
        if not 0xD800 <= p < 0xE000 and (ch := chr(p)).isalpha():
            out[p] = ord(ch.lower()[0])
    return out


def gram_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, n-grams and counts of a block, sorted by row and n-gram; and which rows have a letter.

    An n-gram holds its length above its (up to three) code points of BITS bits
    each, a blank counting as 0. To be sorted together with the row, the letters
    of a block are numbered in order of their code points.
    """
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    first = heads[at]
    letter = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    rows = len(at) - 1
    used = np.zeros(1 << BITS, bool)
    used[letter] = True
    used[0] = True  # the blank
    code = np.flatnonzero(used).astype(np.uint64)
    bits = max(1, int(len(code) - 1).bit_length())
    if 2 + 3 * bits + int(rows).bit_length() > 63 and rows > 1:  # more letters than fit beside the rows: half of the rows at a time
        parts = [(0, rows // 2), (rows // 2, rows)]
        parts = [(lo, gram_counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) for lo, hi in parts]
        return tuple(np.concatenate([x[i] + lo if i == 0 else x[i] for lo, x in parts]) for i in range(4))
    number = np.zeros(1 << BITS, np.uint64)
    number[used] = np.arange(len(code), dtype=np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    keep = letter > 0
    # one blank before each word and after it: words are runs of letters in a row
    start = keep.copy()
    start[1:] &= ~(keep[:-1] & (row[1:] == row[:-1]))
    spots = np.flatnonzero(keep)
    if not len(spots):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, bool)
    opens = start[spots]
    place = np.arange(len(spots)) + np.cumsum(opens)
    x = np.zeros(int(place[-1]) + 2, np.uint64)
    x[place] = number[letter[spots]]
    r = np.zeros(len(x), np.uint64)
    r[place] = row[spots]
    r[place[opens] - 1] = row[spots[opens]]  # a blank counts to the row of the word that follows
    s = np.uint64(bits)
    size, top = s * np.uint64(3), s * np.uint64(3) + np.uint64(2)
    one = (r[place] << top) | x[place] | (np.uint64(1) << size)
    left = np.concatenate((place[opens] - 1, place))  # begins with a blank or a letter
    two = (r[left] << top) | (x[left] << s) | x[left + 1] | (np.uint64(2) << size)
    # three: blank and two letters, or letters with an end or a letter; the middle is no blank
    mid = left[(x[left + 1] > 0) & (left + 2 < len(x))]
    three = (r[mid] << top) | (x[mid] << (s + s)) | (x[mid + 1] << s) | x[mid + 2] | (np.uint64(3) << size)
    mask = (np.uint64(1) << s) - np.uint64(1)
    every = np.sort(np.concatenate((one, two[two & mask > 0], three)))
    edge = np.concatenate(([0], np.flatnonzero(every[1:] != every[:-1]) + 1, [len(every)]))
    keys = every[edge[:-1]]
    has = np.zeros(rows, bool)
    has[row[spots]] = True
    wide = np.uint64(BITS)
    grams = ((keys >> size) & np.uint64(3)) << (wide * np.uint64(3))
    for i in (2, 1, 0):
        grams |= code[(keys >> (s * np.uint64(i))) & mask] << (wide * np.uint64(i))
    return (keys >> top).astype(np.int64), grams, np.diff(edge), has


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial counts of n-grams by language."""
    for batch in batches:
        langs = batch.column(0)
        for lo, _, data, at in c.blocks(batch.column(1), c.SMALL_BLOCK):
            row, gram, count, _ = gram_counts(data, at)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(row + lo)), pa.array(gram.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their n-grams (sorted), and ranks (n-gram by language; the profile length where absent)."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"))
    # a hash test leaves about twice the sample of each language, so no task ranks all rows of one
    share = labelled.groupBy("lang").agg((F.lit(2.0 * sample + 100) / F.count(F.lit(1))).alias("share"))
    share = share.limit(MOST_LANGUAGES + 1).collect()
    if len(share) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; no more profiles are kept by the driver")
    share = df.sparkSession.createDataFrame(share, "lang string, share double")
    # this table has MOST_LANGUAGES rows at most, the next one `sample` rows for each of them
    labelled = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    turn = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id")
    chosen = labelled.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= sample).select("_id", "lang")
    chosen = F.broadcast(chosen.distinct())
    texts = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(chosen, (texts["_id"].eqNullSafe(chosen["_id"])) & (texts["lang"] == chosen["lang"]), "left_semi").select("lang", "_text")
    counts = texts.mapInArrow(_sample_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LANGUAGE_GRAMS).select("lang", "gram", "rank").collect()
    langs = sorted({r[0] for r in top})
    grams = np.array(sorted({r[1] for r in top}), np.uint64)
    ranks = np.full((len(grams) + 1, len(langs)), LANGUAGE_GRAMS, np.int64)
    for lang, gram, rank in top:
        ranks[np.searchsorted(grams, np.uint64(gram)), langs.index(lang)] = rank - 1
    return langs, grams, ranks


def distances(model: tuple[list[str], np.ndarray, np.ndarray], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Out-of-place distance by row and language, the n-grams compared by row, and which rows have a letter."""
    langs, grams, ranks = model
    row, gram, count, has = gram_counts(data, at)
    rows = len(at) - 1
    if not len(row) or not langs:
        return np.zeros((rows, len(langs)), np.int64), np.zeros(rows, np.int64), has
    most = int(count.max()) + 1
    order = np.argsort(row * most - count, kind="stable")  # by row, then by falling count, then by n-gram
    row, gram = row[order], gram[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    rank = np.arange(len(row)) - first[row]
    top = rank < DOCUMENT_GRAMS
    row, gram, rank = row[top], gram[top], rank[top]
    at_ = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    at_ = np.where(grams[at_] == gram, at_, len(grams))
    other = ranks[at_]
    cost = np.where(other == LANGUAGE_GRAMS, LANGUAGE_GRAMS, np.abs(other - rank[:, None]))
    out = np.stack([np.bincount(row, weights=cost[:, k], minlength=rows) for k in range(len(langs))], axis=1)
    return out.astype(np.int64), np.bincount(row, minlength=rows), has


def _predict(text_at: int, model):
    langs = model[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for lo, hi, data, at in c.blocks(batch.column(text_at), c.SMALL_BLOCK):
                cost, n, has = distances(model, data, at)
                if not langs:
                    pred += [UNKNOWN] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                best = cost.argmin(axis=1)  # ties: the first language by code point
                share = 1 - cost[np.arange(hi - lo), best] / np.maximum(1, n * LANGUAGE_GRAMS)
                pred += [langs[b] if h else UNKNOWN for b, h in zip(best, has)]
                score += [float(x) if h else 0.0 for x, h in zip(share, has)]
            yield c.with_arrays(batch, lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()))

    return run


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """df's columns with held_out, lang_pred and score (0 to 1: one less the mean cost of an n-gram).

    lang_pred is `und`, with score 0, where the text is null or has no letter,
    and everywhere if no labelled document can be learned from. A null id is
    not held out. Input columns with the added names are replaced; an empty
    table gives an empty table. Equal distances go to the first language by
    code point.
    """
    model = learn(df, id_col, text_col, lang_col, sample)
    df = c.without(df, *ADDED)
    df = df.withColumn(text_col, F.col(text_col).cast("string")).withColumn("held_out", held_out(F.col(id_col)))
    schema = c.schema_of(df, ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    return df.mapInArrow(_predict(df.columns.index(text_col), model), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """The op8 query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
