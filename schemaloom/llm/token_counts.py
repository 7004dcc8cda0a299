"""Token counts by prefix dynamic programming.

wordbpe.PrefixCounts stores the exact token count of every prefix of a text.
One pass then answers how many tokens a text has, where to cut it for a limit,
and whether any part from the start fits a budget, without encoding again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as c
from .wordbpe import PrefixCounts

LIMIT = 2048


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def prefix_counter(path: str) -> PrefixCounts:
    """One per Python worker; its memory of pre-tokens stays between batches."""
    return PrefixCounts(path)


def longest_prefix(counts: np.ndarray, limit: int) -> int:
    """The most code points from the start that have `limit` tokens or fewer; counts need not rise steadily."""
    return int(np.flatnonzero(counts <= limit)[-1])


def _count(text_at: int, path: str, limit: int, store: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for lo, hi, data, at in c.blocks(batch.column(text_at)):
                rows = counter.prefix_block(data, at)
                part = batch.slice(lo, hi - lo)
                part = pa.RecordBatch.from_arrays([x for i, x in enumerate(part.columns) if i != text_at], names=[x for i, x in enumerate(part.schema.names) if i != text_at])
                n = [int(r[-1]) for r in rows]
                more = {"prefix_counts": pa.array(rows, pa.list_(pa.int64()))} if store else {}
                yield c.with_arrays(part, n_bytes=pa.array(np.diff(at)), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n]), keep_chars=pa.array([longest_prefix(r, limit) for r in rows], pa.int64()), **more)

    return run


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None, limit: int = LIMIT, store: bool = False) -> DataFrame:
    """df's columns without the text, with n_bytes, n_tokens, over_limit and keep_chars (and prefix_counts).

    keep_chars is the most code points from the start that fit the limit;
    prefix_counts (if store) holds the tokens of the first 0, 1, 2, ... code
    points. A null text counts as empty: 0 tokens. Input columns with the added
    names are replaced. Rows are independent, so ties and repeated rows need
    nothing, and an empty table gives an empty table.
    """
    added = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("keep_chars", T.LongType())] + [("prefix_counts", T.ArrayType(T.LongType()))] * store
    df = c.without(df, *[n for n, _ in added])
    df = df.withColumn(text_col, df[text_col].cast("string"))
    at = df.columns.index(text_col)
    schema = T.StructType([f for i, f in enumerate(c.schema_of(df, *added).fields) if i != at])
    return df.mapInArrow(_count(at, path or tokenizer_path(), limit, store), schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """The op10 query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars")
