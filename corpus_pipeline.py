"""A training corpus in five stages; each is written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of documents. Rows without an id
and unlike texts that share an id are documents like any other; the
near-duplicate stage keeps one row of each group, ids first. Texts, ties,
repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import _common as c
from schemaloom.llm import langid, mixing, near_copies, packing, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose n-grams are less like every learned language than this are rejected. Ordinary texts of learned
#: languages score 0.4 and more, single repeated words and four-word texts among them; random letters and
#: languages that were not learned mostly under 0.33.
LEAST_SCORE = 0.35

#: SQL cannot express language profiles, SimHash or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages; `und` and unlike ones go."""
    found = langid.identify(docs.select(*COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8 or more).

    The one with the smallest id stays, of rows that share it the one with the
    least hash; a row without an id stays only where no row of its component
    has one. Equal rows are one.
    """
    docs = near_copies.with_row(docs.select(*COLUMNS))
    kept = c.spool(near_copies.kept_rows(docs).select(*near_copies.ROW), "kept-rows")
    return docs.join(kept, near_copies.ROW, "left_semi").dropDuplicates(near_copies.ROW).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; a document left with nothing goes."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.where(~changed | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the curriculum takes, once for each pass, in training order.

    The document in which a source's demand ends is cut after its last word taken.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs.select("doc_id", "source", "text", key.alias("_key")))
    first = F.when(F.col("position").isNotNull(), F.struct("position", F.least("taken", "size").alias("words")))
    second = F.when(F.col("position_again").isNotNull(), F.struct(F.col("position_again").alias("position"), (F.col("taken") - F.col("size")).alias("words")))
    passes = F.filter(F.array(first, second), lambda p: p.isNotNull())
    taken = mixed.select("doc_id", "_key", "size", F.explode(passes).alias("p")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "size", "p.*")
    texts = docs.withColumn("_key", key).dropDuplicates(["doc_id", "_key"])
    joined = texts.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    cut = F.col("words") < F.col("size")
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(c.WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    ordered = joined.withColumn("text", F.when(cut, short).otherwise(F.col("text"))).withColumn("n_chars", F.when(cut, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return ordered.repartitionByRange(F.col("position")).sortWithinPartitions("position").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("curriculum_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with c.spools_of_a_step(spark) as keep:
            docs = c.spool(stage(spark, before, sf_dir), f"stage-{name}")
            keep.append(docs._loom_path)
        c.drop_spool(before)
    return docs
