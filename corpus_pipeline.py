"""Corpus pipeline: language, near duplicates, decontamination, mixing, token store.

Each stage takes the documents its predecessor kept and returns documents
(the last one returns the token store's index). ``run`` writes every stage
as Parquet in the shared folder and reads it again. Every stage takes an
empty table, null and empty texts, repeated rows and null ids; each says
below what becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, language_id, mixing, ngram_join, token_store
from tillroll.llm.common import BATCH_BYTES, BATCH_SETTING, PIECE, fold, table
from tillroll.llm.queries import END_ID, TOKENIZER, shared_folder

# A text whose best language has less than this mean probability is no text of a known language.
LANGUAGE_AT = 0.4

# Token pieces that a worker keeps a generation: workers are shared with the other stages, so fewer than the default.
PIECES = 30_000

# Bytes of a batch sent to Python: an executor keeps the buffers of the largest, and each stage leaves some there.
STAGE_BYTES = PIECE

# Near copies share four fifths of their five-word shingles; the width and threshold of op1's contract bind op1 alone.
NEAR = ngram_join.JoinSpec(k=5, num=80, den=100)


def small_batches(spark: SparkSession) -> None:
    """Smaller batches than an operator sets by itself, unless the session names another size."""
    if spark.conf.get(BATCH_SETTING, None) in (None, str(BATCH_BYTES)):
        spark.conf.set(BATCH_SETTING, str(STAGE_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts of no known language.

    Null and empty texts go; repeated rows and null ids are kept as their
    text says; an empty table, or one without languages to learn, leaves none.
    """
    small_batches(spark)
    net = language_id.train(docs.where(fold() != 2))
    scored = language_id.predict(docs, net, docs.columns)
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_AT)).select("row_.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id (then text hash) of each group of near copies; a repeated row stays once.

    Null and empty texts and rows without id stay; an empty table stays empty.
    """
    small_batches(spark)
    return ngram_join.drop_copies(docs, spec=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; an empty benchmark drops nothing.
    """
    small_batches(spark)
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(F.size("spans_") == 0).select("row_.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights; shards are shuffled.

    Null and empty texts have no words and are not taken; rows without a
    source are a source of their own; an empty table gives an empty mixture.
    """
    small_batches(spark)
    return mixing.mix(docs).select("row_.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store; its index, read back from the files.

    Null and empty texts are just the end id; repeated rows are documents of
    their own; null ids come first; an empty table gives an empty index.
    """
    small_batches(spark)
    path = shared_folder(spark, "tokens")
    token_store.write_store(docs, path, public_tokenizers.path(TOKENIZER), END_ID, pieces=PIECES)
    return token_store.read_documents(spark, path)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

# SQL expresses neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        for name, stage in STAGES:
            path = shared_folder(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:        # other queries of the session have their own size
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)
    return docs
