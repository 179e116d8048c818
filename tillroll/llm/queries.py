"""The operators applied to the given tables: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (alignment, ann, decontaminate, html_extract, language_id, license_scan, mixing, ngram_join,
                          packing, pii, resample, token_store, toxicity)
from tillroll.llm.common import PIECE, fold, table
from tillroll.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
TOXIC_AT = 0.3


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(fold() != 2))
    return language_id.predict(docs, net, ["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"), (fold("row_.doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.train(docs))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train(pages))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold() != 2)
    picked = F.broadcast(toxicity.sample_labels(labels))
    model = toxicity.train(docs.select("doc_id", "text").join(picked, "doc_id"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold() == 2).alias("held_out"), "score",
        F.when(F.col("score") >= TOXIC_AT, 1).otherwise(0).alias("predicted"), "n_sentences", "offences")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.report(found).select(
        F.col("row_.doc_id").alias("doc_id"), F.col("n_words_").alias("n_words"), "n_hit", "n_items",
        "items_sha256", "contaminated")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"), F.col("size_").alias("size"), "source_size", "target", "taken")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID,
                            together=4 * PIECE)
    return token_store.read_documents(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = alignment.AlignSpec(public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))
    tokens = alignment.encode(table(spark, sf_dir, "documents"), spec, ["doc_id"])
    return alignment.report(tokens, spec).select(F.col("row_.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups",
                                                 "n_links", "n_best", "count_sum", "groups_sha256")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = resample.ResampleSpec()
    docs = table(spark, sf_dir, "documents")
    gain = resample.gains(resample.bucket_counts(docs, spec),
                          resample.bucket_counts(table(spark, sf_dir, "benchmark"), spec))
    return resample.resample(resample.weigh(docs, gain, spec, ["doc_id"]), spec).select(
        F.col("row_.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = packing.PackSpec(public_tokenizers.path(WORD_TOKENIZER))
    return packing.pack(table(spark, sf_dir, "documents"), spec, ["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_pii, op4_html_extract, op5_toxicity, op6_ann,
                                    op7_decontaminate, op8_license_scan, op9_mixing, op10_token_store,
                                    op11_token_alignment, op12_resample, op13_packing)}
