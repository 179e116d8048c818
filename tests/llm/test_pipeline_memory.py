"""What the pipeline's stages leave in an executor: size of batches, workers of another kind, memory of the words."""

import tracemalloc

import pyarrow as pa

from tillroll.llm import mixing
from tillroll.llm.common import BATCH_BYTES, BATCH_SETTING, SPACE_WORDS, text_bytes, word_counts

SCHEMA = "doc_id long, text string, lang string, source string"


def test_stages_send_small_batches_and_run_restores_the_setting(spark, scratch, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some plain words", "en", None), (None, None, None, "s")], SCHEMA)
    docs.write.parquet(f"{scratch}/documents.parquet")
    docs.selectExpr("'i' as item_id", "text").limit(0).write.parquet(f"{scratch}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{scratch}/documents.parquet"), spark.conf.get(BATCH_SETTING, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            for size, want in ((None, BATCH_BYTES // 4), (BATCH_BYTES, BATCH_BYTES // 4), (12_345_678, 12_345_678)):
                spark.conf.unset(BATCH_SETTING) if size is None else spark.conf.set(BATCH_SETTING, str(size))
                stage(spark, docs, scratch)
                assert spark.conf.get(BATCH_SETTING) == str(want)
        seen = []
        monkeypatch.setattr(corpus_pipeline, "STAGES", [
            ("sees", lambda s, d, _: corpus_pipeline.small_batches(s) or seen.append(s.conf.get(BATCH_SETTING)) or d)])
        spark.conf.unset(BATCH_SETTING)
        assert corpus_pipeline.run(spark, scratch).count() == 2
        assert seen == [str(corpus_pipeline.STAGE_BYTES)] and spark.conf.get(BATCH_SETTING, None) is None
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def test_sources_of_the_mixture_need_no_python_workers(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), "en", [None, "a", "b"][i % 3]) for i in range(60)], SCHEMA)
    small = mixing.plan(mixing.with_sizes(docs, [], "doc_id", "text", "source")).small
    assert "ExistingRDD" not in small._jdf.queryExecution().toString()
    assert [(r["k_"], r["src_"]) for r in small.collect()] == [(0, "a"), (1, "b"), (2, None)]
    assert [c for c, _ in small.dtypes] == ["k_", "src_", "source_size", "target", "whole", "rest", "n_blocks"]
    none = mixing.plan(mixing.with_sizes(docs.limit(0), [], "doc_id", "text", "source")).small
    assert none.count() == 0


def test_words_of_many_texts_take_few_bytes_at_a_time():
    offsets, data = text_bytes(pa.array([("x" * 999 + " ") * 1_000] * 4))
    tracemalloc.start()
    try:
        assert word_counts(offsets, data, SPACE_WORDS).tolist() == [1_000] * 4
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
        from tillroll.llm.common import words

        assert len(words(offsets, data, SPACE_WORDS).hashes) == 4_000
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
