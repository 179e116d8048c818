"""Corpus operators as Spark jobs: edge cases, brute force, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import ann, decontaminate, language_id, license_scan, mixing, ngram_join, pii, token_store, toxicity
from tillroll.llm.common import fold, table
from tillroll.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ string, h_ string, spans_ string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns that clash with internal names."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None),
            (4, None, "en", "b"), (5, "", "en", "b"), (6, "  \n\t ", None, "b"), (7, "One two three", "en", None),
            (8, "one TWO three", "en", "a"), (None, base, "en", "a"), (9, "x" * 300_000 + " " + base, "en", "c"),
            (10, "12 34 !!", "en", "c")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "r", "h", "s") for r in rows], SCHEMA)


def empty(df):
    return df.limit(0)


def test_ngram_join(odd):
    got = {}
    for r in ngram_join.jaccard_components(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(117, 1)] and got[2] == [(117, 1)] * 2 and got[3] == [(118, 1)]
    assert got[4] == got[5][:0] + [(0, 4)] and got[6] == [(0, 6)]
    assert got[7] == [(1, 7)] and got[8] == [(1, 7)] and got[None][0][1] is None
    assert got[9] == [(118, 1)]
    assert ngram_join.jaccard_components(empty(odd)).count() == 0


def test_language(spark, odd):
    docs = table(spark, SF, "documents")
    net = language_id.train(docs.where(fold() != 2))
    held = language_id.predict(docs.where(fold() == 2), net, ["lang"]).select("row_.lang", "lang_pred")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.9 * held.count()
    got = {r["doc_id"]: r for r in language_id.predict(odd, net, ["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"), "lang_pred", "score").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert language_id.train(empty(odd)) is None
    assert language_id.predict(odd, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd):
    rows = [(i, ("nice day. " * 5 + ("you foolish goblin. " if i % 4 == 0 else "all is well. ")), int(i % 4 == 0), 1.0)
            for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int, weight double")
    model = toxicity.train(data.where("doc_id < 300"))
    got = toxicity.score(data.where("doc_id >= 300"), model).join(data, "doc_id").collect()
    assert all((r["score"] >= 0.3) == bool(r["toxic"]) for r in got)
    r = next(r for r in got if r["toxic"])
    assert ["goblin" in r["text"][s["start"]:s["end"]] for s in r["offences"]] == [True]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scores[4] == scores[5] == scores[6] == 0
    assert toxicity.score(empty(odd), toxicity.train(empty(data))).count() == 0


def test_pii_and_license(odd):
    assert pii.train(empty(odd)) is None
    model = pii.train(odd)
    assert pii.scan(odd, model).count() == odd.count()
    text = odd.where("doc_id = 7").withColumn("text", F.lit("Words.\nReleased under the MIT License.\nWords of licence."))
    spec = license_scan.LicenseSpec(copies=20, epochs=8)
    lic = license_scan.train(odd, spec=spec)
    r = license_scan.scan(text, lic).first()
    assert r["license"] == "MIT" and r["n_licensed"] == 1
    assert license_scan.scan(odd, lic).where("license is not null").count() == 0
    assert license_scan.scan(empty(odd), license_scan.train(empty(odd), spec=spec)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (1004, [None] * 8), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), ann.LshSpec(bucket_rows=40, part=16)).collect()
    hit = 0
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hit += len(set(want) & set(mine))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in got if r["query_id"] == q)
    assert hit >= 0.9 * 80 and not {r["vec_id"] for r in got} & {1000, 1001, 1002, 1003, 1004}
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 50), key=lambda r: r["rank"])][:9] == \
        list(range(51, 60))
    assert ann.nearest(empty(df), empty(df)).count() == 0


def recall(x, got, queries, k=10):
    """Share of the exact neighbours found; every query has k rows."""
    hit = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert len(mine) == k, q
        hit += sum(s <= np.sort(d)[k - 1] + 1e-9 for s in mine.values())
    return hit / (k * len(queries))


def test_nearest_of_isolated_queries(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 8))
    x[:3000] = x[0]                             # most rows are equal copies
    x[3000:3010] *= 40                          # far from all others and from each other
    x[3010:3400] = x[3010:3400] * 6             # a thin part
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = [0, 2999, *range(3000, 3010), *range(3010, 3400, 30), *range(3400, 4000, 40)]
    got = ann.nearest(df, df.where(F.col("vec_id").isin(queries)), ann.LshSpec(bucket_rows=40)).collect()
    assert recall(x, got, queries) >= 0.9


def test_nearest_with_many_dims_and_bucket_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6_000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = list(range(0, 6_000, 400))
    for block in (65_536, 500):
        spec = ann.LshSpec(bucket_rows=8, bucket_block=block, visits=1_500)
        assert ann.build_hasher(ann.clean_vectors(df), spec).dims >= 4
        assert recall(x, ann.nearest(df, df.where("vec_id % 400 = 0"), spec).collect(), queries) >= 0.9


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(7, " ".join(f"W{i}" for i in range(5, 17))), (8, "two three"), (None, "zzz"), (9, None)],
                                  "item_id long, text string")
    got = {}
    for spec in (decontaminate.SearchSpec(), decontaminate.SearchSpec(max_patterns=2)):    # one block, several blocks
        rows = decontaminate.report(decontaminate.find_contamination(odd, items, odd.columns, spec=spec)).collect()
        now = sorted(((r["row_"]["doc_id"] or -1, r["n_words_"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows))
        assert got.setdefault("rows", now) == now
    by = {r[0]: r for r in got["rows"]}
    assert by[1][1:4] == (120, 12, 1) and by[7][1:4] == (3, 2, 1) and by[4][1:4] == (0, 0, 0)
    none = decontaminate.find_contamination(odd, empty(items), ["doc_id"])
    assert none.where("size(spans_) > 0").count() == 0


def test_mixing(spark, odd):
    docs = table(spark, SF, "documents")
    rows = mixing.with_sizes(docs, ["doc_id"], "doc_id", "text", "source")
    got = mixing.plan(rows).copies(rows).withColumn("taken", F.col("size_") * F.col("copies"))
    # what a source misses is smaller than every document that could still be added
    per = got.groupBy("src_").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.min(
        F.when((F.col("copies") == F.col("whole")) & (F.col("size_") > 0), F.col("size_"))).alias("free"))
    assert all(-1 <= r["t"] - r["k"] < (r["free"] or 1) + 1 for r in per.collect())
    assert got.where("copies > 2").count() == 0
    mixed = mixing.mix(docs, mixing.MixSpec(shard_words=5000))
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("row_.doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in got.select("row_.doc_id", "copies").collect() if r["copies"]}
    assert mixed.select("shard_").distinct().count() > 3
    assert mixing.mix(odd).select("row_.*").columns == odd.columns
    assert mixing.mix(empty(odd)).count() == 0


def test_token_store(spark, odd, scratch):
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    token_store.write_store(odd, f"{scratch}/a", path)
    got = token_store.read_documents(spark, f"{scratch}/a").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert next(r for r in got if r["doc_id"] == 4)["n_tokens"] == 1
    token_store.write_store(empty(odd), f"{scratch}/b", path)
    assert token_store.read_documents(spark, f"{scratch}/b").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_against_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    texts = []
    for _ in range(6):
        base = [f"w{i}" for i in rng.integers(0, 9000, 400)]
        texts.append(base)
        for scattered in (2, 6, 8, 9, 12, 30):
            copy = list(base)
            for at in np.linspace(5, 390, scattered).astype(int):
                copy[at] = f"new{rng.integers(0, 10 ** 9)}"
            texts.append(copy)
        for passage in (20, 38, 60):
            texts.append(base[:100] + [f"p{i}" for i in rng.integers(0, 10 ** 9, passage)] + base[100 + passage:])
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    root, between = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            either = len(sets[a]) + len(sets[b]) - both
            between += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert between >= 6 and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_mixing_carries_the_rest_into_other_blocks(spark):
    rows = [(i, "w " * 400, "a") for i in range(640)] + [(640, "w " * 200_000, "a")]
    rows += [(1000 + i, "w " * (1 + i % 90), "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for seed in (11, 12):
        spec = mixing.MixSpec(weights=(15, 1), seed=seed)
        sized = mixing.with_sizes(docs, ["doc_id"], "doc_id", "text", "source")
        p = mixing.plan(sized, spec)
        got = p.copies(sized).select("row_.doc_id", "src_", "size_", "whole", "copies", "target").toPandas()
        assert max(s["n_blocks"] for s in p.sources) >= 5
        for _, g in got.groupby("src_"):
            miss = g["target"].iloc[0] - (g["size_"] * g["copies"]).sum()
            free = g["size_"][g["copies"] == g["whole"]]
            assert 0 <= miss < free.min() + 1, (seed, miss)
        dealt = mixing.mix(docs, spec).groupBy("row_.doc_id").count().toPandas()
        assert dict(zip(dealt["doc_id"], dealt["count"])) == \
            {d: c for d, c in zip(got["doc_id"], got["copies"]) if c}


def test_op9_counts_the_mixture(spark, odd, monkeypatch):
    from tillroll.llm import queries

    rows = mixing.with_sizes(table(spark, SF, "documents"), ["doc_id"], "doc_id", "text", "source")
    want = sorted((r["row_"]["doc_id"], r["size_"] * r["copies"]) for r in mixing.plan(rows).copies(rows).collect())
    assert sorted((r["doc_id"], r["taken"]) for r in queries.op9_mixing(spark, SF).collect()) == want
    assert mixing.taken(odd, odd.columns).select("row_.*").count() == odd.count()
    deal = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: deal(*a, **k).where("pmod(h_, 7) <> 0"))
    with pytest.raises(Exception, match="differs from its plan"):
        queries.op9_mixing(spark, SF).collect()


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    rows = [(1, text("a")), (5, text("a") + " more"), (5, text("b")), (6, text("c")), (6, text("c") + " more"),
            (7, text("c") + " end"), (8, text("d")), (8, text("d")), (9, None), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or " ")[0]) for r in kept) == \
        [(0, "a"), (1, "a"), (5, "b"), (6, "c"), (8, "d"), (9, " ")]


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        rows = stage(spark, odd, SF)
        if name != "tokens":
            assert rows.columns == odd.columns
        if name in ("near_duplicates", "decontaminate"):
            # null, empty and blank texts, and rows without id, are no copies and hold no benchmark window
            ids = [r["doc_id"] for r in rows.collect()]
            assert {4, 5, 6, None} <= set(ids), name
    near = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 4, 5, 6, 7, 10]
    assert corpus_pipeline.identify_language(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.identify_language(spark, odd, SF).columns == odd.columns
    assert corpus_pipeline.write_tokens(spark, odd, SF).agg(F.sum("n_tokens")).first()[0] > odd.count()


def test_near_duplicates_drop_repeated_rows_however_many(spark):
    import corpus_pipeline

    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.range(600).select((F.col("id") + 100).alias("doc_id"), F.lit(text + " x").alias("text")))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(7, text)]
