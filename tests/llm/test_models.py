"""Trained operators and the mixture against plain versions of what they compute."""

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import language_id, queries, toxicity
from tillroll.llm.common import fold, table, text_bytes

SF = "/root/testdata/sf0.001"


def plain_language(net, text):
    """Mean over windows of softmax(out(relu(max over places of the filters)))."""
    raw = (text or "").encode()
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    size = net.spec.window
    probs = []
    for a in range(0, max(len(raw), 1), size):
        x = list(raw[a:a + size].ljust(size, b"\0"))
        pooled = []
        for t, b in zip(net.tables, net.bias):
            places = [sum(t[j, x[i + j]].astype(float) for j in range(len(t))) for i in range(size - len(t) + 1)]
            pooled.append(np.maximum(np.max(places, 0) + b, 0))
        z = np.concatenate(pooled) @ net.out.astype(float) + net.out_bias
        e = np.exp(z - z.max())
        probs.append(e / e.sum())
    mean = np.mean(probs, 0)
    return net.labels[int(mean.argmax())], float(mean.max())


def test_language_scores_equal_a_plain_convolution(spark):
    docs = table(spark, SF, "documents")
    net = language_id.train(docs.where(fold() != 2))
    short = docs.where("length(text) < 1500").limit(25).unionByName(docs.limit(1).withColumn("text", F.lit("12 !!")))
    rows = language_id.predict(short, net, ["text"]).select("row_.text", "lang_pred", "score").collect()
    for r in rows:
        lang, p = plain_language(net, r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p, abs=1e-4)


def test_toxicity_scores_equal_a_plain_noisy_or(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").where(fold() != 2)
    model = toxicity.train(docs.select("doc_id", "text").join(toxicity.sample_labels(labels), "doc_id"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    weights = np.append(model.weights, np.float32(0))
    some = 0
    for r in docs.orderBy("doc_id").limit(60).collect():
        text = r["text"] or ""
        clean, sentences = 1.0, 0
        for sentence in re.split(r"(?<=[.!?])(?=[\x20\x09-\x0D])|\n", text):
            found = list(toxicity.features(*text_bytes(pa.array([sentence])), model.spec))
            f = found[0][3] if found else np.zeros((0, 1), np.int64)
            if len(f):
                sentences += 1
                z = model.bias + float(weights[f].sum())
                clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[r["doc_id"]]["n_sentences"] == sentences
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - clean, abs=1e-4)
        some += sentences > 1
    assert some > 10


def test_one_class_gives_its_rate_to_every_text(spark):
    rows = spark.createDataFrame([(1, "some text here", 1, 1.0), (2, "", 1, 1.0), (3, None, 1, 1.0)],
                                 "doc_id long, text string, toxic int, weight double")
    model = toxicity.train(rows)
    assert [r["score"] for r in toxicity.score(rows, model).collect()] == [1.0] * 3


def test_training_text_is_bounded(spark):
    long = "word and more words here. " * 400
    rows = spark.createDataFrame([(i, long + str(i) + (" vile" if i % 2 else ""), i % 2, 1.0) for i in range(200)],
                                 "doc_id long, text string, toxic int, weight double")
    few = toxicity.MilSpec(train_chars=200_000)
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda bags, y, spec, weight=None: seen.append((len(bags), weight)) or fit(bags, y, spec, weight)
        toxicity.train(rows, spec=few)
        toxicity.train(rows)
    finally:
        toxicity.fit = fit
    assert seen[0][0] < 80 and seen[1][0] == 200


def test_mixture_meets_plainly_computed_targets(spark):
    docs = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
            for r in table(spark, SF, "documents").collect()]
    size = defaultdict(int)
    for _, s, n in docs:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:                       # a source above twice its size stops there, the rest share again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    got = queries.op9_mixing(spark, SF).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for i, _, n in docs)
    of = {i: s for i, s, _ in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + min(largest[s], 60), s
