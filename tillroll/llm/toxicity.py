"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model scores each sentence from
hashed words and word beginnings; the document's probability is the noisy-or
of its sentences, ``1 - prod(1 - p_s)``. Only document labels are needed: the
gradient of the noisy-or reaches the sentences that explain the label. After
training, sentences above a threshold are the located offences.

Training uses a documented, bounded sample (about ``per_class`` labelled
documents of each class with at most ``max_train_words`` words) and runs on
the driver with fixed seeds. Scoring covers every sentence of every text.

Edge cases: null or blank text has no sentence and scores 0; a text without
sentence marks is one sentence; repeated rows get equal results; with no
labels, or one class only, every score is that class's rate; an empty table
gives an empty result; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import ALNUM_WORDS, LOWER, bounded, mix, row_groups, text_bytes, words

# A line end or one of these marks before white space closes a sentence.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass(frozen=True)
class MilSpec:
    bits: int = 18
    starts: tuple[int, ...] = (3, 4, 5, 6, 7, 8)   # bytes of word beginnings used as features
    per_class: int = 2500
    max_train_words: int = 20_000
    train_chars: int = 12_000_000   # of a class, expected: bounds what is sent to the driver
    epochs: int = 12
    rate: float = 0.5
    decay: float = 2e-4
    prior: float = -6.0                       # a sentence without features
    locate: float = 0.3
    seed: int = 7


class MilModel:
    def __init__(self, weights: np.ndarray, bias: float, constant: float | None, spec: MilSpec):
        self.weights, self.bias, self.constant, self.spec = weights, bias, constant, spec


def _sentence_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Number the sentences over all given words: a new one after a mark or line end, or in a new document."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.zeros(len(starts), bool)
    new[1:] = docs[1:] != docs[:-1]
    lo = int(starts[0])
    part = data[lo:int(ends[-1])]
    stop = part == 0x0A
    stop[:-1] |= _MARKS[part[:-1]] & _BLANK[part[1:]]
    upto = np.concatenate([[0], np.cumsum(stop)])
    new[1:] |= upto[starts[1:] - lo] > upto[ends[:-1] - lo]
    return np.cumsum(new)


def features(offsets: np.ndarray, data: np.ndarray, spec: MilSpec):
    """Yield (first row, docs, sentence, features [words, 1 + starts], word starts, word ends)."""
    base = np.uint64(0x9E3779B97F4A7C55)
    shift = np.uint64(64 - spec.bits)
    for a, b in row_groups(offsets, 1 << 20):
        w = words(offsets[a:b + 1], data, ALNUM_WORDS)
        n = len(w.starts)
        f = np.zeros((n, 1 + len(spec.starts)), np.int64)
        f[:, 0] = (w.hashes >> shift).astype(np.int64)
        # rolling hashes of the first bytes; shorter words have no such feature (-1)
        h = np.zeros(n, np.uint64)
        length = w.ends - w.starts
        f[:, 1:] = -1
        for j in range(max(spec.starts)):
            on = length > j
            h[on] = h[on] * base + LOWER[data[w.starts[on] + j]].astype(np.uint64) + np.uint64(1)
            if j + 1 in spec.starts:
                on = length > j + 1    # a proper beginning
                f[on, 1 + spec.starts.index(j + 1)] = (mix(h[on] + np.uint64(j)) >> shift).astype(np.int64)
        yield a, w.docs, _sentence_ids(data, w.starts, w.ends, w.docs), f, w.starts, w.ends


def _sentence_logits(f: np.ndarray, sentence: np.ndarray, model_w: np.ndarray, bias: float) -> np.ndarray:
    """Bias plus the weights of a sentence's words and word beginnings."""
    w = np.append(model_w, np.float32(0))      # index -1 reads 0
    return bias + np.bincount(sentence, w[f].sum(1))


def _noisy_or(logits: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) over each document's sentences."""
    keep = -np.logaddexp(0, np.clip(logits, -30, 30))
    return 1 - np.exp(np.bincount(docs, keep, minlength=n))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, spec: MilSpec,
        weight: np.ndarray | None = None) -> MilModel:
    """Adagrad on the likelihood of document labels under the noisy-or.

    bags: (sentence id of each word, features of each word) of a document.
    weight: of each document; undoes the sampling of classes, so that
    probabilities keep the labels' own rate.
    """
    y = np.asarray(y, float)
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return MilModel(np.zeros(1 << spec.bits, np.float32), spec.prior, float(y[0]) if len(y) else 0.0, spec)
    size = 1 << spec.bits
    w = np.zeros(size + 1)
    past = np.full(size + 1, 1e-2)
    bias, past_b = spec.prior, 1e-2
    rng = np.random.default_rng(spec.seed)
    for _ in range(spec.epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), 64):
            at = order[a:a + 64]
            sent, doc, feats, base = [], [], [], 0
            for d, i in enumerate(at):
                s, f = bags[i]
                m = int(s[-1]) + 1 if len(s) else 0
                sent.append(s + base)
                feats.append(f)
                doc.append(np.full(m, d))
                base += m
            sent, f, doc = np.concatenate(sent), np.concatenate(feats), np.concatenate(doc)
            if not len(sent):
                continue
            w[-1] = 0
            z = bias + np.bincount(sent, w[f].sum(1), minlength=base)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            whole = np.clip(_noisy_or(z, doc, len(at)), 1e-6, 1 - 1e-6)
            t = y[at]
            # d log-likelihood / d z_s = p_s * (t / whole - 1): 0 - p_s for a clean document
            g = p * (weight[at] * (t / whole - 1))[doc] / len(at)
            gw = np.bincount(f[f >= 0], np.repeat(g[sent], f.shape[1])[(f >= 0).reshape(-1)],
                             minlength=size + 1)
            hit = np.flatnonzero(gw)
            step = gw[hit] - spec.decay / len(at) * w[hit]
            past[hit] += step ** 2
            w[hit] += spec.rate * step / np.sqrt(past[hit])
            gb = g.sum()
            past_b += gb ** 2
            bias = min(bias + 0.5 * spec.rate * gb / past_b ** 0.5, spec.prior / 2)
    return MilModel(w[:size].astype(np.float32), float(bias), None, spec)


def _bag_rows(spec: MilSpec):
    schema = pa.schema([("h", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64()),
                        ("sent", pa.binary()), ("feats", pa.binary())])

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            h, y, wt = (batch.column(c).to_pylist() for c in (1, 2, 3))
            rows = []
            for a, docs, sent, f, _, _ in features(offsets, data, spec):
                at = np.searchsorted(docs, np.arange((docs[-1] if len(docs) else -1) + 2))
                for d in range(len(at) - 1):
                    s, e = int(at[d]), int(at[d + 1])
                    if 0 < e - s <= spec.max_train_words:
                        rows.append((h[a + d], y[a + d], wt[a + d], (sent[s:e] - sent[s]).astype(np.int32).tobytes(),
                                     f[s:e].astype(np.int32).tobytes()))
            yield pa.record_batch([pa.array([r[c] for r in rows], schema.field(c).type)
                                   for c in range(5)], schema=schema)

    return run


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic",
                  spec: MilSpec = MilSpec()) -> DataFrame:
    """About ``per_class`` (id, 0/1 label, weight) rows of each class, by the hash of the id: safe to broadcast."""
    rows = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, spec.per_class / max(counts.get(1, 0), 1))) \
        .otherwise(min(1.0, spec.per_class / max(counts.get(0, 0), 1)))
    return rows.where(F.pmod(F.xxhash64(F.lit(spec.seed), id_col), F.lit(1 << 30)) < share * (1 << 30)) \
        .withColumn("weight", 1 / share)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic",
          weight_col: str = "weight", spec: MilSpec = MilSpec()) -> MilModel:
    """Fit on (text, 0/1 label, weight) rows, a bounded sample as ``sample_labels`` gives."""
    picked = bounded(labelled).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"),
                             F.col(weight_col).cast("double").alias("weight")) \
        .where("text is not null and y in (0, 1)").withColumn("h", F.xxhash64("text", "y"))
    # a class with more text than its budget is thinned, by document, with its weight made up for
    chars = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = {y: min(1.0, spec.train_chars / max(chars.get(y) or 0, 1)) for y in (0, 1)}
    kept = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    picked = picked.where(F.pmod(F.xxhash64(F.lit(spec.seed + 1), "h"), F.lit(1 << 30)) < kept * (1 << 30)) \
        .withColumn("weight", F.col("weight") / kept)
    got = picked.select("text", "h", "y", "weight").mapInArrow(
        _bag_rows(spec), "h long, toxic int, weight double, sent binary, feats binary").toArrow()
    got = got.sort_by([("h", "ascending"), ("toxic", "ascending")])
    bags = [(np.frombuffer(s, np.int32), np.frombuffer(f, np.int32).reshape(-1, 1 + len(spec.starts)))
            for s, f in zip(got.column("sent").to_pylist(), got.column("feats").to_pylist())]
    weight = got.column("weight").to_numpy()
    return fit(bags, got.column("toxic").to_numpy().astype(float), spec,
               weight / weight.mean() if len(weight) else None)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()),
                  ("offences", pa.list_(_SPAN))])


def _apply(model: MilModel):
    def run(batches):
        spec = model.spec
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            n = batch.num_rows
            score = np.zeros(n) if model.constant is None else np.full(n, model.constant)
            sentences = np.zeros(n, np.int64)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for a, docs, sent, f, starts, ends in features(offsets, data, spec):
                if not len(docs):
                    continue
                m = int(docs[-1]) + 1
                z = _sentence_logits(f, sent, model.weights, model.bias)
                first = np.searchsorted(sent, np.arange(len(z)))
                last = np.append(first[1:], len(sent)) - 1
                owner = docs[first]
                if model.constant is None:
                    score[a:a + m] = _noisy_or(z, owner, m)
                sentences[a:a + m] = np.bincount(owner, minlength=m)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for s in np.flatnonzero(p >= spec.locate):
                    d = int(owner[s])
                    lo = int(offsets[a + d])
                    b0, b1 = int(starts[first[s]]), int(ends[last[s]])
                    # code points: bytes that do not continue a character
                    c0 = int(((data[lo:b0] & 0xC0) != 0x80).sum())
                    c1 = c0 + int(((data[b0:b1] & 0xC0) != 0x80).sum())
                    spans[a + d].append({"start": c0, "end": c1, "p": float(p[s])})
            yield pa.record_batch([batch.column(0), pa.array(np.clip(score, 0, 1)), pa.array(sentences),
                                   pa.array(spans, pa.list_(_SPAN))], schema=_OUT)

    return run


def score(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, n_sentences and the located sentences (code points)."""
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _apply(model), "doc_id long, score double, n_sentences long, "
                       "offences array<struct<start: bigint, end: bigint, p: double>>")
