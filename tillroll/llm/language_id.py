"""Language identification with a byte convolutional network in numpy.

Text is cut into windows of ``window`` bytes; every window of every whole
text is scored. One-hot bytes pass through convolutions of several widths,
ReLU, max pooling over the window and a softmax layer. A convolution over
one-hot bytes is a sum of table rows, so filters are applied as lookups of
byte pairs and single bytes.

Training: a documented, bounded sample (about ``per_lang`` documents of each
language, ``windows_per_doc`` windows of each) is cut out on the executors
and fitted by Adam on the driver with fixed seeds, so reruns agree.

A document's probabilities are the mean of its windows' probabilities.

Edge cases: null text or text without a letter gives ``und`` with score 0;
invalid or rare bytes are ordinary bytes; repeated rows get equal results; an
empty table gives an empty result; with no labelled row every text is
``und``; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from tillroll.llm.common import bounded, lean, text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class CnnSpec:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    per_lang: int = 900        # expected sampled documents per language
    windows_per_doc: int = 3
    max_languages: int = 500
    epochs: int = 8
    batch: int = 128
    rate: float = 0.02
    seed: int = 20240


class ByteCnn:
    """Filter tables (one per width and offset), output layer and labels."""

    def __init__(self, tables: list[np.ndarray], bias: list[np.ndarray], out: np.ndarray,
                 out_bias: np.ndarray, labels: list[str], spec: CnnSpec):
        self.tables, self.bias, self.out, self.out_bias = tables, bias, out, out_bias
        self.labels, self.spec = labels, spec

    def pair_tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width: (offset, is_pair, table) lookups; pairs halve the gathers."""
        plan = []
        for t in self.tables:
            steps, j = [], 0
            while j < len(t):
                if j + 1 < len(t):
                    both = (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)
                    steps.append((j, True, np.ascontiguousarray(both, np.float32)))
                    j += 2
                else:
                    steps.append((j, False, np.ascontiguousarray(t[j], np.float32)))
                    j += 1
            plan.append(steps)
        return plan

    def pooled(self, x: np.ndarray, plan, where: bool = False):
        """Max-pooled activations [windows, widths * filters] (and their positions)."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        feats, spots = [], []
        for width, steps, bias in zip(self.spec.widths, plan, self.bias):
            n = x.shape[1] - width + 1
            acc = None
            for at, is_pair, t in steps:
                index = pairs[:, at:at + n] if is_pair else x[:, at:at + n]
                got = np.take(t, index, axis=0)
                acc = got if acc is None else np.add(acc, got, out=acc)
            if where:
                spots.append(acc.argmax(axis=1))
            feats.append(np.maximum(acc.max(axis=1) + bias, 0))
        return (np.concatenate(feats, 1), spots) if where else np.concatenate(feats, 1)

    def probabilities(self, x: np.ndarray, plan) -> np.ndarray:
        return _softmax(self.pooled(x, plan) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """The whole byte string as rows of ``size`` bytes, the last padded with zeros."""
    n = max(-(-len(data) // size), 1)
    out = np.zeros(n * size, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, size)


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], spec: CnnSpec) -> ByteCnn:
    """Adam on cross-entropy. Only pooled positions get a filter gradient."""
    rng = np.random.default_rng(spec.seed)
    k, nf = len(labels), spec.filters
    tables = [rng.normal(0, 0.3, (w, 256, nf)).astype(np.float32) for w in spec.widths]
    bias = [np.zeros(nf, np.float32) for _ in spec.widths]
    out = rng.normal(0, 0.1, (nf * len(spec.widths), k)).astype(np.float32)
    out_bias = np.zeros(k, np.float32)
    params = [*tables, *bias, out, out_bias]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    net = ByteCnn(tables, bias, out, out_bias, labels, spec)
    weight = (len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1)))[y].astype(np.float32)
    step = 0
    for epoch in range(spec.epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), spec.batch):
            at = order[a:a + spec.batch]
            xb = x[at]
            plan = [[(j, False, t[j]) for j in range(len(t))] for t in net.tables]
            h, spots = net.pooled(xb, plan, where=True)
            p = _softmax(h @ net.out + net.out_bias)
            p[np.arange(len(at)), y[at]] -= 1
            p *= (weight[at] / len(at))[:, None]
            dh = (p @ net.out.T) * (h > 0)
            grads = []
            for i, t in enumerate(net.tables):
                g = np.zeros_like(t)
                d = dh[:, i * nf:(i + 1) * nf]
                for j in range(len(t)):
                    chars = xb[np.arange(len(at))[:, None], spots[i] + j]
                    np.add.at(g[j], (chars, np.arange(nf)[None, :]), d)
                grads.append(g)
            grads += [dh[:, i * nf:(i + 1) * nf].sum(0) for i in range(len(bias))]
            grads += [h.T @ p, p.sum(0)]
            step += 1
            rate = spec.rate * (1 - epoch / spec.epochs)
            for q, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q -= rate * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-6)
    return net


def _sample_windows(spec: CnnSpec):
    """Windows spread over the whole text, at places drawn from the row's hash."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("i", pa.int32()), ("w", pa.binary())])

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            langs, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for r in range(batch.num_rows):
                x = windows(data[offsets[r]:offsets[r + 1]], spec.window)
                rng = np.random.default_rng(abs(hashes[r]))
                for i in sorted(rng.choice(len(x), min(len(x), spec.windows_per_doc), replace=False)):
                    rows.append((langs[r], hashes[r], int(i), x[i].tobytes()))
            yield pa.record_batch([pa.array([q[c] for q in rows], schema.field(c).type)
                                   for c in range(4)], schema=schema)

    return lean(run)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          spec: CnnSpec = CnnSpec()) -> ByteCnn | None:
    """Fit on a bounded sample of (text, lang) rows; None without labelled rows."""
    rows = bounded(labelled).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(spec.max_languages + 1).collect()
    if len(counts) > spec.max_languages:
        raise ValueError(f"more than {spec.max_languages} languages")
    if not counts:
        return None
    # a hash threshold per language keeps about per_lang of its rows
    share = F.create_map(*[x for r in counts
                           for x in (F.lit(r["lang"]), F.lit(min(1.0, spec.per_lang / r["count"])))])
    h = F.xxhash64("text")
    picked = rows.withColumn("h", h).where(
        F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    got = picked.select("text", "lang", "h").mapInArrow(
        _sample_windows(spec), "lang string, h long, i int, w binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("h", "ascending"), ("i", "ascending")])
    labels = sorted({r["lang"] for r in counts})
    index = {lang: i for i, lang in enumerate(labels)}
    y = np.array([index[v] for v in got.column("lang").to_pylist()])
    x = np.frombuffer(b"".join(got.column("w").to_pylist()), np.uint8).reshape(-1, spec.window)
    return fit(x, y, labels, spec)


def _score(net: ByteCnn, schema: pa.Schema, inside: str | None, block: int = 192):
    """Score every window of every text (field ``inside`` of row_, if named); a long text is scored block by block."""

    def run(batches):
        plan = net.pair_tables()
        size, k = net.spec.window, len(net.labels)
        for batch in batches:
            row = batch.column("row_")
            offsets, data = text_bytes(pc.struct_field(row, inside) if inside else batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            n = np.where(letters, np.maximum(-(-np.diff(offsets) // size), 1), 0)
            sums = np.zeros((batch.num_rows, k))
            buf = np.zeros((block, size), np.uint8)
            owner = np.zeros(block, np.int64)
            used = 0

            def flush(used):
                if used:
                    np.add.at(sums, owner[:used], net.probabilities(buf[:used], plan))

            for r in np.flatnonzero(n):
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                while lo < hi:
                    take = min(block - used, -(-(hi - lo) // size))
                    part = data[lo:min(lo + take * size, hi)]
                    flat = buf[used:used + take].reshape(-1)
                    flat[:len(part)] = part
                    flat[len(part):] = 0
                    owner[used:used + take] = r
                    used += take
                    lo += take * size
                    if used == block:
                        flush(used)
                        used = 0
            flush(used)
            mean = sums / np.maximum(n, 1)[:, None]
            best = mean.argmax(1)
            names = [net.labels[b] if n[r] else UNKNOWN for r, b in enumerate(best)]
            score = np.where(n > 0, np.clip(mean[np.arange(len(n)), best], 0, 1), 0.0)
            yield pa.record_batch([row, pa.array(names, pa.string()), pa.array(score)],
                                  schema=schema)

    return lean(run)


def predict(docs: DataFrame, net: ByteCnn | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Every row's ``keep`` columns (struct row_) with lang_pred and score."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    base = bounded(docs).select(kept.alias("row_"), F.col(text_col).alias("text"))
    out = base.select("row_", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return out
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    # a text among the kept columns is sent once
    inside = text_col if text_col in keep and isinstance(docs.schema[text_col].dataType, StringType) else None
    sent = [c for c in ("row_", "text") if c != "text" or not inside]
    return base.select(*sent, letters).mapInArrow(
        _score(net, to_arrow_schema(out.schema), inside), out.schema)
