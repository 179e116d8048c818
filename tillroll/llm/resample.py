"""Importance resampling of documents towards a target text distribution.

Features are word runs, hashed into buckets. A bucket's gain is the logarithm
of its smoothed frequency in the target over that in the documents; a
document's weight is the mean gain of its features, computed on arrays: words
of a batch are dictionary-encoded, each distinct feature is hashed once, gains
are taken by bucket and summed by document. Noise of a Gumbel law, fixed by the document's id,
turns the highest scores into a draw without replacement.

The draw never sorts all rows to find its cutoff. A quantile sketch brackets
the cutoff, exact counts of the rows above and not below the bracket validate
it or widen it, and only rows of the bracket are sorted. The drawn rows alone
are ranked, by range partitions and the row counts before each.

Edge cases: null and empty texts have no features, weight 0 and are drawn
only if ``least_words`` is 0; repeated rows are drawn each for itself; ties
go to the smaller id, null ids last, then to more features and the higher
weight; a null id is hashed as the empty text; an empty table or target is
allowed; other columns are ignored; a text of any length is one row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import ALNUM_WORDS, LOWER, bounded, materialize, row_groups, text_bytes, words


@dataclass(frozen=True)
class ResampleSpec:
    runs: int = 1                # features are runs of 1 to this many words
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least_words: int = 20
    accuracy: int = 2_000        # of the sketch: rank error one in so many rows


def features(offsets: np.ndarray, data: np.ndarray, spec: ResampleSpec):
    """(bucket, row) of every feature and the number of words of every row."""
    n = len(offsets) - 1
    w = words(offsets, data, ALNUM_WORDS, hashed=False)
    n_words = np.bincount(w.docs, minlength=n)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    # spans and the gaps between them as slices of the lower-cased bytes; words are the even ones
    lo = int(offsets[0])
    bounds = np.empty(2 * len(w.starts), np.int64)
    bounds[0::2], bounds[1::2] = w.starts - lo, w.ends - lo
    low = LOWER[data[lo:int(offsets[-1])]]
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1,
                                              [None, pa.py_buffer(bounds), pa.py_buffer(low)])
    word = slices.take(pa.array(np.arange(0, len(bounds) - 1, 2)))
    found, rows = [], []
    for k in range(1, min(spec.runs, len(word)) + 1):
        run = word if k == 1 else pc.binary_join_element_wise(
            *(word.slice(i, len(word) - k + 1) for i in range(k)), pa.scalar(b" ", pa.large_binary()))
        first, last = w.docs[:len(run)], w.docs[k - 1:]
        inside = first == last
        found.append(_buckets(run, spec.buckets)[inside])
        rows.append(first[inside])
    return np.concatenate(found), np.concatenate(rows), n_words


def _buckets(run: pa.Array, buckets: int) -> np.ndarray:
    coded = run.dictionary_encode()
    crc = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return (crc % buckets)[coded.indices.to_numpy()]


def bucket_counts(texts: DataFrame, spec: ResampleSpec, text_col: str = "text") -> np.ndarray:
    """Features of all rows by bucket; tasks send one row a bucket at most."""
    def run(batches):
        total = np.zeros(spec.buckets, np.int64)
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            for a, b in row_groups(offsets):
                total += np.bincount(features(offsets[a:b + 1], data, spec)[0], minlength=spec.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = bounded(texts).select(F.col(text_col).alias("text_")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(spec.buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():     # at most spec.buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed frequency in the target over that in the source, by bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, spec: ResampleSpec, columns: list[str],
          text_col: str = "text") -> DataFrame:
    """row_ (the named columns), n_words, n_features and weight of every row."""
    rows = bounded(docs).select(F.struct(*columns).alias("row_"), F.col(text_col).alias("text_"))
    kept = rows.schema["row_"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for a, b in row_groups(offsets):
                bucket, row, n_words = features(offsets[a:b + 1], data, spec)
                n = np.bincount(row, minlength=b - a)
                order = np.argsort(row, kind="stable") if spec.runs > 1 else slice(None)
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))],
                    ["row_", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"row_ {kept}, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, spec: ResampleSpec, id_col: str = "row_.doc_id") -> DataFrame:
    """Adds score: the weight and Gumbel noise drawn from the id's hash."""
    name = F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long"))


def _order(id_col: str):
    return [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc()]


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Adds rank_ (from 1) by a total sort: range partitions and the rows before each, no single task."""
    id_ = F.monotonically_increasing_id()
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", id_))
    part = F.shiftright("at_", 33)
    before = (placed.groupBy(part.alias("part_")).count()            # a row a partition
              .withColumn("before_", F.sum("count").over(Window.orderBy("part_")) - F.col("count")))
    return (placed.withColumn("part_", part).join(F.broadcast(before.drop("count")), "part_")
            .withColumn("rank_", F.col("before_") + (F.col("at_") - F.shiftleft("part_", 33)) + 1)
            .drop("at_", "part_", "before_"))


def cutoff(pool: DataFrame, k: int, n: int, spec: ResampleSpec, id_col: str):
    """The k-th of the n rows by score and ties (k from 1 to n)."""
    error, share = 1.0 / spec.accuracy, 1 - k / n
    slack = 2 * error
    while True:
        low, high = max(0.0, share - slack), min(1.0, share + slack)
        lo, hi, least, most = pool.agg(
            F.percentile_approx("score", low, spec.accuracy), F.percentile_approx("score", high, spec.accuracy),
            F.min("score"), F.max("score")).first()
        lo, hi = (least if low == 0 else lo), (most if high == 1 else hi)
        above, not_below = pool.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score") >= lo)).first()
        if above < k <= not_below:
            break
        slack *= 4
    bracket = pool.where(F.col("score").between(lo, hi))
    return ranked(bracket, _order(id_col)).where(F.col("rank_") == k - above).first()


def resample(weighed: DataFrame, spec: ResampleSpec, id_col: str = "doc_id") -> DataFrame:
    """All rows with score and rank; rank is null for rows that are not drawn."""
    name = f"row_.{id_col}"
    rows = materialize(with_score(weighed, spec, name))
    able = F.col("n_words") >= spec.least_words
    pool = rows.where(able)
    n = pool.count()
    k = spec.percent * n // 100
    rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select("*", rank)
    last = cutoff(pool, k, n, spec, name)
    id_, at = F.col(name), last["row_"][id_col]
    at = F.lit(at)
    before = F.coalesce(id_ < at, F.when(at.isNull(), id_.isNotNull()).otherwise(False))
    more = (F.col("n_features") > last["n_features"]) | (
        (F.col("n_features") == last["n_features"]) & (F.col("weight") >= last["weight"]))
    first = able & ((F.col("score") > last["score"]) | (
        (F.col("score") == last["score"]) & (before | (id_.eqNullSafe(at) & more))))
    drawn = ranked(rows.where(first), _order(name)).select(
        *rows.columns, F.when(F.col("rank_") <= k, F.col("rank_")).alias("rank"))   # rows equal in all go by number
    return drawn.unionByName(rows.where(~first).select("*", rank))
