"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target number of words (``targets``). Each row of a
   source is taken ``target // size`` whole times; the rest of the target
   needs a part of the source.
2. A source's rows fall into blocks by a seeded hash. In a seeded order of
   blocks, whole blocks are taken while they fit; inside the first block that
   doesn't, rows are taken in a seeded order while they fit. What is left goes
   on to the rows of other blocks that are no longer than it, in the same
   way, until no row left out of the source fits: each such round leaves less
   than the smallest row left out of its last block. Blocks hold about
   ``block_rows`` rows, or a ``1 / max_blocks`` part of a large source.
3. The taken block copies are the balls of an urn, one colour per source. A
   binary tree over the output shards splits them exactly: each node draws
   the left child's colours from a multivariate hypergeometric law with a
   generator seeded by the node. Every leaf finds its quotas on its own, so
   no table of all shards exists on the driver.
4. A shard draws its quota from each source's permuted list of block copies;
   ranges of different shards are disjoint. Rows of a shard are then ordered
   by a seeded hash.

Only per-source totals reach the driver (at most ``max_sources`` rows, else
an error). A hot source has many blocks, so its rows spread.

Edge cases: a null source is a source, last in order; null texts have size
0 and are never needed for a target (they ride along with whole passes); equal
rows share every decision; a source of size 0 has target 0; an empty table
gives an empty result; reruns agree; other columns pass through ``mix`` in
the struct ``row_``, so no name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.llm.common import SPACE_WORDS, bounded, lean, materialize, small_table, text_bytes, word_counts


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (3, 1, 2)      # by source in order, repeating
    share: Fraction = Fraction(3, 2)          # of all words
    limit: int = 2                            # target at most limit * size
    block_rows: int = 128
    max_blocks: int = 4096
    shard_words: int = 2_000_000
    max_sources: int = 100_000
    seed: int = 11


def targets(sizes: dict[str | None, int], spec: MixSpec = MixSpec()) -> dict[str | None, Fraction]:
    """Exact target of every source; what exceeds the limit is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: spec.weights[i % len(spec.weights)] for i, s in enumerate(order)}
    left = spec.share * sum(sizes.values())
    got: dict[str | None, Fraction] = {}
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if want[s] > spec.limit * sizes[s]]
        if not over:
            return got | want
        for s in over:
            got[s] = Fraction(spec.limit * sizes[s])
            left -= got[s]
        open_ = [s for s in open_ if s not in got]
    return got


def with_sizes(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``keep`` columns in a struct row_, plus id_, src_, size_ (words) and h_ (row hash)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    base = bounded(docs).select(kept.alias("row_"), F.col(id_col).cast("long").alias("id_"), F.col(source_col).alias("src_"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h_"),
                       F.lit(0).cast("long").alias("size_"), F.col(text_col).alias("text_"))
    schema = to_arrow_schema(base.drop("text_").schema)

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column("text_"))
            n = pa.array(word_counts(offsets, data, SPACE_WORDS))
            yield pa.record_batch([n if f.name == "size_" else batch.column(f.name) for f in schema],
                                  schema=schema)

    return base.mapInArrow(lean(run), base.drop("text_").schema)


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Take units in a seeded order while they fit; of some orders the one that leaves least.

    The rest is smaller than every unit of the block left out.
    """
    pdf = pdf.sort_values("h_")
    words, rest = pdf["words"].to_numpy(), int(pdf["left"].iloc[0])
    best, least = np.zeros(len(words), bool), rest
    for trial in range(64):
        order = np.random.default_rng([trial, len(words)]).permutation(len(words))
        left, take = rest, np.zeros(len(words), bool)
        for i, n in zip(order.tolist(), words[order].tolist()):
            if 0 < n <= left:
                left -= n
                take[i] = True
        if trial == 0 or left < least:
            best, least = take, left
        if least <= words.sum() // 1000:
            break
    return pdf.loc[best, ["k_", "b_", "h_", "words"]]


# A lookup table up to this many rows is broadcast; a larger one is joined as the planner sees fit.
LOOKUP_ROWS = 500_000


def _lookup(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= LOOKUP_ROWS else df


class Plan:
    """Per-source figures (driver, bounded), taken blocks, and the copies of every row."""

    def __init__(self, sources: list[dict], small: DataFrame, ranked: DataFrame, part: DataFrame, spec: MixSpec):
        self.sources, self.small, self.spec = sources, small, spec
        self.n_blocks = sum(s["n_blocks"] for s in sources)
        self.ranked, self.part, self.n_part = ranked, part, part.count()

    def tag(self, rows: DataFrame) -> DataFrame:
        """Adds the source's figures and b_, the block."""
        return rows.join(F.broadcast(self.small), rows["src_"].eqNullSafe(self.small["src_"])) \
            .drop(self.small["src_"]).withColumn("b_", _block(self.spec))

    def copies(self, rows: DataFrame) -> DataFrame:
        """Rows of ``with_sizes`` plus k_ (source number), b_, source_size, target and copies (0 .. limit)."""
        full = _lookup(self.ranked.select("k_", "b_", "full"), self.n_blocks)
        part = _lookup(self.part, self.n_part)
        return self.tag(rows).join(full, ["k_", "b_"]).join(part, ["k_", "h_"], "left").withColumn(
            "copies", F.col("whole") + F.when(F.col("full") | F.coalesce("part", F.lit(False)), 1).otherwise(0))

    def blocks(self) -> DataFrame:
        """k_, b_, pass_ of every taken block copy."""
        last = F.col("whole") + F.when(F.col("full") | F.col("edge"), 0).otherwise(-1)
        return self.ranked.where("whole > 0 or full or edge").select(
            "k_", "b_", F.explode(F.sequence(F.lit(0), last)).alias("pass_"))


def _block(spec: MixSpec):
    return F.pmod(F.xxhash64(F.lit(spec.seed), "h_"), F.col("n_blocks")).cast("int")


def plan(rows: DataFrame, spec: MixSpec = MixSpec()) -> Plan:
    """Decide how often each row of ``with_sizes`` is taken; reads ``rows`` once."""
    spark = rows.sparkSession
    rows = materialize(rows.select("src_", "h_", "size_"))
    stats = rows.groupBy("src_").agg(F.sum("size_").alias("size"), F.count("*").alias("n")) \
        .limit(spec.max_sources + 1).collect()
    if len(stats) > spec.max_sources:
        raise ValueError(f"more than {spec.max_sources} sources")
    want = targets({r["src_"]: r["size"] for r in stats}, spec)
    sources = []
    for r in sorted(stats, key=lambda r: (r["src_"] is None, r["src_"] or "")):
        t = want[r["src_"]]
        whole = int(t // r["size"]) if r["size"] else 0
        sources.append({"k_": len(sources), "src_": r["src_"], "source_size": r["size"], "target": float(t),
                        "whole": whole, "rest": round(t - whole * r["size"]),
                        "n_blocks": max(1, min(spec.max_blocks, r["n"] // spec.block_rows))})
    kinds = ("k_ int, src_ string, source_size long, target double, whole int, rest long, n_blocks int")
    small = small_table(spark, [tuple(s.values()) for s in sources], kinds)
    tagged = rows.join(F.broadcast(small), rows["src_"].eqNullSafe(small["src_"])).drop(small["src_"]) \
        .withColumn("b_", _block(spec))
    # blocks in hash order with running words; a source has at most max_blocks of them
    sums = tagged.groupBy("k_", "b_").agg(F.sum("size_").alias("w"), F.first("rest").alias("rest"),
                                          F.first("whole").alias("whole"))
    order = F.xxhash64(F.lit(spec.seed + 1), "k_", "b_")
    ranked = sums.withColumn("o", order).selectExpr(
        "*", "sum(w) over (partition by k_ order by o, b_ rows between unbounded preceding and current row) as run")
    ranked = materialize(ranked.selectExpr(
        "k_", "b_", "whole", "w", "run <= rest as full", "run > rest and run - w < rest as edge",
        "rest - (run - w) as left"))
    edge = ranked.where("edge").select("k_", "b_", "left")
    units = tagged.join(edge, ["k_", "b_"]).groupBy("k_", "b_", "h_").agg(
        F.sum("size_").alias("words"), F.first("left").alias("left"))
    part = materialize(_filled(units))
    part = _carry(tagged, ranked, part, order, {s["k_"]: s["rest"] for s in sources})
    more = part.groupBy("k_", "b_").agg(F.lit(True).alias("more"))
    ranked = materialize(ranked.join(more, ["k_", "b_"], "left").select(
        "k_", "b_", "whole", "full", (F.col("edge") | F.coalesce("more", F.lit(False))).alias("edge")))
    part = part.select("k_", "h_", F.lit(True).alias("part"))
    return Plan(sources, small, ranked, part, spec)


_PART = "k_ int, b_ int, h_ long, words long"


def _filled(units: DataFrame) -> DataFrame:
    """The units that ``_fill`` takes; a source has one block here."""
    return units.groupBy("k_").applyInPandas(_fill, _PART)


def _carry(tagged: DataFrame, ranked: DataFrame, part: DataFrame, order, rests: dict[int, int]) -> DataFrame:
    """``part`` and what else is taken of the other blocks until no row left out of a source fits.

    A round gives what a source has left to its units that are no longer: all units of the blocks that fit in the
    seeded order, then ``_fill`` in the first block that doesn't.
    """
    spark, blocks = tagged.sparkSession, ranked.count()
    taken = ranked.where("full").select("k_", F.col("w").alias("words"))
    for r in taken.union(part.select("k_", "words")).groupBy("k_").agg(F.sum("words").alias("words")).collect():
        rests[r["k_"]] -= r["words"]
    open_blocks = _lookup(ranked.where("not full").select("k_", "b_"), blocks)
    while rests := {k: n for k, n in rests.items() if n > 0}:
        left = F.broadcast(small_table(spark, list(rests.items()), "k_ int, left long"))
        fit = tagged.join(left, "k_").where("size_ > 0 and size_ <= left").join(open_blocks, ["k_", "b_"], "left_semi") \
            .groupBy("k_", "b_", "h_").agg(F.sum("size_").alias("words"), F.first("left").alias("left")) \
            .where("words <= left").join(part.select("k_", "h_"), ["k_", "h_"], "left_anti")
        fit = materialize(fit)
        sums = fit.groupBy("k_", "b_").agg(F.sum("words").alias("w"), F.first("left").alias("left"))
        runs = materialize(sums.withColumn("o", order).selectExpr(
            "k_", "b_", "w", "left",
            "sum(w) over (partition by k_ order by o, b_ rows between unbounded preceding and current row) as run"))
        n_runs = runs.count()
        if not n_runs:
            break
        whole = _lookup(runs.where("run <= left").select("k_", "b_"), n_runs)
        edge = _lookup(runs.where("run > left and run - w < left")
                       .select("k_", "b_", (F.col("left") - (F.col("run") - F.col("w"))).alias("left")), n_runs)
        got = materialize(fit.join(whole, ["k_", "b_"], "left_semi").select("k_", "b_", "h_", "words")
                          .union(_filled(fit.drop("left").join(edge, ["k_", "b_"]))))
        spent = {r["k_"]: r["words"] for r in got.groupBy("k_").agg(F.sum("words").alias("words")).collect()}
        open_ = {r["k_"] for r in runs.select("k_").distinct().collect()}
        rests = {k: n - spent.get(k, 0) for k, n in rests.items() if k in open_}
        part = materialize(part.union(got))
    return part


def split(counts: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, quota) per colour of one leaf of the splitting tree over ``shards`` leaves."""
    lo, hi = 0, shards
    offset = np.zeros(len(counts), np.int64)
    total = int(counts.sum())
    size = lambda a, b: total * b // shards - total * a // shards  # noqa: E731  balls of leaves a .. b - 1
    counts = counts.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, size(lo, mid), method="marginals")
        if shard < mid:
            counts, hi = left, mid
        else:
            offset, counts, lo = offset + left, counts - left, mid
    return offset, counts


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", planned: Plan | None = None) -> DataFrame:
    """The mixture: every row of ``docs`` (struct row_) as often as it is taken, with k_, h_, shard_ and place_.

    Rows are partitioned by shard and locally shuffled (ordered by place_). ``planned`` is their plan, if there is one.
    """
    spark = docs.sparkSession
    rows = with_sizes(docs, docs.columns, id_col, text_col, source_col)
    p = planned or plan(rows, spec)
    spec = p.spec
    taken = materialize(p.blocks())
    per = {r["k_"]: r["count"] for r in taken.groupBy("k_").count().collect()}
    counts = np.array([per.get(s["k_"], 0) for s in p.sources], np.int64)
    words = sum(s["target"] for s in p.sources)
    shards = max(1, min(int(counts.sum()), round(words / spec.shard_words)))
    leaves = spark.range(shards).mapInArrow(_leaves(counts, shards, spec.seed), "shard_ int, k_ int, lo long, hi long")
    # permuted list of each source's block copies, cut into the shards' ranges
    spots = taken.withColumn("o", F.xxhash64(F.lit(spec.seed + 2), "k_", "b_", "pass_")).selectExpr(
        "k_", "b_", "pass_", "row_number() over (partition by k_ order by o, pass_, b_) - 1 as spot")
    ranges = leaves.select("shard_", "k_", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("spot"))
    drawn = spots.join(ranges, ["k_", "spot"]).select("k_", "b_", "pass_", "shard_")
    out = (p.copies(rows).where("copies > 0")
           .withColumn("pass_", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
           .join(_lookup(drawn, int(counts.sum())), ["k_", "b_", "pass_"])
           .withColumn("place_", F.xxhash64(F.lit(spec.seed + 3), "h_", "pass_")))
    return out.select("row_", "k_", "h_", "shard_", "place_").repartition("shard_") \
        .sortWithinPartitions("shard_", "place_")


def taken(docs: DataFrame, keep: list[str], spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` (``keep`` columns in row_) with size_, source_size, target and taken, its words in ``mix``.

    The rows of the mixture are counted; a count that differs from the plan's copies is an error.
    """
    rows = materialize(with_sizes(docs, keep, id_col, text_col, source_col))
    p = plan(rows, spec)
    dealt = materialize(mix(docs, spec, id_col, text_col, source_col, p).groupBy("k_", "h_").agg(F.count("*").alias("dealt")))
    copies = p.copies(rows)
    # equal rows share a hash
    equal = copies.groupBy("k_", "h_").agg(F.count("*").alias("equal")).join(dealt, ["k_", "h_"], "left") \
        .withColumn("dealt", F.coalesce("dealt", F.lit(0)))
    wrong = F.raise_error(F.lit("the mixture differs from its plan")).cast("long")
    return copies.join(equal, ["k_", "h_"]).withColumn("taken", F.when(
        F.col("equal") * F.col("copies") == F.col("dealt"), F.expr("size_ * (dealt div equal)")).otherwise(wrong))


def _leaves(counts: np.ndarray, shards: int, seed: int):
    schema = pa.schema([("shard_", pa.int32()), ("k_", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                lo, n = split(counts, shard, shards, seed)
                k = np.flatnonzero(n)
                yield pa.record_batch([pa.array(np.full(len(k), shard, np.int32)), pa.array(k.astype(np.int32)),
                                       pa.array(lo[k]), pa.array(lo[k] + n[k])], schema=schema)

    return lean(run)
