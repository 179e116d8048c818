"""Approximate nearest neighbours by multiprobe p-stable hashing.

``tables`` hash tables each cut ``dims`` Gaussian projections into slots of
width ``w``. If a neighbour lies at distance r, its projection differs from
the query's by a normal step of deviation r, so every slot has a probability
and a bucket the product.

1. A query's own bucket of each table gives its k nearest there. The k-th of
   them bounds the distance of what can still matter.
2. The query then visits perturbed buckets, best first: a heap over the
   slots' probabilities makes them in order of their estimated success, until
   their sum is the table's share, so that the tables together reach
   ``target``. r is the distance of the k-th neighbour in a bounded sample.
   Only candidates within the bound come back, so the rows made follow the
   number of queries and not of the buckets visited.
3. A query that would visit more buckets than a table has occupied ones ranks
   the occupied buckets by the same probabilities instead, in blocks of
   ``bucket_block``, each to its share: no query's probing is cut off.
4. A query whose found k-th neighbour lies farther than r visits again with
   this distance, which no true neighbour exceeds. A query that found fewer
   than k is compared with all vectors.

There are as many projections as keep buckets at about ``bucket_rows``
vectors, but no more than let a query visit ``visits`` buckets of a table on
average; where neighbours lie far apart, buckets are larger instead.

Every vector is indexed. A (table, bucket) holds its vectors in parts of
about ``part`` rows, so a crowded bucket spreads over many tasks; queries go
to all parts of the buckets they visit, in blocks of ``query_block``. Each part ranks its candidates by exact
distance and keeps the k best per query; the parts' lists are merged.

Distances are Euclidean in double precision on the original vectors, ties go
to the smaller id.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; repeated rows of one id and
vector count once; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import materialize


@dataclass(frozen=True)
class LshSpec:
    k: int = 10
    tables: int = 2
    target: float = 0.97
    bucket_rows: int = 400       # vectors per occupied bucket aimed at
    max_dims: int = 16
    visits: int = 32             # buckets of a table that a query visits, on average, at most
    part: int = 4096
    query_block: int = 1024
    bucket_block: int = 65_536
    sample: int = 2000
    seed: int = 17


class Hasher:
    """Projections of every table and the buckets that a query visits."""

    def __init__(self, size: int, n: int, radius: float, spread: float, spec: LshSpec, dims: int | None = None):
        self.spec, self.radius = spec, max(radius, 1e-12)
        # about 3 crowded slots per projection of width = spread
        self.dims = dims or max(1, min(spec.max_dims, round(math.log(max(n / spec.bucket_rows, 1.0), 3))))
        self.width = max(spread, 1e-12)
        rng = np.random.default_rng(spec.seed)
        self.a = rng.normal(size=(spec.tables, self.dims, size))
        self.b = rng.uniform(0, self.width, size=(spec.tables, self.dims))

    def project(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.width

    def keys(self, x: np.ndarray, t: int) -> list[str]:
        slots = np.floor(self.project(x, t)).astype(np.int64)
        return [",".join(map(str, row)) for row in slots.tolist()]

    @property
    def share(self) -> float:
        """What each table must cover for all together to reach the target."""
        return 1 - (1 - self.spec.target) ** (1 / self.spec.tables)

    def slot_chances(self, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Slots around a projected query and the log probability of each, by projection."""
        scale = max(radius, 1e-12) / self.width
        reach = 2 + int(min(6 * scale, 1 << 12))
        near = np.floor(y)[:, None] + np.arange(-reach, reach + 1)
        return near.astype(np.int64), _log_between((near - y[:, None]) / scale, 1 / scale)

    def perturbed(self, y: np.ndarray, radius: float, most: int) -> np.ndarray | None:
        """Slots of the buckets to visit, best first, up to the table's share; None if these are more than ``most``."""
        slots, chance = self.slot_chances(y, radius)
        order = np.argsort(-chance, 1, kind="stable")
        slots, chance = np.take_along_axis(slots, order, 1), np.take_along_axis(chance, order, 1)
        steps = chance.tolist()
        # a bucket is the rank of its slot in each projection; each is made once, from the one with its last
        # raised rank lowered
        heap = [(-float(chance[:, 0].sum()), (0,) * self.dims, 0)]
        found, covered = [], 0.0
        while heap:
            worst, ranks, last = heapq.heappop(heap)
            found.append(ranks)
            covered += math.exp(-worst)
            if covered >= self.share:
                return np.take_along_axis(slots.T, np.array(found), 0)
            if len(found) >= most:
                return None
            for i in range(last, self.dims):
                r, row = ranks[i], steps[i]
                if r + 1 < len(row) and row[r + 1] > -math.inf:
                    heapq.heappush(heap, (worst + row[r] - row[r + 1], ranks[:i] + (r + 1,) + ranks[i + 1:], i))
        return None

    def success(self, q: np.ndarray, radius: np.ndarray, slots: np.ndarray, t: int) -> np.ndarray:
        """Log probability that a neighbour at distance ``radius`` of each query lies in each bucket (slot numbers)."""
        y, scale = self.project(q, t), (np.maximum(radius, 1e-12) / self.width)[:, None]
        out = np.zeros((len(q), len(slots)))
        for i in range(self.dims):
            each, at = np.unique(slots[:, i], return_inverse=True)
            out += _log_between((each[None, :] - y[:, i, None]) / scale, 1 / scale)[:, at.reshape(-1)]
        return out

    def visited(self, q: np.ndarray, radius: np.ndarray, slots: np.ndarray, t: int) -> list[np.ndarray]:
        """Per query the buckets, by success, that make up the table's share of what all these have."""
        out = []
        for a in range(0, len(q), 16):
            for row in self.success(q[a:a + 16], radius[a:a + 16], slots, t):
                top = row.max()
                if top == -np.inf:
                    out.append(np.zeros(0, np.int64))
                    continue
                order = np.argsort(-row, kind="stable")
                total = np.cumsum(np.exp(row[order] - top))
                out.append(order[:int(np.searchsorted(total, self.share * total[-1])) + 1])
        return out


# Logarithm of the normal tail, interpolated: its second derivative lies between -1 and 0, so the error is
# below step**2 / 8 = 1.3e-6.
_GRID = np.arange(0, 38, 1 / 320)
_LOG_TAIL = np.array([math.log(0.5 * math.erfc(z / math.sqrt(2))) for z in _GRID.tolist()])


def _tail(z: np.ndarray) -> np.ndarray:
    """Normal tail of z; 0 from 38 on, where doubles end."""
    near = np.exp(np.interp(np.abs(z), _GRID, _LOG_TAIL))
    near = np.where(np.abs(z) >= _GRID[-1], 0.0, near)
    return np.where(z < 0, 1 - near, near)


def _log_between(lo: np.ndarray, length) -> np.ndarray:
    """Log probability of a normal step from ``lo`` to ``lo + length``."""
    hi = lo + length
    # the tail farther from the query, so that small probabilities keep their digits
    lo, hi = np.where(lo + hi < 0, -hi, lo), np.where(lo + hi < 0, -lo, hi)
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(_tail(lo) - _tail(hi), 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist(), np.float64).reshape(len(col), -1)


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where("vec_id is not null and v is not null and size(v) > 0") \
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .where(F.exists(v, lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "v"])


def build_hasher(rows: DataFrame, spec: LshSpec) -> Hasher | None:
    """Radius and spread from a bounded sample: its k-th neighbour distance, no less than the full size has."""
    stats = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if stats is None:
        return None
    d, n = stats["d"], stats["count"]
    h = F.xxhash64(F.lit(spec.seed), "vec_id")
    got = rows.where(F.size("v") == d).withColumn("h", h) \
        .where(F.pmod("h", F.lit(1 << 30)) < F.lit(min(1.0, spec.sample / n) * (1 << 30))).orderBy("h", "vec_id") \
        .select("v").toArrow()
    if not got.num_rows:
        return Hasher(d, n, 1.0, 1.0, spec)
    x = _matrix(got.column("v"))
    sq = (x * x).sum(1)
    dist = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(dist, np.inf)
    near = np.sort(dist, 1)[:, min(spec.k, len(x) - 1) - 1] if len(x) > 1 else np.ones(1)
    near = near[np.isfinite(near)]
    radius = float(np.quantile(near, 0.75)) if len(near) else 1.0
    spread = float((x - x.mean(0)).std() * math.sqrt(1)) * math.sqrt(d)
    spread = spread if spread > 0 else max(radius, 1.0)
    # fewer, larger buckets where neighbours lie far apart: else a query's visits would grow with the table
    hasher = Hasher(d, n, radius, spread, spec)
    while hasher.dims > 1 and _visits_of(hasher, x[:200]) > spec.visits:
        hasher = Hasher(d, n, radius, spread, spec, hasher.dims - 1)
    return hasher


def _visits_of(hasher: Hasher, x: np.ndarray) -> float:
    """Mean number of buckets of a table that some vectors would visit."""
    most = 8 * hasher.spec.visits
    found = [hasher.perturbed(y, hasher.radius, most) for y in hasher.project(x, 0)]
    return float(np.mean([most if f is None else len(f) for f in found]))


_ENTRY = pa.schema([("t", pa.int32()), ("bucket", pa.string()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])


def _index(hasher: Hasher):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(hasher.spec.tables):
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(hasher.keys(x, t)),
                                       batch.column(0), batch.column(1)], schema=_ENTRY)

    return run


_PROBE = pa.schema([("t", pa.int32()), ("bucket", pa.string()), ("qb", pa.int64()), ("query_id", pa.int64())])


def _sequences(hasher: Hasher, most: int):
    """Buckets that each query visits, without its own one; a null bucket where they are too many."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, radius = _matrix(batch.column(1)), batch.column(3).to_numpy()
            for t in range(hasher.spec.tables):
                y, own = hasher.project(q, t), hasher.keys(q, t)
                names, of = [], []
                for i in range(len(q)):
                    found = hasher.perturbed(y[i], float(radius[i]), most)
                    keys = [None] if found is None else [
                        k for k in (",".join(map(str, row)) for row in found.tolist()) if k != own[i]]
                    names += keys
                    of += [i] * len(keys)
                take = pa.array(of, pa.int64())
                yield pa.record_batch([pa.array(np.full(len(of), t, np.int32)), pa.array(names, pa.string()),
                                       batch.column(2).take(take), batch.column(0).take(take)], schema=_PROBE)

    return run


def _own(hasher: Hasher):
    """Each query's own bucket of every table."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            for t in range(hasher.spec.tables):
                yield pa.record_batch([pa.array(np.full(len(q), t, np.int32)), pa.array(hasher.keys(q, t)),
                                       batch.column(2), batch.column(0)], schema=_PROBE)

    return run


_VISITS = "t int, bucket string, qb long, query_id long"


def _visits(hasher: Hasher, counts: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """t, bucket, qb, query_id of the occupied buckets, but for its own ones, that each of ``asked`` visits."""
    made = materialize(asked.select("query_id", "q", "qb", "radius").mapInArrow(_sequences(hasher, most), _VISITS))
    seen = made.where("bucket is not null").join(counts.select("t", "bucket"), ["t", "bucket"], "left_semi")
    many = made.where("bucket is null").select("query_id").distinct()
    if many.isEmpty():
        return seen.select("t", "bucket", "qb", "query_id")
    ranked = _ranked(hasher, counts, materialize(asked.join(many, "query_id")))
    return seen.join(many, "query_id", "left_anti").select("t", "bucket", "qb", "query_id").unionByName(ranked)


def _probe(hasher: Hasher):
    """Join of a block of a table's occupied buckets with a block of queries."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PROBE.empty_table()
        t = left.column("t")[0].as_py()
        names = np.array(left.column("bucket").to_pylist(), object)
        slots = np.array([b.split(",") for b in names]).astype(np.int64)
        seen = hasher.visited(_matrix(right.column("q").combine_chunks()), right.column("radius").to_numpy(), slots, t)
        n = [len(b) for b in seen]
        return pa.table([pa.array(np.full(sum(n), t, np.int32)), pa.array(names[np.concatenate(seen)], pa.string()),
                         pa.array(np.repeat(right.column("qb").to_numpy(), n)),
                         pa.array(np.repeat(right.column("query_id").to_numpy(), n))], schema=_PROBE)

    return run


def _ranked(hasher: Hasher, counts: DataFrame, asked: DataFrame) -> DataFrame:
    """t, bucket, qb, query_id of the occupied buckets that each of ``asked`` visits, by ranking all of them."""
    spec = hasher.spec
    blocks = -(-counts.count() // spec.bucket_block)
    groups = -(-asked.count() // spec.query_block)
    if not blocks or not groups:
        return counts.sparkSession.createDataFrame([], _VISITS)
    buckets = counts.select("t", "bucket", F.pmod(F.xxhash64("bucket"), F.lit(blocks)).alias("bb"),
                            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    every = asked.withColumn("group", F.pmod("qb", F.lit(groups)).cast("int")) \
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(spec.tables - 1)))) \
        .withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["t", "bb", "group"]
    return buckets.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(
        _probe(hasher), _VISITS)


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(qid: np.ndarray, q: np.ndarray, limit: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int):
    """The k nearest rows of v within each query's limit, by exact distance, ties to the smaller id."""
    approx = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
    approx[qid[:, None] == vid[None, :]] = np.inf
    out_q, out_v, out_s = [], [], []
    for i in range(len(qid)):
        row = approx[i]
        if len(row) > 4 * k:       # a margin far above rounding keeps every possible tie
            edge = np.partition(row, k - 1)[k - 1]
            at = np.flatnonzero(row <= edge + 1e-9 * (abs(edge) + float(q[i] @ q[i])))
        else:
            at = np.arange(len(row))
        at = at[(vid[at] != qid[i])]
        d = np.sqrt(((v[at] - q[i]) ** 2).sum(1))
        near = d <= limit[i]
        at, d = at[near], d[near]
        order = np.lexsort((vid[at], d))[:k]
        out_q.append(np.full(len(order), qid[i]))
        out_v.append(vid[at][order])
        out_s.append(d[order])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _rank(spec: LshSpec):
    """Join of one bucket part with the queries that visit it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _BEST.empty_table()
        vid = left.column("vec_id").to_numpy()
        v = _matrix(left.column("v").combine_chunks())
        qid = right.column("query_id").to_numpy()
        q = _matrix(right.column("q").combine_chunks())
        limit = right.column("limit").to_numpy()
        parts = [best_of(qid[a:a + 256], q[a:a + 256], limit[a:a + 256], vid, v, spec.k) for a in range(0, len(qid), 256)]
        return pa.table([np.concatenate([p[c] for p in parts]) for c in range(3)], schema=_BEST)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, spec: LshSpec = LshSpec(), id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``queries``."""
    spark = vectors.sparkSession
    rows = materialize(clean_vectors(vectors, id_col, vec_col))
    hasher = build_hasher(rows, spec)
    out = "query_id long, rank int, vec_id long, score double"
    if hasher is None:
        return spark.createDataFrame([], out)
    size = hasher.a.shape[2]
    rows = rows.where(F.size("v") == size)
    asked = materialize(clean_vectors(queries, id_col, vec_col).where(F.size("v") == size).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
        F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)).alias("qb"), F.lit(float("inf")).alias("limit")))
    entries = rows.mapInArrow(_index(hasher), "t int, bucket string, vec_id long, v array<double>")
    counts = materialize(entries.groupBy("t", "bucket").agg(F.count("*").alias("m"))
                         .select("t", "bucket", F.ceil(F.col("m") / spec.part).cast("int").alias("parts")))
    most = counts.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    own = asked.select("query_id", "q", "qb").mapInArrow(_own(hasher), _VISITS)
    home = materialize(_merge(_meet(entries, counts, own, asked, spec), spec))
    # no farther than the k-th found so far (a margin far above rounding), if there are k
    bound = home.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far")).where(F.col("n") >= spec.k)
    first = materialize(asked.drop("limit").join(bound, "query_id", "left").select(
        "query_id", "q", "qb", F.lit(hasher.radius).alias("radius"),
        F.coalesce(F.col("far") * (1 + 1e-9), F.lit(float("inf"))).alias("limit")))
    more = _meet(entries, counts, _visits(hasher, counts, first, most), first, spec)
    best = materialize(_merge(home.select("query_id", "vec_id", "score").union(more), spec))
    # queries with fewer than k, or whose k-th lies farther than the radius they were sent out with
    reach = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("radius"))
    late = materialize(asked.join(reach, "query_id", "left").where(
        (F.coalesce("n", F.lit(0)) < spec.k) | (F.col("radius") > hasher.radius)))
    if late.first() is not None:
        far = late.where(F.col("n") >= spec.k).drop("n")
        few = late.where(F.coalesce("n", F.lit(0)) < spec.k)
        one = (F.lit(-1).alias("t"), F.lit("").alias("bucket"))
        whole = spark.range(1).select(*one, F.lit(-(-rows.count() // spec.part)).cast("int").alias("parts"))
        # k rows are known within the radius: only what is no farther can replace one (a margin far above rounding)
        near = far.withColumn("limit", F.col("radius") * (1 + 1e-9))
        again = _meet(entries, counts, _visits(hasher, counts, far, most), near, spec)
        every = _meet(rows.select(*one, "vec_id", "v"), whole, few.select(*one, "qb", "query_id"), asked, spec)
        best = _merge(best.select("query_id", "vec_id", "score").union(again).union(every), spec)
    return best.select("query_id", "rank", "vec_id", "score")


def _meet(entries: DataFrame, counts: DataFrame, visits: DataFrame, asked: DataFrame, spec: LshSpec) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each visited bucket's parts."""
    parted = entries.join(counts, ["t", "bucket"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    visits = visits.join(counts, ["t", "bucket"])
    # queries of a bucket in blocks: a block meets every part
    many = visits.groupBy("t", "bucket").agg(F.ceil(F.count("*") / spec.query_block).cast("int").alias("blocks"))
    visits = visits.join(many, ["t", "bucket"]).withColumn("block", F.pmod("qb", F.col("blocks")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .join(asked.select("query_id", "q", "limit"), "query_id") \
        .select("t", "bucket", "part", "block", "query_id", "q", "limit")
    held = parted.join(many, ["t", "bucket"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["t", "bucket", "part", "block"]
    return held.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(
        _rank(spec), "query_id long, vec_id long, score double")


def _merge(found: DataFrame, spec: LshSpec) -> DataFrame:
    """The k best of the parts' lists, with their rank."""
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.selectExpr("query_id", "vec_id", "score",
                           "row_number() over (partition by query_id order by score, vec_id) as rank") \
        .where(F.col("rank") <= spec.k)
