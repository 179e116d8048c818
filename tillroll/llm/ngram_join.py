"""N-gram Jaccard self-join of documents by a distributed prefix tree.

Every document is the set of its distinct word shingles. All sets are put
into one global order: shingles in crowded hash buckets last, then by hash.
Read in that order, sets form a trie.

1. The first levels of the trie are distributed. Two sets with Jaccard
   similarity >= t share a shingle among the first ``n - ceil(t*n) + 1`` of
   each, so each set is sent, as a small row, to the subtrees of those
   shingles. Subtrees with a single set end there.
2. The pairs of a subtree with few sets are candidates. In a larger one, in blocks
   of sets of similar size, each set meets the block's medoid (the set
   nearest to the majority of their sketches) and keeps the medoid it met
   most. Bounds on the length and the remaining length prune.
3. Every set has a parity sketch of about one bit per shingle. Two sketches
   differ in at most as many bits as the sets differ in shingles, so a pair
   that differs in too many bits is no link: an exact test without the texts.
4. Candidates of one centre are checked together: their ordered sets form a
   compressed trie (sorted sequences with common-prefix lengths). A walk
   shares the overlap counted on common paths and leaves a subtree as soon
   as the remaining lengths cannot reach the required overlap.
5. Links give components. A second pass tests all pairs of sets in one
   subtree that lie in *different* components (bounds and sketches first,
   then the trie), so every link that can join two components is seen, while
   a group of thousands of near copies is never expanded into its pairs.

Equal sets are merged first. Shingles and sets are compared by 64-bit
hashes of their bytes.

Edge cases: null or blank text has an empty set and links with nothing;
fewer words than ``k`` give one shingle of the whole sequence; repeated rows
are separate rows with the same result; a null id keeps its row with a null
component and links with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import SPACE_WORDS, bounded, lean, materialize, mix, row_groups, text_bytes, words

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                  0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

# Slots of the crowding table: its size is fixed, so it may be broadcast.
CROWD_BITS = 22

# Slots by which texts are filtered before they are fetched: at most so many numbers are broadcast.
FETCH_SLOTS = 1 << 20


@dataclass(frozen=True)
class JoinSpec:
    """Shingle width and threshold ``num/den`` on intersection / union."""

    k: int = 4
    num: int = 85
    den: int = 100
    chunk: int = 256      # candidates of one centre per verification trie
    few: int = 12         # sets of a subtree whose pairs are all candidates
    block: int = 2048     # sets of a larger subtree per block

    def need(self, n: int, m: int) -> int:
        """Smallest overlap of a link between sets of n and m shingles."""
        return -(-(self.num * (n + m)) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n - (n * self.num + self.den - 1) // self.den + 1


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every document, in order."""
    for a, b in row_groups(offsets):
        w = words(offsets[a:b + 1], data, SPACE_WORDS)
        ends = np.searchsorted(w.docs, np.arange(b - a + 1))
        h = w.hashes
        m = max(len(h) - k + 1, 0)
        grams = np.zeros(m, np.uint64)
        for j in range(k):
            grams += h[j:j + m] * _MULT[j]
        grams = mix(grams)
        for i in range(b - a):
            s, e = int(ends[i]), int(ends[i + 1])
            if e - s >= k:
                yield a + i, np.unique(grams[s:e - k + 1])
            elif e > s:
                one = (h[s:e] * _MULT[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
                yield a + i, mix(np.array([one], np.uint64))
            else:
                yield a + i, np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """64-bit fingerprint of a sorted distinct set."""
    h = mix(grams * _MULT[1] + np.uint64(1))
    both = h.sum(dtype=np.uint64, keepdims=True) * _MULT[2] + np.uint64(len(grams))
    return int(mix(both ^ np.bitwise_xor.reduce(h)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the set's shingles in each of 2**b slots, b by the set's size."""
    size = 1 << max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound on the number of shingles in which two sets differ."""
    if len(x) < len(y):
        x, y = y, x
    a = _fold(int.from_bytes(x, "little"), 8 * len(x), 8 * len(y))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _crowd_slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CROWD_BITS)).astype(np.int64)


def global_order(grams: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """The set in the global order: uncrowded slots first, then by hash."""
    c = crowd[_crowd_slots(grams)]
    return grams[np.argsort(c, kind="stable")] if c.any() else grams


def order_rank(grams: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """One sortable number per shingle that follows the global order."""
    c = crowd[_crowd_slots(grams)].astype(np.uint64)
    return (c << np.uint64(59)) | (grams >> np.uint64(5))


_PROFILE = "kind int, doc_id long, th long, n long, sid long, sketch binary"
_PROFILE_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()),
                            ("n", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary())])


def _profile(spec: JoinSpec):
    """Per document: set size, set id and, once a task, its sketch (kind 0); per crowded slot: count (kind 1)."""

    def run(batches):
        counts = np.zeros(1 << CROWD_BITS, np.uint32)
        total, seen = 0, set()
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            sketches: list[bytes | None] = [None] * batch.num_rows
            n = np.zeros(batch.num_rows, np.int64)
            sid = np.zeros(batch.num_rows, np.int64)
            held = []
            for i, g in shingle_sets(offsets, data, spec.k):
                n[i] = len(g)
                if len(g):
                    sid[i] = set_id(g)
                    if sid[i] not in seen:
                        seen.add(sid[i])
                        sketches[i] = sketch(g)
                    held.append(_crowd_slots(g))
                    total += len(g)
                if len(held) >= 64:
                    np.add.at(counts, np.concatenate(held), 1)
                    held = []
            if held:
                np.add.at(counts, np.concatenate(held), 1)
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int32)), batch.column(0),
                                   batch.column(2), pa.array(n), pa.array(sid, mask=n == 0),
                                   pa.array(sketches, pa.binary())], schema=_PROFILE_ARROW)
        mean = total / len(counts)
        hot = np.flatnonzero(counts >= max(3, mean + 5 * mean ** 0.5))
        for a in range(0, len(hot), 10_000):
            part = hot[a:a + 10_000]
            yield pa.record_batch([pa.array(np.ones(len(part), np.int32)), pa.array(part),
                                   pa.nulls(len(part), pa.int64()),
                                   pa.array(counts[part].astype(np.int64)),
                                   pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())],
                                  schema=_PROFILE_ARROW)

    return lean(run)


def _crowd_table(profile: DataFrame) -> np.ndarray:
    """Crowding class 0..31 of every hash slot (log2 of the counts of busy tasks)."""
    rows = (profile.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n"))
            .toArrow())  # at most 2**CROWD_BITS rows
    crowd = np.zeros(1 << CROWD_BITS, np.uint8)
    if rows.num_rows:
        at = rows.column("doc_id").to_numpy()
        crowd[at] = np.minimum(np.log2(rows.column("n").to_numpy()).astype(np.int64) + 1, 31)
    return crowd


_POST_ARROW = pa.schema([("w", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _postings(spec: JoinSpec, crowd):
    """First levels of the trie: one row per prefix shingle of every distinct set."""

    def run(batches):
        table, seen = crowd.value, set()
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            w, sid, n, pos, held = [], [], [], [], 0
            for _, g in shingle_sets(offsets, data, spec.k):
                if not len(g) or (s := set_id(g)) in seen:
                    continue
                seen.add(s)
                p = spec.prefix(len(g))
                w.append(global_order(g, table)[:p])
                sid.append(np.full(p, s, np.int64))
                n.append(np.full(p, len(g), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
                held += p
                if held > 200_000:
                    yield _post_batch(w, sid, n, pos)
                    w, sid, n, pos, held = [], [], [], [], 0
            if held:
                yield _post_batch(w, sid, n, pos)

    return lean(run)


def _post_batch(w, sid, n, pos):
    return pa.record_batch([pa.array(np.concatenate(w).view(np.int64)), pa.array(np.concatenate(sid)),
                            pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))],
                           schema=_POST_ARROW)


_SHARED = "w long, sid long, n int, pos int, blk int, other long"
_SHARED_ARROW = pa.schema([*_POST_ARROW, ("blk", pa.int32()), ("other", pa.int64())])


def _shared_rows(batches):
    """Rows of subtrees with two or more sets, without repeats (input sorted by w, n, sid).

    The last row of a batch waits for the next one, which may continue its
    subtree.
    """
    cols = ["w", "sid", "n", "pos"]
    last = None  # the pending last row and whether its subtree is known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        v = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in cols}
        if last is not None:
            v = {c: np.concatenate([last[0][c], v[c]]) for c in cols}
        first = np.ones(len(v["w"]), bool)
        first[1:] = (v["w"][1:] != v["w"][:-1]) | (v["sid"][1:] != v["sid"][:-1])
        v = {c: x[first] for c, x in v.items()}
        same = v["w"][1:] == v["w"][:-1]
        shared = np.zeros(len(v["w"]), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= last is not None and last[1]
        last = ({c: x[-1:] for c, x in v.items()}, bool(shared[-1]))
        yield zip(*(v[c][:-1][shared[:-1]].tolist() for c in cols))
    if last is not None and last[1]:
        yield zip(*(last[0][c].tolist() for c in cols))


def _shared(spec: JoinSpec):
    """Split shared subtrees: the pairs (sid, other) of a small one that the bounds allow, else rows in blocks."""

    def batch_of(out):
        return pa.record_batch([pa.array([r[c] for r in out], _SHARED_ARROW.field(c).type) for c in range(6)],
                               schema=_SHARED_ARROW)

    def run(batches):
        now, begun, count, out, seen = None, [], 0, [], set()

        def close():
            for i, (w, s, n, p) in enumerate(begun):
                for _, s2, n2, p2 in begun[:i]:
                    need = spec.need(n, n2)
                    pair = (min(s, s2), max(s, s2))
                    if n2 >= need and min(n - p, n2 - p2) >= need and pair not in seen:
                        seen.add(pair)
                        out.append((w, pair[0], n, p, 0, pair[1]))

        for rows in _shared_rows(batches):
            for row in rows:
                if row[0] != now:
                    close()
                    now, begun, count = row[0], [row], 1
                    continue
                count += 1
                if count <= spec.few:
                    begun.append(row)
                else:
                    out += [(*r, 0, None) for r in begun]
                    begun = []
                    out.append((*row, (count - 1) // spec.block, None))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
            if len(seen) > 500_000:    # only spares repeats
                seen.clear()
        close()
        yield batch_of(out)

    return lean(run)


_PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _fold(x: int, size: int, to: int) -> int:
    """A parity sketch of ``size`` slots on ``to`` slots."""
    while size > to:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return x


def medoid(sketches: list[bytes]) -> int:
    """The set whose sketch is nearest to the bitwise majority of all."""
    size = min(map(len, sketches))
    bits = np.stack([np.unpackbits(np.frombuffer(
        _fold(int.from_bytes(x, "little"), 8 * len(x), 8 * size).to_bytes(size, "little"), np.uint8))
        for x in sketches])
    return int((bits != (2 * bits.sum(0) > len(bits))).sum(1).argmin())


def _medoid_pairs(spec: JoinSpec):
    """Each set of a block with the block's medoid, if bounds and sketches allow a link.

    Input sorted by (w, blk, n, sid); a block has at most ``block`` sets.
    """

    def run(batches):
        key, rows, a, b = None, [], [], []

        def close():
            if len(rows) < 2:
                return
            n, s, p, sk = rows[medoid([r[3] for r in rows])]
            for n2, s2, p2, sk2 in rows:
                need = spec.need(n, n2)
                if s2 != s and min(n, n2) >= need and min(n - p, n2 - p2) >= need \
                        and differ_at_least(sk, sk2) <= n + n2 - 2 * need:
                    a.append(s)
                    b.append(s2)

        for batch in batches:
            for w, blk, n, s, p, sk in zip(*(batch.column(c).to_pylist()
                                             for c in ("w", "blk", "n", "sid", "pos", "sketch"))):
                if (w, blk) != key:
                    close()
                    key, rows = (w, blk), []
                rows.append((n, s, p, sk))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_ARROW)
            a, b = [], []
        close()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_ARROW)

    return lean(run)


def _cross_pairs(spec: JoinSpec):
    """Pairs of sets of different components within a block pair that pass the bounds and sketches.

    Input sorted by (w, i, j, n, sid), with columns blk, root and sketch. A
    block pair holds about ``2 * block`` sets at most.
    """

    def run(batches):
        key, held, seen = None, {}, set()
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch.column(c).to_pylist()
                         for c in ("w", "i", "j", "n", "sid", "pos", "blk", "root", "sketch")))
            for w, i, j, n, s, p, blk, root, sk in rows:
                if (w, i, j) != key:
                    key, held = (w, i, j), {}
                for other, sets in held.items():
                    if other == root:
                        continue
                    for n2, s2, p2, blk2, sk2 in sets:
                        if (i != j and blk2 == blk) or spec.den * n2 < spec.num * n:
                            continue
                        need = spec.need(n, n2)
                        if min(n - p, n2 - p2) >= need and differ_at_least(sk, sk2) <= n + n2 - 2 * need:
                            pair = (min(s, s2), max(s, s2))
                            if pair not in seen:
                                seen.add(pair)
                                a.append(pair[0])
                                b.append(pair[1])
                held.setdefault(root, []).append((n, s, p, blk, sk))
                if len(seen) > 1_000_000:
                    seen.clear()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_ARROW)

    return lean(run)


def _may_link(spec: JoinSpec):
    """Keep the pairs whose sketches allow a link."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                need = spec.need(n, m)
                keep.append(min(n, m) >= need and differ_at_least(x, y) <= n + m - 2 * need)
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([part.column("a"), part.column("b")], schema=_PAIR_ARROW)

    return lean(run)


def trie_overlaps(centre: np.ndarray, members: list[np.ndarray], need: list[int]) -> list[int]:
    """Overlap of ``centre`` with each member, or -1 once it cannot reach ``need``.

    All sequences are sorted by the global rank. Members are walked in
    lexicographic order, which is a depth-first walk of their compressed
    trie: the cumulative overlap along the path shared with the previous
    member is reused. A path is left where the members' and the centre's
    remaining lengths cannot reach the smallest overlap needed below it.
    """
    order = sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())
    out = [-1] * len(members)
    path = np.zeros(0, np.uint64)     # the sequence walked last
    seen = np.zeros(1, np.int64)      # overlap before each depth of path
    for i in order:
        x = members[i]
        m = min(len(x), len(path))
        diff = np.flatnonzero(x[:m] != path[:m])
        shared = int(diff[0]) if len(diff) else m
        if shared:  # overlap so far plus what may still come
            left = min(len(x) - shared,
                       len(centre) - int(np.searchsorted(centre, x[shared - 1], side="right")))
            if seen[shared] + left < need[i]:
                path, seen = x[:shared], seen[:shared + 1]
                continue
        spot = np.searchsorted(centre, x[shared:])
        hit = np.zeros(len(x) - shared, np.int64)
        ok = spot < len(centre)
        hit[ok] = centre[spot[ok]] == x[shared:][ok]
        seen = np.concatenate([seen[:shared], seen[shared] + np.concatenate([[0], np.cumsum(hit)])])
        path = x
        out[i] = int(seen[-1]) if seen[-1] >= need[i] else -1
    return out


def _verify(spec: JoinSpec, crowd):
    """Links of each centre; input sorted by (centre, part, role, sid), the centre's row first."""

    def check(centre, rows):
        offsets, data = text_bytes(pa.array([centre[1]] + [t for _, t in rows], pa.large_string()))
        sets = [np.sort(order_rank(g, crowd.value)) for _, g in shingle_sets(offsets, data, spec.k)]
        head, rest = sets[0], sets[1:]
        need = [spec.need(len(head), len(x)) for x in rest]
        return [sid for (sid, _), o in zip(rows, trie_overlaps(head, rest, need)) if o >= 0]

    def run(batches):
        key, centre, rows, size = None, None, [], 0
        for batch in batches:
            a, b = [], []
            cols = [batch.column(c).to_pylist() for c in ("centre", "part", "role", "sid", "text")]
            for c, part, role, sid, text in zip(*cols):
                if (c, part) != key or size > (1 << 23):
                    if rows:
                        found = check(centre, rows)
                        a += [key[0]] * len(found)
                        b += found
                    rows, size = [], 0
                if (c, part) != key:
                    key, centre = (c, part), None
                if role == 0:
                    centre = (sid, text)
                else:
                    rows.append((sid, text))
                    size += len(text)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_ARROW)
        if rows:
            found = check(centre, rows)
            yield pa.record_batch([pa.array([key[0]] * len(found), pa.int64()),
                                   pa.array(found, pa.int64())], schema=_PAIR_ARROW)

    return lean(run)


def _links(pairs: DataFrame, base: DataFrame, sets: DataFrame, spec: JoinSpec, crowd, repeated: bool) -> DataFrame:
    """Verified links among candidate pairs (a, b)."""
    texts = _texts(base, sets, pairs, repeated)
    parts = pairs.select(F.col("a").alias("centre"), F.col("b").alias("sid"))
    sizes = parts.groupBy("centre").agg(F.count("*").alias("m"))
    chunks = F.ceil(F.col("m") / spec.chunk).cast("int")
    members = (parts.join(sizes, "centre")
               .select("centre", F.pmod(F.xxhash64("sid"), chunks).cast("int").alias("part"),
                       F.lit(1).alias("role"), "sid"))
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("part"),
                           F.lit(0).alias("role"), F.col("centre").alias("sid"))
    rows = members.unionByName(centres).join(texts, "sid")
    rows = (rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "role", "sid")
            .select("centre", "part", "role", "sid", "text"))
    return rows.mapInArrow(_verify(spec, crowd), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges as (sid, root): root is the smallest id.

    Alternates large-star and small-star steps, each one aggregation and one
    join; the number of rounds is logarithmic in the longest path.
    """
    e = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).distinct()
        e = materialize(small)
        now = e.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (now["c"], now["s"]):
            break
        mark = (now["c"], now["s"])
    low = e.groupBy("u").agg(F.min("v").alias("root"))
    return low.select(F.col("u").alias("sid"), "root")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (see the module text)."""
    return rows_with_first(docs, id_col, text_col, spec).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("component_id"))


def rows_with_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row per document: doc_id, th (xxhash64 of the text), n_shingles, first: (doc_id, th) of the component's least row.

    ``first`` is null for rows without shingles or id.
    """
    spark = docs.sparkSession
    base = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    profile = materialize(base.mapInArrow(_profile(spec), _PROFILE))
    crowd = spark.sparkContext.broadcast(_crowd_table(profile))
    rows = profile.where("kind = 0").drop("kind")
    repeated = not rows.groupBy("doc_id", "th").count().where("count > 1 and doc_id is not null").isEmpty()
    # one row per set: its size, a document that has it, its sketch
    sets = materialize(
        rows.where("sid is not null and doc_id is not null").groupBy("sid")
        .agg(F.min(F.struct("doc_id", "th")).alias("d"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        .select("sid", "n", "d.doc_id", "d.th", "sketch"))

    # first levels of the trie, kept where two or more sets meet
    posts = base.where("doc_id is not null").select("text").mapInArrow(
        _postings(spec, crowd), "w long, sid long, n int, pos int")
    posts = posts.repartition("w").sortWithinPartitions("w", "n", "sid")
    shared = materialize(posts.mapInArrow(_shared(spec), _SHARED))
    sides = [sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"x{c}"))
             for c in "ab"]
    pairs = shared.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct() \
        .join(sides[0], "a").join(sides[1], "b").mapInArrow(_may_link(spec), "a long, b long")
    # rows of larger subtrees; sketches join them last, where they are compared
    held, sketches = shared.where("other is null").drop("other"), sets.select("sid", "sketch")
    met = (held.join(sketches, "sid").repartition("w", "blk").sortWithinPartitions("w", "blk", "n", "sid")
           .mapInArrow(_medoid_pairs(spec), "a long, b long").groupBy("a", "b").count())
    best = met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    first = materialize(pairs.union(best))
    first = materialize(_links(first, base, sets, spec, crowd, repeated))
    roots = components(first)

    # pairs that could join two components
    tagged = held.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    groups = tagged.groupBy("w").agg(F.max("blk").alias("top"), F.min("root").alias("lo"),
                                     F.max("root").alias("hi")).where("lo <> hi").select("w", "top")
    blocks = (tagged.join(groups, "w").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("top"))))
              .withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")))
    cross = (blocks.select("w", "i", "j", "n", "sid", "pos", "blk", "root").join(sketches, "sid")
             .repartition("w", "i", "j").sortWithinPartitions("w", "i", "j", "n", "sid")
             .mapInArrow(_cross_pairs(spec), "a long, b long").distinct())
    second = materialize(_links(materialize(cross), base, sets, spec, crowd, repeated))
    roots = components(first.union(second))

    members = sets.select("sid", "doc_id", "th").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = members.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    comps = members.join(smallest, "root").select("sid", "first")
    return (rows.join(comps, "sid", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                spec: JoinSpec = JoinSpec()) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least id (then text hash) stays.

    A row that occurs several times with one id and text stays once. Rows
    without shingles stay, as do all rows without id. Decisions are made on
    ids and text hashes alone. At most ``FETCH_SLOTS`` slots of doubtful ids
    are broadcast; a row outside them stays where it is, and only the others'
    texts move to meet the decisions.
    """
    found = rows_with_first(docs, id_col, text_col, spec)
    known = found.where("doc_id is not null").groupBy("doc_id", "th").agg(
        F.bool_or(F.expr("first.doc_id <> doc_id or first.th <> th")).alias("gone"), F.count("*").alias("n"))
    doubt = materialize(known.where("gone or n > 1").select(
        F.col("doc_id").alias("id_"), F.col("th").alias("th_"), F.coalesce("gone", F.lit(False)).alias("gone_")))
    key, th = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    slot = F.pmod(F.xxhash64(key), F.lit(FETCH_SLOTS))
    slots = F.broadcast(doubt.select(F.pmod(F.xxhash64("id_"), F.lit(FETCH_SLOTS)).alias("slot_")).distinct())
    here = (key.isNotNull()) & (slot == slots["slot_"])
    sure = docs.join(slots, here, "left_anti")
    maybe = docs.join(slots, here, "left_semi").withColumns({"key_": key, "hash_": th})
    met = maybe.join(doubt, (F.col("key_") == F.col("id_")) & (F.col("hash_") == F.col("th_")), "left")
    once = met.where("gone_ is null").select(*docs.columns)
    many = met.where("not gone_").dropDuplicates(["key_", "hash_"]).select(*docs.columns)
    return sure.unionByName(once).unionByName(many)


def _texts(base: DataFrame, sets: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """(sid, text) of one document for each set that occurs in ``pairs``; ``repeated``: some rows occur again.

    Texts are filtered by the slots of the wanted ids before they move.
    """
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    pick = sets.join(wanted, "sid").select("sid", "doc_id", "th")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FETCH_SLOTS)).alias("slot")
    slots = F.broadcast(pick.select(slot).distinct())      # at most FETCH_SLOTS numbers
    near = base.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    texts = near.join(pick, ["doc_id", "th"]).select("sid", "text")
    # a row that occurs again brings its text again; where none does, nothing is to be dropped
    return texts.dropDuplicates(["sid"]) if repeated else texts
