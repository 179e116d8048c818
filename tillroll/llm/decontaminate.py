"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive item words (a shorter item
is one window). Documents are searched as word sequences:

* blocks of two words index a shift table; a block that ends no pattern
  lets the search skip up to ``width - 1`` words;
* where the shift is zero, the hash of the last words of the window selects
  a bucket of patterns;
* the window's words are then compared directly, byte by byte.

Many positions of many texts advance together: each text is cut into
segments, one cursor per segment, and one numpy step moves all cursors.
Patterns of another length (short items) have tables of their own.

Patterns go to the executors in blocks of at most ``max_patterns`` (pattern,
item) rows, so the broadcast is bounded whatever the size of the benchmark.
With several blocks the texts are written once, with a number for each row;
they are read once per block, and only numbers, spans and items move.

Edge cases: null and empty texts have no words; repeated rows are separate
rows with equal results; equal windows count for each of their items; an
item without words is never found; a null item id counts as one item named
'null'; an empty benchmark leaves every document clean; other columns of
either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.llm.common import ALNUM_WORDS, LOWER, Words, bounded, lean, materialize, mix, row_groups, text_bytes, words

_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SearchSpec:
    width: int = 10
    block: int = 2                 # words per block of the shift table
    table_bits: int = 16           # slots of the shift table at least; it grows with the patterns
    segment: int = 128             # words per cursor
    max_patterns: int = 300_000    # (pattern, item) rows broadcast at once


def _item_windows(spec: SearchSpec):
    schema = pa.schema([("item", pa.string()), ("window", pa.binary())])

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            items = batch.column(0).to_pylist()
            for a, b in row_groups(offsets):
                w = words(offsets[a:b + 1], data, ALNUM_WORDS, hashed=False)
                at = np.searchsorted(w.docs, np.arange(b - a + 1))
                out_i, out_w = [], []
                for d in range(b - a):
                    text = [LOWER[data[s:e]].tobytes() for s, e in
                            zip(w.starts[at[d]:at[d + 1]], w.ends[at[d]:at[d + 1]])]
                    n = min(spec.width, len(text))
                    for i in range(len(text) - n + 1 if n else 0):
                        out_i.append(items[a + d])
                        out_w.append(b" ".join(text[i:i + n]))
                yield pa.record_batch([pa.array(out_i, pa.string()), pa.array(out_w, pa.binary())],
                                      schema=schema)

    return lean(run)


def pattern_table(items: DataFrame, id_col: str, text_col: str, spec: SearchSpec) -> DataFrame:
    """Distinct (item, window) rows; a window is its lower-cased words joined by one space."""
    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                        F.col(text_col).alias("text")) \
        .mapInArrow(_item_windows(spec), "item string, window binary").distinct()


class WuManber:
    """Tables for patterns of one length (in words)."""

    def __init__(self, patterns: dict[bytes, list[int]], m: int, spec: SearchSpec):
        self.m, self.spec = m, spec
        self.b = min(spec.block, m)
        texts = sorted(patterns)
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        w = words(np.concatenate([[0], ends[:-1], [len(joined)]]).astype(np.int64), data, ALNUM_WORDS)
        h = w.hashes.reshape(len(texts), m)
        # four slots a pattern block, so that few foreign blocks fall on a used slot and stop the skipping
        self.bits = max(spec.table_bits, int(4 * len(texts) * (m - self.b + 1)).bit_length())
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.uint8 if m < 256 else np.int64)
        for j in range(m - self.b + 1):     # block ends at word j + b - 1 of the pattern
            np.minimum.at(self.shift, self._slot(h[:, j:j + self.b]), self.shift.dtype.type(m - self.b - j))
        # buckets: sorted hashes of the whole window, found through its suffix hash
        suffix = self._suffix(h)
        order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[order]
        self.texts = [texts[i] for i in order]
        self.items = [patterns[t] for t in self.texts]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        h = blocks[:, 0].copy()
        for j in range(1, blocks.shape[1]):
            h = mix(h * _K + blocks[:, j])
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _suffix(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for j in range(h.shape[1]):
            out = out * _K + h[:, j]
        return mix(out)

    def positions(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Last words of windows whose suffix hash is in a bucket, by skipping."""
        n, m, b = len(hashes), self.m, self.b
        if n < m:
            return np.zeros(0, np.int64)
        stop = np.minimum(np.arange(0, n, self.spec.segment) + self.spec.segment, n)
        cur = np.arange(0, n, self.spec.segment)
        cur[0] = m - 1 if m - 1 < stop[0] else stop[0]
        found = []
        lag = np.arange(b - 1, -1, -1)
        back = np.arange(m - 1, -1, -1)
        cur[cur < m - 1] = m - 1
        live = cur < stop
        cur, stop = cur[live], stop[live]
        while len(cur):
            s = self.shift[self._slot(hashes[cur[:, None] - lag])].astype(np.int64)
            at = cur[s == 0]
            if len(at):
                at = at[docs[at] == docs[at - (m - 1)]]
                if len(at):
                    key = self._suffix(hashes[at[:, None] - back])
                    spot = np.searchsorted(self.suffix, key)
                    ok = spot < len(self.suffix)
                    ok[ok] = self.suffix[spot[ok]] == key[ok]
                    found.append(at[ok])
            cur = cur + np.maximum(s, 1)
            live = cur < stop
            cur, stop = cur[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, w: Words, data: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(last word, items) of every occurrence, confirmed on the words themselves."""
        for last in self.positions(w.hashes, w.docs):
            first = last - self.m + 1
            text = b" ".join(LOWER[data[s:e]].tobytes() for s, e in
                             zip(w.starts[first:last + 1], w.ends[first:last + 1]))
            key = self._suffix(w.hashes[None, first:last + 1])
            spot = int(np.searchsorted(self.suffix, key[0]))
            while spot < len(self.suffix) and self.suffix[spot] == key[0]:
                if self.texts[spot] == text:
                    yield int(last), self.items[spot]
                    break
                spot += 1


def build_tables(rows: list[tuple[str, bytes]], spec: SearchSpec) -> tuple[list[str], list[WuManber]]:
    """Item names and one search table per pattern length."""
    names = sorted({item for item, _ in rows})
    index = {name: i for i, name in enumerate(names)}
    by_len: dict[int, dict[bytes, list[int]]] = {}
    for item, window in rows:
        by_len.setdefault(window.count(b" ") + 1, {}).setdefault(window, []).append(index[item])
    return names, [WuManber(p, m, spec) for m, p in sorted(by_len.items())]


_SPANS = "array<struct<s: bigint, e: bigint>>"


def _scan(tables, spec: SearchSpec, schema: pa.Schema, every: bool = True):
    """Words, hit spans and items of each row in this block of patterns; without ``every`` of rows with a hit only.

    The first column stays as it is, the second is the text.
    """

    def run(batches):
        names, searches = tables.value
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for a, b in row_groups(offsets):
                w = words(offsets[a:b + 1], data, ALNUM_WORDS)
                n_words[a:b] = np.bincount(w.docs, minlength=b - a)
                first = np.searchsorted(w.docs, np.arange(b - a))
                for search in searches:
                    for last, ids in search.matches(w, data):
                        d = int(w.docs[last])
                        e = int(last - first[d]) + 1
                        spans[a + d].append((e - search.m, e))
                        items[a + d].update(names[i] for i in ids)
            out = pa.record_batch([
                batch.column(0), pa.array(n_words),
                pa.array([[{"s": s, "e": e} for s, e in _merge(v)] for v in spans], schema.field("spans_").type),
                pa.array([sorted(v) for v in items], pa.list_(pa.string()))], schema=schema)
            yield out if every else out.filter(pa.array([bool(v) for v in spans], pa.bool_()))

    return lean(run)


def _together(schema: pa.Schema):
    """One row of the spans and items that several blocks found."""

    def run(batches):
        for batch in batches:
            spans = [_merge([(x["s"], x["e"]) for part in v for x in part]) for v in batch.column("spans_").to_pylist()]
            items = [sorted({x for part in v for x in part}) for v in batch.column("items_").to_pylist()]
            yield pa.record_batch([
                batch.column("key_"), batch.column("n_words_"),
                pa.array([[{"s": s, "e": e} for s, e in v] for v in spans], schema.field("spans_").type),
                pa.array(items, pa.list_(pa.string()))], schema=schema)

    return lean(run)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       spec: SearchSpec = SearchSpec()) -> DataFrame:
    """Every row's ``keep`` columns (struct row_), n_words_, spans_ (hit words, merged) and items_."""
    spark = docs.sparkSession
    patterns = materialize(pattern_table(items, item_id, item_text, spec))
    blocks = max(-(-patterns.count() // spec.max_patterns), 1)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    base = bounded(docs).select(kept.alias("row_"), F.col(text_col).alias("text_"))

    def tables(k: int):
        part = patterns if blocks == 1 else patterns.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k)
        rows = part.toArrow()
        return spark.sparkContext.broadcast(build_tables(
            list(zip(rows.column("item").to_pylist(), rows.column("window").to_pylist())), spec))

    found = f"n_words_ long, spans_ {_SPANS}, items_ array<string>"
    if blocks == 1:
        out = base.select("row_", F.lit(0).cast("long").alias("n_words_"), F.array().cast(_SPANS).alias("spans_"),
                          F.array().cast("array<string>").alias("items_"))
        return base.mapInArrow(_scan(tables(0), spec, to_arrow_schema(out.schema)), out.schema)
    rows = materialize(base.withColumn("key_", F.monotonically_increasing_id()))
    parts = None
    for k in range(blocks):
        empty = spark.createDataFrame([], f"key_ long, {found}")
        sent = tables(k)
        # the first block has a row for every text, with its number of words
        part = materialize(rows.select("key_", "text_").mapInArrow(
            _scan(sent, spec, to_arrow_schema(empty.schema), every=k == 0), empty.schema))
        sent.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("key_").agg(F.max("n_words_").alias("n_words_"), F.collect_list("spans_").alias("spans_"),
                                       F.collect_list("items_").alias("items_"))
    return rows.select("key_", "row_").join(
        merged.mapInArrow(_together(to_arrow_schema(empty.schema)), empty.schema), "key_").drop("key_")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of each row of ``find_contamination``."""
    hit = F.aggregate("spans_", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        "*", hit.alias("n_hit"), F.size("items_").cast("long").alias("n_items"),
        F.sha2(F.array_join("items_", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
