"""Alignment of the tokens that two tokenizers make of the same texts.

Both tokenizers see a space and the text. Token ends are segmented cumulative
sums of token byte lengths. Where ends of both fall together (an Acero hash
join on document and end) a group closes. Each stretch between neighbouring
ends of either kind lies in one token of each side, so the stretches are the
links: the pairs of tokens whose bytes overlap. How often an id pair is linked
is counted a batch at a time with ``Table.group_by``; Spark adds the partial
counts up.

Tokens are written once to the shared folder and read twice, for the counts
and for the report. The report looks counts up in a sent table. That holds
the most frequent pairs, at most ``AlignSpec.sent`` of them; the links of all
rarer pairs, none of them hot, are joined with their counts by a shuffle.

Edge cases: null and empty texts, and texts that a tokenizer does not keep
byte by byte, have no tokens (all numbers 0, an empty digest); repeated rows
count once each; of equally frequent pairs of an id all are best; an empty
table gives an empty result; kept columns come back in ``row_``, so names
cannot clash; a text of any length is one row.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bounded, materialize
from tillroll.llm.pieces import pattern_encoder, sentence_encoder
from tillroll.session import checkpoint_dir


@dataclass(frozen=True)
class AlignSpec:
    """Files of the tokenizers, and bounds that trade memory for speed (results don't depend on them)."""

    a_path: str                  # byte-level BPE of the tokenizers library
    b_path: str                  # sentence pieces
    pieces: int = 60_000         # kept pieces of a generation, of each tokenizer
    sent: int = 2_000_000        # id pairs whose counts are sent to the workers
    held: int = 500_000          # distinct pairs that a task holds before it passes them on


def byte_level_bytes(encoder) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary.

    Its entries write a byte as a visible character: itself if it is one in
    Latin-1, else the next unused code point from 256 on.
    """
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    char = {chr(b): b for b in visible}
    char.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(visible)))
    vocab = encoder.tokenizer.tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(char[c] for c in entry) if all(c in char for c in entry) else entry.encode()
    return out


class _Side:
    """One tokenizer: its encoder, the bytes and the byte length of each id."""

    def __init__(self, encoder, entries: list[bytes]):
        self.encoder = encoder
        self.bytes = pa.array(entries, pa.large_binary())
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.width = np.dtype("<u2" if len(entries) <= 1 << 16 else "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids, offsets of each text's ids, and the joined token bytes of each text."""
        flat, ends = self.encoder.encode(texts)
        joined = self.bytes.take(pa.array(flat))
        at = np.concatenate([[0], np.cumsum(self.lengths[flat])])[ends]
        whole = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(at), joined.buffers()[2] or pa.py_buffer(b"")])
        return flat, ends, whole


_SIDES: dict[AlignSpec, tuple[_Side, _Side]] = {}          # per Python worker


def sides(spec: AlignSpec) -> tuple[_Side, _Side]:
    if spec not in _SIDES:
        a = pattern_encoder(spec.a_path, spec.pieces, plain_special=True)
        b = sentence_encoder(spec.b_path, spec.pieces)
        _SIDES[spec] = _Side(a, byte_level_bytes(a)), _Side(b, b.tokenizer.bytes)
    return _SIDES[spec]


def _packed(flat: np.ndarray, ends: np.ndarray, keep: np.ndarray, width: np.dtype) -> pa.Array:
    """Ids of each text as little-endian bytes."""
    counts = np.diff(ends)
    if not keep.all():
        flat, counts = flat[np.repeat(keep, counts)], np.where(keep, counts, 0)
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * width.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets),
                                                                  pa.py_buffer(flat.astype(width))])


def packed_tokens(texts: pa.Array, spec: AlignSpec) -> tuple[pa.Array, pa.Array]:
    """Packed ids of both tokenizers; none where a tokenizer loses or changes bytes of the text."""
    texts = texts.cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, ""),
                                         pa.scalar("", pa.large_string()))
    raw = spaced.cast(pa.large_binary())
    a, b = (side.encode(spaced) for side in sides(spec))
    keep = pc.and_(pc.greater(pc.binary_length(raw), 1), pc.and_(pc.equal(a[2], raw), pc.equal(b[2], raw)))
    keep = keep.to_numpy(zero_copy_only=False)
    return tuple(_packed(x[0], x[1], keep, side.width) for x, side in zip((a, b), sides(spec)))


def id_lists(col: pa.Array, width: np.dtype) -> pa.Array:
    """A column of packed ids as lists, over the same buffers."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1] // width.itemsize
    ids = np.frombuffer(col.buffers()[2] or b"", width)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flattened values of a list column and the offsets of its rows."""
    offsets = col.offsets.to_numpy()
    return col.flatten().to_numpy().astype(np.int64), offsets.astype(np.int64) - offsets[0]


class Aligned:
    """Links and groups of some documents, given the packed tokens of both sides."""

    def __init__(self, a: pa.Array, b: pa.Array, spec: AlignSpec):
        left, right = sides(spec)
        self.a, self.a_rows = _flat(id_lists(a, left.width))
        self.b, self.b_rows = _flat(id_lists(b, right.width))
        # both sides cover the same bytes, so running sums over the batch agree at each document's end
        self.a_ends, self.b_ends = np.cumsum(left.lengths[self.a]), np.cumsum(right.lengths[self.b])
        size = int(self.a_ends[-1]) if len(self.a_ends) else 0
        at_a, at_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        at_a[self.a_ends] = True
        at_b[self.b_ends] = True
        ends = np.flatnonzero(at_a | at_b)
        # the token of a stretch: as many of its side end before the stretch does
        self.link_a = (np.cumsum(at_a) - at_a)[ends]
        self.link_b = (np.cumsum(at_b) - at_b)[ends]
        bytes_to = np.concatenate([[0], self.a_ends])[self.a_rows]
        self.link_rows = np.searchsorted(ends, bytes_to, side="right")
        self.pairs = (self.a[self.link_a] << 32) | self.b[self.link_b]

    def cuts(self) -> np.ndarray:
        """Ends that both sides share, ascending; a group closes at each."""
        keys = [pa.table({"row": pa.array(np.repeat(np.arange(len(rows) - 1), np.diff(rows))), "end": pa.array(ends)})
                for rows, ends in ((self.a_rows, self.a_ends), (self.b_rows, self.b_ends))]
        return np.sort(keys[0].join(keys[1], ["row", "end"], join_type="inner", use_threads=False)["end"].to_numpy())

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each A token, group of each B token, and the offsets of each document's groups."""
        shared = self.cuts()
        bytes_to = np.concatenate([[0], self.a_ends])[self.a_rows]
        return (np.searchsorted(shared, self.a_ends), np.searchsorted(shared, self.b_ends),
                np.searchsorted(shared, bytes_to, side="right"))

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each link over each document's links."""
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[self.link_rows])


class _Digits:
    """Ids as decimal text with the mark that follows them."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        a, b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
        self.texts = pa.array([x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b]
                              + [x + ";" for x in b] + b, pa.large_string())

    def digests(self, found: Aligned, group_a, group_b, group_rows) -> list[str]:
        """SHA-256 of ``a1,a2|b1;...`` of each document; empty without tokens."""
        n_a, n_b = len(found.a), len(found.b)
        last_a, last_b = np.ones(n_a, bool), np.ones(n_b, bool)
        last_a[:-1] = group_a[1:] != group_a[:-1]
        last_b[:-1] = group_b[1:] != group_b[:-1]
        end = np.zeros(n_b, bool)
        ends = found.b_rows[1:][np.diff(found.b_rows) > 0] - 1
        end[ends] = True
        # A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens up to their own
        count = int(group_rows[-1]) if len(group_rows) else 0
        b_before = np.searchsorted(group_b, np.arange(count + 1))
        a_to = np.searchsorted(group_a, np.arange(count + 1), side="right")
        which = np.empty(n_a + n_b, np.int64)
        which[np.arange(n_a) + b_before[group_a]] = found.a + last_a * self.n_a
        which[np.arange(n_b) + a_to[group_b]] = 2 * self.n_a + found.b + (last_b + end.astype(np.int64)) * self.n_b
        text = self.texts.take(pa.array(which))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[:n_a + n_b + 1]
        at = offsets[found.a_rows + found.b_rows].tolist()
        data = memoryview(text.buffers()[2] or b"")
        return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]


_DIGITS: dict[AlignSpec, _Digits] = {}


def _digits(spec: AlignSpec) -> _Digits:
    if spec not in _DIGITS:
        a, b = sides(spec)
        _DIGITS[spec] = _Digits(len(a.lengths), len(b.lengths))
    return _DIGITS[spec]


def encode(docs: DataFrame, spec: AlignSpec, columns: list[str], text_col: str = "text") -> DataFrame:
    """row_ (the named columns), key_, a and b (packed ids) of every row, read back from the shared folder."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.struct(*columns).alias("row_"), F.col(text_col).alias("text_"))
    kept = rows.schema["row_"].dataType.simpleString()
    schema = f"row_ {kept}, key_ long, a binary, b binary"

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            a, b = packed_tokens(batch.column(1), spec)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(key, key + n)), a, b],
                                             ["row_", "key_", "a", "b"])
            key += n

    path = f"{checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return bounded(spark.read.parquet(path))


def pair_counts(tokens: DataFrame, spec: AlignSpec) -> DataFrame:
    """a, b, n: how many links of all documents hold the id pair."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            pairs = Aligned(batch.column(0), batch.column(1), spec).pairs
            part = pa.table({"pair": pairs, "n": np.ones(len(pairs), np.int64)})
            held.append(part.group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]))
            rows += held[-1].num_rows
            if rows >= spec.held:
                merged = _merged(held)
                if merged.num_rows >= spec.held // 2:
                    yield from _pairs(merged)
                    held, rows = [], 0
                else:
                    held, rows = [merged], merged.num_rows
        if held:
            yield from _pairs(_merged(held))

    parts = tokens.select("a", "b").mapInArrow(run, "a int, b int, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _merged(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    merged = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n_sum", "sum")])
    return merged.select(["pair", "n_sum_sum"]).rename_columns(["pair", "n_sum"])


def _pairs(table: pa.Table):
    pair = table["pair"].to_numpy()
    out = pa.table({"a": (pair >> 32).astype(np.int32), "b": (pair & 0xFFFFFFFF).astype(np.int32),
                    "n": table["n_sum"]})
    yield from out.to_batches(max_chunksize=1 << 16)


class _Counts:
    """The sent counts: sorted pairs, their counts and whether they are best for their B id."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order]

    def look(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and best mark of each link (0 if its pair was not sent), and whether it was sent."""
        coded = pa.array(pairs).dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if not len(self.pair):
            none = np.zeros(len(pairs), np.int64)
            return none, none, none.astype(bool)
        at = np.minimum(np.searchsorted(self.pair, distinct), len(self.pair) - 1)
        sent = self.pair[at] == distinct
        return np.where(sent, self.n[at], 0)[codes], (sent & self.best[at])[codes], sent[codes]


_REPORT = ("key_ long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def report(tokens: DataFrame, spec: AlignSpec) -> DataFrame:
    """row_, numbers of tokens, groups and links, best links, summed pair counts, digest of the groups."""
    spark = tokens.sparkSession
    counts = materialize(pair_counts(tokens, spec))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))           # a row an id of the vocabulary
    marked = counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    # smallest power of two whose pairs, counted at least so often, are few enough to send
    by_size = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("k")).count().collect()
    total, least = 0, 63
    for k, rows in sorted(((r["k"], r["count"]) for r in by_size), reverse=True):
        if total + rows > spec.sent:
            break
        total, least = total + rows, k
    often = F.floor(F.log2(F.col("n").cast("double"))) >= least
    table = marked.where(often).toArrow()
    pair = (table["a"].to_numpy().astype(np.int64) << 32) | table["b"].to_numpy()
    sent = spark.sparkContext.broadcast(
        _Counts(pair, table["n"].to_numpy(), table["best"].to_numpy()))
    kept = tokens.schema["row_"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = Aligned(batch.column(2), batch.column(3), spec)
            group_a, group_b, group_rows = found.groups()
            n, best, _ = sent.value.look(found.pairs)
            numbers = [np.diff(found.a_rows), np.diff(found.b_rows), np.diff(group_rows), np.diff(found.link_rows),
                       found.per_row(best), found.per_row(n)]
            digests = _digits(spec).digests(found, group_a, group_b, group_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in numbers),
                 pa.array(digests, pa.string())], ["row_", "key_", *_NAMES, "groups_sha256"])

    out = tokens.select("row_", "key_", "a", "b").mapInArrow(run, f"row_ {kept}, {_REPORT}")
    if sum(r["count"] for r in by_size) == total:
        return out.drop("key_")
    return _with_rare(out, tokens, marked.where(~often), sent, spec)


def _with_rare(out: DataFrame, tokens: DataFrame, rare: DataFrame, sent, spec: AlignSpec) -> DataFrame:
    """Adds the links whose pairs are too rare to be sent: each pair has few links, so their join has no hot key."""
    def run(batches):
        for batch in batches:
            found = Aligned(batch.column(1), batch.column(2), spec)
            links = ~sent.value.look(found.pairs)[2]
            rows = np.repeat(np.arange(batch.num_rows), np.diff(found.link_rows))[links]
            part = pa.table({"row": rows, "pair": found.pairs[links]}).group_by(
                ["row", "pair"], use_threads=False).aggregate([([], "count_all")])
            pair = part["pair"].to_numpy()
            yield from pa.table({
                "key_": batch.column(0).take(part["row"].combine_chunks()), "a": (pair >> 32).astype(np.int32),
                "b": (pair & 0xFFFFFFFF).astype(np.int32), "here": part["count_all"]}).to_batches()

    links = tokens.select("key_", "a", "b").mapInArrow(run, "key_ long, a int, b int, here long")
    more = links.join(rare, ["a", "b"]).groupBy("key_").agg(
        F.sum(F.when(F.col("best"), F.col("here")).otherwise(0)).alias("more_best"),
        F.sum(F.col("here") * F.col("n")).alias("more_sum"))
    return out.join(more, "key_", "left").select(
        "row_", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def align(tokens: DataFrame, spec: AlignSpec) -> DataFrame:
    """row_, lists of ids a and b, and the group of each A token and of each B token within its document."""
    kept = tokens.schema["row_"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = Aligned(batch.column(1), batch.column(2), spec)
            a, b = (id_lists(col, side.width) for col, side in zip(batch.columns[1:], sides(spec)))
            group_a, group_b, group_rows = found.groups()
            lists = [pa.ListArray.from_arrays(rows.astype(np.int32), pa.array(
                (group - np.repeat(group_rows[:-1], np.diff(rows))).astype(np.int32)))
                for rows, group in ((found.a_rows, group_a), (found.b_rows, group_b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), a, b, *lists], ["row_", "a", "b", "a_group", "b_group"])

    return tokens.select("row_", "a", "b").mapInArrow(
        run, f"row_ {kept}, a array<int>, b array<int>, a_group array<int>, b_group array<int>")
