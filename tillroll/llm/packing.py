"""Packing of token ids into sequences of a fixed size.

A document's ids and its end id are cut into pieces of ``size`` ids and a
rest. Full pieces are sequences of their own. Rests are dealt at random into
groups of about ``group`` documents. Within a group, longer rests go first
and each to the first sequence with room (first-fit decreasing); a tournament
tree over the room of the sequences finds it in logarithmic time. Where the
groups' lengths do not fit each other and more than ``waste`` of the space
would be padding, the emptiest sequences are dissolved and their pieces cut
to fill the others, so a group has as few sequences as its ids need.

Groups are drawn by a row's place in the tokenized table, which is written
once, so a third of all rows being copies of one still spreads evenly, and a
task that runs again deals the same groups.

Edge cases: null and empty texts give just the end id; repeated rows are
documents of their own; null ids are kept; an empty table gives no
sequences; kept columns come back in ``row_``, so names cannot clash; a text
of any length is cut.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import PIECE, bounded, row_groups, text_bytes
from tillroll.llm.pieces import PIECES, pattern_encoder
from tillroll.session import checkpoint_dir


@dataclass(frozen=True)
class PackSpec:
    tokenizer: str
    end_id: int = 1
    size: int = 2048
    group: int = 2048            # documents of a group, on average
    waste: float = 0.005         # share of padding that cuts documents instead
    seed: int = 7
    pieces: int = PIECES         # kept pieces of the tokenizer's generations
    text_bytes: int = 4 * PIECE  # text whose pieces are looked up together


FULL = 1 << 62                   # ids of sequences that are one full piece start here


class Tournament:
    """Room of sequences in a tree of maxima; finds the first sequence with enough room."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(n - 1, 0).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Takes ``length`` from the first leaf with that much room and returns its number."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < length:
                at += 1
        leaf = at - self.leaves
        tree[at] -= length
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left > right else right
            if tree[at] == best:
                break
            tree[at] = best
        return leaf


def first_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """Sequence of each length; no length exceeds ``size``. Equal lengths go in the given order."""
    out = np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return out
    rooms = Tournament(len(lengths), size)
    order = np.argsort(-lengths, kind="stable")
    out[order] = [rooms.place(x) for x in lengths[order].tolist()]
    return out


def pack_group(lengths: np.ndarray, size: int, waste: float):
    """Pieces of a group as arrays: item, start in the item, length, sequence, offset in the sequence."""
    place = first_fit_decreasing(lengths, size)
    item, start, length = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), lengths.astype(np.int64)
    used = np.bincount(place, weights=length).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    total = int(used.sum())
    if total < (1 - waste) * size * len(used):
        item, start, length, place = _filled(length, place, used, size, -(-total // size))
    order = np.lexsort((start, item, -length, place))
    item, start, length, place = (x[order] for x in (item, start, length, place))
    ends = np.cumsum(length)
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    offset = ends - length
    offset -= np.repeat(offset[first], np.diff(np.append(np.flatnonzero(first), len(place))))
    return item, start, length, place, offset


def _filled(lengths, place, used, size, needed):
    """Keeps the ``needed`` fullest sequences and pours the pieces of the others into their gaps."""
    by_fill = np.argsort(-used, kind="stable")
    number = np.empty(len(used), np.int64)
    number[by_fill] = np.arange(len(used))
    seq = number[place]
    keep = seq < needed
    items = np.flatnonzero(keep)
    loose = np.flatnonzero(~keep)
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    # gaps and loose pieces laid end to end: a piece is cut where a gap ends
    gaps = size - used[by_fill[:needed]]
    gap_ends, loose_ends = np.cumsum(gaps), np.cumsum(lengths[loose])
    ends = np.union1d(gap_ends[gap_ends < loose_ends[-1]], loose_ends) if len(loose) else np.zeros(0, np.int64)
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    which = np.searchsorted(loose_ends, ends)
    cut_start = begins - (loose_ends - lengths[loose])[which]
    cut_seq = np.searchsorted(gap_ends, ends)
    return (np.concatenate([items, loose[which]]), np.concatenate([np.zeros(len(items), np.int64), cut_start]),
            np.concatenate([lengths[items], ends - begins]), np.concatenate([seq[items], cut_seq]))


def cut_documents(docs: DataFrame, spec: PackSpec, columns: list[str], text_col: str = "text") -> DataFrame:
    """row_, key_, doc_tokens, start, length and ids (little-endian 32-bit) of full pieces and rests."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.struct(*columns).alias("row_"), F.col(text_col).alias("text_"))
    kept = rows.schema["row_"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        encoder = pattern_encoder(spec.tokenizer, spec.pieces, group=spec.text_bytes)
        for batch in batches:
            offsets, _ = text_bytes(batch.column(1))
            for a, b in row_groups(offsets):
                flat, ends = encoder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(flat, ends[1:], np.uint32(spec.end_id)).astype("<u4")
                n = np.diff(ends) + 1
                pieces = -(-n // spec.size)
                row = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * spec.size
                length = np.minimum(n[row] - start, spec.size)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + a)), pa.array(np.arange(key, key + len(row))),
                     pa.array(n[row]), pa.array(start), pa.array(length), raw],
                    ["row_", "key_", "doc_tokens", "start", "length", "ids"])
                key += len(row)

    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = f"row_ {kept}, key_ long, doc_tokens long, start long, length long, ids binary"
    rows.mapInArrow(run, schema).write.parquet(path)
    return bounded(spark.read.parquet(path))


def pack(docs: DataFrame, spec: PackSpec, columns: list[str], text_col: str = "text") -> DataFrame:
    """Pieces with their ids and places: row_, doc_tokens, start, length, ids, sequence_id, offset.

    A sequence is the pieces of one sequence_id in order of offset.
    """
    pieces = cut_documents(docs, spec, columns, text_col)
    kept = pieces.schema["row_"].dataType.simpleString()
    names = ["row_", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
    full = pieces.where(F.col("length") == spec.size).select(
        "row_", "doc_tokens", "start", "length", "ids",
        (F.col("key_") + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.where(F.col("length") < spec.size)
    groups = max(1, -(-rests.count() // spec.group))
    dealt = rests.withColumn("group_", F.pmod(F.xxhash64("key_", F.lit(spec.seed)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("key_")
        length = table["length"].to_numpy()
        item, start, part, seq, offset = pack_group(length, spec.size, spec.waste)
        raw = table["ids"].to_pylist()
        ids = [raw[i][4 * s:4 * (s + n)] for i, s, n in zip(item.tolist(), start.tolist(), part.tolist())]
        taken = table.take(pa.array(item))
        base = int(table["group_"][0].as_py()) << 32
        return pa.table([taken["row_"], taken["doc_tokens"], pa.array(taken["start"].to_numpy() + start),
                         pa.array(part), pa.array(ids, pa.binary()), pa.array(base + seq), pa.array(offset)], names)

    schema = f"row_ {kept}, doc_tokens long, start long, length long, ids binary, sequence_id long, offset long"
    return full.unionByName(dealt.groupBy("group_").applyInArrow(run, schema))
