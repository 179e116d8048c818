"""Token ids in a compact binary store with Simple-8b coding.

Texts are tokenized with a public tokenizer, an end id closes each document,
and ids are written in ascending document order. A shard is a Parquet file of
segments; a segment holds some whole documents:

* ``doc_ids`` and ``lengths``: the documents and their numbers of ids;
* ``words``: little-endian 64-bit words. A word is 4 bits of selector and 60
  bits of payload; selector s packs ``COUNTS[s]`` ids of ``BITS[s]`` bits,
  the first id lowest;
* ``block_ends``: after each block of ``BLOCK`` ids, the number of words so
  far, so blocks decode independently and all at once;
* ``escapes``: ids too large for 60 bits, in order. Selector 15 marks the
  place of one of them (its payload is unused).

Ids are packed greedily, all blocks of a segment in step.

Edge cases: null and empty texts give just the end id; repeated rows are
separate documents; null doc ids come first; an empty table gives an empty
store; other columns are ignored; a text of any length is one document of
one segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import PIECE, bounded, lean, row_groups, text_bytes
from tillroll.llm.pieces import PIECES, pattern_encoder

# Fixed values of the format: ids per word and bits per id of selectors 0..14.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
BLOCK = 256
SEGMENT_IDS = 1 << 18


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block_ends, escapes) of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    # bits of each id, by block; 100 marks places after the end
    need = np.full(blocks * BLOCK, 100, np.int8)
    need[:n] = np.maximum(np.frexp(ids.astype(np.float64))[1], 1)
    most = need.reshape(blocks, BLOCK)       # widest id of the next ``reach`` ids
    escaped = need[:n] > 60
    pick = np.full((blocks, BLOCK), ESCAPE, np.int8)
    reach = 1
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        while reach < c:
            step = min(reach, c - reach)
            ahead = np.full_like(most, 100)
            ahead[:, :-step] = most[:, step:]
            most = np.maximum(most, ahead)
            reach += step
        np.copyto(pick, s, where=most <= BITS[s])
    pick = pick.reshape(-1)
    # greedy walk, every block one word at a time
    cur = np.arange(blocks) * BLOCK
    stop = np.minimum(cur + BLOCK, n)
    took = np.append(COUNTS, 1)
    begins = np.zeros(blocks * BLOCK, bool)
    while len(cur):
        begins[cur] = True
        cur = cur + took[pick[cur]]
        live = cur < stop
        cur, stop = cur[live], stop[live]
    at = np.flatnonzero(begins)
    ends = np.cumsum(begins.reshape(blocks, BLOCK).sum(1)).astype(np.uint32)
    sel = pick[at]
    out = sel.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        here = np.flatnonzero(sel == s)
        first = at[here]
        for j in range(int(COUNTS[s])):
            out[here] |= ids[first + j] << np.uint64(j * int(BITS[s]))
    return out, ends, ids[escaped & begins[:n]]


def decode_ids(code: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of a run of words (a segment, or any range of its blocks with their escapes)."""
    sel = (code >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, 1)[sel]
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(start[-1]), np.uint64)
    for s in range(len(COUNTS)):
        here = np.flatnonzero(sel == s)
        if not len(here):
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[start[here] + j] = (code[here] >> np.uint64(j * int(BITS[s]))) & mask
    out[start[:-1][sel == ESCAPE]] = escapes
    return out


SEGMENT = ("shard int, seg int, doc_ids array<bigint>, lengths array<bigint>, "
           "words binary, block_ends binary, escapes binary")
_SEGMENT_ARROW = pa.schema([
    ("shard", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("block_ends", pa.binary()),
    ("escapes", pa.binary())])


def _segment(shard, seg, docs, parts):
    code, ends, escapes = encode_ids(np.concatenate(parts))
    return pa.record_batch([
        pa.array([shard], pa.int32()), pa.array([seg], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
        pa.array([code.astype("<u8").tobytes()], pa.binary()),
        pa.array([ends.astype("<u4").tobytes()], pa.binary()),
        pa.array([escapes.astype("<u8").tobytes()], pa.binary())], schema=_SEGMENT_ARROW)


def _encode(tokenizer: str, end_id: int, pieces: int, together: int):
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = pattern_encoder(tokenizer, pieces, group=together)
        seg, docs, parts, held = 0, [], [], 0
        for batch in batches:
            offsets, _ = text_bytes(batch.column(1))
            for a, b in row_groups(offsets):
                flat, ends = encoder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(flat, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
                for doc, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    docs.append(doc)
                    parts.append(ids[i:j])
                    held += j - i
                    if held >= SEGMENT_IDS:
                        yield _segment(shard, seg, docs, parts)
                        seg, docs, parts, held = seg + 1, [], [], 0
        if docs:
            yield _segment(shard, seg, docs, parts)

    return lean(run)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text", pieces: int = PIECES, together: int = PIECE) -> None:
    """Tokenize ``docs`` and write the store to ``path`` (a folder all executors share).

    ``pieces`` and ``together`` (bytes of text whose pieces are looked up
    together) trade a worker's memory for speed; the ids do not depend on them.
    """
    (bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .repartitionByRange("doc_id", F.xxhash64("text"), F.spark_partition_id())      # rows of one id may be split
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(_encode(tokenizer, end_id, pieces, together), SEGMENT).write.parquet(path))


_DOC = "shard int, seg int, doc_id long, within long, n_tokens long, ids_crc32 long"
_DOC_ARROW = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("doc_id", pa.int64()),
                        ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def segment_ids(code: bytes, escapes: bytes) -> np.ndarray:
    """All ids of a segment, as little-endian unsigned 32-bit integers."""
    return decode_ids(np.frombuffer(code, "<u8"), np.frombuffer(escapes, "<u8")).astype("<u4")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = segment_ids(row["words"], row["escapes"])
            n = np.array(row["lengths"], np.int64)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), row["lengths"])]
            m = len(crc)
            yield pa.record_batch([
                pa.array(np.full(m, row["shard"], np.int32)), pa.array(np.full(m, row["seg"], np.int32)),
                pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n),
                pa.array(crc, pa.int64())], schema=_DOC_ARROW)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    ``start`` adds the ids of earlier shards, of earlier segments of the
    shard and of earlier documents of the segment; only small totals move.
    """
    store = bounded(spark.read.schema(SEGMENT).parquet(path))
    totals = store.select("shard", "seg", F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    shards = totals.groupBy("shard").agg(F.sum("t").alias("t")).selectExpr(
        "shard", "coalesce(sum(t) over (order by shard rows between unbounded preceding "
                 "and 1 preceding), 0) as shard_start")
    segments = totals.selectExpr(
        "shard", "seg", "coalesce(sum(t) over (partition by shard order by seg rows between unbounded "
                        "preceding and 1 preceding), 0) as seg_start")
    starts = segments.join(shards, "shard")
    docs = store.select("shard", "seg", "doc_ids", "lengths", "words", "escapes").mapInArrow(lean(_read), _DOC)
    return docs.join(starts, ["shard", "seg"]).select(
        "doc_id", (F.col("shard_start") + F.col("seg_start") + F.col("within")).alias("start"),
        "n_tokens", "ids_crc32")
