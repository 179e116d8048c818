"""Shared helpers: tables, fold rule, vectorised words of Arrow text batches.

Texts stay as UTF-8 bytes in numpy. A batch is cut into pieces of about
``WORDS_PIECE`` bytes, so memory depends on the piece and on the longest single
word, never on the batch or on the longest document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillroll.session import checkpoint_dir

PIECE = 1 << 20
BATCH_BYTES = 4 * PIECE
# Bytes whose words are found together: some ten numbers a byte are held meanwhile, two of them as long as the worker lives.
WORDS_PIECE = PIECE // 4
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# ASCII white space \x20 and \x09-\x0D separates words.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE_WORDS = ~_SPACES

# Word bytes: digits, letters and everything outside ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x41:0x5B] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(docs: DataFrame) -> DataFrame:
    """Sends texts to Python in batches of about ``BATCH_BYTES``, unless the session names another size.

    Spark's default of 64 MB a batch is held several times over in the executor and in each worker.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver, sent as Arrow.

    A list given to ``createDataFrame`` is converted by Python workers of another kind than the tasks of
    ``mapInArrow`` have; they then stay beside those in every executor.
    """
    kinds = StructType.fromDDL(ddl)
    schema = to_arrow_schema(kinds)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema), kinds)


def lean(run):
    """A task's function that gives its free memory back at the end: workers live on and serve other stages."""
    def leaner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):      # a C library without it
            pass

    return leaner


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, WORDS_PIECE + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """Words of some documents: hash, byte span and document of each word."""

    def __init__(self, hashes, starts, ends, docs):
        self.hashes, self.starts, self.ends, self.docs = hashes, starts, ends, docs


def _piece_words(data: np.ndarray, lo: int, hi: int, bounds: np.ndarray,
                 is_word: np.ndarray, hashed: bool):
    """Words of data[lo:hi], a range that cuts no word; bounds: document starts in it."""
    low = LOWER[data[lo:hi]]
    inside = is_word[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds - lo] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = bounds - lo - 1
    after[ends_at[ends_at >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not hashed:
        return None, starts + lo, ends + lo
    up, down = _POWERS.get(hi - lo)
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(h), starts + lo, ends + lo


def words(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray, hashed: bool = True) -> Words:
    """All words of the documents that ``offsets`` delimits in ``data``.

    A-Z is lower-cased for the hash. Two words have equal hashes exactly
    when their lower-cased bytes are equal, up to 64-bit collisions.
    """
    lo, end = int(offsets[0]), int(offsets[-1])
    parts = []
    starts_of_docs = offsets[:-1][offsets[1:] > offsets[:-1]]
    while lo < end:
        hi = min(lo + WORDS_PIECE, end)
        # move the cut to the end of a word or of a document
        while hi < end and is_word[data[hi - 1]] and is_word[data[hi]]:
            stop = min(hi + 4096, end)
            gaps = np.flatnonzero(~is_word[data[hi:stop]])
            limit = starts_of_docs[np.searchsorted(starts_of_docs, hi)] \
                if len(starts_of_docs) and starts_of_docs[-1] >= hi else end
            nxt = hi + int(gaps[0]) if len(gaps) else stop
            if limit <= nxt:
                hi = int(limit)
                break
            hi = nxt
        a, b = np.searchsorted(starts_of_docs, [lo, hi])
        parts.append(_piece_words(data, lo, hi, starts_of_docs[a:b], is_word, hashed))
        lo = hi
    if not parts:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z)
    starts = np.concatenate([p[1] for p in parts])
    ends = np.concatenate([p[2] for p in parts])
    hashes = np.concatenate([p[0] for p in parts]) if hashed else None
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return Words(hashes, starts, ends, docs)


def row_groups(offsets: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` text bytes (a longer document comes alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_counts(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Number of words of each document."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in row_groups(offsets):
        w = words(offsets[a:b + 1], data, is_word, hashed=False)
        out[a:b] = np.bincount(w.docs, minlength=b - a)
    return out
