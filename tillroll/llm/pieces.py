"""Token ids of whole batches of texts: each distinct piece is encoded once a batch.

A text is cut where no token can span the cut, so that its pieces encoded
apart give the ids of the whole text. The pieces of a batch are slices of
its Arrow buffer; ``dictionary_encode`` finds the distinct ones, the
tokenizer sees only those, and ``take`` puts the ids back in order. Ids of
recent pieces are kept over batches in two bounded generations: a piece in
use moves to the younger one, and when that holds ``limit`` pieces it
becomes the older one, whose pieces go.

Where a text may be cut:

* Byte-level and word-end BPE (the tokenizers library): their splitting
  pattern starts a new pre-token at a single space and at a single line feed
  between visible characters, and at an ASCII punctuation mark that follows
  an ASCII letter or digit. A text that holds the text of a special token is
  left whole unless ``plain_special`` makes those ordinary text.
* Sentence pieces: a merge needs a vocabulary entry that holds both
  neighbours, so a cut is safe wherever no entry of the vocabulary holds the
  bytes left and right of it next to each other. Pieces are encoded behind a
  line feed, which the same rule separates from whatever follows. A text with
  U+2581, the model's mark of a space, is left whole.

Null and empty texts have no ids.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillroll.llm.common import PIECE, row_groups, text_bytes

PIECES = 250_000               # kept pieces of a generation
LONG = 64                      # characters from which a piece hardly recurs and is not kept
_AT_ONCE = 4096                # an encoding holds far more than its ids
_JOINED = 256                  # pieces encoded as one text

_VISIBLE = set(range(0x21, 0x7F))
_ALNUM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)}
_BREAK = {0x20, 0x0A}
# First bytes under which Unicode has white space: a neighbour under one of them is taken for white space.
_WIDE_SPACE = {0xC2, 0xE1, 0xE2, 0xE3}


def _flags() -> np.ndarray:
    """Classes of each byte as bits."""
    out = np.zeros(256, np.uint8)
    for bit, members in ((ALNUM, _ALNUM), (PUNCT, _VISIBLE - _ALNUM), (VISIBLE, _VISIBLE), (INNER, range(0x80, 0xC0)),
                         (WIDE, _WIDE_SPACE), (BREAK, _BREAK), (STARTS, _VISIBLE | set(range(0xC3, 0x100)) - _WIDE_SPACE),
                         (FEED, {0x0A})):
        out[list(members)] |= bit
    return out


ALNUM, PUNCT, VISIBLE, INNER, WIDE, BREAK, STARTS, FEED = (1 << i for i in range(8))
_FLAGS = _flags()


def _pattern_cuts(d: np.ndarray) -> np.ndarray:
    """Places (mask over bytes) before which a text may be cut for pattern-splitting tokenizers."""
    n = len(d)
    if n < 3:
        return np.zeros(n, bool)
    f = _FLAGS[d]
    cut = np.zeros(n, np.uint8)
    cut[1:] = f[1:] & (f[:-1] << 1) & PUNCT                # a mark after a letter or digit
    # a break byte with a visible character on both sides; of that on the left the last byte is seen
    ends = f & VISIBLE
    inner = f & INNER
    if inner.any():
        wide = (f & WIDE) != 0
        inner[1:][wide[:-1]] = 0
        inner[2:][wide[:-2]] = 0
        ends |= inner
    alone = (ends[:-2] != 0) & ((f[1:-1] & BREAK) != 0) & ((f[2:] & STARTS) != 0)
    cut[1:-1] |= alone
    cut[2:] |= alone & ((f[1:-1] & FEED) != 0)
    return cut != 0


class PatternTokenizer:
    """A tokenizer of the tokenizers library whose pattern separates words and punctuation."""

    def __init__(self, path: str, plain_special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark gives each task a core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.plain = plain_special
        found = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = list(found)
        self.search = re.compile("|".join(map(re.escape, found)) or "(?!)").search
        # one special token closes a piece where many are encoded as one text
        self.mark, self.mark_id = next(iter(found.items()), (None, None))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return _pattern_cuts(data)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that must not be cut."""
        out = np.zeros(len(texts), bool)
        for s in self.special if not self.plain else []:
            out |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        if self.mark is None:
            return self._one_by_one(pieces)
        # pieces that hold a special token's text go alone
        search = self.search
        alone = [i for i, p in enumerate(pieces) if search(p)]
        out = self._marked([p for i, p in enumerate(pieces) if i not in set(alone)] if alone else pieces)
        for i, ids in zip(alone, self._one_by_one([pieces[i] for i in alone])):
            out.insert(i, ids)
        return out

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        self.tok.encode_special_tokens = self.plain
        return [array("I", e.ids).tobytes() for a in range(0, len(pieces), _AT_ONCE)
                for e in self.tok.encode_batch_fast(pieces[a:a + _AT_ONCE], add_special_tokens=False)]

    def _marked(self, pieces: list[str]) -> list[bytes]:
        self.tok.encode_special_tokens = False
        texts = [self.mark.join([*pieces[a:a + _JOINED], ""]) for a in range(0, len(pieces), _JOINED)]
        out = []
        for a in range(0, len(texts), 16):
            for e in self.tok.encode_batch_fast(texts[a:a + 16], add_special_tokens=False):
                ids = array("I", e.ids)
                ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.mark_id)
                raw, begin = ids.tobytes(), 0
                for end in (4 * ends).tolist():
                    out.append(raw[begin:end])
                    begin = end + 4
        return out


class SentencePieces:
    """A sentence-piece BPE model. Pieces hold the text behind the model's own leading space."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.sp.get_piece_size())]
        joined = np.zeros((256, 256), bool)
        for i, b in enumerate(self.bytes):
            if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)):
                b = np.frombuffer(b, np.uint8)
                joined[b[:-1], b[1:]] = True
        starts = np.zeros(256, bool)
        starts[list(_BREAK | _VISIBLE - _ALNUM)] = True
        self.apart = ~joined & starts[None, :]
        if joined[0x0A].any():
            raise ValueError("a vocabulary entry joins a line feed with what follows")

    def _bytes(self, i: int) -> bytes:
        piece = self.sp.id_to_piece(i)
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data), bool)
        cut[1:] = self.apart[data[:-1], data[1:]]
        return cut

    def whole(self, texts: pa.Array) -> np.ndarray:
        # the model writes a space as U+2581, so the two are alike to it but not to the table of bytes
        return pc.fill_null(pc.match_substring(texts, "\u2581"), False).to_numpy(zero_copy_only=False)

    def ids(self, pieces: list[str]) -> list[bytes]:
        # the guard's ids are those of the leading space and of the line feed
        return [array("I", e[2:]).tobytes() for a in range(0, len(pieces), _AT_ONCE)
                for e in self.sp.encode(["\n" + p for p in pieces[a:a + _AT_ONCE]], num_threads=1)]


class PieceEncoder:
    """Ids of texts by way of their distinct pieces."""

    def __init__(self, tokenizer: PatternTokenizer | SentencePieces, limit: int = PIECES, group: int = PIECE):
        self.tokenizer, self.limit, self.group = tokenizer, limit, group
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _look(self, pieces: list[str]) -> list[bytes]:
        known, older = self.known, self.older
        new = [p for p in pieces if p not in known]
        known.update((p, older[p]) for p in new if p in older)
        fresh = [p for p in new if p not in older]
        known.update(zip(fresh, self.tokenizer.ids(fresh)))
        out = list(map(known.__getitem__, pieces))
        for p in fresh:
            if len(p) > LONG:
                del known[p]
        if len(known) >= self.limit:
            self.known, self.older = {}, known
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32, one after the other) and the offsets (n + 1) of each text's."""
        offsets, data = text_bytes(col)
        n = len(offsets) - 1
        counts, parts = np.zeros(n, np.int64), []
        for a, b in row_groups(offsets, self.group):
            flat, ends = self._encode(offsets[a:b + 1], data, self.tokenizer.whole(col.slice(a, b - a)))
            counts[a:b] = np.diff(ends)
            parts.append(flat)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, offsets, data, whole):
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = self.tokenizer.cuts(data[lo:hi])
        for i in np.flatnonzero(whole):
            cut[offsets[i] - lo:offsets[i + 1] - lo] = False
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[begins - lo] = True
        at = np.flatnonzero(cut) + lo
        bounds = np.append(at, hi)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        ids = self._look(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        store = np.frombuffer(b"".join(ids), np.uint32)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lens)]), pa.array(store))
        flat = lists.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lens[coded.indices.to_numpy()])])
        return flat, ends[np.searchsorted(at, offsets)]


_ENCODERS: dict[tuple, PieceEncoder] = {}        # per Python worker, kept over its tasks


def pattern_encoder(path: str, limit: int = PIECES, plain_special: bool = False, group: int = PIECE) -> PieceEncoder:
    """``group``: bytes of text whose pieces are looked up together; more is faster and takes more memory."""
    key = (path, limit, plain_special, group)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(PatternTokenizer(path, plain_special), limit, group)
    return _ENCODERS[key]


def sentence_encoder(path: str, limit: int = PIECES) -> PieceEncoder:
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(SentencePieces(path), limit)
    return _ENCODERS[key]
