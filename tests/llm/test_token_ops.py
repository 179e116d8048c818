"""Token alignment, importance resampling and packing against plain Python versions."""

import base64
import bisect
import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm import alignment, packing, pieces, queries, resample
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SPEC = alignment.AlignSpec(BYTE, PIECE)
SCHEMA = "doc_id long, text string, a string, b string, key_ string, row_ string, start string, ids string, rank string"

TRICKY = ["", " ", "  ", "a  b", "a b\n", "\n\nx", "don't 's x's", "it's.'s <|endoftext|> a", "x<|startoftext|>y",
          "　a b  c", "é\ńa", "a. b, c! 'tis ''s", "\ta \tb", "a\x85b \x85 c", "\x00 a", "１２ 3４", "中 文\n中", "▁ a▁b",
          "<s>x</s> <0x41>", "a | b ||c", "ﬁ x İ ß́", "don 't\n's", "a b   c  d", "́x ́y"]
MARKS = st.sampled_from(list("ab'sSt.,\n \t!|<>é́　中１9\x1c\x85 ﬁİß▁") + ["<|endoftext|>", " the", " to "])
TEXTS = st.lists(MARKS, max_size=14).map("".join)


def odd_rows():
    base = " ".join(f"word{i % 7}" for i in range(60))
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base), (5, " \n\t"), (6, "x" * 100_000),
             (7, base * 60), (8, None), (9, "One two, three"), (10, "12 34 !! a▁b"), (11, base + " extra")]
    return [(i, t, "a", "b", None, "r", "s", "i", "k") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


# --- pieces -----------------------------------------------------------------

@functools.cache
def plain_tokenizer(path, plain):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    return tok


def same_ids(texts):
    for path in (BYTE, WORD):
        for plain in (False, True):
            tok = plain_tokenizer(path, plain)
            flat, ends = pieces.pattern_encoder(path, plain_special=plain).encode(pa.array(texts, pa.string()))
            got = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
            assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    sp = pieces.sentence_encoder(PIECE).tokenizer.sp
    texts = [t for t in texts if t]
    flat, ends = pieces.sentence_encoder(PIECE).encode(pa.array([" " + t for t in texts]))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    same_ids(texts)


def test_pieces_of_tricky_texts_and_documents(spark):
    same_ids(TRICKY + [None])
    same_ids([r["text"] for r in table(spark, SF, "documents").collect()])


def test_few_kept_pieces_change_nothing():
    texts = [f"w{i} w{i // 3} again, and w{i % 5}" for i in range(400)]
    small = pieces.PieceEncoder(pieces.PatternTokenizer(BYTE), limit=50)
    a = [small.encode(pa.array(texts[i:i + 20]))[0].tolist() for i in range(0, 400, 20)]
    assert sum(a, []) == pieces.pattern_encoder(BYTE).encode(pa.array(texts))[0].tolist()


# --- alignment --------------------------------------------------------------

_RANKS = {int(i): base64.b64decode(b) for b, i in
          (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}


def plain_alignment(texts):
    """Per text: A ids, B ids, groups and links by nested loops over byte ranges."""
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        if not t or b"".join(_RANKS[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
            out.append(([], [], [], []))
            continue
        a_end = np.cumsum([len(_RANKS[i]) for i in a]).tolist()
        b_end = np.cumsum([len(piece(i)) for i in b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            to_a, to_b = bisect.bisect_right(a_end, end), bisect.bisect_right(b_end, end)
            groups.append((a[i:to_a], b[j:to_b]))
            i, j = to_a, to_b
        links = [(x, y) for i, x in enumerate(a)
                 for j in range(bisect.bisect_right(b_end, a_end[i - 1] if i else 0), bisect.bisect_left(b_end, a_end[i]) + 1)
                 for y in [b[j]]]
        out.append((a, b, groups, links))
    return out


def plain_report(rows):
    """rows: (doc_id, text); the expected result rows."""
    found = plain_alignment([t for _, t in rows])
    count = Counter(link for f in found for link in f[3])
    most = defaultdict(int)
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def report(docs, spec=SPEC):
    got = alignment.report(alignment.encode(docs, spec, ["doc_id"]), spec)
    return sorted((tuple(r["row_"]) + tuple(r)[1:] for r in got.collect()), key=key)


def test_alignment_of_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert report(odd) == sorted(plain_report(rows), key=key)
    assert report(odd.limit(0)) == []
    assert report(odd.where("text is null")) == [(3, 0, 0, 0, 0, 0, 0, ""), (8, 0, 0, 0, 0, 0, 0, "")]
    marked = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    assert report(marked) == plain_report(list(enumerate(TRICKY)))


def test_alignment_query_on_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, queries.op11_token_alignment(spark, SF).collect()), key=key)
    assert got == sorted(plain_report(rows), key=key)


@pytest.mark.parametrize("sent", [0, 100, 3_000])
def test_counts_too_many_to_send_give_the_same_report(spark, sent):
    docs = table(spark, SF, "documents").limit(60).unionByName(table(spark, SF, "documents").limit(3))
    few = alignment.AlignSpec(BYTE, PIECE, sent=sent, held=500)
    assert report(docs, few) == report(docs)


def test_alignment_lists(spark):
    docs = table(spark, SF, "documents").limit(20)
    got = {r["row_"]["doc_id"]: r for r in alignment.align(alignment.encode(docs, SPEC, ["doc_id"]), SPEC).collect()}
    rows = docs.collect()
    for row, (a, b, groups, _) in zip(rows, plain_alignment([r["text"] for r in rows])):
        r = got[row["doc_id"]]
        assert (r["a"], r["b"]) == (a, b)
        assert r["a_group"] == [g for g, (x, _) in enumerate(groups) for _ in x]
        assert r["b_group"] == [g for g, (_, y) in enumerate(groups) for _ in y]


# --- resampling -------------------------------------------------------------

def plain_resample(docs, target, runs=1, buckets=10_000, percent=10, least=20):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets
                        for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    sums = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sums[0] + buckets) / ((s[b] + 1) * (sums[1] + buckets))))
            for b in range(buckets)]
    out = []
    for (i, _), (n_words, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                    n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=key)


def drawn(docs, target, spec):
    gain = resample.gains(resample.bucket_counts(docs, spec), resample.bucket_counts(target, spec))
    got = resample.resample(resample.weigh(docs, gain, spec, ["doc_id"]), spec)
    return sorted(map(tuple, got.select("row_.doc_id", "n_features", "weight", "score", "rank").collect()), key=key)


@pytest.mark.parametrize("runs,buckets,percent,least", [(1, 10_000, 10, 20), (3, 500, 40, 1), (2, 50, 100, 0)])
def test_resample(spark, odd, runs, buckets, percent, least):
    spec = resample.ResampleSpec(runs=runs, buckets=buckets, percent=percent, least_words=least)
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    for docs in (table(spark, SF, "documents"), odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = plain_resample(rows, target, runs, buckets, percent, least)
        assert drawn(docs, table(spark, SF, "benchmark"), spec) == want
    assert drawn(odd.limit(0), odd, spec) == []
    empty_target = plain_resample([(r[0], r[1]) for r in odd_rows()], [], runs, buckets, percent, least)
    assert drawn(odd, odd.limit(0), spec) == empty_target


def test_cutoff_among_ties_and_with_a_coarse_sketch(spark):
    rows = [(i, (i * 37) % 11 if i % 3 else 5) for i in range(3_000)] + [(7, 5)] * 1_500
    pool = spark.createDataFrame([((i,), 1, 0, s) for i, s in rows],
                                 "row_ struct<doc_id: long>, n_features long, weight long, score long")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for accuracy in (3, 100):
        spec = resample.ResampleSpec(accuracy=accuracy)
        for k in (1, 2, 700, 1_999, 2_500, 4_499, 4_500):
            got = resample.cutoff(pool, k, len(rows), spec, "row_.doc_id")
            assert (got["row_"]["doc_id"], got["score"]) == want[k - 1]


def test_equal_rows_at_the_cutoff_keep_the_count(spark):
    docs = spark.createDataFrame([(1, "word " * 30)] * 1_000, "doc_id long, text string")
    ranks = [r[4] for r in drawn(docs, docs, resample.ResampleSpec())]
    assert sorted(r for r in ranks if r) == list(range(1, 101)) and ranks.count(None) == 900


# --- packing ----------------------------------------------------------------

def plain_first_fit(lengths, size):
    rooms, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((k for k, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(size)
        rooms[at] -= lengths[i]
        out[i] = at
    return [out[i] for i in range(len(lengths))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([0.0, 0.01, 0.2, 1.0]))
def test_pack_group(lengths, waste):
    lens = np.array(lengths, np.int64)
    place = packing.first_fit_decreasing(lens, 64)
    assert place.tolist() == plain_first_fit(lengths, 64)
    item, start, length, seq, offset = packing.pack_group(lens, 64, waste)
    covered = defaultdict(list)
    held = defaultdict(list)
    for i, s, n, q, o in zip(*(x.tolist() for x in (item, start, length, seq, offset))):
        covered[i].append((s, n))
        held[q].append((o, n))
    assert sorted(covered) == list(range(len(lengths)))
    for spans, want in [(covered[i], lengths[i]) for i in covered] + [(held[q], None) for q in held]:
        at = 0
        for s, n in sorted(spans):
            assert s == at and n > 0
            at += n
        assert at == want if want else at <= 64
    needed = -(-sum(lengths) // 64)
    assert len(held) == needed or len(held) == len(set(place.tolist())) and sum(lengths) >= (1 - waste) * 64 * len(held)
    if waste == 1:
        assert len(item) == len(lengths)


def check_packing(docs, got, size=2048):
    """Pieces tile documents and sequences and hold the ids of the plain tokenizer; returns sequences' fills."""
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        raw = bytes(r["ids"])
        assert len(raw) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["row_"]["doc_id"], r["doc_tokens"]].append((r["start"], raw))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    have = Counter()
    for (i, n), parts in documents.items():
        copies = sum(s == 0 for s, _ in parts)
        at, whole = 0, b""
        if copies == 1:
            for s, raw in sorted(parts):
                assert 4 * s == len(whole)
                whole += raw
            have[i, n, zlib.crc32(whole)] += 1
        else:                                     # repeated rows: equal ids, tiled in total
            assert sum(len(raw) for _, raw in parts) == 4 * n * copies
            have.update({k: want[k] for k in want if k[:2] == (i, n)})
    assert have == want
    return [sum(n for _, n in spans) for spans in sequences.values()]


def test_packing(spark, odd):
    spec = packing.PackSpec(WORD, group=30)
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fills = check_packing(rows, packing.pack(docs, spec, ["doc_id"]).collect())
    assert sum(2048 - n for n in fills) < 0.1 * sum(fills)
    fills = check_packing([(r[0], r[1]) for r in odd_rows()], packing.pack(odd, spec, ["doc_id"]).collect())
    assert len(fills) == -(-sum(fills) // 2048)
    assert packing.pack(odd.limit(0), spec, ["doc_id"]).count() == 0


def test_packing_query_on_all_documents(spark):
    got = queries.op13_packing(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in table(spark, SF, "documents").collect()}
    whole = packing.pack(table(spark, SF, "documents"), packing.PackSpec(WORD), ["doc_id"])
    want = whole.select(F.col("row_.doc_id").alias("doc_id"), "start", "length", "ids", "doc_tokens").collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(
        (r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"]) for r in want)


def test_copies_spread_over_groups(spark):
    docs = spark.createDataFrame([(i, "word " * 1_100) for i in range(200)], "doc_id long, text string")
    got = packing.pack(docs, packing.PackSpec(WORD, group=20), ["doc_id"]).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(groups) == 10 and max(groups.values()) < 100
    fills = check_packing([(i, "word " * 1_100) for i in range(200)], got)
    assert sum(2048 - n for n in fills) < 10 * 2048 and len(fills) < 200      # less than one sequence of padding a group


# --- token store ------------------------------------------------------------

def test_store_reads_back_the_ids_of_all_documents(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect())
    tok = Tokenizer.from_file(BYTE)
    want, at = [], 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op10_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
