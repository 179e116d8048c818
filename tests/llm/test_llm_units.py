"""Numpy parts of the corpus operators against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import decontaminate, html_extract, language_id, mixing, ngram_join, pii, token_store
from tillroll.llm.common import ALNUM_WORDS, SPACE_WORDS, text_bytes, word_counts, words

TEXT = st.text(alphabet="ab AB\t\n.é0x1€", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_match_the_patterns(texts):
    off, data = text_bytes(pa.array(texts, pa.string()))
    n = word_counts(off, data, SPACE_WORDS)
    assert n.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    w = words(off, data, ALNUM_WORDS)
    got = [data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    by_word = {}
    for h, x in zip(w.hashes.tolist(), got):
        assert by_word.setdefault(re.sub("[A-Z]", lambda m: m.group().lower(), x), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_texts_longer_than_a_piece():
    text = "word " * 300_000 + "x" * 1_500_000 + " end"
    off, data = text_bytes(pa.array(["a", text, "b"]))
    assert word_counts(off, data, SPACE_WORDS).tolist() == [1, 300_002, 1]


def test_trie_overlaps_and_sketch_bound():
    rng = np.random.default_rng(0)
    spec = ngram_join.JoinSpec()
    for _ in range(40):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(0, 2 ** 60, n, dtype=np.uint64))
        sets = []
        for _ in range(8):
            keep = base[rng.random(len(base)) < rng.uniform(0.5, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2 ** 60, int(rng.integers(1, 20)), dtype=np.uint64)])))
        need = [spec.need(len(base), len(x)) for x in sets]
        got = ngram_join.trie_overlaps(base, sets, need)
        for x, m, o in zip(sets, need, got):
            both = len(np.intersect1d(base, x))
            assert o == (both if both >= m else -1)
            assert ngram_join.differ_at_least(ngram_join.sketch(base), ngram_join.sketch(x)) <= len(base) + len(x) - 2 * both


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2 ** 64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    code, ends, escapes = token_store.encode_ids(np.array(ids, np.uint64))
    assert token_store.decode_ids(code, escapes).tolist() == ids
    assert len(ends) == -(-len(ids) // token_store.BLOCK) and (not ids or ends[-1] == len(code))
    if len(ids) > token_store.BLOCK and not len(escapes):     # a block alone
        assert token_store.decode_ids(code[ends[0]:ends[1]], escapes).tolist() == \
            ids[token_store.BLOCK:2 * token_store.BLOCK]


def test_wu_manber_finds_all_occurrences():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(6)]
    spec = decontaminate.SearchSpec(width=4, segment=7)
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 60)))) for _ in range(20)]
    rows = [(str(i), " ".join(rng.choice(vocab, m)).encode()) for i, m in enumerate([4] * 30 + [1, 2, 2, 3])]
    names, tables = decontaminate.build_tables(rows, spec)
    off, data = text_bytes(pa.array(texts))
    w = words(off, data, ALNUM_WORDS)
    got = {(last, names[i]) for t in tables for last, ids in t.matches(w, data) for i in ids}
    want, at = set(), 0
    for t in texts:
        v = t.split()
        for item, win in rows:
            p = win.decode().split()
            want |= {(at + i + len(p) - 1, item) for i in range(len(v) - len(p) + 1) if v[i:i + len(p)] == p}
        at += len(v)
    assert got == want and want


def test_splitting_tree_is_exact_and_disjoint():
    counts = np.array([5, 0, 17, 3, 40])
    leaves = [mixing.split(counts, s, 7, 3) for s in range(7)]
    assert (sum(q for _, q in leaves) == counts).all()
    for k in range(len(counts)):
        ranges = sorted((int(o[k]), int(o[k] + q[k])) for o, q in leaves if q[k])
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges]][:len(ranges)]
    sizes = [int(q.sum()) for _, q in leaves]
    assert max(sizes) - min(sizes) <= 1
    assert all((a[1] == b[1]).all() for a, b in zip(leaves, [mixing.split(counts, s, 7, 3) for s in range(7)]))


def test_targets_reshare_the_excess():
    got = mixing.targets({"b": 10, "a": 100, None: 1000})
    assert float(sum(got.values())) == 1.5 * 1110
    assert got["a"] == 200 and got["b"] == 20 and got[None] == 1665 - 220
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


PII_TEXT = st.lists(st.sampled_from(["a@b.c", "x.y@mail.example.com", "1.2.3.4", "256.1.1.1", "4242 4242 4242 4242",
                                     "4111111111111111", "+1 (017) 555-7713", "+12", "@", "a@b", " ", ".", "+", "9",
                                     "é", "-", "1.2.3.4.5", "b.c@d.e@f.g"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(PII_TEXT)
def test_base_spans_match_the_patterns(t):
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
             if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            want.append((m.start(), 2, m.end()))
    want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
             if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    assert pii.find_spans(t, None)[0] == sorted(want)


def test_dawid_skene_finds_the_reliable_labeler():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 5, 600)
    noisy = lambda q: np.where(rng.random(600) < q, truth, rng.integers(0, 5, 600))
    v = np.stack([noisy(0.95), noisy(0.9), noisy(0.3), noisy(0.8)], 1)
    post, confusion = pii.dawid_skene(v, 25)
    assert (post.argmax(1) == truth).mean() > 0.95
    right = [np.trace(c) for c in confusion]
    assert right[0] > right[3] > right[2]


PAGE = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav>'
        '<div class="ad">Buy now</div><article><h1>A &amp; B</h1><p>First  para,\n text.<br>more<p>Second one.'
        '<div class="comments"><p>Nice post</p></div></article><footer>&copy; x</footer></body></html>')


@pytest.fixture(scope="module")
def html_model():
    x, y = zip(*[html_extract.training_rows(PAGE.replace("Second one", f"Second {i}"), w)
                 for i in range(30) for w in range(4)])
    return html_extract.fit_gbt(np.concatenate(x), np.concatenate(y).astype(float), html_extract.GbtSpec())


def test_html_text(html_model):
    got = html_extract.extract_all([PAGE, None, "", "<p", "<div><div></p></span>", "<!-- x"], html_model)
    assert got[0] == "A & B\nFirst para, text. more\nSecond one."
    assert got[1:3] == ["", ""]


def test_html_choices_never_contradict(html_model):
    t = html_extract.Forest()
    html_extract.parse(PAGE, t)
    rng = np.random.default_rng(4)
    for _ in range(50):
        chosen = html_extract.decode(t, rng.normal(0, 3, len(t.tag)))
        assert all(chosen[t.parent[i]] for i in range(len(chosen)) if chosen[i] and t.parent[i] >= 0)


def test_cnn_separates_alphabets_and_pads():
    rng = np.random.default_rng(5)
    text = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(40)).encode()
    x = np.concatenate([language_id.windows(np.frombuffer(text(a), np.uint8), 256)[:1] for a in ["abcde", "vwxyz"] * 60])
    y = np.array([0, 1] * 60)
    spec = language_id.CnnSpec(epochs=40)
    net = language_id.fit(x, y, ["a", "v"], spec)
    assert (net.probabilities(x, net.pair_tables()).argmax(1) == y).mean() > 0.95
    assert language_id.windows(np.zeros(0, np.uint8), 8).shape == (1, 8)


def test_digest_of_no_spans():
    assert hashlib.sha256(pii.span_text([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_perturbed_buckets_come_best_first():
    import itertools
    import math

    from tillroll.llm import ann

    rng = np.random.default_rng(3)
    hasher = ann.Hasher(6, 12_000, 1.0, 2.0, ann.LshSpec(bucket_rows=400))
    assert hasher.dims == 3
    for radius in (0.02, 0.7, 2.5):
        y = rng.normal(size=3) * 2
        got = hasher.perturbed(y, radius, 10_000)
        slots, chance = hasher.slot_chances(y, radius)
        every = sorted(((chance[0, a] + chance[1, b] + chance[2, c], (slots[0, a], slots[1, b], slots[2, c]))
                        for a, b, c in itertools.product(range(slots.shape[1]), repeat=3)), reverse=True)
        mass = np.cumsum([math.exp(p) for p, _ in every])
        need = int(np.searchsorted(mass, hasher.share)) + 1
        assert len(got) == need and len({tuple(r) for r in got.tolist()}) == need
        by = {s: p for p, s in every}
        assert np.allclose([by[tuple(r)] for r in got.tolist()], [p for p, _ in every[:need]], rtol=1e-9)
        assert tuple(got[0]) == tuple(np.floor(y).astype(int))
        assert need == 1 or hasher.perturbed(y, radius, need - 1) is None
    z = np.linspace(-12, 37, 5_000)
    want = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
    assert np.allclose(ann._tail(z), want, rtol=3e-6, atol=0)


def test_rows_out_of_the_search_follow_the_queries():
    from tillroll.llm import ann

    x = np.random.default_rng(5).normal(size=(300, 4))
    q, limit = x[:3], np.array([np.inf, 0.4, 0.0])
    qid, vid, score = ann.best_of(np.arange(3), q, limit, np.arange(300), x, 10)
    assert (np.bincount(qid, minlength=3)[0], np.bincount(qid, minlength=3)[2]) == (10, 0)
    d = np.sqrt(((x - x[1]) ** 2).sum(1))
    assert set(vid[qid == 1]) == set([i for i in np.argsort(d) if i != 1 and d[i] <= 0.4][:10])


def test_spans_meet_like_a_plain_search():
    rng = np.random.default_rng(7)
    for _ in range(200):
        spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 8), rng.integers(1, 6, 8))]
        union = pii.Spans(spans)
        kept = []
        free = pii.Spans()
        for s, e in [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 20), rng.integers(1, 6, 20))]:
            assert union.meets(s, e) == any(a < e and s < b for a, b in spans)
            assert free.meets(s, e) == any(a < e and s < b for a, b in kept)
            if not free.meets(s, e):
                free.add(s, e)
                kept.append((s, e))


def test_pii_time_is_linear():
    import time

    def seconds(n):
        text = " ".join(f"a{i}@b.org (0{i % 10}) 555 {1000 + i}" for i in range(n))
        begin = time.process_time()
        pii.candidates(text)
        return time.process_time() - begin

    assert seconds(20_000) < 25 * max(seconds(2_000), 0.01)


def test_shift_table_grows_with_the_patterns():
    rng = np.random.default_rng(2)
    patterns = {b" ".join(b"w%d" % x for x in row): [0] for row in rng.integers(0, 10 ** 6, (20_000, 10))}
    search = decontaminate.WuManber(patterns, 10, decontaminate.SearchSpec())
    assert len(search.shift) >= 4 * 20_000 * 9 and (search.shift == 0).mean() < 0.05 and search.shift.max() == 9
    text = "x y " + next(iter(patterns)).decode() + " z"
    off, data = text_bytes(pa.array([text]))
    assert [last for last, _ in search.matches(words(off, data, ALNUM_WORDS), data)] == [11]


def test_license_phrasings_that_training_did_not_see():
    from tillroll.llm import license_scan

    ordinary = [f"the {a} of this {b} was found near the {c}" for a in ("sea", "house", "road", "wood") for b in ("day", "text", "war")
                for c in ("river", "old gate", "hill")]
    model = license_scan.fit(ordinary, license_scan.LicenseSpec(copies=20, epochs=16))
    assert model.held_out["precision"] >= 0.8 and model.held_out["recall"] >= 0.5
