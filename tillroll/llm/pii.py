"""Personal data by weak-supervision aggregation.

Candidates are the matches of the base patterns and of wider patterns
(written-out or bracketed separators, numbers without a country code, other
digit groups). Labelers vote on each candidate for a kind or for none:
patterns, check sums and ranges, gazetteers, context words and neighbours.
Expectation-maximisation (Dawid-Skene) estimates each labeler's confusion
matrix and the candidates' true kinds without any label; a softmax span
classifier is then trained on these posteriors, from the span's shape and
its context. Base spans always stay; a wider candidate is added where the
classifier is sure of its kind and no base span overlaps it.

The model is fitted on a documented, bounded sample (about ``sample``
documents with candidates, ``per_doc`` candidates of each).

Edge cases: null and empty texts have no spans; any text length is scanned
once per pattern, in time linear in its length; repeated rows get equal
results; an empty table gives an empty result, and without candidates only
the base patterns apply; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bounded

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)

# The base patterns (email is found from its @ sign).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)

# Wider candidates: (kind it suggests, pattern).
_WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}"
                         r"(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[(\[{](?:dot|\.)[)\]}] ?[0-9]{1,3}){3}(?![0-9])", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ ‑]| - )[0-9]{4}(?:[./_ ‑]| - )[0-9]{4}"
                        r"(?:[./_ ‑]| - )[0-9]{2,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("phone", re.compile(r"(?<![0-9+])\+ ?[0-9]{1,3}(?:[ ./ ‑()-]{1,2}[0-9]{2,5}){2,5}(?![0-9])")),
)

# Gazetteers and context words.
_TLD = frozenset("com org net edu gov io de fr es uk eu info biz int mil us ca ch at it nl be".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
         "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81",
         "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_CONTEXT = {
    "email": frozenset("mail email e-mail contact write courriel correo".split()),
    "ip": frozenset("ip host server addr address subnet gateway".split()),
    "card": frozenset("card visa mastercard amex credit debit karte tarjeta carte".split()),
    "phone": frozenset("tel phone call mobile fax cell telefon teléfono téléphone".split()),
}
_CONTEXT_NONE = frozenset("version isbn order sha token key hash id page section price".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last, True
        at = text.find("@", max(at + 1, last))


def base_matches(text: str):
    """(kind, start, end, valid) of the base patterns; valid: passes the kind's test."""
    for s, e, ok in _emails(text):
        yield 0, s, e, ok
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if len(d) > 7:
            yield 2, m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield 3, m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15


@dataclass(frozen=True)
class PiiSpec:
    sample: int = 4000
    per_doc: int = 8
    feature_bits: int = 12
    em_rounds: int = 25
    fit_rounds: int = 60
    sure: float = 0.95
    seed: int = 5


@dataclass(frozen=True)
class Candidate:
    kind: int        # the kind its pattern suggests
    start: int
    end: int
    base: bool       # from a base pattern
    valid: bool      # a base match that passes its test


class Spans:
    """A union of spans that is asked, in logarithmic time, whether another span meets it."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect.bisect_right(self.ends, s)        # the first that ends behind s
        return i < len(self.starts) and self.starts[i] < e

    def add(self, s: int, e: int) -> None:
        """Adds a span that meets none."""
        i = bisect.bisect_right(self.ends, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def candidates(text: str) -> list[Candidate]:
    """Base matches (also failing ones) and wider matches that overlap no base match."""
    out = [Candidate(k, s, e, True, ok) for k, s, e, ok in base_matches(text)]
    taken = Spans((c.start, c.end) for c in out if c.valid)
    for name, pattern in _WIDE:
        for m in pattern.finditer(text):
            s, e = m.span()
            if not taken.meets(s, e):
                out.append(Candidate(KINDS.index(name), s, e, False, False))
    return out


def _context(text: str, c: Candidate) -> list[str]:
    return re.findall(r"[^\W\d_][\w-]*", text[max(0, c.start - 40):c.start].lower())[-4:]


def votes(text: str, c: Candidate) -> list[int]:
    """One vote per labeler: a kind, NONE, or -1 to abstain."""
    s = text[c.start:c.end]
    d = _digits(s)
    name = KINDS[c.kind]
    pattern = c.kind if c.valid or not c.base else -1
    if name == "email":
        check = 0 if "." in s or "dot" in s.lower() else NONE
        gaz = 0 if re.split(r"[^a-z0-9]+", s.lower())[-1] in _TLD else -1
    elif name == "ip":
        parts = re.findall(r"[0-9]+", s)
        check = 1 if ":" in s or all(len(p) < 4 and int(p) < 256 for p in parts) else NONE
        gaz = 1 if s.startswith(("10.", "127.", "172.", "192.168.")) else -1
    elif name == "card":
        check = 2 if 14 <= len(d) <= 19 and luhn(d) else NONE
        gaz = 2 if d[:1] in "3456" and 14 <= len(d) <= 19 else -1
    else:
        check = 3 if 10 <= len(d) <= 15 else NONE
        gaz = 3 if d.startswith(_DIAL) and "+" in s else -1
    near = _context(text, c)
    context = next((KINDS.index(k) for k, w in _CONTEXT.items() if w & set(near)), -1)
    if context < 0 and _CONTEXT_NONE & set(near):
        context = NONE
    before, after = text[c.start - 1:c.start], text[c.end:c.end + 1]
    glued = NONE if (before.isalnum() or after.isalnum() or before in "\"'=#/_" and before) else -1
    return [pattern, check, gaz, context, glued]


def dawid_skene(v: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior [n, kinds + 1], confusion [labelers, true, vote]) by EM from votes [n, labelers]."""
    n, m = v.shape
    k = NONE + 1
    one = np.zeros((n, m, k))
    r, c = np.nonzero(v >= 0)
    one[r, c, v[r, c]] = 1
    post = one.sum(1) + 0.1
    post /= post.sum(1, keepdims=True)
    confusion = np.zeros((m, k, k))
    for _ in range(rounds):
        prior = (post.sum(0) + 1) / (n + k)
        confusion = np.einsum("nt,nmv->mtv", post, one) + 0.2 + 2.0 * np.eye(k)
        confusion /= confusion.sum(2, keepdims=True)
        logp = np.log(prior) + np.einsum("nmv,mtv->nt", one, np.log(confusion))
        post = np.exp(logp - logp.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return post, confusion


def span_features(text: str, c: Candidate, bits: int) -> np.ndarray:
    """Hashed shape n-grams, length, separators and context words of a candidate."""
    s = text[c.start:c.end]
    shape = "".join("9" if x.isdigit() else "a" if x.isalpha() else x for x in s[:64])
    digits = _digits(s)
    words = [f"n{min(len(digits), 20)}", f"p{KINDS[c.kind]}", f"ok{c.valid}", f"luhn{bool(digits) and luhn(digits)}",
             f"b{text[c.start - 1:c.start][:1].isalnum()}", f"a{text[c.end:c.end + 1].isalnum()}"]
    short = re.sub(r"(.)\1+", r"\1+", shape)
    words += ["s" + short[i:i + 3] for i in range(max(len(short) - 2, 1))][:24]
    words += ["c" + w for w in _context(text, c)]
    h = sorted({zlib.crc32(w.encode()) & ((1 << bits) - 1) for w in words})[:40]
    out = np.full(40, 1 << bits, np.int64)
    out[:len(h)] = h
    return out


class SpanModel:
    def __init__(self, weights: np.ndarray, confusion: np.ndarray, spec: PiiSpec):
        self.weights, self.confusion, self.spec = weights, confusion, spec

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        z = self.weights[f].sum(1)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(v: np.ndarray, f: np.ndarray, spec: PiiSpec) -> SpanModel:
    """EM on the votes, then a softmax span classifier on the posteriors."""
    post, confusion = dawid_skene(v, spec.em_rounds)
    w = np.zeros(((1 << spec.feature_bits) + 1, NONE + 1))
    past = np.full_like(w, 1e-4)
    rng = np.random.default_rng(spec.seed)
    for _ in range(spec.fit_rounds):
        order = rng.permutation(len(f))
        for a in range(0, len(order), 512):
            at = order[a:a + 512]
            z = w[f[at]].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros_like(w)
            np.add.at(g, f[at], ((post[at] - p) / len(at))[:, None, :])
            g -= 1e-5 * w
            past += g * g
            w += 0.1 * g / np.sqrt(past)
            w[-1] = 0
    return SpanModel(w, confusion, spec)


def _votes_rows(spec: PiiSpec):
    schema = pa.schema([("h", pa.int64()), ("i", pa.int32()), ("v", pa.binary()), ("f", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = candidates(text)
                pick = np.random.default_rng([abs(h)]).permutation(len(found))[:spec.per_doc]     # of all patterns
                for i, c in enumerate(found[j] for j in sorted(pick.tolist())):
                    rows.append((h, i, np.array(votes(text, c), np.int8).tobytes(),
                                 span_features(text, c, spec.feature_bits).tobytes()))
            yield pa.record_batch([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(4)],
                                  schema=schema)

    return run


def train(docs: DataFrame, text_col: str = "text", spec: PiiSpec = PiiSpec()) -> SpanModel | None:
    """Fit on a bounded sample of the documents that hold a digit or an at sign."""
    rows = bounded(docs).select(F.col(text_col).alias("text")).where(F.col("text").rlike(r"[0-9@]|(?i)[(\[{]at[)\]}]"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = rows.count()
    if not n:
        return None
    got = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(min(1.0, spec.sample / n) * (1 << 30))) \
        .dropDuplicates(["h"]).select("text", "h") \
        .mapInArrow(_votes_rows(spec), "h long, i int, v binary, f binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("h", "ascending"), ("i", "ascending")])
    v = np.frombuffer(b"".join(got.column("v").to_pylist()), np.int8).reshape(got.num_rows, -1)
    f = np.frombuffer(b"".join(got.column("f").to_pylist()), np.int64).reshape(got.num_rows, -1)
    return fit(v.astype(np.int64), f, spec)


def find_spans(text: str, model: SpanModel | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each a list of (start, kind, end) in order."""
    if not text or not _ANY.search(text):
        return [], []
    found = candidates(text)
    base = sorted((c.start, c.kind, c.end) for c in found if c.valid)
    wide = [c for c in found if not c.base]
    if not wide or model is None:
        return base, []
    p = model.probabilities(np.stack([span_features(text, c, model.spec.feature_bits) for c in wide]))
    added: list[tuple[int, int, int]] = []
    taken = Spans()
    for c, q in sorted(zip(wide, p), key=lambda x: -x[1].max()):
        k = int(q.argmax())
        if k == c.kind and q[k] >= model.spec.sure and votes(text, c)[1] == k and not taken.meets(c.start, c.end):
            taken.add(c.start, c.end)
            added.append((c.start, k, c.end))
    return base, sorted(added)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_COLS = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
         "n_added long")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()),
                     ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                     ("n_added", pa.int64())])


def scan(docs: DataFrame, model: SpanModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, added = find_spans(text.as_py() or "", model)
                n = np.bincount([k for _, k, _ in base], minlength=4).tolist() if base else [0] * 4
                rows.append((*n, hashlib.sha256(span_text(base).encode()).hexdigest(),
                             span_text(sorted(base + added)), len(added)))
            yield pa.record_batch([batch.column(0), *[pa.array([r[c] for r in rows], _SCHEMA.field(c + 1).type)
                                                      for c in range(7)]], schema=_SCHEMA)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, _COLS)
