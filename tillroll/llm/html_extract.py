"""Main-text extraction from HTML: boosted trees over DOM nodes, decoded over the tree.

A tolerant parser builds the element tree in document order, in time linear
in the page, however many tags stay open. Each element
gets features: subtree text, text and link density, attribute tokens, depth,
sibling statistics, tag and section context. Gradient-boosted trees (numpy,
logistic loss, histogram splits) give the log-odds that the element belongs
to the article. Decoding then picks the best labelling in which no element
under a dropped one is kept (dynamic programme over the tree), so ancestor
and descendant choices never contradict.

Labels for training come from the pages' own markup (section elements and
attribute words). A part of the training copies has this markup hidden, or
gets extra boilerplate inside the article, so the trees also learn density
and position. The sample is bounded: about ``train_pages`` pages.

Edge cases: null or empty html gives an empty text; text without any markup
is one block of a page without article and is kept when nothing else is; an
unclosed or stray tag never fails, and an unclosed comment, quote, script or
the like loses no text behind it; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import bounded

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|aria-label)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())         # their content is no markup
FOREIGN = frozenset({"svg", "math"})                                  # elements in them may close themselves
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul button".split())
_RAW_END = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "button", "option", "select"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
OUT_TAGS = frozenset("nav footer aside form script style noscript template iframe svg head title button select "
                     "textarea menu dialog fieldset option".split())
# Attribute words of page furniture and of articles.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer foot form header menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promoted related reply respond share sharing sidebar side signup social sponsor sponsored "
    "subscribe tags toolbar widget widgets login search skip alert contentinfo complementary".split())
IN_WORDS = frozenset("article articlebody body content entry main post story text prose".split())
TAGS = ["p", "h1", "h2", "div", "section", "article", "main", "ul", "ol", "li", "table", "td", "nav", "header",
        "footer", "aside", "form", "script", "style", "body", "html", "head", "blockquote", "pre"]
_TAG_NO = {t: i for i, t in enumerate(TAGS)}


# Bits of what an element, or one above it, says about itself.
OUT_TAG, OUT_WORD, ARTICLE, IN_WORD, HEADER = 1, 2, 4, 8, 16


class Forest:
    """Elements of some pages in document order; text runs grouped into blocks.

    Every page has a root element of its own, with parent -1.
    """

    def __init__(self):
        self.roots: list[int] = []
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []            # one past the last descendant
        self.says: list[int] = []           # bits of the element itself
        self.path: list[int] = []           # bits of the element and all above
        self.order: list[int] = []          # place among its siblings
        self.kids: list[int] = []
        self.own: list[int] = []            # characters of own text
        self.link: list[int] = []           # of these, inside links
        self.stops: list[int] = []          # sentence marks in own text
        self.runs: list[list[tuple[int, int, str]]] = []   # per page: (element, block number, text)


def _says(tag: str, attrs: str) -> int:
    bits = OUT_TAG if tag in OUT_TAGS else ARTICLE if tag in ("article", "main") else HEADER * (tag == "header")
    if attrs and ("=" in attrs or "hidden" in attrs):
        for a in _ATTR.finditer(attrs):
            if a.group(1).lower() == "hidden":
                bits |= OUT_WORD
            for w in _SPLIT.split((a.group(2) or a.group(3) or a.group(4) or "").lower()):
                if w in OUT_WORDS:
                    bits |= OUT_WORD
                elif w in IN_WORDS:
                    bits |= IN_WORD
    return bits


class _Scanner:
    """Finds the ends of tags in one pass: what once was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True           # whether attribute values may hide a >
        self.endless: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place of the > that closes a tag whose name ends at ``at``; -1 if none does."""
        if self.quotes:
            end = self._behind_values(at)
            if end >= 0:
                return end
            self.quotes = False      # a value that is never closed: from here on any > closes
        return self.find(">", at)

    def _behind_values(self, at: int) -> int:
        page = self.page
        while True:
            m = _MARK.search(page, at)
            if m is None:
                return -1
            i, mark = m.start(), m.group()
            if mark == ">":
                return i
            at, j = i + 1, i - 1
            while page[j].isspace():
                j -= 1
            if page[j] == "=":       # a value; one that swallows markup up to the next value's quote is none
                close = self.find(mark, i + 1)
                if close >= 0 and ("<" not in page[i + 1:close] or page[close + 1:close + 2] in ("", ">", "/")
                                   or page[close + 1].isspace()):
                    at = close + 1

    def find(self, what: str, at: int) -> int:
        if what in self.endless:
            return -1
        end = self.page.find(what, at)
        if end < 0:
            self.endless.add(what)
        return end

    def raw_end(self, tag: str, at: int) -> re.Match | None:
        """End tag of an element whose content is no markup."""
        if tag in self.endless:
            return None
        m = _RAW_END[tag].search(self.page, at)
        if m is None:
            self.endless.add(tag)
        return m


def parse(page: str, t: Forest) -> None:
    """Add a page to the forest, in time linear in its length."""
    stack: list[int] = []
    places: dict[str, list[int]] = {}        # depths of the open elements of each tag
    blocks: list[int] = []                   # depths of the open block elements
    block = 0
    runs: list[tuple[int, int, str]] = []
    t.roots.append(len(t.tag))
    t.runs.append(runs)
    links = places.setdefault("a", [])

    def open_(tag, says):
        i = len(t.tag)
        up = stack[-1] if stack else -1
        t.tag.append(tag)
        t.parent.append(up)
        t.depth.append(len(stack))
        t.end.append(i + 1)
        t.says.append(says)
        t.kids.append(0)
        if up >= 0:
            t.path.append(says | t.path[up])
            t.order.append(t.kids[up])
            t.kids[up] += 1
        else:
            t.path.append(says)
            t.order.append(0)
        t.own.append(0)
        t.link.append(0)
        t.stops.append(0)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(i)

    def close(k):
        while len(stack) > k:
            i = stack.pop()
            t.end[i] = len(t.tag)
            tag = t.tag[i]
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    def text(s):
        i = stack[-1]
        if s.isspace():              # parts words, and is no text of its own
            runs.append((i, block, " "))
            return
        n = len(s)
        t.own[i] += n
        if links:
            t.link[i] += n
        t.stops[i] += s.count(".") + s.count(",")
        runs.append((i, block, s))

    open_("#root", 0)
    scan = _Scanner(page)
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        if page.startswith(("<!", "<?"), start):
            end = scan.find("-->", start + 2) if page.startswith("<!--", start) else -1
            if end >= 0:
                at = end + 3
                continue
            end = scan.find(">", start)      # a comment that is never closed ends here, too
            if end < 0:
                break
            at = end + 1
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            text("<")
            at = start + 1
            continue
        end = scan.tag_end(m.end())
        if end < 0:
            text(page[start:])
            break
        at = end + 1
        tag = m.group(2).lower()
        if tag in BLOCK:
            block += 1
        if m.group(1):
            if places.get(tag):
                close(places[tag][-1])
            continue
        if blocks and tag in CLOSES_P and t.tag[stack[blocks[-1]]] == "p":
            close(blocks[-1])
        if tag in SAME:
            k = len(blocks) - 1
            while k >= 0 and t.tag[stack[blocks[k]]] == "p":
                k -= 1
            if k >= 0 and t.tag[stack[blocks[k]]] in SAME[tag]:
                close(blocks[k])
        if tag == "br":
            runs.append((stack[-1], block, " "))
            continue
        if tag in VOID:
            continue
        attrs = page[m.end():end]
        raw = scan.raw_end(tag, at) if tag in RAW else None
        open_(tag, _says(tag, attrs))
        if raw:
            close(len(stack) - 1)
            at = raw.end()
        elif attrs.endswith("/") and (tag in FOREIGN or places.get("svg") or places.get("math")):
            close(len(stack) - 1)
    close(0)


N_FEATURES = len(TAGS) + 23


def features(t: Forest) -> np.ndarray:
    """One row per element; all subtree figures by prefix sums over document order."""
    n = len(t.tag)
    idx = np.arange(n)
    parent, depth, end = np.array(t.parent), np.array(t.depth), np.array(t.end)
    own, link, stops = np.array(t.own, float), np.array(t.link, float), np.array(t.stops, float)
    says, path = np.array(t.says), np.array(t.path)
    order, kids = np.array(t.order, float), np.array(t.kids, float)
    child = parent >= 0
    par = np.where(child, parent, idx)
    root = np.maximum.accumulate(np.where(child, 0, idx))

    def below(v):
        c = np.concatenate([[0], np.cumsum(v)])
        return c[end] - c[idx]

    no = np.array([_TAG_NO.get(g, -1) for g in t.tag])
    is_p, is_a = no == 0, np.array([g == "a" for g in t.tag])
    text, links, marks = below(own), below(link), below(stops)
    some, sub = np.maximum(text, 1), (end - idx).astype(float)
    sib_text = np.bincount(par[child], text[child], minlength=n)[par]
    out_tag, out_word, header = says & OUT_TAG > 0, says & OUT_WORD > 0, says & HEADER > 0
    x = np.zeros((n, N_FEATURES), np.float32)
    x[idx[no >= 0], no[no >= 0]] = 1
    x[:, len(TAGS):] = np.stack([
        np.log1p(text), text / sub, links / some, marks / some, text / np.maximum(text[root], 1), depth,
        order, kids[par], order / np.maximum(kids[par], 1), text / np.maximum(sib_text, 1), np.log1p(sib_text),
        kids, below(is_p), below(is_a) / sub, own / some, out_tag, out_word, header,
        says & (ARTICLE | IN_WORD) > 0, path & (OUT_TAG | OUT_WORD) > 0, path & (ARTICLE | IN_WORD) > 0,
        header & (path & ARTICLE == 0), below(says & ARTICLE > 0) > 0,
    ], 1)
    return x


def article_marks(t: Forest) -> np.ndarray:
    """Elements that are an article by the page's markup.

    ``article`` and ``main`` first; without them elements with an article's
    words; without those the element with most text in paragraphs of its own.
    """
    says = np.array(t.says)
    out = np.array(t.path) & (OUT_TAG | OUT_WORD) > 0
    for bit in (ARTICLE, IN_WORD):
        found = (says & bit > 0) & ~((says & OUT_TAG > 0) if bit == ARTICLE else out)
        if found.any():
            return found
    parent = np.array(t.parent)
    is_p = np.array([g == "p" for g in t.tag]) & (parent >= 0) & ~out
    found = np.zeros(len(parent), bool)
    if is_p.any():
        held = np.bincount(parent[is_p], np.array(t.own, float)[is_p], minlength=len(parent))
        found[int(held.argmax())] = held.max() > 0
    return found


def silver_labels(t: Forest) -> np.ndarray:
    """1: article or an element that holds it; 0: page furniture, by the page's own markup."""
    n = len(t.tag)
    marks = article_marks(t)
    out, holds, inside = [False] * n, [False] * n, [False] * n
    for i in range(n):
        p, says = t.parent[i], t.says[i]
        inside[i] = bool(marks[i]) or (p >= 0 and inside[p])
        bad = not marks[i] and (says & (OUT_TAG | OUT_WORD) or (says & HEADER and not inside[i]))
        out[i] = bool(bad) or (p >= 0 and out[p])
        if marks[i]:
            while p >= 0 and not holds[p]:
                holds[p] = True
                p = t.parent[p]
    return ((np.array(inside) | np.array(holds)) & ~np.array(out)).astype(np.int8)


@dataclass(frozen=True)
class GbtSpec:
    train_pages: int = 200
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    smooth: float = 1.0
    seed: int = 3


class Gbt:
    """Boosted trees as arrays: split feature and threshold per inner node, value per leaf."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.start, self.trees = start, trees

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feat[at]] > cut[at])
            out += leaf[at - len(feat)]
        return out


def fit_gbt(x: np.ndarray, y: np.ndarray, spec: GbtSpec) -> Gbt:
    """Histogram gradient boosting, second order, trees of fixed depth."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, spec.bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    z = np.full(n, start)
    trees = []
    b = spec.bins + 1
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feat = np.zeros(2 ** spec.depth - 1, np.int64)
        cut = np.full(2 ** spec.depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(spec.depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for j in range(m):
                key = (node - first) * b + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, minlength=width * b).reshape(width, b), 1)
                hs = np.cumsum(np.bincount(key, h, minlength=width * b).reshape(width, b), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs ** 2 / (hs + spec.smooth) + (gt - gs) ** 2 / (ht - hs + spec.smooth)
                        - gt ** 2 / (ht + spec.smooth))[:, :len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for q in np.flatnonzero(top > best):
                    best[q], feat[first + q], cut[first + q] = top[q], j, cuts[j][k[q]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > cut[node])
        slot = node - len(feat)
        size = 2 ** spec.depth
        leaf = spec.rate * np.bincount(slot, g, minlength=size) / (np.bincount(slot, h, minlength=size) + spec.smooth)
        trees.append((feat, cut, leaf))
        z += leaf[slot]
    return Gbt(start, trees)


def decode(t: Forest, logit: np.ndarray) -> list[bool]:
    """Best keep/drop labels under: below a dropped element nothing is kept.

    An element's weight is its own text, plus a little for the element itself.
    """
    n = len(t.tag)
    keep = (np.clip(logit, -8, 8) * (1 + np.sqrt(np.array(t.own, float)))).tolist()
    total = keep.copy()                # dropping a subtree is worth -total
    parent = t.parent
    for i in range(n - 1, -1, -1):
        p = parent[i]
        if p >= 0:
            drop = -total[i]
            keep[p] += keep[i] if keep[i] > drop else drop
            total[p] += total[i]
    chosen = [False] * n
    for i in range(n):                 # the document itself is kept
        p = parent[i]
        chosen[i] = p < 0 or (chosen[p] and keep[i] > -total[i])
    return chosen


def block_text(runs: list[tuple[int, int, str]], chosen: list[bool]) -> str:
    """Kept runs joined per block, white space collapsed, blocks on lines of their own."""
    out: list[str] = []
    now, parts = -1, []
    for i, block, s in runs:
        if block != now:
            if parts:
                out.append("".join(parts))
            now, parts = block, []
        if chosen[i]:
            parts.append(s)
    if parts:
        out.append("".join(parts))
    lines = (" ".join(html_lib.unescape(x).split()) for x in out)
    return "\n".join(x for x in lines if x)


def extract_all(pages: list[str | None], model: Gbt) -> list[str]:
    """Main texts; pages share the numpy work in groups of about a megabyte."""
    out: list[str] = []
    t, size = Forest(), 0
    for i, page in enumerate(pages):
        parse(page or "", t)
        size += len(page or "")
        if size > 1 << 20 or i + 1 == len(pages):
            chosen = decode(t, model.logit(features(t)))
            out += [block_text(runs, chosen) for runs in t.runs]
            t, size = Forest(), 0
    return out


# Boilerplate put into training copies; {0} is a text of the page.
_EXTRA = (
    '<div class="comments"><h2>{0}</h2><div class="comment"><p>{0}</p></div></div>',
    '<aside class="sidebar"><ul><li><a href="/a">{0}</a></li></ul></aside>',
    '<div class="cookie notice"><p>{0}</p><button>{0}</button></div>',
    '<form action="/s"><label>{0}</label><input name="q"><button>{0}</button></form>',
    '<div id="ad-1" class="advert"><p>{0}</p></div>',
    '<header class="site-header"><p>{0}</p></header>',
    '<section id="respond" class="reply"><p>{0}</p></section>',
)


def training_rows(page: str, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page: as it is, with boilerplate added, or with markup hidden."""
    rng = np.random.default_rng(which)
    if which % 2:
        texts = re.findall(r">([^<>]{12,})<", page)
        for _ in range(2):
            extra = _EXTRA[int(rng.integers(len(_EXTRA)))].format(
                texts[int(rng.integers(len(texts)))] if texts else "text")
            for mark in (("</article>", "<article>", "</body>", "<body>")[int(rng.integers(4))],):
                at = page.find(mark)
                if at >= 0:
                    at += len(mark) if "/" not in mark else 0
                    page = page[:at] + extra + page[at:]
    t = Forest()
    parse(page, t)
    x, y = features(t), silver_labels(t)
    if which % 3 == 2:                 # hide tags and attribute words
        k = len(TAGS)
        x[:, [_TAG_NO[g] for g in ("article", "main", "nav", "footer", "aside", "header")]] = 0
        x[:, k + 15:k + 23] = 0
    return x, y


def _sample_rows(spec: GbtSpec):
    schema = pa.schema([("h", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for page, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for which in range(4):
                    x, y = training_rows(page, which)
                    pick = np.random.default_rng([abs(h), which]).permutation(len(y))[:200]
                    rows.append((h, x[pick].tobytes(), y[pick].tobytes()))
            yield pa.record_batch([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(3)],
                                  schema=schema)

    return run


def train(pages: DataFrame, html_col: str = "html", spec: GbtSpec = GbtSpec()) -> Gbt | None:
    """Fit on a bounded sample of pages; None if there is no page."""
    rows = bounded(pages).select(F.col(html_col).alias("html")).where("html is not null and html <> ''")
    n = rows.count()
    if not n:
        return None
    share = min(1.0, spec.train_pages / n)
    got = (rows.withColumn("h", F.xxhash64("html"))
           .where(F.pmod("h", F.lit(1 << 30)) < F.lit(share * (1 << 30)))
           .mapInArrow(_sample_rows(spec), "h long, x binary, y binary").toArrow())
    if not got.num_rows:
        return None if share == 1.0 else train(pages, html_col, GbtSpec(train_pages=2 * spec.train_pages))
    got = got.sort_by([("h", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    y = np.frombuffer(b"".join(got.column("y").to_pylist()), np.int8).astype(float)
    return fit_gbt(x, y, spec)


def extract_pages(pages: DataFrame, model: Gbt | None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    base = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            pages_ = batch.column(2).to_pylist()
            texts = extract_all(pages_, model) if model else [""] * len(pages_)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
