import re
from html import unescape

import numpy as np
import pytest

from quernstone.llm import boost, html, htmlmodel


@pytest.fixture(scope="module")
def trees():
    return htmlmodel.model()


def text(trees, page):
    return html.main_texts([page], trees.logit)[0]


PARAS = ["The first paragraph of the story has quite a few words, and it goes on.", "A second one follows & says <more> about the same thing, at length, with commas."]


def test_article_without_the_rest(trees):
    body = f"<h1>Title of it</h1><p>{PARAS[0]}<p><b>A second one\n follows &amp; says &lt;more&gt; about the same&#32;thing, at length, with commas.<br></p>"
    page = f"""<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <!-- ad --><div class="ad">Buy this now please.</div><div class="cookie-notice"><p>We use cookies.</p><button>Ok</button></div>
    <article data-x="1>0">{body}</article><aside class=sidebar><h3>Related</h3><a href=q>Other story</a></aside>
    <form class="search"><label>Search</label><input><button>Go</button></form>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>Nice post, I liked it.</p></div></section>
    <footer>&copy; Somebody &middot; All rights.</footer></body></html>"""
    assert text(trees, page) == "\n".join(["Title of it", *PARAS])
    assert text(trees, page[: page.index("</article>") - 8]).startswith("Title of it\n" + PARAS[0])


def brute(page):
    """The article element of a page of the test tables, cut at its blocks by hand."""
    inner = page[page.index("<article>") + len("<article>") : page.index("</article>")]
    blocks = (" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_table_equals_the_article(trees, spark):
    got = html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(got) == 250
    for r in got:
        assert r.text == brute(r.html) and r.n_chars == len(r.text)


LONG = [" ".join(f"word{i}{j}" for j in range(24)) for i in range(20)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1>Title here now</h1>" + "".join(f"<p>{x}</p>" for x in LONG[:3]), "\n".join(["Title here now", *LONG[:3]])),
        ("".join(f"<div>{x}</div>" for x in LONG[:2]), "\n".join(LONG[:2])),
        ("<p>Just one paragraph, alone.</p>", "Just one paragraph, alone."),
        ("plain text of a page, without any markup at all", "plain text of a page, without any markup at all"),
        ('<article class="related-post">' + "".join(f"<p>{x}</p>" for x in LONG[:2]) + "</article>", "\n".join(LONG[:2])),
        ("<body>" + "".join(f"<p>{x}</p>" for x in LONG), "\n".join(LONG)),
        ("<p>same words all of it.</p>" * 20, "\n".join(["same words all of it."] * 20)),
        ("<ul><li>one thing</li><li>another thing</li></ul>", "one thing\nanother thing"),
        ("<body><div><div><div>Some text here.</div></div></div></body>", "Some text here."),
        ("<p>&am<b>p;</b> x</p>", "&amp; x"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
        ("<p>one <svg><text>no</text></svg> two <video> three</p><p>four</p>", "one two three\nfour"),
    ],
)
def test_pages_that_are_all_article(trees, page, want):
    assert text(trees, page) == want


def test_made_pages(trees):
    doms, want = htmlmodel.examples(150, 1234)
    logit = trees.logit(html.features(doms))
    at = hit = extra = missed = 0
    for d in doms:
        n = len(d.kind)
        kept, good = html.decode(d, logit[at : at + n]), want[at : at + n]
        size = np.array([len(t) for t in d.text]) * (np.array(d.kind) == 0)
        hit, extra, missed = hit + size[kept & good].sum(), extra + size[kept & ~good].sum(), missed + size[~kept & good].sum()
        at += n
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.98, (hit, extra, missed)


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    for _ in range(200):
        d = html.Dom()
        n = int(rng.integers(1, 9))
        for i in range(n):
            d.parent.append(-1 if i == 0 else int(rng.integers(0, i)))
        inner = set(d.parent)
        d.kind = [1 if i in inner or rng.random() < 0.2 else 0 for i in range(n)]
        logit = rng.normal(size=n)
        best, choice = -np.inf, None
        for bits in range(2**n):
            k = [bits >> i & 1 for i in range(n)]
            ok = all(not k[i] or i == 0 or k[d.parent[i]] for i in range(n)) and all(not k[i] or d.kind[i] == 0 or any(k[c] and d.parent[c] == i for c in range(1, n)) for i in range(n))
            if ok and (s := sum(x if y else -x for x, y in zip(logit, k, strict=True))) > best:
                best, choice = s, k
        assert html.decode(d, logit).astype(int).tolist() == choice


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    assert (((boost.fit(x, y).logit(x) > 0) == y).mean()) > 0.97


def test_odd_pages(trees, spark):
    odd = ["", "plain words only", "<", "<p", "<p>a<!-- x", "<script>a", "</p>b", "<div>" * 3000 + "deep", "<p>" + "w " * 200_000, '<a b="', "< 3 &amp", "\x00<p>\x00", "<title>t<p>x", "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b<tr><td>c"]
    for p in odd:
        d = html.parse(p)
        assert all(e > i for i, e in enumerate(d.end)) and d.end[0] == len(d.kind)
        text(trees, p)
    rows = [(i, p, 1) for i, p in enumerate([*odd, None, None])]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert len(out) == len(rows) and [r.text for r in out if r.html is None] == ["", ""]
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
