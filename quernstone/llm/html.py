"""Main text of web pages: boosted trees over DOM-node features, decoded over the tree.

A page becomes a tree of block elements whose leaves are runs of text. Trees
give each node the log-odds of holding main text; the decoder keeps the set of
nodes of the highest total under two rules: below a dropped node nothing is
kept, and a kept element holds a kept run. The model is fitted on made-up pages
(:mod:`quernstone.llm.htmlmodel`), not on the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.shared import small_batches

# Element names of the HTML standard by their role.
RAW = frozenset("script style noscript template iframe head title".split())
#: Their content is skipped too, but only if they are closed.
EMBEDDED = frozenset("svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img math mrow mi mo mn ms mtext mfrac msup msub msubsup msqrt mroot semantics annotation".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}, "p": {"article", "body", "div", "section", "td", "li"}}
#: Roles of elements; the place in this tuple is the code of a node's kind.
KINDS = ("leaf", "root", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "item", "table", "quote", "control", "other")
_KIND = {"body": "root", "html": "root", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tbody": "table", "tr": "table", "td": "table", "th": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "button": "control", "select": "control", "option": "control", "textarea": "control", "legend": "control"} | {f"h{k}": "heading" for k in range(1, 7)}
#: Attribute tokens by what they announce; the place in this dict is a bit of a node's mask.
TOKENS = {
    "content": "article body content entry story main post text prose articlebody".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap skip".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp".split(),
    "side": "sidebar aside rail widget widgets related recommended popular trending more".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "head": "header masthead topbar logo brand branding".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay privacy".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond".split(),
    "form": "form login signup subscribe newsletter search contact input".split(),
    "share": "share sharing social follow tags meta byline author".split(),
}
_BIT = {word: 1 << k for k, words in enumerate(TOKENS.values()) for word in words}
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")


@dataclass
class Dom:
    """Nodes in page order: parents before children. A leaf has the text of a run."""

    kind: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    mask: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    kinds_above: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)


def _mask(attrs: str) -> int:
    out = 0
    for m in _ATTR.finditer(attrs):
        for word in _SPLIT.split(m.group(1)):
            out |= _BIT.get(word.lower(), 0)
    return out


def parse(html: str | None) -> Dom:
    """The block tree of a page; null and text without markup give a root with at most one run.

    Unclosed, misnested and cut-off markup is repaired as browsers do in the
    common cases. Raw elements (scripts, styles, the head) and comments leave nothing,
    nor do embedded objects that are closed; formulas count as text.
    """
    s, d = html or "", Dom()
    tags: list[str] = []
    nodes: list[int] = []
    run: list[str] = []
    link = in_link = 0

    def open_node(kind: int, mask: int, text: str = "", n_link: int = 0) -> int:
        up = nodes[-1] if nodes else -1
        d.kind.append(kind)
        d.parent.append(up)
        d.depth.append(len(nodes))
        d.end.append(0)
        d.mask.append(mask)
        d.above.append(d.above[up] | d.mask[up] if up >= 0 else 0)
        d.kinds_above.append(d.kinds_above[up] | 1 << d.kind[up] if up >= 0 else 0)
        d.text.append(text)
        d.link.append(n_link)
        return len(d.kind) - 1

    def close_run() -> None:
        nonlocal link
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                i = open_node(0, 0, text, min(link, len(text)))
                d.end[i] = i + 1
        link = 0

    def pop(to: int) -> None:
        close_run()
        while len(tags) > to:
            tags.pop()
            d.end[nodes.pop()] = len(d.kind)

    def close_if_open(names: set[str] | frozenset[str], within: set[str]) -> None:
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in names:
                pop(k)
                return
            if tags[k] in within:
                return

    tags.append("#root")
    nodes.append(open_node(KINDS.index("root"), 0))
    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt < 0 or lt == n - 1:
            run.append(unescape(s[at:]))
            link += in_link and n - at
            break
        if lt > at:
            # Each piece by itself: markup within a character reference ends it.
            run.append(unescape(s[at:lt]))
            link += in_link and lt - at
        c = s[lt + 1]
        if c == "!" or c == "?":
            if s.startswith("<!--", lt):
                z = s.find("-->", lt + 4)
                at = n if z < 0 else z + 3
            else:
                z = s.find(">", lt)
                at = n if z < 0 else z + 1
            continue
        closing = c == "/"
        m = _NAME.match(s, lt + 1 + closing)
        if not m:
            if closing:
                z = s.find(">", lt)
                at = n if z < 0 else z + 1
            else:
                run.append("<")
                at = lt + 1
            continue
        name = m.group().lower()
        z = s.find(">", m.end())
        if z < 0:
            break  # cut off within a tag
        attrs = s[m.end() : z]
        if '"' in attrs or "'" in attrs:
            e = _TAG_END.match(s, m.end())
            if e:
                z, attrs = e.end() - 1, s[m.end() : e.end() - 1]
        at = z + 1
        if closing:
            if name == "a":
                in_link = 0
            if name in INLINE or name in VOID:
                continue
            if name == "p" and "p" not in tags:
                close_run()
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == name:
                    pop(k)
                    break
                if name == "p" and tags[k] in SCOPE["p"]:
                    break
            continue
        if name in EMBEDDED:
            e = None if attrs.endswith("/") else re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
            if e:
                z = s.find(">", e.end())
                at = n if z < 0 else z + 1
            continue
        if name in RAW:
            if not attrs.endswith("/") or name in ("script", "style"):
                e = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
                if not e:
                    if name not in ("head", "title"):
                        break
                    e = re.compile(r"<body", re.I).search(s, at) if name == "head" else None
                    at = e.start() if e else at
                    continue
                z = s.find(">", e.end())
                at = n if z < 0 else z + 1
            continue
        if name == "br" or name == "hr" or name == "wbr":
            if name == "br":
                run.append(" ")
            elif name == "hr":
                close_if_open({"p"}, SCOPE["p"])
                close_run()
            continue
        if name == "a":
            in_link = 1
        if name in INLINE or name in VOID:
            continue
        if name in ("html", "body"):
            close_run()
            d.mask[0] |= _mask(attrs)
            continue
        close_run()
        if name in ENDS_P:
            close_if_open({"p"}, SCOPE["p"] - {"p"})
        if name in SAME_CLOSES:
            close_if_open(SAME_CLOSES[name], SCOPE.get(name, set()))
        kind = KINDS.index(_KIND.get(name, "other"))
        i = open_node(kind, _mask(attrs) if attrs else 0)
        if attrs.endswith("/") and name not in ENDS_P:
            d.end[i] = i + 1
            continue
        tags.append(name)
        nodes.append(i)
    pop(0)
    return d


_MARKS = re.compile(r"[.,;:!?]")


def features(doms: list[Dom]) -> np.ndarray:
    """Features of all nodes of some pages, in order."""
    sizes = [len(d.kind) for d in doms]
    first = np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
    cat = lambda f: np.concatenate([np.array(f(d), np.int64) for d in doms])
    kind, parent, depth, end = (cat(f) for f in (lambda d: d.kind, lambda d: d.parent, lambda d: d.depth, lambda d: d.end))
    mask, above, kinds_above, link = (cat(f) for f in (lambda d: d.mask, lambda d: d.above, lambda d: d.kinds_above, lambda d: d.link))
    n = len(kind)
    me = np.arange(n)
    up = np.where(parent < 0, me, parent + first)
    last = end + first
    chars = cat(lambda d: [len(t) for t in d.text]).astype(float)
    words = cat(lambda d: [t.count(" ") + 1 if t else 0 for t in d.text]).astype(float)
    marks = cat(lambda d: [len(_MARKS.findall(t)) for t in d.text]).astype(float)
    leaf = kind == 0

    def below(v: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0.0], np.cumsum(v)])
        return s[last] - s[me]

    bad = np.array([k != "content" for k in TOKENS])
    bad_bits = sum(1 << k for k in range(len(TOKENS)) if bad[k])
    odd_kinds = sum(1 << KINDS.index(k) for k in ("nav", "header", "footer", "aside", "form", "control"))
    flagged = ((mask & bad_bits) > 0) | (((1 << kind) & odd_kinds) > 0)
    under_flag = leaf & (((above & bad_bits) > 0) | ((kinds_above & odd_kinds) > 0))
    text, links, leaves = below(chars), below(link.astype(float)), below(leaf.astype(float))
    page = text[first] + 1
    before = np.concatenate([[0.0], np.cumsum(chars)[:-1]])
    before = (before - before[first]) / page
    children = np.bincount(up[parent >= 0], minlength=n)
    order = np.zeros(n)
    prev, following = np.zeros(n), np.zeros(n)
    by = np.lexsort((me, up))
    by = by[parent[by] >= 0]
    same = np.concatenate([[False], up[by[1:]] == up[by[:-1]]]) if len(by) else np.zeros(0, bool)
    starts = np.flatnonzero(~same)
    order[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    prev[by[1:][same[1:]]] = text[by[:-1][same[1:]]]
    following[by[:-1][same[1:]]] = text[by[1:][same[1:]]]
    log = np.log1p
    cols = [
        depth, log(text), links / (text + 1), log(leaves), log(text / (leaves + 1e-9) * (leaves > 0)), below(marks) / (text + 1) * 100,
        below(words) / (leaves + 1e-9) * (leaves > 0), text / page, before, (last - me) / (text + 1) * 100, text / (text[up] + 1),
        children[up], order, order / (children[up] + 1e-9), log(prev), log(following), log(below((kind == KINDS.index("p")).astype(float))),
        log(below((kind == KINDS.index("item")).astype(float))), log(below((kind == KINDS.index("control")).astype(float))),
        (below(((kind == KINDS.index("article")) | (kind == KINDS.index("main"))).astype(float)) > 0).astype(float),
        below(chars * under_flag) / (text + 1), (below(flagged.astype(float)) > 0).astype(float), kind[up], links[up] / (text[up] + 1), log(text[up]), leaf & (kind[up] == KINDS.index("heading")),
        log(below(flagged.astype(float))[first]), (below(chars * under_flag) / (text + 1))[first], (below(((kind == KINDS.index("article")) | (kind == KINDS.index("main"))).astype(float)) > 0)[first].astype(float), log(leaves)[first],
    ]
    cols += [kind == k for k in range(len(KINDS))]
    for k in range(len(TOKENS)):
        cols += [(mask >> k & 1), (above >> k & 1)]
    cols += [(kinds_above >> KINDS.index(k) & 1) for k in ("nav", "header", "footer", "aside", "form", "article", "main", "control", "list", "table", "item")]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1)


def decode(d: Dom, logit: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the consistent choice of the highest total log-odds.

    Nothing below a dropped node is kept; a kept element has a kept child; an
    element without runs is dropped.
    """
    n = len(d.kind)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[d.parent[i]].append(i)
    keep, drop = np.zeros(n), np.zeros(n)
    forced = [-1] * n
    for i in range(n - 1, -1, -1):
        drop[i] = -logit[i] + sum(drop[c] for c in children[i])
        if d.kind[i] == 0:
            keep[i] = logit[i]
        elif not children[i]:
            keep[i] = -np.inf
        else:
            best = max(children[i], key=lambda c: keep[c] - drop[c])
            forced[i] = best
            keep[i] = logit[i] + keep[best] + sum(max(keep[c], drop[c]) for c in children[i] if c != best)
    kept = np.zeros(n, bool)
    kept[0] = keep[0] > drop[0]
    for i in range(1, n):
        up = d.parent[i]
        kept[i] = kept[up] and (forced[up] == i or keep[i] > drop[i])
    return kept


def main_texts(pages: list[str | None], logits) -> list[str]:
    """The main text of each page: its kept runs in page order, one a line."""
    doms = [parse(p) for p in pages]
    if not doms:
        return []
    score = logits(features(doms))
    out, at = [], 0
    for d in doms:
        kept = decode(d, score[at : at + len(d.kind)])
        at += len(d.kind)
        out.append("\n".join(t for t, k, kind in zip(d.text, kept, d.kind, strict=True) if k and kind == 0))
    return out


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Every row of ``df`` with ``text`` (empty if none) and ``n_chars``; columns of these names are replaced.

    Null and empty pages have an empty text. Narrow: a task holds the nodes of
    about :data:`PAGE_CHARS` of markup, or of one page that is longer.
    """
    from pyspark.sql import types as T

    from quernstone.llm.htmlmodel import model

    small_batches(df.sparkSession)
    trees = model()
    names = [c for c in df.columns if c not in ("text", "n_chars") or c == html]
    kept = df.select(*[f"`{c}`" for c in names])
    out_names = [c for c in names if c not in ("text", "n_chars")]
    schema = T.StructType([kept.schema[c] for c in out_names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from quernstone.llm.textvec import groups, slices

        arrow = to_arrow_schema(schema)
        for b in slices(batches):
            pages = b.column(names.index(html)).to_pylist()
            for i, j in groups(pages, PAGE_CHARS):
                texts = main_texts(pages[i:j], trees.logit)
                cols = [b.column(names.index(c)).slice(i, j - i).cast(arrow.field(c).type) for c in out_names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow)

    return kept.mapInArrow(run, schema)


#: Markup that is classified at once.
PAGE_CHARS = 1 << 19
