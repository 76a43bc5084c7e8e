"""Made-up pages with known main text, and the boosted trees fitted on them.

The maker varies layout, element names, attribute tokens, lengths, broken
markup and where the article stands, so that no single sign decides. Some pages
have nothing but the article, as markup or as plain text, and some articles have
class names that announce something else.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from quernstone.llm import boost
from quernstone.llm.html import TOKENS, Dom, features, parse

PAGES = 800
SEED = 3
#: Every made word of main text ends so, which marks the runs that hold it.
_MARK = "\u2060"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(["an", "the", "ti", "on", "er", "in", "st", "ou", "re", "é", "sch", "ción"]) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, mark: str = "") -> str:
        out = []
        for k in range(self.r.randint(low, high)):
            w = self.word() + (self.r.choice([".", ",", "", "", "", ""]))
            out.append((w.capitalize() if k == 0 else w) + mark)
        return " ".join(out)

    def junk(self, text: str) -> str:
        return "".join(w + self.r.choice(["***", "$$$", "&amp;&amp;", "%%%", ""]) + " " for w in text.split())

    def attrs(self, group: str | None, share: float = 0.75) -> str:
        r = self.r
        if group and r.random() < share:
            word = r.choice(TOKENS[group])
            word = r.choice([word, f"site-{word}", f"{word}_{r.choice('abc')}", f"{word}-box", word.capitalize() + "Box"])
            return f' {r.choice(["class", "class", "id", "role"])}="{word}{r.choice(["", " wide", " col-" + str(r.randint(1, 9))])}"'
        return r.choice(["", "", f' class="c{r.randint(1, 99)}"', ' class="row wrap"', ' data-x="1>0"'])

    def el(self, names: str, group: str | None, inner: str, share: float = 0.75) -> str:
        name = self.r.choice(names.split())
        return f"<{name}{self.attrs(group, share)}>{inner}</{name}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(3, 12))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def boilerplate(self, where: str) -> str:
        r = self.r
        made = {
            "nav": lambda: self.el("nav nav div ul", "nav", self.links()),
            "head": lambda: self.el("header header div", "head", self.el("div p h2", "head", self.words(1, 4)) + r.choice(["", self.links()])),
            "foot": lambda: self.el("footer footer div", "foot", r.choice([f"&copy; {self.words(3, 12)}", self.links() + f"<p>{self.words(4, 20)}</p>", f"<p>&copy; {self.words(2, 8)} &middot; {self.words(3, 14)}</p>"])),
            "ad": lambda: self.el("div div aside section", "ad", r.choice([self.words(4, 25), f"<p>{self.words(4, 25)}</p>", self.link(3, 9)]), 0.95),
            "side": lambda: self.el("aside aside div section", "side", f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(), f"<p>{self.words(8, 60)}</p>"])),
            "notice": lambda: self.el("div div section dialog", "notice", f"<p>{self.words(8, 40)}</p>" + r.choice(["", "<button>Ok</button>", self.link()]), 0.95),
            "form": lambda: f"<form{self.attrs('form')}>" + self.el("label p div", None, self.words(1, 12)) + "<input name=q>" + r.choice(["", "<select><option>a</option><option>b c</option></select>", "<textarea>write here</textarea>"]) + f"<button>{self.words(1, 2)}</button></form>",
            "comment": lambda: self.el("div section ol", "comment", f"<h3>{self.words(1, 3)}</h3>" + "".join(self.el("div li article", "comment", f"<p>{self.words(5, 70)}</p>", 0.9) for _ in range(r.randint(1, 6))), 0.95),
            "share": lambda: self.el("div ul p", "share", r.choice([self.words(1, 6), self.links()])),
        }
        return made[where]()

    def misled(self) -> str:
        """An attribute that announces other things than the article that it is on."""
        return self.attrs(self.r.choice(["side", "head", "share", "nav", "ad", "form", "foot", "notice"]), 1.0)

    def article(self, bare: bool = False) -> str:
        r, mark, parts = self.r, _MARK, []
        title = self.words(2, 14, mark)
        if r.random() < (0.5 if bare else 0.9):
            parts.append(f"<h1>{title}</h1>")
        odd = self.junk if r.random() < 0.15 else (lambda t: t)
        block = r.choice(["p", "div", "section"]) if r.random() < 0.3 else None  # all blocks alike
        even = self.words(4, 90, mark) if r.random() < 0.3 else None
        misled = r.random() < 0.08
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            text = odd(self.words(*r.choice([(1, 6), (5, 30), (30, 140), (30, 140)]), mark))
            if even:
                n = len(even.split())
                text = self.words(n, n, mark)
            kind = r.random()
            if block:
                parts.append(f"<{block}{self.misled() if misled and r.random() < 0.5 else ''}>{text}</{block}>")
            elif kind < 0.72:
                parts.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=x>{self.words(1, 3, mark)}</a> {self.words(3, 12, mark)}</p>", f"<div>{text}</div>"]))
            elif kind < 0.8:
                parts.append(f"<h2>{self.words(1, 8, mark)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 20, mark)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 6, mark)}</td><td>{self.words(1, 6, mark)}</td></tr>" for _ in range(3)) + "</table>")
            elif not bare:
                parts.append(self.boilerplate(r.choice(["ad", "share", "side", "form", "notice", "nav", "comment"])))
        if not parts:
            parts.append(f"<p>{title}</p>")
        inner = "".join(parts)
        shape = r.random() + (0.45 if bare else 0)
        own = "content"
        if misled:
            return f"<{(name := r.choice('article article main section'.split()))}{self.misled()}>{inner}</{name}>"
        if shape < 0.5:
            out = self.el("article", own, inner, 0.3)
        elif shape < 0.7:
            out = f"<main>{self.el('article div section', own, inner, 0.6)}</main>"
        elif shape < 0.92:
            out = self.el("div section td", own, inner, 0.9)
        else:
            out = inner
        return out

    def bare(self) -> str:
        """A page that is all article, with or without markup."""
        r = self.r
        if r.random() < 0.25:
            return "\n".join(self.words(1, 120, _MARK) for _ in range(r.randint(1, 4)))
        body = self.article(bare=True)
        return r.choice([body, f"<body>{body}</body>", f"<html><head><title>{self.words(2, 9)}</title></head><body>{body}</body></html>"])

    def page(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return self.bare()
        top = [self.boilerplate(k) for k in ("notice", "head", "nav", "ad", "form", "side") if r.random() < 0.5]
        end = [self.boilerplate(k) for k in ("share", "comment", "side", "ad", "form", "nav", "notice") if r.random() < 0.35]
        if r.random() < 0.85:
            end.append(self.boilerplate("foot"))
        r.shuffle(top)
        body = "".join(top) + self.article() + "".join(end)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.el("div div section", None, body)
        page = f"<html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
        return page[: int(len(page) * r.uniform(0.6, 1))] if r.random() < 0.1 else page


def examples(pages: int, seed: int) -> tuple[list[Dom], np.ndarray]:
    """Made pages and, for each node, whether it holds main text."""
    maker, doms, labels = Maker(seed), [], []
    for _ in range(pages):
        d = parse(maker.page())
        good = np.zeros(len(d.kind), bool)
        for i in range(len(d.kind) - 1, -1, -1):
            if d.kind[i] == 0:
                good[i] = _MARK in d.text[i]
                d.text[i] = d.text[i].replace(_MARK, "")
                d.link[i] = min(d.link[i], len(d.text[i]))
            if good[i] and d.parent[i] >= 0:
                good[d.parent[i]] = True
        doms.append(d)
        labels.append(good)
    return doms, np.concatenate(labels)


@lru_cache(1)
def model() -> boost.Trees:
    """The fitted trees; the same on every machine and run."""
    doms, labels = examples(PAGES, SEED)
    return boost.fit(features(doms), labels.astype(float))
