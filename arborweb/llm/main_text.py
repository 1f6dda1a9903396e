"""Main text of web pages as the maximum-scoring run of tokens.

A page is read into tags and runs of words. Every word and tag has a score, learned from
labelled pages: a word's comes from what it stands in (elements with a role, names in
class, id and role, links, the article element of a page that has one), a tag's from its
name, and is never positive. One linear scan finds the contiguous run with the greatest
sum; its words are the main text, one line for each block. Words whose surroundings score
below zero (menus, notices, comments, ...) are no text: the run may cross them, at a
cost of ``CROSSING`` at most, and leaves them out.

Weights are fitted by logistic regression for words, and are log odds for tags, of lying in
the marked region of labelled pages (``learn``). The pages are ``LABELLED`` and
``PAGES`` more that ``labelled`` makes by a rule, so what is learned from is bounded; others
may be given. Which names mean what is not decided here but learned from where they
stand in those pages; a name they lack says nothing.

Scripts, styles and the like, whose content is no text of the page, are not read.

A part of a page that is called nothing but comment, reply, social, login and the like is taken for
what it says, in an article too; a table, figure or quotation of such a name, and a compound with
a word that pages do not use for their parts, is text if it stands in text.

Defined results: null, empty or tag-only HTML has an empty text. An unclosed element
ends where its parent does, an unclosed tag or comment at the end of the page, and an
undecodable character reference stays as it is. ``<br>`` is white space inside a
block. Equal sums: the first run, and of those the shortest, wins. Null ids and URLs stay
null, repeated rows each give a row, an empty table gives an empty one. Pages of any length
and depth are read whole, in linear time. Columns other than those named are not read,
whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, slices

#: What a stretch of words that are no text costs at most, however long it is.
CROSSING = 3.0
#: The largest score of a word.
MOST = 4.0
#: Words that a link has at least to be told from a menu's.
LONG = 4
#: Labelled pages that are made.
PAGES = 1200

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg annotation annotation-xml".split())
INLINE = frozenset(
    """a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp script small
    span strike strong style sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder
    mover munderover mtable mtr mtd mstyle mpadded mphantom mspace semantics""".split()
)
ROLES = frozenset("head nav header footer aside form fieldset button select option menu dialog audio video canvas object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id is an anchor to jump to, not the name of a part of the page.
ANCHORS = frozenset("section p pre li dt dd blockquote figure table".split()) | HEADINGS
#: Elements that hold pieces of text of a kind, whatever they are called.
PIECES = frozenset("figure table pre blockquote dl".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table td th body html article section div".split())
#: Words of compound names that say how a part is laid out, not what it is.
LAYOUT = frozenset("wrap wrapper inner outer inside container box block area section holder list item items row col column group content widget zone slot unit panel region body left right top bottom bar id".split())

_open = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_name = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_quoted = re.compile(r"[^>\"']*")
_attribute = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_invisible = re.compile(r"display\s*:\s*none", re.I)


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends the tag opened at ``at``; -1 if the page ends first.
    A quote counts only after ``=``, and only if it is closed."""
    here = at
    while True:
        here = _quoted.match(page, here).end()
        if here >= len(page):
            return page.find(">", at)
        c = page[here]
        if c == ">":
            return here
        shut = page.find(c, here + 1) if page[at:here].rstrip()[-1:] == "=" else here
        if shut < 0:
            return page.find(">", at)
        here = shut + 1


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, "") and ("text", "", text) in page order;
    comments, declarations and the inside of scripts and the like are left out."""
    at = 0
    while at < len(page):
        m = _open.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.start()
        if m[0] == "<!--":
            shut = page.find("-->", at + 4)
            at = len(page) if shut < 0 else shut + 3
            continue
        shut = _tag_end(page, at + 1)
        if shut < 0:
            return
        if m[0] in ("<!", "<?"):
            at = shut + 1
            continue
        name = _name.match(page, at)
        tag = name[1].lower()
        if m[0][1] == "/":
            yield "close", tag, ""
        else:
            yield "open", tag, page[name.end() : shut]
            if tag in RAW and page[shut - 1] != "/":
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, shut + 1)
                if not end:
                    return
                shut = end.start() - 1
        at = shut + 1


def features(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says about the words in it: its name, if HTML gives it a role, and for each
    name in class, id and role the last word of it that is not about layout, as compounds
    name a kind of their last word. A compound says its last word once more, and whether it is
    made of words of pages (``site-header``, ``post-comments``) or not (``market-share``); one of
    ``PIECES`` says it once more as well. Ids of ``ANCHORS`` and names on
    inline elements, headings and ``PIECES`` are told apart; html, body and main say nothing
    by their names."""
    said = {f"element:{name}"} if name in ROLES else set()
    if not attrs or name in ("html", "body"):
        return tuple(said)
    for m in _attribute.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and _invisible.search(value)):
            said.add("hidden")
        elif key in ("class", "id", "role") and name != "main":
            if key == "id" and (name in ANCHORS or name in INLINE):
                continue
            kind = "inline" if name in INLINE or name in HEADINGS else "name"
            for compound in value.split():
                words = [w.lower() for w in _parts.findall(compound)]
                named = [w for w in words if w not in LAYOUT]
                if named:
                    said.add(f"{kind}:{named[-1]}")
                if named and name in PIECES:
                    said.add(f"piece:{named[-1]}")
                elif len(named) > 1 and kind == "name":
                    said.add(f"compound:{named[-1]}")
                    if named[-1] in BEFORE and not BEFORE.isdisjoint(named[:-1]):
                        said.add("compound:words of pages")
    return tuple(sorted(said))


class Stack:
    """The open elements by number and name. Each of its questions is answered at once,
    however deep the page is nested."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.numbers: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, name: str, number: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in SCOPE:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.numbers.append(number)

    def cut(self, depth: int) -> None:
        """Ends the elements from ``depth`` on."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.numbers.pop()
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, -1 for none."""
        found = self.places.get(name)
        return found[-1] if found else -1

    def starts(self, name: str) -> None:
        """Ends the elements that a start tag ends."""
        if name in ENDS_P and (at := self.last("p")) >= 0 and at > (self.scopes[-1] if self.scopes else -1):
            self.cut(at)
        # a tr ends its cells, which are in scope themselves, and then the row
        while name in SIBLINGS and (at := max(map(self.last, SIBLINGS[name]))) >= 0:
            below = [k for k in self.scopes[-2:] if k > at]
            if below:
                break
            self.cut(at)
            if name != "tr":
                break

    @property
    def top(self) -> int:
        return self.numbers[-1] if self.numbers else 0


class Page:
    """The elements and tokens of a page. Element 0 is the page itself; ``parent``, ``names``
    and ``said`` are by element. A token is (element, text, words) of a run of words, or
    (element, tag name, -1) of a tag."""

    def __init__(self, page: str):
        self.parent, self.names, self.said = [0], [""], [()]
        self.tokens: list[tuple[int, str, int]] = []
        stack = Stack()
        for what, name, rest in events(page):
            if what == "text":
                text = entities.unescape(rest)
                self.tokens.append((stack.top, text, len(text.split())))
            elif what == "open":
                stack.starts(name)
                up = stack.top
                self.parent.append(up)
                self.names.append(name)
                self.said.append(features(name, rest))
                number = len(self.names) - 1
                if name not in VOID and name not in RAW:
                    stack.push(name, number)
                self.tokens.append((number, name, -1))
            elif (at := stack.last(name)) >= 0:
                number = stack.numbers[at]
                stack.cut(at)
                self.tokens.append((number, name, -1))
            else:
                self.tokens.append((stack.top, name, -1))


@dataclass(frozen=True)
class Weights:
    """``words``: by feature, ``bias`` for every word; ``tags``: by feature."""

    words: dict[str, float]
    bias: float
    tags: dict[str, float]


NOTHING = Weights({}, 1.0, {})


class State:
    """What holds for the words of each element under ``weights``: ``sure`` (the score of its
    surroundings; below zero they are no text), ``link``, ``own`` (its links belong to the
    text: in the article, or in a main heading), and ``place`` (inside or outside of the
    article, if the page has one)."""

    def __init__(self, page: Page, weights: Weights):
        n = len(page.names)
        parent, names = page.parent, page.names
        own = [sum(weights.words.get(f, 0.0) for f in said) for said in page.said]
        role = [weights.words.get(f"element:{x}", 0.0) if x in ROLES else 0.0 for x in names]
        # a part that holds the page's heading, or main element, says nothing against it by its names
        under = [0.0] * n
        heads, articles = [], []
        for k in range(1, n):
            under[k] = under[parent[k]] + role[k]
            if names[k] in ("main", "h1") and under[k] >= 0:
                heads.append(k)
            elif names[k] == "article" and under[k] >= 0 and own[k] >= 0:
                articles.append(k)
        holds = [False] * n
        for k in heads or articles:
            k = parent[k]
            while k and not holds[k]:
                holds[k] = True
                k = parent[k]
        self.names_sum = total = [0.0] * n
        main = [False] * n
        for k in range(1, n):
            total[k] = total[parent[k]] + (max(role[k], own[k]) if holds[k] else own[k])
            main[k] = main[parent[k]] or (names[k] in ("main", "article") and total[k] >= 0)
        inner = outer = 0
        for e, _, words in page.tokens:
            if words > 0 and total[e] >= 0:
                inner, outer = (inner + words, outer) if main[e] else (inner, outer + words)
        # articles of fewer words than what is around them are teasers
        self.has_main = any(main) and inner >= outer
        place = (weights.words.get("place:outside", 0.0), weights.words.get("place:inside", 0.0)) if self.has_main else (0.0, 0.0)
        self.main = main
        self.sure = [weights.bias + total[k] + place[main[k]] for k in range(n)]
        self.link, self.own = [False] * n, [False] * n
        for k in range(1, n):
            self.link[k] = self.link[parent[k]] or names[k] == "a"
            self.own[k] = self.own[parent[k]] or (self.has_main and main[k]) or names[k] in ("h1", "h2")

    def linked(self, e: int, words: int) -> str | None:
        """What a run of so many words in an element is as a link's."""
        if not self.link[e]:
            return None
        return "link:own" if self.own[e] else "link:long" if words >= LONG else "link:short"

    def features(self, page: Page, e: int, words: int) -> list[str]:
        """All features of a run of so many words in an element."""
        out = ["place:inside" if self.main[e] else "place:outside"] if self.has_main else []
        out += [x] if (x := self.linked(e, words)) else []
        while e:
            out += page.said[e]
            e = page.parent[e]
        return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest positive sum; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def scored(page: Page, weights: Weights) -> tuple[list[float], list[bool]]:
    """(score, whether it is text) of each token."""
    state = State(page, weights)
    scores, shown, spent = [], [], 0.0
    for e, name, words in page.tokens:
        sure = state.sure[e]
        if words < 0:
            up = page.parent[e]
            text = sure >= 0 and state.sure[up] >= 0
            score = weights.tags.get(f"{'own' if state.own[e] or state.own[up] else 'tag'}:{name}", -0.01 if state.own[e] else -0.5)
        else:
            text = sure >= 0
            score = max(-MOST, min(MOST, sure + (weights.words.get(state.linked(e, words), 0.0) if text else 0.0))) * words
        if text:
            spent = 0.0 if words > 0 else spent
        else:
            score = -min(-score, CROSSING - spent) if score < 0 else 0.0
            spent -= score
        scores.append(score)
        shown.append(text)
    return scores, shown


def extract(html: str | None, weights: Weights | None = None) -> str:
    """The main text of a page."""
    weights = weights or known()
    page = Page(html or "")
    scores, shown = scored(page, weights)
    start, end = best_run(scores)
    blocks: list[str] = []
    parts: list[str] = []
    for (_, text, words), text_here in zip(page.tokens[start:end], shown[start:end], strict=True):
        if words >= 0:
            if text_here:
                parts.append(text)
        elif text == "br":
            parts.append(" ")
        elif text not in INLINE and text not in RAW:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


# Labelled pages: what stands between [[ and ]] is the main text's region, less what stands in it between {{ and }}.
LABELLED = [
    """<html><head><title>T</title></head><body><div class="top"><a href="/">Home</a> <a href="/n">News</a></div>
    <nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>[[<article><h1>A title of the page</h1>
    <p>The first paragraph has <b>some words</b> in it and <a href="/x">a link</a> too.</p><p>The second one goes on
    for a while, as such texts do.</p><ul><li>a point</li><li>another point</li></ul><blockquote>words that were said
    </blockquote><h2>A part</h2><p>And a last paragraph ends it.</p></article>]]<aside><h3>More</h3><ul><li><a href="/c">
    Other</a></li></ul></aside><footer><p>All rights reserved</p><a href="/i">Imprint</a></footer></body></html>""",
    """<body><div id="header"><a href="/">Site</a></div><div class="menu"><a href="/1">A</a><a href="/2">B</a></div>
    <div id="page">[[<div class="content"><h1>Heading here</h1><div><p>Text in a nested box that runs on and on for some
    time.</p><p>It has more than one paragraph.<br>And a line break.</p></div><table><tr><th>Name</th><td>Value</td></tr>
    </table><figure><img src="i"><figcaption>What it shows</figcaption></figure><pre>code is shown</pre></div>]]<div
    class="sidebar"><h3>Related</h3><ul><li><a href="/3">C</a></li><li><a href="/4">D</a></li></ul></div></div>
    <div class="comments"><p>Nice one, thanks</p><form><input name="q"><button>Send</button></form></div></body>""",
    """<body><header><h2>Paper</h2><nav><a href="/">Start</a><a href="/s">Sport</a></nav></header><div class="cookie-notice">
    <p>We use cookies to give you the best service</p><button>Yes</button></div><main>[[<section><h1>What went on today</h1>
    <p>It was <em>said</em> that <i>this</i> and <strong>that</strong> came about.</p><p>Nobody <span>knows</span> why.</p>
    <ol><li>first</li><li>second</li></ol><dl><dt>term</dt><dd>meaning</dd></dl></section>]]</main><div class="ad"><a
    href="/buy">Buy now for less</a></div><div><a href="/p">Privacy</a> <a href="/t">Terms</a></div></body>""",
    """<body><div class="bar"><a href="/">Home</a><a href="/n">News</a><a href="/s">Sport</a><a href="/o">Our
    team</a><a href="/c">Contact us</a></div><div><div class="post">[[<h1>
    <a href="/w">A title that is a link</a></h1><ul><li><a href="#1">How it all began here</a></li><li><a href="#2">What
    came of it later</a></li></ul><p>It began with a <a href="/f">few words on paper</a> that somebody had left.</p><p>Much
    came of them.</p><ol><li><a href="/r1">Smith, On papers and words</a></li><li><a href="/r2">Jones, A history of small
    things</a></li></ol>]]</div></div><div class="end"><a href="/p">Privacy policy</a><a href="/t">Terms of use</a><a
    href="/i">Imprint</a><a href="/j">Jobs</a></div></body>""",
    """<body><div class="top"><a href="/">Start</a><a href="/m">Map</a></div>[[<article><h1><a href="/w">Linked title</a></h1>
    <ul><li><a href="#a">One</a></li><li><a href="#b">Two</a></li></ul><p>The text of it.</p><h2>References</h2><ul><li><a
    href="/r1">First source</a></li><li><a href="/r2">Second source</a></li></ul></article>]]<div class="end"><a href="/p">
    Privacy</a></div></body>""",
]

# What parts of pages are called in class, id and role, by where they stand.
AROUND = """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar
    navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist reply replies respond disqus
    share sharing social buttons related recommended recommendations toolbar pagination pager login search
    contentinfo complementary copyright imprint""".split()
WITHIN = "post entry article story text main lead intro abstract summary chapter caption code note quote table figure heading title paragraph".split()
#: Words of ``AROUND`` that mean other things as well: a share of a market, the alert of a price.
SENSES = "share alert reply notice header footer menu search banner comment related social login sharing advertisement".split()
#: Words that say of a compound that it is a part of the page.
OFTEN = "site page blog web post article entry main user reader social comment".split()
BEFORE = frozenset([*AROUND, *WITHIN, *OFTEN])
ON_WORDS = "comment keyword string number name highlight term math".split()


def labelled(pages: int = PAGES, seed: int = 42) -> list[str]:
    """Labelled pages made by a rule: a region of headings, paragraphs, lists, tables and links
    in an article, a main element or a box with one of the names ``WITHIN`` or none; around
    it, and now and then within, parts with roles, with names of ``AROUND`` or none, of links,
    of words, or of both. The same seed gives the same pages."""
    draw = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join(["word"] * draw.randint(least, most))

    def links(least: int, most: int, tag: str = "", longest: int = 3) -> str:
        each = [f'<a href="/">{words(1, longest)}</a>' for _ in range(draw.randint(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if tag else " ".join(each)

    def called(name: str) -> str:
        before = draw.choice([draw.choice(OFTEN), draw.choice(sorted(BEFORE))])
        name = draw.choice([name, name, f"{before}-{name}", f"{name}-{draw.choice(sorted(LAYOUT))}", f"{before}{name.title()}"])
        return f'{draw.choice(["class", "class", "id"])}="{name}"'

    def unlike() -> str:
        """A compound of a word that pages do not use for their parts."""
        name = "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
        return f'class="{name}-{draw.choice(SENSES)}"'

    def filling() -> str:
        return draw.choice([lambda: links(2, 8, "ul"), lambda: links(2, 6), lambda: f"<p>{words(2, 40)}</p>", lambda: words(1, 30), lambda: f"<h3>{words(1, 4)}</h3><p>{words(2, 20)}</p>{links(1, 4, 'ul', 8)}", lambda: f"<ul><li>{words(2, 9)}</li><li>{words(2, 9)}</li></ul>"])()

    def part(bare: bool) -> str:
        kind = draw.random()
        if kind < 0.4:
            name = draw.choice(sorted(ROLES - {"head", "option", "fieldset"}))
            return f"<{name}>{filling()}</{name}>"
        if kind < 0.8 or not bare:
            name = draw.choice(AROUND)
            tag = draw.choice(["div", "div", "section", "ul", "p", "span", "table"])
            if tag == "table" and name in SENSES:
                tag = "div"
            where = f'role="{name}"' if name in ("navigation", "banner", "contentinfo", "complementary", "search") else called(name)
            return draw.choice([f"<{tag} {where}>{filling() if tag in ('div', 'section') else f'<tr><td>{links(1, 6)}</td></tr>' if tag == 'table' else words(1, 20)}</{tag}>", f"<div hidden>{words(1, 20)}</div>", f"<div {where}>{filling()}</div>", f"<div {where}>{filling()}</div>"])
        return draw.choice([f"<div>{links(2, 6)}</div>", f"<p>{links(2, 5)}</p>", f"<div>{words(1, 4)}</div>", f"<div>{words(1, 3)} {links(1, 3)}</div>"])

    def block() -> str:
        one = draw.choice(["p", "p", "p", "p", "list", "links", "quote", "table", "code", "figure", "box", "heading", "section", "terms", "lines", "nested", "unlike", "piece"])
        if one == "p":
            return f"<p>{words(3, 80)} <a href='/'>{words(1, 6)}</a> <em>{words(1, 3)}</em> {words(0, 30)}</p>"
        if one == "list":
            return f"<ul><li>{words(1, 12)}</li><li>{words(1, 12)}<ul><li>{words(1, 6)}</li></ul></li></ul>"
        if one == "links":
            return f"<h2>{words(1, 3)}</h2>" + links(2, 9, "ul", 12)
        if one == "quote":
            return f"<blockquote><p>{words(4, 30)}</p></blockquote>"
        if one == "table":
            return f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if one == "code":
            return f"<pre><code>{words(2, 20)} <span class='{draw.choice(ON_WORDS)}'>{words(1, 6)}</span></code></pre>"
        if one == "figure":
            return f"<figure><img src='i'><figcaption>{words(2, 12)}</figcaption></figure>"
        if one == "box":
            return f"<div {called(draw.choice(WITHIN))}><p>{words(3, 40)}</p></div>"
        if one == "lines":
            return "".join(f"<div>{words(1, 12)}</div>" for _ in range(draw.randint(2, 5)))
        if one == "unlike":
            tag = draw.choice(["div", "div", "p", "section"])
            return f"<{tag} {unlike()}>{words(1, 20)}</{tag}>"
        if one == "piece":
            name = f'class="{draw.choice(SENSES)}"'
            return draw.choice([f"<figure {name}><img src='i'><figcaption>{words(2, 12)}</figcaption></figure>", f"<table {name}><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", f"<blockquote {name}>{words(3, 20)}</blockquote>", f"<pre {name}>{words(2, 12)}</pre>"])
        if one == "nested":
            return f"<div><div><p>{words(3, 40)}</p></div><div>{words(1, 20)}<br>{words(1, 20)}</div></div>"
        if one == "heading":
            return f"<{(h := draw.choice(['h2', 'h3']))} id='{draw.choice(AROUND)}'>{words(1, 6)}</{h}>"
        if one == "section":
            return f"<section id='{draw.choice(AROUND)}'><h2>{words(1, 4)}</h2><p>{words(5, 50)}</p></section>"
        return f"<dl><dt>{words(1, 3)}</dt><dd>{words(2, 12)}</dd></dl>"

    def region() -> str:
        title = words(2, 10)
        parts = [f"<h1><a href='/'>{title}</a></h1>" if draw.random() < 0.2 else f"<h1>{title}</h1>" if draw.random() < 0.9 else ""]
        parts += [block() for _ in range(draw.randint(2, 14))]
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            parts.insert(draw.randint(1, len(parts)), "{{" + part(False) + "}}")
        if draw.random() < 0.1:
            parts[0] = "{{<header>" + words(2, 6) + "</header>}}" + parts[0]
        return "".join(parts)

    def page() -> str:
        frame = draw.choice(["article", "article", "main", "main article", "named", "named", "none"])
        text = region()
        if frame == "article":
            text = f"[[<article>{text}</article>]]"
        elif frame == "main":
            text = f"<main>[[{text}]]</main>"
        elif frame == "main article":
            text = f"<main>[[<article>{text}</article>]]</main>"
        elif frame == "named":
            text = f"<div {called(draw.choice(WITHIN))}>[[{text}]]</div>"
        else:
            text = f"<div>[[{text}]]</div>"
        # beside an article, any text may stand outside of it
        bare = [f"<div><p>{words(2, 30)}</p></div>", f"<p>{words(2, 20)}</p>"] if "a" in frame.split()[0] and frame != "named" else []
        before = [part(True) for _ in range(draw.randint(0, 4))] + ([draw.choice(bare)] if bare and draw.random() < 0.4 else [])
        after = [part(True) for _ in range(draw.randint(0, 4))] + ([draw.choice(bare)] if bare and draw.random() < 0.4 else [])
        draw.shuffle(before)
        draw.shuffle(after)
        return "<html><body>" + "".join(before) + text + "".join(after) + "</body></html>"

    return [page() for _ in range(pages)]


_marks = re.compile(r"(\[\[|\]\]|\{\{|\}\})")


def learn(pages: list[str], ridge: float = 0.05, rounds: int = 12) -> Weights:
    """Weights from labelled pages. Words: logistic regression, by Newton's method, of
    lying in the text on the features of each run of words. Tags: log odds of lying in the
    region, smoothed by one half, and not above -0.01."""
    rows: list[tuple[list[str], bool]] = []
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    # which elements are articles does not hang on weights, except for what is learned of their names
    for html in pages:
        page = Page(html)
        state = State(page, NOTHING)
        within = hole = False
        for e, text, n in page.tokens:
            if n < 0:
                if not hole:
                    into = inside if within else outside
                    kind = f"{'own' if state.own[e] or state.own[page.parent[e]] else 'tag'}:{text}"
                    into[kind] = into.get(kind, 0) + 1
                continue
            for piece in _marks.split(text):
                if piece in ("[[", "]]"):
                    within = piece == "[["
                elif piece in ("{{", "}}"):
                    hole = piece == "{{"
                elif piece.split():
                    rows.append((state.features(page, e, n), within and not hole))
    kinds = {f: k for k, f in enumerate(sorted({f for fs, _ in rows for f in fs}))}
    x = np.zeros((len(rows), len(kinds) + 1))
    x[:, -1] = 1
    for k, (fs, _) in enumerate(rows):
        for f in fs:
            x[k, kinds[f]] += 1
    y = np.array([float(t) for _, t in rows])
    w, penalty = np.zeros(len(kinds) + 1), np.full(len(kinds) + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(step, x.T @ (y - p) - penalty * w)
    tags = {k: min(-0.01, math.log((inside.get(k, 0) + 0.5) / (outside.get(k, 0) + 0.5))) for k in {*inside, *outside}}
    return Weights({f: float(w[k]) for f, k in kinds.items()}, float(w[-1]), tags)


@lru_cache(maxsize=1)
def known() -> Weights:
    """The weights of ``LABELLED`` and the pages that are made."""
    return learn([*LABELLED, *labelled()])


def main_text(pages: DataFrame, weights: Weights | None = None, *, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (its code points) of each page."""
    weights = weights or known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(h, weights) for h in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:-1], ("text", pa.string()), ("n_chars", pa.int64())]))

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_arrow(pages.select(*keep, html), run, schema)
