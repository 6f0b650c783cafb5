"""Main-text extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. The words of a block score by what is known of it: the elements it stands in and
the words of their class, id and role names, its length, its share of links and of the page. The weights are those of a
logistic model learned from labelled pages; no name or tag decides by itself, and a name that the labelled pages show
inside and outside articles counts for nothing. Tags score negative, by the learned odds of standing within a main text;
an element all of whose blocks score below ``DROP`` counts once, however many words it holds, so that an advert or
the readers' comments in an article don't part it. One linear scan finds the contiguous region with the largest sum,
and its blocks but for those below ``DROP`` are the text.

Every step is linear in the page. Defined cases: null or empty html gives an empty text; unclosed and stray tags are
closed or passed over; an unclosed comment, script or style runs to the end of the page, and so does a tag without an
end; a page without words gives an empty text; ties go to the region that begins first and then to the shorter one;
repeated rows each give their row; an empty table gives an empty result; columns other than page_id, url and html are
not looked at.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "canvas", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SPACED = {"br", "img"}
#: Elements that say nothing by their tag.
PLAIN = {"html", "body", "div", "span", "section", "p", "font", "center", "tbody", "table", "tr", "td"}
#: Start tags that end open elements of these kinds.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Share of a page's words from which an element's names are those of a frame around content and rest alike.
FRAME = 0.6
#: Share from which an article element counts as the page's holder of text.
HOLDER = 0.3
LIMIT = 4.0
#: Shares of the tags' log-odds that are tried as their weights.
SCALES = (1.0, 0.3, 0.1, 0.03)
#: Log-odds below which a block within the region is none of the text: only on clear evidence.
DROP = -1.5

# Words that pages use in class, id and role names of what isn't article text, by what it is.
ADVERTS = "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot adbox adsense adunit advertorial cta".split()
MENUS = "menu menus nav navbar navigation breadcrumb breadcrumbs toc topbar toolbar masthead pagination pager tags".split()
NOTICES = "cookie cookies consent gdpr notice notices alert disclaimer paywall popup modal overlay legal copyright".split()
SIDES = "sidebar sidebars side rail aside widget widgets related recommended recommendations popular trending teaser recommend".split()
SHARES = "share sharing social subscribe subscription newsletter signup login search".split()
TALK = "comment comments commentlist respond reply replies disqus discussion reviews feedback responses".split()
FOOTS = "footer foot bottom imprint".split()
#: And of what is, or of frames around all of a page.
WANTED = "article content post entry story main body text prose markdown".split()
FRAMES = "page wrapper container site outer layout root app grid row wrap".split()
NEUTRAL = "more continued part col block inner box first second lead intro enabled open has with no".split()
#: What a name is one of, as a feature beside the name itself.
KINDS = {n: kind for kind, names in {"advert": ADVERTS, "menu": MENUS, "notice": NOTICES, "side": SIDES, "share": SHARES, "talk": TALK, "foot": FOOTS, "wanted": WANTED}.items() for n in names}


_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*+")


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id and role; whether the element is hidden."""
    names: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.update(x.lower() for x in _PARTS.findall(value))
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "hidden":
            hidden = True
        else:
            hidden |= value.lower() == "true"
    return names, hidden


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    names: set[str]
    hidden: bool
    words: int = 0
    block: int = 0  # the nearest element that isn't inline


@dataclass(slots=True)
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0


@dataclass
class Page:
    """Elements, blocks of text, and the sequence of tags and blocks: ("inline" or "block", element) and (None, block)."""

    elements: list[Element]
    blocks: list[Block]
    sequence: list[tuple[str | None, int]]


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, name with a leading slash for end tags, attributes) of the tags in order; the name is empty for
    comments and declarations. Raw elements come as one tag up to their end."""
    low, last, quoted, pos = page.lower(), page.rfind(">"), True, 0
    while (at := page.find("<", pos)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", ""
            pos = end
            continue
        mark = page[at + 1 : at + 2]
        name = _NAME.match(page, at + 2 if mark == "/" else at + 1)
        if not name and mark not in ("!", "?"):
            pos = at + 1
            continue
        begin = name.end() if name else at + 2
        m = _ATTRIBUTES.match(page, begin) if quoted and begin <= last else None
        if m:
            end = m.end()
        else:  # an open quote: from here on quotes hide nothing
            quoted = quoted and begin > last
            end = page.find(">", begin) + 1 if begin <= last else len(page)
        attributes = page[begin : end - 1]
        tag = name[0].lower() if name else ""
        if tag in RAW and mark != "/":
            close = low.find(f"</{tag}", end)
            while close >= 0 and low[close + len(tag) + 2 : close + len(tag) + 3].isalnum():
                close = low.find(f"</{tag}", close + 1)
            end = len(page) if close < 0 else (page.find(">", close) + 1 or len(page))
        yield at, end, f"/{tag}" if mark == "/" and tag else tag, attributes
        pos = end


def parse(page: str) -> Page:
    elements = [Element("", -1, set(), False)]
    out = Page(elements, [], [])
    stack, opened = [0], Counter()
    at, fresh = 0, True

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        if fresh:
            out.blocks.append(Block(elements[stack[-1]].block))
            out.sequence.append((None, len(out.blocks) - 1))
            fresh = False
        b = out.blocks[-1]
        plain = html.unescape(raw) if "&" in raw else raw
        b.parts.append(plain)
        n = len(plain.split())
        b.words += n
        b.linked += n if opened["a"] else 0

    def leave(depth: int) -> None:
        for k in stack[depth:]:
            opened[elements[k].tag] -= 1
        del stack[depth:]

    def end_of(kinds: set[str], tag: str) -> None:
        """Ends the innermost blocks of these kinds, up to one of ``tag``."""
        while (e := elements[stack[-1]].block) and elements[e].tag in kinds:
            depth = len(stack) - 1
            while stack[depth] != e:
                depth -= 1
            leave(depth)
            if elements[e].tag == tag:
                break

    for begin, end, tag, attributes in _tags(page):
        text(page[at:begin])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if opened[tag] > 0:
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag:
                    depth -= 1
                leave(depth)
        elif tag in RAW:
            if tag not in INLINE:
                fresh = True
            continue
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in ENDS:
                end_of(ENDS[tag], tag)
            elif tag not in INLINE:
                end_of({"p"}, "p")
            names, hidden = _names(attributes) if attributes and not attributes.isspace() else (set(), False)
            elements.append(Element(tag, stack[-1], names, hidden))
            k = len(elements) - 1
            elements[k].block = elements[stack[-1]].block if tag in INLINE else k
            stack.append(k)
            opened[tag] += 1
        if tag in SPACED:
            text(" ")
        elif tag not in INLINE:
            fresh = True
        out.sequence.append(("inline" if tag in INLINE else "block", stack[-1]))
    text(page[at:])
    for b in out.blocks:
        elements[b.element].words += b.words
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    return out


def _bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def features(page: Page) -> list[frozenset[str]]:
    """The features of each block."""
    total = max(page.elements[0].words, 1)
    within: list[frozenset[str]] = [frozenset()]
    nearest: list[frozenset[str]] = [frozenset()]
    for e in page.elements[1:]:
        own = set()
        if e.tag not in ("html", "body"):  # these carry names of all kinds
            kind = "frame" if e.words >= FRAME * total else "in"
            own = {f"{kind} {n}" for n in e.names} | {f"{kind} kind {KINDS[n]}" for n in e.names if n in KINDS}
            if e.tag not in PLAIN and e.tag not in INLINE:
                own.add(f"tag {e.tag}")
                if e.tag in ("header", "footer", "aside") and "tag article" in within[e.parent]:
                    own.add(f"tag {e.tag} of article")
            if e.tag == "article":
                own |= {f"article {x}" for x in within[e.parent] if x.startswith("in ")}
            if e.hidden:
                own.add("hidden")
        within.append(within[e.parent] | own if own else within[e.parent])
        nearest.append(frozenset(f"at {x}" for x in own) if own else nearest[e.parent])
    bare = not any(within)
    out, held = [], any(e.tag in ("article", "main") and e.words >= HOLDER * total for e in page.elements)
    for b in page.blocks:
        last = b.parts[-1].rstrip()[-1:] if b.parts else ""
        share = b.linked / b.words if b.words else 0
        own = {f"links {_bucket(share, (0.01, 0.3, 0.7))}", f"words {_bucket(b.words, (3, 6, 11, 26, 60))}", f"share {_bucket(b.words / total, (0.1, 0.3, 0.7))}", f"ends {last in '.?!…:;。！？' and last != ''}"}
        article = "tag article" in within[b.element] or "tag main" in within[b.element]
        if share >= 0.7:
            own.add(f"links in article {article}")
        if bare:
            own.add("bare page")
        if held and not article:
            own.add("beside an article")
        out.append(within[b.element] | nearest[b.element] | own)
    return out


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


@dataclass
class Weights:
    #: Of features, and the offset.
    of: dict[str, float]
    offset: float
    #: Of an inline and a block tag, and of an element without text.
    tags: dict[str, float]

    def score(self, found: frozenset[str]) -> float:
        s = self.offset
        for f in found:
            s += self.of.get(f, 0.0)
        return max(-LIMIT, min(LIMIT, s))


def learn(labelled: Iterable[tuple[str, list[str]]], ridge: float = 0.3, rounds: int = 30) -> Weights:
    """Weights from (html, blocks of the main text). A logistic model of blocks lying in the main text, each block by the
    logarithm of its words, is fitted by Newton's method; tags take the log-odds of lying between the first and the last
    block of it, held below zero, times the one of SCALES with the fewest errors, a lost block being two."""
    labelled = list(labelled)
    rows, y, weight = [], [], []
    inside, outside = Counter(), Counter()
    for page, wanted in labelled:
        p, good = parse(page), {" ".join(b.split()) for b in wanted}
        hit = [_clean(b.parts) in good for b in p.blocks]
        for b, found, h in zip(p.blocks, features(p), hit, strict=True):
            if b.words:
                rows.append(found), y.append(h), weight.append(1 + math.log(b.words))
        span = [i for i, (kind, k) in enumerate(p.sequence) if kind is None and hit[k]]
        lo, hi = (span[0], span[-1]) if span else (0, -1)
        for i, (kind, _) in enumerate(p.sequence):
            if kind:
                (inside if lo <= i <= hi else outside)[kind] += 1
    names = sorted(set().union(*rows)) if rows else []
    place = {n: i + 1 for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, found in enumerate(rows):
        x[i, [place[f] for f in found]] = 1
    t, c, w = np.array(y, float), np.array(weight), np.zeros(len(names) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (c * (p - t)) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-6:
            break
    odds = {k: min(0.0, math.log((inside[k] + 0.5) / (outside[k] + 0.5))) - 0.05 for k in ("inline", "block")}
    of, best = dict(zip(names, w[1:].tolist(), strict=True)), None
    for scale in SCALES:
        tried = Weights(of, float(w[0]), {"inline": odds["inline"] * scale, "block": odds["block"] * scale, "dead": odds["block"]})
        wrong = 0
        for page, blocks in labelled[::5]:
            got, want = Counter(extract(page, tried).split("\n")), Counter(" ".join(b.split()) for b in blocks)
            wrong += 2 * (want - got).total() + (got - want).total()
        if best is None or wrong < best[0]:
            best = wrong, tried
    return best[1]


def extract(page: str, weights: Weights) -> str:
    """The text of the best region."""
    p = parse(page)
    score = [weights.score(f) if b.words else 0.0 for b, f in zip(p.blocks, features(p), strict=True)]
    # elements that hold a block of the text, if in the region; the topmost ones that hold none count once
    alive = [False] * len(p.elements)
    for b, s in zip(p.blocks, score, strict=True):
        alive[b.element] |= s > DROP and b.words > 0
    for k in range(len(p.elements) - 1, 0, -1):
        alive[p.elements[k].parent] |= alive[k]
    dead = list(range(len(p.elements)))
    for k in range(1, len(p.elements)):
        up = p.elements[k].parent
        dead[k] = dead[up] if not alive[up] else k
    best, total, begin, counted = (0.0, 0, 0), 0.0, 0, set()
    for i, (kind, k) in enumerate(p.sequence):
        e = k if kind else p.blocks[k].element
        if not alive[e]:
            if dead[e] in counted:
                continue
            counted.add(dead[e])
            total += weights.tags["dead"]
        elif kind:
            total += weights.tags[kind]
        else:
            total += score[k] * p.blocks[k].words if score[k] > 0 else score[k]
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best[0]:
            best = (total, begin, i + 1)
    _, lo, hi = best
    kept = (_clean(p.blocks[k].parts) for kind, k in p.sequence[lo:hi] if kind is None and score[k] > DROP)
    return "\n".join(b for b in kept if b)


class _Maker:
    """Pages of varied layouts with known main text."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.serial = 0
        self.wanted: list[str] = []

    def words(self, lo: int, hi: int, end: str = ".") -> str:
        self.serial += 1
        n = self.r.randint(lo, hi)
        return " ".join([f"Wo{self.serial}rd", *(f"{self.r.choice('abcdefgh')}{self.r.randrange(999)}" for _ in range(n - 1))]) + end

    def named(self, *lists: list[str]) -> str:
        return "-".join(self.r.choice(x) for x in lists)

    def attribute(self, name: str) -> str:
        return f' {self.r.choice(("class", "class", "class", "id"))}="{name}"'

    def links(self, n: int, tag: str) -> str:
        items = "".join(f"<li><a href='/x'>{self.words(1, 4, '')}</a></li>" for _ in range(n))
        return f"<{tag}>{items}</{tag}>"

    def unwanted(self, kind: list[str]) -> str:
        """An element of what isn't article text."""
        r = self.r
        tag = {id(MENUS): ("nav", "div", "ul", "header"), id(SIDES): ("aside", "div", "section"), id(FOOTS): ("footer", "div"), id(SHARES): ("div", "form", "section"), id(TALK): ("div", "section", "ol", "article"), id(NOTICES): ("div", "section", "p", "dialog"), id(ADVERTS): ("div", "div", "section", "aside")}[id(kind)]
        tag = r.choice(tag)
        name = self.attribute(self.named(kind) if r.random() < 0.6 else self.named(kind, r.choice((kind, NEUTRAL, FRAMES, ["list", "box", "area"])))) if tag in ("div", "section", "ul", "p", "ol", "article") or r.random() < 0.4 else ""
        if kind is not TALK and r.random() < 0.12:
            name = ""
        if kind is MENUS and tag == "header" and r.random() < 0.5:
            inner = f"<h1>{self.words(1, 4, '')}</h1>" + (f"<p>{self.words(2, 8, '')}</p>" if r.random() < 0.3 else "")
            return f"<{tag}{name}>{inner}</{tag}>"
        if kind is TALK:
            inner = "".join(f"<{t}{self.attribute(self.named(TALK)) if r.random() < 0.5 else ''}>{self.words(2, 60)}</{t}>" for t in r.choices(("p", "div", "li"), k=r.randint(1, 5)))
            if tag != "article" and r.random() < 0.3:
                inner = "".join(f"<article><p>{self.words(2, 60)}</p></article>" for _ in range(r.randint(1, 3)))
            inner += "<a href='#'>reply</a>" if r.random() < 0.5 else ""
        elif kind in (MENUS, SIDES) and r.random() < 0.75:
            inner = (f"<h3>{self.words(1, 3, '')}</h3>" if r.random() < 0.4 else "") + self.links(r.randint(2, 9), "ul")
        elif tag == "form":
            inner = f"<label>{self.words(1, 6, '')}</label><input name='q'><button>{self.words(1, 2, '')}</button>"
        elif kind is SHARES:
            inner = " ".join(f"<a href='/s'>{self.words(1, 2, '')}</a>" for _ in range(r.randint(1, 5))) + (self.words(1, 8) if r.random() < 0.5 else "")
        else:
            inner = self.words(2, 45) if r.random() < 0.5 else f"<p>{self.words(2, 45)}</p>"
            inner += f" <a href='/y'>{self.words(1, 3, '')}</a>" if r.random() < 0.4 else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def block(self) -> str:
        """A block of article text."""
        r = self.r
        kind = r.choices(("p", "h2", "li", "blockquote", "td", "pre", "figcaption", "div", "link", "open"), (16, 2, 2, 1, 1, 1, 1, 2, 1, 3))[0]
        if kind in ("h2", "figcaption"):
            t = self.words(1, 9, r.choice(("", ".")))
        else:
            t = self.words(1, r.choice((2, 5)), r.choice((".", "", "!"))) if r.random() < 0.25 else self.words(4, r.choice((12, 40, 120)), r.choice((".", ".", ".", "!", "", ":")))
        self.wanted.append(t)
        first, _, rest = t.partition(" ")
        marked = r.choice((t, f"<b>{first}</b> {rest}", f"<a href='/in'>{first}</a> {rest}", f"{first} <a href='/in'>{rest}</a>" if len(rest) < 40 else t, f"<em>{t}</em>"))
        if kind == "link":
            return f"<p><a href='/full'>{t}</a></p>"
        if kind == "open":
            return f"<p>{marked}"
        shape = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "figcaption": "<figure><figcaption>{}</figcaption></figure>"}.get(kind, f"<{kind}>{{}}</{kind}>")
        return shape.format(marked)

    def article(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.8:
            title = self.words(2, 9, "")
            self.wanted.append(title)
            h = f"<h1>{title}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.2 else h)
        for _ in range(r.choice((1, 2, 3, 5, 9))):
            b = self.block()
            x = r.random()
            if x < 0.12:  # a holder of any name
                b = f"<div{self.attribute(self.named(NEUTRAL, r.choice((WANTED, NEUTRAL)))) if r.random() < 0.5 else self.attribute(self.named(NEUTRAL))}>{b}{self.block()}</div>"
            elif x < 0.17:
                b = f"<div{self.attribute(self.named(r.choice((SHARES, TALK, SIDES, ADVERTS, MENUS)), WANTED))}>{b}{self.block()}</div>"
            parts.append(b)
            if r.random() < 0.18:
                parts.append(self.unwanted(r.choice((ADVERTS, ADVERTS, SHARES, SIDES, NOTICES, TALK))))
        if r.random() < 0.2:
            parts.append(f"<footer>{self.words(2, 12)}</footer>")
        if r.random() < 0.3:
            parts.append(self.unwanted(TALK))
        inner = "".join(parts)
        shape = r.randrange(10)
        names = self.attribute(self.named(WANTED) if r.random() < 0.6 else self.named(WANTED, r.choice((WANTED, NEUTRAL))))
        if r.random() < 0.15:
            names = self.attribute(f"{self.named(r.choice((TALK, SIDES, ADVERTS, SHARES)), NEUTRAL)} {self.named(WANTED, WANTED)}")
        if shape < 3:
            return f"<article{names if r.random() < 0.4 else ''}>{inner}</article>"
        if shape == 3:
            return f"<main{names if r.random() < 0.4 else ''}>{inner}</main>"
        if shape == 4:
            return f"<main><article><div{names}>{inner}</div></article></main>"
        if shape == 5:
            return f"<div>{inner}</div>"
        if shape == 9:
            return inner
        if shape == 6:
            return f"<table><tr><td{names}>{inner}</td></tr></table>"
        return f"<{r.choice(('div', 'section'))}{names}>{inner}</div>"

    def page(self) -> tuple[str, list[str]]:
        r, self.wanted = self.r, []
        if r.random() < 0.06:  # an article and nothing else
            parts = "".join(self.block() for _ in range(r.choice((1, 2, 4))))
            return f"<html><body>{self.article() if r.random() < 0.5 else parts}</body></html>", self.wanted
        if r.random() < 0.05:  # a page that is nothing but its text
            t = self.words(1, 60, r.choice(("", ".")))
            return f"<html><body>{t if r.random() < 0.5 else f'<p>{t}</p>'}</body></html>", [t]
        before = [self.unwanted(k) for k in (MENUS, NOTICES, ADVERTS, SHARES, MENUS, SIDES) if r.random() < 0.45]
        body = self.article()
        after = [self.unwanted(k) for k in (TALK, SIDES, SHARES, ADVERTS, NOTICES, FOOTS) if r.random() < 0.45]
        if r.random() < 0.1:
            after.append(f"<div style='display:none'><p>{self.words(3, 40)}</p></div>")
        inner = "".join([*before, body, *after])
        for _ in range(r.choice((0, 0, 1, 2))):
            extra = f" {self.named(['has', 'with', 'no'], r.choice((SIDES, TALK, ADVERTS, MENUS)))}" if r.random() < 0.4 else ""
            inner = f"<div{self.attribute(self.named(FRAMES) + extra)}>{inner}</div>"
        return f"<html><head><title>{self.words(1, 5, '')}</title></head><body{self.attribute(self.named(TALK)) if r.random() < 0.1 else ''}>{inner}</body></html>", self.wanted


def labelled_pages(n: int = 1_500, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with known main text, made by rule: varied frames, holders and names, with what isn't article text around
    and within the article, and names of the one kind on the other. The labels are the article's blocks."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


def report(pages: DataFrame, labelled: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row. ``labelled``: a few pages to learn from, instead of the
    built-in ones; they are handled on the driver."""
    weights = learn(labelled or labelled_pages())

    @F.pandas_udf("string")
    def main_text(texts: pd.Series) -> pd.Series:
        return pd.Series([extract(t, weights) for t in texts], dtype=object)

    out = pages.select("page_id", "url", main_text(F.coalesce("html", F.lit(""))).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
