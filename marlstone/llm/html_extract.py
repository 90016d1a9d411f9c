"""Main text of web pages: flat text blocks, features of a block and its neighbours, a decision tree.

A page becomes a flat list of text blocks. A block's features are its own, the previous and the next
block's number of words and link density, and what kind of elements it stands in. A decision tree,
grown on the small labelled table below, says which blocks are main text.

Elements that look like edges by element, class, id or role (zones) only count as such if they don't
hold the page's article: names such as `sidebar` also stand on wrappers of whole pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import tidy

# Element names by what they do to the text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style textarea title noscript iframe noembed noframes template svg".split())
BODY = frozenset("article main".split())
EDGE = frozenset("nav aside footer form menu button select dialog fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br hr td th li".split())
#: An end tag doesn't close an element outside the last of these, unless it is of that kind itself.
BARRIER = frozenset("article main body table".split())
# Parts of class names, ids and roles of what isn't an article. Those of HEAD count outside articles only.
COMMENT = re.compile(r"comments?|commentlist|commentary|disqus|replies|reply|respond|livefyre")
HINT = re.compile(r"ads?|advert\w*|adsbygoogle|alert|breadcrumbs?|complementary|consent|contentinfo|cookies?|dialog|footer|gdpr|login|menu|menubar|modal|nav\w*|newsletter|notices?|offcanvas|outbrain|pager|pagination|popup|promo\w*|recommend\w*|related|search|share|sharing|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|taboola|toolbar|topbar|widget")
HEAD = re.compile(r"banner|header|masthead")
#: With one of these a token names a part of an article or a layout, and is no hint of HEAD (first) or of any kind (second).
OF_ARTICLE = frozenset("article content entry post story title section".split())
OF_LAYOUT = frozenset("has with no without is not".split())

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: One attribute, possessive so that no place is read twice: a name and a quoted or bare value. A quote that never ends is a bare value.
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_TAG_END = re.compile(r"[\s/]*+>")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Zone:
    """An element that may be an edge or holds an article. `kind`: edge, hint, comment or body; `words` are unlinked ones in it."""

    kind: str
    above: int
    name: str
    words: int = 0
    void: bool = False


@dataclass
class Block:
    """A run of text between block elements. words and linked count words; the flags tell where it stands."""

    text: str
    words: int
    linked: int
    body: bool
    edge: bool
    hint: bool
    heading: bool
    zone: int = -1

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@lru_cache(50_000)
def _parts(token: str) -> tuple[str, ...]:
    return tuple(p for p in re.split(r"[_\W]+", _CAMEL.sub("-", token).lower()) if p)


def zone_of(name: str, said: list[str], in_body: bool) -> str | None:
    """The kind of zone that an element with these class, id and role values opens, if any."""
    if name in ("html", "body"):
        return None
    kind = "edge" if name in EDGE or name == "header" and not in_body else None
    for token in " ".join(said).split():
        parts = _parts(token[:200])
        if not parts or OF_LAYOUT.intersection(parts[:1]):
            continue
        # An article's own class names its subject; only whole words of it count.
        tested = parts if name not in BODY else parts[:1]
        if any(COMMENT.fullmatch(p) for p in tested):
            return "comment"
        if name in BODY and len(parts) > 1:
            continue
        if any(HINT.fullmatch(p) for p in parts) or not in_body and name not in BODY and any(HEAD.fullmatch(p) for p in parts) and not OF_ARTICLE.intersection(parts):
            kind = kind or "hint"
    return kind or ("body" if name in BODY else None)


class _Page:
    """Reads a page once, from its first to its last character."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.blocks: list[Block] = []
        self.zones: list[Zone] = []
        self.stack: list[tuple[str, int]] = []  # name and its zone, or -1
        self.places: dict[str, list[int]] = {}
        self.zone = -1
        self.counts = {"a": 0, "head": 0, "body": 0, "heading": 0}
        self.parts: list[tuple[str, bool]] = []
        self.absent: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """The place of `what`, or -1, which is remembered as it then holds for all later places."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """Where the end tag of a dropped element ends, or -1."""
        if name in self.absent:
            return -1
        found = re.compile(rf"</{name}(?:[\s/][^>]*+)?>", re.I).search(self.page, at)
        if not found:
            self.absent.add(name)
            return -1
        return found.end()

    def count(self, name: str, by: int) -> None:
        if name in ("a", "head"):
            self.counts[name] += by
        elif name in BODY:
            self.counts["body"] += by
        elif name in HEADING:
            self.counts["heading"] += by

    def push(self, name: str, said: list[str]) -> None:
        kind = zone_of(name, said, self.counts["body"] > 0)
        zone = -1
        if kind:
            zone = len(self.zones)
            self.zones.append(Zone(kind, self.zone, name))
            self.zone = zone
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, zone))
        self.count(name, 1)

    def pop(self, k: int) -> None:
        """Close the elements from the k-th on."""
        while len(self.stack) > k:
            name, zone = self.stack.pop()
            self.places[name].pop()
            self.count(name, -1)
            if zone >= 0:
                self.zone = self.zones[zone].above

    def close(self, name: str) -> None:
        """An end tag: close the innermost element of that name, if it stands inside the last barrier."""
        own = self.places.get(name)
        if own:
            wall = -1 if name in BARRIER or name == "html" else max((self.places[b][-1] for b in BARRIER if self.places.get(b)), default=-1)
            if own[-1] >= wall:
                self.pop(own[-1])

    def flush(self) -> None:
        """End the block."""
        if self.parts:
            # Each part is decoded alone, as a reference never spans a tag.
            decoded = [(entities.unescape(t), a) for t, a in self.parts]
            text = " ".join("".join(t for t, _ in decoded).split())
            if text and not self.counts["head"]:
                linked = len(" ".join(t for t, a in decoded if a).split())
                words = len(text.split())
                self.blocks.append(Block(text, words, linked, False, False, False, self.counts["heading"] > 0, self.zone))
                if self.zone >= 0:
                    self.zones[self.zone].words += max(0, words - linked)
            self.parts.clear()

    def say(self, text: str) -> None:
        self.parts.append((text, self.counts["a"] > 0))

    def attributes(self, at: int) -> tuple[int, list[str], bool]:
        """From behind a tag's name: where the tag ends (-1: not at all), class, id and role values, and whether it ends in a slash."""
        said = []
        while not (end := _TAG_END.match(self.page, at)):
            m = _ATTR.match(self.page, at)
            if not m or m.end() == at:
                return -1, said, False
            at = m.end()
            if m[1].lower() in ("class", "id", "role"):
                said.append(m[2] or m[3] or m[4] or "")
        return end.end(), said, end[0].endswith("/>")

    def read(self) -> None:
        page, n, at = self.page, len(self.page), 0
        while at < n:
            lt = self.find("<", at)
            if lt < 0:
                self.say(page[at:])
                break
            if lt > at:
                self.say(page[at:lt])
            m = _NAME.match(page, lt)
            if m:
                at = self.tag(m)
                if at < 0:
                    break
            elif page.startswith("<!--", lt) and (end := self.find("-->", lt + 2)) >= 0:
                at = end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?") or page.startswith("</", lt) and lt + 2 < n:
                end = self.find(">", lt)  # a declaration, a comment that never ends or a bogus one
                at = n if end < 0 else end + 1
            else:
                self.say("<")
                at = lt + 1
        self.flush()

    def tag(self, m: re.Match) -> int:
        """Take in a tag; where to read on, or -1 if the page ends within it."""
        name = m[2].lower()
        at, said, slash = self.attributes(m.end())
        if at < 0:
            return -1
        if name in BLOCK:
            self.flush()
        if name in SPACE:
            self.say(" ")
        if m[1]:
            self.close(name)
            return at
        if name in DROPPED:
            end = -1 if slash and name == "svg" else self.end_tag(name, at)
            # Only scripts and styles that never end take the rest of the page with them.
            return len(self.page) if end < 0 and name in ("script", "style") else max(end, at)
        if name in VOID:
            return at
        if name in ("p", "li", "dd", "dt", "option", "tr", "td", "th") or name in HEADING:
            closes = {"p", *HEADING} if name not in ("li", "dd", "dt", "tr", "td", "th") else {"p", name}
            for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 4), -1):
                if self.stack[k][0] in closes:
                    self.pop(k)
                    break
                if self.stack[k][0] in BLOCK:
                    break
        self.push(name, said)
        return at

    def settle(self) -> None:
        """Say which zones hold the page's article after all, and with that the flags of the blocks."""
        zones, total = self.zones, sum(max(0, b.words - b.linked) for b in self.blocks)
        for z in reversed(zones):  # an element is numbered after those that it stands in
            if z.above >= 0:
                zones[z.above].words += z.words
        bodies = [i for i, z in enumerate(zones) if z.kind == "body"]
        if bodies:
            at = max(bodies, key=lambda i: (zones[i].words, -i))
            while (at := zones[at].above) >= 0:
                zones[at].void = zones[at].kind in ("hint", "edge")
        else:
            said = total - sum(z.words for z in zones if z.kind == "comment" and (z.above < 0 or zones[z.above].kind != "comment"))
            for z in zones:
                z.void = z.words * 5 >= said * 4 > 0 and (z.kind == "hint" or z.name in ("form", "fieldset"))
        flags: list[tuple[bool, bool, bool]] = []
        for z in zones:
            body, edge, hint = flags[z.above] if z.above >= 0 else (False, False, False)
            flags.append((body or z.kind == "body", edge or z.kind == "edge" and not z.void, hint or z.kind in ("hint", "comment") and not z.void))
        for b in self.blocks:
            if b.zone >= 0:
                b.body, b.edge, b.hint = flags[b.zone]


def segment(page: str) -> list[Block]:
    """The text blocks of a page in order. Comments, scripts, styles, titles and pictures give none.

    Character references are decoded, white space becomes one space and ends are trimmed. An element
    that is never closed ends with its parent; a tag cut off at the end of the page is dropped, as is
    what follows a script or style that never ends. A comment that never ends ends at the next ">", and
    any other dropped element that never ends is a tag like others. Reading takes time in proportion
    to the page, however broken its markup.
    """
    reader = _Page(page)
    reader.read()
    reader.settle()
    return reader.blocks


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "in article or main", "in an edge element", "named as an edge", "heading", "page has an article")

#: The labelled table: features as above, then 1 for main text. Fixed values, one row a block seen or imagined.
LABELLED = np.array(
    [
        # articles: paragraphs of any length, headings, lists, quotes, table cells, at the beginning and at the end of a page
        (9, 0, 7, 0, 22, 0, 1, 0, 0, 1, 1, 1), (22, 0, 9, 0, 30, 0, 1, 0, 0, 0, 1, 1), (30, 0, 22, 0, 1, 0, 1, 0, 0, 0, 1, 1), (1, 0, 30, 0, 60, 0, 1, 0, 0, 0, 1, 1),
        (60, 0.1, 1, 0, 120, 0, 1, 0, 0, 0, 1, 1), (120, 0, 60, 0.1, 12, 0, 1, 0, 0, 0, 1, 1), (3, 0, 120, 0, 9, 0.2, 1, 0, 0, 0, 1, 1), (4, 0.5, 50, 0, 50, 0, 1, 0, 0, 0, 1, 1),
        (2, 1, 40, 0, 80, 0, 1, 0, 0, 0, 1, 1), (5, 0, 0, 0, 14, 0, 1, 0, 0, 1, 1, 1), (14, 0, 5, 0, 0, 0, 1, 0, 0, 0, 1, 1), (200, 0.02, 6, 1, 9, 0.1, 1, 0, 0, 0, 1, 1),
        (8, 0.3, 12, 0, 11, 0, 1, 0, 0, 0, 1, 1), (2, 0, 3, 0, 2, 0, 1, 0, 0, 0, 1, 1), (1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 1, 1), (35, 0.6, 80, 0, 20, 0, 1, 0, 0, 0, 1, 1),
        (1, 0, 40, 0, 0, 0, 1, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1), (4, 0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1), (2, 1, 30, 0, 0, 0, 1, 0, 0, 0, 1, 1), (6, 0, 2, 1, 0, 0, 1, 0, 0, 0, 1, 1), (11, 0, 25, 0, 0, 0, 1, 0, 0, 0, 1, 1),
        # inside articles: comments, adverts, share bars, forms, related links
        (25, 0, 60, 0, 18, 0, 1, 0, 1, 0, 1, 0), (18, 0, 25, 0, 4, 1, 1, 0, 1, 0, 1, 0), (4, 1, 40, 0, 50, 0, 1, 0, 1, 0, 1, 0), (9, 0, 70, 0, 60, 0, 1, 0, 1, 0, 1, 0),
        (3, 0, 40, 0, 2, 0, 1, 1, 0, 0, 1, 0), (2, 0, 3, 0, 44, 0, 1, 1, 0, 0, 1, 0), (7, 1, 30, 0, 7, 1, 1, 1, 0, 0, 1, 0), (55, 0, 30, 0, 16, 0, 1, 0, 1, 0, 1, 0),
        (12, 0, 80, 0, 33, 0, 1, 1, 1, 0, 1, 0), (6, 0, 20, 0, 5, 0.8, 1, 1, 1, 1, 1, 0), (40, 0, 30, 0, 22, 0, 1, 1, 0, 0, 1, 0), (1, 0, 20, 0, 0, 0, 1, 0, 1, 0, 1, 0), (90, 0, 50, 0, 40, 0, 1, 0, 1, 0, 1, 0),
        # around articles: menus, footers, sidebars, notices, adverts
        (1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 0), (2, 1, 1, 1, 10, 0, 0, 1, 0, 0, 1, 0), (8, 0, 1, 1, 9, 0, 0, 0, 1, 0, 1, 0),
        (14, 0, 1, 1, 11, 0, 0, 0, 1, 0, 1, 0), (40, 0, 2, 1, 9, 0, 0, 0, 1, 0, 0, 0), (12, 0, 90, 0, 0, 0, 0, 1, 0, 0, 1, 0), (25, 0, 60, 0, 0, 0, 0, 1, 0, 0, 0, 0),
        (5, 0.6, 33, 0, 0, 0, 0, 1, 0, 0, 1, 0), (60, 0.1, 12, 0, 20, 0.5, 0, 1, 0, 0, 0, 0), (30, 0.2, 44, 0, 3, 1, 0, 1, 1, 0, 1, 0), (3, 0, 0, 0, 5, 1, 0, 1, 0, 1, 0, 0),
        (20, 0, 0, 0, 2, 1, 0, 0, 1, 0, 1, 0), (15, 0.1, 20, 0.2, 1, 1, 0, 1, 1, 0, 0, 0), (70, 0, 15, 0, 22, 0, 0, 0, 1, 0, 0, 0), (33, 0, 40, 0, 41, 0, 0, 0, 1, 0, 0, 0),
        (35, 0, 60, 0, 45, 0, 0, 1, 0, 0, 0, 0), (80, 0, 30, 0, 25, 0, 0, 1, 0, 0, 0, 0), (50, 0, 70, 0, 64, 0, 0, 0, 1, 0, 0, 0), (28, 0, 40, 0, 33, 0, 0, 1, 0, 0, 0, 0),
        # beside an article, in elements without a telling name
        (30, 0, 1, 1, 9, 0, 0, 0, 0, 0, 1, 0), (45, 0, 60, 0, 0, 0, 0, 0, 0, 0, 1, 0), (80, 0, 40, 0, 30, 0, 0, 0, 0, 0, 1, 0), (6, 0, 0, 0, 9, 0, 0, 0, 0, 1, 1, 0), (12, 0, 2, 1, 40, 0, 0, 0, 0, 0, 1, 0), (3, 1, 50, 0, 2, 1, 0, 0, 0, 0, 1, 0),
        (20, 0, 30, 0, 0, 0, 0, 0, 0, 0, 1, 0), (9, 0, 25, 0, 14, 0, 0, 0, 0, 0, 1, 0), (60, 0, 20, 0, 50, 0, 0, 0, 0, 0, 1, 0), (4, 0, 3, 0, 35, 0, 0, 0, 0, 0, 1, 0), (17, 0, 0, 0, 22, 0, 0, 0, 0, 0, 1, 0), (5, 0, 90, 0, 0, 0, 0, 0, 0, 1, 1, 0),
        (110, 0.1, 80, 0, 12, 0.5, 0, 0, 0, 0, 1, 0), (8, 0.5, 30, 0, 5, 0, 0, 0, 0, 0, 1, 0), (25, 0.1, 4, 0.5, 60, 0, 0, 0, 0, 0, 1, 0), (2, 0, 12, 0, 7, 0, 0, 0, 0, 0, 1, 0), (50, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0),
        # in articles, link lists and short texts between others
        (1, 1, 2, 1, 3, 1, 1, 0, 0, 0, 1, 1), (5, 1, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1), (12, 0.9, 4, 1, 6, 0.8, 1, 0, 0, 0, 1, 1), (7, 0.8, 0, 0, 20, 0, 1, 0, 0, 1, 1, 1), (3, 0, 5, 1, 4, 1, 1, 0, 0, 0, 1, 1), (22, 0.7, 9, 0.9, 1, 1, 1, 0, 0, 0, 1, 1),
        # pages without article elements: long text is main, short text follows its neighbours and links
        (80, 0.02, 10, 0, 60, 0, 0, 0, 0, 0, 0, 1), (45, 0, 80, 0, 50, 0, 0, 0, 0, 0, 0, 1), (28, 0.05, 45, 0, 70, 0.1, 0, 0, 0, 0, 0, 1), (6, 0, 70, 0, 55, 0, 0, 0, 0, 0, 0, 1),
        (3, 0, 60, 0, 42, 0, 0, 0, 0, 0, 0, 1), (10, 0, 2, 1, 80, 0, 0, 0, 0, 1, 0, 1), (7, 0, 3, 1, 38, 0, 0, 0, 0, 1, 0, 1), (18, 0, 66, 0, 4, 0.5, 0, 0, 0, 0, 0, 1),
        (120, 0.1, 3, 1, 3, 1, 0, 0, 0, 0, 0, 1), (24, 0.1, 30, 0, 2, 1, 0, 0, 0, 0, 0, 1), (30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (15, 0, 12, 0, 14, 0, 0, 0, 0, 0, 0, 1), (13, 0, 15, 0, 0, 0, 0, 0, 0, 0, 0, 1),
        (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (9, 0.1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1), (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
        (4, 0, 0, 0, 16, 0, 0, 0, 0, 1, 0, 1), (5, 0, 40, 0, 0, 0, 0, 0, 0, 0, 0, 1), (5, 0, 35, 0, 30, 0, 0, 0, 0, 1, 0, 1), (2, 0, 48, 0, 0, 0, 0, 0, 0, 0, 0, 1), (8, 0, 20, 0, 26, 0, 0, 0, 0, 0, 0, 1),
        (3, 1, 4, 1, 2, 1, 0, 0, 0, 0, 0, 0), (5, 0.9, 2, 1, 80, 0, 0, 0, 0, 0, 0, 0), (2, 0, 3, 1, 4, 1, 0, 0, 0, 0, 0, 0), (12, 0.8, 6, 1, 9, 0.9, 0, 0, 0, 0, 0, 0),
        (30, 0.9, 12, 0.8, 8, 1, 0, 0, 0, 0, 0, 0), (9, 0.4, 5, 1, 3, 1, 0, 0, 0, 0, 0, 0), (4, 0, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0), (8, 0, 3, 0.7, 0, 0, 0, 0, 0, 0, 0, 0),
        (2, 1, 0, 0, 60, 0, 0, 0, 0, 0, 0, 0), (1, 1, 60, 0, 0, 0, 0, 0, 0, 0, 0, 0), (4, 1, 70, 0, 0, 0, 0, 0, 0, 0, 0, 0), (6, 1, 0, 0, 35, 0, 0, 0, 0, 0, 0, 0), (3, 0.9, 50, 0, 2, 0, 0, 0, 0, 0, 0, 0), (8, 0.9, 90, 0, 40, 0, 0, 0, 0, 0, 0, 0),
        (6, 0, 0, 0, 3, 1, 0, 0, 0, 0, 0, 0), (1, 0, 2, 0, 3, 1, 0, 0, 0, 0, 0, 0), (15, 0.7, 70, 0, 5, 1, 0, 0, 0, 0, 0, 0), (5, 0, 4, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ],
    float,
)
#: Blocks of the table that a leaf stands for at least.
LEAST = 3


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = LEAST) -> tuple | float:
    """A tree of (feature, threshold, at most, above) with shares of main text as leaves, by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= cut
            a, b = y[left], y[~left]
            if min(len(a), len(b)) < least:
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(cut))
    if best is None:
        return share
    _, k, cut = best
    left = x[:, k] <= cut
    return (k, cut, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


@cache
def tree() -> tuple | float:
    """The tree of the labelled table."""
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def classify(blocks: list[Block]) -> list[bool]:
    """For each block whether it is main text."""
    out = []
    none = Block("", 0, 0, False, False, False, False)
    article = any(b.body and not b.edge and not b.hint for b in blocks)
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none
        x = (b.words, b.density, before.words, before.density, after.words, after.density, b.body, b.edge, b.hint, b.heading, article)
        node = tree()
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        out.append(node >= 0.5)
    return out


def main_text(page: str | None) -> str:
    """The main blocks of a page in order, one a line; empty for null or empty pages."""
    blocks = segment(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, classify(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points).

    Null html counts as empty; null ids and urls stay null. Repeated rows each give a row, an empty table
    gives none. Pages are read whole whatever their length. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
