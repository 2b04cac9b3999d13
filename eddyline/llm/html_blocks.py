"""Leaf blocks of HTML pages: the text between block-level tags, with what surrounds it.

Work and memory grow with the page's length, whatever it holds: ends of tags that can't be found are looked
for once, open elements are known by name, and what the elements around a block give is a set of names, of which
``known`` bounds the number.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: A tag's attributes and end; quoted values may hold ">".
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_QUOTE = re.compile("[\"']")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: Character references of more digits than any character has.
_ZEROS = re.compile("&#0+(?=[0-9])")
_FAR = re.compile(r"&#(?:[0-9]{8,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
#: Their contents are no page text at all.
RAW = frozenset("script style textarea title template iframe svg select annotation annotation-xml".split())
_PLAIN = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var button wbr img input math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover "
    "mtable mtr mtd mstyle mfenced mpadded mphantom".split()
)
#: Opening one of these ends the open ones of the same row.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open element below one of these is not ended by a tag above it.
_SCOPE = frozenset("ul ol dl table article section div main aside nav header footer body form".split())
_WORD = re.compile(r"[a-z]+")
#: Stands for any name: of a class, an id or a role.
NAMED = "named"
_ALWAYS = frozenset({NAMED, "in:article", "in:main"})
#: Longer attributes are not remembered.
_SHORT = 256


class Block(NamedTuple):
    text: str
    #: Names of the features that the elements around it give.
    around: frozenset[str]
    #: How many of the text's characters are in links.
    linked: int


def _features(tag: str, names: str, hidden: bool) -> frozenset[str]:
    words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    return frozenset({f"in:{tag}", *(f"name:{w}" for w in words), *([NAMED] if words else []), *(["hidden"] if hidden else [])})


_short_features = lru_cache(1 << 14)(_features)


@lru_cache(1 << 15)
def _joined(above: frozenset[str], own: frozenset[str]) -> frozenset[str]:
    return above if own <= above else above | own


class _Open:
    """The open elements, by depth and by name."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def top(self) -> frozenset[str]:
        return self.stack[-1][1] if self.stack else frozenset()

    @property
    def leaf(self) -> str:
        return self.stack[-1][0] if self.stack else "none"

    def push(self, tag: str, around: frozenset[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, around))

    def cut(self, to: int) -> None:
        """Ends all elements from depth to on."""
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        if places := self.places.get(tag):
            self.cut(places[-1])

    def make_way(self, tag: str) -> None:
        """Ends what the opening of tag ends: a paragraph, or all of a row's kind down to the next scope."""
        scope = self.scopes[-1] if self.scopes else -1
        if tag not in _CLOSES:
            if (p := self.places.get("p")) and p[-1] > scope:
                self.cut(p[-1])
            return
        least = len(self.stack)
        for name in (*_CLOSES[tag], "p"):
            places = self.places.get(name, ())
            k = bisect_right(places, scope)
            if k < len(places):
                least = min(least, places[k])
        self.cut(least)


class _Tags:
    """Where a page's tags end. After the last ">" there is none; beyond that a tag's end may only be missed
    for an open quote. How the quotes stood in searches that ran to the page's end is kept, as one that starts
    where an earlier one was outside quotes ends as that did; as quotes only swap such states, there are three at most.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        #: [place, quote that is open there]
        self.lost: list[list] = []

    def _known_lost(self, at: int) -> bool:
        outside = False
        for path in self.lost:
            for m in _QUOTE.finditer(self.page, path[0], at):
                path[1] = "" if path[1] == m[0] else path[1] or m[0]
            path[0] = at
            outside |= not path[1]
        return outside

    def rest(self, at: int) -> tuple[str, int]:
        """A tag's attributes and where it ends; at: behind its name, not beyond the last ">"."""
        if not self.lost or not self._known_lost(at):
            if m := _REST.match(self.page, at):
                return m[1], m.end()
            self.lost.append([at, ""])
        end = self.page.find(">", at)
        return self.page[at:end], end + 1


def _text(data: str) -> str:
    if "&#" in data:  # of any number of digits
        data = _FAR.sub("\ufffd", _ZEROS.sub("&#", data))
    return html.unescape(data) if "&" in data else data


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks with text, in order, white space collapsed. known: the features of surroundings
    that matter; without it all are kept, which takes space for each open element around each block."""
    out: list[Block] = []
    held = _Open()
    tags = _Tags(page)
    ends: dict[str, int] = {}
    parts: list[str] = []
    linked = link = 0
    keep = None if known is None else known | _ALWAYS

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, _joined(held.top, frozenset({f"leaf:{held.leaf}"})), linked))
            parts.clear()
        linked = 0

    at = begin = 0
    while True:
        m = _OPEN.search(page, at, tags.last + 1) if at <= tags.last else None
        data = page[begin : m.start()] if m else page[begin:].partition("<!--")[0]
        if data:
            data = _text(data)
            parts.append(data)
            if link:
                linked += len(data.strip())
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end())
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        tag = (m[3] or "").lower()
        if not tag:
            at = begin = page.find(">", m.end()) + 1
            continue
        attributes, at = tags.rest(m.end())
        begin = at
        block = tag not in INLINE and tag not in VOID
        if m[2]:
            if tag == "a":
                link = 0
            elif block:
                flush()
                link = 0
                held.end(tag)
            elif tag == "br":
                parts.append(" ")
        elif tag in RAW:
            if not attributes.endswith("/"):
                at = begin = _after(page, at, tag, ends, tags.last + 1)
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr" or tag == "head":
            flush()
        elif tag == "a":
            link = 1
        elif block:
            flush()
            link = 0
            if tag == "body":
                held.end("noscript")  # of a head whose end tags are left out
            held.make_way(tag)
            if not attributes.endswith("/"):
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
                hidden = bool(attributes) and tag not in ("html", "body") and bool(_HIDDEN.search(attributes))
                own = (_short_features if len(names) <= _SHORT else _features)(tag, names, hidden)
                held.push(tag, _joined(held.top, own if keep is None else own & keep))
    flush()
    return out


def _after(page: str, at: int, tag: str, ends: dict[str, int], last: int) -> int:
    """Where the element that was opened just before at ends: a plain one that never does, with the page; another
    one that never does, behind the last end tag of its name, if there is one. ends: of tags, the place of that.
    """
    if tag in _PLAIN:
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at, last)
        return m.end() if m else len(page)
    if tag not in ends:
        ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
    find = re.compile(rf"<(?:(script|style|textarea|title|iframe)(?=[\s/>])[^>]*>|!--.*?(?:-->|\Z)|(/?){tag}(?=[\s/>])[^>]*>)", re.I | re.S)
    depth, begin, behind = 1, at, at
    while at <= ends[tag] and (m := find.search(page, at, last)):
        at = m.end()
        if m[1]:
            at = _after(page, at, m[1].lower(), ends, last)
        elif m[2]:
            depth, behind = depth - 1, at
            if not depth:
                return at
        elif m[2] is not None:
            depth += 1
    if behind == begin:  # what looks like an end tag is none, nor will it be for later ones
        ends[tag] = -1
    return behind
