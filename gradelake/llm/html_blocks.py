"""DOM leaf blocks of a page: runs of text between block-level tags, with what stands above them. One pass, linear in the page's length and depth."""

from __future__ import annotations

import html
import re
from collections.abc import Set
from dataclasses import dataclass

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video title textarea select".split())
#: Other elements that are told apart; all that are in none of these lists count as one.
KNOWN = INLINE | frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag that ends an open element of these names, unless one of SCOPE is in between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = ("ul", "ol", "dl", "table")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
#: The rest of a tag: quotes after an equals sign hold whatever they hold, other quotes are characters like any.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    """Text with white space as single spaces; leaf, tags and names (parts of class, id and role) of its ancestors; characters in links; the element that holds the leaf."""

    text: str
    leaf: str
    tags: Set[str]
    names: Set[str]
    linked: int
    holder: int


def name_parts(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {p.lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMING for p in _PART.findall(m[2])}


class _Element:
    """An open element. tags and names are those of it and all above; where nothing is new they are the same objects as its parent's."""

    __slots__ = ("closed", "holder", "leaf", "names", "number", "tag", "tags")

    def __init__(self, number: int, tag: str, names: Set[str], parent: _Element | None):
        self.number, self.tag, self.closed = number, tag, False
        tags, above = (parent.tags, parent.names) if parent else (frozenset(), frozenset())
        kind = tag if tag in KNOWN else "other"
        self.tags = tags if tag in INLINE or kind in tags else tags | {kind}
        self.names = above if names <= above else above | names
        self.leaf = (parent.leaf if parent else "-") if tag in INLINE else kind
        self.holder = (parent.holder if parent else 0) if tag in INLINE else (parent.number if parent else 0)


class _Page:
    def __init__(self, vocabulary: Set[str]):
        self.vocabulary = vocabulary
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.n = 0
        self.above: _Element | None = None

    def text(self, raw: str) -> None:
        if not raw:
            return
        if not self.parts:
            if raw.isspace():
                return
            self.above = self.stack[-1] if self.stack else None
        t = html.unescape(raw) if "&" in raw else raw
        self.parts.append(t)
        if self.links:
            self.linked += len(t.strip())

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                e = self.above
                self.blocks.append(Block(text, e.leaf if e else "-", e.tags if e else frozenset(), e.names if e else frozenset(), self.linked, e.holder if e else 0))
            self.parts, self.linked = [], 0

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, to: int) -> None:
        """Closes all elements from place `to` of the stack on."""
        while len(self.stack) > to:
            e = self.stack.pop()
            if not e.closed:
                self.places[e.tag].pop()
                self.links -= e.tag == "a"

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            scope = self.last(SCOPE)
            if (at := self.last(("p",))) > scope and tag not in ("option", "body"):
                self.cut(at)
            elif (at := self.last(CLOSES.get(tag, ()))) > scope:
                # the outermost of those that are open side by side
                while (more := self.last(CLOSES[tag])) > scope:
                    self.cut(at := more)
        self.n += 1
        e = _Element(self.n, tag, name_parts(attributes) & self.vocabulary, self.stack[-1] if self.stack else None)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)
        self.links += tag == "a"

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag in INLINE and self.stack[-1].tag not in INLINE:  # it ends below an open block, which stays
            self.places[tag].pop()
            self.stack[at].closed = True
            self.links -= tag == "a"
        else:
            self.cut(at)


def blocks(page: str | None, vocabulary: Set[str] = frozenset()) -> list[Block]:
    """The leaf blocks of a page in order. Of names only those of `vocabulary` are kept.

    Markup errors end no block's text: unknown end tags are passed over, open elements end with the page. A tag that never ends
    ends the page, as browsers have it. Null and empty pages have no blocks.
    """
    out = _Page(vocabulary)
    at, begun, n = 0, 0, len(page or "")
    while at < n:
        here = page.find("<", at)
        if here < 0:
            break
        after = page[here + 1 : here + 2]
        if after in ("!", "?"):
            out.text(page[begun:here])
            mark, lead = ("-->", 4) if page.startswith("<!--", here) else ("]]>", 9) if page.startswith("<![CDATA[", here) else (">", 2)
            end = page.find(mark, here + lead)
            at = begun = n if end < 0 else end + len(mark)
            continue
        m = _NAME.match(page, here)
        if not m:
            at = here + 1
            continue
        out.text(page[begun:here])
        rest = _REST.match(page, m.end())
        if not rest:
            at = begun = n
            break
        at = begun = rest.end()
        tag = m[2].lower()
        if m[1]:
            out.close(tag)
        elif tag in SILENT:
            if tag not in ("script", "style", "title"):
                out.flush()
            if not rest[1].endswith("/"):
                end = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = begun = n if close < 0 else close + 1
        else:
            out.open(tag, rest[1])
    if begun < n:
        out.text(page[begun:])
    out.flush()
    return out.blocks
