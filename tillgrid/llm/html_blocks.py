"""HTML pages as sequences of leaf blocks: text between block boundaries, with the path of elements around it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements that run on within a line of text; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SILENT = frozenset("script style template noscript title textarea xmp iframe noembed noframes svg math select object audio video canvas".split())
#: An opening tag ends an open element of the same group, up to the nearest of its containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in SILENT}


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]  # words of class, id, role and itemprop, lower-case


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]
    link_chars: int


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = (a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes))
    return tuple(w for value in found for w in _SPLIT.split(value.lower()) if w)


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self._path: tuple[Element, ...] | None = ()

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        if not self.pieces:
            self._path = tuple(self.stack) if len(self.stack) <= 24 else tuple(self.stack[:8] + self.stack[-16:])
        self.pieces.append(piece)
        if self.open.get("a"):
            self.linked += len(piece)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self._path, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if self.open.get("p"):  # a paragraph ends where another block begins
                at = len(self.stack) - 1
                while at >= 0 and self.stack[at].tag in INLINE:
                    at -= 1
                if at >= 0 and self.stack[at].tag == "p":
                    self.pop(at)
            group = CLOSES.get(tag)
            if group and any(self.open.get(t) for t in group[0]):
                least = None
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at].tag in group[1]:
                        break
                    if self.stack[at].tag in group[0]:
                        least = at
                        if self.stack[at].tag == tag:
                            break
                if least is not None:
                    self.pop(least)
        if tag not in VOID:
            self.stack.append(Element(tag, names_of(attributes)))
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open.get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.pop(at)


def blocks_of(page: str | None) -> list[Block]:
    """Blocks with text, in page order. White space in a block is one blank; character references are decoded.

    Comments, declarations, scripts, styles and other elements without page text are left out. Unclosed
    elements end where HTML lets them end; a tag whose quote never closes ends at the next ``>``. Time grows with the length of the page.
    """
    page = page or ""
    out, at, size, quotes = _Reader(), 0, len(page), True
    while at < size:
        tag_at = page.find("<", at)
        if tag_at < 0:
            out.text(page[at:])
            break
        if tag_at > at:
            out.text(page[at:tag_at])
        if page.startswith("<!--", tag_at):
            end = page.find("-->", tag_at + 2)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag_at):
            end = page.find(">", tag_at)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, tag_at)
        if not name:  # a sign, not a tag
            out.text("<")
            at = tag_at + 1
            continue
        whole = _TAG.match(page, tag_at) if quotes else None
        if whole:
            at, attributes = whole.end(), whole[3]
        else:
            quotes = False
            end = page.find(">", name.end())
            at = size if end < 0 else end + 1
            attributes = page[name.end():max(name.end(), at - 1)]
        tag = name[2].lower()
        if name[1]:
            out.end(tag)
        elif tag in SILENT:
            if tag not in INLINE:
                out.flush()
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                close = _END[tag].search(page, at)
                at = close.end() if close else size
        else:
            out.start(tag, attributes)
    out.flush()
    return out.blocks
