"""HTML into blocks: the runs of text between block-level tags, each with the path of elements that it stands in."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
#: A slash that closes a tag: not the end of a value without quotes.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")

#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript title head iframe object svg math canvas audio video".split())
#: Of these the content is not even markup, up to the end tag of the same name.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends these elements where they are open, up to the nearest of the bounds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",), "body": ("head",), "thead": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
_BOUNDS = frozenset("html body article section div main aside nav header footer table ul ol dl form blockquote figure fieldset".split())
_LIST_BOUNDS = frozenset("html body table ul ol dl select".split())


FOREIGN = frozenset(("svg", "math"))


class Element:
    """An open element and those that it stands in. ``mark`` is its own label or the nearest above; ``known`` is for what readers work out about its path."""

    __slots__ = ("depth", "known", "mark", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], mark: str | None, parent: "Element | None"):
        self.tag, self.names, self.parent, self.known = tag, names, parent, None
        self.mark = mark if mark is not None or parent is None else parent.mark
        self.depth = parent.depth + 1 if parent else 1


class Block:
    """``path``: the innermost element, or None; ``links``: characters of the text that are linked."""

    __slots__ = ("links", "path", "text")

    def __init__(self, path: Element | None, text: str, links: int):
        self.path, self.text, self.links = path, text, links


def _names(attributes: str, label: str | None) -> tuple[tuple[str, ...], str | None]:
    """Words of class, id and role; the value of ``label``, which only training pages have."""
    found, mark = [], None
    if "=" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "aria-label"):
                found += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
            elif name == label:
                mark = a or b or c
    return tuple(found), mark


def blocks(page: str, label: str | None = None) -> list[Block]:
    """Blocks in page order.

    Broken markup is read as browsers would for the most part: open elements that a tag must end are ended, end tags
    without a start are passed over, quotes count only after an equals sign, a slash closes foreign elements alone, and
    what is open at the end of the page ends there. The places of open elements are kept by tag, so that the time is in
    proportion to the page, however deep or broken it is.
    """
    out: list[Block] = []
    stack: list[Element] = []
    where: dict[str, list[int]] = {}
    bounds: list[int] = []
    list_bounds: list[int] = []
    parts: list[str] = []
    hidden = links = linked = foreign = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal hidden, links, foreign
        at = len(stack)
        stack.append(Element(tag, *_names(attributes, label), stack[-1] if stack else None))
        where.setdefault(tag, []).append(at)
        if tag in _BOUNDS:
            bounds.append(at)
        if tag in _LIST_BOUNDS:
            list_bounds.append(at)
        hidden += tag in HIDDEN
        foreign += tag in FOREIGN
        links += tag == "a"

    def pop() -> None:
        nonlocal hidden, links, foreign
        tag = stack.pop().tag
        where[tag].pop()
        if tag in _BOUNDS:
            bounds.pop()
        if tag in _LIST_BOUNDS:
            list_bounds.pop()
        hidden -= tag in HIDDEN
        foreign -= tag in FOREIGN
        links -= tag == "a"

    def end_open(tags: tuple[str, ...], until: list[int]) -> None:
        while True:
            last = max((where[t][-1] for t in tags if where.get(t)), default=-1)
            if last < 0 or until and until[-1] > last:
                return
            while len(stack) > last:
                pop()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        ended, started = m[1], m[2]
        if started:
            tag = started.lower()
            if tag not in INLINE:
                flush()
                if tag in ENDS:
                    end_open(ENDS[tag], list_bounds if tag not in ("p", "body") else bounds)
                elif tag not in HIDDEN:
                    end_open(("p",), bounds)
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                body, at = page[at : close.start() if close else len(page)], close.end() if close else len(page)
                if tag == "textarea" and not hidden:
                    push(tag, m[3] or "")
                    parts.append(body)
                    flush()
                    pop()
                continue
            if tag not in EMPTY and not ((foreign or tag in FOREIGN) and _CLOSED.search(m[3])):
                push(tag, m[3])
        elif ended:
            tag = ended.lower()
            if tag not in INLINE:
                flush()
            if where.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
    flush()
    return out
