"""A small HTML reader: the tree of block elements with their texts, whatever the markup's faults."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: A quoted value holds no tag, or is followed by what may follow one; else its quote isn't closed and
#: the tag ends at the next ">" (the last alternative).
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul caption".split())
#: Not rendered, or a form control. Formulas, drawings' labels and objects' contents are read.
UNSHOWN = frozenset("script style noscript template head title select textarea iframe button datalist "
                    "audio video canvas map noframes annotation annotation-xml desc metadata defs".split())
RAW = frozenset("script style textarea title noframes iframe".split())
#: What may stand in the head; anything else, and any text, ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the set beside it, up to the nearest of the limits.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_NO_END = ((), ())
_ANY_BLOCK = "*"  # no element has this name


@dataclass
class Node:
    """A block element. ``items`` holds its texts and its block elements in page order."""
    tag: str
    tokens: list[str]
    parent: int
    depth: int
    items: list = field(default_factory=list)  # str or int (index of a node)
    linked: int = 0  # characters inside links
    inline: int = 0  # inline elements


def _words_of_attributes(source: str) -> list[str]:
    """Lower-case words of the class, id and role attributes."""
    out: list[str] = []
    for name, value in _ATTRIBUTE.findall(source):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out += [t.lower() for t in _TOKENS.findall(html.unescape(value.strip("\"'")))]
    return out


def parse(source: str) -> list[Node]:
    """Block elements in page order; the first is the page itself.

    Scripts, styles, comments and other content that isn't shown are left out. End tags without
    an open element are ignored, and elements that another one's start ends are closed. The head
    ends at its end tag, at the body, or at the first thing that cannot stand in it.
    """
    nodes = [Node("html", [], -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # names of open elements with their nodes; -1: not shown
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack, and of all blocks
    links = 0
    at = 0

    def text(piece: str) -> None:
        if stack[-1][0] == "head" and not piece.isspace() and piece:
            close(len(stack) - 1)
        node = stack[-1][1]
        if piece and node >= 0:
            piece = html.unescape(piece)
            items = nodes[node].items
            if items and isinstance(items[-1], str):
                items[-1] += piece
            else:
                items.append(piece)
            if links:
                nodes[node].linked += len(piece)

    def last(name: str) -> int:
        """Where the last open element of the name stands, 0 if none is open."""
        return places[name][-1] if places.get(name) else 0

    def put(name: str, node: int) -> None:
        for key in (name, _ANY_BLOCK) if name in BLOCKS else (name,):
            places.setdefault(key, []).append(len(stack))
        stack.append((name, node))

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                places[_ANY_BLOCK].pop()
            links -= name == "a"

    for m in _TOKEN.finditer(source):
        start, stop = m.span()
        if start < at:
            continue  # inside raw text
        text(source[at:start])
        at = stop
        ends, name, attributes = (m[1], m[2], m[3]) if m[5] is None else (m[4], m[5], m[6])
        if name is None:
            if source.startswith("<![CDATA[", start):
                text(source[start + 9: stop - 3])
            continue
        name = name.lower()
        if ends:
            depth = 0 if name in ("html", "body") else last(name)
            # an inline end tag reaches no further than the block that it stands in
            if depth and (name in BLOCKS or name in UNSHOWN or last(_ANY_BLOCK) < depth):
                close(depth)
            continue
        if name == "body":
            close(last("head") or len(stack))
        elif stack[-1][0] == "head" and name not in HEAD:
            close(len(stack) - 1)
        hidden = stack[-1][1] < 0
        if name in ("html", "body"):
            nodes[0].tokens += _words_of_attributes(attributes)
            continue
        if not hidden and name in BLOCKS:
            # a block ends an open paragraph
            depth = last(_ANY_BLOCK)
            if depth and stack[depth][0] == "p":
                close(depth)
            ended, limits = _ENDS.get(name, _NO_END)
            limit = max(map(last, limits), default=0)
            while (depth := max(map(last, ended), default=0)) > limit:
                close(depth)
                if name in ("li", "dt", "dd", "td", "th"):
                    break
            parent = stack[-1][1]
            nodes.append(Node(name, _words_of_attributes(attributes), parent, nodes[parent].depth + 1))
            nodes[parent].items.append(len(nodes) - 1)
            if name != "hr":
                put(name, len(nodes) - 1)
        elif name in VOID:
            if name == "br":
                text(" ")
        elif not attributes.rstrip().endswith("/") or name in RAW:
            node = -1 if hidden or name in UNSHOWN else stack[-1][1]
            if node >= 0:
                nodes[node].inline += 1
            links += name == "a"
            put(name, node)
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(source, stop)
                at = end.start() if end else len(source)
                close(len(stack) - 1)
                if end:
                    at = source.find(">", end.start()) + 1 or len(source)
    text(source[at:])
    return nodes


def shown(piece: str) -> str:
    """A block's text: white space turned into single spaces, none at its ends."""
    return " ".join(piece.split())
