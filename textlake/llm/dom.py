"""A small reader of HTML pages: elements with their style paths, and blocks of text."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass, field

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody td tfoot th thead tr ul""".split()
)
NOISE_TAGS = set(
    """aside audio button canvas dialog fieldset footer form head header iframe input label map math menu nav noembed
    noframes noscript object option script search select style svg template textarea title video""".split()
)
NOISE_WORDS = set(
    """ad adbox ads adsense adslot advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs
    comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal
    nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related
    reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar
    widget""".split()
)
# Words that say nothing beside one of those.
PLAIN_WORDS = set("area bar block body bottom box container content group inner item left list main outer panel right row section side text top wrap wrapper".split())
NOISE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
MAIN_TAGS = {"article", "main"}
KEPT_TAGS = {"html", "body"}
# An element that starts closes an open one of these kinds, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def number(text: str) -> int:
    """A hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _fold(*parts: int) -> int:
    # Hashes of tuples of integers do not depend on the process.
    return hash(parts)


@dataclass
class Node:
    tag: str
    path: int
    noise: bool  # by its tag, class, id or role, or by an element around it
    hint: bool  # one word among others of its class or id speaks of noise, or of that of an element around it
    low: bool  # by its path, or by that of an element around it
    main: bool  # inside an article or main element
    styles: list[int] = field(default_factory=list)  # of its children, in order, repeats once
    content: list[int] = field(default_factory=list)  # hashes of its texts and children


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[list[tuple[str, Node]]]  # pieces of text, each with the element that it stands in


def joined(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def _style(tag: str, more: str) -> tuple[str, bool, bool]:
    """How an element is styled, digits aside; whether that says noise; and whether one word among others hints at it.

    A class or id says noise if all its words do, but for words that say nothing; ``menu-price`` only hints.
    """
    noise, hint = tag in NOISE_TAGS, False
    if not more or more == "/":
        return tag, noise, hint
    style = [tag]
    for m in _ATTRIBUTE.finditer(more):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.split():
                whole = "".join(_WORDS.findall(one.lower()))
                words = _WORDS.findall(_CAMEL.sub(r"\1 \2", one).lower())
                style += words
                telling = {w for w in words if w in NOISE_WORDS}
                hint |= bool(telling)
                noise |= whole in NOISE_WORDS or bool(telling) and all(w in telling or w in PLAIN_WORDS for w in words)
        elif name == "role":
            style.append(value.lower())
            noise |= value.lower() in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = True
        elif name == "style":
            noise |= bool(_HIDDEN.search(value))
    kept = tag in KEPT_TAGS
    return " ".join(style), noise and not kept, hint and not kept


def read(text: str | None, low: Container[int] = frozenset()) -> Page:
    """Elements and blocks of a page; ``low`` has the paths of branches to mark.

    Comments, raw texts and markup go; what is left open is closed at the end. The work for an element or block does
    not grow with its depth.
    """
    text = text or ""
    root = Node("", 0, False, False, False, False)
    stack, nodes, blocks, line = [root], [], [], []
    standing: Counter[str] = Counter()  # open elements by tag
    known: dict[tuple[str, str], tuple[int, bool, bool]] = {}

    def flush():
        if line:
            blocks.append(line.copy())
            line.clear()

    def close():
        node = stack.pop()
        standing[node.tag] -= 1
        above = stack[-1]
        if not above.styles or above.styles[-1] != node.path:
            above.styles.append(node.path)
        above.content.append(_fold(*node.content))

    def close_open(kinds, stops):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in stops:
                return

    def say(piece: str):
        if "&" in piece:
            piece = entities.unescape(piece)
        line.append((piece, stack[-1]))
        words = " ".join(piece.split())
        if words:
            stack[-1].content.append(number(words))

    at = 0
    while m := _MARK.search(text, at):
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                flush()
            if standing[tag]:
                # An inline end tag does not close the blocks around it.
                close_open({tag}, set() if tag in BLOCKS else BLOCKS)
            continue
        if tag == "br":
            line.append((" ", stack[-1]))
            continue
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph.
            close_open({"p"}, {"article", "aside", "blockquote", "body", "button", "div", "figure", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th"})
        if tag in CLOSES:
            close_open(*CLOSES[tag])
        more = m["more"] if m["tag"] else m["more2"]
        if (found := known.get((tag, more))) is None:
            style, *says = _style(tag, more)
            found = known[tag, more] = number(style), *says
        above = stack[-1]
        inside = above.main or tag in MAIN_TAGS
        noise = found[1] and not (tag in ("header", "hgroup") and above.main and "class" not in more and "id" not in more)
        path = _fold(above.path, found[0])
        node = Node(tag, path, above.noise or noise, above.hint or found[2], above.low or path in low, inside)
        nodes.append(node)
        stack.append(node)
        standing[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            close()
        elif tag in VOID or more.endswith("/") and tag not in BLOCKS:
            close()
    if at < len(text):
        # A tag that is cut off at the end of the page is no text.
        say(text[at:])
    flush()
    while len(stack) > 1:
        close()
    nodes.insert(0, root)
    return Page(nodes, blocks)
