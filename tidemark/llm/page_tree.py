"""Web pages as trees of blocks: tags, their classes, and runs of text. What a browser repairs is repaired: missing end tags, stray ones, open quotes."""

from __future__ import annotations

import html
import re

# How elements nest, after the HTML standard.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul
    audio button canvas iframe map math noscript object select svg template video""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: A start tag of the key ends an open element of these, unless one of the bounds was opened since.
ENDS = {
    **{t: ({"p"}, {"table", "td", "th", "caption", "object", "button", "template"}) for t in BLOCKS if t not in ("head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup")},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **{t: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "body": ({"head"}, {"html"}),
}
#: What an end tag doesn't reach through; those of a table's parts reach through all but a table.
SCOPE, PARTS = frozenset("table td th caption object template".split()), frozenset("table tbody thead tfoot tr td th caption".split())

#: Blocks nested deeper than browsers nest them are siblings.
DEEPEST = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element, or a run of text (tag ``#``) with ``text``, white space made single, and how many of its characters are links'."""

    __slots__ = ("tag", "words", "role", "label", "children", "text", "linked")

    def __init__(self, tag: str, words: tuple[str, ...] = (), role: str = ""):
        self.tag, self.words, self.role = tag, words, role
        self.label = ".".join((tag, *words))
        self.children: list[Node] = []
        self.text, self.linked = "", 0


def _attributes(rest: str) -> tuple[tuple[str, ...], str]:
    """The words of class and id (numbers fall away, so that counters make no difference), and the role; ``hidden`` is a role here."""
    words, role = {}, ""
    if "=" in rest:
        for name, a, b, c in _NAMED.findall(rest):
            value, name = a or b or c, name.lower()
            if name == "role":
                role = value.strip().lower()
            elif name == "style":
                role = "hidden" if "display:none" in value.replace(" ", "").lower() else role
            else:
                words |= dict.fromkeys(w.lower() for w in _WORD.findall(value))
    if "hidden" in rest.lower() and _HIDDEN.search(_NAMED.sub("", rest)):
        role = "hidden"
    return tuple(sorted(words)), role


def parse(page: str | None) -> Node:
    """The tree of a page, whatever its state; of no page, an empty ``html``."""
    root = Node("html")
    stack, pieces, linked, link = [root], [], 0, False

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            run = Node("#")
            run.text, run.linked = text, linked
            stack[-1].children.append(run)
        pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head" and not raw.isspace():
            stack.pop()
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link:
            linked += len(text.strip())

    page, at = page or "", 0
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        close, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue  # a comment, a declaration
        tag = tag.lower()
        if close:
            if tag == "a":
                link = False
            elif tag in BLOCKS and tag != "html":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        del stack[i:]
                        break
                    if stack[i].tag in ({"table"} if tag in PARTS else SCOPE):
                        break
            continue
        if tag in RAW:
            ended = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = ended.start() if ended else len(page)
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS and tag != "html":
            flush()
            if stack[-1].tag == "head" and tag not in ("noscript", "template"):
                stack.pop()  # nothing else belongs to a head
            ends, bounds = ENDS.get(tag, ((), ()))
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    cut = i
            if cut:
                del stack[cut:]
            if tag not in VOID and not (tag == "body" and any(n.tag == "body" for n in stack)):
                node = Node(tag, *_attributes(rest))
                stack[-1].children.append(node)
                if len(stack) < DEEPEST and not (rest.endswith("/") and tag in ("svg", "math")):
                    stack.append(node)
    if at < len(page):
        add(page[at:])
    flush()
    return root
