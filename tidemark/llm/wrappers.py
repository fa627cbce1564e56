"""Main text of web pages by wrapper induction: pages of one host are aligned as trees; what stays the same is template, what varies is content.

Each page becomes a tree of slots: repeated siblings (the paragraphs of an article, the entries of a menu) share one. Simple tree matching (the
ordered matching of children that pairs most nodes) aligns it with its host's template, a tree of slots with counts: in how many pages
each is, how much text and link text it has, and whether its text is the same everywhere. Templates are made inside tasks, where pages of a host are merged
before anything is shuffled, and merged with one another in rounds of FAN_IN, so no task holds a host's pages.

Content is what lies in the article: ``article``, else ``main``, else a block whose class says so, else the innermost block that holds most of the varying
text. Menus, sidebars, notices and the like go by their tags, roles and classes there, and so do constant slots that are no prose and slots that are
mostly links. A host's constant slots need MIN_PAGES pages; those of fewer, of hosts without a template and slots that the template lacks are judged alike, by the
page itself.

A null page is empty and gives an empty text, as does one without an article's text; pages without a host have no template; repeated pages each give their
text; no pages give no rows; other columns are not read. Pages of any length are taken whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written
from tidemark.llm.page_tree import Node, parse

#: Pages from which a slot's text counts as constant, and the share of them that must have it.
MIN_PAGES, CONSTANT = 3, 0.9
#: A slot with more link text than this is a list of links; a block with this share of its parent's varying text holds the article.
LINKS, MASS = 0.5, 0.7
#: Slots of a template: beyond that the rarest go, and are judged by the page itself. Templates merged in one step, and slots held in a task before it sends them on.
MAX_SLOTS, FAN_IN, HELD = 1000, 64, 50_000
#: Levels of blocks that are told apart; text in blocks nested deeper is one slot.
DEPTH = 60

# What tags, roles and classes say.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption option caption".split())
CONTAINERS = frozenset("body div section main article center table tbody tr td details".split())
NEVER = frozenset("head nav footer aside form noscript template svg math select button object iframe canvas audio video map dialog menu fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog hidden menu menubar toolbar".split())
ASIDE = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter
    subscribe subscription signup login signin sidebar widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer
    topbar toolbar share sharing social related recommended recommendations trending comment comments disqus replies reply respond popup
    modal overlay dialog search copyright""".split()
)
REMARKS = frozenset("comment comments reply replies respond disqus".split())
BODY = frozenset("content article post entry story text".split())


class Slot:
    """A place in a page or template: ``n`` pages have it, with ``chars`` of text, ``linked`` of them links', and ``same`` of them with the text ``hash``."""

    __slots__ = ("label", "n", "chars", "linked", "hash", "same", "children", "known", "nodes")

    def __init__(self, label: str, n: int = 1, chars: int = 0, linked: int = 0, hash: int = 0, same: int = 0):
        self.label, self.n, self.chars, self.linked, self.hash, self.same = label, n, chars, linked, hash, same
        self.children: list[Slot] = []
        self.known: Slot | None = None
        self.nodes: list[Node] = []

    def walk(self) -> Iterator[Slot]:
        stack = [self]
        while stack:
            s = stack.pop()
            yield s
            stack.extend(reversed(s.children))


def slots(tree: Node) -> Slot:
    """The page's slots. Siblings share one if they are prose of one label, or follow one another and look alike; of several nodes, wherever they stand."""

    def fold(nodes: list[Node], depth: int) -> Slot:
        out = Slot(nodes[0].label)
        out.nodes = nodes
        if depth == DEPTH:
            runs = [n for node in nodes for n in _descend(node) if n.tag == "#" and n is not node]
            out.children = [fold(runs, depth + 1)] if runs else []
            return out
        groups: dict = {}
        last, run = None, 0
        for node in nodes:
            for child in node.children:
                key = child.label
                if child.tag not in PROSE and child.tag != "#":
                    key = (key, frozenset(c.label for c in child.children))
                    if len(nodes) == 1:
                        run += key != last
                        key, last = (key, run), key
                else:
                    last = None
                groups.setdefault(key, []).append(child)
            last = None
        out.children = [fold(own, depth + 1) for own in groups.values()]
        texts = [n for n in nodes if n.tag == "#"]
        if texts:
            out.chars, out.linked, out.same = sum(len(n.text) for n in texts), sum(min(n.linked, len(n.text)) for n in texts), 1
            out.hash = zlib.crc32("\n".join(n.text for n in texts).encode("utf-8", "replace"))
        return out

    return fold([tree], 0)


def _descend(node: Node) -> Iterator[Node]:
    """A node and what is in it, in order of the page."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.children))


def merge(into: Slot, other: Slot, count: bool = True, known: dict | None = None) -> None:
    """Aligns ``other`` with ``into``. With ``count`` its counts are added and slots that are new find their place; else its slots only get to know theirs."""
    known = {} if known is None else known
    other.known = into
    if count:
        _add(into, other)
    a, b = into.children, other.children
    if not b or (not a and not count):
        return
    # best[i][j]: the nodes that the first i and j children can pair.
    gain = [[_pairs(x, y, known) if x.label == y.label else 0 for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain[i - 1][j - 1])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            merge(a[i], b[j], count, known)
            out.append(a[i])
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            if count:
                out.append(b[j])
        else:
            i -= 1
            out.append(a[i])
    if count:
        into.children = out[::-1]


def _pairs(x: Slot, y: Slot, known: dict) -> int:
    """How many nodes simple tree matching pairs below two that match, and these; ``known`` remembers."""
    a, b = x.children, y.children
    if not a or not b:
        return 1
    found = known.get((id(x), id(y)))
    if found:
        return found
    row = [0] * (len(b) + 1)
    for p in a:
        diagonal = 0
        for j, q in enumerate(b, 1):
            above = row[j]
            row[j] = max(above, row[j - 1], diagonal + (_pairs(p, q, known) if p.label == q.label else 0))
            diagonal = above
    known[id(x), id(y)] = 1 + row[-1]
    return 1 + row[-1]


def _add(into: Slot, other: Slot) -> None:
    into.n, into.chars, into.linked = into.n + other.n, into.chars + other.chars, into.linked + other.linked
    if into.hash == other.hash:
        into.same += other.same
    elif other.same > into.same:
        into.hash, into.same = other.hash, other.same - into.same
    else:
        into.same -= other.same


def pruned(template: Slot) -> Slot:
    """At most MAX_SLOTS slots: those in most pages, with all above them."""
    found = list(template.walk())
    if len(found) > MAX_SLOTS:
        least = sorted((s.n for s in found), reverse=True)[MAX_SLOTS]
        for s in found:
            s.children = [c for c in s.children if c.n > least]
    return template


def packed(s: Slot) -> list:
    return [s.label, s.n, s.chars, s.linked, s.hash, s.same, [packed(c) for c in s.children]]


def unpacked(row: list) -> Slot:
    out = Slot(*row[:6])
    out.children = [unpacked(c) for c in row[6]]
    return out


# Judging


def _constant(s: Slot) -> bool:
    # ``same`` counts the pages with the commonest text less those without it.
    return s.n >= MIN_PAGES and s.same >= (2 * CONSTANT - 1) * s.n


def content(page: Slot) -> set[int]:
    """The text slots (by ``id``) of a page, aligned with its template or not, that are its main text."""
    parents: dict[int, Slot] = {}
    order = list(page.walk())
    for s in order:
        for c in s.children:
            parents[id(c)] = s
    node = lambda s: s.nodes[0]
    facts = lambda s: s.known or s
    aimed = {id(s) for s in order if node(s).tag in ("article", "main") or node(s).role == "main"}
    holds: set[int] = set()  # blocks around one that says it is the article
    for s in order:
        if id(s) in aimed:
            up = parents.get(id(s))
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = parents.get(id(up))
    out: dict[int, bool] = {}  # whether a block and what is in it goes, whatever it holds
    for s in order:
        n, tag = node(s), node(s).tag
        above = parents.get(id(s))
        gone = above is not None and out[id(above)]
        if not gone and tag not in ("#", "html", "body"):
            words = set(n.words)
            if tag in ("article", "main"):
                gone = bool(words & REMARKS) or n.role == "hidden"
            elif id(s) in holds:
                gone = n.role == "hidden"
            else:
                gone = tag in NEVER or n.role in ROLES or bool(words & ASIDE)
        out[id(s)] = gone
    text = [s for s in order if node(s).tag == "#" and not out[id(s)]]
    live = [s for s in order if not out[id(s)]]
    pick = lambda test: [s for s in live if test(node(s))]
    regions = pick(lambda n: n.tag == "article") or pick(lambda n: n.tag == "main" or n.role == "main")
    # Without an article, a page's header is not its text.
    if not regions:
        for s in order:
            above = parents.get(id(s))
            if above is not None and (out[id(above)] or node(s).tag == "header"):
                out[id(s)] = True
        text = [s for s in text if not out[id(s)]]
        total = _masses(text, parents, facts)
        most = lambda s: total.get(id(s), 0.0) > MASS * total.get(id(page), 0.0)
        named = [s for s in live if node(s).tag in CONTAINERS and node(s).tag != "body" and set(node(s).words) & BODY and not out[id(s)] and most(s)]
        regions = [min(reversed(named), key=lambda s: total[id(s)])] if named else [_heaviest(page, total)]
    inside: dict[int, bool] = {}
    chosen = {id(s) for s in regions}
    for s in order:
        above = parents.get(id(s))
        inside[id(s)] = id(s) in chosen or (above is not None and inside[id(above)])
    varying = [s for s in text if inside[id(s)] and not _constant(facts(s))]
    keep = set()
    for s in text:
        if inside[id(s)]:
            prose = node(parents[id(s)]).tag in PROSE
            if prose or not varying or not (_constant(facts(s)) or facts(s).linked > LINKS * facts(s).chars):
                keep.add(id(s))
    return keep


def _masses(text: list[Slot], parents: dict[int, Slot], facts) -> dict[int, float]:
    """Of each block (by ``id``) how much varying text it holds on the host's pages; where all is constant, how much text."""
    mean = lambda s: facts(s).chars / facts(s).n
    weight = {id(s): mean(s) for s in text if not _constant(facts(s)) and facts(s).linked <= LINKS * facts(s).chars} or {id(s): mean(s) for s in text}
    total: dict[int, float] = {}
    for s in text:
        at: Slot | None = s
        while at is not None:
            total[id(at)] = total.get(id(at), 0.0) + weight.get(id(s), 0.0)
            at = parents.get(id(at))
    return total


def _heaviest(page: Slot, total: dict[int, float]) -> Slot:
    """The innermost block that holds MASS of the text of the one around it."""
    at = page
    while True:
        best = max((c for c in at.children if c.nodes[0].tag in CONTAINERS), key=lambda c: total.get(id(c), 0.0), default=None)
        if best is None or total.get(id(best), 0.0) < MASS * total.get(id(at), 0.0) or not total.get(id(best)):
            return at
        at = best


def text_of(page: str | None, template: Slot | None) -> str:
    """The main text: a line for each block, in order of the page."""
    tree = parse(page)
    own = slots(tree)
    if template is not None:
        merge(template, own, count=False)
    keep = content(own)
    good = {id(n) for s in own.walk() if id(s) in keep for n in s.nodes}
    return "\n".join(n.text for n in _descend(tree) if id(n) in good)


# Jobs


def host() -> F.Column:
    return F.translate(F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_SCHEMA = "host string, template string"


def _batch(held: dict[str, Slot]) -> pa.RecordBatch:
    rows = [(h, json.dumps(packed(pruned(t)), separators=(",", ":"))) for h, t in held.items()]
    return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in rows], pa.string()), "template": pa.array([t for _, t in rows], pa.string())})


def induce(pages: DataFrame) -> DataFrame:
    """``host, template`` of the hosts of ``pages`` (``url, html``), from all their pages; written."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slot] = {}
        size = 0
        for b in batches:
            for h, page in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                own = slots(parse(page))
                each = list(own.walk())
                for s in each:
                    s.nodes = []
                if h in held:
                    merge(held[h], own)
                else:
                    held[h] = own
                size += sum(s.known is None for s in each)  # what the templates have grown by
                if size > HELD:
                    yield _batch(held)
                    held, size = {}, 0
        yield _batch(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, None
        for b in batches:
            for h, k, t in zip(b["host"].to_pylist(), b["salt"].to_pylist(), b["template"].to_pylist(), strict=True):
                own = unpacked(json.loads(t))
                if (h, k) == key:
                    merge(at, own)
                else:
                    if key:
                        yield _batch({key[0]: at})
                    key, at = (h, k), own
        if key:
            yield _batch({key[0]: at})

    found = written(pages.select(host().alias("host"), "html").where("host <> ''").mapInArrow(partial, _SCHEMA), "templates")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0]  # one number
        if most is None or most <= 1:
            return found
        salt = F.pmod(F.xxhash64("template", F.monotonically_increasing_id()), F.lit(-(-most // FAN_IN)))
        dealt = found.select("host", salt.alias("salt"), "template").repartition("host", "salt").sortWithinPartitions("host", "salt", "template")
        merged = written(dealt.mapInArrow(joined, _SCHEMA), "templates")
        dropped(found)
        found = merged


@lru_cache(maxsize=256)
def _template(packed_template: str) -> Slot:
    return unpacked(json.loads(packed_template))


def main_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``); ``templates``: those of ``induce``, by default of these pages.

    Spark sends the templates to all tasks while they are few, and joins them by host otherwise.
    """
    templates = induce(pages) if templates is None else templates
    read = pages.select("page_id", "url", host().alias("host"), "html").join(templates, "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_of(page, _template(t) if t else None) for page, t in zip(b["html"].to_pylist(), b["template"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(made, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return read.mapInArrow(run, f"page_id {kind}, url string, text string")
