"""Main text of web pages by minimum-cut labelling (op 5).

A page is read by a forgiving tokenizer and cut into blocks: runs of text between block-level tags, with character
references decoded and white space, line breaks included, made one space. Each block gets a cost for being called content and one for
being called boilerplate, from its words, links, tag and the tags, classes and ids around it. Costs are the capacities of
edges to two terminals; blocks next to each other, and blocks near each other in the tree, are tied by smoothness
edges; the minimum cut (max-flow) is the cheapest labelling of all blocks at once. Content blocks are joined in page
order by line feeds.

What is boilerplate by definition (tags such as nav or form, hidden elements, classes of adverts, menus, notices, comments) costs more as content than any cut
saves; words that articles use too (``DOUBTFUL``) only weigh against a block, so long text outvotes them. Inline elements of either kind are left out of
their block, which goes on.

Defined results: a null, empty or wholly boiler page gives an empty text; unclosed or crossed tags are repaired as browsers do
roughly; a tag that the page's end cuts off is dropped; pages of any length are read whole. Each row is judged by itself: nothing is shuffled.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ship

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"})}
ENDS_P = BLOCK - {"html", "head", "body", "option", "optgroup", "caption", "legend", "tbody", "td", "th", "thead", "tfoot", "tr", "li", "dd", "dt"}
BOILER_TAGS = frozenset("nav footer aside form head button menu dialog label fieldset search".split())
BOILER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promotion cookie cookies consent gdpr notification popup modal overlay "
    "sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar newsletter subscribe signup signin login comment comments commentlist disqus replies respond "
    "pagination pager".split()
)
DOUBTFUL = frozenset("related recommended reviews notice banner promo widget copyright disclaimer social share sharing skip".split())
CONTENT_WORDS = frozenset("article content entry post story main body text maincontent articlebody".split())
HARD, AGAINST = 400, 60
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


class Block:
    """text; share of it in links; numbers of the parent and grandparent element; own tag; flags of the elements around it."""

    __slots__ = ("text", "linked", "near", "tag", "hard", "doubtful", "inside")

    def __init__(self, text, linked, near, tag, hard, doubtful, inside):
        self.text, self.linked, self.near, self.tag, self.hard, self.doubtful, self.inside = text, linked, near, tag, hard, doubtful, inside


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _marks(tag: str, source: str, in_content: bool) -> tuple[bool, bool, bool]:
    """(boilerplate for sure, perhaps, content container) of an element."""
    if tag in BOILER_TAGS or tag == "header" and not in_content:
        return True, False, False
    if not source.strip():
        return False, False, tag in ("article", "main")
    a = _attributes(source)
    names = {w.lower() for x in ("class", "id", "role") for w in WORD.findall(a.get(x, ""))}
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style:
        return True, False, False
    if tag in ("article", "main") or a.get("role") in ("main", "article"):
        return False, False, True
    if tag in ("html", "body"):
        return False, False, False
    if names & BOILER_WORDS or "header" in names and not in_content:
        return True, False, False
    return False, bool(names & DOUBTFUL), bool(names & CONTENT_WORDS)


class _Open:
    """The open elements; finding the innermost of a tag takes no search."""

    def __init__(self):
        # of each: tag, number, boilerplate, doubtful, inside content; inline elements: whether they hide their text
        self.all: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.of_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = self.muted = 0

    def last(self, tags) -> int:
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=0)

    def push(self, tag: str, number: int, source: str) -> None:
        _, _, hard, doubtful, inside = self.all[-1]
        boiler, perhaps, content = _marks(tag, source, inside)
        block = tag in BLOCK
        if block:
            hard, doubtful, inside = hard or boiler, doubtful or perhaps, inside or content
            self.blocks.append(len(self.all))
        elif boiler or perhaps:
            self.muted += 1
        self.of_tag.setdefault(tag, []).append(len(self.all))
        self.all.append((tag, number, hard, doubtful, inside) if block else (tag, -1 if boiler or perhaps else 0, hard, doubtful, inside))
        self.links += tag == "a"

    def close(self, k: int) -> None:
        """Close the k-th element and all within it."""
        for tag, number, *_ in self.all[k:]:
            self.of_tag[tag].pop()
            self.links -= tag == "a"
            self.muted -= number == -1
            if tag in BLOCK:
                self.blocks.pop()
        del self.all[k:]

    def close_open(self, tags: frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        k = self.last(tags)
        if k and k > self.last(stop):
            self.close(k)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    opened = _Open()
    number = at = linked = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        joined = " ".join(htmllib.unescape("".join(text)).split())
        if joined:
            around = [opened.all[k] for k in opened.blocks[-3:]]
            tag, _, hard, doubtful, inside = around[-1] if around else opened.all[0]
            near = tuple(e[1] for e in around[-2::-1])
            out.append(Block(joined, min(1.0, linked / len(joined)), near, tag, hard, doubtful, inside))
        text.clear()
        linked = 0

    while at < len(page):
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not opened.muted:
            text.append(piece)
            if opened.links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, source = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if ending:
            if tag in BLOCK:
                flush()
            k = opened.last((tag,))
            if k and (tag in BLOCK or not opened.blocks or k > opened.blocks[-1]):
                opened.close(k)
            continue
        if tag in RAW:
            if not source.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                opened.close_open(frozenset({"p"}), frozenset({"button", "td", "th", "table", "caption", "object"}))
            elif tag in CLOSES:
                opened.close_open(CLOSES[tag], SCOPES.get(tag, frozenset()))
            top = opened.all[-1][0]
            if tag[0] == "h" and tag[1:].isdigit() and top[:1] == "h" and top[1:].isdigit():
                opened.close(len(opened.all) - 1)
        if tag in VOID:
            continue
        number += 1
        opened.push(tag, number, source)
    flush()
    return out


def costs(block: Block) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    if block.hard:
        return 0, HARD
    words = block.text.count(" ") + 1
    heading = block.tag[:1] == "h" and block.tag[1:].isdigit()
    score = 0.6 * min(words, 50) + (40 if block.inside else 0) + (8 if block.tag in ("p", "blockquote", "pre", "td", "dd", "figcaption") else 0) + (6 if heading else 0)
    score -= block.linked * (30 if block.tag == "li" else 24) + (0 if block.tag in ("p", "blockquote", "pre") or heading or block.inside else 10)
    if block.doubtful:
        score -= AGAINST
    if words < 5 and not block.inside and not heading and block.text[-1] not in ".!?…:;。":
        score -= 6
    return (round(score), 0) if score > 0 else (0, round(-score))


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source when the cheapest edges are cut. edges: (a, b, capacity), both ways. Dinic's algorithm."""
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in range(n):  # what passes through a node directly needs no search
        both = min(source[i], sink[i])
        if source[i] > both:
            add(s, i, source[i] - both, 0)
        elif sink[i] > both:
            add(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(heads[a]):
                e = heads[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = to[e]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Ties: 2 to the next block, and 6 or 3 to the next one with the same parent or grandparent in the tree."""
    edges = [(i - 1, i, 2) for i in range(1, len(blocks))]
    for up, weight in ((0, 6), (1, 3)):
        last: dict[int, int] = {}
        for i, b in enumerate(blocks):
            if len(b.near) > up:
                if b.near[up] in last:
                    edges.append((last[b.near[up]], i, weight))
                last[b.near[up]] = i
    return edges


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    source, sink = map(list, zip(*map(costs, blocks)))
    kept = minimum_cut(source, sink, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extracted(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, text and n_chars of each page."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.select(*keys, extract(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
