"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier over a block's own features (words up to
40, share of linked text outside of articles, kind of element, copyright sign) is fitted on the pages
themselves: blocks beside the longest one of their page are examples of content if their text stands on no
page with another longest block, blocks elsewhere whose text does of boilerplate; names of elements give no
examples. What a block's elements and their names say adds to its log-odds; a form, or a wrapper whose name speaks against
content, counts for nothing where it holds the marked element with most of the page's prose. The absolute
value of the sum is the capacity to the source (content) or the sink (boilerplate). Neighbouring blocks,
and consecutive blocks of one parent element, are joined by smoothness edges whose capacity falls with
their distance in the DOM. A maximum flow separates the two sides; blocks that the residual graph reaches
from the source are the main text.

The classifier learns from a sample of at most about ``sample_pages`` pages, chosen by a hash of the id, and
starts from given weights, which stay where there are no examples. Character references are decoded, white
space inside a block becomes one space, blocks are joined in page order by an empty line. Null pages and
pages without content give an empty text, an empty table an empty result. A page is read whole; memory is bounded
by one page. Rows keep their multiplicity, rows of one id or with a null url too; columns beyond ``keep`` are not returned.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frame import bounded_sample, by_rows, over_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.DOTALL)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

RAW = frozenset("script style template textarea title xmp iframe noframes svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an svg.
BREAKS = BLOCK - {"a", "title", "style", "script"} | {"body", "br", "img"}
#: Start tags that end an open element of the kinds given, up to the nearest enclosing one.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Log-odds of content by an enclosing element, and by words in its class, id, role or label.
AGAINST, WITHIN = -9.0, 4.0
TAG_COST = {"article": 5.0, "main": 4.0} | dict.fromkeys("nav footer aside form menu dialog button select search fieldset".split(), AGAINST)
BAD = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup share sharing social related recommended recommendations comment comments commenter reply replies respond discussion disqus form login search widget widgets toolbar pagination pager copyright masthead complementary contentinfo alert dialog toc skip".split())
#: Of these, what may hold articles that are not the page's own; and words that make a class a state of its element.
ASIDE = BAD & frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer related recommended recommendations comment comments commenter reply replies respond discussion disqus widget widgets complementary contentinfo".split())
#: What is never a wrapper of the page's own article.
FOREIGN = BAD & frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion related recommended recommendations comment comments commenter reply replies respond discussion disqus".split())
STATE = frozenset("no not has have with without is enabled disabled hide hidden show visible active open closed".split())
#: Words that leave the sense of a name with one of the above as it is.
PLAIN = frozenset("list box block section area container wrapper wrap inner outer links link posts item items bar unit slot top bottom left right group form field thread count button buttons post".split())
GOOD = frozenset("article content post entry story main articlebody".split())
#: The classifier's features, and the weights that it starts from.
KINDS = ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "td", "li")
WEIGHTS = np.array([-1.0, 0.1, -8.0, -3.0, 1.5, 1.5, 1.0, 1.0, 1.0, 1.5, 1.5, 0.5, -0.5])  # bias, words, links, ©, kinds
#: Smoothness between neighbours, divided by one more than the steps between their elements; and between siblings.
NEAR, SIBLING = 1.5, 1.0
SCALE = 1000


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    odds: float = 0.0
    closed: bool = False  # an article inside is not the page's own
    article: bool = False  # stands in an article
    sign: int = 0  # 1: marked as content, -1: speaks against content, -2: so does it, and can be no wrapper


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _weigh(here: Element, above: Element, wrapper: bool = False) -> None:
    """Log-odds of what stands in an element; those of a wrapper are left as they are above it.

    What is above counts, and the strongest sign against content stays, but where only names speak against
    content, or a form, an article or main inside raises the odds again.
    """
    tag = here.tag
    own = TAG_COST.get(tag, 0.0)
    closed = own < 0 and tag not in ("form", "fieldset")
    inside = above.odds >= WITHIN
    if tag == "header" and not inside:
        own, closed = AGAINST, True
    page, story, foreign = tag in ("article", "main"), tag == "article", closed
    if here.attributes:
        a = _attributes(here.attributes)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
            here.odds, here.closed, here.article, here.sign = -20.0, True, False, -2
            return
        role = a.get("role", "").strip().lower()
        page, story = page or role in ("article", "main"), story or role == "article"
        words = [{x.lower() for x in _NAME.findall(name)} for k in ("class", "id", "role", "aria-label") for name in (a.get(k, "").split() if k != "aria-label" else [a.get(k, "")])]
        bad = {x for w in words if not w & STATE for x in w & BAD}
        foreign = foreign or bool(bad & FOREIGN)
        if inside:  # a word of a longer name, as in "related-work", says nothing about a part of the article
            bad = {x for w in words if not w & STATE and all(x in BAD or x in PLAIN or x.isdigit() or (x in GOOD and w & ASIDE) for x in w) for x in w & BAD}
        if tag in ("article", "main", "body", "html"):
            bad &= {"comment", "comments", "reply", "related", "ad", "ads", "advertisement", "sponsored", "promo"}
        if bad and tag in ("div", "section") and any(w & GOOD and not w & BAD for w in words):
            own = min(own, -4.0)  # another of its names speaks for content
        elif bad:
            own, closed = min(own, AGAINST), closed or bool(bad & ASIDE)
        elif own == 0.0 and any(w & GOOD for w in words):
            own = WITHIN
    here.sign = 1 if own > 0 else 0 if own == 0 else -2 if foreign else -1
    if wrapper and here.sign == -1:
        own, closed = 0.0, False
    here.closed = above.closed or closed
    here.article = (above.article or story) and own >= 0
    if page and own > 0 and not above.closed:
        here.odds, here.closed = max(above.odds, own), False
    elif above.odds <= -8.0:
        here.odds = above.odds + min(own, 0.0)
    else:
        here.odds = own if own < 0 else max(above.odds, own)


def _wrappers(blocks: list[Block], elements: list[Element]) -> set[int]:
    """Elements that speak against content but hold the page's own article, by where its prose stands.

    Prose are the unlinked characters of blocks of ten words or more outside of comments, adverts, navigation
    and what is hidden. The marked element with most of it, if that is at least half, is the article, unless another one that
    nothing speaks against has a fifth as much. Without marked prose, a form with half of the prose is a wrapper.
    """
    barred = [False] * len(elements)
    prose = [0] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        barred[k] = barred[e.parent] or e.sign == -2
    for b in blocks:
        if not barred[b.element] and b.text.count(" ") >= 9:
            prose[b.element] += max(0, len(b.text) - b.links)
    for k in range(len(elements) - 1, 0, -1):
        prose[elements[k].parent] += prose[k]
    marked = [k for k, e in enumerate(elements) if e.sign == 1 and prose[k]]
    if not prose[0]:
        return set()
    if not any(elements[k].odds > 0 for k in marked):
        forms = {k for k, e in enumerate(elements) if e.tag == "form" and e.sign == -1 and 2 * prose[k] >= prose[0]}
    else:
        forms = set()
    best = max(marked, key=lambda k: (prose[k], k), default=0)
    if not best or 2 * prose[best] < prose[0]:
        return forms if not marked else set()
    above: set[int] = set()
    k = best
    while k:
        k = elements[k].parent
        above.add(k)
    if elements[best].odds > 0 or any(elements[k].odds > 0 and 5 * prose[k] > prose[best] and k not in above for k in marked):
        return set()
    return {k for k in above if elements[k].sign == -1} | {k for k in forms if k in above}


def weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Sets the log-odds of all elements; a parent stands before its children."""
    for e in elements[1:]:
        _weigh(e, elements[e.parent])
    if any(e.sign == -1 for e in elements) and (wrappers := _wrappers(blocks, elements)):
        for k, e in enumerate(elements[1:], 1):
            _weigh(e, elements[e.parent], k in wrappers)


@dataclass
class Block:
    text: str
    links: int  # characters inside of links
    element: int
    turn: int  # depth of the element that it shares with the block before


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and the elements they stand in."""
    elements = [Element("", -1, 0)]
    stack = [0]
    parts: list[str] = []
    found: list[Block] = []
    linked = links = owner = low = raw_depth = foreign = 0
    opened: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, owner, min(low, elements[owner].depth)))
                low = elements[owner].depth
            parts.clear()
        linked = 0

    def holder() -> int:
        return next((e for e in reversed(stack) if elements[e].tag in BLOCK), 0)

    def pop_to(k: int) -> None:
        nonlocal links, low
        for e in stack[k:]:
            opened[elements[e].tag] -= 1
            links -= elements[e].tag == "a"
        del stack[k:]
        low = min(low, elements[stack[-1]].depth)

    skip = ""
    for m in _TOKEN.finditer(page):
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if skip or (text[0] == "<" and len(text) > 1):
                continue
            if not parts:
                owner = holder()
            parts.append(text)
            if links:
                linked += len(text)
            continue
        tag, ends, attributes = tag.lower(), (m[1] or m[4]) == "/", (m[3] or m[6] or "")
        if skip:
            foreign += (tag == "foreignobject") * (1 - 2 * ends)
            if tag == skip and skip in ("svg", "template"):
                raw_depth += -1 if ends else not attributes.rstrip().endswith("/")
                skip = skip if raw_depth > 0 else ""
            elif tag == skip and ends:
                skip = ""
            elif skip == "svg" and foreign <= 0 and not ends and tag in BREAKS:
                skip = ""  # an svg that was not ended
            if skip or ends:
                continue
        if ends and not opened[tag]:
            if tag in BLOCK:
                end_block()
            continue
        if ends:
            k = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), 0)
            if tag in BLOCK:
                end_block()
            if k and (tag in BLOCK or not any(elements[e].tag in BLOCK for e in stack[k + 1 :])):
                pop_to(k)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                skip, raw_depth, foreign = tag, 1, 0
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
            if opened["p"] and (k := next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == "p"), 0)) and not any(elements[e].tag in ("td", "th", "button", "object") for e in stack[k + 1 :]):
                pop_to(k)
            if tag in CLOSES:
                kinds, within = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag in within:
                        break
                    if elements[stack[k]].tag in kinds:
                        pop_to(k)
                        break
        if tag in VOID:
            continue
        above = elements[stack[-1]]
        elements.append(Element(tag, stack[-1], above.depth + 1, attributes))
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            stack.append(len(elements) - 1)
            opened[tag] += 1
            links += tag == "a"
    end_block()
    weigh(found, elements)
    return found, elements


def features(block: Block, element: Element) -> list[float]:
    words = block.text.count(" ") + 1
    links = 0.0 if element.article else round(10 * min(1.0, block.links / max(1, len(block.text)))) / 10  # a list of sources is part of an article
    return [1.0, float(min(words, 40)), links, float("©" in block.text and words < 40), *(float(element.tag == k) for k in KINDS)]


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side of a minimum cut.

    Blocking flows over levels of equal distance from the source: as paths between neighbouring blocks are
    short, there are few levels, and each costs a pass over the edges.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, x in enumerate(odds):
        join(*((source, k) if x > 0 else (k, sink)), round(abs(x) * SCALE), 0)
    for a, b, x in edges:
        join(a, b, round(x * SCALE), round(x * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = [source]
        for a in todo:
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if not room[e])
                del path[back + 1 :]
                a = to[path.pop() ^ 1]
            elif at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 0 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    at[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def costs(blocks: list[Block], elements: list[Element], weights: np.ndarray = WEIGHTS) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The log-odds of the blocks, and the smoothness edges between them."""
    if not blocks:
        return [], []
    own = (np.array([features(b, elements[b.element]) for b in blocks]) @ weights).tolist()
    odds = [x + elements[b.element].odds for x, b in zip(own, blocks, strict=True)]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        here = elements[b.element]
        if k:
            edges.append((k - 1, k, NEAR / (1 + elements[blocks[k - 1].element].depth + here.depth - 2 * b.turn)))
        if here.parent in last and last[here.parent] != k - 1:
            edges.append((last[here.parent], k, SIBLING))
        last[here.parent] = k
    return odds, edges


def main_text(page: str | None, weights: np.ndarray = WEIGHTS) -> str:
    blocks, elements = blocks_of(page or "")
    odds, edges = costs(blocks, elements, weights)
    if not any(x > 0 for x in odds):
        return ""
    keep = min_cut(odds, edges) if any(x <= 0 for x in odds) else [True] * len(odds)
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def examples(page: str | None) -> list[tuple[tuple[float, ...], bytes, bytes, bool]]:
    """Of each block the features, digests of its text and of the page's longest block, and whether it stands beside that one."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return []
    longest = max(blocks, key=lambda b: len(b.text) - b.links)
    parent, key = elements[longest.element].parent, _digest(longest.text)
    return [(tuple(features(b, e)), _digest(b.text), key, e.parent == parent) for b in blocks for e in (elements[b.element],)]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def learn(counts: dict[tuple[tuple[float, ...], int], int], prior: float = 1.0, most: float = 1000.0) -> np.ndarray:
    """Weights of a logistic regression, kept near ``WEIGHTS``; examples together weigh ``most`` at most, both kinds alike."""
    total = [sum(n for (_, y), n in counts.items() if y == k) for k in (0, 1)]
    if not all(total):
        return WEIGHTS
    keys = sorted(counts)
    x, y = np.array([k[0] for k in keys]), np.array([k[1] for k in keys], dtype=np.float64)
    n = np.array([counts[k] / total[k[1]] for k in keys]) * min(most, sum(total)) / 2
    w = WEIGHTS.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w)), x.T @ (n * (p - y)) + prior * (w - WEIGHTS))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 4_000) -> np.ndarray:
    """The classifier's weights. To the driver come counts of distinct examples: some thousands of feature values at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            found = [e for page in b.column(0).to_pylist() for e in examples(page)]
            yield pa.RecordBatch.from_arrays([pa.array([list(e[0]) for e in found], pa.list_(pa.float64())), *(pa.array([e[k] for e in found], kind) for k, kind in ((1, pa.binary()), (2, pa.binary()), (3, pa.bool_())))], ["x", "t", "k", "near"])

    pages = bounded_sample(df.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("h")), "id", sample_pages).select("h")
    seen = pages.mapInArrow(run, "x array<double>, t binary, k binary, near boolean").groupBy("t", "x", "near").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"))
    text = Window.partitionBy("t")
    sure = seen.select("x", "n", F.when(F.col("near") == (F.min("a").over(text) == F.max("b").over(text)), F.col("near").cast("int")).alias("y")).where("y is not null")
    found = sure.groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    return learn({(tuple(r.x), r.y): r.n for r in found})


def extract(df: DataFrame, weights: np.ndarray = WEIGHTS, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns of ``keep``, and ``text string`` of every page; ``weights`` are what ``fit`` returns."""
    return over_texts(df, html_col, [id_col, *keep], lambda: lambda pages: [pa.array([main_text(p, weights) for p in pages], pa.string())], "text string")
