"""Main text of web pages by a minimum cut (operator 1).

A page becomes a row of text blocks. A classifier gives each block log-odds of
being content: they are its terminal capacities. Blocks that are adjacent, and
blocks of the same parent, are tied by smoothness edges, the weaker the longer
the way between them in the DOM. The minimum cut between the content and the
boilerplate terminal labels all blocks at once. Blocks whose own capacity
exceeds all their edges keep their side in every minimum cut; the others are
settled by max-flow, and may get another label than their own odds say.

The classifier is one logistic model of what a block's containers say (kinds of
evidence, not single names) and of its shape. It is trained on a bounded sample
of pages: blocks in article or main against those in nav, footer or aside, each
with and without its containers' evidence, so that shape is weighed for pages
that name nothing. A ridge that grows with the sample draws the weights to the
prior ones: they stay finite on data that a weight alone could part, and few
pages move them little. The edges' weight is the one of a few that errs least
on other pages of the sample, read without their containers' names: so costs of
shape and edges are of one scale, and neighbours overrule blocks whose shape
alone misleads.

What is shown counts as text: mathematics and the contents of object, video,
audio and canvas do. Drawings (svg) and other encodings (annotation) do not.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, small_batches, table, texts_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names of elements and what they say.
RAW = frozenset("script style textarea title template iframe noembed noframes svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math maction menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video wbr img".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form menu button select fieldset dialog head header noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot header masthead topbar sidebar aside rail widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments respond reply replies disqus discussion toolbar skip copyright legal tags meta".split()
)
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
#: First parts of names that tell a state of the page, not what an element is (with-sidebar, has-comments).
STATE_NAMES = frozenset("with without no not has is hide show".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CONTENT_ROLES = frozenset(("main", "article"))

#: Kinds of evidence that containers give.
IN_CONTENT, IN_BOILER, GOOD_NAME, BAD_NAME, HIDDEN, ARTICLE_HEADER = (1 << k for k in range(6))
FEATURES = ("in article or main", "in nav, footer ...", "content name", "boilerplate name", "hidden", "header of an article", "log words", "link density", "stops per word", "heading", "list item", "copyright sign", "bias")
EVIDENCE = 6
#: Prior weights of the features, and where too few pages say what is what, the weights.
PRIOR = (2.2, -6.0, 1.2, -6.0, -12.0, -4.0, 0.7, -3.0, 3.0, 1.0, -1.0, -4.0, -1.6)
SMOOTH = 1.2
#: A ridge of this weight for each row of the sample draws the fit to PRIOR.
RIDGE = 0.02
#: Rows that count for PRIOR besides those of the sample.
RIDGE_ROWS = 100
#: Weights of the edges that are tried.
SMOOTHS = (0.0, 0.3, 0.6, SMOOTH, 1.8, 2.4, 3.6)
#: Errors by which another weight than SMOOTH must do better.
PRIOR_ERRORS = 5
#: The most pages, and blocks of one page, that the model is fitted on.
FIT_PAGES, FIT_BLOCKS = 2000, 40
#: Steps in the DOM beyond which two blocks are not tied.
FAR = 12


class Node:
    """An element that is not inline: its parent and depth."""

    __slots__ = ("depth", "parent")

    def __init__(self, parent: "Node | None"):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("heading", "item", "linked", "node", "parts", "says", "size", "text")

    def __init__(self, node: Node, says: int, heading: bool, item: bool):
        self.node, self.says, self.heading, self.item = node, says, heading, item
        self.parts, self.linked, self.size, self.text = [], 0, 0, ""

    def features(self) -> tuple[float, ...]:
        words = self.text.count(" ") + 1
        stops = sum(self.text.count(c) for c in ".,;:!?")
        evidence = tuple(float(self.says >> k & 1) for k in range(EVIDENCE))
        return (*evidence, min(5.0, math.log(words)), self.linked / max(1, self.size), min(1.0, stops / words), float(self.heading), float(self.item), float("©" in self.text), 1.0)


def _says(tag: str, attributes: str, in_content: bool) -> int:
    """The evidence that an element gives for what it holds."""
    if tag in CONTENT_TAGS:
        says = IN_CONTENT
    elif tag == "header" and in_content:
        says = ARTICLE_HEADER
    elif tag in BOILER_TAGS:
        says = IN_BOILER
    else:
        says = 0
    if not attributes or tag in ("html", "body"):
        return says
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.split():
                pieces = [p.lower() for p in _PIECES.findall(name)]
                if not pieces or pieces[0] in STATE_NAMES:
                    continue
                good, bad = CONTENT_NAMES.intersection(pieces), BOILER_NAMES.intersection(pieces)
                if bad and not (good and bad <= {"header", "meta"}):
                    says |= BAD_NAME
                elif good:
                    says |= GOOD_NAME
        elif key == "role":
            says |= IN_BOILER if value.lower() in BOILER_ROLES else IN_CONTENT if value.lower() in CONTENT_ROLES else 0
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            says |= HIDDEN
    return says


_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with their places in the DOM and what their containers say."""
    out: list[Block] = []
    # tag, nearest element that is not inline, evidence so far, kind: 1 heading, 2 list item, 4 link
    stack: list[tuple[str, Node, int, int]] = [("#", Node(None), 0, 0)]
    opened: Counter[str] = Counter()
    # places in the stack of elements that are not inline, and the inline elements that are open in the last of each
    bases, inside = [0], [Counter()]
    block: Block | None = None
    at = 0
    end = len(page)

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if len(stack) == bases[-1]:
                bases.pop()
                inside.pop()
            else:
                inside[-1][tag] -= 1

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if piece.isspace():
                return
            _, node, says, kind = stack[-1]
            if kind & 1:
                says &= ~ARTICLE_HEADER  # the title
            block = Block(node, says, bool(kind & 1), bool(kind & 2))
            out.append(block)
        piece = html.unescape(piece) if "&" in piece else piece
        block.parts.append(piece)
        n = len(piece)
        block.size += n
        if stack[-1][3] & 4:
            block.linked += n

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            block = None
        if closing:
            # what is passed on the way to the element goes with it, so all ways together are as long as the page
            if inside[-1][tag] if tag in INLINE else opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end if close is None else close.start()
            if close is not None:
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            shut = ("p",) if tag in _CLOSES_P else ("dt", "dd", "p") if tag in ("dt", "dd") else (tag, "p")
            if stack[bases[-1]][0] in shut:
                cut(bases[-1])
            while tag in _CLOSES_P and stack[-1][0] in INLINE and stack[-1][0] != "a":
                cut(len(stack) - 1)  # an inline element left open does not reach over blocks
        _, node, says, kind = stack[-1]
        if tag == "a":
            kind |= 4
        elif tag in HEADINGS:
            kind |= 1
        elif tag == "li":
            kind |= 2
        in_content = bool(says & IN_CONTENT) and not says & (IN_BOILER | BAD_NAME)
        if tag in INLINE:
            inside[-1][tag] += 1
        else:
            bases.append(len(stack))
            inside.append(Counter())
        stack.append((tag, node if tag in INLINE else Node(node), says | _says(tag, attributes, in_content), kind))
        opened[tag] += 1
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return kept


def log_odds(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    if not blocks:
        return []
    return (np.array([b.features() for b in blocks]) @ np.array(weights)).tolist()


def _steps(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM, FAR + 1 at most."""
    n = 0
    while a is not b and n <= FAR:
        if a.depth >= b.depth:
            a, n = a.parent, n + 1
        else:
            b, n = b.parent, n + 1
    return n


def _edges(blocks: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Smoothness: adjacent blocks and next blocks of the same parent, weaker along longer DOM ways."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k and (n := _steps(blocks[k - 1].node, b.node)) <= FAR:
            out.append((k - 1, k, smooth * 4.0 ** (2 - max(2, n))))
        parent = id(b.node.parent)
        if (j := last.get(parent)) is not None and j != k - 1:
            out.append((j, k, smooth / 2))
        last[parent] = k
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of the minimum cut with terminal capacities |odds| (ties: the sink side).

    Exact: nodes whose capacity exceeds the sum of their edges are settled
    first, and their edges fold into their neighbours' capacities; what is left
    is solved by max-flow with shortest augmenting paths.
    """
    n = len(odds)
    odds, near = list(odds), [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(odds[i]) > sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                odds[j] += w if side[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    for i, content in zip(left, _flow_sides(left, odds, near)):
        side[i] = content
    return side  # type: ignore[return-value]


def _flow_sides(nodes: list[int], odds: list[float], cap: list[dict[int, float]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow: shortest ways first, all ways of a length at a time."""
    least = 1e-12
    give, take = {i: max(0.0, odds[i]) for i in nodes}, {i: max(0.0, -odds[i]) for i in nodes}
    while True:
        level = {i: 0 for i in nodes if give[i] > least}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            found = found or take[i] > least
            for j, c in cap[i].items():
                if c > least and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [i in level for i in nodes]
        ways = {i: list(cap[i]) for i in level}
        for start in [i for i in level if not level[i]]:
            path = [start]
            while path and give[start] > least:
                i = path[-1]
                if take[i] > least:
                    flow = min(give[start], take[i], *(cap[a][b] for a, b in zip(path, path[1:])))
                    give[start] -= flow
                    take[i] -= flow
                    for a, b in zip(path, path[1:]):
                        cap[a][b] -= flow
                        cap[b][a] += flow
                    while len(path) > 1 and (take[path[-1]] <= least or cap[path[-2]][path[-1]] <= least):
                        if cap[path[-2]][path[-1]] > least:
                            break
                        path.pop()
                    if any(cap[a][b] <= least for a, b in zip(path, path[1:])):
                        path = [start]
                    continue
                while ways[i] and not (cap[i][ways[i][-1]] > least and level.get(ways[i][-1]) == level[i] + 1):
                    ways[i].pop()
                if ways[i]:
                    path.append(ways[i][-1])
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def label(page: str | None, weights: tuple[float, ...] = PRIOR, smooth: float = SMOOTH) -> tuple[list[Block], list[bool]]:
    """A page's blocks, and which of them the cut calls content."""
    blocks = blocks_of(page or "")
    return blocks, min_cut(log_odds(blocks, weights), _edges(blocks, smooth))


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR, smooth: float = SMOOTH) -> str:
    return " ".join(b.text for b, k in zip(*label(page, weights, smooth)) if k)


def _labelled(b: Block) -> bool | None:
    """What a semantic element says of a block: content, boilerplate or nothing."""
    bad = bool(b.says & (IN_BOILER | BAD_NAME | HIDDEN))
    return not bad if bool(b.says & IN_CONTENT) != bad or b.says & IN_BOILER else None


def fit_rows(blocks: list[Block]) -> list[tuple[float, ...]]:
    """Training rows (features, label) of a page's blocks that a semantic element labels: with their containers' evidence and without."""
    own = [b for b in blocks if _labelled(b) is not None]
    rows = []
    for k in sorted({int(x) for x in np.linspace(0, len(own) - 1, FIT_BLOCKS)}) if own else ():
        x, y = own[k].features(), float(_labelled(own[k]))
        rows += [(*x, y), (*(0.0,) * EVIDENCE, *x[EVIDENCE:], y)]
    return rows


def fit_weights(rows: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps that are halved until they better the fit; without rows the weights are PRIOR, with few near it."""
    rows = np.asarray(rows, float).reshape(-1, len(FEATURES) + 1)
    rows = rows[np.lexsort(rows.T)]
    x, y, prior = rows[:, :-1], rows[:, -1], np.array(PRIOR)
    ridge = RIDGE * (len(y) + RIDGE_ROWS)

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * np.sum((w - prior) ** 2)

    w = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        step, size, now = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), slope), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(round(float(v), 6) for v in w)


def bare_errors(blocks: list[Block], weights: tuple[float, ...], smooths: tuple[float, ...] = SMOOTHS) -> list[int]:
    """Labelled blocks that the cut gets wrong with each weight of the edges, when it is not told what their containers say."""
    if not any(_labelled(b) is not None for b in blocks):
        return [0] * len(smooths)
    x = np.array([b.features() for b in blocks])
    x[:, :EVIDENCE] = 0
    odds, want = (x @ np.array(weights)).tolist(), [_labelled(b) for b in blocks]
    return [sum(y is not None and y != k for y, k in zip(want, min_cut(odds, _edges(blocks, smooth)))) for smooth in smooths]


def _sample(pages: DataFrame, seed: int) -> DataFrame:
    """html and fold (0 or 1) of at most FIT_PAGES pages that the hash of their ids picks."""
    few = pages.select("page_id", F.xxhash64("page_id", F.lit(seed)).alias("h")).orderBy("h", "page_id").limit(FIT_PAGES).select("page_id", F.pmod("h", F.lit(2)).cast("int").alias("fold")).distinct()
    return pages.select("page_id", "html").join(F.broadcast(few), "page_id").select("html", "fold").limit(FIT_PAGES)


def fit(pages: DataFrame, seed: int = 7) -> tuple[float, ...]:
    """The classifier's weights, from one half of the sample."""

    def run(batches):
        for batch in batches:
            rows = [r for page in texts_of(batch, "html") for r in fit_rows(blocks_of(page))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    return fit_weights([r.x for r in _sample(pages, seed).where("fold = 0").select("html").mapInArrow(run, "x array<double>").collect()])


def calibrate(pages: DataFrame, weights: tuple[float, ...], seed: int = 7) -> float:
    """The weight of the edges that errs least on the other half of the sample, its pages read as if no container had a name; SMOOTH, if none betters it by PRIOR_ERRORS."""

    def run(batches):
        for batch in batches:
            errors = [bare_errors(blocks_of(page), weights) for page in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in errors], pa.int64()) for k in range(len(SMOOTHS))], [f"e{k}" for k in range(len(SMOOTHS))])

    errors = _sample(pages, seed).where("fold = 1").select("html").mapInArrow(run, ", ".join(f"e{k} long" for k in range(len(SMOOTHS))))
    total = errors.agg(*(F.coalesce(F.sum(f"e{k}"), F.lit(0)) for k in range(len(SMOOTHS)))).first()
    return min((e + PRIOR_ERRORS * (s != SMOOTH), s != SMOOTH, s) for e, s in zip(total, SMOOTHS))[2]


def extract(pages: DataFrame, weights: tuple[float, ...] = PRIOR, smooth: float = SMOOTH) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept per row of pages.

    A null or empty page gives the empty text; markup that is cut off is read as
    far as it goes; repeated rows give repeated results; other columns are left
    aside.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, "html"):
            texts, n, kept = [], [], []
            for page in texts_of(batch, "html"):
                blocks, keep = label(page, weights, smooth)
                texts.append(" ".join(b.text for b, k in zip(blocks, keep) if k))
                n.append(len(blocks))
                kept.append(sum(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = fit(pages)
    return extract(pages, weights, calibrate(pages, weights))
