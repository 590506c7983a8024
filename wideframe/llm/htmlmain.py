"""Operator 5 - main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A logistic classifier over a block's ancestors,
their class and id words, its link share, length and punctuation gives the log-odds
that it is content; these are the capacities from the source and to the sink.
Blocks that follow each other are joined by an edge that weakens with their
distance in the document tree, and siblings by a further one.  The minimum cut
(maximum flow by shortest augmenting paths, level by level) parts content from
boilerplate, so a block about which the classifier is in doubt goes with those around it.

The weights are fitted on a bounded sample of the pages (``SAMPLE_PAGES``), whose
blocks are labelled by the pages' own ``article`` and ``main`` markup: content is what
is inside and under no element of boilerplate.  Each page counts twice, once as it
is and once as if it had no such markup, so that the other features are learned
too.  Stated prior weights hold where the sample says nothing (``PRIOR_SHARE``); without
any page to learn from they are the weights.

Character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined in page order by two line feeds.  Scripts, styles,
comments in the markup, form controls and hidden elements never become blocks.

Scale: a map over pages, no shuffle; a page is handled by itself, in time about
linear in its length.  Of the sample only counts of equal feature vectors are shuffled and collected.

Edge cases: a null or empty page, or one without content, has an empty text.
Unclosed and stray tags are closed or skipped; an unclosed script, style or
comment runs to the end of the page.  Text without any markup is content.
Very long pages are handled whole.  Repeated rows each get a row, null ids and urls too; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import map_batches, row_groups

_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""")
_LOOSE = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template", "svg", "canvas", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: A start tag that ends an open element of these kinds first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"html", "body", "head", "button", "caption", "tbody", "tfoot", "thead", "tr", "legend", "summary"}
#: Elements whose text is never content.
NEVER = {"head", "button", "form", "dialog", "datalist", "legend"}
#: Elements of boilerplate (a header only outside of an article), and roles.
BOILERPLATE = {"nav", "menu", "footer", "aside", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}

#: Words of class names and ids that speak for content, against it, and weakly against it.
GOOD_WORDS = {"article", "content", "post", "entry", "main", "story", "body", "text", "maincontent", "articlebody"}
BAD_WORDS = {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
    "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended",
    "recommendations", "trending", "comment", "comments", "disqus", "reply", "replies", "breadcrumb", "breadcrumbs", "pagination", "pager", "login", "signin", "signup", "copyright",
    "toolbar", "sitemap", "respond",
}
WEAK_WORDS = {"header", "masthead", "banner", "disclaimer", "legal", "toc", "tags", "skip", "search", "register", "discussion", "widget"}

#: Features of a block, and the prior of their weights, in log-odds.
PRIOR = {"main": 3.0, "outside": -2.0, "boilerplate": -5.0, "bad": -5.0, "weak": -2.0, "good": 1.5, "stop": 0.7, "heading": 0.5, "links": -3.0, "length": 0.4, "bias": -0.5}
FLAGS = ("main", "outside", "boilerplate", "bad", "weak", "good", "stop", "heading")
#: Pages that the weights are fitted on, at most: those with the smallest hashes.
SAMPLE_PAGES = 400
#: Weight of the prior beside the mean loss of a block.
PRIOR_SHARE = 0.01
# Smoothness: between neighbours, divided by their distance in the tree, and between siblings.
NEIGHBOUR = 1.5
SIBLING = 1.0

#: Page bytes handled at once.
GROUP_BYTES = 4 << 20


class Block:
    __slots__ = ("depth", "flags", "heading", "links", "parent", "parts", "size", "text")

    def __init__(self, frame: tuple):
        _, self.parent, self.depth, _, self.flags, self.heading = frame
        self.parts: list[str] = []
        self.links = self.size = 0
        self.text = ""


def _flags(tag: str, raw: str, above: frozenset) -> tuple[frozenset, bool]:
    """Flags that hold within an element, and whether it is hidden."""
    flags, hidden, words = set(above), False, set()
    entered = tag in ("article", "main")
    boilerplate = tag in BOILERPLATE or (tag == "header" and "main" not in above)
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "role":
            role = value.strip().lower()
            boilerplate |= role in ROLES
            entered |= role in ("main", "article")
        elif name == "itemprop" and value.lower() == "articlebody":
            entered = True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            style = value.lower().replace(" ", "")
            hidden = hidden or "display:none" in style or "visibility:hidden" in style
    good = bool(words & GOOD_WORDS)
    if good:
        flags.add("good")
    if tag not in ("html", "body", "article", "main"):
        if words & BAD_WORDS and not good:
            flags.add("bad")
        elif words & (BAD_WORDS | WEAK_WORDS):
            flags.add("weak")
    if boilerplate:
        flags.add("boilerplate")
    if flags & {"bad", "boilerplate"}:
        flags.discard("main")
    elif entered:
        flags.discard("weak")
        flags.add("main")
    return frozenset(flags), hidden


def blocks(page: str) -> tuple[list[Block], list[int], list[int]]:
    """The page's blocks of text in order, and the parent and depth of every element by number."""
    # a frame: tag, number, depth, never content, flags, heading
    frames: list[tuple] = [("", 0, 0, False, frozenset(), False)]
    up, deep = [0], [0]
    opened: dict[str, int] = {}
    found: list[Block] = []
    current: Block | None = None
    link, mute, at, end, last = 0, 0, 0, len(page), page.rfind(">")

    def text(a: int, b: int) -> None:
        nonlocal current
        if a >= b or mute or frames[-1][3]:
            return
        part = page[a:b]
        if current is None:
            if part.isspace():
                return
            current = Block(frames[-1])
            found.append(current)
        current.parts.append(part)
        current.size += b - a
        if link:
            current.links += b - a

    def pop() -> None:
        nonlocal link, mute
        opened[frames.pop()[0]] -= 1
        link, mute = (0 if k > len(frames) else k for k in (link, mute))

    while at < end:
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):  # no tag ends any more
            text(at, end)
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a lone "<"
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if m.lastindex is None or m[2] is None:  # a declaration
            continue
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW:
            if not closing and not raw.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "a":
            link = 0 if closing else len(frames)
            continue
        if tag == "label":
            mute = 0 if closing else len(frames)
            continue
        if tag not in BLOCK:
            if (tag in ("br", "td", "th", "img", "wbr") or tag == "option") and current is not None:
                current.parts.append("" if tag == "wbr" else " ")
            continue
        current = None
        if closing:
            if opened.get(tag, 0):
                while frames[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in ENDS_P and frames[-1][0] == "p":
            pop()
        while frames[-1][0] in CLOSES.get(tag, ()):
            pop()
        if tag in VOID:
            continue
        above = frames[-1]
        flags, hidden = _flags(tag, raw, above[4])
        heading = len(tag) == 2 and tag[0] == "h" and tag != "hr"
        frames.append((tag, len(up), above[2] + 1, above[3] or hidden or tag in NEVER, flags, heading))
        up.append(above[1])
        deep.append(above[2] + 1)
        opened[tag] = opened.get(tag, 0) + 1
    for b in found:
        joined = "".join(b.parts)
        b.text = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
    return [b for b in found if b.text], up, deep


def features(found: list[Block], markup: bool = True) -> list[int]:
    """A code of each block's features: the flags, its link share in tenths, its length in powers of two.

    Without ``markup`` the page counts as one without article or main elements.
    """
    has_main = markup and any("main" in b.flags for b in found)
    out = []
    for b in found:
        own = set(b.flags)
        if not markup:
            own.discard("main")
        elif has_main and "main" not in own:
            own.add("outside")
        if b.text[-1] in ".!?…。！？\"”»:":
            own.add("stop")
        if b.heading:
            own.add("heading")
        code = sum(1 << i for i, name in enumerate(FLAGS) if name in own)
        out.append(code | round(10 * b.links / max(b.size, 1)) << 8 | round(math.log2(1 + b.text.count(" "))) << 12)
    return out


def _vectors(codes: list[int]) -> np.ndarray:
    """Feature vectors of codes, in the order of ``PRIOR``."""
    code = np.array(codes, np.int64)[:, None]
    flags = (code >> np.arange(len(FLAGS))) & 1
    return np.hstack([flags, (code >> 8 & 15) / 10, code >> 12, np.ones_like(code)]).astype(np.float64)


def gains(codes: list[int], weights: list[float]) -> list[float]:
    """For each block, the log-odds that it is content."""
    return (_vectors(codes) @ np.array(weights)).tolist() if codes else []


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, content, n) of the blocks of the pages that have article or main markup."""
    seen: Counter = Counter()
    for whole in batches:
        for batch in row_groups(whole, 0, GROUP_BYTES):
            for page in batch.column(0).to_pylist():
                found, _, _ = blocks(page or "")
                content = ["main" in b.flags for b in found]
                if any(content):
                    for markup in (True, False):
                        seen.update(zip(features(found, markup), content, strict=True))
    keys = sorted(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=["code", "content", "n"])


def fit(codes: list[int], content: list[bool], n: list[int]) -> list[float]:
    """Weights of least mean loss and distance from the prior, by Newton's method."""
    prior = np.array(list(PRIOR.values()))
    if not codes:
        return prior.tolist()
    x, y, c, w = _vectors(codes), np.array(content, np.float64), np.array(n, np.float64) / sum(n), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (c * (p - y)) + PRIOR_SHARE * (w - prior)
        curve = (x.T * (c * p * (1 - p))) @ x + PRIOR_SHARE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> list[float]:
    """Weights fitted on at most ``sample`` distinct pages."""
    own = pages.select(F.col(html).alias("page")).where("page is not null").withColumn("h", F.xxhash64("page"))
    last = own.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]  # a top-k of hashes
    if last is None:
        return fit([], [], [])
    chosen = own.where(F.col("h") <= last).groupBy("h").agg(F.first("page").alias("page"))
    seen = map_batches(chosen.select("page"), _observed, "code bigint, content boolean, n bigint").groupBy("code", "content").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in seen.collect())  # bounded: the codes are flags, tenths and powers of two
    return fit(*map(list, zip(*rows, strict=True))) if rows else fit([], [], [])


def _steps(a: int, b: int, up: list[int], deep: list[int]) -> int:
    """Distance of two elements in the tree."""
    steps = 0
    while a != b:
        if deep[a] >= deep[b]:
            a = up[a]
        else:
            b = up[b]
        steps += 1
    return steps


def graph(found: list[Block], up: list[int], deep: list[int]) -> list[tuple[int, int, float]]:
    """Edges between blocks: (block, block, cost of parting them)."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + _steps(found[i - 1].parent, b.parent, up, deep))))
        group = up[b.parent]
        if group in last:
            edges.append((last[group], i, SIBLING))
        last[group] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut; of several cuts, the one with the most content."""
    n = len(gain)
    excess = list(gain)  # above 0: left to come from the source; below 0: left to go to the sink
    near: list[list[list]] = [[] for _ in range(n)]  # [to, left, number of the way back]
    for i, j, c in edges:
        near[i].append([j, c, len(near[j])])
        near[j].append([i, c, len(near[i]) - 1])
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if excess[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:  # grows while it is read
            for j, left, _ in near[i]:
                if left > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    reached = reached or excess[j] < -tiny
                    queue.append(j)
        if not reached:
            break
        turn = [0] * n
        for root in [i for i in range(n) if excess[i] > tiny]:
            path: list[list] = []
            at = root
            while excess[root] > tiny:
                if excess[at] < -tiny:
                    flow = min(excess[root], -excess[at], *(e[1] for e in path)) if path else 0.0
                    for e in path:
                        e[1] -= flow
                        near[e[0]][e[2]][1] += flow
                    excess[root] -= flow
                    excess[at] += flow
                    path, at = [], root
                    continue
                while turn[at] < len(near[at]):
                    e = near[at][turn[at]]
                    if e[1] > tiny and level[e[0]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(near[at]):
                    path.append(near[at][turn[at]])
                    at = path[-1][0]
                elif path:
                    back = path.pop()
                    at = near[back[0]][back[2]][0]
                    turn[at] += 1
                else:
                    break
    sink = [excess[i] < -tiny for i in range(n)]
    queue = [i for i in range(n) if sink[i]]
    for j in queue:
        for i, _, back in near[j]:
            if not sink[i] and near[i][back][1] > tiny:
                sink[i] = True
                queue.append(i)
    return [not s for s in sink]


def main_text(page: str | None, weights: list[float] | None = None) -> str:
    """Main text of a page; without weights, by the prior."""
    found, up, deep = blocks(page or "")
    if not found:
        return ""
    if len(found) == 1 and not found[0].depth:
        return found[0].text
    keep = minimum_cut(gains(features(found), weights or list(PRIOR.values())), graph(found, up, deep))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(weights: list[float], carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, 0, GROUP_BYTES):
                texts = [main_text(p, weights) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i + 1) for i in range(carried)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*(f"c{i}" for i in range(carried)), "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, carry: list[str], html: str = "html", weights: list[float] | None = None) -> DataFrame:
    """Columns ``carry`` of every page with its main ``text`` and ``n_chars``."""
    own = pages.selectExpr(f"`{html}` as h", *[f"`{c}` as c{i}" for i, c in enumerate(carry)])
    kept = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    out = map_batches(own, _extract(weights or list(PRIOR.values()), len(carry)), f"{kept}text string, n_chars bigint")
    return out.selectExpr(*[f"c{i} as `{c}`" for i, c in enumerate(carry)], "text", "n_chars")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by weights fitted on a sample of them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, ["page_id", "url"], weights=train(pages))
