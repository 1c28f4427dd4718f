"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of blocks. A linear classifier gives each block a cost of being called boilerplate and one of
being called content; these are the capacities to the two terminals. Neighbouring blocks, and blocks close in the
document tree, are joined by edges whose cut costs smoothness. The minimum cut separates content from boilerplate.

Nothing is labelled, so the classifier learns from what the pages show: a text that pages with different articles of one
host repeat is boilerplate, a text of an article that no other page holds is content. A prior keeps its weights near
those that HTML's own names suggest, and gives them where the pages show nothing.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import written

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
# How HTML names divide a page.
RAW = {"script", "style", "textarea", "title", "iframe"}  # text up to the end tag, or of the page, as browsers read it
UNSHOWN = {"noscript", "template", "svg", "select"}  # left out where they are closed; else the tag alone
ITEMS, LISTS = {"li", "dd", "dt", "td", "th", "tr", "option"}, {"ul", "ol", "dl", "table"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"button", "label", "body", "html", "head"}
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "label", "menu", "dialog", "fieldset", "head"}
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|sidebar|footer|masthead|comments?|discussion|replies|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|sharing|breadcrumbs?|widget|newsletter|subscribe|signup|login|copyright|disclaimer|pagination|pager|toolbar)(?:$|[\s_-])"
    # words that a heading's id may hold as well: alone, or with a word for a part of a page
    r"|(?:^|\s)(?:side|foot|header|share|social|related|recommend\w*|legal|tags?|search|hidden)(?:[_-](?:bar|box|posts?|articles?|links?|stories|list|widget|buttons?|items?|block|nav|container|wrapper|area))*(?:$|\s)")
_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])")
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _hidden(attributes: str) -> bool:
    """Do an element's own attributes, not words in their values, hide it?"""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, *values in _ATTRIBUTE.findall(low):
        value = "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


@dataclass
class Node:
    """An open element: where it stands in the tree and what its ancestors and it say about a block."""

    tag: str
    number: int
    depth: int
    parent: int
    content: bool = False
    boiler: int = 0
    named: int = 0
    hidden: bool = False
    article: bool = False
    block: Node | None = None  # the nearest block at or above it; none: the page
    p: int = 0  # place in the stack of the open paragraph in scope, 0 if none
    items: dict[str, int] = field(default_factory=dict)  # of open list items and cells in scope


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int
    heading: bool


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, white space as one space, references decoded, without markup, scripts and styles."""
    stack = [Node("", 0, 0, 0)]
    opened: Counter = Counter()
    found: list[Block] = []
    parts: list[str] = []
    links, numbers, at = 0, 0, 0
    holder = stack[0]
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text and not holder.hidden:
            found.append(Block(text, holder, min(links, len(text)), bool(re.fullmatch("h[1-6]", holder.tag))))
        parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal holder, links
        if not parts:
            holder = stack[-1].block or stack[0]
        parts.append(text)
        if any(n.tag == "a" for n in stack[-4:]):
            links += len(text.strip())

    def close(depth: int) -> None:
        if any(n.tag in BLOCK for n in stack[depth:]):
            flush()
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while m := _TAG.search(html, at):
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag] > 0:  # what is closed on the way is gone from the stack, so each element is passed once
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW or tag in UNSHOWN:
            if not attributes.rstrip().endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(html)
                else:
                    unclosed.add(tag)
            if tag in ("select", "iframe"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in CLOSES_P and stack[-1].p:
            close(stack[-1].p)
        if tag in ITEMS and stack[-1].items.get(tag):
            close(stack[-1].items[tag])
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        up = stack[-1]
        numbers += 1
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""
        boiler = tag in BOILER_TAGS and not (tag == "header" and up.article)  # an article's own header is part of it
        node = Node(tag, numbers, up.depth + 1, up.number, up.content or tag in CONTENT_TAGS, up.boiler + boiler, up.named, up.hidden or bool(attributes and _hidden(attributes)), up.article or tag == "article")
        node.block = node if tag in BLOCK else up.block
        node.p = len(stack) if tag == "p" else 0 if tag in ("button", "table") else up.p
        node.items = {**up.items, tag: len(stack)} if tag in ITEMS else {} if tag in LISTS else up.items
        if names:
            node.named += 2 if _BOILER_NAME.search(names) else -1 if _CONTENT_NAME.search(names) else 0
        stack.append(node)
        opened[tag] += 1
    if at < len(html):
        say(html[at:])
    flush()
    return found


#: Weights before anything is learnt: none, content tags, boilerplate tags, names, length, links in an article, links
#: elsewhere, a sentence's end, headings, items that are links, copyright lines.
PRIOR = (-0.6, 2.6, -3.2, -1.9, 2.5, -1.0, -3.0, 0.5, 0.4, -1.2, -1.5)
MASKED = (1, 2, 3)  # what the page says of itself; left out of every second example


def features(block: Block) -> list[float]:
    """What the classifier sees of a block, in the order of PRIOR."""
    n = len(block.text)
    node, links = block.node, block.link_chars / len(block.text)
    inside = node.content and not node.boiler and node.named <= 0
    return [1.0, float(node.content), float(node.boiler), float(max(-1, min(2, node.named))), min(n, 400) / 400, links if inside else 0.0, 0.0 if inside else links,
            float(bool(re.search(r"[.!?…]\W*$", block.text))), float(block.heading), float(node.tag == "li" and not inside and links > 0.6), float(bool(re.match(r"\s*(?:©|\(c\)|copyright\b)", block.text, re.I)))]


def logit(block: Block, weights: tuple[float, ...] = PRIOR) -> float:
    """How much more likely content than boilerplate."""
    return sum(w * x for w, x in zip(weights, features(block), strict=True))


_EXAMPLES = "host long, own long, article long, inside boolean, x array<float>"
FIXED = 1 << 30  # sums of the fit are whole multiples of its inverse, so that their order does not matter


def _examples(batches):
    """Blocks of pages, equal ones of a page once: hashes of the host, the text and the page's longest text, whether an article holds it, features."""
    for batch in batches:
        out = []
        for host, html in zip(batch["host"], batch["html"], strict=True):
            found = blocks(html or "")
            if found:
                where, article = _hash(host), _hash(max((b.text for b in found), key=len))
                out += dict.fromkeys((where, _hash(b.text), article, b.node.content and not b.node.boiler and b.node.named <= 0, tuple(features(b))) for b in found)
        yield pd.DataFrame(out, columns=["host", "own", "article", "inside", "x"])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def sums(x: np.ndarray, times: np.ndarray, w: np.ndarray, y: float) -> list[int]:
    """Gradient and upper half of the Hessian of a logistic regression at w, by FIXED, over rows of the label y."""
    p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
    a, b = np.triu_indices(x.shape[1])
    each = np.concatenate([x * (y - p)[:, None], x[:, a] * x[:, b] * (p * (1 - p))[:, None]], axis=1)
    return (np.rint(each * FIXED).astype(np.int64) * times[:, None]).sum(axis=0).tolist()


def newton(totals, n0: int, n1: int, evidence: float = 400.0, spread: float = 0.5) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method; totals(w) gives `sums` for the labels 0 and 1.

    The examples weigh as `evidence` ones, half of them of each label; the prior about PRIOR has the deviation `spread`.
    """
    prior = np.array(PRIOR)
    if not n0 or not n1:
        return PRIOR
    size = len(prior)
    a, b = np.triu_indices(size)
    w = prior.copy()
    for _ in range(30):
        by = sum(np.array(total, float) / FIXED * (evidence / 2 / n) for total, n in zip(totals(w), (n0, n1), strict=True))
        hessian = np.zeros((size, size))
        hessian[a, b] = hessian[b, a] = by[size:]
        step = np.linalg.solve(hessian + np.eye(size) / spread**2, by[:size] - (w - prior) / spread**2)
        w += step
        if np.abs(step).max() < 1e-6:  # the error after such a step is near its square, below what the sums resolve
            break
    return tuple(w.tolist())


def fit(x: np.ndarray, y: np.ndarray, evidence: float = 400.0, spread: float = 0.5) -> tuple[float, ...]:
    """The weights that `newton` gives for examples at hand."""
    once = np.ones(len(y), np.int64)
    return newton(lambda w: [sums(x[y == v], once[y == v], w, v) for v in (0, 1)], int((y == 0).sum()), int((y == 1).sum()), evidence, spread)


def _sum_rows(w: np.ndarray):
    """Sums over patterns, each as it is and once more without what the page says of itself."""
    def run(batches):
        for batch in batches:
            out = []
            for label, rows in batch.groupby("y"):
                x, times = np.array(rows["x"].tolist(), float), rows["times"].to_numpy(np.int64)
                masked = x.copy()
                masked[:, MASKED] = 0.0
                out.append((label, [p + q for p, q in zip(sums(x, times, w, label), sums(masked, times, w, label), strict=True)]))
            yield pd.DataFrame(out, columns=["y", "sums"])
    return run


def train(df: DataFrame, url: str = "url", html: str = "html", repeats: int = 3) -> tuple[float, ...]:
    """Weights learnt from the labelled blocks of all pages.

    Boilerplate: a text on pages of `repeats` or more different articles of one host; copies of an article count once.
    Content: a text inside an article on one page only. Each example is seen again without what the page's tags and
    names say. Pages that show none of either give the prior. Equal features are counted, and every step of the fit sums
    over the counts in tasks.
    """
    host = F.coalesce(F.regexp_extract(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    seen = written(df.select(host.alias("host"), F.col(html).alias("html")).mapInPandas(_examples, _EXAMPLES), "page-blocks")
    spread = seen.groupBy("host", "own").agg(F.count_distinct("article").alias("articles"))
    # texts a host repeats are few by host; both sides are hashed by host and text, so a hot host is spread
    label = F.when(F.col("articles") >= repeats, 0).when((F.col("articles") == 1) & F.col("inside"), 1)
    labelled = seen.join(spread, ["host", "own"]).select("own", "article", "x", label.alias("y")).where("y IS NOT NULL").distinct()
    patterns = written(labelled.groupBy("y", "x").agg(F.count("*").alias("times")), "page-patterns")
    per = {r["y"]: r["n"] for r in patterns.groupBy("y").agg(F.sum("times").alias("n")).collect()}
    size = len(PRIOR) + len(PRIOR) * (len(PRIOR) + 1) // 2

    def totals(w: np.ndarray) -> list[list[int]]:
        parts = patterns.mapInPandas(_sum_rows(w), "y int, sums array<long>")
        found = {r["y"]: list(r)[1:] for r in parts.groupBy("y").agg(*[F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(size)]).collect()}
        return [[int(v) for v in found[y]] for y in (0, 1)]

    return newton(totals, 2 * per.get(0, 0), 2 * per.get(1, 0))


def minimum_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; edges are undirected. Dinic's algorithm."""
    n = len(to_source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(head))
        head.append(b)
        room.append(there)
        graph[b].append(len(head))
        head.append(a)
        room.append(back)

    for i in range(n):
        through = min(to_source[i], to_sink[i])  # flows straight through the node
        if to_source[i] > through:
            add(s, i, to_source[i] - through, 0.0)
        if to_sink[i] > through:
            add(i, t, to_sink[i] - through, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[x] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[x] < len(graph[x]):
                e = graph[x][at[x]]
                if room[e] > 1e-9 and level[head[e]] == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(graph[x]):
                path.append(graph[x][at[x]])
                x = head[path[-1]]
            elif path:
                x = head[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR, adjacency: float = 0.5, proximity: float = 0.7) -> str:
    """The content blocks of a page, joined by a blank line."""
    found = blocks(html or "")
    if not found:
        return ""
    scores = [logit(b, weights) for b in found]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            p = found[i - 1].node
            same = p.content == b.node.content and p.boiler == b.node.boiler and p.named == b.node.named
            edges.append((i - 1, i, adjacency if same else adjacency / 10))
        if b.node.parent in last:  # the previous block of the same parent element
            edges.append((last[b.node.parent], i, proximity))
        last[b.node.parent] = i
    content = minimum_cut([max(0.0, x) for x in scores], [max(0.0, -x) for x in scores], edges)
    return "\n\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """key, url, text and n_chars (code points) of every page.

    Null, empty and contentless pages give an empty text; keys and urls are passed on, null ones too. Nothing is cut
    off. Repeated pages get equal results; an empty table gives an empty result; other columns are ignored. Without
    weights they are learnt from the pages themselves.
    """
    learnt = train(df, url, html) if weights is None else weights

    def main_texts(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, learnt) for h in page], dtype=object)

    found = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.pandas_udf(main_texts, "string")(F.col(html)).alias("text"))
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
