"""Main-text extraction from web pages by gradient-boosted trees over DOM nodes.

Every element gets features: subtree text density and link density, depth, place
among its siblings and their make-up, share of the page's text, and what its
class/id tokens and position say. Boosted trees give the probability that the node
is main content; a dynamic programme over the tree then labels whole subtrees kept
or dropped, or lets the children decide, so that no ancestor and descendant
contradict each other.

The trees are trained on a bounded sample of pages (`n_pages`, least hashes of
page_id) whose nodes are labelled by semantic HTML: what lies in article or main is
content, what lies beside them is not, nor are nav, header, footer, aside and forms. The names
of those elements are hidden from the features, so the trees also judge pages without.

Defined results: one row per page with an id; null, empty and tagless html give the
empty string or the plain text; unclosed and stray tags are tolerated; repeated rows
are extracted each; extra columns are ignored. With no labelled node in the sample
all text outside scripts and styles is kept.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, read

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("p div ul ol li table section article aside header footer nav h1 h2 h3 h4 h5 h6 blockquote pre form main".split())
BLOCK = CLOSES_P | frozenset("body html td th tr dd dt figure figcaption title br".split())
CONTENT, BOILER = frozenset(("article", "main")), frozenset(("head", "title", "nav", "header", "footer", "aside", "form", "button"))
_KIND = {t: k + 1 for k, ts in enumerate((("p", "blockquote", "pre"), ("div", "section", "body", "html"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "table"), ("li", "td", "th", "tr", "dd", "dt"), ("a",), ("b", "i", "em", "strong", "span"))) for t in ts}
N_ATTR = 256
N_FEATURES = 20


class Page:
    """Flat DOM: parents come before children; texts are (node, text) in order."""

    __slots__ = ("attrs", "last", "parent", "tag", "texts")

    def __init__(self, html: str):
        self.parent, self.tag, self.attrs, self.texts = [-1], ["#root"], [""], []
        self.last = [0]
        stack, depth = [0], Counter()  # open elements, and how many of each name
        for m in _TOKEN.finditer(html):
            token = m.group(0)
            if token[0] != "<" or len(token) == 1:
                if stack[-1] == 0 and token.isspace():
                    continue
                self.texts.append((stack[-1], token))
            elif m.group(3):
                tag = m.group(3).lower()
                if m.group(2):
                    if not depth[tag]:
                        continue
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            for n in stack[k:]:
                                self.last[n] = len(self.tag)
                                depth[self.tag[n]] -= 1
                            del stack[k:]
                            break
                else:
                    while tag in CLOSES_P and len(stack) > 1 and self.tag[stack[-1]] in ("p", "b", "i", "a", "span", "em", "strong") and depth["p"]:
                        depth[self.tag[stack[-1]]] -= 1
                        self.last[stack.pop()] = len(self.tag)
                    node = len(self.tag)
                    self.parent.append(stack[-1])
                    self.tag.append(tag)
                    rest = m.group(4)
                    self.attrs.append(" ".join(next(filter(None, a), "") for a in _ATTR.findall(rest)).lower() if "=" in rest else "")
                    self.last.append(node + 1)
                    if tag not in VOID and not rest.endswith("/"):
                        stack.append(node)
                        depth[tag] += 1
        for n in stack:
            self.last[n] = len(self.tag)

    def labels(self) -> np.ndarray:
        """1 content, 0 boilerplate, -1 unknown or mixed.

        Where a page has a content element, all that is neither in it nor around it is
        boilerplate; elsewhere only what stands in elements of that kind is.
        """
        y = np.full(len(self.tag), -1)
        around = np.zeros(len(self.tag), bool)
        for n in range(1, len(self.tag)):
            t = self.tag[n]
            y[n] = 0 if t in BOILER else 1 if t in CONTENT else y[self.parent[n]]
            if t in CONTENT:
                up = self.parent[n]
                while up >= 0 and not around[up]:
                    around[up] = True
                    up = self.parent[up]
        if around.any():
            y[1:][(y[1:] < 0) & ~around[1:]] = 0
        return y


def _attr_slots(attrs: str) -> list[int]:
    return [hash_token(t) for t in re.split(r"[^a-z0-9]+", attrs) if t] if attrs else []


def hash_token(t: str) -> int:
    x = 2166136261
    for c in t.encode():
        x = ((x ^ c) * 16777619) & 0xFFFFFFFF
    return x % N_ATTR


def node_features(pages: list[Page], attr_odds: np.ndarray) -> np.ndarray:
    """Features of all nodes of the pages, one page after the other."""
    odds = attr_odds.tolist()
    size = [len(p.tag) for p in pages]
    base = np.cumsum([0, *size])
    n = int(base[-1])
    parent, last, depth, place, inside, attr, kind, node, text = [], [], [], [], [], [], [], [], []
    for p, b in zip(pages, base.tolist(), strict=False):
        d, q, a, v, seen = [0], [0], [False], [0.0], {}
        for i in range(1, len(p.tag)):
            up = p.parent[i]
            d.append(d[up] + 1)
            k = seen.get(up, 0)
            seen[up] = k + 1
            q.append(k)
            a.append(a[up] or p.tag[i] == "a")
            best = 0.0
            if p.attrs[i]:
                for slot in _attr_slots(p.attrs[i]):
                    if abs(odds[slot]) > abs(best):
                        best = odds[slot]
            v.append(best or v[up])
        parent += [b, *(x + b for x in p.parent[1:])]
        last += [x + b for x in p.last]
        depth += d
        place += q
        inside += a
        attr += v
        kind += [_KIND.get(t, 0) + 100 * (t in ("td", "li", "option")) for t in p.tag]
        for i, t in p.texts:
            node.append(i + b)
            text.append((len(t), t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?"), t.count("|") + t.count("&")))
    parent, last, place, kind = np.array(parent), np.array(last), np.array(place, float), np.array(kind)
    own = np.zeros((n, 4))
    if node:
        for j, col in enumerate(np.array(text, float).T):
            own[:, j] = np.bincount(node, col, n)
    item, kind = kind >= 100, kind % 100
    table = np.column_stack([own, own[:, 0] * np.array(inside), kind == 6, kind == 1, item, np.ones(n)])
    total = np.zeros((n + 1, table.shape[1]))
    np.cumsum(table, axis=0, out=total[1:])
    sub = total[last] - total[:-1]
    root = np.repeat(base[:-1], size)
    is_root = np.zeros(n, bool)
    is_root[base[:-1]] = True
    kids = np.bincount(parent[~is_root], minlength=n).astype(float)
    siblings = np.where(is_root, 1, kids[parent])
    chars, tags = sub[:, 0], sub[:, 8]
    one, page = np.maximum(chars, 1), np.maximum(chars[root], 1)
    sib_chars = np.maximum(chars[parent] - chars, 0) / np.maximum(siblings - 1, 1)
    x = np.zeros((n, N_FEATURES))
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(chars), np.log1p(tags), np.log1p(chars / tags)
    x[:, 3], x[:, 4] = sub[:, 4] / one, sub[:, 2] / np.maximum(sub[:, 1], 1)
    x[:, 5], x[:, 6] = chars / page, depth
    x[:, 7], x[:, 8], x[:, 9] = place, siblings, place / np.maximum(siblings - 1, 1)
    x[:, 10], x[:, 11] = np.log1p(sib_chars), np.log1p(own[:, 0])
    x[:, 12], x[:, 13], x[:, 14] = sub[:, 5] / tags, sub[:, 6] / tags, sub[:, 7] / tags
    x[:, 15] = chars / np.maximum(sub[:, 1], 1)
    x[:, 16], x[:, 17] = kind, attr
    x[:, 18] = sub[parent, 4] / np.maximum(sub[parent, 0], 1)
    x[:, 19] = (total[:-1, 0] - total[root, 0]) / page
    return x


class Trees:
    """Boosted depth-limited trees on histograms, for the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins, self.trees, self.base = rounds, depth, rate, bins, [], 0.0
        self.edges: list[np.ndarray] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b, n = self._bin(x), len(y)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(n, self.base)
        width = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(n, np.int64)
            splits = np.zeros((2 * width, 2), np.int64)
            splits[:, 1] = self.bins + 1  # everything left
            for level in range(self.depth):
                slots = 1 << level
                best = np.full(slots, 1e-6)
                for j in range(x.shape[1]):
                    key = leaf * self.bins + b[:, j]
                    sg = np.bincount(key, g, slots * self.bins).reshape(slots, -1).cumsum(1)
                    sh = np.bincount(key, h, slots * self.bins).reshape(slots, -1).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < 1) | (th - sh < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(slots), at]
                    for s in np.flatnonzero(top > best + 1e-9):
                        best[s] = top[s]
                        splits[slots + s] = (j, at[s])
                own = splits[slots + leaf]
                leaf = 2 * leaf + (b[np.arange(n), own[:, 0]] > own[:, 1])
            value = self.rate * np.bincount(leaf, g, width) / (np.bincount(leaf, h, width) + 1)
            self.trees.append((splits, value))
            f += value[leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, f, every = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = splits[(1 << level) + leaf]
                leaf = 2 * leaf + (b[every, own[:, 0]] > own[:, 1])
            f += value[leaf]
        return f


def decode(parent: list[int], logit: np.ndarray, weight: np.ndarray, switch: float = 2.0) -> np.ndarray:
    """Per node 1 kept or 0 dropped, such that whole subtrees agree unless their root is left to its children (-1)."""
    n = len(parent)
    z = np.clip(logit, -8, 8)
    keep, drop = (-np.log1p(np.exp(-z)) * weight).tolist(), (-np.log1p(np.exp(z)) * weight).tolist()
    mixed, kids = [-switch] * n, [False] * n
    for i in range(n - 1, 0, -1):
        q, k, d = parent[i], keep[i], drop[i]
        keep[q] += k
        drop[q] += d
        best = k if k > d else d
        mixed[q] += mixed[i] if kids[i] and mixed[i] > best else best
        kids[q] = True
    state = [0] * n
    for i in range(n):
        up = state[parent[i]] if i else -1
        state[i] = up if up >= 0 else -1 if kids[i] and mixed[i] > keep[i] and mixed[i] > drop[i] else int(keep[i] >= drop[i])
    return np.array(state)


def _text(p: Page, keep: list[bool]) -> str:
    out: list[str] = []
    block = [0] * len(p.tag)
    for n in range(1, len(p.tag)):
        block[n] = n if p.tag[n] in BLOCK else block[p.parent[n]]
    last = None
    for node, t in p.texts:
        if keep[node] and (t := _SPACE.sub(" ", _html.unescape(t) if "&" in t else t)).strip():
            if out and block[node] != last:
                out.append("\n")
            out.append(t)
            last = block[node]
    return "\n".join(filter(None, (x.strip() for x in "".join(out).split("\n"))))


class Model:
    def __init__(self, pages: list[str], trees: Trees | None = None):
        self.odds, parsed = np.zeros(N_ATTR), [Page(h) for h in pages]
        seen = np.zeros((2, N_ATTR))
        for p in parsed:
            y = p.labels()
            for n in range(1, len(p.tag)):
                if y[n] >= 0:
                    for s in _attr_slots(p.attrs[n]):
                        seen[y[n], s] += 1
        used = seen.sum(0) > 4
        self.odds[used] = np.log((seen[1, used] + 1) / (seen[0, used] + 1))
        y = np.concatenate([p.labels() for p in parsed]) if parsed else np.zeros(0, int)
        ok = y >= 0
        x = node_features(parsed, self.odds)[ok] if parsed else np.zeros((0, N_FEATURES))
        self.trees = (trees or Trees()).fit(x, y[ok].astype(float)) if ok.any() and 0 < y[ok].mean() < 1 else None

    def states(self, p: Page, logit: np.ndarray) -> np.ndarray:
        chars = np.zeros(len(p.tag))
        for node, t in p.texts:
            chars[node] += len(t)
        state = decode(p.parent, logit, 0.2 + np.sqrt(chars))
        return np.where(state >= 0, state, logit > 0) > 0

    def extract(self, htmls: list[str | None]) -> list[str]:
        pages = [Page(h or "") for h in htmls]
        if self.trees is None:
            return [_text(p, [True] * len(p.tag)) for p in pages]
        if not pages:
            return []
        logit = self.trees.logit(node_features(pages, self.odds))
        at, out = 0, []
        for p in pages:
            mine = logit[at : at + len(p.tag)]
            at += len(p.tag)
            out.append(_text(p, [True] if len(p.tag) == 1 else self.states(p, mine).tolist()))
        return out


def fit(pages: DataFrame, n_pages: int = 500, seed: int = 11) -> Model:
    ids = pages.where("page_id is not null and html is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(n_pages)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.max("html").alias("html")).collect()  # n_pages pages at most
    return Model(sorted({r["html"] for r in rows}))


def extract(pages: DataFrame, model: Model | None = None, n_pages: int = 500) -> DataFrame:
    """(page_id, main_text) of every page."""
    model = model or fit(pages, n_pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # trees of fixed number and depth
    schema = pa.schema([("page_id", pa.int64()), ("main_text", pa.string())])

    def run(batches):
        for b in K.batches_by_bytes(batches, "html", 4 << 20):
            yield batch_of(schema, b.column("page_id"), shared.value.extract(b.column("html").to_pylist()))

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    return base.mapInArrow(run, "page_id long, main_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
