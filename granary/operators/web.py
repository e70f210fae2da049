"""Pages: main text by selectors, links within the host, and a crawl over stored pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.lineage import table

DROPPED = frozenset("aside footer form header iframe nav noscript script style".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: (kind, name) of the places that hold the text, best first.
PLACES = [("tag", "article"), ("tag", "main"), ("class", "content"), ("class", "article-body"), ("class", "post-content"), ("id", "content"), ("class", "entry-content")]


class _Reader(HTMLParser):
    """Texts, each with the places and the body it is in, and links in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[int, ...], bool]] = []
        self.count = [0] * len(PLACES)
        self.texts: list[tuple[frozenset, str]] = []
        self.links: list[str] = []
        self.body = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href") is not None:
            self.links.append(a["href"])
        dropped = tag in DROPPED or (bool(self.stack) and self.stack[-1][2])
        mine = []
        if not dropped:
            classes = (a.get("class") or "").split()
            for k, (kind, name) in enumerate(PLACES):
                if (kind == "tag" and tag == name) or (kind == "class" and name in classes) or (kind == "id" and a.get("id") == name):
                    self.count[k] += 1
                    if self.count[k] == 1:  # only the first of a kind is the place
                        mine.append(k)
        if tag == "body":
            self.body = True
            mine.append(-1)
        if tag not in _EMPTY:
            up = self.stack[-1][1] if self.stack else ()
            self.stack.append((tag, (*up, *mine), dropped))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]) and (t := data.strip()):
            self.texts.append((frozenset(self.stack[-1][1]) if self.stack else frozenset(), t))


def read_page(html: str | None) -> tuple[str | None, list[str]]:
    """(main text or null, hrefs): texts of the best place that is there, else of the body, a line each."""
    if not html:
        return None, []
    r = _Reader()
    r.feed(html)
    r.close()
    place = next((k for k, n in enumerate(r.count) if n), -1)
    if place == -1 and not r.body and not r.texts:
        return None, r.links
    inside = [t for at, t in r.texts if place in at or (place == -1 and not r.body)]
    return "\n".join(inside), r.links


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, main_text); null for a page without any, one row for each row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "main_text": [read_page(h)[0] for h in b[html]]})

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, main_text string")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, place, link): links to the same host and port that aren't skipped, in order and with repeats."""

    def run(batches):
        for b in batches:
            rows = []
            for u, h in zip(b[url], b[html], strict=True):
                if not isinstance(u, str):
                    continue
                host = urlparse(u).netloc
                for k, href in enumerate(read_page(h)[1]):
                    try:
                        full = urljoin(u, href)
                        if urlparse(full).netloc == host:
                            rows.append((u, k, full))
                    except ValueError:  # no address at all
                        continue
            yield pd.DataFrame(rows, columns=[url, "place", "link"]).astype({"place": "int32"})

    return pages.select(url, html).mapInPandas(run, f"`{url}` string, place int, link string").where(~T.skipped_url(F.col("link")))


def page_links(pages: DataFrame, most: int = 10, url: str = "url", html: str = "html") -> DataFrame:
    """The first `most` links of each page."""
    w = Window.partitionBy(url).orderBy("place")
    return links(pages, url, html).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, most_links: int = 10, url: str = "url", html: str = "html") -> DataFrame:
    """(url, depth) of the stored pages reached from the seeds, level by level, no page twice.

    A level is a join of its pages' links with all pages and an anti-join with what was
    visited, each a written table. Pages that aren't stored are visited and lead nowhere.
    """
    edges = table(page_links(pages, most_links, url, html).select(F.col(url).alias("from"), F.col("link").alias("to")).distinct(), "crawl-links")
    front = table(seeds.select(F.col(url).alias("u")).distinct().withColumn("depth", F.lit(0)), "crawl-front")
    seen = front
    for depth in range(1, max_depth + 1):
        nxt = edges.join(front.withColumnRenamed("u", "from"), "from", "left_semi").select(F.col("to").alias("u")).distinct().join(seen, "u", "left_anti")
        front = table(nxt.withColumn("depth", F.lit(depth)), "crawl-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(pages.select(F.col(url).alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("url"), "depth")


def crawled_documents(pages: DataFrame, min_words: int = 50, lang: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(url, text, word_count, raw_content_sha256, source) of pages with enough words in their main text."""
    text = main_text(pages, url, html).withColumnRenamed("main_text", "text").where("text is not null")
    if lang is not None and "lang" in pages.columns:
        text = text.join(pages.select(url, "lang").distinct(), url).where(F.coalesce(F.col("lang") == lang, F.lit(True))).drop("lang")
    n = T.word_count(F.col("text"))
    return text.where(n >= min_words).select(F.col(url).alias("url"), "text", n.alias("word_count"), T.content_sha256(F.col("text")).alias("raw_content_sha256"), F.regexp_extract(url, r"\A[^:/?#]+://([^/?#]*)", 1).alias("source"))
