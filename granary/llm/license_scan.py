"""Licence scan with a positional index of rare licence words.

Each licence template is a short run of words with mandatory key phrases. Its
*anchors* are its words of highest IDF (document frequencies come from all
documents). Of a file, all words that are anchors are looked up in the index - its rarest
licence words and, as no number of them is fixed, the less rare too -, every posting votes
for (template, start = place in the file - place in the template), and starts that
gather enough votes are verified: at least `coverage` of the template's words stand
at their places and every key phrase occurs there. A template of n words has
floor((1-coverage) n) + 3 anchors, so a start that passes has at least the votes
asked for: the candidate step loses nothing.

Defined results: one row per (doc_id, licence) at the best start (highest coverage,
then least start). Null, empty or wordless texts give no row, nor do rows without an
id; repeated rows give repeated results; extra columns are ignored; texts are scanned
to their end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, read, texts
from granary.llm.licenses import TEMPLATES

def _words(text: str) -> np.ndarray:
    return K.words(pa.array([text]), "punct", lower=True)[0]


class Index:
    """Postings of the anchors of all templates, sorted by word hash."""

    def __init__(self, templates, coverage: float, idf: dict[int, float]):
        self.names = [t[0] for t in templates]
        self.words = [_words(t[1]) for t in templates]
        self.phrases = [[_words(p) for p in t[2]] for t in templates]
        self.coverage = coverage
        post, self.need = [], []
        for t, w in enumerate(self.words):
            miss = math.floor((1 - coverage) * len(w) + 1e-9)
            order = sorted(range(len(w)), key=lambda q: (-idf.get(int(w[q]), 0.0), q))[: miss + 3]
            self.need.append(len(order) - miss)
            post += [(int(w[q]), t, q) for q in order]
        post.sort()
        self.key = np.array([p[0] for p in post], np.uint64)
        self.template = np.array([p[1] for p in post], np.int64)
        self.place = np.array([p[2] for p in post], np.int64)
        self.need = np.array(self.need, np.int64)

    def verify(self, doc: np.ndarray, t: int, start: int) -> float | None:
        w = self.words[t]
        lo, hi = max(start, 0), min(start + len(w), len(doc))
        share = float((doc[lo:hi] == w[lo - start : hi - start]).sum()) / len(w) if hi > lo else 0.0
        if share < self.coverage - 1e-9:
            return None
        near = doc[max(0, start - 2) : start + len(w) + 2]
        for p in self.phrases[t]:
            m = len(near) - len(p) + 1
            if m <= 0 or not np.logical_and.reduce([near[i : i + m] == p[i] for i in range(len(p))]).any():
                return None
        return share


def candidates(index: Index, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, template, start) with enough votes."""
    lo, hi = np.searchsorted(index.key, h, "left"), np.searchsorted(index.key, h, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    times = (hi - lo)[hit]
    token = np.repeat(hit, times)
    post = np.repeat(lo[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc = np.searchsorted(at, token, "right") - 1
    start = token - at[doc] - index.place[post] + 1000  # never below zero: templates are shorter
    both = np.stack([doc, index.template[post], start])
    order = np.lexsort(both[::-1])
    both = both[:, order]
    r = np.append(np.flatnonzero(np.append(True, (both[:, 1:] != both[:, :-1]).any(0))), both.shape[1])
    first, votes = r[:-1], np.diff(r)
    ok = votes >= index.need[both[1, first]]
    return [(int(d), int(t), int(s) - 1000) for d, t, s in both[:, first[ok]].T]


def scan(docs: DataFrame, templates=None, coverage: float = 0.7) -> DataFrame:
    """(doc_id, license, start_word, coverage) for every licence found."""
    templates = templates or TEMPLATES
    base = texts(docs)
    vocabulary = np.unique(np.concatenate([_words(t[1]) for t in templates]))
    schema = pa.schema([("word", pa.int32()), ("df", pa.int64())])

    def count(batches):
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for b in K.batches_by_bytes(batches, "text"):
            h, at = K.words(b.column("text"), "punct", lower=True)
            i = np.searchsorted(vocabulary, h)
            i[i == len(vocabulary)] = 0
            hit = np.flatnonzero(vocabulary[i] == h)
            pair = np.unique((np.searchsorted(at, hit, "right") - 1) * len(vocabulary) + i[hit])
            df += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
            n += b.num_rows
        yield batch_of(schema, np.arange(-1, len(vocabulary)), np.append(n, df))

    df = {r["word"]: r["df"] for r in base.mapInArrow(count, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    n = df.get(-1, 0)
    index = Index(templates, coverage, {int(w): math.log((n + 1) / (df.get(i, 0) + 1)) for i, w in enumerate(vocabulary)})
    out = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int32()), ("coverage", pa.float64())])

    def find(batches):
        for b in K.batches_by_bytes(batches, "text"):
            h, at = K.words(b.column("text"), "punct", lower=True)
            best: dict[tuple[int, str], tuple[float, int]] = {}
            for d, t, s in candidates(index, h, at):
                share = index.verify(h[at[d] : at[d + 1]], t, s)
                key = (d, index.names[t])
                if share is not None and (-share, s) < best.get(key, (1.0, 0)):
                    best[key] = (-share, s)
            if best:
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                rows = sorted(best.items())
                yield batch_of(out, [int(ids[d]) for (d, _), _ in rows], [name for (_, name), _ in rows], [v[1] for _, v in rows], [round(-v[0], 6) for _, v in rows])

    return base.mapInArrow(find, "doc_id long, license string, start_word int, coverage double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
