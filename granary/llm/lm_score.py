"""Language-model scoring: stupid backoff over n-gram count tables of the corpus itself.

Counts of all word n-grams up to `order` are added up over all documents, partitioned
by the hash of the n-gram. The documents' exploded n-grams are joined to them (each
chunk of documents asks for its distinct n-grams once and gets their totals back) and
log scores are summed per document:

    S(w | context) = c(context w) / c(context)             if c(context w) >= min_count
                     backoff * S(w | shorter context)      otherwise
    S(w)           = c(w) / N

The first words of a document have the shorter context that there is. N-grams of two
words or more that occur under `min_count` times count as unseen, which is what makes a
corpus scored by its own counts back off.

Defined results: one row per row of documents with an id: the number of words, the
number of them scored by the full order, and the mean natural log score (null where a
text is null or has no word). N-grams are told apart by 64-bit hashes. Rows without an id are left out; repeated rows count
each, in the counts too; extra columns are ignored. Words are split at ASCII white
space; case is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, chunks, opened, partitions, read, totals_of, with_totals
from granary.plans.lineage import table

CHUNK = 12 << 20  # bytes of text whose n-grams are counted together before they are sent


def _grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the n-grams that lie within a text, and their hashes."""
    g = K.grams(h, n)
    first = np.flatnonzero(K.within(at, n)[: len(g)])
    return first, g[first]


def score_words(h: np.ndarray, at: np.ndarray, totals: list[np.ndarray], order: int, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: log score but for -log N, whether that is missing, whether the full order was used."""
    count = []  # by order: total of the n-gram that ends at the word, 0 without
    for n in range(1, order + 1):
        first, g = _grams(h, at, n)
        _, back = np.unique(g, return_inverse=True)
        c = np.zeros(len(h), np.float64)
        c[first + n - 1] = totals[n - 1][back]
        count.append(c)
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    level = np.minimum(place, order - 1)  # words of context to start with
    score, done, penalty = np.zeros(len(h)), np.zeros(len(h), bool), math.log(backoff)
    full = np.zeros(len(h), bool)
    for n in range(order, 1, -1):
        hit = np.flatnonzero(~done & (level >= n - 1) & (count[n - 1] >= min_count))
        # the context is the (n-1)-gram that ends one word earlier
        score[hit] = np.log(count[n - 1][hit]) - np.log(count[n - 2][hit - 1]) + (level[hit] - (n - 1)) * penalty
        done[hit] = True
        if n == order:
            full[hit] = True
    rest = np.flatnonzero(~done)
    score[rest] = np.log(count[0][rest]) + level[rest] * penalty
    return score, ~done, full


def stupid_backoff(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, words, full_order_words, score)."""
    n = partitions(docs.sparkSession)
    pieces = chunks(docs, CHUNK)

    def keys(batch):
        h, at = K.words(batch.column("text"))
        return [np.unique(_grams(h, at, k)[1], return_counts=True) for k in range(1, order + 1)]

    out = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("full_order_words", pa.int64()), ("part_score", pa.float64()), ("unigrams", pa.int64())])

    def score(batches):
        for b in batches:
            for blob, replies in zip(b.column("blob"), b.column("replies"), strict=True):
                batch = opened(blob.as_py())
                h, at = K.words(batch.column("text"))
                s, plain, full = score_words(h, at, totals_of(replies.as_py(), order), order, backoff, min_count)
                doc, m = np.repeat(np.arange(batch.num_rows), np.diff(at)), batch.num_rows
                by = lambda w: np.bincount(doc, w, m)
                yield batch_of(out, batch.column("doc_id"), np.diff(at), by(full).astype(np.int64), by(s), by(plain).astype(np.int64))

    parts = table(with_totals(pieces, keys, n).mapInArrow(score, "doc_id long, words long, full_order_words long, part_score double, unigrams long"), "lm-parts")
    size = parts.agg(F.sum("words").alias("total"))  # one row
    return parts.crossJoin(F.broadcast(size)).select("doc_id", "words", "full_order_words", F.when(F.col("words") > 0, F.round((F.col("part_score") - F.col("unigrams") * F.log("total")) / F.col("words"), 4)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM l),
g AS (SELECT doc_id, pos, w, lag(w, 1) OVER d AS b, lag(w, 2) OVER d AS a FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT b, w, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, w),
c3 AS (SELECT a, b, w, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, w),
t AS (SELECT count(*) AS n FROM w),
s AS (SELECT g.doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n) - ln(c2p.n)
    WHEN c2.n >= 2 THEN ln(c2.n) - ln(c1p.n) + CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(c1.n) - ln(t.n) + CASE WHEN g.b IS NULL THEN 0 WHEN g.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s,
    CASE WHEN c3.n >= 2 THEN 1 ELSE 0 END AS f
  FROM g CROSS JOIN t JOIN c1 ON c1.w = g.w
  LEFT JOIN c1 AS c1p ON c1p.w = g.b
  LEFT JOIN c2 ON c2.b = g.b AND c2.w = g.w
  LEFT JOIN c2 AS c2p ON c2p.b = g.a AND c2p.w = g.b
  LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.w = g.w)
SELECT l.doc_id, len(l.ws)::BIGINT AS words, coalesce(sum(s.f), 0)::BIGINT AS full_order_words, round(sum(s.s) / len(l.ws), 4) AS score
FROM l LEFT JOIN s USING (doc_id) GROUP BY l.doc_id, len(l.ws)
"""
