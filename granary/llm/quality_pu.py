"""Quality classifier learnt from positive and unlabelled documents only.

A small network is fitted by minimising the non-negative unbiased PU risk: trusted
positives (rated good and not toxic), unlabelled web text, and a class prior that
is estimated from the two (the least ratio of unlabelled to positive mass over
top score bins). Scoring is one map over all documents, with no shuffle.

The fit sees a bounded sample of each kind (`n_positive`, `n_unlabelled`: the rows
with the smallest hashes of doc_id, under another seed for each kind); half of it makes
the word table, half the network. Where a half has fewer than `LEAST` rows of a kind, all
rows make both.

Defined results: a text that is null or has no word is rejected with score 0. A null
doc_id is scored like any other. Repeated rows are scored each; in the sample, rows that
share an id are one, of the greatest text. Extra columns are passed on by `keep_good` and
ignored by `quality_scores`. With fewer than `LEAST` trusted positives or unlabelled
documents in all there is too little to learn from, and every text with a word is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, read, texts
from granary.plans.lineage import table

BUCKETS = 1 << 18
_CLASS = np.full(256, 5, np.int8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 plain punctuation, 5 symbol, 6 beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
N_DENSE = 16
LEAST = 8


@dataclass
class Model:
    odds: np.ndarray  # log odds of each word bucket
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        g = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.float64)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def features(column, odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense features of each text, its number of words, and (word bucket, word offsets)."""
    raw, off = K.flat(column)
    s, e, at = K.spans(raw, off, "punct")
    h = K.hashes(raw, s, e, "punct", lower=True)
    n, size = np.diff(at).astype(float), np.diff(off).astype(float)
    one, per = np.maximum(n, 1), np.maximum(size, 1)
    kind = _CLASS.take(raw)
    share = [_sums(kind == k, off) / per for k in range(7)]
    doc = np.repeat(np.arange(len(n)), np.diff(at))
    key = K.mix(h ^ K.mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    fresh = np.zeros(len(h), bool)
    fresh[order[K.runs(key[order])[:-1]]] = True
    distinct = _sums(fresh, at)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = _sums(raw == 10, off)
    bucket = (h >> np.uint64(46)).astype(np.int64)
    x = np.zeros((len(n), N_DENSE))
    x[:, 0] = np.log1p(n)
    x[:, 1] = _sums(e - s, at) / one
    x[:, 2:9] = np.array(share).T
    x[:, 9] = distinct / np.sqrt(one)
    x[:, 10] = _sums(again, at) / one
    x[:, 11] = np.log1p(lines) - np.log1p(n)
    x[:, 12] = share[2] / np.maximum(share[1] + share[2], 1e-9)
    if odds is not None and len(h):
        v = odds.take(bucket)
        x[:, 13] = _sums(v, at) / one
        low = np.minimum(v, 0)
        x[:, 14] = np.minimum.reduceat(np.append(low, 0), at[:-1]) * (n > 0)
        x[:, 15] = _sums(np.where(fresh & (v < -1), v, 0), at)
    return x, n, bucket[fresh], np.append(0, np.cumsum(distinct)).astype(np.int64)


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, epochs: int, hidden: int = 24):
    """The network, fitted with Adam on batches; `prior` None fits plain positive against unlabelled."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    size = 256
    steps = max(1, max(len(p), len(u)) // size)

    def grad(x, coef):
        a = np.tanh(x @ w[0] + w[1])
        back = (coef[:, None] * w[2]) * (1 - a * a)
        return [x.T @ back, back.sum(0), a.T @ coef, np.array([coef.sum()])]

    def out(x):
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3], -30, 30)))

    for _ in range(epochs * steps):
        bp, bu = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
        sp, su = out(bp), out(bu)  # sigmoid loss: loss(+)=1-s, loss(-)=s
        dp, du = sp * (1 - sp), su * (1 - su)
        if prior is None:
            gp, gu = -dp / size, du / size
        else:
            negative = su.mean() - prior * sp.mean()
            if negative >= 0:
                gp, gu = (-prior - prior) * dp / size, du / size
            else:  # the negative part went below zero: step back on it alone
                gp, gu = prior * dp / size, -du / size
        t += 1
        for k, g in enumerate(a + b + 1e-4 * c for a, b, c in zip(grad(bp, gp), grad(bu, gu), w, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, out


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Share of positives among the unlabelled: least of (share of U above a score + margin) / share of P above it."""
    best, margin = 1.0, np.sqrt(np.log(20) / 2)
    for q in np.linspace(0.05, 0.95, 37):
        c = np.quantile(sp, q)
        up, uu = (sp >= c).mean(), (su >= c).mean()
        if up > 0.04:
            slack = margin * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
            best = min(best, uu / up + slack * 0.5)
    return float(min(max(best, 0.05), 0.98))


def fit(docs: DataFrame, labels: DataFrame, n_positive: int = 8000, n_unlabelled: int = 8000, epochs: int = 40, seed: int = 5) -> Model | None:
    spark = docs.sparkSession
    base = texts(docs)
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rank = lambda k: F.xxhash64("doc_id", F.lit(seed), F.lit(k))
    positive = good.join(base.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(rank(1), "doc_id").limit(n_positive)
    unlabelled = base.select("doc_id").distinct().orderBy(rank(0), "doc_id").limit(n_unlabelled)
    ids = positive.withColumn("kind", F.lit(1)).unionByName(unlabelled.withColumn("kind", F.lit(0)))
    # at most n_positive + n_unlabelled ids, so a broadcast of bounded size
    drawn = base.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "kind").agg(F.max("text").alias("text"))
    sample = table(drawn.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2))), "pu-sample")

    count_schema = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("u", pa.int32())])

    def count(batches):
        both = np.zeros((2, BUCKETS), np.int32)
        for b in K.batches_by_bytes(batches, "text"):
            kind = b.column("kind").to_numpy(zero_copy_only=False)
            _, _, bucket, at = features(b.column("text"), None)
            of = np.repeat(kind, np.diff(at))
            for k in (0, 1):
                both[k] += np.bincount(bucket[of == k], minlength=BUCKETS).astype(np.int32)
        seen = np.flatnonzero(both.sum(0))
        yield batch_of(count_schema, seen, both[1, seen], both[0, seen])

    halves = {r["half"]: (r["p"], r["u"]) for r in sample.groupBy("half").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u")).collect()}
    whole = [sum(halves.get(k, (0, 0))[i] for k in (0, 1)) for i in (0, 1)]
    if min(whole) < LEAST:
        return None
    first, second = "half = 0", "half = 1"
    if any(min(halves.get(k, (0, 0))) < LEAST for k in (0, 1)):
        first, second = "true", "true"
    n1, n0 = halves[0] if first == "half = 0" else whole
    odds = np.zeros(BUCKETS)
    for r in sample.where(first).select("text", "kind").mapInArrow(count, "bucket int, p int, u int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toLocalIterator():
        odds[r["bucket"]] = np.log((r["p"] / n1 + 4 / n1) / (r["u"] / n0 + 4 / n0))

    x, kind = [], []
    shared = spark.sparkContext.broadcast(odds)  # BUCKETS numbers, whatever the data

    def dense(batches):
        for b in K.batches_by_bytes(batches, "text"):
            f, n, _, _ = features(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), b.column("kind").cast(pa.int32())], names=["x", "kind"])

    for r in sample.where(second).select("text", "kind").mapInArrow(dense, "x array<double>, kind int").toLocalIterator():
        x.append(r["x"])
        kind.append(r["kind"])
    x, kind = np.array(x), np.array(kind)
    order = np.lexsort(x.T)
    x, kind = x[order], kind[order]  # whatever the partitions, the same fit
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    p, u = z[kind == 1], z[kind == 0]
    _, out = _train(p, u, None, seed, max(4, epochs // 4))
    prior = estimate_prior(out(p), out(u))
    w, _ = _train(p, u, prior, seed + 1, epochs)
    return Model(odds, mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def _scores(model, column) -> np.ndarray:
    x, n, _, _ = features(column, model.value.odds if model is not None else None)
    return np.where(n > 0, model.value.score(x) if model is not None else 1.0, 0.0)


def _share(docs: DataFrame, model: Model | None):
    return docs.sparkSession.sparkContext.broadcast(model) if model is not None else None


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None, **how) -> DataFrame:
    """(doc_id, quality_score, kept) of every row of docs."""
    shared = _share(docs, model or fit(docs, labels, **how))
    schema = pa.schema([("doc_id", pa.int64()), ("quality_score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for b in K.batches_by_bytes(batches, "text"):
            s = _scores(shared, b.column("text"))
            yield batch_of(schema, b.column("doc_id"), np.round(s, 6), s >= 0.5)

    return texts(docs, nulls=True).mapInArrow(run, "doc_id long, quality_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    shared = _share(docs, model or fit(docs, labels, **how))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            named = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
            for part in K.batches_by_bytes([named], f"c{at}"):
                keep = _scores(shared, part.column(at)) >= 0.5
                yield part.filter(pa.array(keep)).rename_columns(b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, each with its score."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).where("kept").select("doc_id", "quality_score")
