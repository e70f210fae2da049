"""Exact top-k search by exhaustive accumulation over blocks of documents.

Queries and documents are sparse BM25 rows, tokenised once and written as blocks of about
a thousand rows that use alike words. Every block of documents meets every chunk of
queries, and all products of shared terms are accumulated in single precision: those of
terms that are common in both as a product of two dense strips, the others posting by
posting. No product is negative, so the error is a known share of the sum. Pairs that
could, within it, score no less than what k documents are known to reach wait until the
task has met more blocks; those that still could are scored again from their own terms in
double precision and selected. Nothing is skipped, so the result is the one of brute force.

What k documents reach is first found over a sample of the blocks, then it is what a task
has found itself; both only decide how many pairs are scored twice, never which are found. So do the word groups, of at most `GROUPS` centres fitted on at most `SAMPLE` queries.
Statistics (document count, mean length, document frequencies) come from all documents.
Each task keeps k a query at most, and rows are merged by query.

Queries go out in slices of at most `slice_terms` postings (a word of a text), so what is
sent to the tasks is bounded however many queries there are; a slice is a pass over the blocks.
The hashes and document frequencies of the distinct query words, 16 bytes a word, go to all tasks.

Defined results: scores are rounded to 6 places, then ties go to the lower doc_id;
only scores above zero count, so a query without words or hits has no rows. Rows
without an id (of either table) are left out, repeated rows each count, null and
empty texts match nothing, extra columns are ignored. A document that is a query finds
itself like any other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, by_part, pack, partitions, read, split_sorted, texts, unpack
from granary.plans.lineage import table

ROWS = 1024  # rows of a block of documents, and of a chunk of queries
STRIP = 2 / 1024  # share of the pairs of a block and a chunk from which on a term is accumulated in strips
PRODUCTS = 1 << 17
GROUPS, SAMPLE = 6, 1000
PAIRS, TOGETHER = 1 << 17, 512  # pairs that are scored at a time, and those of one row
SPREAD = 5000  # a row that is spread out costs as much as so many terms looked up
FLOOR = 4e-7  # scores below are rounded to zero
WAITING = 8  # times k: pairs of a query that wait for their exact scores
HELD = 8_000_000  # postings of the blocks that a task holds for them, 12 bytes each


def _terms(vocabulary: np.ndarray, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, count) of query terms in the texts, by term; and the length of each text."""
    h, at = K.words(column, "punct", lower=True)
    i = np.searchsorted(vocabulary, h)
    i[i == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[i] == h)
    n = len(at) - 1
    pair, count = np.unique(i[hit] * n + np.searchsorted(at, hit, "right") - 1, return_counts=True)
    return pair // n, pair % n, count, np.diff(at)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Best:
    """The k best (score, document) of every query row, in the order of score, then lower id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.row, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, d: np.ndarray) -> None:
        """Takes in scores of query rows, of documents that were not scored before."""
        s = np.round(s, 6)
        good = (s > 0) & (s >= self.floor[q])
        if not good.any():
            return
        q, d, s = np.append(self.row, q[good]), np.append(self.doc, d[good]), np.append(self.score, s[good])
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        r = K.runs(q)
        rank = np.arange(len(q)) - np.repeat(r[:-1], np.diff(r))
        last, keep = rank == self.k - 1, rank < self.k
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last] - 2e-6)  # rounded scores may tie with it
        self.row, self.doc, self.score = q[keep], d[keep], s[keep]


class Postings:
    """Rows of a block or chunk: postings (term, row, weight) by term, and where each term begins."""

    def __init__(self, term, row, weight, n: int):
        self.term, self.row, self.weight, self.n = term, row, weight, n
        self.starts = K.runs(term)
        self.tokens, self.begin, self.size = term[self.starts[:-1]], self.starts[:-1], np.diff(self.starts)
        self.longest = int(np.bincount(row).max()) if len(row) else 0
        self.single, self.rows = weight.astype(np.float32), None

    def __reduce__(self):
        """Made anew where it arrives: arrays that were pickled have types of their own, with which `np.add.at` is some 15 times slower."""
        return Postings, (self.term, self.row, self.weight, self.n)

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, weight) by row, and where each row begins."""
        if self.rows is None:
            order = np.argsort(self.row.astype(np.uint16) if self.n <= 1 << 16 else self.row, kind="stable")  # short keys sort faster
            self.rows = self.term[order], self.weight[order], np.searchsorted(self.row[order], np.arange(self.n + 1))
        return self.rows


class Shared:
    """The terms that a chunk of queries and a block of documents share."""

    def __init__(self, chunk: Postings, block: Postings):
        self.chunk, self.block = chunk, block
        i = np.searchsorted(chunk.tokens, block.tokens)
        i[i == len(chunk.tokens)] = 0
        j = np.flatnonzero(chunk.tokens[i] == block.tokens) if len(chunk.tokens) else i[:0]
        i = i[j]
        self.token, self.q, self.d = block.tokens[j], (chunk.begin[i], chunk.size[i]), (block.begin[j], block.size[j])
        self.strip = chunk.size[i] * block.size[j] >= STRIP * chunk.n * block.n
        strips = int(self.strip.sum())
        self.slack = (strips + min(len(j) - strips, chunk.longest) + 16) * 2.0**-23  # of sums of so many products, none negative

    def _of(self, side, which: np.ndarray, postings: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term number among the shared, row, weight) of the postings of these shared terms."""
        begin, size = side[0][which], side[1][which]
        at = _ranges(begin, size)
        return np.repeat(which, size), postings.row[at], postings.single[at]

    def strips(self) -> np.ndarray:
        which = np.flatnonzero(self.strip)
        column = np.cumsum(self.strip) - 1
        left, right = np.zeros((self.chunk.n, len(which)), np.float32), np.zeros((len(which), self.block.n), np.float32)
        t, row, x = self._of(self.q, which, self.chunk)
        left[row, column[t]] = x
        t, row, x = self._of(self.d, which, self.block)
        right[column[t], row] = x
        return left @ right

    def rough(self) -> np.ndarray:
        """Scores of all pairs, to a share of `slack`."""
        scores = self.strips()
        which = np.flatnonzero(~self.strip)
        (q, rows), (d, docs) = (self.q[0][which], self.q[1][which]), (self.d[0][which], self.d[1][which])
        flat, upto = scores.reshape(-1), np.append(0, np.cumsum(rows * docs))
        i = 0
        while i < len(which):  # whole terms, as many products at a time as stay in the cache
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PRODUCTS, "right")) - 1)
            own = _ranges(q[i:j], rows[i:j])
            size = np.repeat(docs[i:j], rows[i:j])  # a query row's postings of one term, one after the other
            at = _ranges(np.repeat(d[i:j], rows[i:j]), size)
            np.add.at(flat, np.repeat(self.chunk.row[own] * self.block.n, size) + self.block.row[at], np.repeat(self.chunk.single[own], size) * self.block.single[at])
            i = j
        return scores


def _scores(queries, docs, q: np.ndarray, d: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (q, d); `dense` has a zero for every term.

    The rows of one side are spread out one by one, the terms of the other looked up there,
    whichever is less. Either way the products of shared terms are added in the order of terms.
    """
    sides, costs = [], []
    for (own, x), (other, y) in (((queries, q), (docs, d)), ((docs, d), (queries, q))):
        own, other = own.by_row(), other.by_row()
        once = np.unique(x)
        sides.append((own, x, other, y))
        costs.append((other[2][y + 1] - other[2][y]).sum() + 2 * (own[2][once + 1] - own[2][once]).sum() + SPREAD * len(once))
    (t, w, begin), x, (t2, w2, begin2), y = sides[int(np.argmin(costs))]
    order = np.argsort(x, kind="stable")
    x, y, out = x[order], y[order], np.zeros(len(x))
    r = np.union1d(K.runs(x), np.arange(0, len(x), TOGETHER))
    for i, j in zip(r[:-1].tolist(), r[1:].tolist(), strict=True):
        own = slice(begin[x[i]], begin[x[i] + 1])
        dense[t[own]] = w[own]
        size = begin2[y[i:j] + 1] - begin2[y[i:j]]
        at = _ranges(begin2[y[i:j]], size)
        out[i:j] = np.bincount(np.repeat(np.arange(j - i), size), dense[t2[at]] * w2[at], j - i)
        dense[t[own]] = 0
    back = np.empty(len(x))
    back[order] = out
    return back


def _likely(chunk: Postings, block: Postings, best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(q, d, score to a share of `slack`, slack) of all pairs that can be among the k best of a query, by q; raises floors to what k documents of the block reach."""
    both = Shared(chunk, block)
    if not len(both.token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.0
    rough = both.rough()
    able = rough >= (best.floor * (1 - both.slack)).astype(np.float32)[:, None]
    many = np.flatnonzero(np.count_nonzero(able, axis=1) > best.k)
    if len(many):
        best.floor[many] = np.maximum(best.floor[many], np.partition(rough[many], block.n - best.k, axis=1)[:, block.n - best.k] * (1 - both.slack) - 2e-6)
        able[many] = rough[many] >= (best.floor[many] * (1 - both.slack)).astype(np.float32)[:, None]
    q, d = np.nonzero(able)
    return q, d, rough[q, d].astype(float), both.slack


def _meet(chunk: Postings, block: Postings, ids: np.ndarray, best: Best, dense: np.ndarray) -> None:
    """Takes in all documents of the block that can be among the k best of a query of the chunk."""
    q, d, _, _ = _likely(chunk, block, best)
    for i in range(0, len(q), PAIRS):
        own = slice(i, i + PAIRS)
        best.add(q[own], _scores(chunk, block, q[own], d[own], dense), ids[d[own]])


class Rows:
    """Postings by row of several blocks or chunks, one after the other."""

    def __init__(self):
        self.parts, self.first, self.postings = [], 0, 0

    def add(self, rows: Postings) -> int:
        """The number of the first row."""
        t, w, at = rows.by_row()
        self.parts.append((t.astype(np.int32), w, np.diff(at)))
        first, self.first, self.postings = self.first, self.first + rows.n, self.postings + len(t)
        return first

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [tuple(map(np.concatenate, zip(*self.parts, strict=True)))]
        t, w, size = self.parts[0]
        return t, w, np.append(0, np.cumsum(size))


class Waiting:
    """Pairs of a chunk of queries and held blocks, known to score between two bounds: most are outdone before they are scored exactly."""

    def __init__(self, best: Best):
        self.best, self.parts, self.fresh = best, [], 0

    def add(self, q: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether so many wait now that they should be scored."""
        if len(q):
            self.parts.append((q, d, low, high))
            self.fresh += len(q)
        n = len(self.best.floor)
        return self.fresh * 2 > n and len(self.left()[0]) > WAITING * self.best.k * n

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are not outdone by k documents."""
        if self.fresh:
            q, d, low, high = map(np.concatenate, zip(*self.parts, strict=True))
            best, self.fresh = self.best, 0
            row, least = np.append(best.row, q), np.append(best.score, low)
            order = np.lexsort((-least, row))
            r = K.runs(row[order])
            kth = order[r[:-1][np.diff(r) >= best.k] + best.k - 1]
            best.floor[row[kth]] = np.maximum(best.floor[row[kth]], least[kth] - 2e-6)  # rounded scores may tie with it
            keep = high >= best.floor[q]
            self.parts = [(q[keep], d[keep], low[keep], high[keep])]
        return self.parts[0][:2] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _settle(waiting: list[tuple[int, Waiting]], queries: Rows, docs: Rows, ids: list[np.ndarray], dense: np.ndarray) -> None:
    """Scores all that waits exactly: [(first query row, pairs)], and the documents of the held rows."""
    left = [(lo, mine, *mine.left()) for lo, mine in waiting]
    q, d = (np.concatenate(x) for x in ([q + lo for lo, _, q, _ in left], [d for _, _, _, d in left]))
    if not len(q):
        return
    scores, names, i = _scores(queries, docs, q, d, dense), np.concatenate(ids), 0
    for _, mine, q, d in left:
        mine.best.add(q, scores[i : i + len(q)], names[d])
        mine.parts, i = [], i + len(q)


def _packed_sum(found: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, total counts) of packed rows (part, payload), each key once; by part, so keys are in order."""
    schema = pa.schema([("part", pa.int32()), ("payload", pa.binary())])

    def add(batches):
        got: dict[int, tuple] = {}
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("payload").to_pylist(), strict=True):
                h, c = unpack(x, np.int64)
                if p in got:
                    h, c = np.append(got[p][0], h), np.append(got[p][1], c)
                h, i = np.unique(h, return_inverse=True)
                got[p] = h, np.bincount(i, c, len(h)).astype(np.int64)
        for p in sorted(got):
            yield batch_of(schema, [p], [pack(*got[p])])

    rows = by_part(found, n).mapInArrow(add, "part int, payload binary").toLocalIterator()
    return [tuple(unpack(x, np.int64)) for _, x in sorted((r["part"], bytes(r["payload"])) for r in rows)]


PACKED = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def _vocabulary(queries: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of all query words."""

    def run(batches):
        for b in K.batches_by_bytes(batches, "text"):
            h, c = np.unique(K.words(b.column("text"), "punct", lower=True)[0], return_counts=True)
            rows = [(p, pack(h[s], c[s].astype(np.int64))) for p, s in split_sorted(h, n)]
            if rows:
                yield batch_of(PACKED, *zip(*rows, strict=True))

    found = _packed_sum(queries.mapInArrow(run, "part int, payload binary"), n)
    return np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)


def _statistics(base: DataFrame, shared, size: int, n: int) -> tuple[int, int, np.ndarray]:
    """Documents, words, and the document frequency of every term."""

    def run(batches):
        vocabulary = shared.value
        df, rows, words = np.zeros(len(vocabulary), np.int64), 0, 0
        for part in K.batches_by_bytes(batches, "text"):
            t, _, _, length = _terms(vocabulary, part.column("text"))
            df += np.bincount(t, minlength=len(vocabulary))
            rows, words = rows + part.num_rows, words + int(length.sum())
        seen = np.flatnonzero(df)
        key, count = np.append(seen, [size, size + 1]), np.append(df[seen], [rows, words])
        part = key * n // (size + 2)
        r = K.runs(part)
        yield batch_of(PACKED, part[r[:-1]], [pack(key[i:j].astype(np.uint64), count[i:j]) for i, j in zip(r[:-1], r[1:], strict=True)])

    total = np.zeros(size + 2, np.int64)
    for key, count in _packed_sum(base.mapInArrow(run, "part int, payload binary"), n):
        total[key.astype(np.int64)] = count
    return int(total[-2]), int(total[-1]), total[:-2]


def _centres(vocabulary: np.ndarray, idf: np.ndarray, df: np.ndarray, sample: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(column of every term, -1 for most; centres): groups of texts by their common words, which decide speed only."""
    top = np.sort(np.argsort(-df, kind="stable")[:2000])
    column = np.full(len(vocabulary), -1)
    column[top] = np.arange(len(top))
    t, row, _, _ = _terms(vocabulary, pa.array(sample, pa.string()))
    x = np.zeros((len(sample), len(top)))
    x[row[column[t] >= 0], column[t[column[t] >= 0]]] = idf[t[column[t] >= 0]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[:1]
    for _ in range(GROUPS - 1):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(6):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.vstack([x[near == g].sum(axis=0) if (near == g).any() else centres[g] for g in range(len(centres))])
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return column, centres


BLOCK = pa.schema([("cluster", pa.int32()), ("number", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("length", pa.binary()), ("payload", pa.binary())])
KINDS = "cluster int, number long, size long, ids binary, length binary, payload binary"


def _blocks(base: DataFrame, shared, name: str) -> DataFrame:
    """A written table of blocks: rows of one word group, and their postings by term."""

    def run(batches):
        vocabulary, idf, column, centres = shared.value
        held: dict[int, list] = {}

        def block(g):
            t, d, tf, ids, length = zip(*held.pop(g), strict=True)
            first = np.cumsum([0, *map(len, ids)])
            t, d, tf = np.concatenate(t), np.concatenate([x + i for x, i in zip(d, first, strict=False)]), np.concatenate(tf)
            order = np.argsort(t, kind="stable")
            payload = pack(t[order].astype(np.uint64), d[order].astype(np.int32), tf[order].astype(np.int32))
            return batch_of(BLOCK, [g], [int(ids[0][0])], [len(t)], [np.concatenate(ids).tobytes()], [np.concatenate(length).tobytes()], [payload])

        for part in K.batches_by_bytes(batches, "text", 4 << 20):
            t, d, tf, length = _terms(vocabulary, part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            known = column[t] >= 0
            near = np.array([np.bincount(d[known], c[column[t[known]]] * idf[t[known]], len(ids)) for c in centres]).argmax(axis=0)
            for g in np.unique(near).tolist():
                mine = near == g
                to = np.cumsum(mine) - 1
                p = mine[d]
                held.setdefault(g, []).append((t[p], to[d[p]], tf[p], ids[mine], length[mine].astype(np.int64)))
                if sum(len(x[3]) for x in held[g]) >= ROWS:
                    yield block(g)
        for g in sorted(held):
            yield block(g)

    return table(base.mapInArrow(run, KINDS), name)


def _block(batches, idf: np.ndarray, mean: float, k1: float, b: float):
    """(cluster, ids, postings) of every block of documents."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, length = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["length"], np.int64)
            t, d, tf = unpack(r["payload"], np.int32, np.int32)
            t = t.astype(np.int64)
            yield r["cluster"], ids, Postings(t, d, idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[d] / mean)), len(ids))


def _search(blocks: DataFrame, step: int, rows: list, of_all, k: int, mean: float, k1: float, b: float) -> DataFrame:
    """The k best at least of every query row of a slice: [(cluster, ids, term, row, times)]."""
    spark, chunks, names = blocks.sparkSession, [], []
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        first = np.cumsum([0, *(len(r[1]) for r in own)])
        ids, term, times = (np.concatenate([r[i] for r in own]) for i in (1, 2, 4))
        row = np.concatenate([r[3] + i for r, i in zip(own, first, strict=False)])
        for lo in range(0, len(ids), ROWS):
            mine = np.flatnonzero((row >= lo) & (row < lo + ROWS))
            mine = mine[np.argsort(term[mine], kind="stable")]
            chunks.append((g, sum(map(len, names)), Postings(term[mine], row[mine] - lo, times[mine].astype(float), min(ROWS, len(ids) - lo))))
            names.append(ids[lo : lo + ROWS])
    names = np.concatenate(names)
    shared = spark.sparkContext.broadcast(chunks)  # bounded by the slice
    known = pa.schema([("row", pa.int32()), ("score", pa.float64())])

    def floors(batches):
        best = np.zeros((len(names), k))
        for g, _, block in _block(batches, of_all.value, mean, k1, b):
            for own, lo, chunk in shared.value:
                if own == g:
                    both = Shared(chunk, block)
                    rough = both.rough() * (1 - both.slack)
                    top = np.partition(rough, block.n - k, axis=1)[:, -k:] if block.n > k else rough
                    best[lo : lo + chunk.n] = np.sort(np.hstack([best[lo : lo + chunk.n], top]), axis=1)[:, -k:]
        row, i = np.nonzero(best)
        if len(row):
            yield batch_of(known, row, best[row, i])

    sample = blocks.where(F.pmod(F.xxhash64("number"), F.lit(step)) == 0).coalesce(max(8, partitions(spark) // 8))
    scores = sample.mapInArrow(floors, "row int, score double").groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("score"))
    floor = np.full(len(names), FLOOR)
    for r in scores.where(F.size("score") >= k).select("row", F.col("score")[k - 1].alias("score")).collect():  # a number a query of the slice
        floor[r["row"]] = max(FLOOR, r["score"] - 2e-6)
    least = spark.sparkContext.broadcast(floor)
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        idf = of_all.value
        dense, queries, held, ids = np.zeros(len(idf)), Rows(), Rows(), []
        waiting = [(queries.add(chunk), Waiting(Best(least.value[lo : lo + chunk.n], k))) for _, lo, chunk in shared.value]
        for _, own, block in _block(batches, idf, mean, k1, b):
            first, full = held.add(block), False
            ids.append(own)
            for (_, _, chunk), (_, mine) in zip(shared.value, waiting, strict=True):
                q, d, rough, slack = _likely(chunk, block, mine.best)
                full |= mine.add(q, d + first, rough * (1 - slack), rough / (1 - slack))
            if full or held.postings > HELD:
                _settle(waiting, queries, held, ids, dense)
                held, ids = Rows(), []
        if ids:
            _settle(waiting, queries, held, ids, dense)
        for lo, mine in waiting:
            if len(mine.best.row):
                yield batch_of(out, names[mine.best.row + lo], mine.best.doc, mine.best.score)

    return blocks.mapInArrow(run, "query_id long, doc_id long, score double")


def top_k(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", k1: float = 1.2, b: float = 0.75, slice_terms: int = 2_000_000) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query row."""
    spark, base, asked = docs.sparkSession, texts(docs), texts(queries, query_id)
    n = partitions(spark)
    vocabulary = _vocabulary(asked, n)
    if not len(vocabulary):
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    count, words, df = _statistics(base, spark.sparkContext.broadcast(vocabulary), len(vocabulary), n)
    mean = words / count if words else 1.0
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    centres = _centres(vocabulary, idf, df, [r["text"] for r in asked.where("text <> ''").limit(SAMPLE).collect()])
    shared, of_all = spark.sparkContext.broadcast((vocabulary, idf, *centres)), spark.sparkContext.broadcast(idf)
    blocks = _blocks(base, shared, "search-documents")
    step = min(16, max(1, blocks.count() // 16))
    found, now, size = [], [], 0
    for r in _blocks(asked, shared, "search-queries").orderBy("cluster", "number", "ids").toLocalIterator():
        ids = np.frombuffer(bytes(r["ids"]), np.int64)
        t, row, times = unpack(bytes(r["payload"]), np.int32, np.int32)
        if now and size + len(t) > slice_terms:
            found.append(_search(blocks, step, now, of_all, k, mean, k1, b))
            now, size = [], 0
        now.append((r["cluster"], ids, t.astype(np.int64), row.astype(np.int64), times))
        size += len(t)
    found.append(_search(blocks, step, now, of_all, k, mean, k1, b))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    merged = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 as a query, against all documents."""
    docs = read(spark, sf_dir, "documents")
    return top_k(docs.where("doc_id % 20 = 0"), docs, query_id="doc_id")


ORACLE = r"""
WITH dw AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS tf FROM dw WHERE w <> '' GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS n FROM d GROUP BY doc_id),
stat AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(n) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
q AS (SELECT doc_id AS query_id, w, tf AS qtf FROM d WHERE doc_id % 20 = 0),
idf AS (SELECT w, ln(1 + (stat.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d, stat GROUP BY w, stat.n),
s AS (SELECT q.query_id, d.doc_id, round(sum(q.qtf * idf.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len.n / stat.mean))), 6) AS score
      FROM q JOIN d USING (w) JOIN idf USING (w) JOIN len ON len.doc_id = d.doc_id, stat GROUP BY q.query_id, d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
