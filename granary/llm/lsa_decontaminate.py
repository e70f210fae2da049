"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into cells of 32 words; a passage is two adjacent cells. Passages are
TF-IDF rows over the words of the benchmark (words found in over `max_df` of all
cells are left out). A distributed
randomised SVD sketches Z = A'(A G) over all cells in one pass - tasks add up their
share, blocks of Z are summed by a shuffle - and the benchmark items and passages
are compared in the space of its leading directions. The items are rows of A as well,
together as heavy as the corpus, or the directions would tell little of them.
A short item in a passage of many benchmark words is far from it in that space, so items of
one cell or less are looked for by their rarest words as well: of miss + v of them, where
miss is how many words a leak may lack, any leak has v, and passages with v are candidates.
Words of an item that leaks into more than `max_df` of the cells lose their weight too; a
piece of which half the words or more are left without is looked for by its words
themselves: in passages that hold at least `cosine` of them (the cosine reported is then
that of the two sets of words).
An item of more than two cells is looked for by pieces of two cells, a cell apart.
Each candidate is then checked word by word: it is a leak if the longest common
subsequence with the item, within the passage and one cell either side (for a longer
item: its whole length from where it would begin, half of what it has over two cells
more on either side, and the cell), covers `exact` of the item's words, or `paraphrase` of them if the answer is there too (the
benchmark's `answer` column, else the item's rarest words).

Benchmarks go out in slices that end with the item at which they hold `slice_items`
pieces; what a task is sent is bounded by that and the longest item, however large the benchmark is. Nothing of the documents is shuffled.

Defined results: one row per (doc_id, item_id), at the best passage (greatest cover,
then first; the cosine is 0 if only rare words led there). Null and empty texts or items match nothing; items of fewer than 8 words
must stand word for word to be a leak; those of fewer than `min_words` are skipped, as any
text would hold them; rows without an id are
left out of `leaks` and judged like any other by `drop_leaks`; repeated rows are reported each; extra
columns are ignored or passed on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, by_part, read, texts

CELL = 32
LOOSE = 8  # words from which on a leak may lack some
_BLOCKS = 16


def _pieces(words: int) -> list[int]:
    """Where the pieces of an item of so many words begin, two cells long each (the last may be shorter)."""
    return list(range(0, max(words - CELL, 1), CELL))


def _vocabulary_index(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(vocabulary, h)
    i[i == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[i] == h)
    return hit, i[hit]


def _cells(at: np.ndarray) -> np.ndarray:
    """First cell of every text, and the number of cells."""
    return np.append(0, np.cumsum(-(-np.diff(at) // CELL)))


def _cell_of(at: np.ndarray, cells: np.ndarray, token: np.ndarray) -> np.ndarray:
    doc = np.searchsorted(at, token, "right") - 1
    return cells[doc] + (token - at[doc]) // CELL


def _run_sums(table: np.ndarray, index: np.ndarray, r: np.ndarray, most: int = 32) -> np.ndarray:
    """Sum of the rows table[index] of each run, place after place for all runs at once; long runs in pieces."""
    size = np.diff(r)
    if len(size) and size.max() > most:
        pieces = -(-size // most)
        first = np.cumsum(pieces) - pieces
        place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        part = _run_sums(table, index, np.append(np.repeat(r[:-1], pieces) + place * most, r[-1]), most)
        return _run_sums(part, np.arange(len(part)), np.append(first, len(part)), most)
    out, at, j = table[index[r[:-1]]], r[:-1], 1
    live = np.flatnonzero(size > 1)
    while len(live):
        out[live] += table[index[at[live] + j]]
        j += 1
        live = live[size[live] > j]
    return out


def lcs(item: dict[int, int], m: int, text) -> int:
    """Length of the longest common subsequence; `item` maps a word to the bit set of its places."""
    v = full = (1 << m) - 1
    for w in text:
        u = v & item.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Benchmark:
    """A slice of the benchmark and all that the tasks need to know about it."""

    def __init__(self, rows: list[tuple[int, str, str | None]], min_words: int):
        h, at = K.words(pa.array([r[1] for r in rows], pa.string()), "punct", lower=True)
        keep = [i for i in range(len(rows)) if at[i + 1] - at[i] >= min_words]
        self.ids = np.array([rows[i][0] for i in keep], np.int64)
        self.items = [h[at[i] : at[i + 1]] for i in keep]
        self.pieces = [(k, o) for k, w in enumerate(self.items) for o in _pieces(len(w))]
        self.vocabulary = np.unique(np.concatenate(self.items)) if keep else np.zeros(0, np.uint64)
        self.answers = [K.words(pa.array([rows[i][2]], pa.string()), "punct", lower=True)[0] if rows[i][2] else None for i in keep]
        self.masks = []
        for w in self.items:
            bits: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                bits[x] = bits.get(x, 0) | 1 << k
            self.masks.append(bits)

    def rare_words(self, exact: float, df: np.ndarray) -> None:
        """Of each item of a cell or less its rarest words: by word, the pieces it stands for, and the words each piece must have."""
        self.need = np.zeros(len(self.pieces), np.int64)
        pairs = []
        for j, (k, _) in enumerate(self.pieces):
            m = len(self.items[k])
            if m <= CELL:
                t = np.unique(np.searchsorted(self.vocabulary, self.items[k]))
                miss = int((1 - exact) * m + 1e-9) if m >= LOOSE else 0
                t = t[np.lexsort((t, df[t]))][: miss + max(3, m // 6)]
                self.need[j] = max(1, len(t) - miss)
                pairs += [(x, j) for x in t.tolist()]
        x = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.rare_at = np.searchsorted(x[:, 0], np.arange(len(self.vocabulary) + 1))
        self.rare_piece = x[:, 1].copy()

    def weigh(self, cells: int, df: np.ndarray, max_df: float) -> None:
        self.idf = np.log((cells + 1) / (df + 1.0)) + 1
        self.idf[df > max(max_df * cells, 2)] = 0.0  # a word in one or two cells is never common
        if not self.idf.any():
            self.idf = np.log((cells + 1) / (df + 1.0)) + 1
        self._without_weight()
        for k, w in enumerate(self.items):
            if self.answers[k] is None or not len(self.answers[k]):
                t = np.unique(w)
                order = np.lexsort((t, -self.idf[np.searchsorted(self.vocabulary, t)]))
                self.answers[k] = t[order[:5]]

    def _without_weight(self) -> None:
        """The pieces of which half the words or more have no weight, and a table of their words: word x piece."""
        terms = [np.unique(np.searchsorted(self.vocabulary, self.items[k][o : o + 2 * CELL])) for k, o in self.pieces]
        self.bare = np.array([j for j, t in enumerate(terms) if 2 * (self.idf[t] > 0).sum() <= len(t)], np.int64)
        self.bare_size = np.array([len(terms[j]) for j in self.bare], np.int64)
        self.bare_row = np.full(len(self.vocabulary), -1)
        if len(self.bare):
            used = np.unique(np.concatenate([terms[j] for j in self.bare]))
            self.bare_row[used] = np.arange(len(used))
            self.bare_table = np.zeros((len(used), len(self.bare)), np.uint8)  # a piece has 64 words at most
            for i, j in enumerate(self.bare):
                self.bare_table[self.bare_row[terms[j]], i] = 1

    def rows(self) -> np.ndarray:
        q = np.zeros((len(self.pieces), len(self.vocabulary)))
        for j, (k, o) in enumerate(self.pieces):
            np.add.at(q[j], np.searchsorted(self.vocabulary, self.items[k][o : o + 2 * CELL]), 1)
        return q * self.idf


def _fit(base: DataFrame, bench: Benchmark, rank: int, max_df: float, exact: float, seed: int) -> None:
    """Weights and leading directions, from all documents."""
    vocabulary, m = bench.vocabulary, len(bench.vocabulary)
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches):
        df, cells = np.zeros(m, np.int64), 0
        for b in K.batches_by_bytes(batches, "text"):
            h, at = K.words(b.column("text"), "punct", lower=True)
            first = _cells(at)
            hit, term = _vocabulary_index(vocabulary, h)
            pair = np.sort(_cell_of(at, first, hit) * m + term)
            df += np.bincount(pair[K.runs(pair)[:-1]] % m, minlength=m) if len(pair) else 0
            cells += int(first[-1])
        seen = np.flatnonzero(df)
        yield batch_of(schema, np.append(-1, seen), np.append(cells, df[seen]))

    found = {r["term"]: r["n"] for r in base.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([found.get(i, 0) for i in range(m)], float)
    bench.weigh(found.get(-1, 0), df, max_df)
    bench.rare_words(exact, df)

    width = min(rank + 8, m)
    start = np.random.default_rng(seed).normal(size=(m, width)).astype(np.float32)
    start[bench.idf == 0] = 0
    idf = bench.idf.astype(np.float32)
    blocks = np.array_split(np.arange(m), _BLOCKS)
    sums = pa.schema([("part", pa.int32()), ("z", pa.binary())])

    def sketch(batches):
        z, alone, scaled = np.zeros((m, width), np.float32), np.zeros(m), start * idf[:, None]
        for b in K.batches_by_bytes(batches, "text", 1 << 20):  # the rows of a batch stay in the cache
            h, at = K.words(b.column("text"), "punct", lower=True)
            hit, term = _vocabulary_index(vocabulary, h)
            used = idf[term] > 0
            hit, term = hit[used], term[used]
            if not len(hit):
                continue
            cell = _cell_of(at, _cells(at), hit)
            size = np.diff(K.runs(cell))
            one = np.repeat(size == 1, size)  # a cell of one such word adds to the diagonal of A'A only
            alone += np.bincount(term[one], idf[term[one]] ** 2, m)
            term, cell = term[~one], cell[~one]
            if not len(term):
                continue
            r = K.runs(cell)
            y = _run_sums(scaled, term, r)  # A G, a row a cell
            own = np.repeat(np.arange(len(r) - 1), np.diff(r))
            order = np.argsort(term, kind="stable")
            t = term[order]
            r = K.runs(t)
            t = t[r[:-1]]
            z[t] += _run_sums(y, own[order], r) * idf[t][:, None]  # A'(A G)
        z += (alone[:, None] * start).astype(np.float32)
        yield batch_of(sums, np.arange(_BLOCKS), [z[i].tobytes() for i in blocks])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, z in zip(b.column("part").to_pylist(), b.column("z").to_pylist(), strict=True):
                x = np.frombuffer(z, np.float32).astype(np.float64)
                total[p] = total[p] + x if p in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=sums)

    z = np.zeros((m, width))
    for r in by_part(base.mapInArrow(sketch, "part int, z binary"), _BLOCKS).mapInArrow(add, "part int, z binary").collect():
        z[blocks[r["part"]]] = np.frombuffer(r["z"]).reshape(-1, width)
    q = bench.rows()
    energy = float((z * start).sum()) / width  # E[G'A'A G] is the squared norm of A
    z += (q.T @ (q @ start)) * (energy / max(float((q * q).sum()), 1e-9))  # the items are passages too, as heavy together as the corpus
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    bench.directions = u[:, : min(rank, int((s > 1e-9 * max(s[0], 1e-30)).sum()))].astype(np.float32) if m else np.zeros((0, 0), np.float32)
    bench.scaled = bench.directions * idf[:, None]
    latent = q.astype(np.float32) @ bench.directions
    bench.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)


def _cover(bench: Benchmark, k: int, words: np.ndarray, start: int, how: dict) -> float:
    """The share of item k found in order around the place where it would begin; 0 if that is no leak."""
    m = len(bench.items[k])
    room = CELL + max(m - 2 * CELL, 0) // 2
    text = words[max(0, start - room) : max(0, start + max(m, 2 * CELL) + room)].tolist()
    if sum(map(bench.masks[k].__contains__, text)) < how["paraphrase"] * m:
        return 0.0  # too few words of the item for any such subsequence
    if m < LOOSE:
        own = bench.items[k].tolist()
        return float(any(text[i : i + m] == own for i in range(len(text) - m + 1)))
    cover = lcs(bench.masks[k], m, text) / m
    return cover if cover >= how["exact"] or (cover >= how["paraphrase"] and np.isin(bench.answers[k], text).mean() >= 0.8) else 0.0


def _by_words(bench: Benchmark, cell: np.ndarray, term: np.ndarray, nxt: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, piece, cosine of their sets of words) where a passage has at least `least` of the words of a piece without weight."""
    mine = bench.bare_row[term] >= 0
    cell, row, n = cell[mine], bench.bare_row[term[mine]], len(bench.bare_table)
    first = np.flatnonzero((cell > 0) & nxt[cell - 1])  # words of the second cell of a passage
    pair = np.unique(np.append(cell, cell[first] - 1) * n + np.append(row, row[first]))
    if not len(pair):
        return pair, pair, pair
    r = K.runs(pair // n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(r) - 1, 4096):
        at = r[lo : lo + 4097]
        both = _run_sums(bench.bare_table, pair % n, at)
        i, j = np.nonzero(both >= least * bench.bare_size)
        found.append((pair[at[i]] // n, bench.bare[j], both[i, j] / np.sqrt(bench.bare_size[j] * np.diff(at)[i])))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _by_rare_words(bench: Benchmark, cell: np.ndarray, term: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, piece) where a passage has as many of a piece's rarest words as any leak of it has."""
    mine = bench.rare_at[term + 1] > bench.rare_at[term]
    cell, term, n, m = cell[mine], term[mine], len(bench.vocabulary), len(bench.pieces)
    pair = np.unique(cell * n + term)
    if not len(pair):
        return pair, pair
    cell, term = pair // n, pair % n
    second = (cell > 0) & nxt[cell - 1]  # words of the second cell of a passage
    pair = np.unique(np.append(pair, (cell[second] - 1) * n + term[second]))
    passage, term = pair // n, pair % n
    times = bench.rare_at[term + 1] - bench.rare_at[term]
    post = np.repeat(bench.rare_at[term] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    both, votes = np.unique(np.repeat(passage, times) * m + bench.rare_piece[post], return_counts=True)
    ok = votes >= bench.need[both % m]
    return both[ok] // m, both[ok] % m


def find(bench: Benchmark, column, how: dict) -> list[tuple[int, int, int, float, float]]:
    """(text, item, start word, cover, cosine) of each leak, the best passage of a pair."""
    h, at = K.words(column, "punct", lower=True)
    hit, term = _vocabulary_index(bench.vocabulary, h)
    cells = _cells(at)
    n = int(cells[-1])
    if not len(hit) or not len(bench.ids):
        return []
    w = bench.idf[term]
    cell = _cell_of(at, cells, hit)
    doc_of = np.repeat(np.arange(len(at) - 1), np.diff(cells))
    place = np.arange(n) - cells[doc_of]
    own = np.bincount(cell, w * w, n)
    nxt = np.append(doc_of[1:] == doc_of[:-1], False) if n else np.zeros(0, bool)
    own2 = own.copy()
    own2[nxt] += own[1:][nxt[:-1]]
    live = np.flatnonzero(own2 > 0)
    need = np.zeros(n + 1, bool)
    need[live] = True
    need[1:] |= need[:-1] & nxt
    mine = need[cell] & (w > 0)
    y = np.zeros((n, bench.directions.shape[1]), np.float32)
    if mine.any():
        r = K.runs(cell[mine])
        y[cell[mine][r[:-1]]] = _run_sums(bench.scaled, term[mine], r)
    p = y[live].copy()
    two = nxt[live]
    p[two] += y[live[two] + 1]
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    best: dict[tuple[int, int], tuple] = {}
    covers: dict[tuple[int, int, int], float] = {}

    def look(passages: np.ndarray, pieces: np.ndarray, cosines: np.ndarray) -> None:
        for c, j, cos in zip(passages.tolist(), pieces.tolist(), cosines.tolist(), strict=True):
            d, (k, o) = int(doc_of[c]), bench.pieces[j]
            at_cell = int(place[c]) - o // CELL  # where the item would begin
            if (d, k, at_cell) not in covers:
                covers[d, k, at_cell] = _cover(bench, k, h[at[d] : at[d + 1]], at_cell * CELL, how)
            if cover := covers[d, k, at_cell]:
                row = (-cover, int(place[c] * CELL), -cos)
                if row < best.get((d, k), (1,)):
                    best[(d, k)] = row

    for lo in range(0, len(live), 4096):
        cos = p[lo : lo + 4096] @ bench.latent.T
        i, j = np.nonzero(cos >= how["cosine"])
        look(live[lo + i], j, cos[i, j])
    rare = _by_rare_words(bench, cell, term, nxt)
    look(*rare, np.zeros(len(rare[0])))
    if len(bench.bare):
        look(*_by_words(bench, cell, term, nxt, how["cosine"]))
    return [(d, int(bench.ids[k]), s, -c, -x) for (d, k), (c, s, x) in sorted(best.items())]


def _slices(docs: DataFrame, benchmark: DataFrame, how: dict) -> list:
    base, out, now = texts(docs), [], []
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"), answer.alias("a")).where("i is not null and t is not null").distinct().orderBy("i", "t", "a")

    def add():
        b = Benchmark(now, how["min_words"])
        if len(b.ids):
            _fit(base, b, how["rank"], how["max_df"], how["exact"], how["seed"])
            out.append(docs.sparkSession.sparkContext.broadcast(b))

    pieces = 0
    for r in rows.toLocalIterator():
        now.append((r["i"], r["t"], r["a"]))
        pieces += len(_pieces(len(K.words(pa.array([r["t"]], pa.string()), "punct", lower=True)[0])))
        if pieces >= how["slice_items"]:
            add()
            now, pieces = [], 0
    if now:
        add()
    return out


DEFAULTS = {"rank": 256, "max_df": 0.05, "cosine": 0.5, "exact": 0.7, "paraphrase": 0.5, "min_words": 5, "slice_items": 1000, "seed": 3}


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, start_word, cover, cosine) of every leak."""
    how = DEFAULTS | how
    base = texts(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("cover", pa.float64()), ("cosine", pa.float64())])

    def one(bench):
        def run(batches):
            for b in K.batches_by_bytes(batches, "text", 1 << 20):
                if rows := find(bench.value, b.column("text"), how):
                    ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                    d, i, s, c, x = zip(*rows, strict=True)
                    yield batch_of(schema, ids[list(d)], list(i), list(s), np.round(c, 6), np.round(x, 4))

        return base.mapInArrow(run, "doc_id long, item_id long, start_word long, cover double, cosine double")

    found = [one(b) for b in _slices(docs, benchmark, how)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, cover double, cosine double")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    how = DEFAULTS | how
    at = docs.columns.index("text")

    def one(bench):
        def run(batches):
            for b in batches:
                named = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
                for part in K.batches_by_bytes([named], f"c{at}", 1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r[0] for r in find(bench.value, part.column(at), how)]] = False
                    yield part.filter(pa.array(keep)).rename_columns(b.schema.names)

        return run

    for b in _slices(docs, benchmark, how):
        docs = docs.mapInArrow(one(b), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
