"""Best-fit packing of documents into sequences of fixed capacity, by linear grouping.

Documents are packed within groups of about `group_docs` (by hash of doc_id), so the
work is spread and no task grows with the data; each group is packed as follows.
Texts longer than the capacity are cut into full sequences and a rest. Pieces above
`large` of the capacity are sorted and put in `classes` groups of equal cardinality;
each length is rounded up to the greatest of its group. The few-size problem is
optimised over bin configurations (column generation with a knapsack for pricing);
actual documents take the places of their rounded lengths, what rounding down the
solution leaves over and the small pieces follow by best fit, largest first.

Lengths are counts of whitespace-separated words, or a column of the input
(`length_col`). Defined results: null and empty texts (length 0) take no room and get
no row; rows without an id are left out; repeated rows are packed each; extra columns
are ignored; a negative or null length counts as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import batch_of, by_part, read, texts


def _price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest dual value that fits (unbounded knapsack)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    items = [(int(s), float(v), i) for i, (s, v) in enumerate(zip(sizes, duals, strict=True)) if v > 1e-12]
    value, chosen = [0.0] * (room + 1), [-1] * (room + 1)
    for c in range(1, room + 1):
        v, k = value[c - 1], -1
        for s, d, i in items:
            if s <= c and value[c - s] + d > v + 1e-12:
                v, k = value[c - s] + d, i
        value[c], chosen[c] = v, k
    best, pick = np.array(value), np.array(chosen)
    out, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, unit: int, rounds: int = 200) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in a fractional optimum for few sizes."""
    room, small = capacity // unit, -(-sizes // unit)
    n = len(sizes)
    basis = np.diag(np.maximum(room // small, 1).astype(float))
    x = counts / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, column = _price(duals, small, room)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, i].copy(), float(x[i])) for i in range(n)]


class _Bins:
    """Open bins by room left; the tightest that fits is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.left, self.mask, self.by = capacity, [], 0, {}

    def _file(self, b: int) -> None:
        r = self.left[b]
        if r:
            self.by.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def open(self, room: int) -> int:
        self.left.append(room)
        self._file(len(self.left) - 1)
        return len(self.left) - 1

    def fit(self, size: int) -> int:
        rest = self.mask >> size
        if not rest:
            return self.open(self.capacity - size)
        r = size + (rest & -rest).bit_length() - 1
        b = self.by[r].pop()
        if not self.by[r]:
            self.mask ^= 1 << r
        self.left[b] = r - size
        self._file(b)
        return b


def pack(lengths: np.ndarray, capacity: int, classes: int = 48, large: float = 0.125, unit: int | None = None) -> np.ndarray:
    """Bin of each length (all from 1 to capacity)."""
    unit = unit or max(1, capacity // 256)
    order = np.argsort(-lengths, kind="stable")
    bins, at = _Bins(capacity), np.full(len(lengths), -1, np.int64)
    full = order[lengths[order] == capacity]
    for i in full:
        at[i] = bins.open(0)
    order = order[len(full) :]
    big = order[lengths[order] > capacity * large]
    rest = list(order[len(big) :])
    if len(big):
        groups = [g for g in np.array_split(big, min(classes, len(big))) if len(g)]
        sizes = np.array([int(lengths[g[0]]) for g in groups])
        merged, first = np.unique(-sizes, return_index=True)
        ids = [np.concatenate([g for g, s in zip(groups, sizes, strict=True) if s == -m]) for m in merged]
        sizes = -merged
        queues = [list(map(int, g[::-1])) for g in ids]  # pop() takes the longest
        for column, times in configurations(sizes, np.array([len(g) for g in ids], float), capacity, unit):
            for _ in range(int(times + 1e-9)):
                take = [queues[k].pop() for k in range(len(sizes)) for _ in range(int(column[k])) if queues[k]]
                if take:
                    b = bins.open(capacity - int(lengths[take].sum()))
                    at[take] = b
        left = [i for q in queues for i in q]
        rest = sorted(left, key=lambda i: (-lengths[i], i)) + rest
    for i in rest:
        at[i] = bins.fit(int(lengths[i]))
    return at


def pack_documents(docs: DataFrame, capacity: int = 4096, group_docs: int = 40_000, classes: int = 48, large: float = 0.125, length_col: str | None = None) -> DataFrame:
    """(bin_group, bin_id, doc_id, chunk, doc_start, length, bin_start): each piece of a document and its place."""
    spark = docs.sparkSession
    if length_col is None:
        base = texts(docs).select("doc_id", F.expr(r"size(filter(split(text, '[\\x09-\\x0d\\x1c-\\x20]+'), w -> w <> ''))").cast("long").alias("length"))
    else:
        base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[length_col].cast("long"), F.lit(0)).alias("length")).where("doc_id is not null")
    n = max(1, -(-docs.count() // group_docs))
    out = pa.schema([("bin_group", pa.int32()), ("bin_id", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("doc_start", pa.int64()), ("length", pa.int64()), ("bin_start", pa.int64())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("part", "ascending"), ("doc_id", "ascending"), ("length", "ascending")])
        part, ids, size = (t.column(c).to_numpy() for c in ("part", "doc_id", "length"))
        for p in np.unique(part):
            mine = part == p
            doc, length = ids[mine], size[mine]
            pieces = -(-length // capacity)
            of = np.repeat(np.arange(len(doc)), pieces)
            chunk = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            piece = np.minimum(length[of] - chunk * capacity, capacity)
            at = pack(piece, capacity, classes, large)
            order = np.lexsort((chunk, of, at))
            at, of, chunk, piece = at[order], of[order], chunk[order], piece[order]
            ends = np.cumsum(piece)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: len(at)]
            base = np.repeat((ends - piece)[first], np.diff(np.append(first, len(at))))
            yield batch_of(out, np.full(len(at), p), at, doc[of], chunk, chunk * capacity, piece, ends - piece - base)

    parts = base.where("length > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    return by_part(parts, n).mapInArrow(run, "bin_group int, bin_id long, doc_id long, chunk int, doc_start long, length long, bin_start long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
