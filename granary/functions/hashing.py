"""SimHash of word shingles, and rolling hashes of word n-grams over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FEATURES = 4096  # hashed at a time
_ONES = (1 << 64) - 1


def _digests(features: list[str], kind: str) -> np.ndarray:
    if kind == "md5":
        raw = b"".join(hashlib.md5(f.encode(), usedforsecurity=False).digest()[:8] for f in features)
    else:
        raw = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def simhash_of(tokens: str | None, kind: str = "blake2b", most: int | None = None) -> int | None:
    """Signed 64-bit SimHash of tokens joined by spaces; a bit whose votes tie is set, so no tokens give all ones."""
    if tokens is None:
        return None
    words = tokens.split(" ") if tokens else []
    size = 3 if len(words) >= 3 else 1
    n = max(0, len(words) - size + 1)
    n = n if most is None else min(n, most)
    if not n:
        return -1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, FEATURES):
        features = [" ".join(words[i : i + size]) for i in range(lo, min(lo + FEATURES, n))]
        votes += np.unpackbits(_digests(features, kind), axis=1).sum(0, dtype=np.int64)  # the highest bit first
    return int(np.packbits(2 * votes >= n).view(">u8")[0].astype(np.int64))


def simhash64(tokens: Column, kind: str = "blake2b", most: int | None = None) -> Column:
    """Votes of all shingles of three tokens (single tokens where there are fewer), or of the first `most`."""

    @pandas_udf("long")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([simhash_of(t, kind, most) for t in series], dtype="Int64")

    return run(tokens)


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


class Rolling:
    """Hashes of all n-grams of token strings (single spaces between tokens), from one running hash of the bytes.

    The hash of bytes s..e is (H[e] - H[s]) / R**s modulo 2**64, so an n-gram costs two
    look-ups whatever its length. Hashes only choose candidates; the text decides.
    """

    R = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, n: int):
        self.n = n
        rng = np.random.default_rng(97)
        self.byte = rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.up) < size:
            for name, base in (("up", self.R), ("down", self.INVERSE)):
                p = np.full(size, base)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def grams(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first byte, byte after the last) of every n-gram, and the bytes."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        z = np.zeros(0, np.int64)
        if not len(raw):
            return z.view(np.uint64), z, z, z, raw
        solid = raw != 32
        edge = np.zeros(len(raw), bool)
        edge[off[:-1][off[:-1] < len(raw)]] = True
        first = np.flatnonzero(solid & (edge | np.append(True, ~solid[:-1])))
        ends = np.append(~solid[1:] | edge[1:], True)
        last = np.flatnonzero(solid & ends) + 1
        row = np.searchsorted(off, first, "right") - 1
        k = len(first) - self.n + 1
        if k < 1:
            return z.view(np.uint64), z, z, z, raw
        same = row[:k] == row[self.n - 1 :]
        s, e, row = first[:k][same], last[self.n - 1 :][same], row[:k][same]
        self._powers(len(raw) + 1)
        h = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=h[1:], dtype=np.uint64)
        x = (h[e] - h[s]) * self.down[s]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32)), row, s, e, raw


def slices(batches, column: str, most: int = 4 << 20):
    """Parts of Arrow batches with about `most` bytes of text (a longer text alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j
