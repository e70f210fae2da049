"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel takes one Arrow string array and works on its UTF-8 buffer with
numpy, so that no Python object is made for a word. A null text is an empty one.
Word boundaries are ASCII: bytes from 0x80 on always belong to words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_PUNCT = np.ones(256, bool)
_PUNCT[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _PUNCT[_lo:_hi] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True
SEPARATORS = {"space": _SPACE, "punct": _PUNCT, "line": _LINE}
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * _A
    x = x ^ (x >> np.uint64(29))
    x = x * _B
    return x ^ (x >> np.uint64(32))


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, mode: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets into them by text."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    table, starts, ends = (~SEPARATORS[mode]).view(np.int8), [], []
    edges, step = np.unique(off), 1 << 18
    for i in range(0, len(raw), step):  # pieces that stay in the cache
        piece = raw[max(i - 1, 0) : i + step + 1]
        word = table.take(piece)
        first = 1 if i else 0
        n = min(step, len(raw) - i)
        own = word[first : first + n]
        before = word[:n] if i else np.append(np.int8(0), word[: n - 1])
        after = np.append(word[first + 1 : first + n], word[first + n] if len(word) > first + n else np.int8(0))
        cut = edges[np.searchsorted(edges, i) : np.searchsorted(edges, i + n)] - i
        start = own > before
        start[cut] = own[cut] > 0
        cut = edges[np.searchsorted(edges, i, "right") : np.searchsorted(edges, i + n, "right")] - i - 1
        end = own > after
        end[cut] = own[cut] > 0
        starts.append(np.flatnonzero(start) + i)
        ends.append(np.flatnonzero(end) + (i + 1))
    s, e = np.concatenate(starts), np.concatenate(ends)
    return s, e, np.searchsorted(s, off)


def hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, mode: str = "space", lower: bool = False) -> np.ndarray:
    """64-bit hash of every span; `lower` folds ASCII letters only."""
    if not len(s):
        return np.zeros(0, np.uint64)
    out = np.empty(len(s), np.uint64)
    table = _BYTE.copy()
    table[SEPARATORS[mode]] = 0
    if lower:
        table[65:91] = table[97:123]
    for i in range(0, len(s), 1 << 14):
        a, b = s[i : i + (1 << 14)], e[i : i + (1 << 14)]
        lo, hi = a[0], b[-1]
        place = np.arange(hi - lo, dtype=np.int64)
        place -= np.repeat(a - lo, np.diff(np.append(a, hi)))
        v = table.take(raw[lo:hi])
        if (b - a).max() > len(_PLACE):  # places repeat after a block; blocks have weights of their own, the first 1
            v *= np.where(place >= len(_PLACE), mix((place // len(_PLACE)).astype(np.uint64)) | np.uint64(1), np.uint64(1))
        place %= len(_PLACE)
        v *= _PLACE.take(place)
        out[i : i + (1 << 14)] = mix(np.add.reduceat(v, a - lo) + (b - a).astype(np.uint64) * _B)
    return out


def words(texts, mode: str = "space", lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and n+1 offsets by text."""
    raw, off = flat(pc.utf8_lower(texts) if lower else texts)
    s, e, at = spans(raw, off, mode)
    return hashes(raw, s, e, mode), at


def hash_of(word: str, mode: str = "space", lower: bool = False) -> int:
    """The hash that `words` gives a single word."""
    h, _ = words(pa.array([word]), mode, lower)
    return int(h[0])


def within(at: np.ndarray, n: int) -> np.ndarray:
    """For every item, whether the n items from it on are in the same text."""
    total = int(at[-1])
    left = np.repeat(at[1:], np.diff(at)) - np.arange(total)
    return left >= n


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each item on; it has len(h)-n+1 entries (texts run together: see `within`).

    The identifier of a run of 2m items is made of the identifiers of the runs of
    m items at it and m further on, so that each doubling reuses the last.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, size, acc, done = h, 1, None, 0
    while True:
        if n & size:
            if acc is None:
                acc, done = have, size
            else:
                m = len(h) - (done + size) + 1
                acc = mix(acc[:m] * _A + have[done : done + m] * _B + np.uint64(done * 131 + size))
                done += size
        if done == n:
            return acc[: len(h) - n + 1]
        m = len(have) - size
        have = mix(have[:m] * _A + have[size : size + m] * _B + np.uint64(size * 257 + 1))
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w entries from each entry on; it has len(x)-w+1 entries."""
    if len(x) < w:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    if size < w:
        have = np.minimum(have[: len(x) - w + 1], have[w - size :])
    return have


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal entries, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), len(sorted_keys))


def batches_by_bytes(batches, column: str, most: int = 8 << 20):
    """Slices of Arrow batches with about `most` bytes of text each (a longer text alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        i = 0
        while i < b.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(i, j - i)
            i = j
