"""Texts of Arrow arrays, a few at a time, so that a worker's memory depends on neither table nor batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(texts: pa.Array) -> Iterator[str | None]:
    """One text after the other; bytes that are no UTF-8 become replacement characters."""
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    for x in raw:
        b = x.as_py()
        yield None if b is None else b.decode("utf-8", "replace")


def parts(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices with about `most` bytes of text (a longer text alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield texts.slice(i, j - i)
        i = j


def mapped(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of every text; null stays null."""
    done = [pa.array((None if t is None else f(t) for t in strings(x)), pa.string(), size=len(x)) for x in parts(texts)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())
