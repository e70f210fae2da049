"""The explainable quality score: four shares, weighted."""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from granary.functions.batches import strings

SIGNALS = ("alpha_ratio", "unique_word_ratio", "average_word_length", "short_line_ratio")


@cache
def _alphabet() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@arrow_udf(ArrayType(IntegerType()))
def _counts(texts: pa.Array) -> pa.Array:
    """Of each text: words, letters, characters, different words, characters in words, lines of one or two words, lines that have any."""
    alpha, out = _alphabet(), array("i")
    for t in strings(texts):
        words = t.split()
        lines = [len(x.split(None, 2)) for x in t.splitlines()]
        filled = len(lines) - lines.count(0)
        letters = np.count_nonzero(alpha[np.frombuffer(t.encode("utf-32-le"), np.uint32)])
        folded = t.lower().replace("ß", "ss").replace("ς", "σ")
        out.extend((len(words), letters, len(t), len(set(folded.split())), sum(map(len, words)), filled - lines.count(3), filled))
    return pa.ListArray.from_arrays(pa.array(range(0, len(out) + 1, 7), pa.int32()), pa.array(out, pa.int32()))


def _clamp(c: Column, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), c))


def _rounded(c: Column) -> Column:
    """To 4 places, half up of the scaled number; so a share just below a half of the last place counts as one if ten thousand times it does."""
    return F.round(c * 10_000.0) / 10_000.0


def with_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with word_count, the four signals and quality_score, all rounded to 4 places.

    A null, empty or wordless text scores 0 and has a word_count of 0 and null signals;
    no row is dropped. The score is made of unrounded shares.
    """
    df = df.withColumn("__counts", _counts(F.coalesce(F.col(text), F.lit(""))))
    n, letters, chars, different, solid, short, filled = (F.col("__counts")[k] for k in range(7))
    df = df.withColumn("word_count", n)
    raw = (letters / F.greatest(chars, F.lit(1)), different / n, solid / n, short / F.greatest(filled, F.lit(1)))
    df = df.withColumns({f"__{k}": F.when(n > 0, x) for k, x in zip(SIGNALS, raw, strict=True)})
    a, u, m, s = (F.col(f"__{k}") for k in SIGNALS)
    score = 0.4 * _clamp((a - 0.35) / 0.4) + 0.3 * F.least(u / 0.5, F.lit(1.0)) + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(m - 6) / 12) + 0.1 * (1 - s)
    out = df.withColumn("quality_score", F.when(n > 0, _rounded(score)).otherwise(F.lit(0.0)))
    return out.withColumns({k: _rounded(F.col(f"__{k}")) for k in SIGNALS}).drop("__counts", *(f"__{k}" for k in SIGNALS))


def is_good(threshold: float = 0.5) -> Column:
    """The gate over the columns of `with_quality`: rounded values count; without words it is false."""
    a, u, m, _ = map(F.col, SIGNALS)
    return F.coalesce((F.col("quality_score") >= threshold) & (a >= 0.5) & (u >= 0.1) & m.between(2, 25), F.lit(False))


def quality_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, word_count, the four signals, quality_score) of every row."""
    return with_quality(docs.select("doc_id", "text")).drop("text")
