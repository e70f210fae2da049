"""Benchmark contamination: documents that share word n-grams with benchmark records.

A map over the documents tests rolling hashes of their n-grams against a bit set of the
benchmark's, so only n-grams that (all but surely) occur there become rows; those are
joined by their text, which makes the result exact. The bit set has a fixed greatest
size, so it goes to the tasks whatever the benchmark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.hashing import Rolling, slices

MOST_BITS = 28  # 32 MB
SLICE = 1 << 20  # bytes of text at a time; the hashes take some seventy times as many


def record_grams(records: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram): the distinct n-grams of each record."""
    tokens = records.select(key, T.word_tokens(F.col(text)).alias("__w")).where(F.size("__w") >= n)
    return tokens.select(key, F.explode(F.array_distinct(T.shingles(F.col("__w"), n))).alias("gram")).distinct()


def _bit_set(records: DataFrame, text: str, n: int):
    strings = records.select(T.token_string(F.col(text)).alias("t"))
    bits = 1 << MOST_BITS

    def run(batches):
        roll = Rolling(n)
        for b in slices(batches, "t", SLICE):
            x = np.unique(roll.grams(b.column("t"))[0] & np.uint64(bits - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["slots"])

    found = np.zeros(bits // 8, np.uint8)
    for r in strings.mapInArrow(run, "slots binary").toLocalIterator():  # one task's part at a time
        x = np.frombuffer(r["slots"], np.int32)
        np.bitwise_or.at(found, x >> 3, (1 << (x & 7)).astype(np.uint8))
    return records.sparkSession.sparkContext.broadcast(found)


def document_grams(docs: DataFrame, key: str, text: str, records: DataFrame, record_text: str, n: int) -> DataFrame:
    """(key, gram): the documents' distinct n-grams that may occur in the records; those that do are all there."""
    shared = _bit_set(records, record_text, n)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        roll, slots = Rolling(n), np.uint64((1 << MOST_BITS) - 1)
        for b in slices(batches, "t", SLICE):
            h, row, s, e, raw = roll.grams(b.column("t"))
            slot = (h & slots).astype(np.int64)
            hit = np.flatnonzero((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            if len(hit):
                data = raw.tobytes()
                grams = [data[i:j].decode() for i, j in zip(s[hit].tolist(), e[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[hit])), pa.array(grams, pa.string())], names=[key, "gram"])

    return docs.select(key, T.token_string(F.col(text)).alias("t")).mapInArrow(run, f"`{key}` {kind}, gram string").distinct()


def contamination(docs: DataFrame, records: DataFrame, n: int = 13, min_hits: int = 2, key: str = "doc_id", text: str = "text", record_key: str = "item_id", record_text: str = "text") -> DataFrame:
    """(key, record_key, hits) of records that share `min_hits` distinct n-grams with a document.

    Null, empty and shorter texts match nothing; rows that share an id pool their n-grams,
    rows without an id pool as one; with n words a record can give one hit only.
    """
    grams = record_grams(records, record_key, record_text, n)
    mine = document_grams(docs, key, text, records, record_text, n)
    return mine.join(grams, "gram").groupBy(key, record_key).agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)


def matches(docs: DataFrame, records: DataFrame, key: str = "doc_id", record_key: str = "item_id", **how) -> DataFrame:
    """(key, contamination_matches): the sorted ids of the records found, for documents that have any."""
    found = contamination(docs, records, key=key, record_key=record_key, **how)
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.col(record_key).cast("string"))).alias("contamination_matches"))


def reject(docs: DataFrame, records: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without those that match any record."""
    return docs.join(matches(docs, records, key, **how).select(key), key, "left_anti")


def flag(docs: DataFrame, records: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs with `contamination_matches`, empty where nothing matches."""
    out = docs.join(matches(docs, records, key, **how), key, "left")
    return out.withColumn("contamination_matches", F.coalesce("contamination_matches", F.array().cast("array<string>")))
