"""Suffix-array dedup by bucket-pointer refinement: passages that the corpus holds twice.

Suffixes (word positions) are first put in buckets by the q-gram that starts them, q
half of `min_words`. A bucket is then refined by the bucket identifier of the suffix q
words further on, which names the next q words, so each round doubles the depth with
the identifiers of the round before; it ends at depth `min_words`, where suffixes that
still share a bucket start a repeated passage. Identifiers are hashes of the words, so
every task names buckets alike, with nothing gathered.

Of the first round only one suffix in a window of `min_words` words need be counted,
the one of the least identifier: windows that are equal choose equal ones. Windows
whose choice is alone in its bucket can't repeat and are not refined, which leaves the
second round with the repeated share of the corpus.

Defined results: `repeats` has one row per stretch of a document covered by passages
of at least `min_words` words that occur more than once in the corpus (overlapping and
adjacent ones joined), within one document or in several: (doc_id, start_word,
end_word, duplicate_words). duplicate_words counts the words that dedup would cut: those
in passages of which the corpus has an earlier one, in the order of (doc_id, start).
Texts that are null, empty or shorter give no row, nor do rows without an id; repeated
rows repeat each other, and rows that share an id are reported under it together; extra
columns are ignored. Words are split at ASCII white space; case is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from granary.llm import kernels as K
from granary.llm.common import batch_of, by_part, chunks, opened, pack, partitions, read, split_sorted, totals_of, unpack, with_totals


def windows(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window of `length` words in a text, the least q-gram identifier in it, and its own identifier."""
    q = (length + 1) // 2
    first = K.grams(h, q)  # initial buckets
    start = np.flatnonzero(K.within(at, length)[: max(0, len(h) - length + 1)])
    if not len(start):
        z = np.zeros(0, np.uint64)
        return start, z, z
    least = K.sliding_min(first, length - q + 1)[start]
    refined = K.mix(first[start] * K._A + first[start + length - q] * K._B)  # by the bucket at the later offset
    return start, least, refined


def chosen(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Initial buckets of the suffixes that any window chooses, each suffix once."""
    q = (length + 1) // 2
    reach = length - q + 1
    if len(h) < length:
        return np.zeros(0, np.uint64)
    first = K.grams(h, q)
    least = np.where(K.within(at, length)[: len(h) - length + 1], K.sliding_min(first, reach), np.uint64(0))
    edge = np.zeros(reach - 1, np.uint64)
    most = ~K.sliding_min(~np.concatenate([edge, least, edge]), reach)  # greatest least of the windows that hold the suffix
    return first[most == first]


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, duplicate_words) of every stretch of repeated passages."""
    n = partitions(docs.sparkSession)

    def keys(batch):
        return [np.unique(chosen(*K.words(batch.column("text")), min_words), return_counts=True)]

    sent = pa.schema([("part", pa.int32()), ("payload", pa.binary())])

    def refine(batches):
        for b in batches:
            for blob, replies in zip(b.column("blob"), b.column("replies"), strict=True):
                batch = opened(blob.as_py())
                h, at = K.words(batch.column("text"))
                start, least, own = windows(h, at, min_words)
                if not len(start):
                    continue
                names = np.unique(least)
                shared = totals_of(replies.as_py(), 1)[0] >= 2
                live = shared[np.searchsorted(names, least)]
                start, own = start[live], own[live]
                order = np.argsort(own)
                start, own = start[order], own[order]
                doc = np.searchsorted(at, start, "right") - 1
                ids = batch.column("doc_id").to_numpy()[doc]
                pos = (start - at[doc]).astype(np.int32)
                rows = [(p, pack(own[s], ids[s], pos[s])) for p, s in split_sorted(own, n)]
                if rows:
                    yield batch_of(sent, *zip(*rows, strict=True))

    def match(batches):
        got = [unpack(x, np.int64, np.int32) for b in batches for x in b.column("payload").to_pylist()]
        if not got:
            return
        key, doc, pos = map(np.concatenate, zip(*got, strict=True))
        order = np.argsort(key, kind="stable")
        r = K.runs(key[order])
        size = np.diff(r)
        order = order[np.repeat(size > 1, size)]
        key, doc, pos = key[order], doc[order], pos[order]
        order = np.lexsort((pos, doc, key))
        key, doc, pos = key[order], doc[order], pos[order]
        later = np.append(False, key[1:] == key[:-1])[: len(key)]
        part = K.mix(doc.view(np.uint64)) % np.uint64(n)
        order = np.lexsort((pos, doc.view(np.uint64), part))
        part, doc, pos, later = part[order], doc[order], pos[order], later[order]
        r = K.runs(part)
        rows = [(int(part[i]), pack(doc[i:j].view(np.uint64), pos[i:j], later[i:j].astype(np.uint8))) for i, j in zip(r[:-1], r[1:], strict=True)]
        if rows:
            yield batch_of(sent, *zip(*rows, strict=True))

    out = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("duplicate_words", pa.int64())])

    def join(batches):
        got = [unpack(x, np.int32, np.uint8) for b in batches for x in b.column("payload").to_pylist()]
        if not got:
            return
        doc, pos, later = map(np.concatenate, zip(*got, strict=True))
        order = np.lexsort((pos, doc))
        doc, pos, later = doc[order].view(np.int64), pos[order].astype(np.int64), later[order] > 0
        new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + min_words))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        span = np.cumsum(new) - 1
        d = np.flatnonzero(later)  # each such window adds the words up to the next of its stretch
        reach = np.full(len(d), min_words)
        if len(d) > 1:
            same = span[d[1:]] == span[d[:-1]]
            reach[:-1][same] = np.minimum(min_words, pos[d[1:]] - pos[d[:-1]])[same]
        yield batch_of(out, doc[first], pos[first], pos[last] + min_words, np.bincount(span[d], reach, len(first)).astype(np.int64))

    kinds = "part int, payload binary"
    asked = with_totals(chunks(docs), keys, n).mapInArrow(refine, kinds)
    matched = by_part(asked, n).mapInArrow(match, kinds)
    return by_part(matched, n).mapInArrow(join, "doc_id long, start_word long, end_word long, duplicate_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0d\x1c-\x20]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM l WHERE len(ws) >= 50),
g AS (SELECT doc_id, pos, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS k FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS later, count(*) OVER (PARTITION BY k) AS c FROM g WHERE pos + 50 <= n),
h AS (SELECT doc_id, pos, later, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM r WHERE c > 1),
s AS (SELECT doc_id, pos, later, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM h),
d AS (SELECT doc_id, span, sum(least(50, coalesce(nxt - pos, 50))) AS dup FROM (SELECT doc_id, span, pos, lead(pos) OVER (PARTITION BY doc_id, span ORDER BY pos) AS nxt FROM s WHERE later) GROUP BY doc_id, span),
o AS (SELECT doc_id, span, min(pos) AS start_word, max(pos) + 50 AS end_word FROM s GROUP BY doc_id, span)
SELECT o.doc_id, o.start_word::BIGINT AS start_word, o.end_word::BIGINT AS end_word, coalesce(d.dup, 0)::BIGINT AS duplicate_words FROM o LEFT JOIN d USING (doc_id, span)
"""
