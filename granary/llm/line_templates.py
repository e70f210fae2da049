"""Line dedup with a fixed-depth log-template tree.

A line of words goes to the leaf of its word count and its first `depth` words,
where a word with a digit stands for any such word. Within a leaf, lines come in the
order of (doc_id, line): each joins the template it shares most places with (ties:
the older template) if that is at least `similarity` of its words, and places that
differ become variable; otherwise it starts a template. Lines that read the same after
generalising share the template of the first. A template seen in at least `min_docs`
documents is recurring: all its lines are dropped but the first one.

What the tree makes of a line depends only on the first line that reads the same, so
equal lines are collapsed before anything is parsed: a map batch sends each line it holds
once, with its first place and its first `min_docs` documents (enough to tell whether a
union reaches `min_docs`); an exchange by the line itself adds batches up; only then do
the different lines of a leaf meet in one task, in order. A line that a third of the
documents hold is a row a batch, then one row. Leaves seen in fewer than `min_docs`
documents can't recur; a first pass counts them (a small row a leaf and batch) and a bit
set of fixed size passes their lines over: false hits cost bytes, never results. A task
that parses a leaf holds its templates and 16 bytes for each of its different lines.

The lines found to recur go back to the documents as a broadcast of their hashes if they
are at most `BROADCAST_ROWS`, and texts are rewritten in one map; beyond that, as a join
with the lines of the documents that a bit set lets through.

Defined results: lines of fewer than `min_words` words (by default those without any)
carry no template and stay; for lines no longer than `depth` the leaf is the line itself.
Null and empty texts stay as they are; a text that loses all its words comes out
empty in `dedup_lines` and goes in `drop_lines`. Rows without an id pass unchanged.
Rows that repeat an id count as one document: where its line is the first of a template,
each of its rows keeps it. Extra columns pass through `drop_lines`. Lines are separated
by a line feed, words by ASCII white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import kernels as K
from granary.llm.common import batch_of, partitions, read, texts, to_signed
from granary.plans.lineage import table

BITS = 22
BROADCAST_ROWS = 1_000_000  # of 32 bytes
DIGITS = np.uint64(K.hash_of("0"))
ANY = np.uint64(0)


def lines_of(column, depth: int, min_words: int):
    """Per line with enough words: text, line number, leaf, and its generalised words (values and offsets)."""
    raw, off = K.flat(column)
    s, e, at = K.spans(raw, off)
    h = K.hashes(raw, s, e)
    digit = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw >= 48) & (raw <= 57), out=digit[1:])
    h[digit[e] > digit[s]] = DIGITS
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, s)  # line feeds before the word
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))[: len(s)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(s)))
    keep = size >= min_words
    first, size = first[keep], size[keep]
    leaf = K.mix(size.astype(np.uint64))
    for k in range(depth):
        has = size > k
        leaf[has] = K.mix(leaf[has] * K._B + h[first[has] + k])
    number = line[first] - np.searchsorted(feeds, off[:-1])[doc[first]]
    return doc[first], number, leaf, first, size, h


def keys_of(first: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of the generalised words of each line; with the leaf it names the line."""
    if not len(first):
        return np.zeros(0, np.uint64)
    to = np.cumsum(size) - size
    item = np.repeat(first - to, size) + np.arange(int(size.sum()))
    place = (np.arange(len(item)) - np.repeat(to, size)).astype(np.uint64)
    return K.mix(np.add.reduceat(K.mix(h[item] + place * K._B), to) + size.astype(np.uint64) * K._A)


class Leaf:
    """Templates of one leaf, fed with its different lines in order."""

    def __init__(self, similarity: float, min_docs: int):
        self.similarity, self.min_docs = similarity, min_docs
        self.rows = np.zeros((0, 0), np.uint64)
        self.n = 0
        self.docs: list[set[int]] = []  # up to min_docs of each template
        self.first: list[tuple[int, int]] = []
        self.keys: list[int] = []
        self.of: list[int] = []

    def _template(self, words: np.ndarray) -> int:
        if self.n:
            same = (self.rows[: self.n] == words).sum(1)
            t = int(same.argmax())
            if same[t] >= self.similarity * len(words) - 1e-9:
                self.rows[t][self.rows[t] != words] = ANY
                return t
        if self.n == len(self.rows):
            grown = np.zeros((max(4, 2 * self.n), len(words)), np.uint64)
            if self.n:
                grown[: self.n] = self.rows
            self.rows = grown
        self.rows[self.n] = words
        self.n += 1
        return self.n - 1

    def add(self, key: int, doc: int, line: int, docs: np.ndarray, words: np.ndarray) -> None:
        t = self._template(words)
        if t == len(self.docs):
            self.docs.append(set())
            self.first.append((doc, line))
        if len(self.docs[t]) < self.min_docs:
            self.docs[t].update(docs.tolist())
        self.keys.append(key)
        self.of.append(t)

    def recurring(self) -> list[tuple[int, int, int]]:
        """(key, first document, first line) of the lines of recurring templates."""
        return [(k, *self.first[t]) for k, t in zip(self.keys, self.of, strict=True) if len(self.docs[t]) >= self.min_docs]


def _distinct(leaf, key, doc, line, most: int):
    """Order by (leaf, key, doc, line), where each different line begins, and which entries are among the first `most` documents of theirs."""
    order = np.lexsort((line, doc, key, leaf))
    leaf, key, doc = leaf[order], key[order], doc[order]
    new = np.append(True, (leaf[1:] != leaf[:-1]) | (key[1:] != key[:-1]))[: len(order)]
    fresh = new | np.append(True, doc[1:] != doc[:-1])[: len(order)]
    rank = np.cumsum(fresh)
    start = np.flatnonzero(new)
    rank -= np.repeat(rank[start] - 1, np.diff(np.append(start, len(order))))
    return order, start, fresh & (rank <= most)


LINE = pa.schema([("leaf", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("docs", pa.binary()), ("words", pa.binary())])
LINES = "leaf long, key long, doc_id long, line int, docs binary, words binary"


def recurring_lines(docs: DataFrame, depth: int = 4, similarity: float = 0.6, min_docs: int = 10, min_words: int = 1) -> DataFrame:
    """(leaf, key, doc_id, line) of every different line to drop, and the place of its template's first line, which stays."""
    spark, base = docs.sparkSession, texts(docs)
    n = partitions(spark)
    one = pa.schema([("leaf", pa.int64()), ("n", pa.int64())])

    def leaves(batches):
        for b in K.batches_by_bytes(batches, "text"):
            doc, _, leaf, *_ = lines_of(b.column("text"), depth, min_words)
            pair = np.lexsort((doc, leaf))
            doc, leaf = doc[pair], leaf[pair]
            fresh = np.append(True, (doc[1:] != doc[:-1]) | (leaf[1:] != leaf[:-1]))[: len(doc)]
            r = K.runs(leaf[fresh])
            yield batch_of(one, to_signed(leaf[fresh][r[:-1]]), np.diff(r))

    often = base.mapInArrow(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    packed = _bit_set(often.select(F.shiftrightunsigned("leaf", 64 - BITS).cast("int").alias("slot")).distinct())

    def send(batches):
        bits = np.unpackbits(packed.value).astype(bool)
        for b in K.batches_by_bytes(batches, "text"):
            doc, number, leaf, first, size, h = lines_of(b.column("text"), depth, min_words)
            hit = bits[(leaf >> np.uint64(64 - BITS)).astype(np.int64)]
            doc, number, leaf, first, size = doc[hit], number[hit], leaf[hit], first[hit], size[hit]
            if not len(doc):
                continue
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            key = keys_of(first, size, h)
            order, start, kept = _distinct(leaf, key, ids, number, min_docs)
            lead, raw = order[start], h.tobytes()
            some = ids[order][kept]
            cut = np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), start)))
            yield batch_of(
                LINE, to_signed(leaf[lead]), to_signed(key[lead]), ids[lead], number[lead], [some[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)],
                [raw[8 * f : 8 * (f + m)] for f, m in zip(first[lead].tolist(), size[lead].tolist(), strict=True)],
            )

    def merge(batches):
        """Rows of one line, which follow each other, as one."""
        now = held = None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in LINE.names), strict=True):
                if row[:2] == now:
                    if row[2:4] < held[0][2:4]:
                        held[0] = row
                    if len(held[1]) < min_docs:
                        held[1].update(np.frombuffer(row[4], np.int64).tolist())
                else:
                    if held:
                        out.append(held)
                    now, held = row[:2], [row, set(np.frombuffer(row[4], np.int64).tolist())]
            if out:
                yield _merged(out, min_docs)
        if held:
            yield _merged([held], min_docs)

    found = pa.schema([("leaf", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32())])

    def parse(batches):
        now, tree = None, None
        for b in batches:
            for leaf, key, doc, line, some, words in zip(*(b.column(c).to_pylist() for c in LINE.names), strict=True):
                if leaf != now:
                    if tree and (rows := tree.recurring()):
                        yield batch_of(found, [now] * len(rows), *zip(*rows, strict=True))
                    now, tree = leaf, Leaf(similarity, min_docs)
                tree.add(key, doc, line, np.frombuffer(some, np.int64), np.frombuffer(words, np.uint64))
        if tree and (rows := tree.recurring()):
            yield batch_of(found, [now] * len(rows), *zip(*rows, strict=True))

    each = base.mapInArrow(send, LINES).repartition(n, "leaf", "key").sortWithinPartitions("leaf", "key").mapInArrow(merge, LINES)
    return each.repartition(n, "leaf").sortWithinPartitions("leaf", "doc_id", "line", "key").mapInArrow(parse, "leaf long, key long, doc_id long, line int")


def _merged(rows: list, most: int) -> pa.RecordBatch:
    columns = list(zip(*(r for r, _ in rows), strict=True))
    columns[4] = [np.sort(np.fromiter(d, np.int64))[:most].tobytes() for _, d in rows]
    return batch_of(LINE, *columns)


def _bit_set(slots: DataFrame):
    bits = np.zeros(1 << BITS, bool)
    for r in slots.toLocalIterator():
        bits[r["slot"]] = True
    return slots.sparkSession.sparkContext.broadcast(np.packbits(bits))  # half a megabyte, whatever the data


class Dropper:
    """Which lines of a batch go, by the sorted hashes of the recurring ones."""

    def __init__(self, rows: list[tuple], depth: int, min_words: int):
        x = np.array(rows, np.int64).reshape(-1, 4)
        x = x[np.lexsort((x[:, 0], x[:, 1].view(np.uint64)))]
        self.leaf, self.key, self.doc, self.line = x[:, 0].view(np.uint64).copy(), x[:, 1].view(np.uint64).copy(), x[:, 2].copy(), x[:, 3].copy()
        self.depth, self.min_words = depth, min_words

    def lines(self, column, ids: np.ndarray) -> dict[int, set[int]]:
        """Lines to drop of each text that has any."""
        doc, number, leaf, first, size, h = lines_of(column, self.depth, self.min_words)
        if not len(doc) or not len(self.key):
            return {}
        key = keys_of(first, size, h)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        for _ in range(4):  # keys of two leaves that are equal stand side by side
            move = (self.key[at] == key) & (self.leaf[at] != leaf) & (at + 1 < len(self.key))
            at[move] += 1
        hit = (self.key[at] == key) & (self.leaf[at] == leaf) & ~((self.doc[at] == ids[doc]) & (self.line[at] == number))
        out: dict[int, set[int]] = {}
        for d, k in zip(doc[hit].tolist(), number[hit].tolist(), strict=True):
            out.setdefault(d, set()).add(k)
        return out


def without(text: str, lines: set[int]) -> str:
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lines)


def _rewritten(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, depth: int = 4, min_words: int = 1, **how) -> DataFrame:
    """docs with its texts cut and a last column, the number of lines dropped."""
    spark = docs.sparkSession
    found = table(recurring_lines(docs, depth=depth, min_words=min_words, **how), "recurring-lines")
    if found.count() > broadcast_rows:
        return _joined(docs, found, depth, min_words)
    dropper = Dropper([tuple(r) for r in found.toLocalIterator()], depth, min_words)
    shared = spark.sparkContext.broadcast(dropper)  # at most broadcast_rows rows
    names = docs.columns
    text, key = names.index("text"), names.index("doc_id")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField("__granary_lines", T.IntegerType())])

    def run(batches):
        for b in batches:
            named = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
            for part in K.batches_by_bytes([named], f"c{text}"):
                column, ids = part.column(text), part.column(key).cast(pa.int64())
                none = np.asarray(ids.is_null())
                gone = shared.value.lines(column, ids.fill_null(0).to_numpy(zero_copy_only=False))
                gone = {d: lines for d, lines in gone.items() if not none[d]}
                count = np.zeros(part.num_rows, np.int32)
                columns = part.columns
                if gone:
                    where = np.array(sorted(gone))
                    count[where] = [len(gone[d]) for d in where.tolist()]
                    mask = np.zeros(part.num_rows, bool)
                    mask[where] = True
                    columns[text] = pc.replace_with_mask(column, pa.array(mask), pa.array([without(column[d].as_py(), gone[d]) for d in where.tolist()], column.type))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count)], names=[*named.schema.names, "__granary_lines"])

    out = docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)
    return out.toDF(*names, "__granary_lines")


def _joined(docs: DataFrame, found: DataFrame, depth: int, min_words: int) -> DataFrame:
    """The same where the recurring lines are too many to send: lines that may be among them are joined to them, and documents to their lines."""
    packed = _bit_set(found.select(F.shiftrightunsigned("key", 64 - BITS).cast("int").alias("slot")).distinct())
    out = pa.schema([("leaf", pa.int64()), ("key", pa.int64()), ("__granary_id", pa.int64()), ("__granary_line", pa.int32())])

    def candidates(batches):
        bits = np.unpackbits(packed.value).astype(bool)
        for b in K.batches_by_bytes(batches, "text"):
            doc, number, leaf, first, size, h = lines_of(b.column("text"), depth, min_words)
            key = keys_of(first, size, h)
            hit = np.flatnonzero(bits[(key >> np.uint64(64 - BITS)).astype(np.int64)])
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield batch_of(out, to_signed(leaf[hit]), to_signed(key[hit]), ids[doc[hit]], number[hit])

    lines = texts(docs).mapInArrow(candidates, "leaf long, key long, __granary_id long, __granary_line int")
    gone = lines.join(found, ["leaf", "key"]).where("not (doc_id = __granary_id and line = __granary_line)")
    gone = gone.groupBy("__granary_id").agg(F.collect_set("__granary_line").alias("__granary_gone"))
    wide = docs.join(gone, docs["doc_id"].cast("long") == F.col("__granary_id"), "left")
    hit = F.col("__granary_gone").isNotNull()
    flags = F.map_from_entries(F.transform("__granary_gone", lambda x: F.struct(x, F.lit(True))))
    kept = F.expr(r"array_join(filter(split(text, '\n', -1), (x, i) -> __granary_flags[i] is null), '\n')")
    wide = wide.withColumn("__granary_flags", flags)
    return wide.select(*(F.when(hit, kept).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns), F.coalesce(F.when(hit, F.size("__granary_gone")), F.lit(0)).alias("__granary_lines"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, lines_dropped, text) of every row of docs."""
    out = _rewritten(docs.select(docs["doc_id"], docs["text"]), **how)
    return out.select("doc_id", F.col("__granary_lines").alias("lines_dropped"), "text")


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """docs without its recurring lines; a text that loses all its words goes, and n_chars follows the text."""
    columns = docs.columns
    hit = F.col("__granary_lines") > 0
    out = _rewritten(docs, **how)
    out = out.where(~hit | F.expr(r"text rlike '[^\\x09-\\x0d\\x1c-\\x20]'"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))
