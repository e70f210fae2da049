"""Helpers of the operators in this subpackage: inputs, partition counts, packed shuffles.

A *packed* shuffle sends one row (part, payload) per map batch and target
partition instead of one row per item; payloads are numpy arrays in sorted order,
stored as deltas and compressed, which takes about a third of the bytes of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import kernels as K

MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nulls: bool = False) -> DataFrame:
    """Just (doc_id, text) under these names, whatever else the input has; rows without an id are left out unless `nulls`."""
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return out if nulls else out.where("doc_id is not null")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_part(df: DataFrame, n: int) -> DataFrame:
    """Rows with their `part` in 0..n-1, each in the partition of that number."""
    return df.repartitionById(n, F.col("part"))


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Partition of each 64-bit hash: ranges of its upper 32 bits, so sorted hashes have sorted parts."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of an array; byte planes are stored apart, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes() if len(x) else b""


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype) if b else np.zeros(0, dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length in one payload; the first is sorted uint64 and stored as deltas."""
    first = arrays[0]
    delta = np.diff(first, prepend=np.uint64(0))
    head = np.array([len(first)], np.int64).tobytes()
    return zstandard.compress(head + squeeze(delta) + b"".join(map(squeeze, arrays[1:])), 1)


def unpack(payload: bytes, *dtypes) -> list[np.ndarray]:
    raw = memoryview(zstandard.decompress(payload))
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for k, d in enumerate((np.uint64, *dtypes)):
        size = np.dtype(d).itemsize * n
        x = unsqueeze(bytes(raw[at : at + size]), d)
        out.append(np.cumsum(x, dtype=np.uint64) if not k else x)
        at += size
    return out


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def chunks(docs: DataFrame, most: int = 8 << 20) -> DataFrame:
    """(chunk, blob): the texts of `docs` in compressed pieces of about `most` bytes, spread by chunk number.

    Passes that ask the whole corpus something and need the texts again for the answer
    start from this one exchange, which Spark reuses within a query.
    """
    out, inner = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())]), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))  # can't be pickled
        task = TaskContext.get().partitionId()
        for k, b in enumerate(K.batches_by_bytes(batches, "text", most)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner, options=options) as w:
                w.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text").cast(pa.string())], schema=inner))
            yield batch_of(out, [task << 32 | k], [sink.getvalue().to_pybytes()])

    return texts(docs).mapInArrow(run, "chunk long, blob binary").repartition(partitions(docs.sparkSession), "chunk")


def opened(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def split_sorted(h: np.ndarray, n: int):
    """(part, slice) of every part that holds any of the sorted hashes."""
    part = part_of(h, n)
    r = K.runs(part)
    for i, j in zip(r[:-1], r[1:], strict=True):
        yield int(part[i]), slice(i, j)


def with_totals(pieces: DataFrame, keys, n: int) -> DataFrame:
    """(chunk, blob, replies): each chunk with the corpus-wide totals of its keys.

    `keys(batch)` lists (sorted distinct 64-bit keys, counts), one pair a kind. Keys go to
    their partition in packed rows, are added up there, and each packed row is answered
    by the totals in its own order: see `totals_of`.
    """
    sent = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
    kinds = "part int, chunk long, kind int, payload binary"

    def send(batches):
        for b in batches:
            for c, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                rows = [(p, kind, pack(h[s], count[s].astype(np.uint32))) for kind, (h, count) in enumerate(keys(opened(blob.as_py()))) for p, s in split_sorted(h, n)]
                if rows:
                    p, kind, payload = zip(*rows, strict=True)
                    yield batch_of(sent, p, [c] * len(p), kind, payload)

    def add(batches):
        rows: dict[int, list] = {}
        for b in batches:
            for p, c, kind, payload in zip(*(b.column(x).to_pylist() for x in sent.names), strict=True):
                rows.setdefault(kind, []).append((p, c, payload))
        for kind, got in rows.items():
            h, count = map(np.concatenate, zip(*(unpack(x[2], np.uint32) for x in got), strict=True))
            order = np.argsort(h)
            r = K.runs(h[order])
            total = np.empty(len(h), np.uint32)
            total[order] = np.repeat(np.minimum(np.add.reduceat(count[order].astype(np.int64), r[:-1]), 2**32 - 1).astype(np.uint32), np.diff(r))
            at = 0
            for p, c, payload in got:
                size = int(np.frombuffer(zstandard.decompress(payload)[:8], np.int64)[0])
                yield batch_of(sent, [p], [c], [kind], [zstandard.compress(squeeze(total[at : at + size]), 1)])
                at += size

    replies = by_part(pieces.mapInArrow(send, kinds), n).mapInArrow(add, kinds)
    replies = replies.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "payload")).alias("replies"))
    return pieces.join(replies, "chunk", "left")


def totals_of(replies, kinds: int) -> list[np.ndarray]:
    """The totals of each kind, in the order of the keys."""
    out: list[list] = [[np.zeros(0, np.uint32)] for _ in range(kinds)]
    for r in sorted(replies or [], key=lambda r: (r["kind"], r["part"])):
        out[r["kind"]].append(unsqueeze(zstandard.decompress(r["payload"]), np.uint32))
    return [np.concatenate(x) for x in out]
