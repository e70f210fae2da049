"""Fingerprints of data: files by name, size and content, and tables by rows in order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.lineage import table

SUFFIXES = (".json", ".jsonl", ".txt", ".bin", ".npy", ".npz")
MODES = ("auto", "manifest", "full", "metadata", "off")
MANIFESTS = ("manifest.json", "corpus_manifest.json")


def file_entries(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, content: bool = True) -> DataFrame:
    """(path, bytes, sha256) of the files below `path`, named from there; hidden ones are left out. Without `content`, no file is opened."""
    glob = "*{" + ",".join(suffixes) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = path.rstrip("/").removeprefix("file:") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/+", "/"), r"\A\Q" + root + r"\E", "")
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    named = raw.select(relative.alias("path"), F.col("length").alias("bytes"), digest.alias("sha256"))
    return named.where(~F.regexp_like("path", F.lit(r"(?:\A|/)\.")))


def fingerprint(spark: SparkSession, path: str, mode: str = "auto") -> dict:
    """(mode, sha256, files, entries) over the sorted entries: their names, sizes and (but for metadata) hashes.

    auto takes the manifests if there are any, else all files in full; off takes none.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "off":
        return {"mode": "off", "sha256": None, "files": 0, "entries": []}
    files = file_entries(spark, path, content=mode != "metadata")
    rows = files.where(F.col("path").isin(*MANIFESTS)) if mode in ("auto", "manifest") else files
    got = rows.orderBy("path").collect()  # a row a file
    if mode == "manifest" and not got:
        raise FileNotFoundError(f"no manifest in {path}")
    used = mode
    if mode == "auto":
        used = "manifest" if got else "full"
        if not got:
            got = files.orderBy("path").collect()
    if not got:
        raise ValueError(f"no data file in {path}")
    digest = hashlib.sha256()
    for r in got:
        digest.update(("\0".join([r["path"], str(r["bytes"]), *([r["sha256"]] if r["sha256"] else [])]) + "\n").encode())
    return {"mode": used, "sha256": digest.hexdigest(), "files": len(got), "entries": [r.asDict() for r in got]}


def row_hash(*columns: Column) -> Column:
    """SHA-256 of texts with a NUL between them; null counts as empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), "\0"), 256)


def table_fingerprint(df: DataFrame, order: list[str], columns: list[str], parts: int | None = None) -> str:
    """SHA-256 over the rows in order: of the row hashes of each block, then of the blocks' hashes.

    Blocks hold the rows whose number in the order shares the upper digits, so the answer
    doesn't depend on partitions; `order` must be unique for it to be the same each time.
    """
    from granary.operators.ordered import prefix_sum

    hashed = df.select(*order, row_hash(*map(F.col, columns)).alias("__h"), F.lit(1).alias("__one"))
    lined = prefix_sum(hashed, "__one", order, None, "__n", parts)
    for _ in range(8):  # 4096 at a time: eight levels are more than any table has
        block = lined.groupBy(F.expr("__n div 4096").alias("__n")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__h"))), lambda x: x["__h"]), ""), 256).alias("__h"))
        lined = table(block, "fingerprint")
        if lined.count() <= 1:
            break
    top = lined.first()
    return top["__h"] if top else hashlib.sha256(b"").hexdigest()


def ordered_corpus_hash(docs: DataFrame, order: list[str], domain: str = "domain", text: str = "text") -> str:
    """SHA-256 over `domain NUL text LF` of all documents in order, streamed a partition at a time; for sets that are analysed, not for corpora."""
    digest = hashlib.sha256()
    for r in docs.orderBy(*order).select(domain, text).toLocalIterator():
        digest.update(f"{r[domain]}\0{r[text]}\n".encode())
    return digest.hexdigest()
