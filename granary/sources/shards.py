"""Binary token shards: written from pieces, read back with all that the manifest claims checked."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTHS = {"uint16": 2, "int32": 4, "int64": 8}
FORMAT = "granary-shards-1"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save(pieces: DataFrame, path: str, dtype: str = "uint16", within: tuple[str, ...] = ("split", "grp")) -> DataFrame:
    """Pieces (split, grp, shard_id, at, tokens) as Parquet under split and grp; returns (split, grp, shard_id, tokens, sha256).

    Tokens stay arrays; a shard is a row of its bytes, so a lost task costs its shards only.
    An id that doesn't fit the type raises.
    """
    top = (1 << 16) - 1 if dtype == "uint16" else (1 << (8 * WIDTHS[dtype] - 1)) - 1
    keys = [*within, "shard_id"]

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        x = np.concatenate([np.asarray(t, np.int64) for t in part["tokens"]])
        if len(x) and (x.min() < 0 or x.max() > top):
            raise ValueError(f"a token id doesn't fit {dtype}")
        return pd.DataFrame([[*part[keys].iloc[0], len(x), x.astype(dtype).tobytes()]], columns=[*keys, "tokens", "data"])

    kinds = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys)
    shards = pieces.groupBy(*keys).applyInPandas(join, f"{kinds}, tokens long, data binary")  # a group is one shard, whose size is a setting
    shards.write.mode("overwrite").partitionBy(*within).parquet(path)
    back = pieces.sparkSession.read.parquet(path)
    return back.select(*(F.col(w).cast("string") for w in within), "shard_id", "tokens", F.sha2("data", 256).alias("sha256"))


def manifest(entries: DataFrame, vocab_size: int, dtype: str = "uint16", **more) -> dict:
    """The manifest of saved shards: totals and an entry for each shard, sorted."""
    rows = [r.asDict() for r in entries.orderBy("split", "grp", "shard_id").collect()]  # a row a shard
    out = {"format_version": FORMAT, "tokenizer_vocab_size": vocab_size, "dtype": dtype, **more}
    for split in sorted({r["split"] for r in rows}):
        mine = [r for r in rows if r["split"] == split]
        out[split] = {"total_tokens": sum(r["tokens"] for r in mine), "shards": [{k: r[k] for k in ("grp", "shard_id", "tokens", "sha256")} for r in mine]}
    return out


def write_manifest(spark: SparkSession, path: str, data: dict) -> None:
    write_text(spark, f"{path}/_manifest.json", json.dumps(data, ensure_ascii=False, indent=1, allow_nan=False))


def load(spark: SparkSession, path: str, split: str = "train", vocab_size: int | None = None, verify_hashes: bool = False) -> DataFrame:
    """(grp, shard_id, ids) of the shards of a split; raises if they aren't what the manifest says."""
    if split not in ("train", "eval"):
        raise ValueError("split must be train or eval")
    data = json.loads(read_text(spark, f"{path}/_manifest.json"))
    if split not in data:
        raise ValueError(f"the manifest has no {split}")
    if data.get("dtype") not in WIDTHS:
        raise ValueError(f"unknown dtype {data.get('dtype')!r}")
    if vocab_size is not None and data.get("tokenizer_vocab_size") != vocab_size:
        raise ValueError(f"vocabulary sizes differ: {data.get('tokenizer_vocab_size')} in the manifest, {vocab_size} asked for")
    rows = spark.read.parquet(path).where(F.col("split") == split).withColumn("grp", F.col("grp").cast("string"))
    meta = data[split]
    declared = spark.createDataFrame([(s["grp"], s["shard_id"], s["tokens"], s["sha256"]) for s in meta["shards"]], "grp string, shard_id long, d_tokens long, d_sha string")
    actual = rows.select("grp", F.col("shard_id").cast("long").alias("shard_id"), (F.octet_length("data") / WIDTHS[data["dtype"]]).alias("a_tokens"), F.sha2("data", 256).alias("a_sha") if verify_hashes else F.lit(None).cast("string").alias("a_sha"))
    met = declared.join(actual, ["grp", "shard_id"], "full_outer")
    wrong = (
        F.when(F.col("a_tokens").isNull(), "missing").when(F.col("d_tokens").isNull(), "not in the manifest").when(F.col("a_tokens") != F.col("d_tokens"), "token count differs")
        .when(F.lit(verify_hashes) & F.col("d_sha").isNull(), "no hash").when(F.lit(verify_hashes) & (F.col("a_sha") != F.col("d_sha")), "hash differs")
    )
    bad = met.select("grp", "shard_id", wrong.alias("why")).where("why is not null").orderBy("grp", "shard_id").limit(20).collect()
    if bad:
        raise ValueError(f"shards aren't as the manifest says: {[tuple(r) for r in bad]}")
    if meta["total_tokens"] != sum(s["tokens"] for s in meta["shards"]):
        raise ValueError(f"the {split} total differs from its shards")
    return decoded(rows.select("grp", "shard_id", "data"), data["dtype"])


def decoded(rows: DataFrame, dtype: str) -> DataFrame:
    """`rows` with the bytes in `data` as an array of ids."""
    keep = [c for c in rows.columns if c != "data"]

    def run(batches):
        for b in batches:
            b["ids"] = [np.frombuffer(x, dtype).astype(np.int32) for x in b.pop("data")]
            yield b

    return rows.select(*keep, "data").mapInPandas(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"]))


def bin_file(spark: SparkSession, path: str, dtype: str = "int32") -> DataFrame:
    """(path, ids) of flat binary token files; a length that doesn't fit the type raises."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.when(F.col("length") % WIDTHS[dtype] == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("length doesn't fit: "), "path")).cast("binary")).alias("data"))
    return decoded(raw, dtype)
