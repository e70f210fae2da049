"""Streams over folders that grow: exact and near dedup, byte budgets, counters.

All take what is new since the last run and stop (`availableNow`), so "again with new
data" is calling them again with the same checkpoint. State is in tables beside the
output; a batch that is run twice after a failure writes the same rows once, because a
batch's folder is named by its number and overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.quality import is_good, with_quality
from granary.operators.dedup import _masks, hashed, near_duplicates
from granary.operators.ordered import within_budget


def read(spark: SparkSession, path: str, schema: str = "doc_id long, text string, source string", fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def exact_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first document of each content; the state keeps every content hash, as the batch operator does."""
    return stream.withColumn("content_sha256", T.content_sha256(F.coalesce(F.col(text), F.lit("")))).dropDuplicates(["content_sha256"])


def gated(stream: DataFrame, min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """Rows of the stream with quality columns that pass length and quality; no state."""
    wide = with_quality(stream)
    return wide.where((F.col("word_count") >= min_words) & is_good(threshold))


def counters(stream: DataFrame, by: str = "source") -> DataFrame:
    """(by, docs, words) so far, for the complete or update output mode."""
    return stream.groupBy(by).agg(F.count("*").alias("docs"), F.sum(T.word_count(F.coalesce(F.col("text"), F.lit("")))).alias("words"))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) and len(fs.listStatus(p)) else None


def _before(index: DataFrame | None, batch: int) -> DataFrame | None:
    """What batches before this one wrote: after a failure the batch's own rows may be there already."""
    return None if index is None else index.where(F.col("batch") < batch)


def run(stream: DataFrame, each, checkpoint: str) -> None:
    """Runs `each(batch, number)` over all that is new, then stops."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def near_dedup(stream: DataFrame, index: str, out: str, checkpoint: str, key: str = "doc_id", distance: int = 3) -> None:
    """Writes the documents that stay to `out`, and their hashes to `index`, batch by batch.

    A document goes if one that stayed in an earlier batch has its content or lies within
    the distance, or, within its batch, as `near_duplicates` decides.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        known = _before(_table(spark, index), number)
        h = hashed(batch, key)
        fresh = h
        if known is not None:
            same = known.select("content_sha256").distinct()
            fresh = h.join(same, "content_sha256", "left_anti")
            slots = lambda c: F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col(c).bitwiseAND(F.lit(m)).alias("slot")) for k, m in enumerate(_masks(distance)))))
            mine = fresh.select(key, F.col("simhash").alias("__s")).withColumn("b", slots("__s")).select(key, "__s", "b.*")
            theirs = known.select(F.col("simhash").alias("__k")).distinct().withColumn("b", slots("__k")).select("__k", "b.*")
            near = mine.join(theirs, ["band", "slot"]).where(F.bit_count(F.col("__s").bitwiseXOR(F.col("__k"))) <= distance).select(key).distinct()
            fresh = fresh.join(near, key, "left_anti")
        rest = batch.join(fresh.select(key).distinct(), key, "left_semi")
        stay = near_duplicates(rest, key, "text", distance).where("duplicate_type is null").select(key)
        kept = rest.join(stay, key, "left_semi").dropDuplicates([key])
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        hashed(spark.read.parquet(f"{out}/batch={number}"), key).write.mode("overwrite").parquet(f"{index}/batch={number}")

    run(stream, each, checkpoint)


def byte_budget(stream: DataFrame, budget: int, out: str, checkpoint: str, order: list[str], text: str = "text") -> None:
    """Writes documents to `out` until their bytes reach the budget; the one that crosses it is kept, later batches add nothing."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        had = _before(_table(spark, out), number)
        used = 0 if had is None else had.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]  # one number
        if used < budget:
            within_budget(batch, budget - used, order, text).drop("bytes_before").write.mode("overwrite").parquet(f"{out}/batch={number}")

    run(stream, each, checkpoint)


def append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes the rows of a stream as Parquet, all that is new at a time."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
