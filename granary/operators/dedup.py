"""Exact and near duplicates in the order of a key, the first of its kind staying.

Near duplicates are SimHashes within `distance` bits (3 at most). Six blocks of bits, three
at a time, make the candidates: two hashes that differ in three bits agree in three blocks,
so none is lost, and 32 bits to agree in keep chance meetings few at any size. As only documents that stay count as neighbours, the answer is the first maximal
independent set in key order; it is found in rounds over the pairs alone, each round a
written table.

Documents without a key are left out of these operators.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.hashing import hex64, simhash64
from granary.plans.lineage import table


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_sha256, key of the first, copies); partial aggregation, so a hot content costs one row a task."""
    return docs.groupBy(T.content_sha256(F.col(text)).alias("content_sha256")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def first_wins(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content_sha256) of the first document of each content."""
    return exact_groups(docs, key, text).select(key, "content_sha256")


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "blake2b") -> DataFrame:
    """(key, content_sha256, simhash) of documents with a key; null texts count as empty."""
    c = F.coalesce(F.col(text), F.lit(""))
    return docs.where(F.col(key).isNotNull()).select(F.col(key), T.content_sha256(c).alias("content_sha256"), simhash64(T.token_string(c), kind).alias("simhash"))


def near_pairs(reps: DataFrame, distance: int = 3) -> DataFrame:
    """(x, y), x < y, of the different values of `simhash` within the distance.

    A hash that a third of the rows share is one value here and meets others once. Both
    sides are shuffled: their size is told from before the rows of the indexes are made, so
    a plan of its own choice would gather 20 rows a hash on the driver to broadcast them.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    nodes = reps.select("simhash").distinct()
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.col("simhash").bitwiseAND(F.lit(mask)).alias("slot")) for k, mask in enumerate(_masks(distance))))
    wide = nodes.select("simhash", F.explode(keys).alias("k")).select("simhash", "k.band", "k.slot")
    left, right = wide.alias("l"), wide.alias("r")
    apart = F.bit_count(F.col("l.simhash").bitwiseXOR(F.col("r.simhash")))
    met = left.join(right.hint("merge"), (F.col("l.band") == F.col("r.band")) & (F.col("l.slot") == F.col("r.slot")) & (F.col("l.simhash") < F.col("r.simhash")) & (apart <= distance))
    return met.select(F.col("l.simhash").alias("x"), F.col("r.simhash").alias("y")).distinct()


def _masks(distance: int) -> list[int]:
    """Bits kept by each index: all but `distance` of twice as many blocks (of 4 at least), as signed numbers."""
    blocks = max(4, 2 * distance)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    full = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    whole = [sum(x) for x in combinations(full, blocks - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in whole]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, kind: str = "blake2b") -> DataFrame:
    """(key, content_sha256, simhash64, duplicate_type): null for documents that stay, else exact or near.

    A document is exact if one that stays has its content, near if one that stays and comes
    before it lies within the distance. Rows that repeat a key are one document, with the
    least content hash.
    """
    base = table(hashed(docs, key, text, kind).groupBy(key).agg(F.min(F.struct("content_sha256", "simhash")).alias("h")).select(key, "h.content_sha256", "h.simhash"), "dedup-base")
    kept = independent_set(base, key, distance)
    first = base.groupBy("content_sha256").agg(F.min(key).alias("__first"))
    wide = base.join(first, "content_sha256").join(kept.select(F.col(key).alias("__first"), F.lit(True).alias("__kept")), "__first", "left")
    kind_of = F.when(F.col("__kept") & (F.col(key) == F.col("__first")), F.lit(None).cast("string")).when(F.col("__kept"), F.lit("exact")).otherwise("near")
    return wide.select(key, "content_sha256", hex64(F.col("simhash")).alias("simhash64"), kind_of.alias("duplicate_type"))


def independent_set(base: DataFrame, key: str, distance: int = 3) -> DataFrame:
    """(key) of the documents that stay, of (key, content_sha256, simhash).

    Of equal contents only the first can stay, and of equal hashes too: all its later ones
    have it as a neighbour if it stays, and share its neighbours if it doesn't - but one of
    them may come before a neighbour that keeps the first out, never the reverse, as that
    neighbour came even earlier. So one node a hash, ordered by its least key, is enough.
    """
    nodes = table(base.groupBy("simhash").agg(F.min(key).alias(key)), "dedup-nodes")
    pairs = near_pairs(nodes, distance)
    a, b = nodes.select(F.col("simhash").alias("x"), F.col(key).alias("ka")), nodes.select(F.col("simhash").alias("y"), F.col(key).alias("kb"))
    edges = table(pairs.join(a, "x").join(b, "y").select(F.least("ka", "kb").alias("early"), F.greatest("ka", "kb").alias("late")), "dedup-edges")
    out = None  # nodes that are found not to stay
    open_edges = edges
    while not open_edges.isEmpty():
        late = open_edges.select(F.col("late").alias("n")).distinct()
        sure = open_edges.select(F.col("early").alias("n")).distinct().join(late, "n", "left_anti")  # nobody before them is undecided
        gone = table(open_edges.join(sure.withColumnRenamed("n", "early"), "early", "left_semi").select(F.col("late").alias("n")).distinct(), "dedup-gone")
        out = gone if out is None else out.unionByName(gone)
        still = open_edges.join(gone.withColumnRenamed("n", "early"), "early", "left_anti").join(gone.withColumnRenamed("n", "late"), "late", "left_anti")
        open_edges = table(still, "dedup-edges")
    keys = nodes.select(key)
    return keys if out is None else keys.join(out.withColumnRenamed("n", key), key, "left_anti")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without exact and near duplicates; of rows that repeat a key one stays."""
    stay = near_duplicates(docs, key, text, **how).where("duplicate_type is null").select(key)
    one = Window.partitionBy(key).orderBy(T.content_sha256(F.coalesce(F.col(text), F.lit(""))))
    return docs.join(stay, key, "left_semi").withColumn("__row", F.row_number().over(one)).where("__row = 1").drop("__row")
