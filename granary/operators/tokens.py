"""From documents to framed token streams, splits, shards, blocks and batches.

Documents come as rows with an order key and an array of token ids. Nothing is exploded
to one row a token: documents are cut at the shard and block borders they cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.ordered import prefix_sum, range_join

FLOOR = 1_000_000


def framed(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def split_bucket(key: Column, seed: int = 42) -> Column:
    """A number below a million that depends on the seed and the key only."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000))


def with_split(docs: DataFrame, eval_ratio: float = 0.005, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """docs with `split`: eval with the given chance, else train; a null key counts as the empty one."""
    bucket = split_bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    return docs.withColumn("split", F.when(bucket < int(eval_ratio * 1_000_000), "eval").otherwise("train"))


def content_split(docs: DataFrame, eval_ratio: float = 0.05, seed: int = 42, text: str = "text") -> DataFrame:
    """The same by content, so that copies fall on one side."""
    bucket = split_bucket(T.hash_form(F.coalesce(F.col(text), F.lit(""))), seed)
    return docs.withColumn("split", F.when(bucket < int(eval_ratio * 1_000_000), "eval").otherwise("train"))


def eval_shard_size(shard_size: int, least: int = FLOOR) -> int:
    return max(shard_size // 10, least)


def token_offsets(docs: DataFrame, n_tokens: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """docs with `first_token`, where each begins in the stream of its group."""
    return prefix_sum(docs, n_tokens, order, within, "first_token")


def shard_pieces(docs: DataFrame, shard_size: int, order: list[str], within: list[str] | None = None, ids: str = "ids", eval_size: int | None = None) -> DataFrame:
    """(within, shard_id, at, tokens): what each document puts in each shard it reaches into, and where.

    Shards of a group are filled in document order; documents may straddle them, and the
    last one may be short. With `eval_size`, groups whose `split` is eval have their own size.
    """
    within = within or []
    at = token_offsets(docs.withColumn("__n", F.size(ids).cast("long")).where("__n > 0"), "__n", order, within)
    size = F.lit(shard_size) if eval_size is None else F.when(F.col("split") == "eval", F.lit(eval_size)).otherwise(F.lit(shard_size))
    at = at.withColumn("__size", size.cast("long"))
    cut = at.withColumn("shard_id", F.explode(F.sequence(F.expr("first_token div __size"), F.expr("(first_token + __n - 1) div __size"))))
    begin = F.greatest(F.col("shard_id") * F.col("__size"), F.col("first_token"))
    end = F.least((F.col("shard_id") + 1) * F.col("__size"), F.col("first_token") + F.col("__n"))
    piece = F.slice(ids, (begin - F.col("first_token") + 1).cast("int"), (end - begin).cast("int"))
    return cut.select(*within, "shard_id", (begin - F.col("shard_id") * F.col("__size")).alias("at"), piece.alias("tokens"))


def shard_manifest(pieces: DataFrame, within: list[str] | None = None, block: int = 2048) -> DataFrame:
    """(within, shard_id, tokens, blocks): blocks of `block` tokens and one more to predict; a rest is dropped."""
    total = pieces.groupBy(*(within or []), "shard_id").agg(F.sum(F.size("tokens")).alias("tokens"))
    return total.withColumn("blocks", F.greatest(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block}")))


def blocks(pieces: DataFrame, length: int, within: list[str] | None = None) -> DataFrame:
    """(within, block_id, input_ids, labels) of pieces (within, at, tokens) of token streams.

    Block i holds tokens iL to iL+L of its stream: the first L are inputs, the last L their
    labels, so neighbours share a token. Streams of L tokens or fewer have no block.
    """
    within = within or []
    last = "at + size(tokens) - 1"
    cut = pieces.withColumn("block_id", F.explode(F.expr(f"sequence(greatest(at - 1, 0) div {length}, ({last}) div {length})")))
    begin, end = F.greatest(F.col("block_id") * length, F.col("at")), F.least(F.col("block_id") * length + length, F.expr(last))
    piece = cut.select(*within, "block_id", begin.alias("__b"), F.slice("tokens", (begin - F.col("at") + 1).cast("int"), (end - begin + 1).cast("int")).alias("__t"))
    whole = piece.groupBy(*within, "block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__t"))), lambda x: x["__t"])).alias("__t")).where(F.size("__t") == length + 1)
    return whole.select(*within, "block_id", F.slice("__t", 1, length).alias("input_ids"), F.slice("__t", 2, length).alias("labels"))


def pack(docs: DataFrame, length: int, order: list[str], within: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """Blocks of the concatenated documents of each group."""
    at = token_offsets(docs.withColumn("__n", F.size(ids).cast("long")).where("__n > 0"), "__n", order, within)
    return blocks(at.select(*(within or []), F.col("first_token").alias("at"), F.col(ids).alias("tokens")), length, within)


def group_ranges(manifest: DataFrame, group: str = "grp", order: list[str] | None = None) -> DataFrame:
    """(group, shard_id, start, end): the block numbers of each shard in one numbering over all; shards without a block are left out."""
    order = order or [group, "shard_id"]
    out = prefix_sum(manifest.where("blocks > 0"), "blocks", order, None, "start")
    return out.select(group, "shard_id", "start", (F.col("start") + F.col("blocks")).alias("end"))


def locate_blocks(wanted: DataFrame, ranges: DataFrame, index: str = "block_index") -> DataFrame:
    """wanted block numbers with their shard and the block within it."""
    return range_join(wanted, ranges, index, "start", "end").withColumn("local_block", F.col(index) - F.col("start")).drop("start", "end")


def batches(samples: DataFrame, size: int, index: str, item: str, drop_last: bool = True) -> DataFrame:
    """(batch, items) of samples numbered from 0; a short last batch goes if `drop_last`."""
    made = samples.groupBy(F.expr(f"`{index}` div {size}").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, item))), lambda x: x[item]).alias("items"))
    return made.where(F.size("items") == size) if drop_last else made


def padded(docs: DataFrame, max_length: int | None = None, pad: int = 0, ids: str = "ids", batch: list[str] | None = None) -> DataFrame:
    """docs with `ids` cut and padded to the longest of their batch, and `mask`, 1 for tokens and 0 for padding."""
    cut = docs.withColumn(ids, F.slice(ids, 1, max_length)) if max_length else docs
    most = Window.partitionBy(*(batch or [F.lit(1)]))
    if batch is None:
        longest = F.lit(int(cut.agg(F.max(F.size(ids))).first()[0] or 0))  # one number, so no window over everything
    else:
        longest = F.max(F.size(ids)).over(most)
    wide = cut.withColumn("__gap", longest - F.size(ids))
    return wide.withColumns({ids: F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("__gap"))), "mask": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("__gap")))}).drop("__gap")


def group_docs(docs: DataFrame, groups: list[str], group: str = "grp") -> DataFrame:
    """(group, docs) of the train documents; raises if one of the groups has none."""
    found = docs.where("split = 'train'").groupBy(group).agg(F.count("*").alias("docs"))
    have = {r[0] for r in found.select(group).collect()}  # a row a group of the configuration
    if missing := [g for g in groups if g not in have]:
        raise ValueError(f"groups without a train document: {missing}")
    return found
