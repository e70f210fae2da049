"""From raw documents to packed sequences: quality, line dedup, near duplicates, decontamination, packing.

Every stage works on all documents that the one before kept and takes effect on them:
rejected documents go, recurring lines are cut, one document of each near-duplicate
group stays (the one of the least id), leaked documents go, the rest is packed.

Defined results: documents whose text is null or has no word go in the first stage, and
those that lose all their words in the second. Rows without an id pass the first two
stages, stand for their text in the third (a row with an id goes before them), are judged
like any other in the fourth, and get no place in the last, which names documents by id. Of
rows that repeat an id, one is left after the third stage, with the greatest text. Ties
go to the least id. An empty table, or empty labels or benchmark, give what the stages
that need none of them make. All columns of documents pass through until the last stage,
whatever their names; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import jaccard_join, line_templates, lsa_decontaminate, packing, quality_pu
from granary.llm.common import read
from granary.plans.lineage import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsa_decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: A fitted network, template trees and a latent space are beyond SQL; tests/llm compares each stage with plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin_group, bin_id, doc_id, chunk, doc_start, length, bin_start) of all that the stages keep."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs
