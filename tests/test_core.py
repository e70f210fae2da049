import pytest

from granary.plans.catalog import ORACLES, QUERIES
from tests.compare import both

DIR = "/root/testdata/sf0.001"
#: Held against plain Python elsewhere: no SQL function does what they do.
WITHOUT_SQL = {"bootstrap_ci", "clean_pipeline", "cleaner_funnel", "crawl", "mixture_sample", "near_duplicates", "page_links", "page_main_text"}


def test_every_query_has_sql_or_another_test():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, sql = both(spark, QUERIES[name], ORACLES[name], DIR)
    assert ours == sql


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200


def test_no_single_partition_on_documents(spark):
    """Of offsets, shards and blocks only the sums of ranges, a row each, come into one partition."""
    for name in ("token_offsets", "shard_assign", "pack_blocks", "byte_budget"):
        lines = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().split("\n")
        single = [k for k, line in enumerate(lines) if "SinglePartition" in line]
        assert single and all("HashAggregate(keys=[__part" in lines[k + 1] for k in single), name


def test_columns_are_pruned_and_filters_pushed(spark):
    from pyspark.sql import functions as F

    plan = QUERIES["corpus_report"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string,source:string>" in plan
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where(F.col("source") == "src1")
    from granary.functions.quality import quality_signals

    assert "EqualTo(source,src1)" in quality_signals(docs)._jdf.queryExecution().executedPlan().toString()
