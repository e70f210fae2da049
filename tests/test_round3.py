"""Tests of round 3, one or more for each finding that was right."""

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from granary.functions import batches
from granary.functions import text as T
from granary.functions.hashing import simhash64, slices
from granary.operators import contamination, dedup
from granary.plans.catalog import ORACLES, QUERIES
from tests.compare import both


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_rows_are_not_broadcast(spark):
    """The twenty index rows of every hash are shuffled, however few the hashes look."""
    plan = executed(dedup.near_pairs(spark.createDataFrame([(k * 7919,) for k in range(50)], "simhash long")))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def whole_simhash(tokens, digest):
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    values = [int.from_bytes(digest(x.encode()), "big") for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) >= len(values))


def test_simhash_counts_whole_texts(spark, tmp_path):
    """Texts that begin alike for 4096 shingles and then go on differently have their own hashes."""
    begin = [f"w{i}" for i in range(4100)]
    texts = [[*begin, *(f"{c}{i}" for i in range(1500))] for c in "abc"] + [begin]
    docs = frame(spark, [" ".join(t) for t in texts])
    blake = {r[0]: int(r[1], 16) for r in dedup.near_duplicates(docs).select("doc_id", "simhash64").collect()}
    assert blake == {i: whole_simhash(t, lambda x: hashlib.blake2b(x, digest_size=8).digest()) for i, t in enumerate(texts)}
    md5 = [r[0] % (1 << 64) for r in docs.orderBy("doc_id").select(simhash64(F.col("text"), "md5")).collect()]
    assert md5 == [whole_simhash(t, lambda x: hashlib.md5(x).digest()[:8]) for t in texts]
    changed = [*texts[0][:-30], *(f"z{i}" for i in range(30))]
    frame(spark, [" ".join(t) for t in [*texts, changed]]).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    ours, sql = both(spark, QUERIES["simhash_md5_pairs"], ORACLES["simhash_md5_pairs"], str(tmp_path))
    assert ours == sql and len(ours) == 1


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    """scores of 0.99374999999999991, which SQL scales before it rounds."""
    ids = (5978, 4334, 3731, 5630)
    spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(*ids)).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    for name in ("clean_prefix", "quality_signals"):
        ours, sql = both(spark, QUERIES[name], ORACLES[name], str(tmp_path))
        assert ours == sql and len(ours) == 4


def stages(df):
    """Expressions that the rows pass on their way, as the optimised plan has them."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_without_making_them(spark):
    """No array of matches is made of a text to count or measure its words, and no filter counts twice."""
    d = "/root/testdata/sf0.001"
    for name in ("download_gate", "token_offsets", "shard_offsets", "corpus_report", "shard_assign", "shard_manifest", "pack_blocks", "pack_framed", "padded", "banned_next", "quality_signals", "quality_by_source", "quality_vs_label"):
        assert "regexp_extract_all" not in stages(QUERIES[name](spark, d)), name
    assert stages(QUERIES["download_gate"](spark, d)).count("word_count(") == 1


def test_gates_evaluate_each_rule_once(spark):
    """rules are not repeated by those that follow them."""
    plan = stages(QUERIES["quality_gate_funnel"](spark, "/root/testdata/sf0.001"))
    assert plan.count("paylaş.*?") == 2 and "@" not in plan


def test_texts_that_are_odd(spark):
    """null, empty, blank and long texts, and more text than is handled at a time."""
    texts = [None, "", " \x1c\u3000", "A\u0307 ﬁ  x\n\n\n\n\ty ", "é" * 3_000_000 + " ½", "e\u0301 " * 900_000, "İki ſ Reklam REKLAM DEVAMINI oku"]
    c = F.col("text")
    got = frame(spark, texts).select("doc_id", T.nfkc(c).alias("n"), T.tidy_space(c).alias("t"), T.word_count(c).alias("w"), T.word_lengths(c).alias("l")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        want = (None,) * 4 if t is None else (unicodedata.normalize("NFKC", t), re.sub("[ \t]{2,}", " ", "\n".join(x.strip() for x in re.sub("\n{3,}", "\n\n", t).split("\n"))).strip(), len(t.split()), [len(w) for w in t.split()])
        assert tuple(r)[1:] == want
    assert frame(spark, texts[-1:]).select(T.strip_boilerplate(c)).first()[0] == "İki ſ   "
    part = pa.array(["x" * 1000] * 50 + [None, ""] + ["y" * 9000])
    assert [len(x) for x in batches.parts(part, 10_000)] == [10, 10, 10, 10, 12, 1] and batches.mapped(part, str.upper).to_pylist() == [x and x.upper() for x in part.to_pylist()]


def test_hashes_are_made_of_little_text_at_a_time():
    """what a slice needs does not grow with its batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(["w " * 2000] * 3000)], names=["t"])
    assert max(x.column(0).nbytes for x in slices([batch], "t", contamination.SLICE)) <= 2 << 20


def test_lines_are_parsed_once(spark):
    """neither a filter nor an explode makes and parses the lines again."""
    assert stages(QUERIES["audit_missing_fields"](spark, "/root/testdata/sf0.001")).count("StructsToJson") == 1
