"""Cleaning, personal data, quality, dedup, contamination and provenance against plain Python and fixed examples."""

import random
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.pii import redacted
from granary.functions.quality import quality_signals
from granary.operators import cleaning, contamination, dedup, provenance
from tests import model

DIR = "/root/testdata/sf0.001"


def rows(spark, name, *columns, d=DIR):
    return [tuple(r) for r in spark.read.parquet(f"{d}/{name}.parquet").select(*columns).collect()]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


ODD = [
    "a b　c\x1cd", "  lead and trail 　\n \n\n\n next\tline \x0b x", "Straße STRASSE ΣΑΣ ς", "x<br/>y &amp; z &#39; &#x27;", "ﬁne ² ① ｗｉｄｅ", "", None, " \n\t ", "one two three four five\r\nsix",
    "Tüm Hakları Saklıdır © 2024 devamını   oku Reklam LOADING... yorumlar (12) paylaş: Facebook", "cookie x\nkabul cookie y kabul z", "é combining i̇",
]


def test_texts_like_plain_python(spark):
    c = F.col("text")
    got = frame(spark, ODD).select(
        "text", T.word_count(c).alias("n"), T.hash_form(T.nfkc(c)).alias("fold"), T.tidy_space(T.strip_boilerplate(T.nfkc(T.strip_html(c)))).alias("normal"), T.words(c).alias("w"), T.token_string(T.nfkc(c)).alias("t")
    )
    import unicodedata

    for r in got.collect():
        t = r["text"]
        if t is None:
            assert (r["n"], r["fold"], r["normal"], r["w"]) == (None,) * 4
            continue
        nf = unicodedata.normalize("NFKC", t)
        assert r["n"] == len(t.split()) and r["w"] == t.split() and r["fold"] == model.fold(nf) and r["normal"] == model.normal(t)
        assert r["t"] == " ".join(model.WORDS.findall(model.fold(nf)))


def test_quality_like_plain_python(spark):
    texts = [*ODD, *(t for (t,) in rows(spark, "documents", "text"))]
    got = {r["doc_id"]: r for r in quality_signals(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        score, signals = model.quality(t or "")
        r = got[i]
        assert abs(r["quality_score"] - score) < 1.5e-4 and r["word_count"] == len((t or "").split())
        if signals:
            assert all(abs(a - b) < 1.5e-4 for a, b in zip((r["alpha_ratio"], r["unique_word_ratio"], r["average_word_length"], r["short_line_ratio"]), signals, strict=True)), t
        else:
            assert r["alpha_ratio"] is None and r["quality_score"] == 0


PII = [
    "Write to ali.veli+x@posta.example.com or 0532 123 45 67, from 10.0.0.1, id 10000000146.", "müller@firma.de and info@müller.de", "999.1.2.3.4 x10.0.0.1 01.2.3.4 256.1.1.1 1.2.3.4.5 1.2.3.4 5.6.7.8", "+90 (532) 123-45-67 and 905321234567",
    "ids 10000000147 110000000146 010000000146 10000000146", "a@b no dot, <user@host.tld>", "@ @@ a@@b.c", None, "", "12345678901 1.1.1.1.", "tel:2121234567",
]


def test_personal_data_like_plain_python(spark):
    for r in redacted(frame(spark, PII).withColumn("raw", F.col("text"))).collect():
        if r["raw"] is None:
            assert r["text"] is None and r["pii_redactions"] == {}
        else:
            assert (r["text"], r["pii_redactions"]) == model.redact(r["raw"])
    assert redacted(frame(spark, PII[:1])).first()["pii_redactions"] == {"EMAIL": 1, "IP_ADDRESS": 1, "PHONE": 1, "TCKN": 1}


def test_redaction_is_linear(spark):
    """A megabyte without an `@`, and one of digits, take seconds."""
    began = time.time()
    texts = ["A" * 1_000_000, "1" * 1_000_000, " " * 1_000_000 + "x", "a b " * 250_000]
    assert redacted(frame(spark, texts)).where(F.size("pii_redactions") > 0).count() == 0
    frame(spark, texts).select(T.tidy_space(F.col("text")), T.trim_all(F.col("text"))).collect()
    assert time.time() - began < 60


def test_dedup_examples(spark):
    base = "bir iki uc dort bes alti yedi sekiz dokuz on " * 6
    got = {r["doc_id"]: r["duplicate_type"] for r in dedup.near_duplicates(frame(spark, [base, base.upper() + " ", base + "!", "something else entirely, with words of its own"])).collect()}
    assert got[0] is None and got[1] == "exact" and got[2] in ("exact", "near") and got[3] is None


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_near_duplicates_like_plain_python(spark, name):
    texts = sorted(rows(spark, "documents", "doc_id", "text", d=f"/root/testdata/{name}"))
    rng = random.Random(5)
    for k in range(40):  # changed copies, and copies of those
        w = texts[rng.randrange(len(texts))][1].split()
        if len(w) > 40:
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append((100_000 + k, " ".join(w)))
    seen = model.Dedup()
    want = {i: seen.add(t) for i, t in texts}
    got = {r["doc_id"]: r["duplicate_type"] for r in dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and {"exact", "near"} <= set(want.values())


def test_independent_set_like_plain_python(spark):
    """Chains of near hashes: who goes no longer keeps others out."""
    rng = random.Random(9)
    hashes = []
    for _ in range(30):
        h = rng.getrandbits(64)
        for _ in range(8):
            hashes.append(h - (1 << 64) if h >> 63 else h)
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                h ^= 1 << b
    rng.shuffle(hashes)
    keep = []
    for i, h in enumerate(hashes):
        if all(((h ^ hashes[j]) & (1 << 64) - 1).bit_count() > 3 for j in keep):
            keep.append(i)
    base = spark.createDataFrame([(i, str(h), h) for i, h in enumerate(hashes)], "doc_id long, content_sha256 string, simhash long")
    assert sorted(r[0] for r in dedup.independent_set(base, "doc_id").collect()) == keep


def test_contamination_examples(spark):
    item = " ".join(f"k{i}" for i in range(14))
    bench = spark.createDataFrame([("bench-1:text", item), ("short:text", " ".join(item.split()[:13])), ("none", None)], "item_id string, text string")
    docs = frame(spark, [f"x {item.upper()}! y", " ".join(item.split()[:13]), f"{item} {item}", None, ""])
    got = {r["doc_id"]: r["contamination_matches"] for r in contamination.matches(docs, bench).collect()}
    assert got == {0: ["bench-1:text"], 2: ["bench-1:text"]}
    five = {r["doc_id"]: r["contamination_matches"] for r in contamination.matches(docs, bench, n=5).collect()}
    assert five[1] == ["bench-1:text", "short:text"]
    assert sorted(r["doc_id"] for r in contamination.reject(docs, bench).collect()) == [1, 3, 4]
    assert contamination.matches(docs, bench.where("false")).count() == 0 and contamination.matches(docs.where("false"), bench).count() == 0


def test_cleaner_like_plain_python(spark):
    docs, bench = rows(spark, "documents", "doc_id", "text"), rows(spark, "benchmark", "item_id", "text")
    docs += [(900 + i, t) for i, t in enumerate([None, "", "<p>" + docs[0][1], docs[3][1] + " mail a@b.co", "word " * 60])]
    want = model.clean(docs, bench)
    table = spark.createDataFrame([(i, t, "wikipedia") for i, t in docs], "doc_id long, text string, source string")
    judged = cleaning.judged(table, spark.createDataFrame(bench, "item_id long, text string"))
    got = {r["doc_id"]: (r["reject_reason"], r["word_count"]) for r in judged.collect()}
    assert got == {i: v[:2] for i, v in want.items()}
    row = cleaning.funnel(judged).first()
    assert row["total"] == len(docs) and row["accepted"] == sum(v[0] is None for v in want.values()) and row["duplicate"] == row["exact_duplicate"] + row["near_duplicate"] > 0
    assert {r["license_status"]: r["docs"] for r in cleaning.accepted_counts(judged).collect()} == {"verified_dataset_card": row["accepted"]}
    flagged = cleaning.judged(table, spark.createDataFrame(bench, "item_id long, text string"), cleaning.Settings(contamination_action="flag"))
    assert flagged.where("reject_reason = 'contaminated'").count() == 0 and cleaning.funnel(flagged).first()["contaminated"] == row["contaminated"] > 0
    done = cleaning.clean(table.limit(30))
    assert {"dataset_id", "content_sha256", "simhash64", "ingested_at", "pii_redactions"} <= set(done.columns) and done.where("license_status is null").count() == 0
    with pytest.raises(ValueError):
        cleaning.Settings(contamination_action="other")


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "wikipedia_tr"), (2, "host.example"), (3, None), (4, ""), (5, "sample")], "doc_id long, source string")
    got = {r["doc_id"]: r for r in provenance.with_profile(docs).collect()}
    assert got[1]["licenses"] == ["GFDL-unspecified", "CC-BY-SA-3.0"] and got[1]["source"] == "wiki"
    assert got[2]["license_status"] == "review_required" and got[2]["dataset_id"] == "host.example" and got[3]["dataset_id"] == got[4]["dataset_id"] == "unknown" and got[5]["license_status"] == "project_owned"
    assert provenance.crawl_sources(spark).count() == 16


def test_nothing_breaks_on_empty_tables(spark):
    docs = frame(spark, ["x"]).withColumn("source", F.lit("s")).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert cleaning.judged(docs, bench).count() == 0 and cleaning.funnel(cleaning.judged(docs, bench)).first()["total"] == 0
    assert dedup.kept(docs).count() == dedup.exact_groups(docs).count() == quality_signals(docs).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A  B"), (None, "z"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dedup.kept(twice).collect()) == [1, 3]
