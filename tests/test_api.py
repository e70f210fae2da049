"""The jobs from files to files."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import cleaning, tokenizer_stats, tokens
from granary.plans import api
from granary.sources import download, shards


def pieces():
    return tokenizer_stats.Pieces.bytes_and(["▁bir", "▁iki", "▁kelime"])


def text(k):
    return " ".join(f"kelime{i} metin{k} burada duruyor" for i in range(30))


def test_clean_and_audit(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = [{"text": text(k), "source": "wiki", "id": str(k)} for k in range(3)] + [{"text": text(0), "source": "x"}, {"text": "short"}, {"text": " ".join(f"soru{i}" for i in range(60)), "source": "x"}]
    (raw / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n")
    (tmp_path / "bench").mkdir()
    (tmp_path / "bench" / "q.jsonl").write_text(json.dumps({"id": "q", "prompt": " ".join(f"soru{i}" for i in range(20))}) + "\n")
    got = api.clean_corpus(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "bench"), cleaning.Settings(near_duplicate_distance=0), str(tmp_path / "plain"))
    assert {k: got["stats"][k] for k in ("total", "accepted", "too_short", "duplicate", "contaminated")} == {"total": 6, "accepted": 3, "too_short": 1, "duplicate": 1, "contaminated": 1}
    assert spark.read.text(str(tmp_path / "plain")).count() == 3 and (tmp_path / "out" / "_corpus_manifest.json").exists()
    report = api.audit_corpus(spark, str(tmp_path / "out"), str(tmp_path / "audit.json"))
    assert report["totals"]["lines"] == 3 and report["totals"]["hash_mismatch"] == 0 and json.loads((tmp_path / "audit.json").read_text())["sources"] == {"wiki": 3}


def test_pretokenize(spark, tmp_path):
    docs = spark.createDataFrame([(i, "wiki" if i % 3 else "web", "bir iki kelime " * (i % 5)) for i in range(300)], "doc_id long, source string, text string")
    config = {"curriculum_steps": 10, "groups": {"good": {"sources": ["wiki"]}, "rest": {"default": True}}}
    (tmp_path / "mix.json").write_text(json.dumps(config))
    config = api.load_mixture(spark, str(tmp_path / "mix.json"))
    data = api.pretokenize(docs, pieces, str(tmp_path / "out"), config, shard_size=200, eval_ratio=0.1)
    n = {i: 3 * (i % 5) + 2 for i in range(300) if i % 5}
    assert data["total_docs"] == 240 and data["train"]["total_tokens"] + data["eval"]["total_tokens"] == sum(n.values()) and sum(data["group_docs"].values()) + data["eval_docs"] == 240
    assert all(s["tokens"] <= 200 for s in data["train"]["shards"])
    train = shards.load(spark, str(tmp_path / "out"), "train", pieces().get_vocab_size(), verify_hashes=True)
    assert train.select(F.sum(F.size("ids"))).first()[0] == data["train"]["total_tokens"]
    ranges = tokens.group_ranges(tokens.shard_manifest(train.withColumnRenamed("ids", "tokens"), ["grp"], 32))
    assert api.check_blocks(ranges) > 0
    with pytest.raises(ValueError, match="blocks"):
        api.check_blocks(ranges, 10**9)
    with pytest.raises(ValueError, match="without a train"):
        api.pretokenize(docs, pieces, str(tmp_path / "none"), {"groups": {"a": {"sources": ["none"]}, "b": {"default": True}}})


def test_analysis_and_comparison(spark):
    docs = spark.createDataFrame([("a", "bir iki"), ("b", "çok kelime")], "domain string, text string")
    probes = spark.createDataFrame([("bir", "biri", "i")], "lemma string, form string, suffix string")
    got = api.analyze_tokenizers(docs, {"x": pieces}, probes, max_bytes=0.0)
    assert got["x"]["corpus"]["documents"] == 2 and got["x"]["failed_gates"] == ["byte_token_rate"] and got["x"]["morphology"]["forms"] == 1 and set(got["x"]["domains"]) == {"a", "b"}
    assert api.verify_tokenizer(pieces, ["bir iki", "çğ"]) == []
    with pytest.raises(ValueError, match="unique"):
        api.unique_names(["a", "a"])
    schema = "id string, benchmark string, category string, score double, correct boolean"
    base = spark.createDataFrame([("1", "b", "c", 0.0, False), ("2", "b", "d", 1.0, True)], schema)
    better = spark.createDataFrame([("1", "b", "c", 1.0, True), ("2", "b", "d", 1.0, True)], schema)
    report = api.evaluate(base, better, fail_below=0.9, max_regression=0.1)
    assert report["passed"] is False and report["deltas"]["macro_delta"] == -0.5 and api.evaluate(better, base, 0.5, 0.1)["passed"]
    got = api.compare_ablations(base, {"n": better}, 200)
    assert got["n"][None]["wins"] == 1 and got["n"]["c"]["ci95_low"] == 1.0 and got["n"]["scores"]["micro_delta"] == 0.5


def test_downloads(spark):
    rows = [(str(i), "kelime " * n, f"t{i}", "", "w") for i, n in enumerate((10, 40, 60, 100))]
    art = spark.createDataFrame(rows, "id string, text string, title string, digest string, warc_filename string")
    assert sorted(r["title"] for r in download.first_articles(art, 3).collect()) == ["t2"]
    assert sorted(r["title"] for r in download.kept_articles(art, 2).collect()) == ["t1", "t2"]
    got = download.budgeted(art.withColumn("id", F.lit("")), "fineweb2", 500e-9, ["title"]).orderBy("title").collect()
    assert [r["title"] for r in got] == ["t1", "t2"] and got[0]["source_record_id"] == "w" and got[0]["dataset_id"] == "HuggingFaceFW/fineweb-2"


def test_crawl_source(spark):
    body = lambda links: "<body>" + "w " * 60 + "".join(f"<a href='{x}'>x</a>" for x in links) + "</body>"
    pages = spark.createDataFrame([("http://a.example/", body(["/1", "/2"])), ("http://a.example/1", body(["/"])), ("http://a.example/2", "<body>few</body>"), ("http://b.example/", body([]))], "url string, html string")
    assert sorted(r["url"] for r in api.crawl_source(pages, ["http://a.example/", "http://b.example/"], 2).collect()) == ["http://a.example/", "http://a.example/1"]
    assert api.crawl_source(pages, ["http://a.example/", "http://b.example/"], 9).count() == 3
