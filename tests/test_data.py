"""Readers, writers, shards, fingerprints, audit and streams over small folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import audit, cleaning, fingerprint, provenance, tokens
from granary.sources import files, shards, sinks
from granary.streaming import jobs


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "corpus"
    write(d / "a.jsonl", [{"text": "bir", "source": "wiki"}, "{broken", {"text": "", "source": "x"}, "", "[1]", {"text": "iki", "source": "news", "extra": 1}])
    write(d / "b.jsonl", [{"text": "üç"}])
    write(d / "c.txt", ["  dört ", "", "beş"])
    write(d / "deep" / "d.jsonl", [{"text": "altı"}])
    write(d / ".hidden.jsonl", [{"text": "no"}])
    return d


def test_scans(spark, corpus):
    assert [r["text"] for r in files.documents(spark, str(corpus)).orderBy("file", "ord").collect()] == ["bir", "iki", "üç"]
    assert {r["text"] for r in files.documents(spark, str(corpus), ["news"]).collect()} == {"iki"}
    assert [r["text"] for r in files.training_texts(spark, str(corpus)).orderBy("file", "ord").collect()] == ["bir", "iki", "üç", "dört", "beş"]
    assert files.lines(spark, str(corpus), recursive=True).select("file").distinct().count() == 3
    counted = files.jsonl(spark, str(corpus), "text string", "count")
    assert counted.where("malformed").count() == 2 and counted.count() == 6
    with pytest.raises(Exception, match="no JSON object"):
        files.jsonl(spark, str(corpus), "text string", "raise").collect()
    with pytest.raises(ValueError, match="policy"):
        files.jsonl(spark, str(corpus), "text string", "other")


def test_analysis_documents(spark, tmp_path):
    write(tmp_path / "x.jsonl", [{"text": "bir", "domain": "news"}, {"text": "iki"}])
    (tmp_path / "y.json").write_text(json.dumps({"documents": [{"text": "üç", "domain": "law"}, {"text": " "}]}))
    (tmp_path / "z.json").write_text(json.dumps([{"text": "dört"}]))
    write(tmp_path / "t.txt", ["beş"])
    got = [(r["text"], r["domain"]) for r in files.analysis_documents(spark, str(tmp_path)).orderBy("file", "ord").collect()]
    assert got == [("beş", "t"), ("bir", "news"), ("iki", "x"), ("üç", "law"), ("dört", "z")]
    assert files.analysis_documents(spark, str(tmp_path), 2).count() == 2
    (tmp_path / "seed.json").write_text(json.dumps({"documents": [{"domain": "d", "text": "t"}], "morphology": [{"lemma": "ev", "forms": [{"text": "evler", "suffix": "ler"}]}]}))
    docs, probes = files.seed(spark, str(tmp_path / "seed.json"))
    assert docs.count() == 1 and tuple(probes.first()) == ("ev", "evler", "ler")


def test_benchmark_records(spark, tmp_path):
    write(tmp_path / "b.jsonl", [{"id": "q1", "prompt": "p", "choices": ["x", "", "z"], "text": ""}, "{bad", {"question": "q"}, {"id": "none", "other": 1}])
    write(tmp_path / "n.txt", ["first", "second"])
    got = {tuple(r) for r in files.benchmark_records(spark, str(tmp_path)).collect()}
    assert got == {("q1:prompt", "p"), ("q1:choices:0", "x"), ("q1:choices:2", "z"), ("b.jsonl:3:question", "q"), ("n.txt:1", "first"), ("n.txt:2", "second")}


def test_samples(spark, tmp_path):
    good = [{"id": "1", "type": "multiple_choice", "category": "c", "prompt": "p", "choices": ["a", "b"], "answer": 1}, {"id": "2", "type": "pairwise", "category": "c", "prompt": "p", "chosen": "x", "rejected": "y"}]
    write(tmp_path / "ok" / "knowledge.jsonl", good)
    got = files.samples(spark, str(tmp_path / "ok")).orderBy("id").collect()
    assert [(r["benchmark"], r["answer"]) for r in got] == [("knowledge", 1), ("knowledge", None)]
    bad = [{"id": "1", "type": "pairwise", "category": "c"}, {"id": "3", "type": "odd", "category": "c"}, {"type": "pairwise", "category": "c"}, {**good[0], "id": "4", "choices": ["a"]}, {**good[0], "id": "5", "answer": 2}, good[1], good[1], "{x"]
    write(tmp_path / "bad" / "x.jsonl", bad)
    rows = files.numbered(files.lines(spark, str(tmp_path / "bad")))
    assert sorted((r["line_no"], r["problem"]) for r in files.sample_problems(rows).collect()) == [
        (1, "field of the type is missing"), (2, "unknown type"), (3, "field is missing"), (4, "fewer than two choices"), (5, "answer is no index of a choice"), (7, "repeated id"), (8, "malformed"),
    ]
    with pytest.raises(ValueError, match="can't be used"):
        files.samples(spark, str(tmp_path / "bad"))


def test_vocabulary_and_generated(spark, tmp_path):
    (tmp_path / "v.vocab").write_text('<pad>\t0\n<unk>\t0\n"\t-1.5\n▁ev\t-2\n', encoding="utf-8")
    assert [tuple(r) for r in files.vocabulary(spark, str(tmp_path / "v.vocab")).orderBy("token_id").collect()] == [(0, "<pad>", 0.0), (1, "<unk>", 0.0), (2, '"', -1.5), (3, "▁ev", -2.0)]
    got = {r["doc_id"]: r["text"] for r in files.generated(spark, 25).collect()}
    assert len(got) == 25 and got[3] == files.PARAGRAPHS[3] and got[13].startswith(files.PARAGRAPHS[3] + " ")
    assert files.combined(spark.range(2).select("id"), spark.range(1).select("id", F.lit(1).alias("x"))).where("x is null").count() == 2


def test_check_paths(spark, tmp_path):
    write(tmp_path / "in" / "a.jsonl", ["{}"])
    assert len(files.check_paths(spark, str(tmp_path / "in"))) == 1
    with pytest.raises(FileNotFoundError, match="try in"):
        files.check_paths(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.check_paths(spark, str(tmp_path / "none"))


def test_clean_write_audit(spark, tmp_path):
    """Two lines that read the same: one is accepted, one a duplicate; what is written passes the audit."""
    text = " ".join(f"kelime{i} burada duruyor" for i in range(30))
    write(tmp_path / "raw" / "a.jsonl", [{"text": text, "source": "wikipedia", "url": "u", "timestamp": "2024"}] * 2)
    docs = files.documents(spark, str(tmp_path / "raw")).withColumns({"source_file": F.col("file"), "key": F.struct("file", "ord")}).drop("file", "ord")
    judged = cleaning.judged(docs, key="key").cache()
    row = cleaning.funnel(judged).first()
    assert (row["accepted"], row["duplicate"]) == (1, 1)
    done = cleaning.enrich(judged.where("reject_reason is null").drop("reject_reason", "key").withColumn("quality_signals", F.struct("alpha_ratio", "word_count")))
    sinks.jsonl(done, str(tmp_path / "clean"))
    manifest = sinks.corpus_manifest(judged, str(tmp_path / "clean"), {"min_words": 50})
    assert manifest["source_counts"] == {"wiki": 1} and manifest["stats"]["total"] == 2 and len(manifest["files"]) >= 1
    sinks.write_json(spark, str(tmp_path / "manifest.json"), manifest)
    assert json.loads((tmp_path / "manifest.json").read_text())["license_status_counts"] == {"verified_dataset_card": 1}
    lines = files.lines(spark, str(tmp_path / "clean"), ".json", recursive=True)
    found = audit.strict(lines)
    assert found["totals"]["lines"] == 1 and found["blocking"] == 0 and found["missing_fields"] == {}
    with pytest.raises(ValueError, match="blocking"):
        audit.strict(lines.unionByName(lines))
    sinks.plain_text(done, str(tmp_path / "plain"))
    assert spark.read.text(str(tmp_path / "plain")).first()[0] == text
    assert sinks.write_everywhere(spark, {"a": 1}, str(tmp_path / "m1"), str(tmp_path / "m2"), str(tmp_path / "m1")) == [f"{tmp_path}/m1/experiment_manifest.json", f"{tmp_path}/m2/experiment_manifest.json"]


def test_audit_edges(spark):
    digest = hashlib.sha256(b"a b").hexdigest()
    full = dict.fromkeys(audit.REQUIRED) | {"schema_version": provenance.SCHEMA_VERSION, "source": "s", "license_status": "review_required", "text": "A  b", "content_sha256": digest, "pii_redactions": {}, "contamination_matches": []}
    rows = [full, full, {**full, "downloaded_at": None}, {k: v for k, v in full.items() if k != "source"}, {**full, "content_sha256": "", "pii_redactions": {"EMAIL": 2}}, {**full, "text": "other", "contamination_matches": ["x"]}, "{bad", "[1, 2]", "NaN"]
    lines = spark.createDataFrame([("f", r if isinstance(r, str) else json.dumps(r)) for r in rows], "file string, line string")
    t = audit.totals(lines).first().asDict()
    assert t == {"lines": 9, "invalid_json": 3, "missing_metadata": 1, "schema_mismatch": 0, "license_review_required": 6, "pii_redacted_documents": 1, "contaminated_documents": 1, "hash_mismatch": 1, "duplicate_hashes": 4}
    assert {tuple(r) for r in audit.missing_fields(lines).collect()} == {("source", 1)}
    assert audit.totals(lines, verify_hashes=False).first()["hash_mismatch"] == 0 and audit.totals(lines.where("false")).first()["lines"] == 0
    assert {tuple(r) for r in audit.counts_by(lines, "source", "unknown").collect()} == {("s", 5), ("unknown", 1)}


# Shards


def stream(spark):
    rows = [("train", "all", 0, 0, list(range(1000))), ("train", "all", 1, 0, list(range(1500, 2500))), ("eval", "all", 0, 0, list(range(500)))]
    return spark.createDataFrame(rows, "split string, grp string, shard_id long, at long, tokens array<int>")


def test_shards(spark, tmp_path):
    """Two train shards of 1000 tokens make 18 blocks of 100, an eval shard of 500 four; block 9 begins the second shard."""
    path = str(tmp_path / "shards")
    entries = shards.save(stream(spark), path)
    shards.write_manifest(spark, path, shards.manifest(entries, 32_000))
    made = {}
    for split in ("train", "eval"):
        got = shards.load(spark, path, split, 32_000, verify_hashes=True)
        made[split] = tokens.blocks(got.select("grp", "shard_id", F.lit(0).cast("long").alias("at"), F.col("ids").alias("tokens")), 100, ["grp", "shard_id"])
    assert (made["train"].count(), made["eval"].count()) == (18, 4)
    first = made["train"].where("shard_id = 1 and block_id = 0").first()
    assert first["input_ids"][0] == 1500 and first["labels"][-1] == 1600
    ranges = tokens.group_ranges(tokens.shard_manifest(stream(spark).where("split = 'train'"), ["grp"], 100))
    at = {r["block_index"]: (r["shard_id"], r["local_block"]) for r in tokens.locate_blocks(spark.range(18).withColumnRenamed("id", "block_index"), ranges).collect()}
    assert len(at) == 18 and at[8] == (0, 8) and at[9] == (1, 0)
    numbered = spark.range(2).select(F.col("id").alias("i"), F.col("id").alias("x"))
    assert tokens.batches(numbered, 4, "i", "x").count() == 0 and tokens.batches(numbered, 4, "i", "x", drop_last=False).count() == 1


def test_shards_that_are_not_as_told(spark, tmp_path):
    path = str(tmp_path / "shards")
    good = shards.manifest(shards.save(stream(spark), path), 32_000)
    for change, message in (({"dtype": "float"}, "dtype"), ({"tokenizer_vocab_size": 5}, "vocabulary"), ({"eval": None}, "aren't|NoneType|subscript")):
        data = json.loads(json.dumps(good | change))
        shards.write_manifest(spark, path, data)
        with pytest.raises((ValueError, TypeError), match=message):
            shards.load(spark, path, "eval" if "eval" in change else "train", 32_000).count()
    for key, value, message in (("tokens", 7, "token count"), ("sha256", "0", "hash"), ("sha256", None, "no hash"), ("shard_id", 9, "missing")):
        data = json.loads(json.dumps(good))
        data["train"]["shards"][0][key] = value
        shards.write_manifest(spark, path, data)
        with pytest.raises(ValueError, match=message):
            shards.load(spark, path, verify_hashes=True)
    data = json.loads(json.dumps(good))
    data["train"]["total_tokens"] = 1
    shards.write_manifest(spark, path, data)
    with pytest.raises(ValueError, match="total"):
        shards.load(spark, path)
    with pytest.raises(ValueError, match="split"):
        shards.load(spark, path, "test")
    wide = spark.createDataFrame([("train", "all", 0, 0, [70_000])], "split string, grp string, shard_id long, at long, tokens array<int>")
    with pytest.raises(Exception, match="doesn't fit"):
        shards.save(wide, str(tmp_path / "wide"))


def test_bin_file(spark, tmp_path):
    import numpy as np

    (tmp_path / "x.bin").write_bytes(np.arange(5, dtype=np.int32).tobytes())
    assert shards.bin_file(spark, str(tmp_path / "x.bin")).first()["ids"] == [0, 1, 2, 3, 4]
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="length"):
        shards.bin_file(spark, str(tmp_path / "x.bin")).collect()


def test_fingerprints(spark, tmp_path):
    d = tmp_path / "data"
    write(d / "a.jsonl", ["{}"])
    write(d / "sub" / "b.txt", ["x"])
    write(d / "skip.md", ["x"])
    full = fingerprint.fingerprint(spark, str(d))
    want = hashlib.sha256()
    for name in ("a.jsonl", "sub/b.txt"):
        raw = (d / name).read_bytes()
        want.update(f"{name}\0{len(raw)}\0{hashlib.sha256(raw).hexdigest()}\n".encode())
    assert full["mode"] == "full" and full["files"] == 2 and full["sha256"] == want.hexdigest()
    assert fingerprint.fingerprint(spark, str(d), "metadata")["sha256"] == hashlib.sha256(b"a.jsonl\x003\nsub/b.txt\x002\n").hexdigest()
    write(d / "manifest.json", ["{}"])
    assert fingerprint.fingerprint(spark, str(d))["mode"] == "manifest" and fingerprint.fingerprint(spark, str(d), "off")["sha256"] is None
    with pytest.raises(ValueError, match="mode"):
        fingerprint.fingerprint(spark, str(d), "other")
    docs = spark.createDataFrame([(2, "d", "b"), (1, "d", "a")], "i long, domain string, text string")
    assert fingerprint.ordered_corpus_hash(docs, ["i"]) == hashlib.sha256(b"d\0a\nd\0b\n").hexdigest()
    big = spark.range(10_000).withColumn("x", F.col("id").cast("string"))
    assert fingerprint.table_fingerprint(big, ["id"], ["x"], 3) == fingerprint.table_fingerprint(big.repartition(7), ["id"], ["x"], 11)


# Streams


def add(folder, name, rows):
    write(folder / name, [{"doc_id": i, "text": t, "source": "s"} for i, t in rows])


def test_streams(spark, tmp_path):
    """New files are taken once; what stayed in earlier batches keeps copies and near copies out."""
    folder, base = tmp_path / "in", " ".join(f"kelime{i}" for i in range(80))
    add(folder, "1.json", [(1, base), (2, base), (3, "one two three")])
    near = lambda: jobs.near_dedup(jobs.read(spark, str(folder)), str(tmp_path / "index"), str(tmp_path / "kept"), str(tmp_path / "cp"))
    near()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3]
    add(folder, "2.json", [(4, base.upper()), (5, base + " !"), (6, "four five six seven")])
    near()
    near()  # nothing new
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3, 6]
    jobs.append(jobs.exact_dedup(jobs.read(spark, str(folder))), str(tmp_path / "exact"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "exact")).count() == 4 and spark.read.parquet(str(tmp_path / "exact")).select(T.hash_form(F.col("text"))).distinct().count() == 4
    jobs.append(jobs.gated(jobs.read(spark, str(folder)), 50), str(tmp_path / "gated"), str(tmp_path / "cp4"))
    assert spark.read.parquet(str(tmp_path / "gated")).count() == 4


def test_stream_budget_and_counters(spark, tmp_path):
    folder = tmp_path / "in"
    add(folder, "1.json", [(1, "aaaa"), (2, "bbbb"), (3, "cccc")])
    run = lambda: jobs.byte_budget(jobs.read(spark, str(folder)), 14, str(tmp_path / "out"), str(tmp_path / "cp"), ["doc_id"])
    run()
    add(folder, "2.json", [(4, "dddd"), (5, "eeee")])
    run()
    add(folder, "3.json", [(6, "ffff")])
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
    q = jobs.counters(jobs.read(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("counts").first()) == ("s", 6, 6)
