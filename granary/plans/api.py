"""The jobs a user runs, each from files to files: clean, audit, pretokenise, analyse, compare, crawl.

Each reads with the readers of `sources`, applies the operators, writes what it made and
returns its report as a dict of a few entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import audit, cleaning, evaluation, fingerprint, mixture, tokenizer_stats, tokens, web
from granary.plans.lineage import table
from granary.sources import files, shards, sinks


def clean_corpus(spark: SparkSession, path: str, out: str, benchmark_path: str | None = None, settings: cleaning.Settings | None = None, tokenizer_data: str | None = None) -> dict:
    """Cleans JSON lines into JSON lines by source file, with a manifest; returns it."""
    s = settings or cleaning.Settings()
    docs = files.documents(spark, path)
    docs = docs.withColumns({"source_file": F.col("file"), "__key": F.struct("file", "ord")}).drop("file", "ord")
    bench = files.benchmark_records(spark, benchmark_path) if benchmark_path else None
    judged = table(cleaning.judged(docs, bench, s, "__key", "record_id"), "cleaned")
    kept = cleaning.enrich(judged.where("reject_reason is null").drop("reject_reason", "__key"))
    signals = ("alpha_ratio", "unique_word_ratio", "average_word_length", "short_line_ratio")
    kept = kept.withColumn("quality_signals", F.struct("word_count", *signals)).drop(*signals)
    sinks.jsonl(kept.withColumn("part", F.concat(F.lit("clean_"), "source_file")), out, "part")
    if tokenizer_data:
        sinks.plain_text(kept, tokenizer_data)
    manifest = sinks.corpus_manifest(judged, out, asdict(s) | {"contamination_enabled": bench is not None})
    sinks.write_json(spark, f"{out}/_corpus_manifest.json", manifest)
    return manifest


def audit_corpus(spark: SparkSession, path: str, out: str | None = None, verify_hashes: bool = True, strict: bool = False, suffix: str = ".json") -> dict:
    """The audit of all lines below a path; with `strict` it raises on blocking problems."""
    lines = files.lines(spark, path, suffix, recursive=True)
    report = (audit.strict if strict else audit.report)(lines, verify_hashes=verify_hashes)
    if out:
        sinks.write_json(spark, out, report)
    return report


def pretokenize(
    docs: DataFrame, make: Callable[[], object], out: str, config: dict | None = None, shard_size: int = 100_000_000, eval_ratio: float = 0.005, seed: int = 42, order: str = "doc_id", dtype: str = "uint16"
) -> dict:
    """Tokenises documents (order, source, text) into shards by split and group, with a manifest; returns it.

    Documents without a token are left out; a group of the mixture without a train document raises.
    """
    spark, tok = docs.sparkSession, make()
    ids = tokenizer_stats.encoded(docs.select(order, "source", "text").where("text <> ''"), make).where(F.size("ids") > 0).drop("text")
    ids = ids.withColumn("ids", tokens.framed(F.col("ids"), tokenizer_stats.BOS, tokenizer_stats.EOS))
    wide = tokens.with_split(ids, eval_ratio, seed, order)
    wide = mixture.with_group(wide, config) if config else wide.withColumn("grp", F.lit("all"))
    wide = table(wide.withColumn("grp", F.when(F.col("split") == "eval", "all").otherwise(F.col("grp"))), "tokenised")
    groups = list(mixture.validated(config)["groups"]) if config else ["all"]
    by_group = tokens.group_docs(wide, groups) if config else wide.where("split = 'train'").groupBy("grp").agg(F.count("*").alias("docs"))
    pieces = tokens.shard_pieces(wide, shard_size, [order], ["split", "grp"], eval_size=tokens.eval_shard_size(shard_size))
    entries = shards.save(pieces, out, dtype)
    print_of = fingerprint.table_fingerprint(docs, [order], [order, "text"])
    more = {
        "seed": seed, "shard_size_tokens": shard_size, "eval_ratio": eval_ratio, "mixture": mixture.validated(config) if config else None, "input_sha256": print_of, "group_docs": {r["grp"]: r["docs"] for r in by_group.collect()},
        "total_docs": wide.count(), "eval_docs": wide.where("split = 'eval'").count(),
    }
    data = shards.manifest(entries, tok.get_vocab_size(), dtype, **more)
    shards.write_manifest(spark, out, data)
    return data


def load_mixture(spark: SparkSession, path: str) -> dict:
    return mixture.validated(json.loads(shards.read_text(spark, path)))


def check_blocks(ranges: DataFrame, least: int = 1, what: str = "training data") -> int:
    """Number of blocks of `tokens.group_ranges`; raises if they are fewer than `least`."""
    n = ranges.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    if n < least:
        raise ValueError(f"{what} has {n} blocks, {least} are needed: add documents or use shorter blocks")
    return n


def unique_names(names: list[str]) -> list[str]:
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"names must be unique: {twice}")
    return names


def verify_tokenizer(make: Callable[[], object], sentences: list[str]) -> list[str]:
    """The sentences that don't come back from encoding and decoding."""
    tok = make()
    return [s for s in sentences if " ".join(tok.decode(tok.encode(s)).split()) != " ".join(s.split())]


def analyze_tokenizers(docs: DataFrame, makers: dict[str, Callable[[], object]], probes: DataFrame | None = None, **gates) -> dict:
    """Corpus, domain, coverage and vocabulary metrics of each tokenizer over (domain, text), and the gates it fails."""
    spark, out = docs.sparkSession, {}
    for name in unique_names(list(makers)):
        make = makers[name]
        stats = table(tokenizer_stats.corpus_stats(tokenizer_stats.measured(docs, make)), "tokenizer-stats")
        tok = make()
        pieces = spark.createDataFrame([(i, tok.id_to_token(i)) for i in range(tok.get_vocab_size())], "token_id int, piece string")
        report = {"domains": {r["domain"]: r.asDict() for r in stats.where("overall = 0").collect()}, "corpus": stats.where("overall = 1").first().asDict(), "vocabulary": tokenizer_stats.vocabulary(pieces).first().asDict()}
        report["coverage"] = {r["character"]: r.asDict() for r in tokenizer_stats.character_coverage(spark, make).collect()}
        if probes is not None:
            cut = lambda t, tok=tok: [tok.id_to_token(i) for i in tok.encode(t)]
            rows = [(r["lemma"], cut(r["lemma"]), r["form"], r["suffix"], cut(r["form"])) for r in probes.collect()]  # some dozens
            made = spark.createDataFrame(rows, "lemma string, lemma_pieces array<string>, form string, suffix string, pieces array<string>")
            report["morphology"] = tokenizer_stats.morphology(made).first().asDict()
        report["failed_gates"] = tokenizer_stats.gate(stats, **gates)
        out[name] = report
    return out


def evaluate(results: DataFrame, baseline: DataFrame | None = None, fail_below: float | None = None, max_regression: float | None = None) -> dict:
    """The report of an evaluation, its comparison with a baseline, and whether it passes the gates."""
    out = {"summary": evaluation.summary(results).first().asDict(), "rollup": [r.asDict() for r in evaluation.rollup(results).orderBy("scope", "name").collect()], "passed": True}
    if baseline is not None:
        out["categories"] = [r.asDict() for r in evaluation.compare_categories(results, baseline).orderBy("category").collect()]
        out["deltas"] = evaluation.compare_summaries(results, baseline).first().asDict()
        if max_regression is not None and evaluation.regressed(results, baseline, max_regression):
            out["passed"] = False
    if fail_below is not None and evaluation.below(results, fail_below):
        out["passed"] = False
    return out


def compare_ablations(baseline: DataFrame, candidates: dict[str, DataFrame], samples: int = 10_000, seed: int = 42) -> dict:
    """Paired differences of each candidate with intervals, overall and by category."""
    out = {}
    for k, name in enumerate(sorted(unique_names(list(candidates)))):
        deltas = table(evaluation.paired_deltas(candidates[name], baseline), "deltas")
        rows = evaluation.paired_summary(deltas).join(evaluation.bootstrap(deltas, samples, seed, k).withColumnRenamed("category", "c"), F.col("category").eqNullSafe(F.col("c"))).drop("c", "overall")
        out[name] = {r["category"]: r.asDict() for r in rows.collect()} | {"scores": evaluation.compare_summaries(candidates[name], baseline).first().asDict()}
    return out


def crawl_source(pages: DataFrame, seeds: list[str], max_pages: int = 100, max_depth: int = 2, min_words: int = 50) -> DataFrame:
    """Documents of the stored pages reached from the seeds, one seed after the other until enough are found; a seed is always followed to its end."""
    spark, found = pages.sparkSession, None
    for s in seeds:
        reached = web.crawl(pages, spark.createDataFrame([(s,)], "url string"), max_depth)
        fresh = reached.select("url") if found is None else reached.select("url").join(found.select("url"), "url", "left_anti")
        docs = table(web.crawled_documents(pages.join(fresh.distinct(), "url", "left_semi"), min_words), "crawled")
        found = docs if found is None else table(found.unionByName(docs), "crawled")
        if found.count() >= max_pages:
            break
    return found
