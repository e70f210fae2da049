"""All queries of the core library, by name; their SQL is in `oracles`, written apart from the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.hashing import hex64, simhash64
from granary.functions.pii import LABELS, redacted
from granary.functions.quality import SIGNALS, is_good, quality_signals, with_quality
from granary.operators import audit, cleaning, contamination, dedup, evaluation, fingerprint, linguistics, mixture, ordered, provenance, tokenizer_stats, tokens, web
from granary.plans.oracles import ORACLES
from granary.sources import files, sinks

MIX = {
    "curriculum_steps": 100,
    "groups": {"high_quality": {"sources": ["source_1", "source_2", "src1", "src2"], "initial_weight": 0.8, "final_weight": 0.4}, "general": {"default": True, "initial_weight": 0.2, "final_weight": 0.6}},
}


def read(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _redaction(s, d):
    wide = redacted(read(s, d).select("doc_id", "lang", "text"))
    return wide.select("doc_id", "lang", "text", *(F.coalesce(F.col("pii_redactions")[x], F.lit(0)).alias(x.lower()) for x in LABELS))


def _gated(s, d):
    return cleaning.gated(read(s, d).select("doc_id", "lang", "text"))


def _sourced(s, d):
    names = F.array(*map(F.lit, ("wiki", "wikipedia", "fineweb2", "culturax", "sample")), "source")
    return read(s, d).select("doc_id", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("source"))


def audit_lines(docs: DataFrame) -> DataFrame:
    """JSON lines made of documents, with gaps and faults of every kind the audit counts."""
    i = F.col("doc_id")
    every = lambda n, k: i % n == k
    digest = T.content_sha256(F.coalesce(F.col("text"), F.lit("")))
    status = F.when(every(10, 3), F.lit(None)).when(every(5, 0), "review_required").when(every(5, 1), "inherited_review_required").otherwise("verified_dataset_card")
    fields = {
        "schema_version": F.when(every(7, 0), "other").otherwise(F.lit(provenance.SCHEMA_VERSION)), "source": F.col("source"), "dataset_id": F.lit("d"), "dataset_revision": F.lit("r"),
        "licenses": F.array().cast("array<string>"), "license_status": status, "downloaded_at": F.when(~every(4, 1), "2024-01-01"), "content_sha256": F.when(every(13, 0), "").when(every(11, 0), "0").otherwise(digest),
        "quality_score": F.lit(0.5), "quality_signals": F.struct(F.lit(1).alias("word_count")), "text": F.col("text"),
        "pii_redactions": F.when(every(3, 0), F.create_map(F.lit("EMAIL"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>")),
        "contamination_matches": F.when(every(17, 0), F.array(F.lit("b:text"))).otherwise(F.array().cast("array<string>")),
    }
    line = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    return docs.select(F.concat(F.col("lang"), F.lit(".jsonl")).alias("file"), F.when(every(50, 7), '{"text": ').otherwise(line).alias("line"))


def _word_ids(s, d):
    """Documents with a number for each word, its length."""
    return read(s, d).select("doc_id", "source", T.word_lengths(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _manifest(s, d):
    pieces = tokens.shard_pieces(_word_ids(s, d), 5000, ["doc_id"], ["source"]).withColumnRenamed("source", "grp")
    return tokens.shard_manifest(pieces, ["grp"], 64)


def _locate(s, d):
    ranges = tokens.group_ranges(_manifest(s, d))
    total = ranges.agg(F.max("end")).first()[0]
    return tokens.locate_blocks(s.range(total).select(F.col("id").alias("block_index")), ranges)


def _results(s, d):
    """Labels as the results of an evaluation: id, category, benchmark, score, correct."""
    rows = read(s, d, "labels").join(read(s, d).select("doc_id", "lang", "source"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("benchmark"), F.col("quality").cast("double").alias("score"), (F.col("quality") == 1).alias("correct"), F.col("toxic").cast("double").alias("toxic"))


def _baseline(s, d):
    return _results(s, d).withColumn("score", 1 - F.col("toxic")).where("category <> 'fr'")


def _deltas(s, d):
    both = _results(s, d)
    return evaluation.paired_deltas(both, both.withColumn("score", 1 - F.col("toxic")))


def _measured(s, d):
    """Documents as if measured by a tokenizer of whole words, whose ids are lengths and above 10 unknown."""
    t = F.coalesce(F.col("text"), F.lit(""))
    wide = read(s, d).select(F.col("lang").alias("domain"), t.alias("text"), T.words(t).alias("pieces"))
    ids = F.transform("pieces", lambda w: F.length(w))
    return wide.select("domain", "text", "pieces", ids.alias("ids"), F.size(F.filter(ids, lambda n: n > 10)).alias("unknown"), (F.length("text") % 2 == 0).alias("exact"))


def pieces_of(texts: DataFrame, key: str, width: int = 3) -> DataFrame:
    """(seq_id, pos, piece): words of a text in lower case, cut into pieces of three characters, the first marked."""
    words = texts.select(F.col(key).alias("seq_id"), F.posexplode(T.words(F.lower(F.col("text")))).alias("w", "word"))
    cut = words.select("seq_id", "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word"), F.lit(width)), lambda i: F.concat(F.when(i == 1, "▁").otherwise(""), F.substring("word", i, F.lit(width))))).alias("p", "piece"))
    return cut.select("seq_id", (F.col("w") * 100_000 + F.col("p")).alias("pos"), "piece")


def _vocabulary(s, d, texts="benchmark", key="item_id"):
    """Pieces with ids from 100 on, numbered by their hashes, so that nothing has to be sorted in one task."""
    return pieces_of(read(s, d, texts), key).select("piece").distinct().select((F.conv(F.substring(F.md5("piece"), 1, 7), 16, 10).cast("long") + 100).alias("token_id"), "piece")


def _sequences(s, d, texts="benchmark", key="item_id"):
    return pieces_of(read(s, d, texts), key).join(_vocabulary(s, d, texts, key), "piece").select("seq_id", "pos", "token_id")


def _turns(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    form = T.answer_form(F.coalesce(F.col("text"), F.lit("")))
    return read(s, d, "conversations").select("conv_id", "turn", form.alias("form")).withColumn("before", F.lag("form").over(w))


def _fingerprint(s, d):
    return s.createDataFrame([(fingerprint.table_fingerprint(read(s, d), ["doc_id"], ["doc_id", "text"]),)], "sha256 string")


def _clean_pipeline(s, d):
    out = cleaning.judged(read(s, d).select("doc_id", "source", "text"), read(s, d, "benchmark"))
    return out.select("doc_id", "reject_reason", "word_count", "quality_score", "content_sha256", "simhash64", F.array_join("contamination_matches", ",").alias("matches"))


def _schedule(s, d):
    step = F.col("step")
    return s.range(1201).select(F.col("id").alias("step")).select(
        "step", F.round(mixture.learning_rate(step, 3e-4, 3e-5, 100, 1000), 10).alias("rate"), F.round(mixture.warmed_up(step, 0.1, 200, 50), 8).alias("aux_weight"),
        F.round(mixture.suffix_weight(step, 1.5, 400, 0), 8).alias("suffix_weight"), mixture.round_up(step, 64).alias("padded"),
    )


def _near_pairs(s, d):
    c = F.coalesce(F.col("text"), F.lit(""))
    base = read(s, d).select("doc_id", simhash64(T.token_string(c), "md5").alias("simhash"))
    return dedup.near_pairs(base).select(hex64(F.col("x")).alias("a"), hex64(F.col("y")).alias("b"))


def _conversation_keywords(s, d):
    words = F.array(*map(F.lit, ("the", "code", "please", "data")))
    turns = read(s, d, "conversations").select("conv_id", "turn", T.answer_form(F.coalesce(F.col("text"), F.lit(""))).alias("form"))
    return turns.select("conv_id", "turn", F.array_join(T.matching_keywords(words, F.col("form")), ",").alias("found"))


QUERIES = {
    # cleaning
    "html_strip": lambda s, d: read(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("page_text")),
    "page_text": lambda s, d: read(s, d, "pages").select("page_id", T.tidy_space(T.strip_html(F.col("html"))).alias("page_text")),
    "nfkc": lambda s, d: read(s, d).select("doc_id", T.nfkc(F.col("text")).alias("text")),
    "boilerplate_strip": lambda s, d: read(s, d).select("doc_id", T.strip_boilerplate(F.col("text")).alias("text")),
    "whitespace_clean": lambda s, d: read(s, d).select("doc_id", T.tidy_space(F.col("text")).alias("text")),
    "word_count": lambda s, d: read(s, d).select("doc_id", T.word_count(F.col("text")).alias("words")),
    "length_gate": lambda s, d: read(s, d).select("doc_id", cleaning.length_reason(T.word_count(F.col("text")), 50, 1000).alias("reject_reason")),
    "download_gate": lambda s, d: cleaning.download_gate(read(s, d)).groupBy("source").agg(F.count("*").alias("docs")),
    "crawl_gate": lambda s, d: cleaning.crawl_gate(read(s, d), lang="de").select("doc_id"),
    "clean_prefix": lambda s, d: _gated(s, d).select("doc_id", "text", "word_count", "quality_score", "reject_reason"),
    "clean_pipeline": _clean_pipeline,
    "cleaner_funnel": lambda s, d: cleaning.funnel(cleaning.judged(read(s, d).select("doc_id", "source", "text"), read(s, d, "benchmark"))),
    "quality_gate_funnel": lambda s, d: _gated(s, d).groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("docs")),
    # personal data
    "pii_redaction": lambda s, d: _redaction(s, d).drop("lang"),
    "pii_counts_by_lang": lambda s, d: _redaction(s, d).groupBy("lang").agg(*(F.sum(x.lower()).alias(x.lower()) for x in LABELS), F.count_if(F.greatest(*(F.col(x.lower()) for x in LABELS)) > 0).alias("docs")),
    # hashes and duplicates
    "norm_hash": lambda s, d: read(s, d).select("doc_id", T.content_sha256(F.col("text")).alias("content_sha256")),
    "exact_dedup": lambda s, d: dedup.exact_groups(read(s, d)),
    "exact_dup_groups": lambda s, d: dedup.exact_groups(read(s, d)).where("copies > 1"),
    "simhash_md5": lambda s, d: read(s, d).select("doc_id", hex64(simhash64(T.token_string(F.col("text")), "md5", 4096)).alias("simhash64")),
    "simhash_md5_pairs": _near_pairs,
    "near_duplicates": lambda s, d: dedup.near_duplicates(read(s, d)),
    # quality
    "quality_signals": lambda s, d: quality_signals(read(s, d)),
    "quality_vs_label": lambda s, d: with_quality(read(s, d).join(read(s, d, "labels"), "doc_id")).groupBy("quality", "toxic", is_good().alias("good")).agg(F.count("*").alias("docs")),
    "quality_by_source": lambda s, d: quality_signals(read(s, d)).join(read(s, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(*(F.round(F.avg(x), 3).alias(x) for x in ("quality_score", *SIGNALS))),
    # contamination
    "shingle_stats": lambda s, d: read(s, d).select("doc_id", T.word_tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("tokens"), F.greatest(F.size("w") - 12, F.lit(0)).alias("grams")),
    "contamination": lambda s, d: contamination.contamination(read(s, d), read(s, d, "benchmark")),
    "contamination_matches": lambda s, d: contamination.matches(read(s, d), read(s, d, "benchmark")).select("doc_id", F.array_join("contamination_matches", ",").alias("matches")),
    "contamination_reject": lambda s, d: contamination.reject(read(s, d), read(s, d, "benchmark")).groupBy("source").agg(F.count("*").alias("docs")),
    "contamination_flag": lambda s, d: contamination.flag(read(s, d), read(s, d, "benchmark")).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.size("contamination_matches") > 0).alias("flagged")),
    "benchmark_records": lambda s, d: files.flattened(read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text"), F.split("text", " ", 3).alias("choices"))),
    # provenance and audit
    "source_profile": lambda s, d: provenance.with_profile(_sourced(s, d)).select("doc_id", "source", "dataset_id", "dataset_revision", F.array_join("licenses", ",").alias("licenses"), "license_status", "license_url", "terms_url"),
    "license_status_counts": lambda s, d: provenance.license_status_counts(_sourced(s, d)),
    "source_counts": lambda s, d: provenance.source_counts(_sourced(s, d)),
    "provenance": lambda s, d: provenance.with_provenance(read(s, d).select(F.col("doc_id").cast("string").alias("id"), "source", F.when(F.col("doc_id") % 2 == 0, "").otherwise("u").alias("source_url"), F.lit("v").alias("url"))).select("source", "source_url", "source_record_id", "schema_version", "downloaded_at"),
    "audit_totals": lambda s, d: audit.totals(audit_lines(read(s, d))),
    "audit_missing_fields": lambda s, d: audit.missing_fields(audit_lines(read(s, d))),
    "audit_per_file": lambda s, d: audit.per_file(audit_lines(read(s, d))),
    "audit_license_statuses": lambda s, d: audit.counts_by(audit_lines(read(s, d)), "license_status", "missing"),
    "corpus_report": lambda s, d: corpus_report(read(s, d)),
    "output_sizes": lambda s, d: sinks.output_sizes(read(s, d)),
    "corpus_fingerprint": _fingerprint,
    # splits, shards, blocks, mixtures
    "train_eval_split": lambda s, d: tokens.content_split(read(s, d)).select("doc_id", "split"),
    "split_counts": lambda s, d: tokens.with_split(read(s, d), 0.1).groupBy("split").agg(F.count("*").alias("docs"), F.count_distinct("doc_id").alias("ids")),
    "token_offsets": lambda s, d: tokens.token_offsets(read(s, d).select("doc_id", T.word_count(F.coalesce(F.col("text"), F.lit(""))).alias("n")), "n", ["doc_id"]).select("doc_id", "n", "first_token", F.expr("first_token div 2048").alias("first_block")),
    "shard_offsets": lambda s, d: tokens.token_offsets(read(s, d).select("source", "doc_id", T.word_count(F.coalesce(F.col("text"), F.lit(""))).alias("n")), "n", ["doc_id"], ["source"]).select("source", "doc_id", "first_token"),
    "shard_assign": lambda s, d: tokens.shard_pieces(_word_ids(s, d), 10_000, ["doc_id"]).groupBy("shard_id").agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")),
    "shard_manifest": _manifest,
    "pack_blocks": lambda s, d: tokens.pack(_word_ids(s, d), 128, ["doc_id"]).select("block_id", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels")),
    "pack_framed": lambda s, d: tokens.pack(_word_ids(s, d).withColumn("ids", tokens.framed(F.col("ids"), 2, 3)), 256, ["doc_id"], ["source"]).groupBy("source").agg(F.count("*").alias("blocks"), F.sum(F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")),
    "locate_blocks": _locate,
    "batches": lambda s, d: tokens.batches(read(s, d).select((F.col("doc_id") - F.lit(0)).alias("i"), F.col("n_chars").cast("string").alias("x")), 16, "i", "x", False).select("batch", F.array_join("items", " ").alias("items")),
    "padded": lambda s, d: tokens.padded(_word_ids(s, d), 20).select("doc_id", _joined("ids").alias("ids"), _joined("mask").alias("mask")),
    "byte_budget": lambda s, d: ordered.within_budget(read(s, d), 500_000, ["doc_id"]).select("doc_id", "bytes_before"),
    "mixture_weights": lambda s, d: mixture.weights(s.range(0, 151, 10).select(F.col("id").alias("step")), MIX).select("step", "grp", F.round("weight", 6).alias("weight")),
    "mixture_groups": lambda s, d: mixture.with_group(read(s, d), MIX).groupBy("grp").agg(F.count("*").alias("docs")),
    "mixture_sample": lambda s, d: mixture.sample_blocks(s, MIX, s.createDataFrame([("high_quality", 0, 50), ("general", 50, 120), ("high_quality", 120, 140)], "grp string, start long, end long"), 5000),
    "schedules": _schedule,
    # evaluation
    "category_report": lambda s, d: evaluation.rollup(_results(s, d)),
    "micro_macro": lambda s, d: evaluation.summary(_results(s, d)).select("samples", F.round("micro_score", 9).alias("micro_score"), F.round("macro_score", 9).alias("macro_score"), "correct"),
    "category_comparison": lambda s, d: evaluation.compare_categories(_results(s, d), _baseline(s, d)).select("category", *(F.round(c, 9).alias(c) for c in ("current", "baseline", "delta"))),
    "paired_deltas": _deltas,
    "win_tie_loss": lambda s, d: evaluation.paired_summary(_deltas(s, d)).select("category", "samples", F.round("mean_delta", 9).alias("mean_delta"), "wins", "ties", "losses"),
    "bootstrap_ci": lambda s, d: evaluation.bootstrap(_deltas(s, d), 200),
    "id_differences": lambda s, d: evaluation.id_differences(_results(s, d), _baseline(s, d)),
    "top_scores": lambda s, d: evaluation.top_k(read(s, d).select("source", "doc_id", F.col("n_chars").alias("score")), 3, ["source"]),
    "nucleus": lambda s, d: evaluation.nucleus(read(s, d).select("source", F.col("doc_id").alias("token_id"), (F.col("n_chars") / F.sum("n_chars").over(_by("source"))).alias("prob")), 0.5, ["source"]).select("source", "token_id"),
    "banned_next": lambda s, d: _word_ids(s, d).select("doc_id", F.slice("ids", 1, 300).alias("ids")).select("doc_id", _joined(evaluation.banned_next(F.col("ids"), 3)).alias("banned")),
    "answer_forms": lambda s, d: read(s, d, "conversations").select("conv_id", "turn", T.answer_form(F.col("text")).alias("form")),
    "prefix_leak": lambda s, d: _turns(s, d).where("before is not null").select("conv_id", "turn", T.common_prefix_length(F.col("before"), F.col("form")).alias("common"), T.leaked(F.col("before"), F.col("form")).alias("leaked")),
    "keyword_scan": _conversation_keywords,
    # tokenizer analysis
    "token_length_percentiles": lambda s, d: tokenizer_stats.length_percentiles(read(s, d)),
    "domain_stats": lambda s, d: _rounded(tokenizer_stats.corpus_stats(_measured(s, d)).withColumn("overall", F.col("overall").cast("int"))),
    "vocabulary_metrics": lambda s, d: tokenizer_stats.vocabulary(_vocabulary(s, d)),
    # language
    "word_features": lambda s, d: linguistics.word_features(read(s, d), T.words(F.lower(F.coalesce(F.col("text"), F.lit(""))))),
    "token_features": lambda s, d: linguistics.token_features(_vocabulary(s, d)),
    "feature_inventory": lambda s, d: linguistics.inventory(linguistics.token_features(_vocabulary(s, d))),
    "harmony_violation": lambda s, d: linguistics.harmony_violation(_sequences(s, d), linguistics.token_features(_vocabulary(s, d))),
    "assimilation_violation": lambda s, d: linguistics.assimilation_violation(_sequences(s, d), linguistics.token_features(_vocabulary(s, d))),
    "line_metre": lambda s, d: linguistics.text_metre(read(s, d)),
    "turn_changes": lambda s, d: turn_changes(read(s, d, "conversations")),
    # web
    "page_url_skip": lambda s, d: read(s, d, "pages").select("page_id", T.skipped_url(F.col("url")).alias("skip"), T.skipped_url(F.concat("url", F.lit("/pic.PNG"))).alias("skip_file"), T.skipped_url(F.concat("url", F.lit("?a=1&page=2"))).alias("skip_page")),
    "page_main_text": lambda s, d: web.main_text(read(s, d, "pages")),
    "page_links": lambda s, d: web.page_links(read(s, d, "pages")),
    "crawl": lambda s, d: web.crawl(read(s, d, "pages"), read(s, d, "pages").select("url")),
}


def _by(name):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def corpus_report(docs: DataFrame) -> DataFrame:
    """(source, lang, docs, words, chars, empty): all combinations of both, by source, and overall."""
    wide = docs.select("source", "lang", T.word_count(F.coalesce(F.col("text"), F.lit(""))).alias("w"), F.length("text").alias("c"))
    return wide.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.count_if(F.col("w") == 0).alias("empty"))


def turn_changes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, role_changes, words); a conversation is in one task, as its turns are few."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    out = conversations.select("conv_id", "turn", "role", T.word_count(F.coalesce(F.col("text"), F.lit(""))).alias("w"), F.lag("role").over(w).alias("was"))
    return out.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") != F.col("was")).alias("role_changes"), F.sum("w").alias("words"))


__all__ = ["ORACLES", "QUERIES"]
