"""The cleaner: fixed order of normalisation, redaction, gates, contamination and dedup.

Steps 1 to 6 (HTML, NFKC, boilerplate, white space, personal data, gates) are one narrow
stage. Each later step sees only what passed all before it, as the order decides results:
a contaminated copy never takes the place of a clean one.

Defined results: a null text is an empty one and is too_short; each row is counted; rows
that repeat a key are told apart only by text from the dedup step on (see `dedup`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.pii import redacted
from granary.functions.quality import is_good, with_quality
from granary.operators import contamination as C
from granary.operators.dedup import near_duplicates
from granary.operators.provenance import enrich, with_profile
from granary.plans.lineage import table


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_words: int = 100_000
    quality_threshold: float = 0.5
    near_duplicate_distance: int = 3
    redact_pii: bool = True
    contamination_action: str = "reject"

    def __post_init__(self):
        if self.contamination_action not in ("reject", "flag"):
            raise ValueError("contamination_action must be reject or flag")


def normalised(docs: DataFrame, text: str = "text", redact: bool = True) -> DataFrame:
    """docs with `text` cleaned and pii_redactions."""
    c = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(text, T.nfkc(T.strip_html(c)))
    out = out.withColumn(text, T.strip_boilerplate(F.col(text)))
    out = out.withColumn(text, T.tidy_space(F.col(text)))
    return redacted(out, text) if redact else out.withColumn("pii_redactions", F.create_map().cast("map<string,int>"))


def length_reason(n: Column, low: int, high: int) -> Column:
    return F.when(n < low, "too_short").when(n > high, "too_long")


def gated(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs normalised, with quality columns and reject_reason (too_short, too_long, bad_quality or null)."""
    s = settings or Settings()
    wide = with_quality(normalised(docs, redact=s.redact_pii))
    reason = length_reason(F.col("word_count"), s.min_words, s.max_words)
    return wide.withColumn("reject_reason", F.coalesce(reason, F.when(~is_good(s.quality_threshold), "bad_quality")))


def judged(docs: DataFrame, benchmark: DataFrame | None = None, settings: Settings | None = None, key: str = "doc_id", record_key: str = "item_id") -> DataFrame:
    """Every document with what each step found: the columns of `gated`, contamination_matches, content_sha256, simhash64.

    reject_reason may also be contaminated, exact_duplicate or near_duplicate.
    """
    s = settings or Settings()
    base = table(gated(docs, s), "cleaner-gated")
    passed = base.where("reject_reason is null")
    found = None
    if benchmark is not None:
        found = table(C.matches(passed, benchmark, key, record_key), "cleaner-matches")
        base = base.join(found, key, "left")
        if s.contamination_action == "reject":
            base = base.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.size("contamination_matches") > 0, "contaminated")))
            passed = passed.join(found.select(key), key, "left_anti")
    else:
        base = base.withColumn("contamination_matches", F.lit(None).cast("array<string>"))
    twins = near_duplicates(passed.select(key, "text"), key, "text", s.near_duplicate_distance)
    out = base.join(twins, key, "left").withColumn("contamination_matches", F.coalesce("contamination_matches", F.array().cast("array<string>")))
    return out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("duplicate_type").isNotNull(), F.concat("duplicate_type", F.lit("_duplicate"))))).drop("duplicate_type")


def clean(docs: DataFrame, benchmark: DataFrame | None = None, settings: Settings | None = None, key: str = "doc_id", now: Column | None = None, **how) -> DataFrame:
    """The accepted documents, enriched."""
    return enrich(judged(docs, benchmark, settings, key, **how).where("reject_reason is null").drop("reject_reason"), now)


COUNTERS = ("total", "accepted", "too_short", "too_long", "duplicate", "exact_duplicate", "near_duplicate", "bad_quality", "pii_documents", "pii_redactions", "contaminated")


def funnel(results: DataFrame) -> DataFrame:
    """One row of the counters over the rows of `judged`; personal data counts in rejected documents too."""
    reason, n_pii = F.col("reject_reason"), F.aggregate(F.map_values("pii_redactions"), F.lit(0), lambda a, x: a + x)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = {
        "total": F.count("*"),
        "accepted": one(reason.isNull()),
        "duplicate": one(reason.endswith("_duplicate")),
        "pii_documents": one(F.size("pii_redactions") > 0),
        "pii_redactions": F.coalesce(F.sum(n_pii), F.lit(0)).cast("long"),
        "contaminated": one(F.size("contamination_matches") > 0),
    }
    return results.agg(*(counts.get(k, one(reason == k)).alias(k) for k in COUNTERS))


def accepted_counts(results: DataFrame, by: str = "license_status") -> DataFrame:
    """(by, docs) of the accepted rows of `judged`: by source or license_status."""
    return with_profile(results.where("reject_reason is null")).groupBy(by).agg(F.count("*").alias("docs"))


def download_gate(docs: DataFrame, low: int = 30, high: int = 100_000, text: str = "text") -> DataFrame:
    """docs of low to high words whose text isn't blank."""
    return docs.where(T.word_count(F.col(text)).between(max(low, 1), high))


def crawl_gate(docs: DataFrame, low: int = 50, lang: str | None = None, text: str = "text") -> DataFrame:
    """docs of at least `low` words, in the language if one is asked for; an unknown language passes."""
    out = docs.where(T.word_count(F.col(text)) >= low)
    return out if lang is None else out.where(F.coalesce(F.col("lang") == lang, F.lit(True)))
