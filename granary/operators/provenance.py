"""Where documents come from and under which terms: registry, aliases, provenance, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T

SCHEMA_VERSION = "granary-document-1"
_PROFILE = "source string, dataset_id string, dataset_revision string, licenses array<string>, license_status string, license_url string, terms_url string"
_HUB = "https://huggingface.co/datasets/"


def registry(spark: SparkSession) -> DataFrame:
    """The sources whose terms are known, a few rows."""
    cards = [("wiki", "wikimedia/wikipedia", "20231101.tr", ["GFDL-unspecified", "CC-BY-SA-3.0"], "verified_dataset_card", None)]
    cards += [("fineweb2", "HuggingFaceFW/fineweb-2", "main", ["ODC-By-1.0"], "verified_dataset_card", "https://commoncrawl.org/terms-of-use")]
    cards += [("culturax", "uonlp/CulturaX", "main", ["UPSTREAM-mC4", "UPSTREAM-OSCAR"], "inherited_review_required", None)]
    rows = [(*card[:5], _HUB + card[1], card[5]) for card in cards]
    rows.append(("sample", "granary/generated-samples", "local", ["Apache-2.0"], "project_owned", "LICENSE", None))
    return spark.createDataFrame(rows, _PROFILE)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, "wiki") for a in ("wikipedia", "wikipedia_tr", "wikimedia/wikipedia")], "alias string, canonical string")


def crawl_sources(spark: SparkSession) -> DataFrame:
    """Seeds for crawling: (source, kind, priority, url), a row a seed."""
    seeds = {
        ("wikipedia", "encyclopedia", "high"): ["tr.wikipedia.org/wiki/Özel:Rastgele"],
        ("haber", "news", "high"): ["www.hurriyet.com.tr", "www.milliyet.com.tr", "www.haberturk.com", "www.ntv.com.tr", "www.bbc.com/turkce", "www.dw.com/tr", "tr.euronews.com", "www.trthaber.com"],
        ("kamu", "official", "medium"): [f"www.{x}.gov.tr" for x in ("resmigazete", "tbmm", "meb")],
        ("edebiyat", "literature", "medium"): ["www.antoloji.com", "www.siir.gen.tr"],
        ("akademik", "academic", "medium"): ["dergipark.org.tr", "tez.yok.gov.tr"],
    }
    return spark.createDataFrame([(*k, f"https://{u}") for k, urls in seeds.items() for u in urls], "source string, kind string, priority string, url string")


def with_profile(docs: DataFrame, source: str = "source", known: DataFrame | None = None, other_names: DataFrame | None = None) -> DataFrame:
    """docs with the registry's columns: aliases resolved, unknown sources marked for review.

    A null or empty source has the dataset_id `unknown`. The registry and its aliases are
    tables of some rows by nature; they are joined, and broadcast if Spark finds them small.
    """
    spark = docs.sparkSession
    names = (other_names or aliases(spark)).select(F.col("alias").alias("__alias"), "canonical")
    cards = known or registry(spark)
    cards = cards.select(F.col("source").alias("__known"), *(c for c in cards.columns if c != "source"))
    extra = [c for c in cards.columns if c != "__known"]
    out = docs.drop(*(c for c in extra if c in docs.columns)).withColumnRenamed(source, "__source")
    out = out.join(names, F.col("__source") == F.col("__alias"), "left").withColumn("source", F.coalesce("canonical", "__source"))
    out = out.join(cards, F.col("source") == F.col("__known"), "left")
    new = F.col("__known").isNull()
    return out.withColumns({
        "dataset_id": F.when(new, F.coalesce(F.nullif(F.col("__source"), F.lit("")), F.lit("unknown"))).otherwise(F.col("dataset_id")),
        "dataset_revision": F.when(new, F.lit("unknown")).otherwise(F.col("dataset_revision")),
        "licenses": F.when(new, F.array().cast("array<string>")).otherwise(F.col("licenses")),
        "license_status": F.when(new, F.lit("review_required")).otherwise(F.col("license_status")),
    }).drop("__source", "__alias", "canonical", "__known")


def _first_filled(docs: DataFrame, *names: str) -> Column:
    """The first of these columns that is there and not empty."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in docs.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def with_provenance(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """docs with profile, schema_version, source_url, source_record_id, downloaded_at, ingested_at (a second's precision).

    An empty text falls through to the older name of a field, as a missing one does.
    """
    at = now if now is not None else F.date_trunc("second", F.current_timestamp())
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit("unknown"))
    named = docs.withColumns({
        "source_url": _first_filled(docs, "source_url", "url"),
        "downloaded_at": _first_filled(docs, "downloaded_at", "timestamp"),
        "source_record_id": _first_filled(docs, "source_record_id", "id"),
    })
    return with_profile(named).withColumns({"schema_version": F.lit(SCHEMA_VERSION), "ingested_at": at})


def enrich(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Cleaned documents with all their metadata; computed fields replace those of the same name, others stay.

    Takes text, quality columns, pii_redactions, contamination_matches, content_sha256 and
    simhash64 as the cleaning steps name them; those that are missing come out null or empty.
    """
    out = with_provenance(docs, now)
    have = set(out.columns)
    gaps = {"pii_redactions": "map<string,int>", "contamination_matches": "array<string>", "simhash64": "string", "quality_score": "double"}
    out = out.withColumns({k: (F.create_map() if k.startswith("pii") else F.array() if k.startswith("cont") else F.lit(None)).cast(t) for k, t in gaps.items() if k not in have})
    if "content_sha256" not in have:
        out = out.withColumn("content_sha256", T.content_sha256(F.col("text")))
    if "source_file" in have:
        out = out.withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))
    return out.withColumn("word_count", T.word_count(F.col("text")).cast("int"))


def license_status_counts(docs: DataFrame) -> DataFrame:
    """(license_status, docs)."""
    return with_profile(docs).groupBy("license_status").agg(F.count("*").alias("docs"))


def source_counts(docs: DataFrame) -> DataFrame:
    """(source, docs), aliases resolved."""
    return with_profile(docs).groupBy("source").agg(F.count("*").alias("docs"))
