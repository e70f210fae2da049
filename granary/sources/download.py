"""What a download keeps of a table of articles or web documents that is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.cleaning import download_gate
from granary.operators.ordered import within_budget
from granary.operators.provenance import with_provenance


def _document(rows: DataFrame, source: str, text: Column, now: Column | None) -> DataFrame:
    wide = rows.withColumns({"text": T.trim_all(text), "source": F.lit(source)})
    wide = wide.withColumns({"word_count": T.word_count(F.col("text")), "raw_content_sha256": T.content_sha256(F.col("text"))})
    return with_provenance(wide, now)


def first_articles(articles: DataFrame, most: int | None = None, low: int = 50, order: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """Articles of at least `low` words among the first `most` that are looked at; titles stay."""
    seen = articles if most is None else articles.orderBy(*(order or ["id"])).limit(most)
    return _document(seen, "wiki", F.col("text"), now).where(F.col("word_count") >= low)


def kept_articles(articles: DataFrame, most: int | None = None, order: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """The first `most` articles of 30 to 100 000 words."""
    good = download_gate(articles)
    return _document(good if most is None else good.orderBy(*(order or ["id"])).limit(most), "wiki", F.col("text"), now)


def budgeted(rows: DataFrame, source: str, gigabytes: float, order: list[str], text: str = "text", now: Column | None = None) -> DataFrame:
    """Documents of 30 to 100 000 words up to and with the one whose text reaches the budget.

    The record id is the first of id, digest and warc_filename that is there and not empty.
    """
    names = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in ("id", "digest", "warc_filename") if n in rows.columns]
    named = rows.withColumn("source_record_id", F.coalesce(*names) if names else F.lit(None).cast("string"))
    kept = within_budget(download_gate(named, text=text), int(gigabytes * 1e9), order, text).drop("bytes_before")
    return _document(kept, source, F.col(text), now)
