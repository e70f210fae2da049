"""Writers: JSON lines by source file, plain text, manifests and reports."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.fingerprint import file_entries
from granary.operators.provenance import SCHEMA_VERSION
from granary.sources.shards import write_text


def jsonl(docs: DataFrame, path: str, by: str | None = "source_file") -> None:
    """JSON lines, in folders by `by` if that is given and there; names of fields with a null value are left out."""
    writer = docs.write.mode("overwrite")
    if by and by in docs.columns:
        writer = writer.partitionBy(by)
    writer.json(path)


def plain_text(docs: DataFrame, path: str, text: str = "text") -> None:
    """Trimmed texts that aren't empty, one after the other; line feeds within a text stay."""
    docs.select(T.trim_all(F.col(text)).alias("value")).where(F.length("value") > 0).write.mode("overwrite").text(path)


def stamp() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def corpus_manifest(results: DataFrame, path: str, settings: dict, suffix: str = ".json") -> dict:
    """The manifest of a cleaned corpus: settings, counters, sorted counts by source and licence status, files with size and hash.

    results: the rows of `cleaning.judged`; path: where the accepted ones were written.
    """
    from granary.operators.cleaning import accepted_counts, funnel

    named = lambda df: {r[0]: r[1] for r in df.orderBy(df.columns[0]).collect()}  # noqa: E731  # a row a source
    return {
        "schema_version": SCHEMA_VERSION,
        "created_at": stamp(),
        "cleaner": settings,
        "stats": funnel(results).first().asDict(),
        "source_counts": named(accepted_counts(results, "source")),
        "license_status_counts": named(accepted_counts(results, "license_status")),
        "files": [r.asDict() for r in file_entries(results.sparkSession, path, (suffix,)).orderBy("path").collect()],
    }


def write_json(df_or_spark, path: str, data: dict) -> None:
    """One object as a file of any file system; numbers that are no JSON raise."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=1, allow_nan=False) + "\n")


def write_everywhere(spark, data: dict, *folders: str, name: str = "experiment_manifest.json") -> list[str]:
    """The same object in each of the folders, once each, in the order given."""
    paths = [f"{f.rstrip('/')}/{name}" for f in dict.fromkeys(folders)]
    for p in paths:
        write_json(spark, p, data)
    return paths


def output_sizes(docs: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """(by, docs, bytes) of what would be written as text."""
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))
