"""Audit of a corpus of JSON lines: totals, missing fields, repeated and wrong hashes.

Lines come as rows (file, line) of text, so that a field that is missing can be told
from one that is null. A line that is no JSON object counts as invalid_json and in
nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.provenance import SCHEMA_VERSION

REQUIRED = (
    "content_sha256 contamination_matches dataset_id dataset_revision downloaded_at license_status licenses pii_redactions quality_score quality_signals schema_version source".split()
)
REVIEW = ("review_required", "inherited_review_required")
BLOCKING = ("duplicate_hashes", "hash_mismatch", "invalid_json", "missing_metadata", "schema_mismatch")
_FIELDS = "schema_version string, source string, license_status string, content_sha256 string, text string, pii_redactions string, contamination_matches string"


def parsed(lines: DataFrame, column: str = "line") -> DataFrame:
    """(file, keys, d): the names of a line's fields (null if it is no object), and the fields an audit reads."""
    keys = F.json_object_keys(column)
    empty = F.coalesce(F.regexp_like(F.col("d.pii_redactions"), F.lit(r"\A\s*(?:\{\s*\}|\[\s*\]|null|0|false|\"\")\s*\z")), F.lit(True))
    clear = F.coalesce(F.regexp_like(F.col("d.contamination_matches"), F.lit(r"\A\s*(?:\{\s*\}|\[\s*\]|null|0|false|\"\")\s*\z")), F.lit(True))
    out = lines.select("file", F.when(F.is_valid_utf8(F.col(column)), keys).alias("keys"), F.from_json(column, _FIELDS).alias("d"))
    return out.withColumns({"redacted": F.col("keys").isNotNull() & ~empty, "contaminated": F.col("keys").isNotNull() & ~clear})


def _missing():
    return F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")) > 0


def totals(lines: DataFrame, schema_version: str = SCHEMA_VERSION, verify_hashes: bool = True) -> DataFrame:
    """One row of counts. A repeated digest counts once for each line but its first; an empty one never."""
    wide = parsed(lines)
    digest = F.nullif(F.col("d.content_sha256"), F.lit(""))
    ok = F.col("keys").isNotNull()
    wrong = (digest != T.content_sha256(F.coalesce(F.col("d.text"), F.lit("")))) if verify_hashes else F.lit(False)
    facts = wide.select(
        ok.alias("ok"),
        (ok & _missing()).alias("missing"),
        (ok & ~F.coalesce(F.col("d.schema_version") == schema_version, F.lit(False))).alias("mismatch"),
        (ok & F.col("d.license_status").isin(*REVIEW)).alias("review"),
        "redacted",
        "contaminated",
        (ok & wrong).alias("wrong"),
        F.when(ok, digest).alias("digest"),
    )
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    by_digest = facts.groupBy("digest").agg(  # one row a digest, so that the final count needs no distinct
        F.count("*").alias("lines"), F.sum((~F.col("ok")).cast("long")).alias("invalid_json"), one("missing").alias("missing_metadata"), one("mismatch").alias("schema_mismatch"), one("review").alias("license_review_required"),
        one("redacted").alias("pii_redacted_documents"), one("contaminated").alias("contaminated_documents"), one("wrong").alias("hash_mismatch"),
    )
    names = ["lines", "invalid_json", "missing_metadata", "schema_mismatch", "license_review_required", "pii_redacted_documents", "contaminated_documents", "hash_mismatch"]
    again = F.sum(F.when(F.col("digest").isNotNull(), F.col("lines") - 1).otherwise(F.lit(0)))
    return by_digest.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.coalesce(again, F.lit(0)).alias("duplicate_hashes"))


def missing_fields(lines: DataFrame) -> DataFrame:
    """(field, lines) for each required field that any line lacks."""
    counts = parsed(lines).agg(*(F.count_if(~F.array_contains("keys", f)).alias(f) for f in REQUIRED))  # a filter or explode would parse the lines again
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("lines")) for f in REQUIRED))).alias("x")
    return counts.select(each).select("x.field", "x.lines").where("lines > 0")


def per_file(lines: DataFrame) -> DataFrame:
    """(file, lines, invalid_json)."""
    return parsed(lines).groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("keys").isNull()).alias("invalid_json"))


def counts_by(lines: DataFrame, field: str, absent: str) -> DataFrame:
    """(field, lines): sources or license_statuses; `absent` where a line has no such field."""
    value = F.when(F.array_contains("keys", field), F.col(f"d.{field}")).otherwise(F.lit(absent))
    return parsed(lines).where("keys is not null").groupBy(value.alias(field)).agg(F.count("*").alias("lines"))


def report(lines: DataFrame, **how) -> dict:
    """All of it as one object; every part but the files is a few numbers, files are one entry each."""
    row = totals(lines, **how).first().asDict()
    named = lambda df: {r[0]: r[1] for r in df.orderBy(df.columns[0]).collect()}
    return {
        "schema_version": how.get("schema_version", SCHEMA_VERSION),
        "totals": row,
        "sources": named(counts_by(lines, "source", "unknown")),
        "license_statuses": named(counts_by(lines, "license_status", "missing")),
        "missing_fields": named(missing_fields(lines)),
        "files": [r.asDict() for r in per_file(lines).orderBy("file").collect()],
        "blocking": sum(row[k] for k in BLOCKING),
    }


def strict(lines: DataFrame, **how) -> dict:
    """The report; raises if any blocking counter is above zero."""
    out = report(lines, **how)
    if out["blocking"]:
        raise ValueError(f"the audit found {out['blocking']} blocking problems: {({k: out['totals'][k] for k in BLOCKING})}")
    return out
