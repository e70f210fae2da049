"""Redaction of personal data: e-mail addresses, IPv4 addresses, phone numbers, national ids.

Labels are given in that order, each on the text that the one before left. A null text
gives null and no counts.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from granary.functions.batches import parts, strings

#: A part that has no `@` is passed over once, not once for each of its characters.
EMAIL = r"(?<![\w.+\-])[\w.+\-]++@[\w\-]+(?:\.[\w\-]+)+"


def alone(pattern: str) -> str:
    """Not within a longer run of digits."""
    return rf"(?<!\d){pattern}(?!\d)"


DOTTED = alone(r"(?:\d{1,3}[.]){3}\d{1,3}")
_WIDE, _NARROW = r"[\s().\-]*", r"[\s.\-]*"
_PAIR = rf"{_NARROW}\d{{2}}"
PHONE = alone(rf"(?:[+]?90{_WIDE})?0?[2-5]\d{{2}}{_WIDE}\d{{3}}{_PAIR}{_PAIR}")
ELEVEN = alone(r"[1-9]\d{10}")
LABELS = ("EMAIL", "IP_ADDRESS", "PHONE", "TCKN")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4, _ID = re.compile(rf"(?:{_OCTET}[.]){{3}}{_OCTET}"), re.compile("[1-9][0-9]{10}")


def is_ipv4(s: str) -> bool:
    """Four numbers up to 255, none with a leading zero."""
    return _IPV4.fullmatch(s) is not None


def is_national_id(s: str) -> bool:
    """Eleven digits whose last two check the others."""
    if not _ID.fullmatch(s):
        return False
    d = list(map(int, s))
    return (sum(d[:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


#: Of each label: what a text must have for the pattern to fit, told faster than by the pattern; the pattern; who is valid.
_STEPS = tuple(
    (re.compile(hint).search, re.compile(pattern), valid)
    for hint, pattern, valid in (("@", EMAIL, None), (r"\d[.]\d", DOTTED, is_ipv4), (r"[2-5]\d\d", PHONE, None), (r"[1-9]\d{10}", ELEVEN, is_national_id))
)


def redact(t: str) -> tuple[str, list[int]]:
    """The text with each candidate that is valid replaced, and their numbers by label; other candidates are kept whole."""
    counts = [0] * len(LABELS)
    for k, (hint, pattern, valid) in enumerate(_STEPS):
        if hint(t):

            def put(m: re.Match, k: int = k, valid=valid) -> str:
                if valid and not valid(m.group()):
                    return m.group()
                counts[k] += 1
                return f"<{LABELS[k]}>"

            t = pattern.sub(put, t)
    return t, counts


@arrow_udf(StructType().add("text", StringType()).add("counts", ArrayType(IntegerType())))
def _redacted(texts: pa.Array) -> pa.Array:
    done, found = [], array("i")
    for part in parts(texts):
        out = []
        for t in strings(part):
            t, counts = (None, [0] * len(LABELS)) if t is None else redact(t)
            out.append(t)
            found.extend(counts)
        done.append(pa.array(out, pa.string()))
    counts = pa.ListArray.from_arrays(pa.array(range(0, len(found) + 1, len(LABELS)), pa.int32()), pa.array(found, pa.int32()))
    return pa.StructArray.from_arrays([pa.concat_arrays(done) if done else pa.array([], pa.string()), counts], ["text", "counts"])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `text` redacted and `pii_redactions`, a map from label to count that has only labels found."""
    df = df.withColumn("__pii", _redacted(F.col(text)))
    pairs = F.array(*(F.struct(F.lit(label).alias("k"), F.col("__pii.counts")[k].alias("v")) for k, label in enumerate(LABELS)))
    return df.withColumns({text: F.col("__pii.text"), "pii_redactions": F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))}).drop("__pii")
