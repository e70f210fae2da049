"""Column expressions over text; all but `nfkc`, `tidy_space`, `word_count` and `word_lengths` run in the JVM.

White space, letters and word characters are those of Unicode, spelled out as classes,
because `\\s`, `\\d` and `\\w` of the JVM are ASCII. A null text gives null; an empty one
gives an empty text and counts of 0.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from granary.functions.batches import mapped, strings

#: The 29 characters that count as white space; line breaks are among them.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"
#: Printable ASCII is told first, as most characters are that and the list of blanks is long.
SPACE = f"[[^!-~]&&[{BLANK}]]"
SOLID = f"[!-~[^{BLANK}]]"
LEVEL = f"[[^!-~]&&[{BLANK}&&[^{BREAK}]]]"  # white space within a line
WORD = r"[\p{L}\p{N}_]"
NUMERAL = r"\p{Nd}"
ANYCASE = "(?iud)"
VOWELS = "aeıioöuüAEIİOÖUÜ"


def strip_html(c: Column) -> Column:
    """Tags go without a trace, entities become a space (hexadecimal ones stay)."""
    for pattern, by in (("<[^>]+>", ""), ("&[a-zA-Z]+;", " "), ("&#" + NUMERAL + "+;", " ")):
        c = F.regexp_replace(c, pattern, by)
    return c


def _nfkc(t: str) -> str:
    return t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)


@arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition; texts that have it already are passed on as they are."""
    return mapped(texts, _nfkc)


def _boilerplate() -> list[str]:
    gap, years = SPACE + "*", NUMERAL + "{4}"
    spans = [f"{first}.*?{last}" for first, last in zip(("cookie", "çerez", "gizlilik"), ("kabul", "politika", "sözleşme"), strict=True)]
    notices = ["tüm hakları saklıdır", "all rights reserved", f"©{gap}{years}"]
    sharing = ["paylaş.*?(?:" + "|".join(("facebook", "twitter", "whatsapp")) + ")", f"yorum{gap}yap", rf"yorumlar{gap}\({NUMERAL}+\)"]
    return spans + notices + sharing + ["reklam", "advertisement", "loading[.]{3}", gap.join(("devamını", "oku")), gap.join(("daha", "fazla", "göster"))]


BOILERPLATE = [ANYCASE + p for p in _boilerplate()]
_ANY_BOILERPLATE = ANYCASE + "|".join(f"(?:{p})" for p in _boilerplate())


#: A text that a rule fits has one of these when it is in lower case, without dots of its i.
_ANCHORS = ("cookie", "çerez", "gizlilik", "tüm haklari", "all rights", "©", "paylaş", "yorum", "reklam", "advertisement", "loading...", "devamini", "daha")


def _may_have_boilerplate(c: Column) -> Column:
    low = F.lower(c)
    for x, y in (("ı", "i"), ("\u0307", ""), ("ſ", "s")):  # as rules without case take them
        low = F.replace(low, F.lit(x), F.lit(y))
    return F.exists(F.array(low), lambda x: reduce(or_, (F.contains(x, F.lit(a)) for a in _ANCHORS)))  # so that `low` is made once


def strip_boilerplate(c: Column) -> Column:
    """Stock phrases of web pages, taken out one rule after the other; a text that none fits skips the chain."""
    out = c
    for p in BOILERPLATE:
        out = F.regexp_replace(out, p, "")
    return F.when(_may_have_boilerplate(c) & F.regexp_like(c, F.lit(_ANY_BOILERPLATE)), out).otherwise(c)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end; linear in the longest run."""
    return F.regexp_replace(c, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


_GAPS, _RUNS = re.compile("\n{3,}"), re.compile("[ \t]{2,}")


def _tidy(t: str) -> str:
    return _RUNS.sub(" ", "\n".join(x.strip() for x in _GAPS.sub("\n\n", t).split("\n"))).strip()


@arrow_udf(StringType())
def tidy_space(texts: pa.Array) -> pa.Array:
    """Three line feeds or more become two, then lines are trimmed, runs of blanks and tabs squeezed, and the whole trimmed."""
    return mapped(texts, _tidy)


def squeeze(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({SOLID}+)"), 1)


@arrow_udf(IntegerType())
def word_count(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else len(t.split()) for t in strings(texts)), pa.int32(), size=len(texts))


@arrow_udf(ArrayType(IntegerType()))
def word_lengths(texts: pa.Array) -> pa.Array:
    """The length of each of `words`."""
    ends, sizes = [0], array("i")
    for t in strings(texts):
        if t is not None:
            sizes.extend(map(len, t.split()))
        ends.append(len(sizes))
    nulls = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sizes, pa.int32()), mask=nulls)


def letters(c: Column) -> Column:
    """Only the letters."""
    return F.regexp_replace(c, r"[^\p{L}]+", "")


def solid_length(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(c, f"{SPACE}+", ""))


def casefold(c: Column) -> Column:
    """Full case folding as far as texts in NFKC need it: lower case, sharp s as two, final sigma as any."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def hash_form(c: Column) -> Column:
    """Case folded, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(c), f"{SPACE}+", " "))


def content_sha256(c: Column) -> Column:
    return F.sha2(hash_form(c), 256)


def word_tokens(c: Column) -> Column:
    """Runs of letters, numbers and underscores of the hash form (combining marks divide)."""
    return F.regexp_extract_all(hash_form(c), F.lit(f"({WORD}+)"), 1)


def token_string(c: Column) -> Column:
    """The same tokens as one string, a space between them."""
    return F.trim(F.regexp_replace(casefold(c), r"[^\p{L}\p{N}_]+", " "))


def shingles(c: Column, n: int) -> Column:
    """All runs of n tokens as strings, in order and with repeats; none if there are fewer tokens."""
    return F.expr("array()").cast("array<string>") if n < 1 else F.when(
        F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


# Answers and prompts


def answer_form(c: Column) -> Column:
    """For comparing answers: NFKC, dotted and dotless i as Turkish has them, case folded, all but words as single spaces."""
    turkish = F.translate(nfkc(c), "İI", "iı")
    return F.trim(F.regexp_replace(casefold(turkish), r"[^\p{L}\p{N}_]+", " "))


def roundtrip_form(c: Column) -> Column:
    """NFKC with runs of white space as one space, trimmed."""
    return squeeze(nfkc(c))


def lexical_words(c: Column) -> Column:
    """Words of letters (an apostrophe may join two parts) and runs of digits."""
    return F.regexp_count(c, F.lit(rf"[\p{{L}}\p{{No}}\p{{Nl}}]++(?:['’][\p{{L}}\p{{No}}\p{{Nl}}]++)?|{NUMERAL}++"))


def is_byte_piece(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"\A<0x[0-9A-Fa-f]{2}>\z"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two texts begin with alike; halving finds it, so no text is walked character by character."""
    low, high = F.lit(0), F.least(F.length(a), F.length(b))
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.expr("1").cast("int") + F.shiftright(s["lo"] + s["hi"], 1)
        mid = F.least(mid, s["hi"])
        same = F.left(a, mid) == F.left(b, mid)
        return F.when(s["lo"] >= s["hi"], s).when(same, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["lo"])


def prefix_ratio(expected: Column, actual: Column) -> Column:
    return common_prefix_length(expected, actual) / F.greatest(F.length(expected), F.lit(1))


def leaked(expected: Column, actual: Column, threshold: float = 0.8) -> Column:
    return (expected == actual) | (prefix_ratio(expected, actual) >= threshold)


def matching_keywords(keywords: Column, text: Column) -> Column:
    """Those of the keywords (answer forms) that the text (one too) contains."""
    return F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(text, k))


def reference_match(generated: Column, references: Column, mode: Column) -> Column:
    """Exact: equal to one of the references. Otherwise: one of them, not empty, is contained."""
    return F.when(mode == "exact", F.array_contains(references, generated)).otherwise(F.exists(references, lambda r: (r != "") & F.contains(generated, r)))


def long_context(filler: Column, needle: Column, question: Column, filler_tokens: Column, target: Column, position: Column, most: int = 2048) -> Column:
    """The filler, as often as the target length takes, with the needle at a share of it (half repeats round to even)."""
    wanted = F.greatest(F.lit(8), F.least(F.coalesce(target, F.lit(most - 96)), F.lit(max(8, most - 64))))
    repeats = F.greatest(F.lit(1), F.ceil(wanted / F.greatest(filler_tokens, F.lit(1)))).cast("int")
    before = F.bround(repeats * F.least(F.greatest(F.coalesce(position, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))).cast("int")
    context = F.concat(F.array_repeat(filler, before), F.array(needle), F.array_repeat(filler, repeats - before))
    return F.concat(F.lit("Bağlam:\n"), F.array_join(context, " "), F.lit("\n\nSoru: "), question, F.lit("\nYanıt:"))


# URLs


def skipped_url(c: Column) -> Column:
    """Addresses not worth a visit: files, accounts, administration, numbered listings."""
    files = "|".join("jpg jpeg png gif svg ico css js woff ttf pdf zip rar".split())
    rules = [rf".*\.(?:{files})\n?\z", *(f".*/{x}" for x in ("login", "register", "admin")), rf".*\?.*page={NUMERAL}+\n?\z"]
    return F.regexp_like(c, F.lit(r"(?iud)\A(?:" + "|".join(rules) + ")"))
