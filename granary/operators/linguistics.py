"""Turkish features of vocabulary pieces, and harmony, assimilation, metre and rhyme of token sequences.

Pieces are those of a subword vocabulary: `▁` marks the start of a word, `<...>` a
special piece. Sequences are rows (seq_id, pos, token_id); `token_features` is joined to
them as a table the size of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import VOWELS

BACK, FRONT = "aıouAIOU", "eiöüEİÖÜ"
VOICELESS, MUTABLE = "fstkçşhp", "cdg"
SPECIALS = ("sep", "cls", "mask")
DEFAULT_METRE = 11


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\A▁+", "")


def is_special(c: Column) -> Column:
    return c.startswith("<") & c.endswith(">")


def _class(vowel: Column) -> Column:
    return F.when(vowel == "", 2).when(F.contains(F.lit(BACK), vowel), 0).otherwise(1)


def last_vowel_class(c: Column) -> Column:
    """0 back, 1 front, 2 without a vowel."""
    return _class(F.regexp_extract(c, f"([{VOWELS}])[^{VOWELS}]*\\z", 1))


def first_vowel_class(c: Column) -> Column:
    return _class(F.regexp_extract(c, f"([{VOWELS}])", 1))


def turkish_lower(c: Column) -> Column:
    return F.lower(c)


def ends_voiceless(c: Column) -> Column:
    """Whether the last letter is one of the voiceless consonants."""
    return F.coalesce(F.contains(F.lit(VOICELESS), F.nullif(F.regexp_extract(F.lower(c), r"(\p{L})\P{L}*\z", 1), F.lit(""))), F.lit(False))


def starts_mutable(c: Column) -> Column:
    """Whether the first letter is c, d or g."""
    return F.coalesce(F.contains(F.lit(MUTABLE), F.nullif(F.regexp_extract(F.lower(c), r"(\p{L})", 1), F.lit(""))), F.lit(False))


def syllables(c: Column) -> Column:
    return F.when(is_special(c), 0).otherwise(F.regexp_count(c, F.lit(f"[{VOWELS}]")))


def rhyme_ending(c: Column) -> Column:
    """The last two letters in lower case, or the only one; empty for special pieces and those without a letter."""
    return F.when(is_special(c), "").otherwise(F.lower(F.right(F.regexp_replace(c, r"[^\p{L}]+", ""), F.lit(2))))


def is_word_start(token_id: Column, piece: Column) -> Column:
    return piece.startswith("▁") | (token_id < 4)


def role(token_id: Column, piece: Column) -> Column:
    """special, root (starts a word) or suffix."""
    return F.when(token_id < 4, "special").when(piece.startswith("▁"), "root").otherwise("suffix")


def role_weight(role_name: Column, suffix: float | Column) -> Column:
    return F.when(role_name == "suffix", suffix).otherwise(F.lit(1.0))


def morphology_class(token_id: Column, piece: Column) -> Column:
    """0 root, 1 suffix, 2 special: the first four ids, separators, and pieces without a letter."""
    marked = F.regexp_like(F.lower(piece), F.lit(rf"\A[<\[](?:{'|'.join(SPECIALS)})[>\]]\z"))
    return F.when((token_id < 4) | marked | ~F.regexp_like(piece, F.lit(r"\p{L}")), 2).when(piece.startswith("▁"), 0).otherwise(1)


def token_features(vocabulary: DataFrame) -> DataFrame:
    """(token_id, piece) with all features; rhyme_class numbers endings by their first piece, from 1 (0: none)."""
    t, p = F.col("token_id"), F.col("piece")
    bare = _bare(p)
    wide = vocabulary.select(
        "token_id", "piece", last_vowel_class(bare).alias("last_vowel"), first_vowel_class(bare).alias("first_vowel"), is_word_start(t, p).alias("word_start"), ends_voiceless(bare).alias("voiceless_end"),
        starts_mutable(bare).alias("mutable_start"), syllables(p).alias("syllables"), rhyme_ending(p).alias("ending"), role(t, p).alias("role"), morphology_class(t, p).alias("morphology"),
    )
    return wide.join(rhyme_classes(wide), "ending", "left").withColumn("rhyme_class", F.coalesce("rhyme_class", F.lit(0)))


def rhyme_classes(features: DataFrame) -> DataFrame:
    """(ending, rhyme_class): a window over the distinct endings of a vocabulary, some thousand rows."""
    first = features.where("ending <> ''").groupBy("ending").agg(F.min("token_id").alias("__first"))
    return first.select("ending", F.row_number().over(Window.orderBy("__first")).alias("rhyme_class"))


def inventory(features: DataFrame) -> DataFrame:
    """One row of counts over a vocabulary."""
    names = {
        "pieces": F.count("*"), "back_first": F.count_if(F.col("first_vowel") == 0), "front_first": F.count_if(F.col("first_vowel") == 1), "neutral_first": F.count_if(F.col("first_vowel") == 2),
        "word_starts": F.count_if("word_start"), "voiceless_ends": F.count_if("voiceless_end"), "mutable_suffixes": F.count_if(F.col("mutable_start") & ~F.col("word_start")),
        "roots": F.count_if(F.col("role") == "root"), "suffixes": F.count_if(F.col("role") == "suffix"), "specials": F.count_if(F.col("role") == "special"),
        "with_syllables": F.count_if(F.col("syllables") >= 1), "rhyme_classes": F.max("rhyme_class"),
    }
    return features.agg(*(c.alias(n) for n, c in names.items()))


def transitions(tokens: DataFrame, features: DataFrame, columns: list[str], pad: int = 0) -> DataFrame:
    """(seq_id, pos, token_id, columns, was_<column>...) of neighbours whose second token is no padding."""
    wide = tokens.join(features.select("token_id", *columns), "token_id")
    w = Window.partitionBy("seq_id").orderBy("pos")
    out = wide.withColumns({f"was_{c}": F.lag(c).over(w) for c in [*columns, "pos"]})
    return out.where(F.col("was_pos").isNotNull() & (F.col("token_id") != pad)).drop("was_pos")


def harmony_violation(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """(seq_id, transitions, violations): continuations of a word after a vowel; a violation begins with the other class.

    Null sequences have none; sequences without such a neighbour have no row.
    """
    pairs = transitions(tokens, features, ["last_vowel", "first_vowel", "word_start"]).where(~F.col("word_start") & (F.col("was_last_vowel") != 2))
    wrong = F.col("first_vowel") == 1 - F.col("was_last_vowel")
    return pairs.groupBy("seq_id").agg(F.count("*").alias("transitions"), F.count_if(wrong).alias("violations"))


def assimilation_violation(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """(seq_id, transitions, violations): continuations after a voiceless end; a violation begins with c, d or g."""
    pairs = transitions(tokens, features, ["voiceless_end", "mutable_start", "word_start"]).where(~F.col("word_start") & F.col("was_voiceless_end"))
    return pairs.groupBy("seq_id").agg(F.count("*").alias("transitions"), F.count_if("mutable_start").alias("violations"))


def line_syllables(tokens: DataFrame, features: DataFrame, newline: int = 17) -> DataFrame:
    """tokens with line (from 0), before (syllables on the line before the token), syllables and rhyme_class."""
    wide = tokens.join(features.select("token_id", "syllables", "rhyme_class"), "token_id")
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lined = wide.withColumn("line", F.coalesce(F.sum((F.col("token_id") == newline).cast("int")).over(w), F.lit(0)))
    on_line = Window.partitionBy("seq_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lined.withColumn("before", F.coalesce(F.sum("syllables").over(on_line), F.lit(0)))


def target_metre(lined: DataFrame, newline: int = 17) -> DataFrame:
    """(seq_id, metre): syllables of the first finished line; 11 if there is none or it isn't 4 to 20."""
    first = lined.groupBy("seq_id").agg(F.max(F.when((F.col("token_id") == newline) & (F.col("line") == 0), F.col("before"))).alias("__m"))
    return first.select("seq_id", F.when(F.col("__m").between(4, 20), F.col("__m")).otherwise(F.lit(DEFAULT_METRE)).alias("metre"))


def metre_violation(tokens: DataFrame, features: DataFrame, newline: int = 17, pad: int = 0, shifted: bool = True) -> DataFrame:
    """(seq_id, positions, violations): tokens that run over the metre, end a line early or go on when it is full.

    With `shifted` (the customary form) a token is held against the syllables before the
    token that precedes it; without, against those before itself.
    """
    lined = line_syllables(tokens, features, newline)
    w = Window.partitionBy("seq_id").orderBy("pos")
    before = F.lag("before").over(w) if shifted else F.when(F.lag("pos").over(w).isNotNull(), F.col("before"))
    wide = lined.withColumn("__at", before).join(target_metre(lined, newline), "seq_id").where(F.col("__at").isNotNull() & (F.col("token_id") != pad))
    at, s, m = F.col("__at"), F.col("syllables"), F.col("metre")
    wrong = (at + s > m) | ((F.col("token_id") == newline) & (at < m)) | ((at >= m) & (s >= 1))
    return wide.groupBy("seq_id").agg(F.count("*").alias("positions"), F.count_if(wrong).alias("violations"))


def rhyme_violation(tokens: DataFrame, features: DataFrame, newline: int = 17, pad: int = 0) -> DataFrame:
    """(seq_id, line_ends, violations): line ends after an earlier line end that has a rhyme, and those that don't share it."""
    wide = tokens.join(features.select("token_id", "rhyme_class"), "token_id")
    w = Window.partitionBy("seq_id").orderBy("pos")
    ends = wide.withColumn("__next", F.lead("token_id").over(w)).where((F.col("__next") == newline) & (F.col("token_id") != newline) & (F.col("token_id") != pad))
    expected = F.last(F.when(F.col("rhyme_class") > 0, F.col("rhyme_class")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    due = ends.withColumn("__due", expected).where("__due is not null")
    return due.groupBy("seq_id").agg(F.count("*").alias("line_ends"), F.count_if(F.col("rhyme_class") != F.col("__due")).alias("violations"))


def word_features(docs: DataFrame, words: Column) -> DataFrame:
    """(word, n and the features of words as pieces) of every distinct word in lower case."""
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    w = F.col("word")
    return counted.select(
        "word", "n", syllables(w).alias("syllable_count"), last_vowel_class(w).alias("last_vowel"), first_vowel_class(w).alias("first_vowel"), ends_voiceless(w).alias("voiceless_end"), starts_mutable(w).alias("mutable_start"), rhyme_ending(w).alias("ending")
    )


def text_metre(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, syllables, ending) of every line that isn't blank, numbered from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line", "__t")).where(F.regexp_like("__t", F.lit(r"\S")))
    return lines.select("doc_id", "line", F.regexp_count("__t", F.lit(f"[{VOWELS}]")).alias("syllables"), F.lower(F.right(F.regexp_replace("__t", r"[^\p{L}]+", ""), F.lit(2))).alias("ending"))
