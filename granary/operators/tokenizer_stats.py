"""Tokenizers and what they make of a corpus: fertility, coverage, morphology, vocabulary.

A tokenizer is any object with encode(text) -> ids, decode(ids) -> text, id_to_token(id),
get_vocab_size() and unk_token_id. `Pieces` is one over a list of pieces (greedy longest
match, bytes for what no piece covers); trained ones can be put in its place.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

TURKISH = "çğıöşüÇĞİÖŞÜ"
PAD, UNK, BOS, EOS = range(4)


class Pieces:
    """Greedy longest match over pieces; the order gives ids, `▁` stands for a space."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.ids = pieces, {}
        for i, p in enumerate(pieces):
            self.ids.setdefault(p, i)
        self.longest = max((len(p) for p in pieces), default=1)
        self.unk_token_id = self.ids.get("<unk>", UNK)

    @classmethod
    def bytes_and(cls, words: list[str]) -> Pieces:
        """The four special pieces, all bytes, and the words."""
        return cls(["<pad>", "<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), *words])

    def get_vocab_size(self) -> int:
        return len(self.pieces)

    def id_to_token(self, i: int) -> str:
        return self.pieces[i]

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        s, out, i = "▁" + " ".join(text.split()).replace(" ", "▁") if text.split() else "", [], 0
        while i < len(s):
            for j in range(min(len(s), i + self.longest), i, -1):
                if (k := self.ids.get(s[i:j])) is not None:
                    out.append(k)
                    i = j
                    break
            else:
                out += [self.ids.get(f"<0x{b:02X}>", self.unk_token_id) for b in s[i].encode()]
                i += 1
        return [BOS] * add_bos + out + [EOS] * add_eos

    def decode(self, ids: list[int]) -> str:
        raw = bytearray()
        for i in ids:
            if i in (PAD, BOS, EOS):
                continue
            p = self.pieces[i]
            raw += bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return raw.decode(errors="replace").replace("▁", " ").strip()


def encoded(docs: DataFrame, make: Callable[[], object], text: str = "text", into: str = "ids") -> DataFrame:
    """docs with token ids; `make` builds the tokenizer, once in a task. A null text has none."""
    other = [c for c in docs.columns if c != into]

    def run(batches):
        tok = make()
        for b in batches:
            b[into] = [tok.encode(t) if isinstance(t, str) else [] for t in b[text]]
            yield b

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other), f"`{into}` array<int>"])
    return docs.select(*other).mapInPandas(run, schema)


def measured(docs: DataFrame, make: Callable[[], object], domain: str = "domain", text: str = "text") -> DataFrame:
    """(domain, text, ids, pieces, unknown, bytes, exact) of documents that aren't blank."""
    base = docs.select(F.coalesce(F.col(domain).cast("string"), F.lit("unknown")).alias("domain"), F.col(text).alias("text")).where(T.word_count(F.col(text)) > 0)

    def run(batches):
        tok = make()
        for b in batches:
            ids = [tok.encode(t) for t in b["text"]]
            b["ids"], b["pieces"] = ids, [[tok.id_to_token(i) for i in x] for x in ids]
            b["unknown"] = [sum(i == tok.unk_token_id for i in x) for x in ids]
            b["decoded"] = [tok.decode(x) for x in ids]
            yield b

    wide = base.mapInPandas(run, "domain string, text string, ids array<int>, pieces array<string>, unknown int, decoded string")
    exact = T.roundtrip_form(F.col("decoded")) == T.roundtrip_form(F.col("text"))
    return wide.select("domain", "text", "ids", "pieces", "unknown", exact.alias("exact"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """The metrics of (domain, text, ids, pieces, unknown, exact) by domain, and over all as a null domain.

    Ratios are null where there is nothing to divide by; percentiles are exact and interpolated.
    """
    facts = rows.select(
        "domain", T.lexical_words(F.col("text")).alias("w"), T.solid_length(F.col("text")).alias("c"), F.octet_length("text").alias("b"), F.size("ids").alias("t"), F.col("unknown").alias("u"),
        F.size(F.filter("pieces", lambda p: p.startswith("<0x") & T.is_byte_piece(p))).alias("y"), F.col("exact").cast("int").alias("e"),
    )
    s = {k: F.coalesce(F.sum(k), F.lit(0)) for k in "wcbtuye"}
    n = F.count("*")
    return facts.groupingSets([["domain"], []], "domain").agg(
        F.grouping("domain").alias("overall"), n.alias("documents"), s["w"].alias("words"), s["c"].alias("characters"), s["b"].alias("utf8_bytes"), s["t"].alias("tokens"),
        F.try_divide(s["t"], s["w"]).alias("tokens_per_word"), F.try_divide(s["c"], s["t"]).alias("characters_per_token"), F.try_divide(s["b"], s["t"]).alias("utf8_bytes_per_token"),
        F.try_divide(s["u"], s["t"]).alias("unknown_rate"), F.try_divide(s["y"], s["t"]).alias("byte_token_rate"), F.try_divide(s["e"], n).alias("roundtrip_exact_rate"),
        F.percentile("t", 0.5).alias("document_tokens_p50"), F.percentile("t", 0.95).alias("document_tokens_p95"), F.coalesce(F.max("t"), F.lit(0)).alias("document_tokens_max"),
    )


def length_percentiles(docs: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """(by, docs, p50, p95, longest) of word counts, interpolated exactly."""
    wide = docs.select(by, T.word_count(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    return wide.groupBy(by).agg(F.count("*").alias("docs"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("longest"))


def morphology_details(probes: DataFrame) -> DataFrame:
    """(lemma, form, suffix, tokens, lemma_prefix_reuse, exact_suffix_boundary) of (lemma, lemma_pieces, form, suffix, pieces)."""
    least = F.least(F.size("lemma_pieces"), F.size("pieces"))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    first_other = F.array_min(F.filter(places, lambda i: F.element_at("lemma_pieces", i) != F.element_at("pieces", i)))
    common = F.coalesce(first_other - 1, least)
    bare = F.transform("pieces", lambda p: F.regexp_replace(p, r"\A▁+", ""))
    return probes.select("lemma", "form", "suffix", F.size("pieces").alias("tokens"), F.coalesce(F.try_divide(common, F.size("lemma_pieces")), F.lit(0.0)).alias("lemma_prefix_reuse"), F.array_contains(bare, F.col("suffix")).alias("exact_suffix_boundary"))


def morphology(probes: DataFrame) -> DataFrame:
    """One row over the details: forms, tokens_per_form and three rates; null rates without a form."""
    share = lambda c: F.avg(c.cast("double"))
    return morphology_details(probes).agg(
        F.count("*").alias("forms"), F.avg("tokens").alias("tokens_per_form"), F.avg("lemma_prefix_reuse").alias("lemma_prefix_reuse_rate"),
        share(F.col("exact_suffix_boundary")).alias("exact_suffix_boundary_rate"), share(F.col("tokens") == 1).alias("single_token_form_rate"),
    )


def vocabulary(pieces: DataFrame) -> DataFrame:
    """One row of counts over (token_id, piece)."""
    p = F.col("piece")
    bare, start, byte = F.regexp_replace(p, r"\A▁+", ""), p.startswith("▁"), T.is_byte_piece(p)
    return pieces.agg(
        F.count("*").alias("size"), F.count_if(byte).alias("byte_pieces"), F.count_if(start).alias("word_start_pieces"), F.count_if(~start & F.regexp_like(p, F.lit(r"\p{L}"))).alias("continuation_pieces"),
        F.count_if((F.length(bare) == 1) & ~byte).alias("single_character_pieces"),
    )


def character_coverage(spark, make: Callable[[], object], characters: str = TURKISH) -> DataFrame:
    """(character, tokens, unknown, pieces) of the letters a Turkish tokenizer should know."""
    rows = spark.createDataFrame([(c,) for c in characters], "character string")

    def run(batches):
        tok = make()
        for b in batches:
            ids = [tok.encode(c) for c in b["character"]]
            yield pd.DataFrame({"character": b["character"], "tokens": list(map(len, ids)), "unknown": [tok.unk_token_id in x for x in ids], "pieces": [[tok.id_to_token(i) for i in x] for x in ids]})

    return rows.mapInPandas(run, "character string, tokens int, unknown boolean, pieces array<string>")


def gate(stats: DataFrame, max_tokens_per_word: float | None = None, max_unknown: float | None = None, max_bytes: float | None = None, min_roundtrip: float | None = None) -> list[str]:
    """The limits that the overall row of `corpus_stats` breaks; a ratio that can't be formed breaks its limit."""
    row = stats.where("overall = 1").first()
    limits = [("tokens_per_word", max_tokens_per_word, 1), ("unknown_rate", max_unknown, 1), ("byte_token_rate", max_bytes, 1), ("roundtrip_exact_rate", min_roundtrip, -1)]
    return [name for name, limit, sign in limits if limit is not None and (row[name] is None or sign * (row[name] - limit) > 0)]
