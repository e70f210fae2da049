"""Readers of JSON lines, JSON, text, benchmark and vocabulary files.

Rows keep where they come from: `file` (the base name) and `ord`, which sorts the lines
of a file as they stand. `ord` follows the place of a line in its file, so it doesn't
depend on how the file is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from granary.functions import text as T

POLICIES = ("drop", "count", "raise")


def lines(spark: SparkSession, path: str, suffix: str = ".jsonl", recursive: bool = False) -> DataFrame:
    """(path, file, ord, line) of all files of the suffix; empty lines and hidden files are left out, as are other files.

    `ord` numbers a file's lines by their order in the splits that hold them.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{suffix}")
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), F.col("value").alias("line"))
    named = raw.withColumn("file", F.element_at(F.split("path", "/"), -1))
    # a split is read by one task in order, so (block start, running id) sorts a file's lines
    return named.where(T.trim_all(F.col("line")) != "").select("path", "file", F.struct(F.col("__b").alias("block"), F.col("__i").alias("row")).alias("ord"), "line")


def jsonl(spark: SparkSession, path: str, schema: str | t.StructType, policy: str = "drop", recursive: bool = False) -> DataFrame:
    """Objects of JSON lines under `schema`, with file and ord.

    Lines that are no object are dropped, kept with `malformed` true (count), or raise
    when the rows are used. A field of another type than asked for is null.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    base = lines(spark, path, recursive=recursive)
    ok = F.json_object_keys("line").isNotNull()
    wide = base.withColumns({"malformed": ~ok, "d": F.from_json("line", schema)})
    if policy == "raise":
        wide = wide.withColumn("malformed", F.when(ok, F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), "file")).cast("boolean"))).where(~F.col("malformed"))
    elif policy == "drop":
        wide = wide.where(~F.col("malformed"))
    out = wide.select("file", "ord", *(["malformed"] if policy == "count" else []), "d.*")
    return out


DOCUMENT = "text string, source string, url string, source_url string, id string, source_record_id string, timestamp string, downloaded_at string, title string"


def documents(spark: SparkSession, path: str, sources: list[str] | None = None, policy: str = "drop") -> DataFrame:
    """Documents of JSON lines that have a text, of the given sources or of all."""
    out = jsonl(spark, path, DOCUMENT, policy).where(F.length("text") > 0)
    return out if sources is None else out.where(F.coalesce("source", F.lit("")).isin(*sources))


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, ".txt").select("file", "ord", T.trim_all(F.col("line")).alias("text"))


def training_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, text) of .jsonl objects and .txt lines; texts that are empty are left out."""
    return jsonl(spark, path, "text string").where(F.length("text") > 0).select("file", "ord", "text").unionByName(_text_lines(spark, path))


def analysis_documents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(file, ord, text, domain) of .jsonl, .json and .txt files; domain falls back to the file's stem.

    A .json file is a list or holds one as `documents`. Malformed JSON lines raise.
    """
    stem = F.regexp_replace("file", r"\.[^.]*\z", "")
    fields = "text string, domain string"
    rows = [jsonl(spark, path, fields, "raise").select("file", "ord", "text", "domain"), _text_lines(spark, path).withColumn("domain", F.lit(None).cast("string"))]
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value"))
    is_list = F.regexp_like("value", F.lit(r"\A\s*\["))
    items = F.when(is_list, F.from_json("value", f"array<struct<{_typed(fields)}>>")).otherwise(F.from_json("value", f"documents array<struct<{_typed(fields)}>>")["documents"])
    rows.append(whole.select("file", F.posexplode(items).alias("i", "d")).select("file", F.struct(F.lit(0).cast("long").alias("block"), F.col("i").cast("long").alias("row")).alias("ord"), "d.*"))
    out = reduce(DataFrame.unionByName, rows).where(T.word_count(F.col("text")) > 0).withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), stem, F.lit("unknown")))
    return out if most is None else out.orderBy("file", "ord").limit(most)


def _typed(fields: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (f.split() for f in fields.split(", ")))


def seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, probes) of a tokenizer's seed file: (domain, text) and (lemma, form, suffix); raises if either is empty."""
    form = "struct<text: string, suffix: string>"
    raw = spark.read.schema(f"documents array<struct<domain: string, text: string>>, morphology array<struct<lemma: string, forms: array<{form}>>>").option("multiLine", "true").json(path)
    docs = raw.select(F.explode("documents").alias("d")).select("d.*")
    probes = raw.select(F.explode("morphology").alias("m")).select("m.lemma", F.explode("m.forms").alias("f")).select("lemma", F.col("f.text").alias("form"), "f.suffix")
    if docs.isEmpty() or probes.isEmpty():
        raise ValueError("a seed file needs documents and morphology")
    return docs, probes


# Benchmarks

SCALARS = ("text", "prompt", "question", "chosen", "rejected", "needle", "reference", "filler")
LISTS = ("choices", "references")


def _entry(name: str):
    return lambda v, i: F.struct(F.concat(F.lit(f"{name}:"), i.cast("string")).alias("n"), v.alias("v"))


def flattened(records: DataFrame, base: str = "id") -> DataFrame:
    """(record_id, text): a row for each text field (`id:field`) and list entry (`id:field:index`) that isn't empty."""
    fields = [F.struct(F.lit(n).alias("n"), F.col(n).cast("string").alias("v")) for n in SCALARS if n in records.columns]
    parts = []
    if fields:
        parts.append(F.array(*fields))
    for n in LISTS:
        if n in records.columns:
            parts.append(F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), _entry(n)))
    wide = records.select(F.col(base).cast("string").alias("__id"), F.explode(F.concat(*parts)).alias("x"))
    return wide.where(F.length("x.v") > 0).select(F.concat_ws(":", "__id", "x.n").alias("record_id"), F.col("x.v").alias("text"))


def numbered(df: DataFrame) -> DataFrame:
    """`df` with `line_no`, from 1 within each file; benchmark files are small enough for a window each."""
    from pyspark.sql import Window

    return df.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("ord")))


def benchmark_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, text) of .jsonl records, flattened, and .txt lines (`file:line`); malformed lines are dropped.

    Line numbers count the lines that aren't blank. A record without an id is named by its line.
    """
    kinds = ", ".join([*(f"{n} string" for n in ("id", *SCALARS)), *(f"{n} array<string>" for n in LISTS)])
    rows = numbered(lines(spark, path)).withColumn("__line", F.concat_ws(":", "file", "line_no"))
    rows = rows.where(F.json_object_keys("line").isNotNull()).select("__line", F.from_json("line", kinds).alias("d")).select("__line", "d.*").withColumn("id", F.coalesce("id", "__line"))
    text = numbered(lines(spark, path, ".txt")).select(F.concat_ws(":", "file", "line_no").alias("record_id"), T.trim_all(F.col("line")).alias("text"))
    return flattened(rows).unionByName(text)


REQUIRED = {
    "multiple_choice": ("prompt", "choices", "answer"),
    "pairwise": ("prompt", "chosen", "rejected"),
    "generation": ("prompt", "references"),
    "long_context": ("filler", "needle", "question", "choices", "answer"),
    "safety": ("prompt", "unsafe_keywords"),
    "memorization": ("prompt", "reference"),
}
SAMPLE = (
    "id string, type string, category string, prompt string, choices array<string>, answer string, chosen string, rejected string, references array<string>, match string, filler string, needle string, question string,"
    " unsafe_keywords array<string>, refusal_keywords array<string>, reference string, leak_threshold double, target_tokens int, needle_position double, length_normalize boolean, max_new_tokens int, skill string"
)


def sample_problems(rows: DataFrame) -> DataFrame:
    """(file, line_no, problem) of typed samples (file, line_no, line) that can't be used, repeated ids included."""
    wide = rows.withColumns({"keys": F.json_object_keys("line"), "d": F.from_json("line", SAMPLE)})
    lacks = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), "keys")) > 0
    kind = F.col("d.type")
    typed = F.lit(False)
    for name, fields in REQUIRED.items():
        typed = F.when(kind == name, lacks(fields)).otherwise(typed)
    index = F.expr("try_cast(d.answer as int)")
    has_choices = F.array_contains("keys", "choices")
    problem = (
        F.when(F.col("keys").isNull(), "malformed").when(lacks(("id", "type", "category")), "field is missing").when(~kind.isin(*REQUIRED) | kind.isNull(), "unknown type").when(typed, "field of the type is missing")
        .when(has_choices & (F.coalesce(F.size("d.choices"), F.lit(0)) < 2), "fewer than two choices")
        .when(has_choices & (index.isNull() | (index < 0) | (index >= F.size("d.choices"))), "answer is no index of a choice")
    )
    own = wide.withColumn("problem", problem)
    twice = own.where("problem is null").groupBy("d.id").agg(F.count("*").alias("n"), F.max("file").alias("file"), F.max("line_no").alias("line_no")).where("n > 1")
    return own.where("problem is not null").select("file", "line_no", "problem").unionByName(twice.select("file", "line_no", F.lit("repeated id").alias("problem")))


def samples(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Typed evaluation samples with `benchmark`, the stem of their file; raises on any problem.

    With `most`, only the first that many are read and judged.
    """
    rows = numbered(lines(spark, path))
    if most is not None:
        rows = rows.orderBy("file", "ord").limit(most)
    bad = sample_problems(rows).orderBy("file", "line_no").limit(20).collect()
    if bad:
        raise ValueError(f"benchmark samples can't be used: {[tuple(r) for r in bad]}")
    out = rows.select("file", "ord", F.from_json("line", SAMPLE).alias("d")).select(F.regexp_replace("file", r"\.jsonl\z", "").alias("benchmark"), "ord", "d.*")
    if out.isEmpty():
        raise ValueError(f"no benchmark sample in {path}")
    return out.withColumn("answer", F.expr("try_cast(answer as int)"))


# Vocabulary and others


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, piece, score) of lines `piece<TAB>score`; ids are row numbers, so the file is read as one."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)).alias("token_id", "row"))
    cut = F.split("row", "\t", -1)
    return rows.select("token_id", cut[0].alias("piece"), F.expr("try_cast(try_element_at(split(row, '\t', -1), 2) as double)").alias("score"))


PARAGRAPHS = [
    "Tarla, köyün temelidir ve binlerce yıldır insanlara ekmek verir.", "Deniz kıyısındaki kasabada her sabah balıkçılar ağlarını toplar.", "Eski kitaplar, geçmişin sesini bugüne taşıyan sessiz tanıklardır.",
    "Dağların ardında güneş batarken köy yavaş yavaş sessizliğe gömülür.", "Bilim insanları yeni bir yıldızın doğuşunu gözlemlemeyi başardı.", "Çarşıdaki küçük dükkânda her gün taze kahve kavrulur.",
    "Öğrenciler okulun bahçesinde bahar şenliği için hazırlık yapıyor.", "Şehrin kalabalık sokaklarında müzik sesleri birbirine karışıyordu.", "Irmağın iki yakasını birleştiren köprü geçen yüzyılda yapıldı.", "Yağmur yağdığında çimen kokusu bütün ovayı sarar.",
]


def generated(spark: SparkSession, n: int, seed_value: int = 42) -> DataFrame:
    """(doc_id, text, source): sample paragraphs in turn; from the second round on, each with another one behind it."""
    pool, i = F.array(*map(F.lit, PARAGRAPHS)), F.col("id")
    own = F.element_at(pool, (i % len(PARAGRAPHS) + 1).cast("int"))
    other = F.element_at(pool, (F.pmod(F.xxhash64(i, F.lit(seed_value)), F.lit(len(PARAGRAPHS))) + 1).cast("int"))
    return spark.range(n).select(i.alias("doc_id"), F.when(i < len(PARAGRAPHS), own).otherwise(F.concat_ws(" ", own, other)).alias("text"), F.lit("sample").alias("source"))


def combined(*parts: DataFrame) -> DataFrame:
    """All rows of several sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def check_paths(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jsonl", ".txt"), what: str = "data") -> list[str]:
    """The files of these suffixes in a folder of any file system; raises, with a hint where such files are, if there are none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(f"{what} not found: {path}")
    if not fs.getFileStatus(folder).isDirectory():
        return [path]
    entries = list(fs.listStatus(folder))
    found = sorted(str(e.getPath()) for e in entries if not e.isDirectory() and e.getPath().getName().endswith(suffixes))
    if not found:
        inner = [e.getPath().getName() for e in entries if e.isDirectory() and any(x.getPath().getName().endswith(suffixes) for x in fs.listStatus(e.getPath()))]
        raise FileNotFoundError(f"no {what} of {', '.join(suffixes)} in {path}" + (f"; try {', '.join(inner)}" if inner else ""))
    return found
