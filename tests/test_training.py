"""Splits, blocks, mixtures, schedules, evaluation, tokenizer and language analysis, pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import evaluation as E
from granary.operators import linguistics as L
from granary.operators import mixture as M
from granary.operators import ordered, tokens, web
from granary.operators import tokenizer_stats as S
from granary.plans import lineage

MIX = {"curriculum_steps": 100, "groups": {"high_quality": {"sources": ["wiki"], "initial_weight": 0.8, "final_weight": 0.4}, "general": {"default": True, "initial_weight": 0.2, "final_weight": 0.6}}}


def test_blocks_like_a_flat_list(spark):
    rng = random.Random(3)
    docs = [(i, "gh"[i % 2], [rng.randrange(100) for _ in range(rng.choice([0, 1, 7, 30, 200]))]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, grp string, ids array<int>")
    for length in (1, 16, 64):
        for within in ([], ["grp"]):
            want = {}
            for g in {d[1] if within else "" for d in docs}:
                flat = [x for _, k, ids in docs if not within or k == g for x in ids]
                n = 0 if len(flat) <= length else (len(flat) - 1) // length
                want |= {(g, b): (flat[b * length : b * length + length], flat[b * length + 1 : b * length + length + 1]) for b in range(n)}
            got = {(r["grp"] if within else "", r["block_id"]): (r["input_ids"], r["labels"]) for r in tokens.pack(df, length, ["doc_id"], within).collect()}
            assert got == want
    pieces = tokens.shard_pieces(df, 100, ["doc_id"], ["grp"]).collect()
    for g in "gh":
        flat = [x for _, k, ids in docs if k == g for x in ids]
        mine = sorted((r["shard_id"], r["at"], r["tokens"]) for r in pieces if r["grp"] == g)
        assert [x for _, _, t in mine for x in t] == flat and all(a + len(t) <= 100 for _, a, t in mine)
    assert tokens.pack(df.where("false"), 16, ["doc_id"]).count() == 0


def test_prefix_sums_and_range_joins(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 7 == 0 else i) for i in range(200)], "k long, g long, v long")
    for parts in (1, 5, 40):
        got = {r["k"]: r["before"] for r in ordered.prefix_sum(df, "v", ["k"], ["g"], parts=parts).collect()}
        assert got == {i: sum(j for j in range(i) if j % 3 == i % 3 and j % 7) for i in range(200)}
    ranges = spark.createDataFrame([("a", 0, 5), ("b", 5, 5), ("c", 5, 300), ("d", 300, 301)], "n string, lo long, hi long")
    got = {r["p"]: r["n"] for r in ordered.range_join(spark.range(301).withColumnRenamed("id", "p"), ranges, "p", "lo", "hi").collect()}
    assert got == {i: "a" if i < 5 else "c" if i < 300 else "d" for i in range(301)}
    once, again = ([r[0] for r in ordered.shuffled(spark.range(50), "id", s).collect()] for s in (1, 1))
    assert once == again != [r[0] for r in ordered.shuffled(spark.range(50), "id", 2).collect()] and sorted(once) == list(range(50))
    f = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "path string, modified long")
    assert [r["path"] for r in ordered.newest(f, 2).collect()] == ["c", "b"]
    assert [r["k"] for r in ordered.take_first(df, ["k"], 3).collect()] == [0, 1, 2]


def test_splits(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text  "), (F.col("id") / 2).cast("int").cast("string")).alias("text"))
    n = tokens.with_split(docs).where("split = 'eval'").count()
    assert 60 < n < 140  # half a percent of 20 000
    assert tokens.content_split(docs).groupBy("text").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert tokens.eval_shard_size(100_000_000) == 10_000_000 and tokens.eval_shard_size(100) == 1_000_000


def test_mixture(spark):
    got = {(r["step"], r["grp"]): round(r["weight"], 9) for r in M.weights(spark.createDataFrame([(0,), (50,), (100,), (900,), (-5,)], "step long"), MIX).collect()}
    assert [got[s, "high_quality"] for s in (0, 50, 100, 900, -5)] == [0.8, 0.6, 0.4, 0.4, 0.8]
    still = MIX | {"curriculum_steps": 0}
    assert M.weights(spark.range(1).withColumnRenamed("id", "step"), still).where("grp = 'high_quality'").first()["weight"] == pytest.approx(0.4)
    docs = spark.createDataFrame([(1, "wiki"), (2, "wiki"), (3, "x"), (4, None)], "doc_id long, source string")
    grouped = M.with_group(docs, MIX).withColumn("split", F.lit("train"))
    assert {tuple(r) for r in tokens.group_docs(grouped, ["high_quality", "general"]).collect()} == {("high_quality", 2), ("general", 2)}
    with pytest.raises(ValueError, match="general"):
        tokens.group_docs(grouped.where("grp <> 'general'"), ["high_quality", "general"])
    assert M.two_groups(["wiki"], 100)["groups"] == M.validated(MIX)["groups"] or M.two_groups(["wiki"], 100)["groups"]["general"]["final_weight"] == pytest.approx(0.6)
    assert M.groups_table(spark, MIX).count() == 2


@pytest.mark.parametrize(
    ("change", "message"),
    [({"version": "x"}, "version"), ({"groups": {}}, "at least one"), ({"groups": {"a b": {"default": True}}}, "name"), ({"groups": {"a": 1}}, "object"), ({"groups": {"a": {}}}, "default"), ({"groups": {"a": {"default": True}, "b": {"default": True}}}, "default"),
     ({"groups": {"a": {"default": True, "sources": ["x"]}, "b": {"sources": ["x"]}}}, "more than one"), ({"groups": {"a": {"default": True, "initial_weight": -1}}}, "finite"), ({"groups": {"a": {"default": True, "initial_weight": math.nan}}}, "finite"),
     ({"groups": {"a": {"default": True, "initial_weight": 0, "final_weight": 0}}}, "no weight"), ({"groups": {"a": {"default": True, "initial_weight": 0}, "b": {"initial_weight": 0}}}, "sum"), ({"curriculum_steps": -1}, "negative")],
)
def test_bad_mixtures(change, message):
    with pytest.raises(ValueError, match=message):
        M.validated(MIX | change)


def test_sampler(spark):
    ranges = spark.createDataFrame([("high_quality", 0, 10), ("general", 10, 15), ("high_quality", 15, 20)], "grp string, start long, end long")
    got = M.sample_blocks(spark, MIX | {"curriculum_steps": 100_000}, ranges, 2000).collect()
    share = sum(r["grp"] == "high_quality" for r in got) / len(got)
    assert len(got) == 2000 and 0.72 < share < 0.88
    assert all((r["block_index"] < 10 or 15 <= r["block_index"] < 20) == (r["grp"] == "high_quality") for r in got)
    counts = [sum(r["block_index"] == b for r in got) for b in (*range(10), *range(15, 20))]
    assert min(counts) > 60  # 15 blocks share about 1600 draws
    whole = {r["sample"]: tuple(r) for r in M.sample_blocks(spark, MIX, ranges, 300).collect()}
    rest = {r["sample"]: tuple(r) for r in M.sample_blocks(spark, MIX, ranges, 300, start=120).collect()}
    assert rest == {k: v for k, v in whole.items() if k >= 120} and whole != {r["sample"]: tuple(r) for r in M.sample_blocks(spark, MIX, ranges, 300, epoch=1).collect()}
    with pytest.raises(ValueError, match="without a block"):
        M.sample_blocks(spark, MIX, ranges.where("grp = 'general'"), 10)


def test_schedules(spark):
    at = lambda c, *steps: [round(r[0], 10) for r in spark.createDataFrame([(s,) for s in steps], "step long").select(c).collect()]
    assert at(M.learning_rate(F.col("step"), 2e-4, 1e-5, 2, 10), 0, 1, 10, 99) == [1e-4, 2e-4, 1e-5, 1e-5]
    assert at(M.warmed_up(F.col("step"), 0.5, 100, 10), 10, 60, 500) == [0.0, 0.25, 0.5] and at(M.suffix_weight(F.col("step"), 2.0, 10), 0, 5, 20) == [1.0, 1.5, 2.0]


# Evaluation


def results(spark, rows):
    return spark.createDataFrame(rows, "id string, benchmark string, category string, score double, correct boolean")


def test_pairs(spark):
    base = results(spark, [("1", "b", "c", 0.0, False), ("2", "b", "c", 1.0, True)])
    better = results(spark, [("1", "b", "c", 1.0, True), ("2", "b", "c", 1.0, True)])
    s = E.paired_summary(E.paired_deltas(better, base)).where("overall = 1").first()
    assert (s["wins"], s["ties"], s["losses"], s["mean_delta"]) == (1, 1, 0, 0.5)
    for rows, problem in (([("1", "b", "c", 1.0, True)], "missing"), ([("1", "b", "x", 1.0, True), ("2", "b", "c", 1.0, True)], "category"), ([("1", "b", "c", math.nan, True), ("2", "b", "c", 1.0, True)], "finite"), ([("1", "b", "c", 1.0, True)] * 2, "repeated")):
        with pytest.raises(ValueError, match=problem):
            E.paired_deltas(results(spark, rows), base)
    assert {tuple(r) for r in E.id_differences(better.where("id = '1'"), base).collect()} == {("2", "missing")}
    row = E.compare_summaries(better, base).first()
    assert row["macro_delta"] == row["micro_delta"] == 0.5 and not E.below(better, 0.9) and E.below(base, 0.9) and E.regressed(base, better, 0.1)
    assert E.bootstrap_mean([0.0, 1.0, 1.0], 200, 7) == E.bootstrap_mean([0.0, 1.0, 1.0], 200, 7) and E.bootstrap_mean([1.0], 1, 1) == (1.0, 1.0)
    got = {r["category"]: (r["ci95_low"], r["ci95_high"]) for r in E.bootstrap(E.paired_deltas(better, base), 500).collect()}
    assert got[None] == E.bootstrap_mean([1.0, 0.0], 500, 42) and got["c"] == E.bootstrap_mean([1.0, 0.0], 500, 43)
    for bad in ({"values": []}, {"values": [1.0], "samples": 0}, {"values": [1.0], "confidence": 1.0}):
        with pytest.raises(ValueError):
            E.bootstrap_mean(**bad)


def test_reports_that_compare():
    a = {"suite_version": 1, "metadata": {"tokenizer_sha256": "t", "benchmark_sha256": {"x": "1"}, "model_config": {}, "global_step": 5, "data_fingerprint_sha256": "d", "training_recipe": {"lr": 1, "experiment_name": "a", "auxiliary_losses": {}}}}
    b = {**a, "metadata": a["metadata"] | {"training_recipe": {"lr": 1, "experiment_name": "b", "auxiliary_losses": {"v": 1}}}}
    E.check_ablation(a, b)
    for change in ({"tokenizer_sha256": "u"}, {"global_step": 6}, {"data_fingerprint_sha256": None}, {"training_recipe": {"lr": 2}}, {"training_recipe": None}):
        with pytest.raises(ValueError):
            E.check_ablation(a, {**b, "metadata": b["metadata"] | change})
    assert "N/A" in E.markdown([{"a": None, "b": 0.5}], {"a": "A", "b": "B"})


def test_metrics_over_model_outputs(spark):
    losses = spark.createDataFrame([(0, 1.0, 2), (1, 3.0, 2), (2, 9.0, 4)], "batch long, loss double, tokens long")
    assert E.perplexity(losses, 2).first()["perplexity"] == pytest.approx(math.exp(2)) and E.mean_eval_loss(losses, 2).first()[0] == 2.0
    with pytest.raises(Exception, match="no token"):
        E.perplexity(losses.where("false")).collect()
    logprob = -math.log(32)
    rows = [("a", i, i < 2, logprob) for i in range(5)] + [("b", i, True, logprob) for i in range(2)]
    toks = spark.createDataFrame(rows, "id string, pos int, is_prompt boolean, logprob double")
    got = {r["id"]: (r["total_logprob"], r["tokens"]) for r in E.continuation_scores(toks, ["id"]).collect()}
    assert got["a"] == (pytest.approx(3 * logprob), 3) and got["b"] == (-math.inf, 0)
    assert {r["id"]: r["tokens"] for r in E.continuation_scores(toks, ["id"], context=3).collect()}["a"] == 2
    scores = spark.createDataFrame([("1", c, m, t, 1, n) for c, m, t, n in ((0, -1.0, -9.0, True), (1, -1.0, -1.0, True))] + [("2", c, m, t, 1, False) for c, m, t in ((0, -1.0, -9.0), (1, -2.0, -1.0))], "id string, choice int, mean_logprob double, total_logprob double, answer int, length_normalize boolean")
    assert {r["id"]: (r["prediction"], r["correct"]) for r in E.choose(scores).collect()} == {"1": (0, False), "2": (1, True)}
    assert [r["correct"] for r in E.prefer(spark.createDataFrame([("1", 0.0, 0.0), ("2", 1.0, 0.0)], "id string, chosen double, rejected double")).orderBy("id").collect()] == [False, True]
    ce = spark.createDataFrame([(5, 1.0, "root"), (6, 3.0, "suffix"), (0, 99.0, "special")], "token_id int, loss double, role string")
    row = E.weighted_loss(ce, L.role_weight(F.col("role"), 3.0)).first()
    assert (row["loss"], row["root_loss"], row["suffix_loss"]) == (2.5, 1.0, 3.0)


def test_filters_of_generation(spark):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.5, 0.3, 0.1, 0.1))], "seq int, token_id int, prob double")
    assert E.nucleus(p, 0.7, ["seq"]).count() == 2 and E.nucleus(p, 0.7, ["seq"], keep_crossing=False).count() == 1 and E.nucleus(p, 0.4, ["seq"], keep_crossing=False).count() == 0
    assert E.top_k(p.withColumnRenamed("prob", "score"), 3, ["seq"]).count() == 4
    ids = spark.createDataFrame([([1, 2, 3, 1, 2, 4, 1, 2],), ([1],), ([],), ([5, 5, 5],)], "ids array<int>")
    assert [r[0] for r in ids.select(E.banned_next(F.col("ids"), 3)).collect()] == [[3, 4], [], [], [5]]
    assert [r[0] for r in ids.select(E.banned_next(F.col("ids"), 1)).collect()][1] == [1]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    form = lambda t: one(T.answer_form(F.lit(t)))
    assert form("İSTANBUL'dur!") == "istanbul dur" and form("H₂O") == "h2o" and form("ILIK Işık") == "ılık ışık"
    for a, b in (("", ""), ("abc", "abd"), ("abc", "abcdef"), ("x", ""), ("a" * 1000, "a" * 999 + "b")):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert one(T.common_prefix_length(F.lit(a), F.lit(b))) == n
    assert one(T.leaked(F.lit("abcde"), F.lit("abcdX"))) is True and one(T.leaked(F.lit("abcde"), F.lit("abXXX"))) is False
    refs = F.array(F.lit("ankara"), F.lit(""))
    assert one(T.reference_match(F.lit("the capital is ankara"), refs, F.lit("contains"))) is True and one(T.reference_match(F.lit("x"), refs, F.lit("contains"))) is False
    assert one(T.reference_match(F.lit("ankara"), refs, F.lit("exact"))) is True and one(T.matching_keywords(F.array(F.lit("bomb"), F.lit("x")), F.lit("a bomb"))) == ["bomb"]
    prompt = one(T.long_context(F.lit("f"), F.lit("N"), F.lit("q?"), F.lit(4), F.lit(20), F.lit(0.5)))
    assert prompt == "Bağlam:\nf f N f f f\n\nSoru: q?\nYanıt:"
    assert one(T.lexical_words(F.lit("Ali'nin 3 evi var_mı x2"))) == 7
    assert one(T.roundtrip_form(F.lit(" ﬁ  x "))) == "fi x"


# Tokenizers and language


def pieces():
    return S.Pieces.bytes_and(["▁ev", "▁evler", "ler", "▁", "de", "x"])


def test_tokenizer(spark):
    tok = pieces()
    for t in ("evler evde", "çğ x", "ev", ""):
        assert tok.decode(tok.encode(t, True, True)) == t
    docs = spark.createDataFrame([("evler ev", "a"), ("ev", "b"), (None, "a"), (" ", "a"), ("çok", None)], "text string, domain string")
    rows = {r["domain"] or ("all" if r["overall"] else "unknown"): r for r in S.corpus_stats(S.measured(docs, pieces)).collect()}
    assert rows["all"]["documents"] == 3 and rows["b"]["tokens_per_word"] == 1.0 and rows["all"]["roundtrip_exact_rate"] == 1.0 and rows["a"]["byte_token_rate"] == 0 and rows["unknown"]["byte_token_rate"] > 0
    assert S.gate(S.corpus_stats(S.measured(docs, pieces)), max_tokens_per_word=0.5, min_roundtrip=1.0) == ["tokens_per_word"]
    assert [r["ids"] for r in S.encoded(docs.limit(3), pieces).collect()][2] == []
    cover = {r["character"]: r for r in S.character_coverage(spark, pieces).collect()}
    assert len(cover) == 12 and cover["ç"]["tokens"] == 3 and not cover["ç"]["unknown"]
    probes = spark.createDataFrame([("ev", ["▁ev"], "evler", "ler", ["▁ev", "ler"]), ("ev", ["▁ev"], "evde", "de", ["▁evde"])], "lemma string, lemma_pieces array<string>, form string, suffix string, pieces array<string>")
    row = S.morphology(probes).first()
    assert (row["forms"], row["tokens_per_form"], row["lemma_prefix_reuse_rate"], row["exact_suffix_boundary_rate"], row["single_token_form_rate"]) == (2, 1.5, 0.5, 0.5, 0.5)
    ids = spark.createDataFrame([([1, 2, 3],), ([4],)], "ids array<int>")
    assert [(r["ids"], r["mask"]) for r in tokens.padded(ids, 2, 9).collect()] == [([1, 2], [1, 1]), ([4, 9], [1, 0])]


VOCABULARY = ["<pad>", "<unk>", "<s>", "</s>", "▁kitap", "lar", "ler", "▁ağaç", "cı", "dır", "▁göz", "da", "?", "▁I", "ŞEF", "▁ab", "ar", "<0x0A>", "▁mask", "[MASK]"]


def test_features(spark):
    voc = spark.createDataFrame(list(enumerate(VOCABULARY)), "token_id long, piece string")
    f = {r["piece"]: r for r in L.token_features(voc).collect()}
    assert (f["▁kitap"]["last_vowel"], f["▁kitap"]["first_vowel"], f["▁göz"]["last_vowel"], f["?"]["last_vowel"], f["▁I"]["last_vowel"]) == (0, 1, 1, 2, 0)
    assert f["▁kitap"]["voiceless_end"] and f["ŞEF"]["voiceless_end"] and not f["lar"]["voiceless_end"] and f["cı"]["mutable_start"] and f["da"]["mutable_start"] and not f["lar"]["mutable_start"]
    assert f["▁kitap"]["syllables"] == 2 and f["<0x0A>"]["syllables"] == 0 and f["lar"]["ending"] == "ar" and f["<s>"]["ending"] == "" and f["lar"]["rhyme_class"] == f["ar"]["rhyme_class"] > 0
    assert f["<s>"]["role"] == "special" and f["▁göz"]["role"] == "root" and f["da"]["role"] == "suffix" and f["[MASK]"]["morphology"] == 2 and f["?"]["morphology"] == 2 and f["da"]["morphology"] == 1 and f["<s>"]["word_start"]
    row = L.inventory(L.token_features(voc)).first()
    assert row["pieces"] == 20 and row["back_first"] + row["front_first"] + row["neutral_first"] == 20 and row["specials"] == 4
    ends = [f[p]["ending"] for p in VOCABULARY if f[p]["ending"]]
    assert {f[p]["ending"]: f[p]["rhyme_class"] for p in VOCABULARY if f[p]["ending"]} == {e: i + 1 for i, e in enumerate(dict.fromkeys(ends))}


def test_sequences_like_plain_python(spark):
    voc = spark.createDataFrame(list(enumerate(VOCABULARY)), "token_id long, piece string")
    f = {r["token_id"]: r for r in L.token_features(voc).collect()}
    rng, nl = random.Random(4), 17
    seqs = {s: [rng.choice([0, 4, 5, 6, 7, 8, 9, 10, 11, 15, 16, nl, nl]) for _ in range(40)] for s in range(12)}
    want = {"harmony": {}, "assimilation": {}, "metre": {}, "rhyme": {}}
    for s, ids in seqs.items():
        pairs = [(a, b) for a, b in zip(ids, ids[1:], strict=False) if b != 0 and not f[b]["word_start"]]
        h = [(a, b) for a, b in pairs if f[a]["last_vowel"] != 2]
        want["harmony"][s] = (len(h), sum(f[b]["first_vowel"] == 1 - f[a]["last_vowel"] for a, b in h))
        v = [(a, b) for a, b in pairs if f[a]["voiceless_end"]]
        want["assimilation"][s] = (len(v), sum(f[b]["mutable_start"] for _, b in v))
        first = ids.index(nl) if nl in ids else None
        metre = sum(f[i]["syllables"] for i in ids[:first]) if first is not None else 11
        metre = metre if 4 <= metre <= 20 else 11
        total, before = 0, []
        for i in ids:
            before.append(total)
            total = 0 if i == nl else total + f[i]["syllables"]
        n = bad = 0
        for t in range(1, len(ids)):
            i, at, y = ids[t], before[t - 1], f[ids[t]]["syllables"]
            if i:
                n += 1
                bad += at + y > metre or (i == nl and at < metre) or (at >= metre and y >= 1)
        want["metre"][s] = (n, bad)
        last, due = 0, []
        for t in range(len(ids) - 1):
            if ids[t + 1] == nl and ids[t] not in (nl, 0):
                r = f[ids[t]]["rhyme_class"]
                if last:
                    due.append(r != last)
                last = r or last
        want["rhyme"][s] = (len(due), sum(due))
    df = spark.createDataFrame([(s, p, i) for s, ids in seqs.items() for p, i in enumerate(ids)], "seq_id long, pos long, token_id long")
    feats = L.token_features(voc)
    for name, fn in (("harmony", L.harmony_violation), ("assimilation", L.assimilation_violation), ("metre", L.metre_violation), ("rhyme", L.rhyme_violation)):
        got = {r[0]: (r[1], r[2]) for r in fn(df, feats).collect()}
        assert got == {s: v for s, v in want[name].items() if v[0]}, name


# Pages


def test_main_text_and_links(spark):
    page = "<html><body><nav><a href='/n'>menu</a></nav><div class='content x'>side</div><main><p>One <b>two</b></p><script>no</script></main><a href='b?page=2'>x</a><a href='http://other.example/'>o</a><a href='/login'>l</a><a href='#t'>t</a></body></html>"
    assert web.read_page(page)[0] == "One\ntwo" and web.read_page("<body>a<article>b</article></body>")[0] == "b" and web.read_page("<div>plain")[0] == "plain" and web.read_page("")[0] is None and web.read_page(None) == (None, [])
    assert web.read_page("<body><form>x</form>y</body>")[0] == "y"
    pages = spark.createDataFrame([(1, "http://h.example:8/a/", page), (2, "http://h.example:8/n", "<body>" + "w " * 60 + "<a href='/a/'>b</a><a href='/z'>z</a></body>"), (3, None, page), (4, "http://h.example:8/z", None)], "page_id long, url string, html string")
    assert [r["link"] for r in web.links(pages.where("page_id = 1")).orderBy("place").collect()] == ["http://h.example:8/n", "http://h.example:8/a/#t"]
    seeds = spark.createDataFrame([("http://h.example:8/a/",)], "url string")
    assert {tuple(r) for r in web.crawl(pages, seeds).collect()} == {("http://h.example:8/a/", 0), ("http://h.example:8/n", 1), ("http://h.example:8/z", 2)}
    assert {tuple(r) for r in web.crawl(pages, seeds, max_depth=1).collect()} == {("http://h.example:8/a/", 0), ("http://h.example:8/n", 1)}
    got = web.crawled_documents(pages.where("url is not null")).collect()
    assert [(r["url"], r["source"], r["word_count"]) for r in got] == [("http://h.example:8/n", "h.example:8", 62)]
    many = spark.createDataFrame([("http://h.example/", "".join(f"<a href='/{i}'>x</a>" for i in range(30)))], "url string, html string")
    assert web.page_links(many).count() == 10


def test_intermediate_tables_go(spark):
    lineage.table(spark.range(3), "test")
    assert lineage.release(spark) >= 1 and lineage.release(spark) == 0
