import numpy as np
import pytest

from granary.llm import jaccard_join, lm_score, line_templates, lsa_decontaminate, packing, quality_pu, suffix_dedup, topk_search
from granary.llm.registry import ORACLES, QUERIES
from tests.compare import both

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, part int, label string"
PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, names that clash."""
    rows = [(1, PASSAGE), (2, "a b " + PASSAGE), (2, "a b " + PASSAGE), (3, None), (4, ""), (None, PASSAGE), (5, "one"), (6, " ".join(f"x{i}" for i in range(30_000))), (7, "\n\n \t")]
    return spark.createDataFrame([(i, t, None, None, None, "z", 1, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, sql = both(spark, QUERIES[name], ORACLES[name], DIR)
    assert ours == sql


def test_repeats(odd, none):
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["duplicate_words"]) for r in suffix_dedup.repeats(odd).collect()}
    assert got[1] == (0, 60, 0) and got[2][:2] == (0, 62) and set(got) == {1, 2}
    assert suffix_dedup.repeats(none).count() == 0


def test_scores(odd, none):
    got = [(r["doc_id"], r["words"], r["score"] is None) for r in lm_score.stupid_backoff(odd).collect()]
    assert sorted(got) == [(1, 60, False), (2, 62, False), (2, 62, False), (3, 0, True), (4, 0, True), (5, 1, False), (6, 30_000, False), (7, 0, True)]
    assert lm_score.stupid_backoff(none).count() == 0


def test_similar(odd, none):
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in jaccard_join.similar(odd).collect()}
    assert got == {(1, 2): round(59 / 61, 6)}
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(odd).collect()) == [1, 3, 4, 5, 6, 7]
    assert jaccard_join.similar(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    assert {tuple(r) for r in jaccard_join.classes(odd).collect()} == {(1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 0, 0), (4, 4, 0, 0), (5, 5, 0, 0), (6, 6, 0, 0), (7, 7, 0, 0)}
    assert jaccard_join.classes(none).count() == 0


def test_classes_against_all_pairs(spark):
    """Groups of near copies, chains, copies of copies and an id with two texts: class, links and copies as counted one by one."""
    rng, rows = np.random.default_rng(8), []
    for g in range(6):
        a = [f"g{g}w{i}" for i in range(40 + 9 * g)]
        for k in range(12):
            rows.append((len(rows), " ".join(a)))
            if k % 3:
                a = list(a)
                for i in rng.choice(len(a), 1 + k % 2, replace=False):
                    a[i] = f"g{g}n{k}x{i}"
    rows += [(100 + i, rows[5][1]) for i in range(30)] + [(7, rows[7][1]), (7, rows[70][1]), (200, "one"), (201, "one"), (202, None), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets: dict[int, set] = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").split()
            sets.setdefault(i, set()).add(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w))
    alike = lambda x, y: bool(x and y) and len(x & y) / len(x | y) >= 0.75
    pairs = {(i, j) for i in sets for j in sets if i < j and any(alike(x, y) for x in sets[i] for y in sets[j])}
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in jaccard_join.similar(docs, all_pairs=True).collect()}
    assert got == pairs
    least = {i: i for i in sets}
    for _ in sets:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    found = {r["doc_id"]: r for r in jaccard_join.classes(docs).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == least
    everything = {x for i in sets for x in sets[i]}
    for i, r in found.items():
        if i != 7:
            (x,) = sets[i]
            assert r["copies"] == sum(x in s for s in sets.values()) - 1 if x else r["copies"] == 0
            others = {y for y in everything if y != x and alike(x, y)}
            assert r["links"] == len(others), i
    kept = [r["doc_id"] for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(least.values())) and None not in kept


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.75, 0.6])
def test_no_pair_is_lost(threshold):
    """Signatures of random sets at the threshold, of many sizes: each pair shares one."""
    rng, spaces = np.random.default_rng(4), jaccard_join.Spaces(threshold, 1 << 13)
    heavy, checked = rng.random(1 << jaccard_join.SLOTS) < 0.3, 0
    for size in [*range(2, 40), 60, 100, 300, 1000]:
        for _ in range(6):
            a = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
            gone = int(size * (1 - threshold) / (1 + threshold)) if rng.random() < 0.5 else int(size * (1 - threshold))
            new = int(rng.integers(0, gone + 1)) if gone < size * (1 - threshold) / (1 + threshold) + 1 else 0
            b = np.append(a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64))
            sets = [np.sort(a), np.sort(b)]
            same = len(np.intersect1d(*sets))
            if not len(b) or same / (size + len(b) - same) < threshold:
                continue
            checked += 1
            sig, doc, _ = jaccard_join.signatures(np.concatenate(sets), np.array([0, size, size + len(b)]), spaces, heavy)
            assert np.intersect1d(sig[doc == 0], sig[doc == 1]).size, size
    assert checked > 100


def test_no_pair_is_lost_at_the_default(spark):
    """Near copies of similarity 0.75 to 0.8, of many sizes, against all pairs; the later one of each goes."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for k, size in enumerate([16, 17, 31, 46, 77, 150, 400, 1600]):
        a = [f"v{k}x{i}" for i in range(size)]
        b = list(a)
        for i in rng.choice(np.arange(2, size - 2, 2), round(size / 15.5), replace=False):  # each word changed takes two bigrams
            b[i] = f"u{k}x{i}"
        x, y = ({*zip(t, t[1:])} for t in (a, b))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k, 2 * k + 1] = round(len(x & y) / len(x | y), 6)
    assert all(0.75 <= j < 0.8 for j in want.values()), want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in jaccard_join.similar(docs).collect()} == want
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(docs).collect()) == [2 * k for k in range(8)]


def test_lines_quality_leaks_search_packing(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, PASSAGE, None), (2, None, None), (None, "x", None)], "item_id long, text string, answer string")
    assert line_templates.dedup_lines(odd).count() == 9 and line_templates.drop_lines(none).count() == 0
    assert {r["doc_id"] for r in quality_pu.keep_good(odd, labels).collect()} == {1, 2, None, 5, 6}
    assert {r["doc_id"] for r in lsa_decontaminate.leaks(odd, items).collect()} == {1, 2}
    assert lsa_decontaminate.drop_leaks(odd, items).count() == 5 and lsa_decontaminate.leaks(none, items).count() == 0
    assert {r["doc_id"] for r in topk_search.top_k(items, odd.drop("item_id")).collect()} == {1, 2}
    packed = packing.pack_documents(odd).collect()
    assert sum(r["length"] for r in packed) == 60 + 62 + 62 + 1 + 30_000 and packing.pack_documents(none).count() == 0


def test_short_lines_that_recur_go(spark):
    """Lines of 1 to 4 words: dropped from the tenth document on, but for the first; below that they stay."""
    short = ["Les.", "And more", "All rights reserved.", "Read the terms here"]
    rows = [(i, "\n".join([*short, f"own{c} text{c} of{c} it{c}", *(["Nine times"] if i < 9 else []), ""])) for i, c in enumerate("abcdefghijkl")]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for x in short:
        assert [i for i in range(12) if x in got[i]] == [0], x
    assert sum("Nine times" in t for t in got.values()) == 9 and all(t[-1] == "" for t in got.values())


def test_long_items_are_found(spark):
    """Items of 100 to 3000 words, copied verbatim at odd places; the text of another item is no leak."""
    sizes = {1: 100, 2: 200, 3: 500, 4: 3000}
    item = {i: " ".join(f"i{i}q{k}" for k in range(n)) for i, n in sizes.items()}
    items = spark.createDataFrame([(i, t, None) for i, t in item.items()], "item_id long, text string, answer string")
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(50 + 7 * i)) + f" {t} " + " ".join(f"e{i}x{k}" for k in range(90))) for i, t in item.items()]
    rows += [(9, " ".join(item[3].split()[:200])), *((100 + i, " ".join(f"f{i}x{k}" for k in range(200))) for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["cover"]) for r in lsa_decontaminate.leaks(docs, items).collect()} == {(i, i, 1.0) for i in sizes}
    assert {r["doc_id"] for r in lsa_decontaminate.drop_leaks(docs, items).collect()} == {9, *range(100, 140)}


@pytest.mark.parametrize(("docs", "every"), [(6, 2), (40, 1), (300, 4)])
def test_an_item_that_leaks_much_is_found(spark, docs, every):
    """One item in every, second or fourth document, another in one: each verbatim leak is found, in small tables as in larger ones."""
    hot, rare = (" ".join(f"{x}{k}" for k in range(20)) for x in ("hot", "rare"))
    items = spark.createDataFrame([(1, hot, None), (2, rare, None)], "item_id long, text string, answer string")
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(40)) + f" {hot if i % every == 0 else ''} {rare if i == 3 else ''} " + " ".join(f"e{i}x{k}" for k in range(40))) for i in range(docs)]
    got = {(r["doc_id"], r["item_id"], r["cover"]) for r in lsa_decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(i, 1, 1.0) for i in range(0, docs, every)} | {(3, 2, 1.0)}


def test_bins_hold_and_are_few():
    lengths = np.random.default_rng(2).integers(1, 1000, 2000)
    at = packing.pack(lengths, 1000)
    fill = np.bincount(at, lengths)
    assert fill.max() <= 1000 and len(fill) <= 1.05 * lengths.sum() / 1000 + 1
