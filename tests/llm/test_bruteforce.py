"""Operators that SQL can't express, held against plain Python that looks at everything, or against held-out truth."""

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from granary.llm import html_extract, jaccard_join, kernels, license_scan, line_templates, lsa_decontaminate, packing, quality_pu, topk_search

DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x09-\x0d\x1c-\x20]+")


def rows_of(name, *columns, d=DIR):
    t = pq.read_table(f"{d}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))


# kernels


def test_long_words_hash_by_all_their_bytes():
    a, b = "a" * 4096, "b" * 4096
    assert len({kernels.hash_of(x) for x in (a + b, b + a, a + a, b + b, a, b, "x" + a + b, a + b + "x")}) == 8


# 3


def brute_lines(rows, depth=4, similarity=0.6, min_docs=10):
    leaves, known, templates = {}, {}, []
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate((text or "").split("\n")):
            words = tuple("0" if re.search("[0-9]", w) else w for w in SPACE.split(line) if w)
            if not words:
                continue
            leaf = (len(words), words[:depth])
            t = known.get(words)
            if t is None:
                best, at = -1, None
                for i in leaves.setdefault(leaf, []):
                    same = sum(x == y for x, y in zip(templates[i][0], words, strict=True))
                    if same > best:
                        best, at = same, i
                if at is not None and best >= similarity * len(words) - 1e-9:
                    t = at
                    templates[t][0][:] = [x if x == y else None for x, y in zip(templates[t][0], words, strict=True)]
                else:
                    t = len(templates)
                    templates.append((list(words), []))
                    leaves[leaf].append(t)
                known[words] = t
            templates[t][1].append((doc, k))
    gone = set()
    for _, places in templates:
        if len({d for d, _ in places}) >= min_docs:
            gone |= {p for p in places if p != places[0]}
    return {(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone), sum(p[0] == d for p in gone)) for d, t in rows}


def test_line_templates_against_all_lines(spark):
    rows = rows_of("documents", "doc_id", "text")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert sum(n for _, _, n in want) > 20
    for most in (line_templates.BROADCAST_ROWS, 0):
        got = {(r["doc_id"], r["text"], r["lines_dropped"]) for r in line_templates.dedup_lines(docs, broadcast_rows=most).collect()}
        assert got == want


def test_line_templates_odd_rows(spark):
    """Repeated ids keep the first line, rows without an id theirs; nulls and texts of blanks stay; clashing columns pass."""
    line = "the same words on every page"
    rows = [(1, line), (1, line), *((i, f"{line}\nown{chr(95 + i)} text{chr(95 + i)}") for i in range(2, 12)), (None, line), (20, None), (21, ""), (22, " \n\t")]
    docs = spark.createDataFrame([(i, t, 9, "x", "y") for i, t in rows], "doc_id long, text string, n_chars int, leaf string, key string")
    for most in (line_templates.BROADCAST_ROWS, 0):
        got = sorted(((r["doc_id"], r["text"], r["leaf"]) for r in line_templates.drop_lines(docs, broadcast_rows=most).collect()), key=repr)
        assert got == sorted([(1, line, "x")] * 2 + [(i, f"own{chr(95 + i)} text{chr(95 + i)}", "x") for i in range(2, 12)] + [(None, line, "x"), (20, None, "x"), (21, "", "x"), (22, " \n\t", "x")], key=repr)
    assert line_templates.drop_lines(docs.where("false")).count() == 0
    tie = spark.createDataFrame([(i, f"a b c d {'x' if i % 2 else 'y'} e") for i in range(10)], "doc_id long, text string")
    assert sum(r["lines_dropped"] for r in line_templates.dedup_lines(tie).collect()) == 9


# 4


def words(text):
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text.lower()).split()


def brute_licenses(rows, coverage=0.7):
    out = {}
    for doc, text in rows:
        w = words(text or "")
        for name, template, phrases in license_scan.TEMPLATES:
            t = words(template)
            for start in range(-len(t) + 1, len(w)):
                same = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(t)) / len(t)
                near = w[max(0, start - 2) : start + len(t) + 2]
                if same >= coverage - 1e-9 and all(any(near[i : i + len(p)] == p for i in range(len(near))) for p in (words(x) for x in phrases)):
                    out[doc, name] = min(out.get((doc, name), (0, 0)), (-same, start))
    return {(d, n, s, round(-c, 6)) for (d, n), (c, s) in out.items()}


def test_license_scan_against_all_starts(spark):
    rng = np.random.default_rng(3)
    rows = [r for r in rows_of("documents", "doc_id", "text") if re.search("[Ll]icen|ights", r[1])][:12]
    for k, (_, template, _) in enumerate(license_scan.TEMPLATES):
        w = template.split()
        if len(w) < 120:
            for i in rng.choice(len(w), len(w) // 8, replace=False):
                w[i] = "changed"
            rows.append((1000 + k, f"Some text before it, {' '.join(w)} and behind."))
    rows += [(2000, ""), (2001, None), (2002, "license"), (2003, "Released under the MIT License. " * 3)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, license string")
    want = brute_licenses(rows)
    assert len({n for _, n, _, _ in want}) > 12
    assert {tuple(r) for r in license_scan.scan(docs).collect()} == want
    assert license_scan.scan(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "All rights reserved, copyright all rights reserved."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert Counter(r["license"] for r in license_scan.scan(twice).collect())["MIT"] == 1


# 5


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def test_every_verbatim_leak_is_found_and_nothing_else(spark):
    """Items of 5 to 64 words, word for word in texts full of other items' words: all are found, and texts of shuffled words are not."""
    rng = np.random.default_rng(12)
    pool = [f"w{i}" for i in range(700)]
    items = {m: " ".join(rng.choice(pool, m)) for m in range(5, 65, 3)}
    rows = []
    for k, (m, t) in enumerate(items.items()):
        for c in range(3):
            noise = rng.choice([*pool, *(f"n{i}" for i in range(700))], 150 + 31 * c)
            cut = int(rng.integers(0, len(noise)))
            rows.append((100 * m + c, " ".join([*noise[:cut], t, *noise[cut:]])))
        rows.append((50_000 + k, " ".join(rng.choice([*pool, *(f"n{i}" for i in range(700))], 250))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(m, t, None) for m, t in items.items()], "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in lsa_decontaminate.leaks(docs, bench).collect()}
    want = {(i, m) for i, t in rows for m, x in items.items() if f" {x} " in f" {t} "}
    assert len(want) >= 60 and want <= got
    for i, m in got - want:  # what else is found covers enough of the item
        a, b = items[m].split(), dict(rows)[i].split()
        assert lcs(a, b) >= 0.5 * len(a)
    assert not {i for i, _ in got if i >= 50_000}


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, "too short", None), (3, None, None), (4, "", None), (5, "a b c d e", None)], "item_id long, text string, answer string")
    rows = [(1, item), (1, f"z {item}"), (2, None), (3, ""), (None, item), (4, "w " * 200_000 + item), (5, "b a c d e a b c d"), (6, "x a b c d e"), (7, "too short")]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, item_id int, cover double")
    assert sorted((r["doc_id"], r["item_id"]) for r in lsa_decontaminate.leaks(docs, bench).collect()) == [(1, 1), (1, 1), (4, 1), (6, 5)]
    assert sorted(str(r["doc_id"]) for r in lsa_decontaminate.drop_leaks(docs, bench).collect()) == ["2", "3", "5", "7"]
    assert lsa_decontaminate.leaks(docs.where("false"), bench).count() == 0 and lsa_decontaminate.leaks(docs, bench.where("false")).count() == 0


# 6


def test_quality_on_held_out_labels(spark):
    """A model fitted without a fifth of the labels tells good from bad ones among them."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_pu.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert model is not None and 0.05 < model.prior < 0.98
    got = {r["doc_id"]: r["kept"] for r in quality_pu.quality_scores(docs, labels, model).collect()}
    held = labels.where("doc_id % 5 = 0").join(docs.select("doc_id", "lang"), "doc_id").collect()
    hit = [got[r["doc_id"]] == (r["quality"] == 1 and not r["toxic"]) for r in held if r["doc_id"] in got]
    assert len(hit) > 50 and np.mean(hit) >= 0.8


def test_the_sample_does_not_grow_with_repeated_rows(spark, monkeypatch):
    taken = []
    keep = quality_pu.table
    monkeypatch.setattr(quality_pu, "table", lambda df, name: taken.append(keep(df, name)) or taken[-1])
    rows = [(i, f"text number{i} of {'good plain words' if i % 2 else '#### !!!'} {i}") for i in range(60)] * 20
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 60, 2)] * 2, "doc_id long, quality int, toxic int")
    model = quality_pu.fit(docs, labels)
    assert model is not None and taken[0].count() == 30 + 60
    assert quality_pu.quality_scores(docs, labels, model).count() == 1200


def test_quality_of_odd_rows(spark):
    """Few rows still make a model from 8 of each kind on; below, texts with words are kept."""
    rows = [(i, f"plain words of text {i}") for i in range(9)] + [(90, None), (91, ""), (92, "!!!"), (None, "plain words"), (93, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, 3.5) for i, t in rows], "doc_id long, text string, quality double")
    few = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    enough = spark.createDataFrame([(i, 1, None) for i in range(9)], "doc_id long, quality int, toxic int")
    assert quality_pu.fit(docs, few) is None and quality_pu.fit(docs, enough) is not None
    kept = {r["doc_id"] for r in quality_pu.keep_good(docs, few).collect()}
    assert kept == {*range(9), None, 93}
    assert quality_pu.keep_good(docs.where("false"), few).count() == 0


# 7


def test_search_reads_the_documents_as_often_for_many_slices(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common w{i} v{i % 3}") for i in range(60)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    whole, cut = (topk_search.top_k(docs.where("doc_id % 20 = 0"), docs, 5, "doc_id", slice_terms=s) for s in (1000, 1))
    assert not any("/docs/" in f for f in cut.inputFiles())  # each slice reads postings
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_search_bounds_hold(monkeypatch):
    rng = np.random.default_rng(5)
    for strip in (0.0, 0.02, 2.0):
        monkeypatch.setattr(topk_search, "STRIP", strip)
        a, b = ((rng.random((n, 300)) < np.linspace(0.005, 0.7, 300)) * rng.random((n, 300)) * 9 for n in (40, 70))
        chunk, block = (topk_search.Postings(*np.nonzero(x.T), x.T[x.T > 0], len(x)) for x in (a, b))
        both = topk_search.Shared(chunk, block)
        assert (np.abs(both.rough() - a @ b.T) <= both.slack * (a @ b.T)).all()
        best = topk_search.Best(np.full(40, topk_search.FLOOR), 6)
        topk_search._meet(chunk, block, np.arange(70), best, np.zeros(300))
        want = np.round(a @ b.T, 6)
        for q in range(40):
            order = np.lexsort((np.arange(70), -want[q]))[:6]
            assert best.doc[best.row == q].tolist() == order[want[q][order] > 0].tolist()


def products(rng, n, terms=300):
    """Rows of weights, many of them alike, as `Postings` and as a matrix."""
    x = (rng.random((n, terms)) < np.linspace(0.05, 0.7, terms)) * rng.random((n, terms)) * 9
    x[n // 2 :: 3] = x[n // 2]
    return topk_search.Postings(*np.nonzero(x.T), x.T[x.T > 0], n), x


def test_search_postings_arrive_with_plain_types():
    there = pickle.loads(pickle.dumps(products(np.random.default_rng(1), 30)[0]))
    assert there.single.dtype is np.dtype(np.float32)  # else np.add.at takes its slow way


def test_search_scores_few_pairs_of_a_block_above_a_low_floor(monkeypatch):
    rng, scored, plain = np.random.default_rng(6), [], topk_search._scores
    (chunk, a), (block, b) = products(rng, 40), products(rng, 700)
    monkeypatch.setattr(topk_search, "_scores", lambda *x: scored.append(len(x[2])) or plain(*x))
    best = topk_search.Best(np.full(40, 1.0), 6)  # as other blocks left it
    topk_search._meet(chunk, block, np.arange(700), best, np.zeros(300))
    assert (a @ b.T > 1).all() and sum(scored) < 0.5 * 40 * 700  # a third of the block may tie


def test_search_pairs_that_wait(monkeypatch):
    """Blocks with ties across them, settled at the end, or as soon as any wait: the k best by exact scores, and the same bits from either side."""
    rng = np.random.default_rng(7)
    chunks, blocks = [products(rng, n) for n in (40, 9)], [products(rng, n) for n in (70, 5, 300, 80)]
    a, b = (np.concatenate([x for _, x in y]) for y in (chunks, blocks))
    want, ids = np.round(a @ b.T, 6), rng.permutation(455)
    for most in (8, 0):
        monkeypatch.setattr(topk_search, "WAITING", most)
        queries, held, names, dense, first, settled = topk_search.Rows(), topk_search.Rows(), [], np.zeros(300), 0, 0
        waiting = [(queries.add(c), topk_search.Waiting(topk_search.Best(np.full(c.n, topk_search.FLOOR), 6))) for c, _ in chunks]
        for block, _ in blocks:
            at, full = held.add(block), False
            names.append(ids[first : first + block.n])
            first += block.n
            for (c, _), (_, mine) in zip(chunks, waiting, strict=True):
                q, d, rough, slack = topk_search._likely(c, block, mine.best)
                full |= mine.add(q, d + at, rough * (1 - slack), rough / (1 - slack))
            if full:
                topk_search._settle(waiting, queries, held, names, dense)
                held, names, settled = topk_search.Rows(), [], settled + 1
        assert (settled > 1) == (most == 0)
        if names:
            topk_search._settle(waiting, queries, held, names, dense)
        for lo, mine in waiting:
            for q in range(len(mine.best.floor)):
                order = np.lexsort((ids, -want[lo + q]))[:6]
                assert mine.best.doc[mine.best.row == q].tolist() == ids[order].tolist()
    (chunk, _), (block, _), got = chunks[0], blocks[2], []
    for x, y in ((chunk, block), (block, chunk)):
        p, q = np.indices((40, 300)).reshape(2, -1)
        p, q = (p, q) if x is chunk else (q, p)
        got.append(topk_search._scores(x, y, p, q, dense))
    for spread in (0, 1 << 40):
        monkeypatch.setattr(topk_search, "SPREAD", spread)
        got.append(topk_search._scores(chunk, block, *np.indices((40, 300)).reshape(2, -1), dense))
    assert all((x == got[0]).all() for x in got) and not dense.any()


def test_search_ties_and_odd_rows(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, None), (5, ""), (6, "z"), (20, "a b c")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in topk_search.top_k(docs.where("doc_id = 20"), docs, 3, "doc_id").orderBy("rank").collect()]
    assert got == [(20, 1, 1), (20, 2, 2), (20, 3, 3)]
    assert topk_search.top_k(docs.where("false"), docs, 3, "doc_id").count() == 0
    both = [topk_search.top_k(docs.where("doc_id is not null"), docs, 4, "doc_id", slice_terms=s).count() for s in (1, 1000)]
    assert both[0] == both[1]


# 8


def test_hot_groups_are_compared_in_blocks():
    rng = np.random.default_rng(8)
    base, c = rng.integers(0, 2**63, 300, dtype=np.uint64), 1100
    sets = [np.unique(np.append(base[rng.random(300) > rng.random() * 0.3], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64))) for _ in range(c)]
    ids = rng.permutation(3 * c)[:c]
    for again in (0, 1):  # an id of two rows is left to the lists
        all_ids, all_sets = [*ids.tolist(), *ids[:again].tolist()], sets + [base] * again
        found = list(jaccard_join.verified(all_ids, all_sets, np.array([c]), np.sort(ids), 0.75))
        got = {(a, b): s for x, y, z in found for a, b, s in zip(x.tolist(), y.tolist(), z.tolist(), strict=True)}
        assert (len(found) <= 3) == (again == 0)
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        x = np.zeros((c, len(universe)), np.float32)
        x[np.repeat(np.arange(c), size), flat] = 1
        both = (x @ x.T).astype(float)
        near = both / (size[:, None] + size - both)
        p, q = np.nonzero((near >= 0.75) & (ids[:, None] < ids))
        want = {(int(ids[i]), int(ids[j])): round(float(near[i, j]), 6) for i, j in zip(p, q, strict=True)}
        odd = int(ids[0]) if again else None
        assert {k: v for k, v in got.items() if odd not in k} == {k: v for k, v in want.items() if odd not in k}
    whole, cut = (list(jaccard_join._as_lists(iter(found), most)) for most in (1 << 40, 1000))
    assert len(cut) > len(whole)
    for batches in (whole, cut):
        star = [(r["doc_id"], r["other"]) for b in batches for r in b.to_pylist() if r["other"] is not None]
        assert {b for _, b in star} | {min(a for a, _ in star)} == {x for k in got for x in k}


def test_least_of_chains():
    rng = np.random.default_rng(2)
    for n in (2, 50, 3000):
        order = rng.permutation(n)
        assert (jaccard_join._least(order[:-1], order[1:], n) == 0).all()
    assert jaccard_join._least(np.array([1, 3]), np.array([2, 4]), 6).tolist() == [0, 1, 1, 3, 3, 5]


# 9


def hidden(page: str) -> str:
    """The page with the names of all elements that label it made plain."""
    return re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form|section)\b", r"<\1div", page)


def f1(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_extraction_of_held_out_pages():
    pages = [h for _, h in rows_of("pages", "page_id", "html", d="/root/testdata/sf0.01")]
    model = html_extract.Model(pages[:150])
    ours, plain = [], []
    for h in pages[150:]:
        p = html_extract.Page(h)
        y = p.labels()
        truth = html_extract._text(p, [v == 1 for v in y])
        if truth:
            ours.append(f1(model.extract([hidden(h)])[0], truth))
            plain.append(f1(html_extract._text(p, [True] * len(p.tag)), truth))
    assert len(ours) > 30 and np.mean(ours) >= 0.9 and np.mean(ours) > np.mean(plain)


def test_decoding_never_contradicts():
    """A kept or dropped node has no descendant of the other kind below one that decided."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 40
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        state = html_extract.decode(parent, rng.normal(0, 2, n), rng.random(n))
        for i in range(1, n):
            if state[parent[i]] >= 0:
                assert state[i] == state[parent[i]]


def test_pages_of_odd_rows(spark):
    deep = "<div>" * 20_000 + "text" + "</b>" * 20_000
    rows = [(1, "<p>a</p>"), (1, "<p>b</p>"), (2, None), (3, ""), (None, "<p>x</p>"), (4, deep), (5, "no tags at all"), (6, "<<<>><p")]
    pages = spark.createDataFrame([(i, h, "m") for i, h in rows], "page_id long, html string, main_text string")
    got = [(r["page_id"], r["main_text"]) for r in html_extract.extract(pages).collect()]
    assert sorted(i for i, _ in got) == [1, 1, 2, 3, 4, 5, 6] and dict(got)[2] == dict(got)[3] == ""
    assert html_extract.extract(pages.where("false")).count() == 0


# 10


def best_fit_decreasing(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=left.__getitem__)] -= s
        else:
            left.append(capacity - s)
    return len(left)


def check_packing(rows, lengths, capacity):
    """Every word of every document has one place, no bin overflows, and pieces don't overlap."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["doc_start"], r["length"]))
    assert {i: n for i, n in lengths.items() if n > 0} == {i: sum(n for _, n in p) for i, p in pieces.items()}
    for i, p in pieces.items():
        assert [s for s, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]), i
    bins = {}
    for r in rows:
        bins.setdefault((r["bin_group"], r["bin_id"]), []).append((r["bin_start"], r["length"]))
    for b in bins.values():
        assert [s for s, _ in sorted(b)] == list(np.cumsum([0, *(n for _, n in sorted(b))])[:-1]) and sum(n for _, n in b) <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [200, 4096])
def test_packing_has_all_and_is_tight(spark, capacity):
    rows = rows_of("documents", "doc_id", "text")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lengths = {i: len([w for w in SPACE.split(t) if w]) for i, t in rows}
    n = check_packing(packing.pack_documents(docs, capacity).collect(), lengths, capacity)
    pieces = [min(capacity, x - k) for x in lengths.values() for k in range(0, x, capacity)]
    assert n <= 1.05 * best_fit_decreasing(pieces, capacity) + 1
    whole = check_packing(packing.pack_documents(docs, capacity, group_docs=50).collect(), lengths, capacity)
    assert whole <= 1.2 * n + 4  # groups of 50 documents cost some bins


def test_packing_of_odd_rows(spark):
    rows = [(1, "a b c", 3), (2, None, None), (3, "", -5), (None, "a", 1), (4, "x " * 9000, 0), (5, "a", 10)]
    docs = spark.createDataFrame([(i, t, n, 7) for i, t, n in rows], "doc_id long, text string, n long, bin_id int")
    assert check_packing(packing.pack_documents(docs, 100).collect(), {1: 3, 4: 9000, 5: 1}, 100) > 89
    assert check_packing(packing.pack_documents(docs, 100, length_col="n").collect(), {1: 3, 5: 10}, 100) == 1
    assert packing.pack_documents(docs.where("false")).count() == 0


# the pipeline


def test_pipeline_stage_by_stage(spark):
    """Each stage on its own input: quality by the model's scores, lines and near copies by plain Python, leaks by their cover, packing by its invariants."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    plain = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    now = stage["quality classifier"](spark, docs, DIR)
    kept = plain(now)
    assert set(kept) == {r["doc_id"] for r in quality_pu.quality_scores(docs, labels).where("kept").collect()}
    now = spark.createDataFrame(now.toPandas(), docs.schema)
    lined = plain(stage["line dedup"](spark, now, DIR))
    want = {d: t for d, t, n in brute_lines(list(kept.items())) if n == 0 or t.split()}
    assert lined == want
    now = spark.createDataFrame([(i, t) for i, t in lined.items()], "doc_id long, text string")
    once = plain(stage["n-gram Jaccard join"](spark, now, DIR))
    sets = {i: {*zip(w, w[1:])} if len(w := words(t)) > 1 else set(w) for i, t in lined.items()}
    least = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75]
    for _ in pairs:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert set(once) == set(least.values())
    now = spark.createDataFrame([(i, t) for i, t in once.items()], "doc_id long, text string")
    clean = plain(stage["benchmark decontamination"](spark, now, DIR))
    items = [words(t) for _, t in rows_of("benchmark", "item_id", "text")]
    for i, t in once.items():
        w = words(t)
        verbatim = any(w[k : k + len(x)] == x for x in items for k in range(len(w) - len(x) + 1) if w[k] == x[0])
        if verbatim:
            assert i not in clean
        elif i not in clean:
            assert max(lcs(x, w) / len(x) for x in items) >= 0.5
    packed = stage["best-fit packing"](spark, spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string"), DIR).collect()
    check_packing(packed, {i: len([w for w in SPACE.split(t) if w]) for i, t in clean.items()}, 4096)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, texts of blanks, a very long one, clashing names; and empty tables."""
    import corpus_pipeline

    good = " ".join(f"plain{i} words in a row" for i in range(40))
    rows = [(1, good), (1, good), (1, good + " more"), (2, None), (3, ""), (4, " \n\t"), (None, good + " too"), (None, None), (5, "x " * 60_000), (6, good.upper()), (7, "The same line.\n" * 3)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, part int, class_id string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "best-fit packing":
                assert now.columns == docs.columns
            now.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{table is docs}"))
            now = spark.read.parquet(str(tmp_path / f"{name}-{table is docs}"))
        if table is docs:
            lengths = {}
            for r in now.collect():
                lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
            assert lengths == {1: len(good.split()) + 1, 5: 60_000, 7: 9}
        else:
            assert now.count() == 0
