"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets.

Universe-partition pigeonhole: two sets of a size band whose similarity is at least
`threshold` differ in at most H tokens, each in one of m segments of the token universe.
An equal segment is found by its hash, and one that differs in a token by the hashes of
what is left without each of its tokens, its one-deletion neighbourhood. A segment that
is indexed as it is weighs 1, one with its neighbourhood too weighs 2: if the weights of a
set's segments exceed H, some segment has fewer differences than its weight and is found.
A set is compared in the space of its own size band and, as the smaller one, in the next;
each space has its own H, m and d, the number of segments with neighbourhoods.

Allocation by cost: an equal segment of a token or none tells little, as many sets have
it, so only segments of two tokens or more are indexed, and weigh anything; a segment needs
three for its neighbourhood. `allocation` takes the m and d of least cost, in signatures and
chance meetings, for which a set can be expected to weigh enough. Tokens found in very many
documents (a fixed-size count table over all documents says which) share segment 0; the others
are spread by hash.
A set that weighs too little to be sure is indexed by further partitions of the
universe too (all tokens spread alike). A pair could only be missed where *both* are
short, and then both are in the next partition; sets that are short in all partitions
index segments of one token and none as well, m + d of them at least H + 1 in weight. So no pair is lost.

The list of documents that share a signature goes to the partition of its least id, together with their
texts, where similarities are computed from whole sets.

Documents with equal sets are one node, represented by the least id among them: a map
task signs one of each set in its batch, and who belongs to which set is an aggregate
and a join on the hash of the set, so a text that a third of the rows share costs a
signature a batch. A task sends what it found as packed neighbour lists, one row a node,
and as stars of the parts that hang together; pairs of a hot group are never rows.

Defined results: `classes` has one row for every document with an id: (doc_id, class_id,
links, copies). class_id is the least id that can be reached over links, links counts the
other sets that reach the threshold with the document's own, copies the other documents
with an equal set. `similar` lists the links as rows (doc_id_a, doc_id_b, jaccard), a < b,
between representatives, and joins every other document to its own with similarity 1;
`all_pairs` spells out the pairs between all documents instead. A text of fewer words than
n has one token, all its words; null, empty and wordless texts match nothing and are a
class of their own; rows without an id are left out; repeated rows count once; rows that share
an id are one document, linked to what any of them is like, with the most links and copies
of any; extra columns are ignored. Words are runs of letters, digits and non-ASCII
characters, in lower case. `keep_one` keeps one row of each class (of the least id, and of rows that
share it the one of the greatest text); there, rows without an id are compared too, equal texts as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import kernels as K
from granary.llm.common import batch_of, by_part, pack, partitions, read, split_sorted, squeeze, texts, unpack, unsqueeze
from granary.llm.topk_search import Postings, Shared
from granary.plans.lineage import table

SLOTS = 20
SEEDS = 3
HOT = 64  # documents of a part that hangs together from which on it is compared in blocks
BLOCK = 1024
ASK_BY_BROADCAST = 1_000_000  # rows (16 MB) up to which the ids asked for are broadcast; beyond, both sides are shuffled


def token_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and their offsets."""
    h, at = K.words(column, "punct", lower=True)
    g = K.grams(h, n)
    out, size = [], np.zeros(len(at), np.int64)
    for i in range(len(at) - 1):
        a, z = at[i], at[i + 1]
        if z - a >= n:
            x = np.sort(g[a : z - n + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif z > a:
            x = K.mix(np.array([np.bitwise_xor.reduce(K.mix(h[a:z] + np.arange(1, z - a + 1, dtype=np.uint64)))]))
        else:
            continue
        out.append(x)
        size[i + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


class Spaces:
    """Size bands and, for each, the segments to use and how to index them."""

    def __init__(self, threshold: float, most: int = 1 << 34):
        high = [1]
        while high[-1] < most:
            high.append(max(high[-1] + 1, int(high[-1] / threshold + 1e-9)))
        self.threshold, self.high = threshold, np.array(high)
        self.differ = (1 - threshold) / (1 + threshold)  # of the two sizes added up
        self.segments, self.varied = (np.array(x) for x in zip(*(allocation(h, self.differ, threshold) for h in high), strict=True))

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, size)

    def needed(self, size: np.ndarray, space: np.ndarray, up: int) -> np.ndarray:
        """Weight that a set must have to be sure to meet all its partners in the space."""
        other = np.minimum(self.high[space], np.floor(size / self.threshold + 1e-9)) if up else size
        return np.floor(self.differ * (size + other) + 1e-9).astype(np.int64) + 1


def allocation(high: int, differ: float, threshold: float, share: float = 0.02, others: float = 1e5) -> tuple[int, int]:
    """(segments, how many of them with neighbourhoods) at least cost.

    The cost of a signature is itself and the sets it meets by chance: of `others`, those
    that have all its tokens, each with the chance `share`. A meeting costs the look at a
    text, many times a signature, and there are more sets the larger the data, so `others`
    is high enough that more of them would not change the plan. Tokens of a segment are taken
    to be Poisson; the least, middle and greatest sets of the band and of the one below
    must weigh enough, with a margin of one and a half standard deviations.
    """
    need = int(2 * differ * high + 1e-9) + 1
    cases = [(x * high, int(2 * differ * x * high + 1e-9) + 1) for x in (threshold, (1 + threshold) / 2, 1.0)]
    for x in (threshold**2, threshold * (1 + threshold) / 2, threshold):  # those of the band below
        cases.append((x * high, int(differ * (x * high + min(high, x * high / threshold)) + 1e-9) + 1))
    best = (np.inf, np.inf, need, 0)
    for m in sorted({*np.linspace(max(1, need // 2), 3 * need + 4, 120).astype(int).tolist(), need}):
        d, lacks, shares = max(0, need - m), 0.0, []
        for size, least in cases:
            mean = size / m
            zero = np.exp(-mean)
            two, three = (1 - zero * (1 + mean), 1 - zero * (1 + mean + mean * mean / 2)) if m > 1 else (float(size >= 2), float(size >= 3))
            for _ in range(3):  # the margin depends on d, and d on the margin
                margin = 1.5 * np.sqrt(m * two * (1 - two) + d * three * (1 - three))
                lack = least + margin - m * two
                d = min(m, max(d, int(np.ceil(lack / max(three, 1e-9)))))
            lacks = max(lacks, lack - d * three)
            chance = zero * (mean * share) ** 2 / 2 if m > 1 else share**mean
            shares.append((two, mean - zero * (mean + mean * mean) if m > 1 else size, 1 + others * chance))
        cost = sum((m * two + d * rest) * meet for two, rest, meet in shares) * (1 if lacks <= 1e-9 else 4)
        if m + d >= need:
            best = min(best, (cost, lacks, m, d))
    return best[2], best[3]


def _salt(space: np.ndarray, seed: int, seg: np.ndarray) -> np.ndarray:
    return K.mix(K.mix((space.astype(np.uint64) << np.uint64(8)) + np.uint64(seed)) + seg.astype(np.uint64) * K._B)


def signatures(v: np.ndarray, at: np.ndarray, spaces: Spaces, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, 1 if it is the larger size band of the space) of all sets; their order says nothing."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    light = ~heavy[(v >> np.uint64(64 - SLOTS)).astype(np.int64)]
    band = spaces.band(size)
    for up in (0, 1):
        left = some
        for seed in range(SEEDS):
            if not len(left):
                break
            last = seed == SEEDS - 1
            x = np.concatenate([v[at[i] : at[i + 1]] for i in left]) if len(left) < len(some) else v
            of = np.repeat(np.arange(len(left)), size[left])
            space = band[left] + up
            m = spaces.segments[space].astype(np.uint64)
            if seed:
                y = K.mix(x ^ np.uint64(0x51ED270B + seed))
                seg = ((y >> np.uint64(32)) * m[of]) >> np.uint64(32)
                order = np.lexsort((seg, of))
            else:
                seg = np.where(light, np.uint64(1) + (((x >> np.uint64(32)) * (m - np.uint64(1))[of]) >> np.uint64(32)), np.uint64(0))
                seg = np.minimum(seg, (m - np.uint64(1))[of])
                order = np.argsort(of * 2 + light, kind="stable")  # a set's tokens are sorted, and so are their segments
            x, seg, of = x[order], seg[order], of[order]
            starts = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (of[1:] != of[:-1])))
            tokens = np.diff(np.append(starts, len(x)))
            owner, which = of[starts], seg[starts]
            each = K.mix(x * K._A + K._B)
            total, salt = np.add.reduceat(each, starts), _salt(space[owner], seed, which)
            varied = which.astype(np.int64) >= (spaces.segments[space] - spaces.varied[space])[owner]
            useful = np.bincount(owner, (tokens >= 2).astype(np.int64) + (varied & (tokens >= 3)), minlength=len(left))
            short = useful < spaces.needed(size[left], space, up)
            all_of = short & last  # the last resort
            keep = (tokens >= 2) | all_of[owner]
            found.append((K.mix(total[keep] + salt[keep]), left[owner[keep]].astype(np.int32), np.full(int(keep.sum()), 1 - up, np.int8)))
            vary = varied & ((tokens >= 3) | all_of[owner])
            if vary.any():  # each such segment without each of its tokens
                t = np.repeat(np.arange(len(starts)), tokens)
                mine = vary[t]
                t = t[mine]
                found.append((K.mix(total[t] - each[mine] + salt[t]), left[owner[t]].astype(np.int32), np.full(len(t), 1 - up, np.int8)))
            if all_of.any():
                row = np.flatnonzero(all_of)
                gaps = np.arange(int(m[row].max())) < m[row, None].astype(np.int64)
                back = np.full(len(left), -1)
                back[row] = np.arange(len(row))
                hit = back[owner] >= 0
                gaps[back[owner[hit]], which[hit].astype(np.int64)] = False
                s, k = np.nonzero(gaps)
                found.append((K.mix(_salt(space[row[s]], seed, k)), left[row[s]].astype(np.int32), np.full(len(s), 1 - up, np.int8)))
            left = left[short]
    if not found:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z
    sig, doc, larger = map(np.concatenate, zip(*found, strict=True))
    return sig, doc, larger


def _names(v: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Hash of each whole set."""
    return K.mix(np.add.reduceat(K.mix(v * K._B + K._A), at[some]) + np.diff(at)[some].astype(np.uint64))


PIECES = 16


def census(base: DataFrame, n: int) -> DataFrame:
    """A written table: (doc_id, whole) of every row (whole: the hash of its set, null without a word), and the tokens of each hash slot as packed counts by task."""
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("whole", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(1 << SLOTS, np.int32)
        for b in K.batches_by_bytes(batches, "text"):
            v, at = token_sets(b.column("text"), n)
            total += np.bincount((v >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS).astype(np.int32)
            some = np.flatnonzero(np.diff(at))
            whole = np.zeros(b.num_rows, np.int64)
            if len(some):
                whole[some] = _names(v, at, some).view(np.int64)
            yield batch_of(out, np.full(b.num_rows, -1), b.column("doc_id"), pa.array(whole, mask=np.diff(at) == 0), [None] * b.num_rows)
        yield batch_of(out, np.arange(PIECES), [None] * PIECES, [None] * PIECES, [zstandard.compress(squeeze(x), 1) for x in np.split(total, PIECES)])

    return table(base.mapInArrow(run, "part int, doc_id long, whole long, counts binary"), "jaccard-census")


def heavy_slots(found: DataFrame, least: int) -> np.ndarray:
    """Which of 2**SLOTS hash slots hold far more tokens than most, counted over all documents."""
    count = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = unsqueeze(zstandard.decompress(x), np.int32).astype(np.int64)
                total[p] = total[p] + x if p in total else x
        if total:
            yield batch_of(count, list(total), [zstandard.compress(x.tobytes(), 1) for x in total.values()])

    out = np.zeros((PIECES, (1 << SLOTS) // PIECES), np.int64)
    for r in by_part(found.where("part >= 0").select("part", "counts"), PIECES).mapInArrow(add, "part int, counts binary").collect():  # 8 MB at most, whatever the data
        out[r["part"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64)
    return out.reshape(-1) >= max(least, 8 * out.mean())


def _subset(v: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets numbered in `keep`, and their offsets."""
    size = np.diff(at)[keep]
    to = np.append(0, np.cumsum(size))
    return v[np.repeat(at[keep] - to[:-1], size) + np.arange(int(to[-1]))], to


def _groups(key: np.ndarray, doc: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct documents of each run of equal keys, of two or more; only runs with something useful."""
    order = np.lexsort((doc, key))
    key, doc, useful = key[order], doc[order], useful[order]
    r = K.runs(key)
    worth = np.maximum.reduceat(useful, r[:-1]) > 0 if len(key) else np.zeros(0, bool)
    fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    size = np.add.reduceat(fresh.astype(np.int64), r[:-1]) if len(key) else np.zeros(0, np.int64)
    keep = np.repeat(worth & (size > 1), np.diff(r)) & fresh
    key, doc = key[keep], doc[keep]
    return K.runs(key), doc


def _distinct_lists(starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists without those that come twice."""
    size = np.diff(starts)
    if not len(size):
        return size, doc
    place = np.arange(len(doc)) - np.repeat(starts[:-1], size)
    name = K.mix(np.add.reduceat(K.mix(doc.view(np.uint64) * K._A + place.astype(np.uint64)), starts[:-1]) + size.astype(np.uint64))
    _, first = np.unique(name, return_index=True)
    keep = np.zeros(len(size), bool)
    keep[first] = True
    return size[keep], doc[np.repeat(keep, size)]


def _compared(base: DataFrame, found: DataFrame, n: int, threshold: float, heavy_least: int, emit, kinds: str) -> DataFrame:
    """What `emit(pairs)` makes, in each task, of the verified pairs (a, b, similarity) of representatives."""
    spark = base.sparkSession
    parts = 2 * partitions(spark)  # a task sorts some thousand signatures for each of its documents
    spaces = Spaces(threshold)
    shared = spark.sparkContext.broadcast(heavy_slots(found, heavy_least))  # a megabyte, whatever the data
    sent = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("ids", pa.binary())])
    again = table(found.where("part < 0 and whole is not null").groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select(F.col("whole").alias("doc_id")), "jaccard-copied")
    copied = _membership(again, again.count())  # only sets that others may have too need a name

    # as many bits as keep chance meetings in proportion to the data: a collision costs a look, never a pair
    low = np.uint64((1 << (64 - min(62, 36 + int(parts).bit_length()))) - 1)

    def sign(batches):
        known: list[np.ndarray] = []
        for b in K.batches_by_bytes(batches, "text", 2 << 20):  # a signature takes several times the bytes it is sent as
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            v, at = token_sets(b.column("text"), n)
            some = np.flatnonzero(np.diff(at))
            if not len(some):
                continue
            whole = _names(v, at, some)
            order = np.lexsort((ids[some], whole))  # the least id of the batch signs for all with the same set
            one = np.sort(order[K.runs(whole[order])[:-1]])
            ids, whole = ids[some[one]], whole[one]
            bits = np.unpackbits(copied.value).view(bool) if not len(known) else known[0]
            known[:] = [bits]
            whole = np.where(bits[_slot(whole.view(np.int64), len(bits))], whole, np.uint64(0))
            sig, doc, larger = signatures(*_subset(v, at, some[one]), spaces, shared.value)
            sig &= ~low
            order = np.argsort(sig)
            sig, doc, larger = sig[order], doc[order], larger[order]
            rows = []
            for p, s in split_sorted(sig, parts):
                used, local = np.unique(doc[s], return_inverse=True)
                rows.append((p, pack(sig[s], (local * 2 + larger[s]).astype(np.uint32)), zstandard.compress(squeeze(np.diff(ids[used], prepend=np.int64(0))) + squeeze(whole[used]), 1)))
            yield batch_of(sent, *zip(*rows, strict=True))

    lists = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])

    def meet(batches):
        sig, doc, name, larger, total = [], [], [], [], 0
        for b in batches:
            for payload, ids in zip(b.column("payload").to_pylist(), b.column("ids").to_pylist(), strict=True):
                s, local = unpack(payload, np.uint32)
                raw = zstandard.decompress(ids)
                who, whole = np.cumsum(unsqueeze(raw[: len(raw) // 2], np.int64)), unsqueeze(raw[len(raw) // 2 :], np.uint64)
                sig.append(s)
                doc.append(who[local >> 1])
                name.append(whole[local >> 1])
                larger.append((local & 1).astype(np.int8))
        if not sig:
            return
        sig, doc, name, larger = map(np.concatenate, (sig, doc, name, larger))
        order = np.argsort(sig, kind="stable")
        r = K.runs(sig[order])
        order = order[np.repeat(np.diff(r) > 1, np.diff(r))]
        sig, doc, name, larger = sig[order], doc[order], name[order], larger[order]
        rows = []
        order = np.flatnonzero(name)
        order = order[np.lexsort((doc[order], name[order]))]  # the least id stands for all with the same set: they share all signatures
        r = K.runs(name[order])
        if len(order):
            doc[order] = np.repeat(doc[order][r[:-1]], np.diff(r))
        size, doc = _distinct_lists(*_groups(sig, doc, larger))
        if len(size):
            begin = np.cumsum(size) - size
            to = (K.mix(doc[begin].view(np.uint64)) % np.uint64(parts)).astype(np.int64)  # most lists of a group of copies start alike
            k = np.argsort(to, kind="stable")
            q = to[k]
            r = K.runs(q)
            for i, j in zip(r[:-1], r[1:], strict=True):
                l = k[i:j]
                items = np.repeat(begin[l] - (np.cumsum(size[l]) - size[l]), size[l]) + np.arange(int(size[l].sum()))
                rows.append((int(q[i]), _pack_lists(size[l], doc[items])))
        if rows:
            p, payload = zip(*rows, strict=True)
            yield batch_of(lists, p, [None] * len(p), payload)

    def merge(batches):
        size, doc = [], []
        for b in batches:
            for p, payload in zip(b.column("part").to_pylist(), b.column("payload").to_pylist(), strict=True):
                s, d = _unpack_lists(payload)
                size.append(s)
                doc.append(d)
        if size:
            size, doc = _distinct_lists(np.append(0, np.cumsum(np.concatenate(size))), np.concatenate(doc))
            begin = np.cumsum(size) - size
            order = np.argsort(doc[begin], kind="stable")
            r = K.runs(doc[begin][order])
            rows = []
            for i, j in zip(r[:-1], r[1:], strict=True):  # the lists with one least id
                l = order[i:j]
                items = np.repeat(begin[l] - (np.cumsum(size[l]) - size[l]), size[l]) + np.arange(int(size[l].sum()))
                rows.append((int(doc[begin[l[0]]]), _pack_lists(size[l], doc[items])))
            least = np.repeat(doc[begin], size)
            order = np.lexsort((least, doc))
            seen, first = np.unique(doc[order], return_index=True)
            yield batch_of(lists, np.zeros(len(rows), int), *zip(*rows, strict=True))
            yield batch_of(lists, np.ones(len(seen), int), seen, [x.tobytes() for x in least[order][first]])

    packed = "part int, doc_id long, payload binary"
    met = by_part(base.mapInArrow(sign, "part int, payload binary, ids binary"), parts).mapInArrow(meet, packed)
    merged = table(by_part(met, parts).mapInArrow(merge, packed), "jaccard-lists")

    # a list goes where the least id goes that its own least id has met: the lists of a group of copies mostly agree on it
    def label(batches):
        for b in batches:
            seen = np.frombuffer(b"".join(b.column("payload").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(seen)], names=["doc_id", "label"])

    labels = merged.where("part = 1").select("doc_id", "payload").mapInArrow(label, "doc_id long, label long").groupBy("doc_id").agg(F.min("label").alias("label"))
    keyed = merged.where("part = 0").select("doc_id", "payload").join(labels, "doc_id")
    spread = 2 * parts  # a task holds the sets of all that its lists name, several times the texts as sent
    work = table(keyed.select(F.pmod(F.xxhash64("label"), F.lit(spread)).cast("int").alias("part"), "payload"), "jaccard-work")
    want = pa.schema([("part", pa.int32()), ("doc_id", pa.int64())])

    def members(batches):
        for b in batches:
            for p, payload in zip(b.column("part").to_pylist(), b.column("payload").to_pylist(), strict=True):
                doc = np.unique(_unpack_lists(payload)[1])
                yield batch_of(want, np.full(len(doc), p), doc)

    needs = table(work.mapInArrow(members, "part int, doc_id long").distinct(), "jaccard-needs")
    asked = needs.count()
    wanted = _membership(needs, asked)
    text = pa.schema([("doc_id", pa.int64()), ("payload", pa.binary())])

    def pick(batches):
        bits = np.unpackbits(wanted.value).astype(bool)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(bits[_slot(ids, len(bits))]))
            if b.num_rows:
                yield batch_of(text, b.column("doc_id"), [zstandard.compress(x.encode(), 1) for x in b.column("text").to_pylist()])

    fetched = base.mapInArrow(pick, "doc_id long, payload binary").join(F.broadcast(needs) if asked <= ASK_BY_BROADCAST else needs, "doc_id").select("part", "doc_id", "payload")
    work = work.select("part", F.lit(None).cast("long").alias("doc_id"), "payload").unionByName(fetched)

    def verify(batches):
        ids, sets, size, doc = [], [], [], []
        for b in batches:
            own = pc.is_null(b.column("doc_id"))
            for blob in b.filter(own).column("payload").to_pylist():
                s, d = _unpack_lists(blob)
                size.append(s)
                doc.append(d)
            b = b.filter(pc.invert(own))
            if b.num_rows:
                read = pa.array([zstandard.decompress(x).decode() for x in b.column("payload").to_pylist()], pa.large_string())
                for part in K.batches_by_bytes([pa.RecordBatch.from_arrays([b.column("doc_id"), read], names=["doc_id", "text"])], "text"):
                    v, at = token_sets(part.column("text"), n)
                    ids += part.column("doc_id").to_pylist()
                    sets += [v[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        if size:
            yield from emit(verified(ids, sets, np.concatenate(size), np.concatenate(doc), threshold))

    return by_part(work, spread).mapInArrow(verify, kinds)


PAIR = pa.schema([("doc_id_a", pa.int64()), ("doc_id_b", pa.int64()), ("jaccard", pa.float64())])


def _as_pairs(pairs):
    for a, z, s in pairs:
        yield batch_of(PAIR, a, z, s)


def _members(found: DataFrame) -> DataFrame:
    """(doc_id, rep, n): the least id with the same set (itself without a word), and how many documents have it."""
    names = found.where("part < 0").select("doc_id", "whole").distinct()
    sets = names.where("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    return names.join(sets, "whole", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))


def similar(docs: DataFrame, n: int = 2, threshold: float = 0.75, heavy_least: int = 64, all_pairs: bool = False) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of the pairs that reach the threshold; see above for copies."""
    base = texts(docs)
    found = census(base, n)
    kinds = "doc_id_a long, doc_id_b long, jaccard double"
    pairs = _compared(base, found, n, threshold, heavy_least, _as_pairs, kinds).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))
    members = _members(found)
    if not all_pairs:
        return pairs.unionByName(members.where("rep <> doc_id").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard")))
    a, b = (members.select(F.col("doc_id").alias(f"x{c}"), F.col("rep").alias(f"doc_id_{c}")) for c in "ab")
    equal = a.join(b, F.col("doc_id_a") == F.col("doc_id_b")).where("xa < xb").select("xa", "xb", F.lit(1.0).alias("jaccard"))
    wide = pairs.join(a, "doc_id_a").join(b, "doc_id_b").where("xa <> xb").select(F.least("xa", "xb").alias("xa"), F.greatest("xa", "xb").alias("xb"), "jaccard").unionByName(equal)
    return wide.groupBy(F.col("xa").alias("doc_id_a"), F.col("xb").alias("doc_id_b")).agg(F.max("jaccard").alias("jaccard"))


FOUND = pa.schema([("doc_id", pa.int64()), ("other", pa.int64()), ("near", pa.binary())])


def _least(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of each of the nodes 0..n-1 the least that can be reached over edges (x, y)."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[x], top[y])
        after = top.copy()
        for end in (x, y, top[x], top[y]):  # the old tops too, so that whole parts move
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == top).all():
            return top
        top = after


def _as_lists(pairs, most: int = 1 << 21):
    """Packed neighbours of each node, and the star of the least id of each part that hangs together; both of some million pairs at a time."""
    held, size = [], 0
    for a, z, _ in pairs:
        held.append((a, z))
        size += len(a)
        if size >= most:
            yield from _lists_of(held)
            held, size = [], 0
    if held:
        yield from _lists_of(held)


def _lists_of(held: list):
    a, z = map(np.concatenate, zip(*held, strict=True))
    own, near = np.append(a, z), np.append(z, a)
    ids, at = np.unique(own, return_inverse=True)
    top = _least(at[: len(a)], at[len(a) :], len(ids))
    leaf = np.flatnonzero(top != np.arange(len(ids)))
    yield batch_of(FOUND, ids[top[leaf]], ids[leaf], [None] * len(leaf))
    order = np.lexsort((near, own))
    own, near = own[order], near[order]
    r = K.runs(own)
    for lo in range(0, len(r) - 1, 4096):
        cut = r[lo : lo + 4097]
        yield batch_of(FOUND, own[cut[:-1]], [None] * (len(cut) - 1), [zstandard.compress(squeeze(np.diff(near[i:j], prepend=np.int64(0))), 1) for i, j in zip(cut[:-1], cut[1:], strict=True)])


def _count_near(batches):
    """(doc_id, links) of rows sorted by doc_id: its distinct neighbours over all lists."""
    out = pa.schema([("doc_id", pa.int64()), ("links", pa.int64())])
    now, held, done = None, [], []
    for b in batches:
        for d, near in zip(b.column("doc_id").to_pylist(), b.column("near").to_pylist(), strict=True):
            if d != now:
                if held:
                    done.append((now, len(np.unique(np.concatenate(held)))))
                now, held = d, []
            held.append(np.cumsum(unsqueeze(zstandard.decompress(near), np.int64)))
        if done:
            yield batch_of(out, *zip(*done, strict=True))
            done = []
    if held:
        yield batch_of(out, [now], [len(np.unique(np.concatenate(held)))])


def _classes(base: DataFrame, n: int, threshold: float, heavy_least: int) -> DataFrame:
    found = census(base, n)
    links = table(_compared(base, found, n, threshold, heavy_least, _as_lists, "doc_id long, other long, near binary"), "jaccard-links")
    degree = links.where("near is not null").select("doc_id", "near").repartition(partitions(base.sparkSession), "doc_id").sortWithinPartitions("doc_id").mapInArrow(_count_near, "doc_id long, links long")
    members = table(_members(found), "jaccard-members")
    star = links.where("other is not null").select(F.col("doc_id").alias("doc_id_a"), F.col("other").alias("doc_id_b"))
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("doc_id_a"), F.max("rep").alias("last"), F.collect_set("rep").alias("reps")).where("doc_id_a < last")
    bridge = twice.select("doc_id_a", F.explode("reps").alias("doc_id_b")).where("doc_id_a <> doc_id_b")  # rows that share an id hold their sets together
    label = groups(star.unionByName(bridge)).select(F.col("doc_id").alias("rep"), "group")
    nodes = label.join(degree.withColumnRenamed("doc_id", "rep"), "rep", "full")
    wide = members.join(nodes, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("group", "rep")).alias("class_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"), (F.max("n") - 1).alias("copies"))
    return wide.select("doc_id", "class_id", F.col("links").cast("long").alias("links"), "copies")


def classes(docs: DataFrame, n: int = 2, threshold: float = 0.75, heavy_least: int = 64) -> DataFrame:
    """(doc_id, class_id, links, copies) of every document with an id."""
    return _classes(texts(docs), n, threshold, heavy_least)


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(ids.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _membership(needs: DataFrame, count: int, most: int = 27):
    """A bit set, of 16 MB at most, that holds all ids in `needs`; others that it lets pass cost a look, never a result."""
    bits = 1 << min(most, max(16, int(count * 16).bit_length()))

    def run(batches):
        mine = np.zeros(bits, bool)
        for b in batches:
            mine[_slot(b.column("doc_id").to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(mine).tobytes(), 1)], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in needs.select("doc_id").mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(zstandard.decompress(bytes(r["bits"])), np.uint8)
    return needs.sparkSession.sparkContext.broadcast(total)


def _pack_lists(size: np.ndarray, doc: np.ndarray) -> bytes:
    return zstandard.compress(np.array([len(size)], np.int64).tobytes() + squeeze(size.astype(np.int64)) + squeeze(doc.astype(np.int64)), 1)


def _unpack_lists(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    return unsqueeze(raw[8 : 8 + 8 * n], np.int64), unsqueeze(raw[8 + 8 * n :], np.int64)


def _in_blocks(who: np.ndarray, token: np.ndarray, at: np.ndarray, threshold: float):
    """(a, b, similarity) of all pairs of the documents `who`, in order, with the tokens token[at[i]:at[i + 1]], that reach the threshold: common tokens are counted by a product of blocks."""
    length = np.diff(at)
    blocks = []
    for lo in range(0, len(who), BLOCK):
        n = min(BLOCK, len(who) - lo)
        t, row = token[at[lo] : at[lo + n]], np.repeat(np.arange(n), length[lo : lo + n])
        order = np.argsort(t, kind="stable")
        blocks.append((lo, Postings(t[order], row[order], np.ones(len(t)), n)))
    for i, (x, left) in enumerate(blocks):
        for y, right in blocks[i:]:
            both = Shared(left, right).rough()  # whole numbers below 2**24: exact
            total = length[x : x + left.n, None] + length[None, y : y + right.n]
            p, q = np.nonzero(both >= threshold / (1 + threshold) * total - 1e-3)
            if x == y:
                p, q = p[p < q], q[p < q]
            s = both[p, q].astype(float)
            s /= total[p, q] - s
            good = s >= threshold - 1e-12
            if good.any():
                yield who[x + p[good]], who[y + q[good]], np.round(s[good], 6)


def verified(ids: list[int], sets: list[np.ndarray], size: np.ndarray, doc: np.ndarray, threshold: float):
    """(a, b, similarity) arrays of the candidates that reach the threshold.

    Large parts that hang together are compared as a whole, by products of blocks, if their
    lists name a fair share of the pairs; what the lists don't name cannot reach the threshold
    unless ids are repeated, and parts with such ids are left to the lists.
    """
    ids = np.array(ids, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    length = np.array([len(s) for s in sets], np.int64)
    if not length.sum():
        return
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(length))
    named, node = np.unique(doc, return_inverse=True)
    first = np.cumsum(size) - size
    top = _least(np.repeat(node[first], size), node, len(named))
    r = np.searchsorted(ids, named)
    once = (r < len(ids)) & (np.searchsorted(ids, named, "right") - r == 1)
    docs = np.bincount(top, minlength=len(named))
    pairs = np.bincount(top[node[first]], size.astype(float) ** 2, len(named))
    hot = (docs >= HOT) & (pairs >= docs.astype(float) ** 2 / 4) & (np.bincount(top, ~once, len(named)) == 0)
    for t in np.flatnonzero(hot).tolist():
        k = r[top == t]
        of = np.concatenate([flat[at[i] : at[i + 1]] for i in k])
        yield from _in_blocks(ids[k], of, np.append(0, np.cumsum(length[k])), threshold)
    rest = ~hot[top[node[first]]]
    size, doc = size[rest], doc[np.repeat(rest, size)]
    mark = np.zeros(len(universe), bool)
    begin = np.append(0, np.cumsum(size))
    of = np.repeat(np.arange(len(size)), size)
    by_doc = np.argsort(doc, kind="stable")
    lists_of, sorted_doc = of[by_doc], doc[by_doc]
    for a in np.unique(doc).tolist():
        mine = lists_of[np.searchsorted(sorted_doc, a) : np.searchsorted(sorted_doc, a, "right")]
        others = np.unique(np.concatenate([doc[begin[l] : begin[l + 1]] for l in mine]))
        others = others[others > a]
        if not len(others):
            continue
        best: dict[int, float] = {}
        lo, hi = np.searchsorted(ids, a), np.searchsorted(ids, a, "right")
        i0, i1 = np.searchsorted(ids, others), np.searchsorted(ids, others, "right")
        rows = np.concatenate([np.arange(i, j) for i, j in zip(i0, i1, strict=True)]) if (i1 - i0 != 1).any() else i0
        for k in range(lo, hi):
            near = rows[(length[rows] >= threshold * length[k] - 1e-9) & (length[k] >= threshold * length[rows] - 1e-9) & (length[rows] > 0)]
            if not len(near):
                continue
            mark[flat[at[k] : at[k + 1]]] = True
            items = np.repeat(at[near] - (np.cumsum(length[near]) - length[near]), length[near]) + np.arange(int(length[near].sum()))
            both = np.add.reduceat(mark[flat[items]].astype(np.int64), np.cumsum(length[near]) - length[near])
            mark[flat[at[k] : at[k + 1]]] = False
            s = both / (length[k] + length[near] - both)
            for i in np.flatnonzero(s >= threshold - 1e-12):
                z = int(ids[near[i]])
                best[z] = max(best.get(z, 0.0), float(s[i]))
        if best:
            yield np.full(len(best), a), np.array(list(best), np.int64), np.round(list(best.values()), 6)


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): the least id that can be reached over pairs, for every id in one.

    Labels spread to neighbours and are then followed to the label of the label, until
    nothing changes; each round is a written table, so a lost executor costs no round.
    """
    both = pairs.select(F.col("doc_id_a").alias("x"), F.col("doc_id_b").alias("y"))
    edges = table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "group-edges")
    now = table(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("g")), "group-labels")
    while True:
        far = now.select(F.col("x").alias("y"), F.col("g").alias("h"))
        near = edges.join(far, "y").groupBy("x").agg(F.min("h").alias("h"))
        step = now.join(near, "x").select("x", F.least("g", "h").alias("g0"), F.col("g").alias("was"))
        jump = now.select(F.col("x").alias("g0"), F.col("g").alias("of"))
        after = table(step.join(jump, "g0").select("x", F.least("g0", "of").alias("g"), "was"), "group-labels")
        now = after.select("x", "g")
        if after.where("g <> was").isEmpty():
            return now.select(F.col("x").alias("doc_id"), F.col("g").alias("group"))


def keep_one(docs: DataFrame, n: int = 2, threshold: float = 0.75, heavy_least: int = 64) -> DataFrame:
    """docs without all rows of a class but one."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    key = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1)))  # after any id in use
    base = docs.select(key.alias("doc_id"), text.alias("text"))
    gone = _classes(base, n, threshold, heavy_least).where("class_id <> doc_id").select(F.col("doc_id").alias("__granary_id"))
    kept = docs.join(gone, key == F.col("__granary_id"), "left_anti")
    again = table(base.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("__granary_id")), "jaccard-again")
    if again.isEmpty():
        return kept
    wide = kept.withColumn("__granary_key", key)
    once = wide.join(again, F.col("__granary_key") == F.col("__granary_id"), "left_anti").drop("__granary_key")
    first = Window.partitionBy("__granary_key").orderBy(F.desc("text"))
    of = wide.join(again, F.col("__granary_key") == F.col("__granary_id"), "left_semi").withColumn("__granary_row", F.row_number().over(first)).where("__granary_row = 1")
    return once.unionByName(of.drop("__granary_key", "__granary_row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM l WHERE len(ws) > 0),
g AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, n FROM w),
t AS (SELECT DISTINCT doc_id, w || ' ' || coalesce(nxt, '') AS t FROM g WHERE nxt IS NOT NULL OR n = 1),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS h FROM t GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS copies FROM k),
o AS (SELECT t.* FROM t JOIN r USING (doc_id) WHERE r.rep = r.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM o AS a JOIN o AS b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN r AS x ON x.doc_id = a JOIN r AS y ON y.doc_id = b WHERE same / (x.n + y.n - same)::DOUBLE >= 0.75 - 1e-12),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(c.class_id, doc_id) AS class_id, coalesce(d.links, 0)::BIGINT AS links, (coalesce(r.copies, 1) - 1)::BIGINT AS copies
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN c ON c.a = r.rep LEFT JOIN d ON d.a = r.rep
"""
