"""The cleaner in plain Python, one document after the other, written from the survey."""

import hashlib
import re
import unicodedata

WORDS = re.compile(r"\w+")
RULES = [
    *(rf"{a}.*?{b}" for a, b in [("cookie", "kabul"), ("çerez", "politika"), ("gizlilik", "sözleşme")]), "tüm hakları saklıdır", "all rights reserved", r"©\s*[0-9]{4}", "paylaş.*?(?:facebook|twitter|whatsapp)",
    r"yorum\s*yap", r"yorumlar\s*\([0-9]+\)", "reklam", "advertisement", r"loading[.]{3}", r"devamını\s*oku", r"daha\s*fazla\s*göster",
]
MAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
NUMBERS = re.compile(r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
CALL = re.compile(r"(?<!\d)(?:\+?90[\s().\-]*)?0?[2-5]\d\d[\s().\-]*\d\d\d[\s.\-]*\d\d[\s.\-]*\d\d(?!\d)")
LONG = re.compile(r"(?<!\d)[1-9]\d{10}(?!\d)")


def fold(t):
    return re.sub(r"\s+", " ", t.casefold()).strip()


def sha(t):
    return hashlib.sha256(fold(t).encode()).hexdigest()


def normal(t):
    t = re.sub("<[^>]+>", "", t)
    t = re.sub(r"&#\d+;", " ", re.sub("&[a-zA-Z]+;", " ", t))
    t = unicodedata.normalize("NFKC", t)
    for r in RULES:
        t = re.sub(r, "", t, flags=re.I)
    t = "\n".join(x.strip() for x in re.sub("\n{3,}", "\n\n", t).split("\n"))
    return re.sub("[ \t]{2,}", " ", t).strip()


def valid_id(v):
    d = list(map(int, v))
    return (sum(d[:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def valid_ip(v):
    return all(x == str(int(x)) and int(x) < 256 for x in v.split("."))


def redact(t):
    counts = {}
    for label, pattern, ok in (("EMAIL", MAIL, None), ("IP_ADDRESS", NUMBERS, valid_ip), ("PHONE", CALL, None), ("TCKN", LONG, valid_id)):

        def put(m, label=label, ok=ok):
            if ok and not ok(m.group()):
                return m.group()
            counts[label] = counts.get(label, 0) + 1
            return f"<{label}>"

        t = pattern.sub(put, t)
    return t, counts


def quality(t):
    w = t.split()
    if not w:
        return 0.0, None
    lines = [x for x in t.splitlines() if x.strip()]
    a, u, m = sum(c.isalpha() for c in t) / len(t), len({x.casefold() for x in w}) / len(w), sum(map(len, w)) / len(w)
    s = sum(len(x.split()) < 3 for x in lines) / max(len(lines), 1)
    score = 0.4 * min(max((a - 0.35) / 0.4, 0), 1) + 0.3 * min(u / 0.5, 1) + 0.2 * max(0, 1 - abs(m - 6) / 12) + 0.1 * (1 - s)
    return round(score, 4), tuple(round(x, 4) for x in (a, u, m, s))


def grams(t, n=13):
    w = WORDS.findall(fold(t))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def simhash(t):
    w = WORDS.findall(fold(t))
    features = (w if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)])[:4096]
    votes = [0] * 64
    for f in features:
        v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            votes[b] += 1 if v >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] >= 0)


class Dedup:
    def __init__(self, distance=3):
        self.shas, self.hashes, self.distance = set(), [], distance

    def add(self, t):
        """None for a text that stays, else exact or near."""
        if sha(t) in self.shas:
            return "exact"
        h = simhash(t)
        if any((h ^ x).bit_count() <= self.distance for x in self.hashes):
            return "near"
        self.shas.add(sha(t))
        self.hashes.append(h)
        return None


def clean(rows, benchmark):
    """{id: (reason, word count, quality)} of (id, text) rows, benchmark (id, text) rows."""
    bench, seen, out = [(i, grams(t)) for i, t in benchmark], Dedup(), {}
    for i, raw in sorted(rows):
        t, _ = redact(normal(raw or ""))
        n, (score, signals) = len(t.split()), quality(t)
        reason = None
        if n < 50:
            reason = "too_short"
        elif n > 100_000:
            reason = "too_long"
        elif not (score >= 0.5 and signals[0] >= 0.5 and signals[1] >= 0.1 and 2 <= signals[2] <= 25):
            reason = "bad_quality"
        elif any(len(grams(t) & g) >= 2 for _, g in bench):
            reason = "contaminated"
        elif kind := seen.add(t):
            reason = f"{kind}_duplicate"
        out[i] = (reason, n, score)
    return out
