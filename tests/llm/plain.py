"""Plain Python versions of the operators, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return SPACED.findall(t or "")


def quality(t):
    t, w = t or "", words(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    top = max(Counter(w).values(), default=0)
    kept = not (
        failed or len(w) > 100_000 or 10 * symbols > len(w) or not 3 * len(w) <= chars <= 10 * len(w)
        or 100 * dup > 30 * len(lines) or 100 * top > 30 * len(w)
    )
    return len(w), chars, symbols, dup, len(covered), failed, kept


def fingerprint(t, n=4):
    w = words(lower(t))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    """The least member reachable from each of n items."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min(label[j] for j in range(n) if j == i or linked(i, j))
            if least < label[i]:
                label[i], changed = least, True
    return label


def substring(texts, n=35):
    """(words, removed, digest, kept mask) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in all_words for i in range(len(w) - n + 1))
    out = []
    for w in all_words:
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(text, items, n=10):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        iw = ALNUM.findall(lower(t))
        if not iw:
            continue
        size = min(n, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(docs):
    tokens = [[*words(lower(t)), None] for _, t in docs]
    c = Counter(x for (d, _), ts in zip(docs, tokens) if not held_out(d) for x in ts)
    n, v = sum(c.values()), len(c)
    return [(held_out(d), len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for (d, _), ts in zip(docs, tokens)]


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)
