"""Plain versions of the operators that SQL can't express."""

import re
from collections import defaultdict
from functools import lru_cache

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(rows, percent=75):
    """doc_id -> (shingles, component, kept), for distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in posted[s]:
                common[j] += 1
            posted[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def without_repeats(rows, k=20):
    """doc_id -> (words, removed, kept words)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def by_text(rows, order):
    """Rows of (id or None, text) as (position, text) of distinct documents, and the position of each row; ``order`` ranks the texts of one id."""
    documents = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, d[0] or 0, order(d[1])))
    place = {d: k for k, d in enumerate(documents)}
    return [(k, t) for k, (_, t) in enumerate(documents)], [place[i, t or ""] for i, t in rows], [i for i, _ in documents]


# classifiers, without array tricks: texts one by one, features word by word

MASK = (1 << 64) - 1
BASE = 0x9FB21C651E98DF25


@lru_cache(None)
def mix(x, seed=0):
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


@lru_cache(None)
def polynomial(raw):
    return sum((b + 1) * pow(BASE, j, 1 << 64) for j, b in enumerate(raw)) & MASK


@lru_cache(None)
def word_hash(raw):
    return mix((polynomial(raw) + len(raw)) & MASK)


def quality_features(text, bits, grams, spread, again):
    """bucket -> how often."""
    out, before = defaultdict(int), None
    for word in WORD.findall(text or ""):
        raw = word.encode()
        out[(word_hash(raw) * spread[0] & MASK) >> (64 - bits)] += 1
        out[again] += raw == before
        before = raw
        for k, times in zip(grams, spread[1:]):
            for i in range(len(word) - k + 1):
                out[(polynomial(word[i : i + k].encode()) * times & MASK) >> (64 - bits)] += 1
    return {b: n for b, n in out.items() if n}


def toxic_features(text, bits, beginnings):
    raw = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())
    out = set()
    for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", raw):
        if w:
            out.add(word_hash(w) >> (64 - bits))
            out |= {mix(polynomial(w[:k]), k) >> (64 - bits) for k in beginnings if len(w) > k}
    return out


# audit, search and secrets


def audit(rows, labels):
    """(part, order, step) -> counts, by filtering the documents in every order; ``rows`` are (id, text, source), ids not null."""
    from itertools import permutations

    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first[t] < i}
        fails.append((s or "", {k for k, v in bad.items() if v}, any(x[0] == i and x[1] == 1 for x in labels), any(x[0] == i and x[2] == 1 for x in labels)))
    out = {}
    for part in {f[0] for f in fails}:
        shapley, mine = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = [f for f in fails if f[0] == part and x in f[1]]
                alone = sum(f[1] == {x} for f in failing)
                shapley[x] += len(gone)
                mine.append((x, "".join(order), step, len(left), len(gone), len(failing) - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)))
        for x, order, step, *counts in mine:
            out[part, order, step] = (*counts, shapley[x])
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(rows, items, k=10):
    """item -> [(rank, id, score)] by scoring all documents; ``rows`` and ``items`` are (id, text)."""
    import math

    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    docs = [(i, t) for i, t in docs if t]
    n, length, df = len(docs), sum(len(t) for _, t in docs), defaultdict(int)
    for _, t in docs:
        for x in set(t):
            df[x] += 1
    terms, out = defaultdict(set), {}
    for i, t in items:
        terms[i] |= set(TERM.findall((t or "").translate(LOWER)))
    for item, wanted in terms.items():
        found = []
        for i, t in docs:
            m = 100 - 90 + 90 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in wanted if x in t)
            if score > 0:
                found.append((-score, i is None, i or 0))
        if found:
            out[item] = [(r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans (kind, start, end) of a text, by the plain patterns."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda f: (f[1], ("assign", "access", "hex").index(f[0])))
