"""Plain Python statements of the contracts, for comparison on small tables."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

_LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def low(s):
    return (s or "").translate(_LOW)


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


def quality(s):
    s = s or ""
    w = spaced(s)
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in s.split("\n") if spaced(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def contamination(docs, items):
    patterns = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(str(item))
    out = []
    for s in docs:
        w, hit, found = alnum(s), set(), set()
        for n in {len(p) for p in patterns}:
            for j in range(len(w) - n + 1):
                p = tuple(w[j : j + n])
                if p in patterns:
                    hit |= set(range(j, j + n))
                    found |= patterns[p]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(s, k):
    w = spaced(low(s))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(docs, k, percent=80):
    """id -> smallest id reachable; docs: id -> text."""
    sets = {i: shingles(s, k) for i, s in docs.items()}
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in docs}


def license_base(s, phrases):
    w, places = alnum(s), []
    for phrase, label in phrases.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def targets(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, k))
    weight = {k: i % 3 + 1 for i, k in enumerate(keys)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in keys if k not in capped]
        left = total - sum(capped.values())
        got = {k: left * weight[k] / sum(weight[f] for f in free) for k in free}
        over = [k for k in free if got[k] > 3 * sizes[k]]
        if not over:
            return got | capped
        capped |= {k: 3 * sizes[k] for k in over}


def unigram(train, texts):
    counts = Counter(w for s in train for w in [*spaced(low(s)), None])
    n, v = sum(counts.values()), len(counts)
    return [(len(t := [*spaced(low(s)), None]), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for s in texts]


def ppm(train, texts, depth):
    """Method C with symbol exclusion, from explicit context dictionaries."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    code = lambda s: [0xFE] * depth + list(low(s).encode()) + [0xFF]
    for s in train:
        e = code(s)
        for p in range(depth, len(e)):
            for k in range(depth + 1):
                counts[k][tuple(e[p - k : p])][e[p]] += 1

    def one(e, p):
        out, gone = 0.0, set()
        for k in range(depth, -1, -1):
            seen = counts[k].get(tuple(e[p - k : p]))
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            if left:
                total = sum(left.values()) + len(left)
                if e[p] in left:
                    return out + math.log10(left[e[p]] / total)
                out += math.log10(len(left) / total)
            gone |= set(seen)
        return out - math.log10(256 - len(gone))

    return [sum(one(e, p) for p in range(depth, len(e))) for e in map(code, texts)]


def article(page):
    """Text of the article element of a page of the test tables."""
    inner = page[page.find("<article>") + 9 :].split("</article>")[0]
    bare = re.sub(r"<[^>]*>?", lambda m: "" if m.group(0) in ("<b>", "</b>") else " ", inner)
    return re.sub(r"\s+", " ", html.unescape(bare)).strip()
