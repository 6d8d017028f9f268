"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    out = []
    assign = r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for no, (kind, rx, group, least) in enumerate(
        [("assign", assign, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    ):
        for m in re.finditer(rx, text or ""):
            if len(m.group(group)) >= least:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def substring(docs):
    """docs: list of (doc_id, text); words kept of each."""
    first = {}
    for i, t in docs:
        w = words(t)
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def shingles(text):
    w = words((text or "").translate(FOLD))
    k = min(5, len(w))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(x), find(i) if x else i) for i, x in sets]


def contamination(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = []
    for item, text in items:
        w = rx.findall((text or "").translate(FOLD))
        k = min(10, len(w))
        patterns += [(item, w[a : a + k]) for a in range(len(w) - k + 1) if k]
    out = []
    for i, text in docs:
        w = rx.findall((text or "").translate(FOLD))
        hit, names = set(), set()
        for item, p in patterns:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    names.add(str(item))
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
    covered = set()
    for a in range(len(w) - 7):
        if seen[tuple(w[a : a + 8])] > 1:
            covered.update(range(a, a + 8))
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )
