"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(doc_id):
    return LAST if doc_id is None else doc_id


def substrings(rows, size=20, hashes=None):
    """rows: (doc_id, text); rows of one id are ordered by the hash of their text."""
    docs = [(d, (key(d), (hashes or {}).get(t or "", 0)), WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for _, order, w in docs:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (order, s)), (order, s))
    out = []
    for d, order, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (order, s):
                gone[s : s + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def repeated_bytes(rows, size=200):
    docs = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[s : s + size] for _, b in docs for s in range(len(b) - size + 1))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def shingle_sets(rows, size=4):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(low))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def components(rows):
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        members[find(k)].append(d)
    return sorted(((d, len(sets[k]), min((m for m in members[find(k)] if m is not None), default=None)) for k, (d, _) in enumerate(rows)), key=str)


def quality(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base))
    return sorted(out, key=str)


def lines(rows, min_sites=8):
    """rows: (doc_id, text, source)."""
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" \t\n\x0b\x0c\r")].add(s or "")
    bad = {x for x, c in sites.items() if x and len(c) >= min_sites}
    out = []
    for d, t, _ in rows:
        parts = (t or "").split("\n")
        strip = [x.strip(" \t\n\x0b\x0c\r") for x in parts]
        left = [p for p, x in zip(parts, strip) if x not in bad]
        out.append((d, sum(x != "" for x in strip), len(parts) - len(left), sha("\n".join(left))))
    return sorted(out, key=str)
