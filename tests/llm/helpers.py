"""Fixtures and plain re-implementations that the operators are held against."""

from __future__ import annotations

import collections
import hashlib
import random
import re


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(seed, words, letters="abcdefghijklmnop"):
    """Sentences of invented words."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 8)))
    out = []
    while words > 0:
        n = draw.randint(3, 12)
        out.append(" ".join(word() for _ in range(n)).capitalize() + ".")
        words -= n
    return " ".join(out)


def sets(docs, size):
    found = {}
    for i, text in docs:
        words = re.findall("[^\\x20\\x09-\\x0D]+", fold(text))
        found[i] = {tuple(words[p : p + size]) for p in range(max(1, len(words) - size + 1))} if words else set()
    return found


def near_groups(docs, size, percent):
    """(id, shingles, component, kept) by comparing every pair that shares a shingle."""
    own = sets(docs, size)
    holders = collections.defaultdict(list)
    for i, s in own.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in own.items():
        for j, both in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(own[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(own[i]), root(i), root(i) == i) for i in own)


def benchmark_hits(docs, items, window=10):
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    windows = collections.defaultdict(set)
    for i, text in items:
        words = pattern.findall(fold(text))
        size = min(window, len(words))
        for p in range(len(words) - size + 1) if size else ():
            windows[tuple(words[p : p + size])].add(str(i))
    out = []
    for i, text in docs:
        words, hit, found = pattern.findall(fold(text)), set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                own = windows.get(tuple(words[p : p + size]))
                if own:
                    hit.update(range(p, p + size))
                    found |= own
        names = sorted(found)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out)


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    count = [sum(f[1] == k for f in found) for k in range(3)]
    return (*count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


#: columns whose names clash with ones that operators use inside
CLASHES = ["id", "text_", "spans", "component", "hash", "key", "s", "score", "label", "n"]


def with_clashes(df):
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df
