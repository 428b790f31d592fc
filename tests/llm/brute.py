"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = gone.count(b"\0\1") + (gone[:1] == b"\1")
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def unigram(rows):
    tokens = {i: [*WORDS.findall((t or "").translate(LOW)), None] for i, t in rows}
    c = collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(t)
    n, v = sum(c.values()), len(c)
    return {i: (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}


def secrets(text):
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (r, ok)) in enumerate(kinds.items()) for m in r.finditer(text or "") if ok(m)]
    return hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()


def edit_substring(item, text):
    """Least edit distance of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
