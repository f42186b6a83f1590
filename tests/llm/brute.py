"""Plain versions of the contracts, written from their wording."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        s += v if v < 10 else v - 9
    return s % 10 == 0


def digest(spans, kinds):
    spans.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def pii(text):
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    spans = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    return [sum(s[0] == k for s in spans) for k in rules] + [digest(spans, list(rules))]


def secrets(text):
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = {"assign": (assign, lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    spans = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]
    return [sum(s[0] == k for s in spans) for k in rules] + [digest(spans, list(rules))]


def tokens(docs, path):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path), 0, []
    for i, text in sorted(docs, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def repeats(docs, w=13):
    starts = {}
    for i, t in docs:
        x = words(t)
        for p in range(len(x) - w + 1):
            k = tuple(x[p : p + w])
            if i is not None:
                starts[k] = min(starts.get(k, i), i)
    out = []
    for i, t in docs:
        x = words(t)
        gone = set()
        for p in range(len(x) - w + 1):
            if i is not None and starts[tuple(x[p : p + w])] < i:
                gone.update(range(p, p + w))
        kept = b" ".join(x[p] for p in range(len(x)) if p not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, n):
    x = words(text, lower=True)
    if not x:
        return frozenset()
    return frozenset([tuple(x)]) if len(x) < n else frozenset(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def near(docs, n=2, percent=80):
    """Exact: by an inverted index with counts."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    index, count = defaultdict(list), {}
    for i in sorted(sets):
        count.clear()
        for s in sets[i]:
            for j in index[s]:
                count[j] = count.get(j, 0) + 1
            index[s].append(i)
        for j, c in count.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sets]
