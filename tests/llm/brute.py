"""Plain Python versions of what the queries must return."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(item))
    lengths = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def pii(text):
    """Counts and the hash of base spans."""
    text = text or ""
    d = lambda s: re.sub("[^0-9]", "", s)
    found = [
        [("email", m.start(), m.end()) for m in EMAIL.finditer(text)],
        [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d(m[0])) <= 19 and luhn(d(m[0]))],
        [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(d(m[0])) <= 15],
    ]
    return tuple(map(len, found)), [f"{k}:{a}:{b}" for f in found for k, a, b in f]


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text):
    text = text or ""
    found = [
        [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20],
        [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24],
    ]
    every = sorted((a, i, f"{k}:{a}:{b}") for i, f in enumerate(found) for k, a, b in f)
    return tuple(map(len, found)), [x for _, _, x in every]


def shingle_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(docs, n=3, share=85):
    sets = {d: shingle_set(t, n) for d, t in docs}
    holders, root = defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d in sorted(sets):
        met = defaultdict(int)
        for s in sets[d]:
            for o in holders[s]:
                met[o] += 1
            holders[s].append(d)
        for o, both in met.items():
            if 100 * both >= share * (len(sets[o]) + len(sets[d]) - both):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, size=200):
    """(bytes, removed, runs, sha256 of the rest) of each text."""
    seen = defaultdict(int)
    raw = {d: (t or "").encode() for d, t in docs}
    for b in raw.values():
        for i in range(len(b) - size + 1):
            seen[hash(b[i : i + size])] += 1
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        reach = 0
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                for j in range(max(i, reach), i + size):
                    gone[j] = 1
                reach = i + size
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
