"""Plain versions of the operators on repeats and near copies, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def cover(n: int, starts: list[int], width: int) -> list[bool]:
    gone = [False] * n
    for s in starts:
        gone[s: s + width] = [True] * width
    return gone


def repeated_words(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i: i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = cover(len(w), [i for i in range(len(w) - width + 1)
                              if seen[tuple(w[i: i + width])] > 1], width)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), sha(kept.encode())))
    return out


def repeated_bytes(rows, width=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(t[i: i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = cover(len(t), [i for i in range(len(t) - width + 1)
                              if seen[hash(t[i: i + width])] > 1], width)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, sha(kept)))
    return out


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def components(rows, size=4, percent=80):
    """(doc_id, n_shingles, component) by index: pairs that share shingles, counted."""
    sets = [shingles(t, size) for _, t in rows]
    first, parent = {}, list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = []
    for i, s in enumerate(sets):
        j = first.setdefault(frozenset(s), i) if s else i
        if j == i:
            distinct.append(i)
        parent[top(i)] = top(j)
    holders = defaultdict(list)
    for i in distinct:
        met = Counter(j for x in sets[i] for j in holders[x])
        for j, shared in met.items():
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[top(i)] = top(j)
        for x in sets[i]:
            holders[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(top(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s):
    return "".join(c for c in s if c in "0123456789")


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+",
             lambda m: 13 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_spans(rows, patterns, by_start):
    out = []
    for doc_id, t in rows:
        found = [(k, m.start(), m.end()) for k, (p, ok) in patterns.items()
                 for m in re.finditer(p, t or "") if ok(m)]
        if by_start:
            found.sort(key=lambda s: (s[1], list(patterns).index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((doc_id, *(sum(s[0] == k for s in found) for k in patterns), sha(text.encode())))
    return out


def rule_counts(rows):
    out = []
    for doc_id, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        seen = Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
        gone = sum(cover(len(w), [i for i in range(len(w) - 4) if seen[tuple(w[i: i + 5])] > 1], 5))
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, gone,
                    len(w) < 10 or 100 * gone > 20 * len(w)))
    return out
