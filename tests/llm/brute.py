"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def big(doc_id):
    return float("inf") if doc_id is None else doc_id


def window_repeats(docs, size):
    """For each (doc_id, text): its words, and which of them a repeated window covers."""
    first, split = {}, [WORDS.findall(t or "") for _, t in docs]
    for (i, _), w in zip(docs, split):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, float("inf")), big(i))
    out = []
    for (i, _), w in zip(docs, split):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < big(i):
                gone[k : k + size] = [True] * size
        out.append((w, gone))
    return out


def op3(docs, size=13):
    return [(i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (i, _), (w, g) in zip(docs, window_repeats(docs, size))]


def op8_text(docs, min_chars=10):
    """What is left of each text."""
    return op8(docs, min_chars, whole=True)


def op8(docs, min_chars=10, whole=False):
    strip = "".join(map(chr, [32, *range(9, 14)]))
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(strip).translate(low)
    first = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), float("inf")), big(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] >= big(i)]
        out.append("\n".join(kept) if whole else (i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op2_gone(docs, window=50):
    """Per document, which words go."""
    return [g for _, g in window_repeats(docs, window)]


def shingle_set(text, size):
    low = {c: c + 32 for c in range(65, 91)}
    w = WORDS.findall((text or "").translate(low))
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def op6(docs, size=3, percent=90):
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both) and find(i) != find(j):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    return [(i, len(s), docs[find(k)][0]) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def op4_base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeat = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += line in lines and bool(WORDS.search(line))
        lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def op10_base(text):
    low = {c: c + 32 for c in range(65, 91)}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = [(k, label) for k in range(len(w)) for p, label in phrases.items() if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
