"""Plain Python versions of what the queries must return, by their definitions; no hashing, no blocks."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def substring_dedup(docs, window=50):
    """doc_id, n_words, n_removed, kept_sha256; a null id stands behind every other."""
    last = float("inf")
    least = {}
    split = [(last if i is None else i, words(t)) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, last))
    out = []
    for (i, _), (own, w) in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < own:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def byte_dedup(docs, length=400):
    n = Counter()
    raw = [(t or "").encode() for _, t in docs]
    for b in raw:
        n.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def media(docs):
    out = []
    for i, t in docs:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        out.append((i, len(b), len(p), sha(p), zlib.crc32(p[-32:])))
    return out


PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def licenses(docs):
    """doc_id, n_words, n_base, first_word, last_word, base_labels."""
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        found = [(k, x) for x, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in found]
        out.append((i, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def rules(docs):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for i, t in docs:
        t = t or ""
        w = words(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if words(x):
                dup += x in seen
                seen.add(x)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = set()
        for k in range(len(w) - 2):
            if n[tuple(w[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    return out


def shingles(text):
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near(docs):
    """doc_id, n_shingles, component_id, kept for distinct, non-null ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for h in holders.values():
        for k, a in enumerate(h):
            for b in h[k + 1 :]:
                both[a, b] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets.items()]


def maximal_repeats(texts, length):
    """(doc, start, length) of all places of all strings that repeat and can be extended on neither side."""
    at = {}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            at.setdefault(t[i : i + length], []).append((d, i))
    found = set()
    for places in at.values():
        for k, (d, i) in enumerate(places):
            for e, j in places[k + 1 :]:
                if i and j and texts[d][i - 1] == texts[e][j - 1]:
                    continue
                n = length
                while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                    n += 1
                found.add(texts[d][i : i + n])
    return {(d, i, len(x)) for x in found for d, t in texts.items() for i in range(len(t) - len(x) + 1) if t.startswith(x, i)}
