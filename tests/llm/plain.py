"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = "[^\\x20\\x09-\\x0D]+"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def repeated_bytes(raw, length):
    """Flags of the bytes inside strings of ``length`` that start at two places or more, for each text."""
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        flags = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                flags[p : p + length] = b"\x01" * length
        out.append(flags)
    return out


def suffix_dedup(rows, length=400, short=256):
    """rows of (doc_id, text) -> rows of the digest."""
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, gone, again in zip(rows, raw, repeated_bytes(raw, length), repeated_bytes(raw, short), strict=True):
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)), sum(again)))
    return out


def bench_words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))


def decontaminate(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repetition(text):
    text = text or ""
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    chars = sum(map(len, w))

    def covered(n):
        seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}

    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    base = (len(w), chars, sum(c in "#*$%&|<>" for c in text), len(again), len(covered(5)))
    failed = len(w) < 10 or 100 * base[4] > 20 * len(w)
    share = {n: sum(len(w[k]) for k in covered(n)) / max(1, chars) for n in range(5, 11)}
    line = sum(len(x) for y in again for x in re.findall(SPACE, y)) / max(1, chars)
    return base, failed, share, line


def repeat_runs(text):
    w = re.findall(SPACE, text or "")
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return sum(k - 1 not in hit for k in hit)


def line_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    order = lambda i: (i is not None, i)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)], key=order)]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def fingerprint(text):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    lowest = {}
    for (i, _), g in zip(fps, group, strict=True):
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    return [(i, f"{fp:016x}", lowest.get(g)) for (i, fp), g in zip(fps, group, strict=True)]


def mixture(rows):
    """rows of (doc_id, text, source) -> (doc_id, size, source_size, target, taken)."""
    size = [len(re.findall(SPACE, t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    while open_:
        left = sum(size) - sum(target[s] for s in names if s not in open_)
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else level * weight[s]
        open_ = open_ - full if full else set()
    return size, total, target


def fill_middle(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix chars, middle chars, output)."""
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def repeated_starts(rows, size=20):
    """rows of (key, words) in order -> starts of windows that start earlier, by position of the row."""
    seen, out = set(), []
    for _, w in rows:
        mine = []
        for k in range(len(w) - size + 1):
            t = tuple(w[k : k + size])
            if t in seen:
                mine.append(k)
            seen.add(t)
        out.append(mine)
    return out


def seed_extend(rows, size=20):
    """rows of (doc_id, text), no two equal -> rows of the digest; nulls first, then ids, then the hash of the text as ordered by the caller."""
    cut = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    out = []
    for (i, w), starts in zip(cut, repeated_starts(cut, size), strict=True):
        gone = {p for k in starts for p in range(k, k + size)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def clusters(rows, k=8, rounds=10, dims=64):
    """rows of (vec_id, vector) -> rows (vec_id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(((sha(f"3:{'' if i is None else i}"), v) for i, v in kept))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in last:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), sha(",".join(map(str, centroids[j])))) for i, j, d in last]
