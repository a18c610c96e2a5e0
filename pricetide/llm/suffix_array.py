"""Suffix array of a shard by induced sorting, and permuted common prefixes, in numpy.

The scans of induced sorting are done a bucket at a time: when the scan reaches a bucket, everything that buckets before it
put there is in place, so all its entries induce their predecessors at once, in order. Left-most-smaller (LMS) substrings
are sorted by one such induction and named; the recursion on the string of names doubles the number of names that are
compared with every step, because its alphabet is too large for buckets, and ends once ``depth`` characters are covered.
Suffixes that agree in their first ``depth`` characters stand together, in any order.
"""

from __future__ import annotations

import numpy as np

def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour (S); the last one counts as such."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _put(sa: np.ndarray, text: np.ndarray, source: np.ndarray, pointer: np.ndarray, chosen: np.ndarray, down: bool) -> None:
    """Enters the predecessors of ``source[chosen]`` at the pointers of their buckets, in order."""
    j = source[chosen] - 1
    ch = text[j]
    order = np.argsort(ch, kind="stable")
    j, ch = j[order], ch[order]
    count = np.bincount(ch, minlength=len(pointer))
    rank = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)
    if down:
        sa[pointer[ch] - rank] = j
        pointer -= count
    else:
        sa[pointer[ch] + rank] = j
        pointer += count


def induce(text: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from LMS suffixes given in an order that is right inside each bucket."""
    sa = np.full(len(text), -1, np.int32)
    tail = np.cumsum(sizes)
    head = tail - sizes
    ch = text[lms]
    by_bucket = lms[np.argsort(ch, kind="stable")]
    lms_end = np.cumsum(np.bincount(ch, minlength=len(sizes)))
    lms_start = lms_end - np.bincount(ch, minlength=len(sizes))
    pointer = head.copy()
    used = np.flatnonzero(sizes)
    for c in used:
        at = head[c]
        while at < pointer[c]:  # runs of one character: each round is one step further to the left
            entries = sa[at : pointer[c]]
            at = pointer[c]
            j = entries[entries > 0] - 1
            j = j[text[j] == c]
            sa[at : at + len(j)] = j
            pointer[c] += len(j)
        source = np.concatenate((sa[head[c] : pointer[c]], by_bucket[lms_start[c] : lms_end[c]]))
        source = source[source > 0]
        if len(source):
            _put(sa, text, source, pointer, text[source - 1] > c, False)
    l_end, pointer = pointer, tail - 1
    sa[0] = len(text) - 1  # the end of the text, which nothing induces
    pointer[0] -= 1
    for c in used[::-1]:
        at = tail[c] - 1
        while at > pointer[c]:
            entries = sa[pointer[c] + 1 : at + 1][::-1]
            at = pointer[c]
            j = entries[entries > 0] - 1
            j = j[text[j] == c]
            sa[at - len(j) + 1 : at + 1] = j[::-1]
            pointer[c] -= len(j)
        source = np.concatenate((sa[pointer[c] + 1 : tail[c]][::-1], sa[head[c] : l_end[c]][::-1]))
        source = source[source > 0]
        if len(source):
            _put(sa, text, source, pointer, text[source - 1] < c, True)
    return sa


def _sort_names(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first 2**steps names."""
    n = len(names)
    rank = names.astype(np.int64)
    span = 1
    for _ in range(steps):
        ahead = np.zeros(n, np.int64)
        ahead[: n - span] = rank[span:] + 1 if n > span else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        line = key[order]
        new = np.concatenate(([False], line[1:] != line[:-1]))
        rank[order] = np.cumsum(new)
        span *= 2
        if rank[order[-1]] == n - 1 or span >= n:
            break
    return np.argsort(rank, kind="stable")


def _four_at_once(text: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """The text with zeros after it, and the four symbols from each position as one number."""
    wide = np.zeros(len(text) + more + 8, np.uint16)
    wide[: len(text)] = text
    return wide, np.ndarray(shape=(len(wide) - 4,), dtype=np.uint64, buffer=wide.data, strides=(2,))


def _differ(text: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For LMS substrings in order, whether each differs from the one before it."""
    _, fours = _four_at_once(text, 4)
    out = np.zeros(len(ordered), bool)
    length = ends[ordered] - ordered
    out[1:] = length[1:] != length[:-1]
    live = np.flatnonzero(~out[1:]) + 1
    done = 0
    while len(live):
        left = length[live] - done
        away = fours[ordered[live] + done] ^ fours[ordered[live - 1] + done]
        away &= np.where(left >= 4, np.uint64(2**64 - 1), (np.uint64(1) << (16 * np.minimum(left, 3)).astype(np.uint64)) - np.uint64(1))
        out[live[away != 0]] = True
        done += 4
        live = live[(away == 0) & (left > 4)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """``text``: uint16 symbols that end with the only 0. Suffixes in the order of their first ``depth`` symbols."""
    smaller = _types(text)
    sizes = np.bincount(text)
    flag = smaller.copy()
    flag[1:] &= ~smaller[:-1]
    flag[0] = False
    lms = np.flatnonzero(flag).astype(np.int32)
    if len(lms) > 1:
        first = induce(text, lms, sizes)
        ordered = first[flag[first]]
        ends = np.empty(len(text), np.int32)
        ends[lms] = np.append(lms[1:], lms[-1]) + 1
        del first
        name = np.empty(len(text), np.int32)
        name[ordered] = np.cumsum(_differ(text, ordered, ends), dtype=np.int32)
        lms = lms[_sort_names(name[lms], int(np.ceil(np.log2(max(2, depth / 2)))))]
    return induce(text, lms, sizes)


def repeats(text: np.ndarray, sa: np.ndarray, length: int, place: np.ndarray | None = None) -> np.ndarray:
    """Flags the positions whose first ``length`` symbols also begin at another position.

    ``place`` names what each position stands for, if several positions may be the same one; those do not repeat each other.

    A permuted common prefix belongs to a position and its predecessor in the suffix array. Along a chain of positions with
    predecessors at one distance it falls by one each step, so only the ends of chains are compared symbol by symbol.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    same = np.zeros(n, bool)
    has = before >= 0
    same[has] = text[np.flatnonzero(has)] == text[before[has]]
    last = np.ones(n, bool)  # of its chain
    last[:-1] = before[1:] != before[:-1] + 1
    # First mismatch at or after each position, or the end of its chain if there is none before it.
    stop = np.where(~same | last, np.arange(n, dtype=np.int32), np.int32(n))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.flatnonzero(last & same)
    tail = np.zeros(n, np.int32)
    wide, fours = _four_at_once(text, length + 8)
    at, to = ends + 1, before[ends] + 1
    live = np.arange(len(ends))
    done = 0
    while len(live) and done < length:
        equal = fours[at[live] + done] == fours[to[live] + done]
        stopped = live[~equal]
        for k in range(4):
            a, b = at[stopped] + done + k, to[stopped] + done + k
            agree = wide[a] == wide[b]
            tail[ends[stopped[~agree]]] = done + k
            stopped = stopped[agree]
        live = live[equal]
        done += 4
        live = live[at[live] + done < n]
    tail[ends[live]] = length
    run = stop - np.arange(n, dtype=np.int32)
    long = (np.where(same[stop], run + 1 + tail[stop], run) >= length) & has
    joined = long[sa]  # to the one before it in the suffix array
    heads = np.flatnonzero(~joined)
    del before, same, last, stop, tail, run, long
    names = (np.arange(n, dtype=np.uint64) if place is None else place)[sa]
    several = np.minimum.reduceat(names, heads) != np.maximum.reduceat(names, heads)
    out = np.zeros(n, bool)
    out[sa] = np.repeat(several, np.diff(np.append(heads, n)))
    return out
