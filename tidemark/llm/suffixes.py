"""Suffix arrays by induced sorting (SA-IS) and permuted longest common prefixes.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller substrings by
induction, names them, sorts the reduced text recursively and induces the array of the
whole text.  Over bytes each induction goes bucket by bucket in whole numpy batches (as
many rounds a bucket as its longest run of one letter); over the names of a reduced
text, which has many small buckets, it goes letter by letter.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1024  # alphabets up to this size are induced in batches


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: integers >= 0; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    return _sort(np.append(np.asarray(text, np.int64) + 1, 0))[1:]


def _sort(t: np.ndarray, top: bool = True) -> np.ndarray:
    """The suffix array of t, whose last letter is 0 and occurs once."""
    n, letters = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    # smaller[i]: suffix i is smaller than suffix i + 1; runs of one letter take the type of what follows
    differs = np.append(t[1:] != t[:-1], True)
    following = np.flatnonzero(differs)[np.cumsum(np.concatenate([[0], differs[:-1].astype(np.int64)]))]
    smaller = np.ones(n, bool)
    inner = following < n - 1
    smaller[inner] = t[following[inner]] < t[following[inner] + 1]
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=letters))])
    induce = _induce_batches if top and letters <= _SMALL else _induce_letters
    sa = induce(t, smaller, starts, leftmost)
    # names of the leftmost-smaller substrings, in sorted order
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = sa[is_leftmost[sa]]
    m = len(order)
    place = np.full(n + 1, -1, np.int64)
    place[leftmost] = np.arange(m)
    ends = np.append(leftmost[1:], n - 1)
    length = (ends - leftmost + 1)[place[order]]
    same = np.zeros(m, bool)
    pairs = np.flatnonzero(length[1:] == length[:-1])
    a, b, left = order[pairs], order[pairs + 1], length[pairs]
    k = 0
    while len(pairs):
        alike = (t[a + k] == t[b + k]) & (smaller[a + k] == smaller[b + k])
        done = alike & (left == k + 1)
        same[pairs[done] + 1] = True
        on = alike & ~done
        pairs, a, b, left, k = pairs[on], a[on], b[on], left[on], k + 1
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < m:
        reduced = np.empty(m, np.int64)
        reduced[place[order]] = names
        order = leftmost[_sort(reduced, False)]
    return induce(t, smaller, starts, order)


def _induce_batches(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    n, letters = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    seed_letter = t[seeds]
    by = np.argsort(seed_letter, kind="stable")
    seeds, counts = seeds[by], np.bincount(seed_letter, minlength=letters)
    seed_at = np.concatenate([[0], np.cumsum(counts)])
    # larger suffixes: from the left, each from the one behind it
    head = starts[:-1].copy()
    used = np.flatnonzero(starts[1:] > starts[:-1]).tolist()
    for c in used:
        at = int(starts[c])
        while True:
            now, at = sa[at : head[c]], int(head[c])
            if not len(now):
                break
            _place(sa, t, smaller, now, head, False)
        _place(sa, t, smaller, seeds[seed_at[c] : seed_at[c + 1]], head, False)
    # smaller suffixes: from the right
    tail = starts[1:].copy()
    larger_end = head
    for c in reversed(used):
        at = int(starts[c + 1])
        while True:
            now, at = sa[tail[c] : at][::-1], int(tail[c])
            if not len(now):
                break
            _place(sa, t, smaller, now, tail, True)
        _place(sa, t, smaller, sa[starts[c] : larger_end[c]][::-1], tail, True)
    sa[0] = n - 1
    return sa


def _place(sa: np.ndarray, t: np.ndarray, smaller: np.ndarray, sources: np.ndarray, ends: np.ndarray, small: bool) -> None:
    """Puts the predecessors of the sources that are of the wanted type into their buckets, in order."""
    p = sources[sources > 0] - 1
    p = p[smaller[p] == small]
    if not len(p):
        return
    letter = t[p]
    by = np.argsort(letter, kind="stable")
    p, letter = p[by], letter[by]
    first = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
    many = np.diff(np.append(first, len(p)))
    rank = np.arange(len(p)) - np.repeat(first, many)
    if small:
        sa[ends[letter] - 1 - rank] = p
        ends[letter[first]] -= many
    else:
        sa[ends[letter] + rank] = p
        ends[letter[first]] += many


def _induce_letters(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    n = len(t)
    sa, letters, kinds = [-1] * n, t.tolist(), smaller.tolist()
    tail = starts[1:].tolist()
    for i in reversed(seeds.tolist()):
        c = letters[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = starts[:-1].tolist()
    for k in range(n):
        j = sa[k] - 1
        if j >= 0 and not kinds[j]:
            c = letters[j]
            sa[head[c]] = j
            head[c] += 1
    tail = starts[1:].tolist()
    for k in range(n - 1, -1, -1):
        j = sa[k] - 1
        if j >= 0 and kinds[j]:
            c = letters[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each position, the common prefix (at most ``most`` bytes) of its suffix and the one before it in sa.  text: uint8."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    if n:
        before[sa[0]] = n
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 8, 8), (1, 1))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before < n)
    k = 0
    while k < most and len(live):
        a = eight[live + k].copy().view("<u8").reshape(-1)
        b = eight[before[live] + k].copy().view("<u8").reshape(-1)
        x = a ^ b
        equal = x == 0
        low = x & (~x + np.uint64(1))
        bits = np.zeros(len(x), np.int64)
        bits[~equal] = np.log2(low[~equal].astype(np.float64)).astype(np.int64)
        out[live] = k + np.where(equal, 8, bits // 8)
        live, k = live[equal], k + 8
    limit = np.minimum(n - np.arange(n), most)
    limit[before < n] = np.minimum(limit[before < n], n - before[before < n])
    return np.minimum(out, limit)
