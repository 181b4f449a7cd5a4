"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of bytes.

The textbook steps, each over whole buckets at a time: classify suffixes as smaller or larger than
the next one; take the leftmost smaller ones of each run; sort the substrings between them by
inducing; name them; sort the string of names; and induce all suffixes from that order. A bucket is
served in waves: what is induced into the bucket that is being served makes the next wave.
"""

from __future__ import annotations

import numpy as np

#: Reserved symbols: no byte of UTF-8 text becomes one of these after the shift by 2.
END, GAP = 0, 1


def symbols(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as symbols above END and GAP (bytes 254 and 255 do not occur in UTF-8)."""
    return data + np.uint8(2)


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    rise[-1] = 1
    # A run of equal symbols is decided by what follows it.
    at = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return rise[following] > 0


def _induce(t: np.ndarray, small: np.ndarray, first: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from leftmost smaller suffixes in the order given."""
    n = len(t)
    ends = np.cumsum(sizes)
    sa = np.full(n, -1, np.int64)
    # Seeds stand at the ends of their buckets in the order given.
    of = t[seeds]
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(sizes))
    starts = ends - counts
    sa[np.repeat(starts, counts) + np.arange(len(seeds)) - np.repeat(np.cumsum(counts) - counts, counts)] = seeds[order]
    used = np.flatnonzero(sizes)

    def deal(items: np.ndarray, fill: np.ndarray, step: int) -> None:
        """Append items to their buckets, upwards or downwards, in order."""
        c = t[items]
        order = np.argsort(c, kind="stable")
        c = c[order]
        heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        n_each = np.diff(np.r_[heads, len(c)])
        which = c[heads]
        rank = np.arange(len(c)) - np.repeat(heads, n_each)
        sa[np.repeat(fill[which], n_each) + step * rank] = items[order]
        fill[which] += step * n_each

    fill = first.copy()
    for c in used.tolist():
        out, done = [], first[c]
        while done < fill[c]:
            wave = sa[done : fill[c]]
            done = int(fill[c])
            j = wave[wave > 0] - 1
            j = j[~small[j]]
            same = t[j] == c
            stay = j[same]
            sa[done : done + len(stay)] = stay
            fill[c] += len(stay)
            out.append(j[~same])
        if counts[c]:
            j = sa[starts[c] : ends[c]]
            j = j[j > 0] - 1
            out.append(j[~small[j]])
        if out and sum(map(len, out)):
            deal(np.concatenate(out), fill, 1)
    fill = ends - 1
    n_small = np.bincount(t[small], minlength=len(sizes))
    for c in reversed(used.tolist()):
        out, done = [], int(ends[c] - 1)
        while done > fill[c]:
            wave = sa[fill[c] + 1 : done + 1][::-1]
            done = int(fill[c])
            j = wave[wave > 0] - 1
            j = j[small[j]]
            same = t[j] == c
            stay = j[same]
            sa[done - len(stay) + 1 : done + 1] = stay[::-1]
            fill[c] -= len(stay)
            out.append(j[~same])
        if c == 0 and fill[c] == ends[c] - 1:
            # The end of the string is smaller than all; nothing induces it.
            sa[0] = n - 1
            fill[c] -= 1
            j = np.array([n - 2]) if n > 1 else np.empty(0, np.int64)
            out.append(j[small[j]])
        larger = sa[first[c] : ends[c] - n_small[c]][::-1]
        j = larger[larger > 0] - 1
        out.append(j[small[j]])
        if out and sum(map(len, out)):
            deal(np.concatenate(out), fill, -1)
    return sa


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffixes of a string over a large alphabet in order, by doubling of ranks; only suffixes
    whose rank is shared are sorted again."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # rank: place of the first suffix with this prefix
    heads = np.r_[True, rank[order][1:] != rank[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    width = 1
    while True:
        sorted_rank = rank[order]
        shared = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        places = np.flatnonzero(shared)
        if not len(places):
            return order
        part = order[places]
        later = part + width
        second = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        by = np.lexsort((second, rank[part]))
        part, second = part[by], second[by]
        order[places] = part
        first = rank[part]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[part] = np.maximum.accumulate(np.where(new, places, 0))
        width *= 2


def suffix_array(t: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """Starts of all suffixes of t in order. t ends in a 0 that occurs nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = _smaller(t)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(t, minlength=alphabet)
    first = np.cumsum(sizes) - sizes
    if len(leftmost) > 1:
        # Sort the substrings between leftmost smaller suffixes, and name them by rank.
        sa = _induce(t, small, first, sizes, leftmost)
        is_left = np.zeros(n, bool)
        is_left[leftmost] = True
        ordered = sa[is_left[sa]]
        length = np.zeros(n, np.int64)
        length[leftmost] = np.r_[np.diff(leftmost), 1] + 1
        length[leftmost[-1]] = n - leftmost[-1]
        names = np.empty(n, np.int64)
        names[ordered] = np.cumsum(np.r_[0, ~_equal(t, ordered[:-1], ordered[1:], length)])
        reduced = names[leftmost]
        distinct = int(reduced.max()) + 1
        if distinct == len(leftmost):
            order = np.argsort(reduced)
        elif distinct * 64 < len(leftmost):
            order = suffix_array(reduced, distinct)
        else:
            order = _doubled(reduced)
        leftmost = leftmost[order]
    return _induce(t, small, first, sizes, leftmost)


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a[k] and b[k], of the lengths given by start, are equal."""
    same = length[a] == length[b]
    active = np.flatnonzero(same)
    at = 0
    while len(active):
        x, y = a[active] + at, b[active] + at
        differ = t[x] != t[y]
        same[active[differ]] = False
        at += 1
        active = active[~differ & (length[a[active]] > at)]
    return same


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common): for every start, the start of the suffix just before it in order (-1 for
    the first), and the length of their common prefix, not beyond `limit` of the start.

    A value is one less than its left neighbour's where both suffixes go on to the left with the
    same symbol; only the others are compared, eight symbols at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.arange(-1, n - 1)
    fresh = (left < 0) | (before <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = (t[inner - 1] != t[before[inner] - 1]) | (limit[inner - 1] != limit[inner] + 1)
    starts = np.flatnonzero(fresh & (before >= 0))
    common = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    active, at = starts, 0
    while len(active):
        differ = words[np.minimum(active + at, n)] ^ words[np.minimum(before[active] + at, n)]
        # The lowest set bit tells the first symbol that differs.
        bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        stop = differ != 0
        common[active[stop]] = at + bit[stop]
        active = active[~stop]
        at += 8
        over = at >= limit[active]
        common[active[over]] = at
        active = active[~over]
    common[starts] = np.minimum(common[starts], limit[starts])
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return before, np.maximum(common[source] - (np.arange(n) - source), 0)
