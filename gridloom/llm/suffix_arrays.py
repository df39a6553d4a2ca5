"""Suffix arrays by induced sorting, and common prefixes, on numpy arrays of one shard."""

from __future__ import annotations

import numpy as np


def _induce(text: np.ndarray, sa: np.ndarray, heads: np.ndarray, wanted: np.ndarray) -> None:
    """Scan `sa` once from the left; the suffix before each found one, if `wanted`, goes to its bucket's head.

    The scan takes blocks. A block ends before the first place that it fills itself, so every place is
    final when it is read; between buckets such places are far away, and blocks stay long.
    """
    n, at, step = len(sa), 0, 256
    while at < n:
        end = min(at + step, n)
        held = np.flatnonzero(sa[at:end] > 0)
        before = sa[at + held] - 1
        keep = wanted[before]
        held, before = held[keep], before[keep]
        if not len(before):
            at, step = end, min(step * 2, 1 << 16)
            continue
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        ordered = chars[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rank = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
        target = np.empty(len(order), np.int64)
        target[order] = heads[ordered] + rank
        stop = min(end, int(target.min()))
        if stop < end:
            cut = int(np.searchsorted(held, stop - at))
            before, target, chars = before[:cut], target[:cut], chars[:cut]
        sa[target] = before
        heads[chars] = target + 1  # targets rise within a bucket, and the last of equal indices is kept
        step = min(step * 2, 1 << 16) if stop == end else max(64, 2 * (stop - at))
        at = stop


def _sort_from(text: np.ndarray, small: np.ndarray, starts: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller suffixes in their order."""
    n = len(text)
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    order = np.argsort(text[leftmost], kind="stable")
    ordered = text[leftmost][order]
    sa[starts[1:][ordered] - np.searchsorted(ordered, ordered, "right") + np.arange(len(ordered))] = leftmost[order]
    heads = starts[:-1].copy()
    sa[heads[text[n - 1]]] = n - 1  # the last suffix comes before all others of its bucket
    heads[text[n - 1]] += 1
    _induce(text, sa, heads, ~small)
    # Smaller suffixes are induced from the right: the same scan over the mirrored array.
    mirror = np.where((sa >= 0) & ~small[sa], sa, -1)[::-1].copy()
    _induce(text, mirror, n - starts[1:], small)
    return mirror[::-1].copy()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of an integer text with values below about its length (or 300).

    Induced sorting: suffixes are classified as larger or smaller than the next one; the substrings between
    leftmost smaller suffixes are sorted by one induction, named, and sorted recursively where names repeat;
    a second induction from their order gives all suffixes. A suffix is smaller than any it is a prefix of.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    text = text.astype(np.uint16 if text.max() < 1 << 16 else np.int64)  # stable sorts of 16 bits are linear
    less, differ = text[:-1] < text[1:], text[:-1] != text[1:]
    # Type of i: that of the next position where two neighbours differ; the last suffix is larger.
    where = np.where(differ, np.arange(n - 1), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = np.zeros(n, bool)
    known = where < n
    small[:-1][known] = less[where[known]]
    starts = np.concatenate(([0], np.cumsum(np.bincount(text))))
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) < 2:
        return _sort_from(text, small, starts, leftmost)
    first = _sort_from(text, small, starts, leftmost)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    ordered = first[is_left[first]]
    # Name the substrings (up to and with the next leftmost position) by comparing neighbours.
    ends = np.append(leftmost[1:], n)
    length = np.zeros(n, np.int64)
    length[leftmost] = ends - leftmost
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    alive = np.flatnonzero(same)
    k = 0
    while len(alive):
        done = k > length[a[alive]]
        alive = alive[~done]
        x, y = a[alive] + k, b[alive] + k
        inside = (x < n) & (y < n)
        equal = np.zeros(len(alive), bool)
        equal[inside] = text[x[inside]] == text[y[inside]]
        same[alive[~equal]] = False
        alive = alive[equal]
        k += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(leftmost):
        reduced = np.empty(n, np.int32)
        reduced[ordered] = names
        ordered = leftmost[suffix_array(reduced[leftmost])]
    return _sort_from(text, small, starts, ordered)


def common_prefixes(text: np.ndarray, sa: np.ndarray, bound: int) -> np.ndarray:
    """For each place in `sa` but the first, the common prefix with the place before, cut at `bound`.

    Permuted form: phi[i] is the suffix sorted just before i, and plcp[i] their common prefix. Where the
    characters before i and phi[i] agree, plcp[i] = plcp[i - 1] - 1; only the other places are compared.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (at > 0) & (phi > 0)
    follows[follows] = text[at[follows] - 1] == text[phi[follows] - 1]
    plcp = np.zeros(n, np.int64)
    alive, k = at[~follows & (phi >= 0)], 0
    while len(alive):
        alive = alive[np.maximum(alive, phi[alive]) + k < n]
        alive = alive[text[alive + k] == text[phi[alive] + k]]
        k += 1
        plcp[alive] = k
    reach = np.maximum.accumulate(np.where(follows, 0, plcp + at))
    plcp = np.where(follows, reach - at, plcp)
    out[1:] = np.minimum(plcp[sa[1:]], bound)
    return out
