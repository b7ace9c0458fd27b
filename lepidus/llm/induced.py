"""Suffix arrays by induced sorting, over integer alphabets, with numpy.

The scans that induce order are sequential by nature: an entry may place another in its own or a later bucket.  They go
through here a range of buckets at a time.  The ranges are chosen so that nothing placed from within a range falls into the
same range (a bucket that feeds itself, from a run of one symbol, is a range alone and is looped), so one range is one
stable scatter and the scan stays linear.  Real text needs some thousand ranges a million symbols.
"""

from __future__ import annotations

import numpy as np

from lepidus.llm import _text


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type); the last symbol must be the one least."""
    n = len(t)
    d = np.sign(np.diff(t))
    at = np.where(d != 0, np.arange(n - 1), n - 1)
    after = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = np.append(d, 1)[after] > 0
    return s


def _ranges(low: np.ndarray, high: np.ndarray, sigma: int, down: bool) -> list[tuple[int, int, bool]]:
    """Ranges [a, b) of buckets, in the order of the scan, within which no pair low < high lies; (.., .., True) for a bucket that feeds itself."""
    own = np.zeros(sigma + 1, bool)
    own[low[low == high]] = True
    apart = low < high
    low, high = low[apart], high[apart]
    alone = np.flatnonzero(own)
    out = []
    if not down:
        first = np.full(sigma + 1, sigma)
        np.minimum.at(first, low, high)
        first[alone] = np.minimum(first[alone], alone + 1)
        if len(alone):
            k = alone[alone > 0] - 1
            first[k] = np.minimum(first[k], k + 1)
        stop = np.minimum.accumulate(first[::-1])[::-1].tolist()
        a = 0
        while a < sigma:
            b = stop[a]
            out.append((a, b, bool(own[a])))
            a = b
    else:
        last = np.full(sigma + 1, -1)
        np.maximum.at(last, high, low)
        last[alone] = np.maximum(last[alone], alone - 1)
        k = alone[alone < sigma - 1] + 1
        last[k] = np.maximum(last[k], k - 1)
        stop = (np.maximum.accumulate(last) + 1).tolist()
        b = sigma
        while b > 0:
            a = stop[b - 1]
            out.append((a, b, bool(own[b - 1])))
            b = a
    return out


def _grouped(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by c, the distinct values, their counts, and each one's rank within its value (in that order)."""
    order = np.argsort(c, kind="stable")
    c = c[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(start, len(c)))
    return order, c[start], size, np.arange(len(c)) - np.repeat(start, size)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int, up: list, down: list) -> np.ndarray:
    """The suffix array from LMS suffixes in order of their first symbol (and, if the result is to be final, sorted)."""
    n = len(t)
    n_l = np.bincount(t[~s], minlength=sigma)
    n_m = np.bincount(t[lms], minlength=sigma)
    size = np.bincount(t, minlength=sigma)
    # the left scan's queue holds, bucket by bucket, the L-type suffixes and then the LMS ones
    at = np.concatenate([[0], np.cumsum(n_l + n_m)])
    q = np.zeros(int(at[-1]), np.int64)
    q[np.arange(len(lms)) + np.cumsum(n_l)[t[lms]]] = lms
    head = at[:-1].copy()
    ell = ~s
    for a, b, own in up:
        if own:
            new = q[at[a] : head[a]]
            while len(new):
                new = new[new > 0] - 1
                new = new[ell[new] & (t[new] == a)]
                q[head[a] : head[a] + len(new)] = new
                head[a] += len(new)
        j = q[at[a] : at[b]]
        j = j[j > 0] - 1
        j = j[ell[j]]
        c = t[j]
        if own:
            j, c = j[c != a], c[c != a]
        if len(j):
            order, values, count, rank = _grouped(c)
            q[np.repeat(head[values], count) + rank] = j[order]
            head[values] += count
    # the right scan fills S-type suffixes from each bucket's end
    start = np.concatenate([[0], np.cumsum(size)])
    sa = np.full(n, -1, np.int64)
    where = np.arange(int(n_l.sum()))
    at_l = np.concatenate([[0], np.cumsum(n_l)])
    of = np.repeat(np.arange(sigma), n_l)
    sa[start[of] + where - at_l[of]] = q[at[of] + where - at_l[of]]
    tail = start[1:].copy()
    sa[0] = n - 1
    tail[t[n - 1]] -= 1
    for a, b, own in down:
        if own:
            c = b - 1
            new = sa[tail[c] : start[b]][::-1]  # S-type, the last placed first; an L-type one places none in its own bucket
            while len(new):
                new = new[new > 0] - 1
                new = new[s[new] & (t[new] == c)]
                sa[tail[c] - len(new) : tail[c]] = new[::-1]
                tail[c] -= len(new)
        j = sa[start[a] : start[b]][::-1]
        j = j[j > 0] - 1
        j = j[s[j]]
        c = t[j]
        if own:
            j, c = j[c != b - 1], c[c != b - 1]
        if len(j):
            order, values, count, rank = _grouped(c)
            sa[np.repeat(tail[values], count) - 1 - rank] = j[order]
            tail[values] -= count
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``t`` in order.  ``t`` ends with its least value, which occurs nowhere else; values are ranks 0..k without gaps that matter."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    sigma = int(t.max()) + 1
    s = types(t)
    pair = ~s[:-1]
    up = _ranges(t[1:][pair], t[:-1][pair], sigma, False)
    pair = s[:-1]
    down = _ranges(t[:-1][pair], t[1:][pair], sigma, True)
    lms = np.flatnonzero(s & np.concatenate([[False], ~s[:-1]]))
    sa = _induce(t, s, lms[np.argsort(t[lms], kind="stable")], sigma, up, down)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    order = number[sa]
    order = order[order >= 0]  # LMS substrings in order
    # equal substrings get equal names; each reaches to the next LMS position, that included
    end = np.append(lms[1:] + 1, n)
    total = np.zeros(n + 1, np.uint64)
    up_, down_ = _text._power(n + 1)
    np.cumsum(_text.mix(t.astype(np.uint64), 5) * up_[:n], out=total[1:])
    same = (total[end] - total[lms]) * down_[lms] + (end - lms).astype(np.uint64)
    size = end - lms
    differ = np.concatenate([[False], (same[order][1:] != same[order][:-1]) | (size[order][1:] != size[order][:-1])])
    name = np.empty(len(lms), np.int64)
    name[order] = np.cumsum(differ)
    if int(name.max()) + 1 < len(lms):
        order = suffix_array(name)
    return _induce(t, s, lms[order], sigma, up, down)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position of the text, how many symbols its suffix shares with the one before it in order.

    Only irreducible values (where the symbols before the two suffixes differ) are found by comparing; each other is its
    left neighbour's less 1.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    i = np.arange(n)
    hard = (phi < 1) | (i < 1) | (t[i - 1] != t[np.maximum(phi, 1) - 1])
    plcp = np.zeros(n, np.int64)
    a = np.flatnonzero(hard & (phi >= 0))
    b = phi[a]
    live = np.arange(len(a))
    got = np.zeros(len(a), np.int64)
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        got[live] += 1
    plcp[a] = got
    last = np.maximum.accumulate(np.where(hard, i, -1))
    return np.where(hard, plcp, plcp[last] - (i - last))
