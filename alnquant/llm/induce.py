"""Induced suffix sorting in memory with common-prefix values; only queue entries beyond a budget wait on disk.

Suffixes are typed S or L, the leftmost S of each run (LMS) seed the order, L suffixes are induced from left to right and
S suffixes from right to left.  The priority queue of an induction is a queue for each first character, served in order of
the characters; an entry is a tuple (position, prefix shared with the entry before it), and a step handles all entries
that are ready together.  A queue beyond its memory budget writes its oldest runs to a file.  The order of the seeds comes
from sorting their substrings by the same induction and, where their names repeat, by recursion on the names.  A level
with more than NAMES names, which would need as many queues, is ordered by doubling instead.
"""

from __future__ import annotations

import tempfile

import numpy as np

NAMES = 512


class Queues:
    """First-in first-out runs of (position, prefix) for each character; runs beyond ``budget`` bytes wait on disk."""

    def __init__(self, budget: int):
        self.budget, self.held, self.runs, self.file = budget, 0, {}, None

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.runs.setdefault(char, []).append((at, len(pos)))
            return
        self.held += size
        self.runs.setdefault(char, []).append((pos, lcp))

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits for the character just now."""
        runs = self.runs.pop(char, None)
        if not runs:
            return None
        out = []
        for a, b in runs:
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(12 * b)
                a, b = np.frombuffer(raw, np.int64, b), np.frombuffer(raw, np.int32, b, 8 * b)
            else:
                self.held -= a.nbytes + b.nbytes
            out.append((a, b))
        return out[0] if len(out) == 1 else (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))


def _types(t: np.ndarray) -> np.ndarray:
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        change = np.flatnonzero(t[:-1] != t[1:])
        rising = t[change] < t[change + 1]
        s[:-1] = rising[np.searchsorted(change, np.arange(n - 1))]
    return s


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to cap, by comparison."""
    out = np.zeros(len(a), np.int32)
    act, n = np.arange(len(a)), len(t)
    for d in range(cap):
        x, y = a[act] + d, b[act] + d
        ok = (x < n) & (y < n)
        act, x, y = act[ok], x[ok], y[ok]
        act = act[t[x] == t[y]]
        if not len(act):
            break
        out[act] += 1
    return out


class _Running:
    """For each character the least prefix since its last entry, over the entries served so far."""

    def __init__(self, sigma: int, cap: int):
        self.low, self.cap = np.full(sigma, -1, np.int32), cap  # -1: no entry yet, so none shares anything

    def serve(self, lcp: np.ndarray, at: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Prefix of each new entry with the one before it in its queue; ``at``: its source, sorted by (char, at)."""
        m = len(lcp)
        table, span = [lcp], 1
        while span * 2 <= m:
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
            span *= 2
        first = np.ones(len(at), bool)
        first[1:] = char[1:] != char[:-1]
        lo = np.zeros(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[first] = 0
        out = self._least(table, lo, at + 1)
        out[first] = np.minimum(out[first], self.low[char[first]])
        last = np.ones(len(at), bool)
        last[:-1] = first[1:]
        rest = np.minimum(self.low, table[-1][[0, -1]].min()) if m else self.low
        tail = at[last] + 1
        inner = tail < m
        left = np.full(len(tail), self.cap, np.int32)
        left[inner] = self._least(table, tail[inner], np.full(int(inner.sum()), m))
        rest[char[last]] = left
        self.low = rest
        return np.minimum(out + 1, self.cap)

    def _least(self, table, lo, hi):
        out = np.zeros(len(lo), np.int32)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            w = level == k
            out[w] = np.minimum(table[k][lo[w]], table[k][hi[w] - (1 << int(k))])
        return out

    def skip(self, lcp: np.ndarray) -> None:
        if len(lcp):
            self.low = np.minimum(self.low, lcp.min())


def _induce(t, s, seeds, sigma, cap, budget):
    """Order and prefix values of all suffixes from the ordered ``seeds``; with cap 0, the order alone."""
    n = len(t)
    seed_char = t[seeds]
    cut = np.searchsorted(seed_char, np.arange(sigma + 1))
    seed_lcp = np.zeros(len(seeds), np.int32)
    if cap and len(seeds) > 1:
        seed_lcp[1:] = _shared(t, seeds[:-1], seeds[1:], cap)

    def spread(pos, lcp, q, run, wanted):
        """Queue the suffixes one to the left of ``pos`` that are of the wanted type."""
        src = np.flatnonzero(pos > 0)
        src = src[s[pos[src] - 1] == wanted]
        new = pos[src] - 1
        char = t[new]
        o = np.argsort(char, kind="stable")
        src, new, char = src[o], new[o], char[o]
        if not len(new):
            run.skip(lcp)
            return
        got = run.serve(lcp, src, char) if cap else np.zeros(len(new), np.int32)
        at = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(new)]):
            q.push(int(char[i]), new[i:j], got[i:j])

    q, run, left = Queues(budget), _Running(sigma, cap), {}
    for c in range(sigma):
        own, before = [], None
        while (got := q.pop(c)) is not None:
            own.append(got)
            before = got[0][-1]
            spread(*got, q, run, False)
        if own:
            left[c] = np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own])
        if cut[c] < cut[c + 1]:
            pos, lcp = seeds[cut[c] : cut[c + 1]], seed_lcp[cut[c] : cut[c + 1]].copy()
            if cap and before is not None:
                lcp[0] = _shared(t, np.array([before]), pos[:1], cap)[0]
            elif cap:
                lcp[0] = 0
            spread(pos, lcp, q, run, False)
    # from right to left; an entry's prefix is now the one that it shares with the entry to its right
    q, run, right = Queues(budget), _Running(sigma, cap), {}
    q.push(0, np.array([n - 1], np.int64), np.zeros(1, np.int32))
    for c in range(sigma - 1, -1, -1):
        own, after = [], None
        while (got := q.pop(c)) is not None:
            own.append(got)
            after = got[0][-1]
            spread(*got, q, run, True)
        if own:
            right[c] = np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own])
        if c in left:
            pos, lcp = left[c]
            back = np.empty_like(lcp)
            back[1:] = lcp[1:][::-1]
            back[0] = _shared(t, pos[-1:], np.array([after]), cap)[0] if cap and after is not None else 0
            spread(pos[::-1], back, q, run, True)
    sa, out = [], []
    for c in range(sigma):
        if c in left:
            pos, lcp = left[c]
            sa.append(pos)
            lcp = lcp.copy()
            lcp[0] = 0
            out.append(lcp)
        if c in right:
            pos, lcp = right[c]
            lcp = np.concatenate([[0], lcp[1:][::-1]]).astype(np.int32)
            if c in left and cap:
                lcp[0] = _shared(t, left[c][0][-1:], pos[-1:], cap)[0]
            sa.append(pos[::-1])
            out.append(lcp)
    return np.concatenate(sa), np.concatenate(out)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling the compared length of those that are still tied."""
    n = len(names)
    start = np.concatenate([[0], np.cumsum(np.bincount(names))])
    rank, w = start[names], 1  # of each suffix the number of lesser ones, ties apart
    act = np.arange(n)
    while w < n:
        size = np.bincount(rank[act], minlength=n)
        act = act[size[rank[act]] > 1]
        if not len(act):
            break
        nxt = np.full(len(act), -1, np.int64)
        inside = act + w < n
        nxt[inside] = rank[act[inside] + w]
        o = np.argsort(rank[act] * np.int64(n + 1) + nxt + 1, kind="stable")
        act, nxt = act[o], nxt[o]
        own = rank[act]
        group = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        place = np.arange(len(act))
        in_group = place - np.repeat(group, np.diff(np.append(group, len(act))))
        part = np.flatnonzero(fresh)
        rank[act] = own + np.repeat(in_group[part], np.diff(np.append(part, len(act))))
        w *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, cap: int = 0, budget: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``t`` (whose last value is its only 0) and the prefix that each shares with the one before
    it, counted up to ``cap``."""
    n, t = len(t), t.astype(np.int64)
    sigma = int(t.max()) + 1 if n else 1
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1], np.int64)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    if len(lms) > 1:
        order, _ = _induce(t, s, seeds, sigma, 0, budget)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        end = np.append(lms[1:], n - 1)  # an LMS substring ends with the next LMS position
        size = np.zeros(n, np.int64)
        size[lms] = end - lms + 1
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        act = np.flatnonzero(same)
        d = 0
        while len(act):
            act = act[size[a[act]] > d]
            differ = t[a[act] + d] != t[b[act] + d]
            same[act[differ]] = False
            act = act[~differ]
            d += 1
        name = np.concatenate([[0], np.cumsum(~same)])
        if name[-1] + 1 == len(lms):
            seeds = order
        else:
            by_place = np.zeros(n, np.int64)
            by_place[order] = name
            names, k = by_place[lms], int(name[-1]) + 1
            if k <= NAMES:
                sub, _ = suffix_array(np.append(names + 1, 0), 0, budget)
                seeds = lms[sub[1:]]
            else:
                seeds = lms[_doubled(names)]
    return _induce(t, s, seeds, sigma, cap, budget)
