"""Edit distances of many pairs at once, and the search of a block of sequences for those that are near others."""

from __future__ import annotations

import numpy as np

from .kmers import _before, _packed, _within

#: Bases of the parts that are searched for with one edit; places of a block that a part may be found at before it tells nothing.
PART, FREQUENT = 12, 1 << 13
#: Parts that are looked up at once, and pairs that are compared at once.
PARTS_AT_ONCE, PAIRS_AT_ONCE = 1 << 12, 1 << 13
#: Columns of a table after which pairs that can't be near any more are left out.
CHECKED = frozenset((32, 44))

_CAPITALS = np.full(256, 4, np.uint8)
_CAPITALS[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_ALL = np.uint64((1 << 64) - 1)
_PLACE = 40


class Planes:
    """Sequences by planes of bits: bit i of `low` and `high` is that of the base at place i.  plain: those of at most 64 bases, all of them A, C, G or T; others have no planes."""

    def __init__(self, seqs: list[str], gap: str = ""):
        """gap: a letter that follows each sequence in `codes`, where all letters beyond Latin-1 are one."""
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.codes = _CAPITALS[np.frombuffer((gap.join(seqs) + gap).encode("latin-1", "replace"), np.uint8)]
        self.at = _before(self.size + len(gap))
        place, some = _within(self.size + len(gap)), np.flatnonzero(self.size + len(gap))
        odd = np.zeros(len(seqs), bool)
        self.low, self.high = np.zeros(len(seqs), np.uint64), np.zeros(len(seqs), np.uint64)
        if len(some):
            inside = place < np.repeat(self.size, self.size + len(gap))
            odd[some] = np.logical_or.reduceat((self.codes == 4) & inside, self.at[some])
            for plane, bit in ((self.low, 0), (self.high, 1)):
                bits = (self.codes >> bit & inside).astype(np.uint64) << np.minimum(place, 63).astype(np.uint64)
                plane[some] = np.bitwise_or.reduceat(bits, self.at[some])
        self.plain = ~odd & (self.size <= 64)

    def windows(self, k: int) -> np.ndarray:
        """Every window of k letters, packed as it stands; letters that are no bases are as A."""
        return _packed(np.where(self.codes == 4, 0, self.codes).astype(np.uint32), k)[0]


def distances(a: Planes, b: Planes, i: np.ndarray, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """The edit distance of a's sequence i and b's sequence j of each pair, both plain; or something above `most` where it is above.  A column of differences is two words of bits."""
    out = np.zeros(len(i), np.int64)
    longest = b.size[j]
    for m in np.unique(longest):
        own = np.flatnonzero(longest == m)
        for low in range(0, len(own), PAIRS_AT_ONCE):
            p = own[low : low + PAIRS_AT_ONCE]
            out[p] = _compared(a.low[i[p]], a.high[i[p]], a.size[i[p]], b.low[j[p]], b.high[j[p]], int(m), None if most is None else most[p])
    return out


def _compared(a0: np.ndarray, a1: np.ndarray, n: np.ndarray, b0: np.ndarray, b1: np.ndarray, m: int, most: np.ndarray | None) -> np.ndarray:
    out, p = np.full(len(n), 1 << 30, np.int64), np.arange(len(n))
    one = np.uint64(1)
    more, less = np.full(len(n), _ALL), np.zeros(len(n), np.uint64)

    def at(row: np.ndarray, column: int) -> np.ndarray:
        rows = np.where(row > 0, _ALL >> (64 - np.maximum(row, 1)).astype(np.uint64), np.uint64(0))
        return column + np.bitwise_count(more & rows).astype(np.int64) - np.bitwise_count(less & rows)

    for column in range(m):
        t = (b0 >> np.uint64(column)) & one
        np.subtract(np.uint64(0), t, out=t)
        t ^= a0
        u = (b1 >> np.uint64(column)) & one
        np.subtract(np.uint64(0), u, out=u)
        u ^= a1
        t |= u
        np.invert(t, out=t)
        t |= less  # where bases are equal, or the column before falls
        d = t & more
        d += more
        d ^= more
        d |= t
        np.bitwise_or(more, d, out=u)
        np.invert(u, out=u)
        u |= less
        u <<= one
        u |= one
        more &= d
        more <<= one
        np.bitwise_and(u, d, out=less)
        u |= d
        np.invert(u, out=u)
        more |= u
        if most is not None and column + 1 in CHECKED and column + 1 < m:
            # the rest of the way costs the difference of what is left of both at least
            row = np.minimum(n, column + 1)
            keep = np.flatnonzero(at(row, column + 1) <= most + np.abs((n - row) - (m - column - 1)))
            p, a0, a1, n, b0, b1, more, less, most = (x[keep] for x in (p, a0, a1, n, b0, b1, more, less, most))
            if not len(p):
                return out
    out[p] = at(n, m)
    return out


def _different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.flatnonzero(np.append(True, x[1:] != x[:-1]))] if len(x) else x


class Near:
    """A block of sequences, searched for those near others.

    A sequence is cut into parts of `PART` bases.  If another one is so near that it has fewer than two edits a part, one of the parts is in it with one edit at most.  The block's windows
    are sorted, and looked up are all that are one edit from a part; where a window may lie follows from the edits that its distance from the part's place costs."""

    def __init__(self, seqs: list[str]):
        self.seqs, self.own = seqs, Planes(seqs, "A")
        size, at = self.own.size, self.own.at
        self.owner = np.repeat(np.arange(len(seqs), dtype=np.int32), size + 1)
        self.first, self.where = None, np.zeros(0, np.int64)
        if len(self.own.codes) < PART:
            return
        windows = self.own.windows(PART)
        # a window may hold the letter behind its sequence, for a part that has one base more than what it is found in
        start = np.flatnonzero(_within(size + 1)[: len(windows)] <= (size - (PART - 1))[self.owner[: len(windows)]])
        keys = np.sort(windows[start].astype(np.uint64) << np.uint64(_PLACE) | start.astype(np.uint64))
        self.where = (keys & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        self.first = np.zeros(4**PART + 1, np.int32)
        np.cumsum(np.bincount((keys >> np.uint64(_PLACE)).astype(np.int32), minlength=4**PART), out=self.first[1:], dtype=np.int32)

    def _ranges(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part, where the windows one edit from it at most begin, and how many there are of each."""
        parts = parts.astype(np.int64)[:, None]
        j = np.arange(PART)
        left, x = 2 * (PART - j), np.arange(1, 4)
        changed = (parts[:, :, None] ^ x << 2 * j[:, None]).reshape(len(parts), -1)
        head, tail = parts >> left << left, parts & (1 << left) - 1
        base = tail >> left - 2
        # an inserted base that is the one behind it is as one inserted behind that; behind the last there is nothing to tell
        inserted = ((head | tail >> 2)[:, :-1, None] | (base[:, :-1, None] ^ x) << (left[:-1] - 2)[:, None]).reshape(len(parts), -1)
        lost = head | (tail & (1 << left - 2) - 1) << 2
        low = np.concatenate([parts, changed, inserted, lost], axis=1)
        high = low + 1
        high[:, -PART:] += 3
        begin = self.first[low]
        return begin, self.first[high] - begin

    def search(self, others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(other, own, distance) of pairs, and for each other one a number: all pairs with fewer edits are among them."""
        theirs = Planes(others)
        told = np.zeros(len(others), np.int64)
        none = np.zeros(0, np.int64)
        if self.first is None or len(theirs.codes) < PART:
            return none, none, none, told
        n_parts = theirs.size // PART
        r = np.repeat(np.arange(len(others)), n_parts)
        place = PART * _within(n_parts)
        start = theirs.at[r] + place
        known = np.append(0, np.cumsum(theirs.codes == 4))
        keep = known[start + PART] == known[start]
        r, place, parts = r[keep], place[keep], theirs.windows(PART)[start[keep]]
        begin, n = np.zeros((len(r), 1 + 7 * PART - 3), np.int32), np.zeros((len(r), 1 + 7 * PART - 3), np.int32)
        for low in range(0, len(r), PARTS_AT_ONCE):
            begin[low : low + PARTS_AT_ONCE], n[low : low + PARTS_AT_ONCE] = self._ranges(parts[low : low + PARTS_AT_ONCE])
        keep = n.sum(axis=1) <= FREQUENT
        r, place, begin, n = r[keep], place[keep], begin[keep], n[keep]
        told += 2 * np.bincount(r, minlength=len(others))
        pairs = [none]
        ends, low = np.cumsum(n.sum(axis=1), dtype=np.int64), 0
        while low < len(r):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (PARTS_AT_ONCE << 8), side="right")))
            size = n[low:high].ravel().astype(np.int64)
            g = self.where[np.repeat(begin[low:high].ravel(), size) + _within(size)]
            part = np.repeat(np.arange(low, high), n[low:high].sum(axis=1))
            other, own = r[part], self.owner[g].astype(np.int64)
            shift, apart = g - self.own.at[own] - place[part], self.own.size[own] - theirs.size[other]
            fits = np.abs(shift) + np.abs(apart - shift) < told[other]
            pairs.append(_different(other[fits] * len(self.seqs) + own[fits]))
            low = high
        other, own = np.divmod(_different(np.concatenate(pairs)), max(len(self.seqs), 1))
        plain = theirs.plain[other] & self.own.plain[own]
        found = distances(self.own, theirs, own[plain], other[plain], told[other[plain]] - 1)
        near = found < told[other[plain]]
        odd = np.flatnonzero(~plain)
        return np.append(other[plain][near], other[odd]), np.append(own[plain][near], own[odd]), np.append(found[near], np.full(len(odd), -1)), told
