"""A cuckoo filter over numpy arrays: a chain of tables of 16-bit fingerprints, four to a bucket.

A key comes as (``fp``, ``base``): its fingerprint, never zero, and 32 bits that choose its bucket in a table of any size. The
second bucket follows from the first and the fingerprint, so entries can move without their keys. A filter holds a *set* of
entries: what it already contains is not inserted again. A table that has no place left is followed by one of twice the
size, so no entry is ever lost and a key that was inserted is always found. Removing a key also removes any other key that
shares its entry; whoever removes must insert those again (``line_dedup.py`` asks its exact table for them).
"""
from __future__ import annotations

import numpy as np

SLOTS, LEAST, MOVES, LOAD = 4, 16, 200, 0.9


def _partner(at: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
    return (at ^ (fp.astype(np.int64) * 0x5BD1E995 >> 7)) & (buckets - 1)


def _rank(sorted_at: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal values."""
    start = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    return np.arange(len(sorted_at)) - np.repeat(start, np.diff(np.r_[start, len(sorted_at)]))


def _settle(table: np.ndarray, fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put fingerprints into empty slots of their buckets; returns those whose bucket was full."""
    order = np.argsort(at, kind="stable")
    fp, at = fp[order], at[order]
    empty = table[at] == 0
    rank = _rank(at)
    fits = rank < empty.sum(axis=1)
    slot = np.argmax(np.cumsum(empty, axis=1) == (rank + 1)[:, None], axis=1)
    table[at[fits], slot[fits]] = fp[fits]
    return fp[~fits], at[~fits]


def _place(table: np.ndarray, fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Insert fingerprints, moving others to their second buckets; returns what has found no place after ``MOVES`` turns."""
    n = len(table)
    for turn in range(MOVES):
        for _ in range(2):
            if not len(fp):
                return fp, at
            fp, at = _settle(table, fp, at)
            at = _partner(at, fp, n)
        if not len(fp):
            break
        # Every full bucket gives one slot to the first that waits for it; the entry that was there waits next.
        order = np.argsort(at, kind="stable")
        fp, at = fp[order], at[order]
        first = _rank(at) == 0
        slot = (turn + at[first]) % SLOTS
        out = table[at[first], slot]
        table[at[first], slot] = fp[first]
        fp[first] = out
        at[first] = _partner(at[first], out, n)
        fp, at = fp[fp != 0], at[fp != 0]
    return fp, at


class Cuckoo:
    """``tables``: arrays of shape (buckets, 4), buckets a power of two, in the order in which they were added."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def read(cls, blobs: list[bytes]) -> Cuckoo:
        return cls([np.frombuffer(b, "<u2").reshape(-1, SLOTS).copy() for b in blobs])

    def blobs(self) -> list[bytes]:
        return [t.astype("<u2").tobytes() for t in self.tables]

    def contains(self, fp: np.ndarray, base: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fp), bool)
        for t in self.tables:
            at = base & (len(t) - 1)
            found |= (t[at] == fp[:, None]).any(axis=1) | (t[_partner(at, fp, len(t))] == fp[:, None]).any(axis=1)
        return found

    def insert(self, fp: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Insert keys; returns which of them met an entry that was there, or an equal key before them in the arrays."""
        _, first = np.unique(fp.astype(np.int64) << 32 | base, return_index=True)
        again = np.ones(len(fp), bool)
        again[first] = False
        again |= self.contains(fp, base)
        fp, base = fp[~again], base[~again]
        while len(fp):
            if self.tables:
                room = int(LOAD * self.tables[-1].size) - int(np.count_nonzero(self.tables[-1]))
                if room > 0:
                    self._fill(fp[:room], base[:room])
                    # An entry moved to and fro may differ from those given, so what is missing is asked for.
                    missing = ~self.contains(fp, base)
                    fp, base = fp[missing], base[missing]
                    if not len(fp):
                        break
            need = max(LEAST, int(len(fp) / (SLOTS * LOAD)) + 1, 2 * len(self.tables[-1]) if self.tables else 0)
            self.tables.append(np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16))
        return again

    def _fill(self, fp: np.ndarray, base: np.ndarray) -> None:
        t = self.tables[-1]
        left, at = _place(t, fp.copy(), base & (len(t) - 1))
        # Entries without a place, old ones among them, go to a table of their own with the same buckets: their keys' further
        # bits are unknown here, and a table of this size needs no more of them.
        while len(left):
            more = np.zeros_like(t)
            left, at = _place(more, left, at)
            self.tables.append(more)

    def remove(self, fp: np.ndarray, base: np.ndarray) -> None:
        """Clear every entry that answers for one of the keys."""
        for t in self.tables:
            at = base & (len(t) - 1)
            for b in (at, _partner(at, fp, len(t))):
                row, slot = np.nonzero(t[b] == fp[:, None])
                t[b[row], slot] = 0
