"""A cuckoo filter in numpy whose operations take whole arrays. It counts copies, so that it can forget them one at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS, LOAD, MOST_KICKS = 4, 0.8, 400


class Full(RuntimeError):
    """No room was found; the exact table behind the filter builds a larger one."""


def ranks_of(x: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, in the order given."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty(len(s), np.int64)
    out[order] = rank
    return out


class Cuckoo:
    """Buckets of four 16-bit fingerprints, filled ones first. A hash's bucket comes from its low bits, its fingerprint from its high
    ones, and its other bucket from both, so that a fingerprint can be moved without its hash."""

    def __init__(self, entries: int, table: np.ndarray | None = None):
        if table is None:
            m = 4
            while m * SLOTS * LOAD < entries:
                m *= 2
            table = np.zeros((m, SLOTS), np.uint16)
        self.table, self.m = table, len(table)
        self.fill = np.count_nonzero(table, axis=1)

    @staticmethod
    def of_bytes(data: bytes) -> Cuckoo:
        return Cuckoo(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def room(self, more: int) -> bool:
        return int(self.fill.sum()) + more <= LOAD * SLOTS * self.m

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (h & np.uint64(self.m - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, i: np.ndarray) -> np.ndarray:
        return i ^ (mix64(fp.astype(np.uint64)) & np.uint64(self.m - 1)).astype(np.int64)

    def copies(self, h: np.ndarray) -> np.ndarray:
        """How many copies of each hash the filter may hold: never fewer than it does hold."""
        fp, i = self._places(h)
        j = self._other(fp, i)
        n = (self.table[i] == fp[:, None]).sum(axis=1)
        return n + np.where(i != j, (self.table[j] == fp[:, None]).sum(axis=1), 0)

    def _put(self, fp: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot in its bucket; says which did."""
        slot = self.fill[i] + ranks_of(i)
        ok = slot < SLOTS
        self.table[i[ok], slot[ok]] = fp[ok]
        np.add.at(self.fill, i[ok], 1)
        return ok

    def insert(self, h: np.ndarray) -> None:
        """A copy of each hash; a hash given twice is held twice. Raises Full, and then holds part of them."""
        fp, i = self._places(h)
        ok = self._put(fp, i)
        fp, i = fp[~ok], self._other(fp[~ok], i[~ok])
        for kick in range(MOST_KICKS):
            ok = self._put(fp, i)
            fp, i = fp[~ok], i[~ok]
            if not len(fp):
                return
            one = ranks_of(i) == 0  # of each full bucket one fingerprint makes way, and goes to its other bucket
            slot = (i[one] + kick) % SLOTS
            fp[one], self.table[i[one], slot] = self.table[i[one], slot], fp[one]
            i[one] = self._other(fp[one], i[one])
        raise Full

    def delete(self, h: np.ndarray) -> None:
        """Forgets a copy of each hash; only hashes that are held may be given."""
        fp, i = self._places(h)
        j = self._other(fp, i)
        todo = np.arange(len(h))
        while len(todo):
            in_first = (self.table[i[todo]] == fp[todo, None]).any(axis=1)
            b = np.where(in_first, i[todo], j[todo])
            now = ranks_of(b) == 0  # one a bucket at a time, since slots move up
            k, bucket = todo[now], b[now]
            hit = self.table[bucket] == fp[k, None]
            if not hit.any(axis=1).all():
                raise KeyError("the filter does not hold a hash that is to go")
            slot, last = hit.argmax(axis=1), self.fill[bucket] - 1
            self.table[bucket, slot] = self.table[bucket, last]
            self.table[bucket, last] = 0
            self.fill[bucket] = last
            todo = todo[~now]
