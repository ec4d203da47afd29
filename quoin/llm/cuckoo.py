"""A cuckoo filter over 16-byte digests: four 16-bit fingerprints a bucket, insertion in bulk, deletion."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS, LOAD = 4, 500, 0.8


class Full(Exception):
    """The filter can't take another item; rebuild it from the exact table with more buckets."""


class CuckooFilter:
    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        self.table = np.zeros((buckets, SLOTS), dtype="<u2") if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def places(self, digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each digest."""
        words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        prints = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        first = (words[:, 0] >> np.uint64(8)).astype(np.int64) & (len(self.table) - 1)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        return bucket ^ ((prints * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def contains(self, digests) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, dtype=bool)
        prints, a, b = self.places(digests)
        return (self.table[a] == prints[:, None]).any(axis=1) | (self.table[b] == prints[:, None]).any(axis=1)

    def insert(self, digests) -> None:
        """Digests that are not in the filter's exact table yet, each once."""
        if not len(digests):
            return
        prints, a, b = self.places(digests)
        left = np.arange(len(prints))
        for buckets in (a, b):
            for slot in range(SLOTS):
                free = left[self.table[buckets[left], slot] == 0]
                _, one = np.unique(buckets[free], return_index=True)  # one item a bucket and turn
                take = free[one]
                self.table[buckets[take], slot] = prints[take]
                left = np.setdiff1d(left, take, assume_unique=True)
        for i in left:
            self._push(int(prints[i]), int(a[i]), int(b[i]))

    def _push(self, fingerprint: int, first: int, other: int) -> None:
        for bucket in (first, other):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return
        bucket, moved = other, []
        for kick in range(KICKS):
            slot = (kick * 7 + fingerprint) % SLOTS
            moved.append((bucket, slot))
            fingerprint, self.table[bucket, slot] = int(self.table[bucket, slot]), fingerprint
            bucket = int(self._other(bucket, fingerprint))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return
        for bucket, slot in reversed(moved):  # leave the filter as it was
            fingerprint, self.table[bucket, slot] = int(self.table[bucket, slot]), fingerprint
        raise Full

    def delete(self, digests) -> None:
        """Digests that were inserted; one fingerprint goes for each."""
        if not len(digests):
            return
        for fingerprint, *buckets in zip(*map(np.ndarray.tolist, self.places(digests))):
            for bucket in buckets:
                found = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("a digest that the filter does not hold")


def grown(keys, capacity: int | None = None) -> CuckooFilter:
    """A filter of all these digests, doubled until they fit."""
    capacity = max(len(keys), capacity or 0, 1)
    while True:
        made = CuckooFilter(capacity)
        try:
            made.insert(keys)
            return made
        except Full:
            capacity *= 2
