"""A cuckoo filter over 64-bit keys whose operations work on whole numpy arrays.

Four 16-bit fingerprints a bucket, two buckets a key. A table takes keys until it is
full; then one of at least twice its size is added, so there are few tables whatever the
number of insertions, and only fingerprints need be kept. An insertion tells each key's
table (its level); whoever deletes a key gives the level back, since the same fingerprint
in another table is another key's.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.textkit import U, mix

SLOTS = 4
LOAD = 0.85


class CuckooFilter:
    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def load(cls, blobs: list[bytes]) -> CuckooFilter:
        return cls([np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy() for b in blobs])

    def dump(self) -> list[bytes]:
        return [t.tobytes() for t in self.tables]

    @staticmethod
    def _home(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys)
        fp = (h >> U(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (h & U(len(table) - 1)).astype(np.int64)

    @staticmethod
    def _other(table: np.ndarray, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fp.astype(U)) & U(len(table) - 1)).astype(np.int64)

    @staticmethod
    def _rank(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by bucket, and each one's place within its bucket in that order."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        first = np.flatnonzero(new)
        return order, np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))

    def _fill(self, table: np.ndarray, keys: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Put all keys' fingerprints into a table that has room; what finds none comes back."""
        fp, bucket = self._home(table, keys)
        tried = np.zeros(len(fp), np.int8)
        for _ in range(400):
            if not len(fp):
                break
            order, rank = self._rank(bucket)
            fp, bucket, tried = fp[order], bucket[order], tried[order]
            empty = table[bucket] == 0
            fits = rank < empty.sum(1)
            slot = np.argsort(~empty, axis=1, kind="stable")
            table[bucket[fits], slot[fits, rank[fits]]] = fp[fits]
            at = ~fits
            fp, bucket, tried, rank = fp[at], bucket[at], tried[at], rank[at]
            kick = tried > 0
            if kick.any():  # one a bucket puts out another fingerprint, which then looks for room
                _, first = np.unique(bucket[kick], return_index=True)
                who = np.flatnonzero(kick)[first]
                s = rng.integers(0, SLOTS, len(who))
                out = table[bucket[who], s].copy()
                table[bucket[who], s] = fp[who]
                fp[who] = out
            tried[:] = 1
            bucket = self._other(table, fp, bucket)
        return fp, bucket

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Add keys, of which none is in yet; returned is the level of each one's table."""
        level = np.zeros(len(keys), np.int32)
        left = np.arange(len(keys))
        rng = np.random.default_rng(len(keys))
        while len(left):
            last = len(self.tables) - 1
            room = int(self.tables[last].size * LOAD) - int(np.count_nonzero(self.tables[last])) if last >= 0 else 0
            if room <= 0:  # the next table has room for what is left, and for as much as all before it
                need = max(len(left) / LOAD, 2 * self.tables[last].size if last >= 0 else 0)
                self.tables.append(np.zeros((1 << max(4, int(np.ceil(np.log2(need / SLOTS + 1)))), SLOTS), np.uint16))
                continue
            now, left = left[:room], left[room:]
            trial = self.tables[last].copy()
            if len(self._fill(trial, keys[now], rng)[0]):  # keys that are too many alike: a table of their own
                need = max(2 * len(now) / LOAD, 2 * trial.size)
                trial = np.zeros((1 << int(np.ceil(np.log2(need / SLOTS + 1))), SLOTS), np.uint16)
                while len(self._fill(trial, keys[now], rng)[0]):
                    trial = np.zeros((2 * len(trial), SLOTS), np.uint16)
                self.tables.append(trial)
            else:
                self.tables[last] = trial
            level[now] = len(self.tables) - 1
        return level

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that is in, and for a few that aren't."""
        found = np.zeros(len(keys), bool)
        for table in self.tables:
            fp, a = self._home(table, keys)
            b = self._other(table, fp, a)
            found |= ((table[a] == fp[:, None]) | (table[b] == fp[:, None])).any(1)
        return found

    def delete(self, keys: np.ndarray, level: np.ndarray) -> None:
        """Remove one fingerprint of each key from the table that got it; the keys must be in."""
        for k in np.unique(level):
            table, own = self.tables[k], keys[level == k]
            fp, a = self._home(table, own)
            left = np.ones(len(own), bool)
            for bucket in (a, self._other(table, fp, a)):
                while True:
                    hit = left & (table[bucket] == fp[:, None]).any(1)
                    if not hit.any():
                        break
                    _, first = np.unique(bucket[hit], return_index=True)
                    who = np.flatnonzero(hit)[first]
                    slot = (table[bucket[who]] == fp[who, None]).argmax(1)
                    table[bucket[who], slot] = 0
                    left[who] = False
            if left.any():
                raise ValueError(f"{int(left.sum())} keys to delete are not in the filter")
