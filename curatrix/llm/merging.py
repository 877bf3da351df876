"""Byte-pair merges of many pre-tokens at once: those of one size run side by side."""

from __future__ import annotations

import heapq

import numpy as np


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerger:
    """The merge rules of a byte-level vocabulary: always the pair of lowest rank first, leftmost among equals."""

    LONGEST = 64

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.size, self.none = max(vocab.values()) + 1, len(pairs)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], dtype=np.int32)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int32)
        self.final = np.array([vocab[x + suffix] for x in letters], dtype=np.int32)
        self._table(left * self.size + right)

    def _table(self, keys: np.ndarray) -> None:
        """An open hash table of the pairs with room for four times as many."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, self.none, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            where, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[where], self.rank[where] = keys[todo[placed]], todo[placed]
            rest = np.ones(len(todo), dtype=bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; `none` where the vocabulary has no such merge."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.rank[slot], self.none).astype(np.int32)
        open_ = np.flatnonzero((seen != keys).ravel() & (seen != -1).ravel())
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            flat[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return flat.reshape(out.shape)

    def merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each) for the words raw[start : start + size]."""
        counts = np.zeros(len(starts), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if 0 < size <= self.LONGEST:
                for k in range(0, len(rows), 65536):
                    part = rows[k : k + 65536]
                    self._side_by_side(raw[starts[part][:, None] + np.arange(size)], part, done)
            elif size:
                for row in rows.tolist():
                    done.append((np.array([row]), np.array([self._long(raw[starts[row] : starts[row] + size])], dtype=np.int32)))
        for rows, ids in done:
            counts[rows] = ids.shape[1]
        out, at = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        for rows, ids in done:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts

    def _side_by_side(self, letters: np.ndarray, rows: np.ndarray, done: list) -> None:
        """Words of one size. Each step merges one pair in every word still open, so all have the same number of symbols."""
        ids = self.inner[letters]
        ids[:, -1] = self.final[letters[:, -1]]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ranks)), at]
            ends = least == self.none
            if ends.any():
                done.append((rows[ends], ids[ends]))
                rows, ids, ranks, at, least = (x[~ends] for x in (rows, ids, ranks, at, least))
                if not len(rows):
                    return
            n, every = ids.shape[1], np.arange(len(rows))
            ids[every, at] = self.merged[least]
            keep = np.ones(ids.shape, dtype=bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(rows), n - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(len(rows), n - 2)
            for step in (0, 1):  # the new symbol's pairs: with the one before it, with the one after it
                touched = np.flatnonzero((at > 0) if step == 0 else (at < n - 2))
                where = at[touched] - 1 + step
                ranks[touched, where] = self.ranks(ids[touched, where], ids[touched, where + 1])
        done.append((rows, ids))

    def _long(self, letters: np.ndarray) -> list[int]:
        """One word off a heap, so that a very long one takes n log n steps."""
        symbols = self.inner[letters].tolist()
        symbols[-1] = int(self.final[letters[-1]])
        n = len(symbols)
        pair = self.ranks(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(pair) if r < self.none]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    r = int(self.ranks(np.array([symbols[a]]), np.array([symbols[b]]))[0])
                    if r < self.none:
                        heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]
