"""Pair merging of many pieces at once: one matrix row a piece, one merge a row and step.

Ranks of pairs stand in an open-addressing hash table; an id is its own rank, so the least id among a row's pairs is
merged next, and two pairs of the row are looked up again."""

from __future__ import annotations

import numpy as np

ABSENT = np.int32(1 << 30)
WIDTHS = (8, 12, 16, 24, 32)  # bytes of a row; longer pieces are merged one by one
ROWS = 32_768  # pieces of a matrix at most
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int], bits: int = 20):
        keys, values = [], []
        get = ranks.get
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a = get(token[:k])
                if a is not None and (b := get(token[k:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(i)
        while len(keys) * 3 > 1 << bits:
            bits += 1
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, ABSENT, np.int32)
        left, vals = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(left)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.values[at[first]] = left[first], vals[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, vals, at = left[stay], vals[stay], (at[stay] + 1) & self.mask
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pairs, ABSENT where there is none or an element is missing (negative)."""
        shape = a.shape
        a, b = a.ravel().astype(np.int64), b.ravel().astype(np.int64)
        keys = a << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], ABSENT)
        todo = np.flatnonzero((found != keys) & (found != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            todo, at = todo[more], at[more]
        out[(a < 0) | (b < 0)] = ABSENT
        return out.reshape(shape)


def _rows(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges all rows (ids, -1 behind the end) to the end."""
    m, width = symbols.shape
    out = np.full_like(symbols, -1)
    own = np.arange(m)
    sym = np.concatenate([symbols, np.full((m, 1), -1, np.int32)], axis=1)
    rank = np.concatenate([table(sym[:, :-1], sym[:, 1:]), np.full((m, 1), ABSENT, np.int32)], axis=1)
    cols = np.arange(width)
    while len(own):
        row = np.arange(len(own))
        j = rank.argmin(axis=1)
        best = rank[row, j]
        live = best < ABSENT
        if not live.all():
            out[own[~live]] = sym[~live, :width]
            own, sym, rank, j, best = own[live], sym[live], rank[live], j[live], best[live]
            row = np.arange(len(own))
            if not len(own):
                break
        sym[row, j] = best
        sym[:, :width] = np.take_along_axis(sym, cols + (cols > j[:, None]), axis=1)
        rank[:, :width] = np.take_along_axis(rank, cols + (cols >= j[:, None]), axis=1)
        rank[row, j] = table(sym[row, j], sym[row, j + 1])
        at = np.flatnonzero(j > 0)
        rank[at, j[at] - 1] = table(sym[at, j[at] - 1], sym[at, j[at]])
    return out


def merged(pieces: list[bytes], table: PairTable, alone) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other and the number of ids of each. ``alone`` merges a long piece."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = np.zeros(len(pieces), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for width in WIDTHS:
        which = np.flatnonzero((size > low) & (size <= width))
        low = width
        for k in range(0, len(which), ROWS):
            at = which[k : k + ROWS]
            raw = np.frombuffer(b"".join(pieces[i] for i in at.tolist()), np.uint8)
            filled = np.arange(width) < size[at][:, None]
            symbols = np.full(filled.shape, -1, np.int32)
            symbols[filled] = table.single[raw]
            done = _rows(symbols, table)
            counts[at] = (done >= 0).sum(axis=1)
            parts.append((at, done[done >= 0]))
    for i in np.flatnonzero(size > low).tolist():
        ids = np.array(alone(pieces[i]), np.int32)
        counts[i] = len(ids)
        parts.append((np.array([i]), ids))
    begin = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.uint32)
    for at, ids in parts:
        n = counts[at]
        flat[np.arange(len(ids)) + np.repeat(begin[at] - (np.cumsum(n) - n), n)] = ids
    return flat, counts
