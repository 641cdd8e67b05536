"""Vectorised word and window fingerprints, and their exact counts over a whole corpus.

Documents are dealt to chunks by hash. Each chunk sends its sorted distinct fingerprints, split by value into ranges, to
one counter per range; the counter answers every chunk with one small code per fingerprint, in the same order. So counts
over all documents come back without a row per word and without any key that could be hot: within a chunk a
fingerprint is sent once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, released, small_batches, tasks_for

BLOCK = 1 << 20  # bytes of text hashed at once, a longer text alone
_rng = np.random.default_rng(20240607)
#: Two families of fingerprints that have nothing in common: the second checks what the first finds equal.
_BYTE = [_rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) for _ in range(2)]
_BASE = [np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xA0761D6478BD642F | 1)]
_WORD_BASE = [np.uint64(0xC2B2AE3D27D4EB4F | 1), np.uint64(0xE7037ED1A0B428DB | 1)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, kept and extended."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, np.uint64(_inverse(base))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK + (1 << 16))
            for name, b in (("up", self.base), ("down", self.back)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = [_Powers(b) for b in _BASE], [_Powers(b) for b in _WORD_BASE]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes], lower: bool, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, one after the other, and the number of words of each text."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    if lower:
        raw = LOWER[raw]
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    begin, end = edge[::2], edge[1::2]
    up, down = _byte_powers[family](len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[family][raw] * up, out=sums[1:])
    words = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words, np.diff(np.searchsorted(begin, ends), prepend=0)


def window_hashes(words: np.ndarray, counts: np.ndarray, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of n words that lie within one text, and the number of windows of each text."""
    sizes = np.maximum(counts - n + 1, 0)
    if not sizes.any():
        return np.zeros(0, np.uint64), sizes
    up, down = _word_powers[family](len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    at = np.arange(int(sizes.sum())) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(sizes) - sizes), sizes)
    return mixed((sums[at + n] - sums[at]) * down[at]), sizes


def blocks(texts: list[bytes]):
    """Slices of texts of about BLOCK bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def chunk_count(docs: DataFrame, least_bytes: int = 6 << 20, factor: float = 1.7) -> int:
    """Chunks of at least ``least_bytes`` of text, growing with the square root of the input, so that the number of
    messages between chunks and counters grows in proportion to the input."""
    return tasks_for(docs, max(least_bytes, isqrt(4096 * input_bytes(docs))), factor)


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id and text with a chunk number."""
    small_batches(docs.sparkSession)
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance: the upper ones are mostly zero and compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


SENT = "range int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, range int, codes binary"


def sender(fingerprints: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], ranges: int, bits: int):
    """For one chunk: its distinct fingerprints (upper ``bits``) and their counts, by range of values."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        keys, counts = fingerprints([(t or "").encode() for t in group.column("text").to_pylist()])
        out = []
        at = np.searchsorted(keys, cuts(ranges, bits))
        for r, (a, b) in enumerate(zip(at, [*at[1:], len(keys)])):
            if b > a:
                out.append((r, chunk, planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(np.minimum(counts[a:b], 65535).astype(np.uint16))))
        cols = list(zip(*out)) or [[]] * 4
        del keys, counts
        released()
        return pa.table({"range": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})

    return run


def cuts(ranges: int, bits: int) -> np.ndarray:
    return np.array([(r << bits) // ranges for r in range(ranges)], np.uint64)


def counter(code: Callable[[np.ndarray], np.ndarray]):
    """For one range of values: counts over all chunks, answered as one byte for each fingerprint sent."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(b, np.uint64)) for b in group.column("keys").to_pylist()]
        counts = [from_planes(b, np.uint16).astype(np.int64) for b in group.column("counts").to_pylist()]
        sizes = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        total = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        codes = np.empty(len(every), np.uint8)
        codes[order] = code(total)[np.cumsum(new) - 1]
        parts = np.split(codes, sizes[:-1])
        del keys, counts, every, order, ranked, total
        released()
        return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "codes": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def counted(placed: DataFrame, fingerprints, code, ranges: int, bits: int) -> DataFrame:
    """(chunk, range, codes) for every chunk of ``placed``."""
    sent = placed.groupBy("chunk").applyInArrow(sender(fingerprints, ranges, bits), SENT)
    return sent.groupBy("range").applyInArrow(counter(code), ANSWER)


def codes_of(answer: pa.Table) -> np.ndarray:
    """The codes of one chunk's sorted distinct fingerprints."""
    got = sorted(zip(answer.column("range").to_pylist(), answer.column("codes").to_pylist()))
    return np.frombuffer(b"".join(c for _, c in got), np.uint8)
