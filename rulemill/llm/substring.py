"""Substring deduplication by relative Lempel-Ziv parsing.

The windows of ``window`` consecutive words of all documents are the reference blocks. First all of them are counted by a
short fingerprint (see ``fingerprints``), which rules out most: a block that occurs once is nobody's source. The others
are indexed with their places, by that fingerprint and by a second one that shares nothing with it; the index answers
each with another place where the same block starts. Parsing a document is greedy: at a word whose block has a source
the factor is extended as long as the next block continues it there; where the source breaks off a new factor begins,
and at words without a source a literal is taken. A factor is at least ``window`` words long, its boundary blocks (and all
between them) are checked by both fingerprints, and it names its source; its words are removed.

The first fingerprint has enough bits for few blocks to look repeated by chance; equality rests on both, 64 bits and more
each. Nulls: a null text has no words; a null doc_id is place -1. Ties between sources go to the least doc_id and position.
Repeated rows repeat each other's blocks. Very long texts are hashed in one piece. An empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, released, stored
from .fingerprints import blocks, chunk_count, codes_of, counted, cuts, dealt, from_planes, planes, window_hashes, word_hashes

WINDOW = 35
BITS = 40  # of the first fingerprint as it is counted, at least
SPARE = 6  # bits more than the number of words needs


def counting_bits(docs: DataFrame) -> int:
    """So many bits that of blocks that occur once fewer than 1 in 2**SPARE look repeated, at any size of the input."""
    return min(63, max(BITS, (input_bytes(docs) // 4).bit_length() + SPARE))


def _windows(texts: list[bytes], window: int, check: bool):
    """Per block of texts: word counts, window fingerprints of the first family (and of the second) and window counts."""
    for part in blocks(texts):
        words, counts = word_hashes(part, lower=False)
        hashes, sizes = window_hashes(words, counts, window)
        second = window_hashes(word_hashes(part, lower=False, family=1)[0], counts, window, family=1)[0] if check else None
        yield counts, hashes, second, sizes


def _distinct(window: int, bits: int):
    def run(texts):
        got = [h >> np.uint64(64 - bits) for _, h, _, _ in _windows(texts, window, False)]
        return np.unique(np.concatenate(got or [np.zeros(0, np.uint64)]), return_counts=True)

    return run


def repeated(counts: np.ndarray) -> np.ndarray:
    return (counts > 1).astype(np.uint8)


class Chunk:
    """A chunk's documents in a fixed order, and its windows that the counts don't rule out."""

    def __init__(self, group: pa.Table, codes: pa.Table, window: int, bits: int):
        self.table = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = [(t or "").encode() for t in self.table.column("text").to_pylist()]
        got = list(_windows(texts, window, True))
        join = lambda i, kind: np.concatenate([x[i] for x in got] or [np.zeros(0, kind)])
        self.texts, self.n_words, sizes, first, second = texts, join(0, np.int64), join(3, np.int64), join(1, np.uint64), join(2, np.uint64)
        _, place = np.unique(first >> np.uint64(64 - bits), return_inverse=True)
        at = np.flatnonzero(codes_of(codes)[place]) if len(first) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        self.row = np.searchsorted(ends, at, "right")
        self.pos = at - (ends - sizes)[self.row] if len(at) else at
        ids = np.array([-1 if d is None else d for d in self.table.column("doc_id").to_pylist()], np.int64)
        self.doc = ids[self.row] if len(at) else at
        self.first, self.second = first[at], second[at]
        # distinct blocks, in order of both fingerprints; of equal ones the earliest place comes first
        order = np.lexsort((self.second, self.first))
        a, b = self.first[order], self.second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.head = np.flatnonzero(new)
        self.lead = order[self.head]  # the window at each distinct block's first place
        self.times = np.diff(np.append(self.head, len(order)))
        self.next = order[np.minimum(self.head + 1, max(len(order) - 1, 0))]  # and at its second, where times > 1
        self.block = np.empty(len(order), np.int64)
        self.block[order] = np.cumsum(new) - 1


INDEX = "range int, chunk int, first binary, second binary, doc binary, pos binary, times binary"
FOUND = "kind int, chunk int, range int, codes binary, doc binary, pos binary"


def _indexer(window: int, ranges: int, bits: int):
    """For one chunk: its distinct blocks that may be repeated, with their first places, by range of the first fingerprint."""

    def run(group: pa.Table, codes: pa.Table) -> pa.Table:
        out = []
        if group.num_rows:
            c = Chunk(group, codes, window, bits)
            first = c.first[c.lead]
            at = np.searchsorted(first, cuts(ranges, 64))
            for r, (a, b) in enumerate(zip(at, [*at[1:], len(first)])):
                if b > a:
                    w = c.lead[a:b]
                    out.append((r, group.column("chunk")[0].as_py(), planes(np.diff(first[a:b], prepend=np.uint64(0))), planes(c.second[w]), planes(c.doc[w]), planes(c.pos[w].astype(np.int32)), planes(np.minimum(c.times[a:b], 255).astype(np.uint8))))
        cols = list(zip(*out)) or [[]] * 7
        released()
        return pa.table([pa.array(cols[i], pa.int32() if i < 2 else pa.binary()) for i in range(7)], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def _sources(group: pa.Table) -> pa.Table:
    """For one range: to every block that was sent, whether it occurs twice or more, and another place where it starts (its own
    where it is repeated within its chunk alone)."""
    col = {n: group.column(n).to_pylist() for n in ("first", "second", "doc", "pos", "times")}
    first = [np.cumsum(from_planes(b, np.uint64)) for b in col["first"]]
    ends = np.cumsum([len(x) for x in first])
    every = np.concatenate(first)
    second, doc, pos, times = (np.concatenate([from_planes(b, k) for b in col[n]]) for n, k in (("second", np.uint64), ("doc", np.int64), ("pos", np.int32), ("times", np.uint8)))
    order = np.lexsort((pos, doc, second, every))
    a, b = every[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    group_no = np.cumsum(new) - 1
    many = np.add.reduceat(times[order].astype(np.int64), head)[group_no] > 1
    size = np.diff(np.append(head, len(order)))[group_no]
    source = order[np.where(new & (size > 1), np.minimum(head[group_no] + 1, len(order) - 1), head[group_no])]
    flag, from_doc, from_pos = np.empty(len(order), np.uint8), np.empty(len(order), np.int64), np.empty(len(order), np.int32)
    flag[order], from_doc[order], from_pos[order] = many, np.where(many, doc[source], 0), np.where(many, pos[source], 0)
    parts = [np.split(x, ends[:-1]) for x in (flag, from_doc, from_pos)]
    answer = pa.table(
        {
            "kind": pa.array([1] * group.num_rows, pa.int32()),
            "chunk": group.column("chunk"),
            "range": group.column("range"),
            "codes": pa.array([x.tobytes() for x in parts[0]], pa.binary()),
            "doc": pa.array([planes(x) for x in parts[1]], pa.binary()),
            "pos": pa.array([planes(x) for x in parts[2]], pa.binary()),
        }
    )
    released()
    return answer


def factors(row, pos, source, offset, window: int) -> list[tuple[int, int, int, int, int]]:
    """Greedy parse: (row, start, end, source doc_id, offset in the source) of runs of neighbouring blocks whose sources are
    neighbours too; spans are words, end exclusive."""
    if not len(row):
        return []
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (source[1:] != source[:-1]) | (offset[1:] != offset[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(row)) - 1
    return list(zip(row[a].tolist(), pos[a].tolist(), (pos[b] + window).tolist(), source[a].tolist(), offset[a].tolist()))


FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("offset", pa.int32())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,end:int,source:long,offset:int>>"


def _parser(window: int, bits: int, with_text: bool):
    def run(group: pa.Table, answer: pa.Table) -> pa.Table:
        kind = np.array(answer.column("kind").to_pylist())
        c = Chunk(group, answer.filter(pa.array(kind == 0)), window, bits)
        found = sorted(zip(*(answer.filter(pa.array(kind == 1)).column(n).to_pylist() for n in ("range", "codes", "doc", "pos"))))
        join = lambda i, kind: np.concatenate([from_planes(x[i], kind) for x in found] or [np.zeros(0, kind)])
        true, doc, pos = join(1, np.uint8) > 0, join(2, np.int64), join(3, np.int32)
        at = np.flatnonzero(true[c.block]) if len(c.block) else c.block
        k = c.block[at]
        # a window's source: the index's answer for the chunk's first such block, that block itself for the later ones
        leads = c.lead[k] == at
        inner = leads & (doc[k] == c.doc[at]) & (pos[k] == c.pos[at]) & (c.times[k] > 1)  # repeated within the chunk alone
        own = np.where(inner, c.next[k], c.lead[k])
        near = inner | (~leads & ((c.doc[own] < doc[k]) | ((c.doc[own] == doc[k]) & (c.pos[own] <= pos[k]))))
        parse: dict[int, list] = {}
        for row, a, b, source, offset in factors(c.row[at], c.pos[at], np.where(near, c.doc[own], doc[k]), np.where(near, c.pos[own], pos[k]), window):
            parse.setdefault(row, []).append((a, b, source, offset))
        n_removed, digest, spans, out = [], [], [], []
        for i, t in enumerate(c.texts):
            words, merged = t.split(), []
            for a, b, _, _ in parse.get(i, ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            stay, last = [], 0
            for a, b in merged:
                stay += words[last:a]
                last = b
            text = b" ".join(stay + words[last:] if merged else words)
            n_removed.append(sum(b - a for a, b in merged))
            digest.append(sha256(text).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in merged])
            out.append(text.decode() if with_text else None)
        cols = {
            "doc_id": c.table.column("doc_id"),
            "n_words": pa.array(c.n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "factors": pa.array([[dict(zip(("start", "end", "source", "offset"), f)) for f in parse.get(i, ())] for i in range(len(c.texts))], pa.list_(FACTOR)),
        }
        released()
        return pa.table(cols | ({"kept_text": pa.array(out, pa.string())} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, bits: int | None = None) -> DataFrame:
    """One row a document: n_words, n_removed, digest of the kept words, the removed spans of words, the factors with their
    sources (and the kept text). ``bits`` of the first fingerprint are counted."""
    chunks = chunk_count(docs)
    bits = counting_bits(docs) if bits is None else bits
    placed = dealt(docs, chunks)
    codes = stored(counted(placed, _distinct(window, bits), repeated, chunks, bits), "blocks")
    index = placed.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(_indexer(window, chunks, bits), INDEX)
    none = F.lit(None).cast("binary")
    found = index.groupBy("range").applyInArrow(_sources, FOUND).unionByName(codes.select(F.lit(0).alias("kind"), "chunk", "range", "codes", none.alias("doc"), none.alias("pos")))
    schema = RESULT + (", kept_text string" if with_text else "")
    return placed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_parser(window, bits, with_text), schema)
