"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised over a chunk of texts: every code point gets a class (letter, number, other, blank,
other white space); a token boundary depends on the automaton's state, and each class either resets the state or keeps
it, so the composed transition functions of a prefix reduce to "the last class seen", one shifted comparison. The only
longer look is at apostrophes. No regular expression is run. Slices between boundaries go through a bounded cache of
merged pairs; piece starts and token counts are retained, so that ids map back to slices.

Nulls: a null text counts as empty (no ids). Very long runs are merged with a heap. Repeated rows are encoded each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_rows import PairTable, merged
from .common import released, small_batches

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that an apostrophe takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CHUNK = 1 << 19  # code points handled at once, a longer text alone
ROWS = 512  # rows taken out of an Arrow batch at once
CACHED = 250_000  # pieces held by a worker; the more frequent half survives an overflow


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    cats = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    cats = np.array(cats)
    table[cats == "L"] = LETTER
    table[cats == "N"] = NUMBER
    table[WHITE] = SPACE
    table[0x20] = BLANK
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces in ``points`` (code points of texts one after the other); ``first``: starts of the texts."""
    n = len(points)
    c = class_table()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    white = c >= BLANK
    after_white = np.empty(n, bool)
    after_white[0] = False
    after_white[1:] = white[:-1]
    after_white &= ~begins[:n]
    to_word = np.empty(n, bool)
    to_word[-1] = False
    to_word[:-1] = ~white[1:]
    to_word &= ~begins[1:]
    other = np.empty(n, bool)
    other[0] = True
    other[1:] = (c[1:] != c[:-1]) & (c[:-1] != BLANK)
    start = np.where(white, ~after_white | to_word, other | begins[:n])
    for i in np.flatnonzero((points == 0x27) & start).tolist():
        for e in ENDINGS:
            j = i + len(e)
            if j < n and points[i + 1 : j + 1].tobytes() == e.encode("utf-32-le") and not begins[i + 1 : j + 1].any():
                start[i + 1 : j + 1] = False
                if j + 1 < n:
                    start[j + 1] |= c[j + 1] == LETTER
                break
    return np.flatnonzero(start)


def chunks(texts: list[str]):
    """Runs of texts with about CHUNK code points."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of all texts, their starts in the joined text, and the number of pieces of each text."""
    joined = "".join(texts)
    ends = np.fromiter(accumulate(map(len, texts)), np.int64, len(texts))
    if not joined:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], ends[:-1]])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = piece_starts(points, first[first < len(points)])
    cut = [*starts.tolist(), len(joined)]
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, first)
    return [joined[a:b] for a, b in zip(cut, cut[1:])], starts, counts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair with the least rank is joined until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    costs = [get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
    while costs:
        low = min(costs)
        if low == 1 << 40:
            break
        i = costs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = get(parts[i - 1] + parts[i], 1 << 40)
        if i < len(costs):
            costs[i] = get(parts[i] + parts[i + 1], 1 << 40)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list: n log n."""
    n = len(piece)
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : e])) is not None:
            heapq.heappush(heap, (r, prev[i], e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Slots(dict):
    """Piece -> slot; an unknown piece gets the next slot and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece):
        self[piece] = slot = len(self)
        self.fresh.append(piece)
        return slot


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin[i] : begin[i] + size[i]]`` for all i, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - ends + size, size)]


class Codec:
    """Cached encoder. ``missing(pieces)`` gives ids and counts of pieces that are not cached; about CACHED stay."""

    def __init__(self, missing, decimal: bool = False):
        self.missing, self.decimal = missing, decimal
        self.slots, self.text, self.used, self.turn = _Slots(), [], 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.size, self.begin, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _shrink(self):
        n = len(self.slots)
        hits = self.hits[:n]
        stay = np.argsort(-hits, kind="stable")[: CACHED // 2]
        stay = np.sort(stay[hits[stay] > 0])
        names = list(self.slots)
        self.slots = _Slots()
        self.slots.update((names[i], k) for k, i in enumerate(stay.tolist()))
        if self.decimal:
            self.text = [self.text[i] for i in stay.tolist()]
        size = self.size[stay]
        self.flat = gathered(self.flat, self.begin[stay], size)
        self.used, self.size, self.begin, self.hits = len(self.flat), size, np.cumsum(size) - size, hits[stay] // 2

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a)), a.dtype)])

    def encode(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Slots, ids one after the other, and the number of ids of each piece."""
        if len(self.slots) > CACHED:
            self._shrink()
        n = len(self.slots)
        slots = list(map(self.slots.__getitem__, pieces))
        if fresh := self.slots.fresh:
            ids, counts = self.missing(fresh)
            m, k = n + len(fresh), len(ids)
            self.size, self.begin, self.hits = (self._room(a, m) for a in (self.size, self.begin, self.hits))
            self.flat = self._room(self.flat, self.used + k)
            self.size[n:m], self.flat[self.used : self.used + k] = counts, ids
            self.begin[n:m] = self.used + np.cumsum(counts) - counts
            self.used += k
            if self.decimal:
                said, at = list(map(str, ids.tolist())), 0
                for c in counts.tolist():
                    self.text.append(" ".join(said[at : at + c]))
                    at += c
            self.slots.fresh = []
        where = np.array(slots, np.int64)
        self.turn += 1
        if self.turn % 8 == 1:  # how often a piece is met is estimated from every eighth chunk
            seen = np.bincount(where)
            self.hits[: len(seen)] += seen
        size = self.size[where]
        return slots, gathered(self.flat, self.begin[where], size), size


class Vocabulary:
    """Bytes of the ids, for vectorised decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            tokens[v] = k
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return gathered(self.flat, self.begin[ids], self.size[ids]).tobytes()


def codec_of(ranks: dict[bytes, int], alone, decimal: bool = False) -> Codec:
    """A codec that merges unknown pieces many at once (``bpe_rows``); ``alone`` merges a long piece."""
    table = PairTable(ranks)
    return Codec(lambda pieces: merged([p.encode() for p in pieces], table, alone), decimal)


@lru_cache(2)
def own_codec(path: str) -> tuple[Codec, Vocabulary]:
    ranks = load_ranks(path)
    return codec_of(ranks, lambda p: merge(p, ranks), decimal=True), Vocabulary(ranks)


def encode_texts(texts: list[str], path: str):
    """For each text: ids, its pieces' ids as decimal text, piece starts (code points), number of ids of each piece."""
    codec, _ = own_codec(path)
    for part in chunks(texts):
        pieces, starts, counts = pieces_of(part)
        slots, ids, sizes = codec.encode(pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        base, shift, text = 0, 0, codec.text  # the list of this chunk: an overflow makes a new one
        for t, n in zip(part, counts.tolist()):
            own = slice(base, base + n)
            yield ids[ends[base] : ends[base + n]], [text[s] for s in slots[own]], starts[own] - shift, sizes[own]
            base, shift = base + n, shift + len(t)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, piece_starts (code points in the text), piece_ids (ids of each piece)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):  # ids are much larger than the text
                part = b.slice(at, 256)
                rows = [(x[0], x[2], x[3]) for x in encode_texts([t or "" for t in part.column("text").to_pylist()], path)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                        "piece_starts": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                        "piece_ids": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                    }
                )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, piece_starts array<int>, piece_ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes."""

    def run(batches):
        _, vocabulary = own_codec(path)
        for b in batches:
            out = [None if x is None else vocabulary.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded bytes: encoding and decoding in one pass over the texts."""

    def run(batches):
        from hashlib import sha256

        _, vocabulary = own_codec(path)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n, said, back = [], [], []
            for ids, decimal, _, _ in encode_texts([t or "" for t in b.column("text").to_pylist()], path):
                n.append(len(ids))
                said.append(sha256(" ".join(decimal).encode()).hexdigest())
                back.append(sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string())})
        released()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
