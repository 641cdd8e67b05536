"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document is its ids and an end id. Every 2,048 ids from its start fill a sequence of their own; the remainders, at
most 2,047 lengths whatever the corpus, form the histogram. A linear program over patterns of lengths (revised simplex;
a knapsack by dynamic programming, bounded by the demands, prices new columns in every round until Farley's bound is near, or rounds hardly lower the sum any more)
says how often each pattern is used. The uses of patterns
that fill a sequence (but for ``slack`` ids) are rounded down, then up by their fractions while demands last. What that
leaves, some pieces a pattern, is priced again by a bounded knapsack over the lengths left, longest first, each pattern
used as often as the lengths left allow. Lengths that no pattern fills (say, all of 1,500) take the pattern with the
least waste for as many sequences as their ids need, and the documents left over are cut to fill the holes; so only
structure, not rounding, cuts documents. The last ids, under 2,048, go to sequences of powers of two.

Patterns are given to documents by their rank within their length. Ranks are counted in cells of (length, salt), so that
no length, however frequent, meets in one task. Nulls: a null text is empty and holds the end id alone. Very long texts
fill sequences of their own; ties in length go by row. Repeated rows are packed each; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ROWS, Codec, chunks, codec_of, pieces_of
from .common import released, small_batches, stored, tasks_for

LENGTH, END_ID = 2048, 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
SLACK = 4  # ids that a pattern may leave empty
GAP = 0.0005  # stop when the bound is as near
CUT_COST = 0.5  # what cutting ids costs, as a share of the sequence that they fill
COLUMNS = 32  # patterns that one pricing looks at
PART = 24  # lengths priced at a time between pricings of all
TAIL = 60  # rounds that lower the sum by less than half of GAP are the last
BLOCK, FRESH = 64, 1000  # pivots held apart from the inverse, and until it is made anew


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow
    after 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(2)
def library_codec(path: str) -> Codec:
    """The library's vocabulary. Its merges are made here many pieces at once (checked against the library in tests); the
    library itself encodes long pieces."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    chars = byte_characters()
    ranks = {bytes(chars[c] for c in token): i for token, i in t.get_vocab(with_added_tokens=False).items() if token != SPECIAL}
    return codec_of(ranks, lambda p: t.encode(p.decode(), add_special_tokens=False).ids)


def token_ids(texts: list[str], path: str):
    """uint32 ids of each text as the library gives them, with the end id; pieces go through the bounded cache."""
    codec = library_codec(path)
    for part in chunks(texts):
        cuts = [t.split(SPECIAL) if SPECIAL in t else [t] for t in part]
        pieces, _, counts = pieces_of([x for c in cuts for x in c])
        _, ids, sizes = codec.encode(pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        k = 0
        for c in cuts:
            own = [ids[ends[k] : ends[k + 1]]]
            for i in range(1, len(c)):
                own += [np.array([SPECIAL_ID], np.uint32), ids[ends[k + i] : ends[k + i + 1]]]
            k += len(c)
            yield np.concatenate([*own, np.array([END_ID], np.uint32)])


TOKENS = "uid long, doc_id long, doc_tokens long, n_full int, full_crcs array<long>, rem int, rem_crc long, rem_ids binary"


def tokenised(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row a document: counts, checksums of its full pieces, and its remainder's ids as 16-bit numbers."""

    def run(batches):
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            out = []
            for ids in token_ids(texts, path):
                full = len(ids) // length
                crcs = [zlib.crc32(ids[i * length : (i + 1) * length]) for i in range(full)]
                rest = ids[full * length :]
                out.append((len(ids), full, crcs, len(rest), zlib.crc32(rest), rest.astype(np.uint16).tobytes()))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_tokens", "n_full", "full_crcs", "rem", "rem_crc", "rem_ids"]
            yield pa.RecordBatch.from_pydict({"uid": b.column("uid"), "doc_id": b.column("doc_id")} | {n: pa.array(c, t) for n, c, t in zip(names, cols, types)})
        released()

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, TOKENS)


def knapsack(price: np.ndarray, most: dict[int, int], capacity: int):
    """Values of the best patterns of every capacity, and a function that tells such a pattern. ``price[n]`` is the value of
    a piece of length n (0: none), of which a pattern holds ``most[n]`` at most; copies are taken in powers of two."""
    items = []
    for n in np.flatnonzero(price > 1e-12).tolist():
        left, times = min(most[n], capacity // n), 1
        while left > 0:
            items.append((n, min(times, left)))
            left, times = left - times, times * 2
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for i, (n, k) in enumerate(items):
        value, better = best[: -n * k] + price[n] * k, took[i, n * k :]
        np.greater(value, best[n * k :] + 1e-13, out=better)
        np.copyto(best[n * k :], value, where=better)

    def pattern(c: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for i in range(len(items) - 1, -1, -1):
            if took[i, c]:
                n, k = items[i]
                out[n] = out.get(n, 0) + k
                c -= n * k
        return out

    return best, pattern


def least_waste(left: dict[int, int], first: int, capacity: int = LENGTH) -> tuple[dict[int, int], int]:
    """The pattern with ``first`` and other lengths of ``left`` that fills the sequence most, and its waste: a bounded
    knapsack by dynamic programming over bit sets of sums, long pieces first."""
    target = capacity - first
    mask, sums, steps = (1 << (target + 1)) - 1, 1, []
    for n in sorted(left, reverse=True):
        for _ in range(min(left[n] - (n == first), target // n)):
            more = (sums | (sums << n)) & mask
            if more == sums:
                break
            steps.append((n, sums))
            sums = more
        if sums >> target & 1:
            break
    at = sums.bit_length() - 1
    pattern, waste = {first: 1}, target - at
    for n, before in reversed(steps):
        if not before >> at & 1:
            pattern[n] = pattern.get(n, 0) + 1
            at -= n
    return pattern, waste


def fullest(demand: dict[int, int], capacity: int = LENGTH) -> list[dict[int, int]]:
    """Patterns to start with: for the longest length left the fullest one, as often as the lengths left allow."""
    left, out = dict(demand), []
    while left:
        pattern, _ = least_waste(left, max(left), capacity)
        times = min(left[n] // k for n, k in pattern.items())
        out.append(pattern)
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


class Master:
    """The linear program: uses of patterns, each costing one sequence, meet every length's demand.

    Documents may be cut, so a document in no pattern costs what its ids fill and ``cut`` times as much again, and a place
    that no document of its length takes is worth what other ids may fill of it, less ``cut`` times as much. The duals so lie
    between (1 - cut) and about (1 + cut) times length / capacity, and the first basis is the identity. With ``cut`` 1 neither
    pays and this is the cutting-stock program itself. Revised simplex; the inverse is kept with up to ``BLOCK`` pivots
    apart, as a product of low rank, and made anew from its columns every ``FRESH`` pivots. Demands are raised by
    parts in a million, unlike for each length, against ties. The end is Farley's bound: the demands' value at prices at which
    no pattern is worth more than one, which the best pattern's value scales the duals to.
    """

    def __init__(self, demand: dict[int, int], capacity: int = LENGTH, gap: float = GAP, cut: float = CUT_COST):
        self.demand, self.capacity, self.gap = demand, capacity, gap
        self.lengths = sorted(demand, reverse=True)
        self.row = {n: i for i, n in enumerate(self.lengths)}
        self.size, self.need = np.array(self.lengths, np.int64), np.array([demand[n] for n in self.lengths], float)
        self.random = np.random.default_rng(len(demand))
        m, weight = len(self.lengths), self.size / capacity
        self.goal = self.need * (1 + 1e-6 * self.random.random(m))
        self.high = weight * (1 + cut * (1 + 0.2 * self.random.random(m)))
        self.low = weight * (1 - cut)
        self.columns: list[tuple[dict[int, int], bool, bool]] = [({n: 1}, False, False) for n in self.lengths]  # column, a pattern, generated
        self.cost, self.use, self.dual, self.inverse = self.high.copy(), self.goal.copy(), self.high.copy(), np.eye(m)
        self.rows, self.left = [], np.zeros((m, BLOCK))  # the inverse is (1 + left at rows) times the kept one
        self.bound = float(weight @ self.need)  # at prices by length no pattern is worth more than one
        self.pivots = self.pricings = 0

    def _applied(self):
        if self.rows:
            self.inverse += self.left[:, : len(self.rows)] @ self.inverse[self.rows]
            self.left[:], self.rows = 0, []

    def _afresh(self):
        basis = np.zeros((len(self.lengths),) * 2)
        for j, (column, _, _) in enumerate(self.columns):
            for n, k in column.items():
                basis[self.row[n], j] = k
        self.left[:], self.rows = 0, []
        self.inverse = np.linalg.inv(basis)
        self.use, self.dual = np.maximum(self.inverse @ self.goal, 0), self.cost @ self.inverse

    def enter(self, column: dict[int, int], cost: float, pattern: bool = False, generated: bool = False) -> bool:
        """Brings a column into the basis if that pays."""
        at, k = np.array([self.row[n] for n in column]), np.array(list(column.values()), float)
        gain, held = cost - self.dual[at] @ k, len(self.rows)
        if gain >= -1e-9:  # an earlier column has made it worthless
            return False
        d = self.inverse[:, at] @ k
        if held:
            d += self.left[:, :held] @ (self.inverse[np.ix_(self.rows, at)] @ k)
        up = np.flatnonzero(d > 1e-7)
        if not len(up):
            return False
        ratio = self.use[up] / d[up]
        ties = up[ratio <= ratio.min() * (1 + 1e-9) + 1e-9]
        out = int(ties[d[ties].argmax()])
        step = self.use[out] / d[out]
        np.maximum(self.use - step * d, 0, out=self.use)
        self.use[out] = step
        own = self.inverse[out] + (self.left[out, :held] @ self.inverse[self.rows] if held else 0)
        self.dual = self.dual + own * (gain / d[out])
        turn = -d / d[out]
        turn[out] = 1 / d[out] - 1
        if held:
            self.left[:, :held] += np.outer(turn, self.left[out, :held])
        if out not in self.rows:
            self.rows.append(out)
        self.left[:, self.rows.index(out)] += turn
        self.columns[out], self.cost[out] = (column, pattern, generated), cost
        self.pivots += 1
        if len(self.rows) == BLOCK:
            self._applied()
        if self.pivots % FRESH == 0:
            self._afresh()
        return True

    def boxed(self):
        """Documents in no pattern, and places for other ids, where the duals leave their box."""
        for by, sign, cost in ((self.dual - self.high, 1, self.high), (self.low - self.dual, -1, -self.low)):
            for i in np.argsort(-by, kind="stable")[:BLOCK].tolist():
                if by[i] > 1e-7:
                    self.enter({self.lengths[i]: sign}, float(cost[i]))

    def price(self, among: np.ndarray, taken: set[int]) -> bool:
        """Brings in patterns of some lengths (by row), the best that holds each, worth more than one and without a length
        in common; over all lengths the bound follows."""
        self.pricings += 1
        price, sizes = np.zeros(int(self.size[0]) + 1), self.size[among]
        price[sizes] = np.clip(self.dual, 0, self.high)[among]
        best, pattern = knapsack(price, self.demand, self.capacity)
        if len(among) == len(self.lengths):
            self.bound = max(self.bound, float(price[self.size] @ self.need) / max(float(best[self.capacity]), 1.0))
        held, found = price[sizes] + best[self.capacity - sizes], False
        for i in np.argsort(-held, kind="stable")[:COLUMNS].tolist():
            if held[i] <= 1 + 1e-9:
                break
            n = int(sizes[i])
            column = pattern(self.capacity - n)
            column[n] = column.get(n, 0) + 1
            if column[n] <= self.demand[n] and taken.isdisjoint(column) and self.enter(column, 1.0, True, True):
                taken.update(column)
                found = True
        return found

    def solve(self):
        """Prices in every round: over all lengths and, in parts drawn anew, over few of them at a time."""
        m = len(self.lengths)
        for pattern in fullest(self.demand, self.capacity):
            self.enter(pattern, 1.0, True)
        parts, sums = m // PART, []
        while True:
            self.boxed()
            taken: set[int] = set()
            found = self.price(np.arange(m), taken)
            sums.append(float(self.cost @ self.use))
            if sums[-1] <= (1 + self.gap) * self.bound or len(sums) > TAIL and sums[-TAIL] - sums[-1] < self.gap / 2 * self.bound:
                break
            order = self.random.permutation(m)
            for g in range(parts if parts > 1 else 0):
                found |= self.price(np.sort(order[g::parts]), taken)
            if not found and not (self.dual > self.high + 1e-7).any() and not (self.dual < self.low - 1e-7).any():
                break  # nothing pays any more
        self._afresh()
        self.use = np.maximum(self.inverse @ self.need, 0)
        return self

    def plan(self) -> list[tuple[dict[int, int], float]]:
        return [(column, x) for (column, pattern, _), x in zip(self.columns, self.use.tolist()) if pattern and x > 1e-9]

    def generated(self) -> list[dict[int, int]]:
        """The patterns of the plan that pricing has made."""
        return [column for (column, _, made), x in zip(self.columns, self.use.tolist()) if made and x > 1e-9]


def cutting_stock(demand: dict[int, int], capacity: int = LENGTH, gap: float = GAP, cut: float = CUT_COST) -> list[tuple[dict[int, int], float]]:
    """Patterns and their fractional use, by column generation on the master program."""
    return Master(demand, capacity, gap, cut).solve().plan() if demand else []


def rounded(plan, demand: dict[int, int], capacity: int = LENGTH, slack: int = SLACK) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the patterns that leave at most ``slack``: rounded down, then one more by fraction while demands last."""
    left, out = dict(demand), {}
    full = [(p, x) for p, x in plan if capacity - sum(n * k for n, k in p.items()) <= slack]
    for i, (p, x) in enumerate(full):
        times = min([int(x + 1e-9), *(left[n] // k for n, k in p.items())])
        out[i] = times
        for n, k in p.items():
            left[n] -= k * times
    for i in sorted(range(len(full)), key=lambda i: -(full[i][1] % 1)):
        p = full[i][0]
        if full[i][1] % 1 > 1e-6 and all(left[n] >= k for n, k in p.items()):
            out[i] += 1
            for n, k in p.items():
                left[n] -= k
    return [(full[i][0], t) for i, t in out.items() if t]


def residual(demand: dict[int, int], used, capacity: int = LENGTH, slack: int = SLACK):
    """More patterns for what ``used`` leaves of ``demand``: those within ``slack``, and those with holes, each as often as
    the lengths left allow; every step uses up a length, so there are few steps at any demand."""
    left = {n: k - sum(p.get(n, 0) * t for p, t in used) for n, k in demand.items()}
    left = {n: k for n, k in left.items() if k}
    filled, aside = [], {}
    while left:
        first = max(left)
        pattern, waste = least_waste(left, first, capacity)
        if waste > slack:
            aside[first] = left.pop(first)
            continue
        times = min(left[n] // k for n, k in pattern.items())
        filled.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    # lengths that nothing fills: least waste first, in all as many sequences as their ids need
    room, holed = sum(n * k for n, k in aside.items()) // capacity, []
    while aside and room:
        pattern, waste = least_waste(aside, max(aside), capacity)
        times = min([room, *(aside[n] // k for n, k in pattern.items())])
        holed.append((pattern, times))
        room -= times
        for n, k in pattern.items():
            aside[n] -= k * times
            if not aside[n]:
                del aside[n]
    return filled, holed


class Layout:
    """Where ranks within a length, and ids of the stream of documents to be cut, are placed."""

    def __init__(self, demand: dict[int, int], slack: int = SLACK, capacity: int = LENGTH):
        used = rounded(cutting_stock(demand, capacity), demand, capacity, slack)
        filled, holed = residual(demand, used, capacity, slack)
        self.given, self.runs, first = dict.fromkeys(demand, 0), {n: [] for n in demand}, 0
        regions: list[tuple[int, int, int, int, int]] = []  # stream position, slots, ids a slot, first sequence, offset
        place = 0
        for pattern, times in [*used, *filled, *holed]:
            at = 0
            for n, k in sorted(pattern.items(), reverse=True):
                lo = self.given[n]
                self.given[n] += k * times
                self.runs[n].append((lo, self.given[n], k, first, at))
                at += n * k
            if capacity - at > slack:
                regions.append((place, times, capacity - at, first, at))
                place += times * (capacity - at)
            first += times
        self.stream, total = {}, 0
        for n in sorted(demand, reverse=True):
            self.stream[n] = total
            total += (demand[n] - self.given[n]) * n
        self.by_patterns = sum(n * k for n, k in self.given.items())
        whole = max(0, total - place) // capacity
        regions.append((place, whole, capacity, first, 0))
        place, first = place + whole * capacity, first + whole
        for bit in reversed(range(capacity.bit_length() - 1)):
            if max(0, total - place) >> bit & 1:
                regions.append((place, 1, 1 << bit, first, 0))
                place, first = place + (1 << bit), first + 1
        self.regions, self.sequences = [r for r in regions if r[1]], first


def _ranked(rows: DataFrame, salts: int):
    """Adds ``rank`` within the remainder's length and ``full_before``, full pieces of the rows before; both gapless."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("rem", "salt").agg(F.count("*").alias("n"))
    cells = cells.select("rem", "salt", F.coalesce(F.sum("n").over(before(Window.partitionBy("rem").orderBy("salt"))), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("rem", "salt").orderBy("uid")) - 1
    rows = rows.withColumn("rank", rank).join(cells, ["rem", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    return rows


def _full_places(rows: DataFrame, salts: int, first: int) -> DataFrame:
    """A sequence for every full piece."""
    long = rows.where("n_full > 0").select("uid", "doc_id", "doc_tokens", "n_full", "full_crcs").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    sums = long.groupBy("salt").agg(F.sum("n_full").alias("n"))
    w = Window.partitionBy(F.floor(F.col("salt") / 4096)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    top = sums.groupBy(F.floor(F.col("salt") / 4096).alias("block")).agg(F.sum("n").alias("n")).collect()  # salts / 4096 rows
    heads, total = [], 0
    for r in sorted(top, key=lambda r: r.block):
        heads.append((r.block, total))
        total += r.n
    blocks = F.broadcast(rows.sparkSession.createDataFrame(heads, "block long, head long"))
    base = sums.select("salt", F.floor(F.col("salt") / 4096).alias("block"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")).join(blocks, "block")
    own = F.coalesce(F.sum("n_full").over(Window.partitionBy("salt").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = long.withColumn("own", own).join(base, "salt")
    return long.select("doc_id", "doc_tokens", (F.col("own") + F.col("base") + F.col("head") + F.lit(first)).alias("at"), F.posexplode("full_crcs").alias("i", "crc")).select(
        "doc_id", (F.col("i") * LENGTH).cast("long").alias("start"), F.lit(LENGTH).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens", (F.col("at") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


CUT = "ids_crc32 long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


def _cutter(regions):
    """Pieces of remainders that lie in the stream at ``p``: their 16-bit ids, cut at the edges of slots, as 32-bit numbers."""
    heads = np.array([r[0] for r in regions], np.int64)

    def run(batches):
        for b in batches:
            out = []
            for doc, n, tokens, p, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rem", "doc_tokens", "p", "rem_ids"))):
                ids, at = np.frombuffer(blob, np.uint16), 0
                while at < n:
                    head, _, width, first, offset = regions[int(np.searchsorted(heads, p + at, "right")) - 1]
                    slot, within = divmod(p + at - head, width)
                    size = min(width - within, n - at)
                    crc = zlib.crc32(ids[at : at + size].astype("<u4"))
                    out.append((crc, doc, tokens - n + at, size, tokens, first + slot, offset + within))
                    at += size
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in CUT.split(", ")])

    return run


PLACES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length != LENGTH:
        raise ValueError("sequences hold 2,048 ids")
    spark = docs.sparkSession
    rows = stored(tokenised(docs, path), "tokens")
    demand = {r.rem: r.n for r in rows.where("rem > 0").groupBy("rem").agg(F.count("*").alias("n")).collect()}  # 2,047 rows at most
    plan = Layout(demand, slack)
    table = F.broadcast(spark.createDataFrame([(n, plan.runs[n], plan.given[n], plan.stream[n]) for n in demand], "rem int, runs array<struct<lo:long,hi:long,k:int,first:long,at:int>>, given long, stream long"))
    salts = tasks_for(rows.select("uid", "doc_id", "rem"), 4 << 20)
    slim = rows.where("rem > 0").select("uid", "doc_id", "doc_tokens", "rem", "rem_crc")
    ranked = _ranked(slim, salts).join(table, "rem")
    start = F.col("doc_tokens") - F.col("rem")
    run = F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    placed = ranked.where("rank < given").withColumn("run", run).withColumn("i", F.col("rank") - F.col("run.lo"))
    placed = placed.select(
        "doc_id", start.cast("long").alias("start"), F.col("rem").cast("long").alias("length"), F.col("rem_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("run.first") + F.floor(F.col("i") / F.col("run.k"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod("i", F.col("run.k")) * F.col("rem")).cast("long").alias("offset"),
    )
    rest = ranked.where("rank >= given").select("uid", "doc_id", "doc_tokens", "rem", (F.col("stream") + (F.col("rank") - F.col("given")) * F.col("rem")).alias("p"))
    cut = rest.join(rows.select("uid", "rem_ids"), "uid").drop("uid").mapInArrow(_cutter(plan.regions), CUT)
    return placed.select(PLACES).union(cut.select(PLACES)).union(_full_places(rows, salts, plan.sequences).select(PLACES))
