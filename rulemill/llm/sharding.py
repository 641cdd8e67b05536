"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts), law ``bytes``.

Groups of one size are interchangeable, so the driver packs sizes with their numbers of groups, not groups. Sizes keep
12 significant bits, rounded up, so there are some 60,000 of them at most at any size of the input, and a bin holds at most
1/2,048 less than it is counted. By falling size, groups enter the tightest bin that has room, found through a balanced
(AVL) tree; the least capacity that needs no more than the wanted shards is found by bisection. Groups above an even
share of what is left have a shard of their own. Where best fit leaves shards empty (few groups of like sizes), each takes half of
the fullest shard. A group takes its shard by its rank among the groups of its size; ranks are counted in cells of
(size, salt), and groups with many rows meet their rows by a broadcast of bounded size.

Nulls: a null text has no bytes and belongs with empty texts; a null doc_id is kept. Very long texts are groups like
others. Ties in size go by hash. Repeated rows count each; empty tables give no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tasks_for, text_or_empty

BITS = 12  # significant bits of a group's size
HOT = 1024  # groups broadcast at most: those with over 1/HOT of the rows


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


class BinTree:
    """Balanced tree of (remaining capacity, bin): insert, delete and the least key that is not below a bound, each in log time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n.height if n else 0

    def _up(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        return n

    def _right(self, n):
        a = n.left
        n.left, a.right = a.right, n
        self._up(n)
        return self._up(a)

    def _left(self, n):
        a = n.right
        n.right, a.left = a.left, n
        self._up(n)
        return self._up(a)

    def _even(self, n):
        self._up(n)
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._left(n.left)
            return self._right(n)
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._right(n.right)
            return self._left(n)
        return n

    def insert(self, key):
        def go(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = go(n.left)
            else:
                n.right = go(n.right)
            return self._even(n)

        self.root = go(self.root)

    def delete(self, key):
        def go(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = go(n.left, key)
            elif key > n.key:
                n.right = go(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                m = n.right
                while m.left:
                    m = m.left
                n.key = m.key
                n.right = go(n.right, m.key)
            return self._even(n)

        self.root = go(self.root, key)

    def ceiling(self, bound):
        n, found = self.root, None
        while n:
            if n.key >= bound:
                found, n = n.key, n.left
            else:
                n = n.right
        return found


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict | None:
    """Item -> bin for items (size, name); None if more than ``most`` bins would be needed or an item does not fit."""
    tree, bins, placed = BinTree(), 0, {}
    for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        if size > capacity:
            return None
        at = tree.ceiling((size, -1))
        if at is None:
            if most is not None and bins >= most:
                return None
            at, bins = (capacity, bins), bins + 1
        else:
            tree.delete(at)
        placed[name] = at[1]
        tree.insert((at[0] - size, at[1]))
    return placed


def alone(sizes: list[int], bins: int, total: int) -> int:
    """How many of the largest sizes are above an even share of what is left of ``total`` by the larger ones: each needs a bin of its own."""
    n = 0
    for size in sorted(sizes, reverse=True):
        if n + 1 >= bins or size * (bins - n) <= total:
            break
        n, total = n + 1, total - size
    return n


def even_bins(items: list[tuple[int, object]], bins: int) -> dict:
    """Item -> bin. Items above an even share of what is left have a bin each. The others are packed by best fit decreasing at the
    least capacity, to 1/20000 of an even share, that needs no more than the bins left."""
    order = sorted(items, key=lambda x: (-x[0], str(x[1])))
    n = alone([x[0] for x in items], bins, sum(x[0] for x in items))
    found = _least_capacity(order[n:], bins - n)
    if found and max(found.values()) + 1 < bins - n:
        held, of = [Counter() for _ in range(max(found.values()) + 1)], dict((name, s) for s, name in order)
        for name, b in found.items():
            held[b][of[name]] += 1
        free = {s: iter([b for b, sizes in enumerate(levelled(held, bins - n)) for _ in range(sizes[s])]) for s in set(of.values())}
        found = {name: next(free[of[name]]) for name in found}
    return {name: i for i, (_, name) in enumerate(order[:n])} | {name: n + b for name, b in found.items()}


def levelled(held: list[Counter], bins: int) -> list[Counter]:
    """Bins that best fit left empty each take half of the fullest bin of two groups or more. held: per bin the number of groups
    of a size."""
    load = lambda sizes: sum(s * k for s, k in sizes.items())
    while len(held) < bins and (full := [b for b, sizes in enumerate(held) if sum(sizes.values()) > 1]):
        top = max(full, key=lambda b: (load(held[b]), -b))
        keep, give = Counter(), Counter()
        for size, k in sorted(held[top].items(), reverse=True):
            keep[size] += k // 2
            give[size] += k // 2
            if k % 2:
                (keep if load(keep) <= load(give) else give)[size] += 1
        held[top] = +keep
        held.append(+give)
    return held


def _least_capacity(items: list[tuple[int, object]], bins: int) -> dict:
    total, largest = sum(x[0] for x in items), max((x[0] for x in items), default=1)
    return least_capacity(total, largest, bins, lambda capacity: best_fit_decreasing(items, capacity, bins))


def least_capacity(total: int, largest: int, bins: int, pack):
    """What ``pack`` gives for the least capacity, to 1/20000 of an even share, that it can do with."""
    low = max(largest, -(-total // bins), 1)
    step = max(1, low // 20_000)
    high = low
    found, grow = pack(high), step
    while found is None:
        low, high, grow = high, high + grow, grow * 2
        found = pack(high)
    while high - low > step:
        mid = (low + high) // 2
        if (better := pack(mid)) is None:
            low = mid
        else:
            found, high = better, mid
    return found


Classes = list[tuple[int, int]]
Placed = list[list[tuple[int, int]]]


def best_fit_classes(classes: Classes, capacity: int, most: int | None = None) -> Placed | None:
    """Best fit decreasing for (size, number of groups), largest first: per size how many groups enter which bin. A bin that
    was the tightest is tighter still after an item, so it takes all that fit at once: the outcome is that of one by one."""
    tree, bins, placed = BinTree(), 0, []
    for size, count in classes:
        if size > capacity:
            return None
        runs = []
        while count:
            at = tree.ceiling((size, -1))
            if at is None:
                if most is not None and bins >= most:
                    return None
                at, bins = (capacity, bins), bins + 1
            else:
                tree.delete(at)
            k = min(count, at[0] // size)
            runs.append((at[1], k))
            tree.insert((at[0] - k * size, at[1]))
            count -= k
        placed.append(runs)
    return placed


def even_classes(classes: Classes, bins: int) -> Placed:
    """``even_bins`` for (size, number of groups), largest first."""
    total = sum(s * k for s, k in classes)
    top = [s for s, k in classes[:bins] for _ in range(min(k, bins))]
    n = alone(top, bins, total)
    own, rest, first = [], [], n
    for size, count in classes:
        k = min(count, first)
        own.append(k)
        first -= k
        rest.append((size, count - k))
    left, packed = bins - n, [c for c in rest if c[1]]
    whole = sum(s * k for s, k in packed)
    fitted = least_capacity(whole, packed[0][0] if packed else 1, left, lambda capacity: best_fit_classes(packed, capacity, left))
    used = 1 + max((b for runs in fitted for b, _ in runs), default=-1)
    if used < left:
        held = [Counter() for _ in range(used)]
        for (size, _), runs in zip(packed, fitted):
            for b, k in runs:
                held[b][size] += k
        held = levelled(held, left)
        fitted = [[(b, sizes[size]) for b, sizes in enumerate(held) if sizes[size]] for size, _ in packed]
    fitted = iter(fitted)
    out, at = [], 0
    for (_, count), k in zip(rest, own):
        out.append([(at + i, 1) for i in range(k)] + ([(n + b, m) for b, m in next(fitted)] if count else []))
        at += k
    return out


def size_class(size):
    """``size`` rounded up to BITS significant bits."""
    shift = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1, shift), shift)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row in one shard, equal texts together."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = stored(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "sizes",
    )
    salts = tasks_for(rows, 4 << 20)
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = stored(groups.withColumn("class", size_class(F.col("bytes"))).withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts)).cast("int")), "groups")
    classes = sorted(((r["class"], r.n) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)  # one row a size class
    runs = []
    for (size, _), placed in zip(classes, even_classes(classes, shards)):
        lo, own = 0, []
        for b, k in placed:
            own.append((lo, lo + k, b))
            lo += k
        runs.append((size, own))
    plan = F.broadcast(spark.createDataFrame(runs, "class long, runs array<struct<lo:long,hi:long,shard:int>>"))
    cells = groups.groupBy("class", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("class", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("g")) - 1
    ranked = groups.withColumn("rank", rank).join(cells, ["class", "salt"]).join(plan, "class").withColumn("rank", F.col("rank") + F.col("base"))
    shard = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]["shard"]
    found = stored(ranked.select("g", "n", shard.alias("shard")), "shards")
    n_rows = rows.count()
    hot = F.broadcast(found.where(F.col("n") * HOT > n_rows).select("g", "shard"))  # fewer than HOT rows
    placed = rows.join(hot, "g").unionByName(rows.join(hot.select("g"), "g", "left_anti").join(found.select("g", "shard"), "g"))
    # slots: rows of a shard are dealt to chunks; a chunk's first slot is the number of rows in the chunks before it
    chunks = max(1, salts * 4 // shards)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own_row = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "uid")) - 1
    return (
        placed.withColumn("r", own_row).join(base, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
