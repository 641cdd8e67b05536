"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

Shingles are ordered by their exact document frequency (counted over all documents, see ``fingerprints``), rarest
first, so a document's prefix is made of shingles that few others have; those that no other document has cannot join
and are dropped at once. Documents with the same shingle set become one class. Classes that share a prefix shingle and
whose sizes allow the similarity meet: what is reachable so is dealt, by bands of sizes and by hash, to blocks of bounded
size, and only blocks of the same or of neighbouring bands meet, each pair of blocks in one task. There classes are
joined on their prefix shingles, each pair kept at its first shared one: length filter, positional filter at that
shingle, suffix filter on counts by hash range, then one exact intersection. So no group meets in one task, no pair is
ever a row, and a chain of texts of growing sizes isn't compared end to end: a task yields a spanning forest of its links
and each class's number of links.

Similarity is exact: ``100 * |A & B| >= percent * |A | B|`` on 64-bit shingle fingerprints. Nulls and texts without
words have no shingles and link with nothing; fewer words than ``n`` make one shingle. Very long texts are read whole.
A null doc_id is no node: its component is null. Repeated rows and ties are copies of each other. An empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored, tasks_for
from .components import Unions, connected_components
from .fingerprints import blocks, chunk_count, codes_of, counted, dealt, mixed, window_hashes, word_hashes

BITS = 40  # of a fingerprint, for counting
MEMBERS = 96  # classes of a block
EXPAND = 1 << 21  # matches of prefix shingles held at once
SALTS = 16  # parts of the classes that share a token and a size
HOT = 1024  # classes whose labels are broadcast at most: those with the most copies


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    out = []
    for part in blocks(texts):
        words, counts = word_hashes(part, lower=True)
        hashes, sizes = window_hashes(words, counts, n)
        ends, word_ends = np.cumsum(sizes), np.cumsum(counts)
        for e, k, we, w in zip(ends.tolist(), sizes.tolist(), word_ends.tolist(), counts.tolist()):
            if k:
                out.append(np.unique(hashes[e - k : e]))
            elif w:
                own, _ = window_hashes(words[we - w : we], np.array([w]), w)
                out.append(mixed(own + np.uint64(w)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _keys(n: int):
    def run(texts):
        sets = shingle_sets(texts, n)
        return np.unique(np.concatenate(sets) >> np.uint64(64 - BITS), return_counts=True)

    return run


def frequency_code(counts: np.ndarray) -> np.ndarray:
    """0 for one document, then quarters of a power of two."""
    return np.where(counts < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


FEATURES = "doc_id long, n_shingles long, sig binary, tokens array<long>, places array<int>, shingles binary"


def _prefixes(n: int, percent: int):
    def run(group: pa.Table, answer: pa.Table) -> pa.Table:
        sets = shingle_sets([(t or "").encode() for t in group.column("text").to_pylist()], n)
        every = np.concatenate(sets or [np.zeros(0, np.uint64)]) >> np.uint64(64 - BITS)
        code = codes_of(answer)[np.unique(every, return_inverse=True)[1]] if len(every) else every
        sig, tokens, places, blobs, at = [], [], [], [], 0
        for s in sets:
            own = code[at : at + len(s)]
            at += len(s)
            sig.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            p = prefix_length(len(s), percent) if len(s) else 0
            alone = int(np.count_nonzero(own == 0))
            if alone >= p:
                tokens.append([])
                places.append([])
                blobs.append(None)
                continue
            order = np.lexsort((s, own))[alone:p]
            tokens.append(s[order].view(np.int64))
            places.append(np.arange(alone, p, dtype=np.int32))
            blobs.append(s.tobytes())
        released()
        return pa.table(
            {
                "doc_id": group.column("doc_id").cast(pa.int64()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "sig": pa.array(sig, pa.binary()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "places": pa.array(places, pa.list_(pa.int32())),
                "shingles": pa.array(blobs, pa.binary()),
            }
        )

    return run


def ngram_features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    chunks = chunk_count(docs)
    placed = dealt(docs, chunks)
    answers = counted(placed, _keys(n), frequency_code, chunks, BITS)
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(n, percent), FEATURES)


def _flat(arrays):
    size = np.array([len(a) for a in arrays], np.int64)
    return np.concatenate(arrays), np.concatenate([[0], np.cumsum(size)[:-1]]), size


class _Side:
    """Classes of one block with their prefixes and sets as flat arrays of local numbers."""

    def __init__(self, rows, shingle_no):
        self.node = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[5] for r in rows], np.int64)
        self.tokens, self.t_at, sizes = _flat([r[2] for r in rows])
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.rest = self.n[self.owner] - 1 - np.concatenate([r[3] for r in rows])
        self.order = np.argsort(self.tokens, kind="stable")
        self.sorted = self.tokens[self.order]
        self.set, self.s_at, self.s_n = _flat([np.searchsorted(shingle_no, r[4]) for r in rows])
        self.hist = np.stack([np.bincount((r[4] >> np.uint64(59)).astype(np.int64), minlength=32) for r in rows])


def prefix_pairs(a: _Side, b: _Side, percent: int):
    """Joins two blocks on prefix shingles: (i, j) that pass the length and the positional filter, each once. With ``a`` and
    ``b`` the same block, i < j."""
    lo = np.searchsorted(b.sorted, a.tokens, "left")
    count = np.searchsorted(b.sorted, a.tokens, "right") - lo
    ends = np.cumsum(count)
    edges = [*np.searchsorted(ends, np.arange(EXPAND, int(ends[-1]) + EXPAND, EXPAND)).tolist()]
    at = 0
    for edge in [a.owner[min(e, len(a.owner) - 1)] for e in edges]:  # whole classes at a time
        stop = int(np.searchsorted(a.owner, edge, "right"))
        if stop <= at:
            continue
        k = count[at:stop]
        which = np.repeat(np.arange(at, stop), k)
        into = b.order[np.arange(len(which)) + np.repeat(lo[at:stop] - np.cumsum(k) + k, k)]
        at = stop
        i, j = a.owner[which], b.owner[into]
        # rows come by the place in a's prefix, so the first of a pair is at its first shared shingle
        _, first = np.unique(i * len(b.n) + j, return_index=True)
        i, j, bound = i[first], j[first], 1 + np.minimum(a.rest[which[first]], b.rest[into[first]])
        need = -(-percent * (a.n[i] + b.n[j]) // (100 + percent))
        ok = (100 * np.minimum(a.n[i], b.n[j]) >= percent * np.maximum(a.n[i], b.n[j])) & (bound >= need)
        if a is b:
            ok &= i < j
        yield i[ok], j[ok], need[ok]


def links_between(left, right, percent: int):
    """Exact links of two blocks (or within one, where ``right`` is None): (i, j) arrays. Rows: node, n, tokens, places, set, weight."""
    rows = left if right is None else left + right
    shingle_no = np.unique(np.concatenate([r[4] for r in rows]))
    a = _Side(left, shingle_no)
    b = a if right is None else _Side(right, shingle_no)
    member = np.zeros(len(shingle_no), bool)
    for i, j, need in prefix_pairs(a, b, percent):
        # suffix filter: what is shared in each range of hashes is at most the smaller count
        ok = np.minimum(a.hist[i], b.hist[j]).sum(axis=1) >= need
        i, j = i[ok], j[ok]
        edge = np.flatnonzero(np.diff(i, prepend=-1))
        for k, js in zip(i[edge].tolist(), np.split(j, edge[1:])):
            own = a.set[a.s_at[k] : a.s_at[k] + a.s_n[k]]
            member[own] = True
            sizes = b.s_n[js]
            ends = np.cumsum(sizes)
            where = np.arange(int(ends[-1])) + np.repeat(b.s_at[js] - ends + sizes, sizes)
            shared = np.add.reduceat(member[b.set[where]].astype(np.int64), ends - sizes)
            member[own] = False
            js = js[100 * shared >= percent * (a.n[k] + b.n[js] - shared)]
            if len(js):
                yield a, b, k, js


def _verifier(percent: int):
    """One bucket of tasks: forest links (a, b, null) and numbers of links (a, null, n)."""

    def run(group: pa.Table) -> pa.Table:
        tasks: dict = {}
        cols = [group.column(c).to_pylist() for c in ("task", "side", "node", "n_shingles", "tokens", "places", "shingles", "copies")]
        for task, side, node, n, tokens, places, shingles, copies in zip(*cols):
            row = (node, n, np.array(tokens, np.int64).view(np.uint64), np.array(places, np.int64), np.frombuffer(shingles, np.uint64), copies)
            tasks.setdefault((task["root"], *task["i"].values(), *task["j"].values()), ([], []))[side].append(row)
        out = []
        for (_, *blocks_met), (left, right) in tasks.items():
            within = blocks_met[:2] == blocks_met[2:]
            if len(left) < 2 if within else not (left and right):
                continue
            u, degree = Unions(), {}
            for a, b, k, js in links_between(left, None if within else right, percent):
                x = a.node[k]
                degree[x] = degree.get(x, 0) + int(b.weight[js].sum())
                for y in js.tolist():
                    degree[b.node[y]] = degree.get(b.node[y], 0) + int(a.weight[k])
                    if u.join(x, b.node[y]):
                        out.append((x, b.node[y], None))
            out += [(x, None, d) for x, d in degree.items()]
        cols = list(zip(*out)) or [[]] * 3
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "links": pa.array(cols[2], pa.int64())})

    return run


def size_band(n, percent: int):
    """Sizes that may link lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / min(percent, 99))) + F.lit(1e-9)).cast("int")


def block_tasks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (root, node, n) -> (task {root, i, j}, side, node): which pairs of blocks a class takes part in. A block is
    a band of sizes and a part by hash; it meets the blocks of its own band and of the next one."""
    members = members.withColumn("band", size_band(F.col("n"), percent))
    parts = members.groupBy("root", "band").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("parts"))
    beside = parts.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    sizes = parts.join(beside, ["root", "band"], "left").join(below, ["root", "band"], "left").na.fill(0, ["above", "below"])
    m = members.join(sizes, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    block = lambda band, part: F.struct(band.alias("band"), part.alias("part"))
    one = lambda i, j, side: F.struct(F.struct(F.col("root"), i.alias("i"), j.alias("j")).alias("task"), F.lit(side).alias("side"))
    own = block(F.col("band"), F.col("part"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(upto(F.col("parts")), lambda o: F.when(o >= F.col("part"), one(own, block(F.col("band"), o), 0)).otherwise(one(block(F.col("band"), o), own, 1)))
    up = F.transform(upto(F.col("above")), lambda o: one(own, block(F.col("band") + 1, o), 0))
    down = F.transform(upto(F.col("below")), lambda o: one(block(F.col("band") - 1, o), own, 1))
    return m.select("node", F.explode(F.concat(within, up, down)).alias("t")).select("t.task", "t.side", "node")


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links) and n_links."""
    made = stored(ngram_features(docs, n, percent), "ngrams")
    known = made.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    able = known.where(F.size("tokens") > 0)
    reps = able.join(classes, (able.sig == classes.sig) & (able.doc_id == classes.rep)).select("rep", "n_shingles", "tokens", "places", "shingles", "copies").dropDuplicates(["rep"])
    # candidate sets: classes with a token link to the least class of their size, sizes that may join link in order
    postings = able.join(classes, (able.sig == classes.sig) & (able.doc_id == classes.rep), "left_semi").select("doc_id", F.col("n_shingles").alias("n"), F.explode("tokens").alias("token"))
    postings = postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))  # splits tokens that many classes share
    local = postings.groupBy("token", "n", "salt").agg(F.min("doc_id").alias("local"))
    same = postings.join(local, ["token", "n", "salt"]).where("doc_id <> local").select(F.col("doc_id").alias("a"), F.col("local").alias("b"))
    lead = local.groupBy("token", "n").agg(F.min("local").alias("lead"))
    same = same.union(local.join(lead, ["token", "n"]).where("local <> lead").select(F.col("local").alias("a"), F.col("lead").alias("b")))
    w = Window.partitionBy("token").orderBy("n")
    chain = lead.select("n", F.col("lead").alias("a"), F.lag("lead").over(w).alias("b"), F.lag("n").over(w).alias("m")).where(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n"))
    sets = connected_components(same.union(chain.select("a", "b")).distinct())
    members = sets.union(sets.select(F.col("root").alias("node"), "root").distinct())
    members = stored(members.join(reps.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n")), "node"), "sets")
    buckets = tasks_for(made, 8 << 20)
    tasks = block_tasks(members, percent).withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets)).cast("int"))
    tasks = tasks.join(reps.withColumnRenamed("rep", "node"), "node")
    verified = stored(tasks.groupBy("bucket").applyInArrow(_verifier(percent), "a long, b long, links long"), "links")
    joined = connected_components(verified.where("b is not null").select("a", "b"))
    degree = verified.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    labels = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    labels = stored(labels.select("sig", "copies", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    # rows of the classes with the most copies are labelled where they are read, the rest by a join on the class
    hot = labels.where("copies > 1").orderBy(F.desc("copies"), "sig").limit(HOT).select("sig", "component", "n_links").collect()
    hot = F.broadcast(made.sparkSession.createDataFrame(hot, "sig binary, component long, n_links long"))
    rows = made.select("doc_id", "n_shingles", "sig")
    some = rows.where("sig is not null")  # documents without shingles have nothing to meet
    rest = some.join(hot, "sig", "left_anti").join(labels.drop("copies"), "sig", "left")
    none = rows.where("sig is null").select("*", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return some.join(hot, "sig").unionByName(rest).unionByName(none).select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).cast("long").alias("component_id"),
        F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )
