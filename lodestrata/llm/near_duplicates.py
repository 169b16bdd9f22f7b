"""Near-duplicate texts by a count-vector R-tree.

The word shingles of a text are hashed into groups; the numbers of its shingles
per group are a point. Two texts share at most the sum of the coordinate-wise
minima of their points, and the texts under two tree nodes at most that of the
nodes' upper corners. Trees are packed over bounded buckets of a block's texts,
pairs of nodes are followed down while the bound allows the threshold, and the
pairs of texts that remain are verified on their exact shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.components import connected_components
from lodestrata.session import materialize, spread

WORD = re.compile(r"[a-z0-9]+")
#: Weight of the texts that one bucket holds at most, unless it holds one text only: their distinct shingles, at least LIGHT a text.
BUCKET, LIGHT = 4_000_000, 200
#: Copies of a set that may reach its bucket.
MANY = 4
#: Groups that shingles are hashed into, for each shingle of a middling text.
GROUPS_PER_SHINGLE = 1.5
#: Children of a tree node, and points of a leaf.
FAN, LEAF = 8, 64
#: Bytes of a shingle's hash that are kept.
WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the runs of k successive words of a text."""

    def __init__(self, k: int):
        import xxhash

        self.k, self.hash, self.known = k, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(words) < self.k:
            return np.empty(0, np.uint64)
        if len(self.known) > 1_000_000:
            self.known.clear()
        known, digest = self.known, self.hash
        codes = np.fromiter([known[w] if w in known else known.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
        n = len(words) - self.k + 1
        h = np.zeros(n, np.uint64)
        for i in range(self.k):
            h = _mix(h * _MIX + codes[i : i + n])
        h >>= np.uint64(64 - 8 * WIDTH)
        h.sort()
        return h[np.r_[True, h[1:] != h[:-1]]]


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :WIDTH] = raw
    return out.view("<u8").ravel()


def _shingled(docs: DataFrame, k: int) -> DataFrame:
    """(id, block, size, sig, shingles) of the texts with shingles."""
    kinds = [("id", pa.int64()), ("block", pa.string()), ("size", pa.int64()), ("sig", pa.int64()), ("shingles", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(k)
        for batch in batches:
            rows: list[tuple] = []
            for i, block, text in zip(batch["id"].to_pylist(), batch["block"].to_pylist(), batch["text"], strict=True):
                h = shingle(text.as_py())
                if len(h):
                    packed = _pack(h)
                    rows.append((i, block, len(h), xxhash.xxh3_64_intdigest(packed) - (1 << 63), packed))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds))

    return docs.mapInArrow(run, "id long, block string, size long, sig long, shingles binary")


def _counts(sets: list[np.ndarray], groups: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(sets), dtype=np.int64), [len(h) for h in sets])
    flat = np.concatenate(sets) % np.uint64(groups)
    return np.bincount(rows * groups + flat.astype(np.int64), minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def _minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of a with all of b: products of the indicators count >= 1, >= 2, ..."""
    top = int(min(a.max(initial=0), b.max(initial=0)))
    out = np.zeros((len(a), len(b)), np.float32)
    for t in range(1, top + 1):
        x, y = a >= t, b >= t
        cols = np.flatnonzero(x.any(0) & y.any(0))
        if len(cols) < a.shape[1] // 2:
            x, y = x[:, cols], y[:, cols]
        out += x.astype(np.float32) @ y.T.astype(np.float32)
    return out


class CountTree:
    """An R-tree packed over count vectors: leaves hold points of near size that begin with near minimal hashes."""

    def __init__(self, sets: list[np.ndarray], groups: int):
        size = np.array([len(h) for h in sets], np.int64)
        low = np.array([_mix(h * _MIX).min() for h in sets], np.uint64)
        slab = np.empty(len(sets), np.int64)
        slab[np.argsort(size, kind="stable")] = np.arange(len(sets)) // (LEAF * FAN)
        self.order = np.lexsort((size, low, slab))
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]
        self.points = _counts(self.sets, groups)
        self.levels = [self._level(self.points, self.size, self.size, LEAF)]
        while len(self.levels[-1][0]) > FAN:
            hi, small, large = self.levels[-1]
            self.levels.append(self._level(hi, small, large, FAN))

    @staticmethod
    def _level(hi: np.ndarray, small: np.ndarray, large: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(0, len(hi), fan)
        return np.maximum.reduceat(hi, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)

    def leaves(self, hi: np.ndarray, small: int, large: int, share: float, tau: float) -> np.ndarray:
        """Leaves that may hold a partner of a node with upper corner hi and sizes small to large."""
        live = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            his, smalls, larges = self.levels[depth]
            live = live[(smalls[live] * tau <= large + 1e-9) & (small * tau <= larges[live] + 1e-9)]
            if len(live):
                live = live[np.minimum(his[live], hi).sum(1) + 1e-6 >= share * (np.maximum(smalls[live], small * tau) + np.maximum(small, smalls[live] * tau))]
            if depth:
                below = len(self.levels[depth - 1][0])
                live = (live[:, None] * FAN + np.arange(FAN)).ravel()
                live = live[live < below]
        return live


def tree_join(left: CountTree, right: CountTree, tau: float) -> Iterator[tuple[int, int, int]]:
    """(i, j, shared) of the pairs of points with a Jaccard similarity of tau or more; for left is right, each pair once."""
    share = tau / (1 + tau)
    n, m = len(left.sets), len(right.sets)
    for leaf, (hi, small, large) in enumerate(zip(*left.levels[0], strict=True)):
        rows = np.arange(leaf * LEAF, min(n, (leaf + 1) * LEAF))
        found = right.leaves(hi, small, large, share, tau)
        if left is right:
            found = found[found >= leaf]
        for at in range(0, len(found), 64):
            cols = (found[at : at + 64, None] * LEAF + np.arange(LEAF)).ravel()
            cols = cols[cols < m]
            need = share * (left.size[rows][:, None] + right.size[cols][None, :])
            a, b = np.nonzero(_minima(left.points[rows], right.points[cols]) + 1e-3 >= need)
            for i, j in zip(rows[a].tolist(), cols[b].tolist()):
                if left is not right or i < j:
                    x, y = left.sets[i], right.sets[j]
                    if len(x) > len(y):
                        x, y = y, x
                    if len(x) < tau * len(y) - 1e-9:
                        continue
                    spot = np.searchsorted(y, x)
                    spot[spot == len(y)] = 0
                    shared = int((y[spot] == x).sum())
                    if shared >= tau * (len(x) + len(y) - shared) - 1e-9:
                        yield i, j, shared


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, block: list, tau: float = 0.6, k: int = 3, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of texts alike within a block.

    members(id, block, class_id): every text with its class, the smallest id of
    the texts of the block with the same set of shingles. pairs(id_a, id_b,
    similarity): two classes whose sets have a Jaccard similarity of tau or
    more, smaller id first. So copies are never expanded, and no link between
    different texts is lost. Shingles are compared by hashes of WIDTH bytes.

    Texts are cut into lower-cased runs of [a-z0-9]; a set holds all runs of k
    successive words, so a text of fewer words than k (an empty or null one
    too) has no set, is in no class and like nothing. Rows with a null id take
    no part; repeated rows change nothing, and of different texts under one id
    each pairs that id with others, never with itself. In a block column null
    equals null and nothing else.

    A block larger than a bucket is cut into buckets by size of set, from a
    histogram and without sorting the block in one task; only pairs of buckets
    whose sizes can reach tau meet, each pair in a task of its own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.to_json(F.struct(*[c.alias(f"b{i}") for i, c in enumerate(block)])).alias("block"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = spread(rows)
    # The texts are read and cut once; what follows reads the columns it needs of this table.
    full = materialize(_shingled(rows, k))
    thin = full.select("id", "block", "size", "sig")
    least = thin.groupBy("block", "sig", "size").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    classed = materialize(thin.join(least, ["block", "sig", "size"]))
    # Copies of a set fall into one bucket, where they are put together; those of a set with many are left out before.
    many = materialize(classed.where(f"id <> class_id and copies > {MANY}").select("id", "sig").distinct())

    # Buckets of the blocks: cumulative weight before each size, ties spread by the set's signature.
    heavy = classed.where("id = class_id").groupBy("block", "size").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("block").orderBy("size")
    heavy = heavy.withColumn("weight", F.col("n") * F.greatest("size", F.lit(LIGHT))).withColumn("before", F.sum("weight").over(upto) - F.col("weight"))
    heavy = heavy.withColumn("first", F.floor(F.col("before") / bucket)).withColumn("last", F.floor((F.col("before") + F.col("weight") - 1) / bucket))
    spans = heavy.withColumn("bucket", F.explode(F.sequence("first", "last")))
    ranges = spans.groupBy("block", "bucket").agg(F.min("size").alias("small"), F.max("size").alias("large"))
    large = ranges.where("bucket > 0").select("block").distinct()
    cut = materialize(heavy.join(large, "block", "left_semi").select("block", "size", "before", "weight"))
    ranges = ranges.join(large, "block", "left_semi")
    other = ranges.select(F.col("block"), F.col("bucket").alias("bucket_b"), F.col("small").alias("small_b"), F.col("large").alias("large_b"))
    met = ranges.join(other, "block").where(f"bucket <= bucket_b and small_b * {tau} <= large")
    ends = met.select("block", "bucket", F.struct("bucket", "bucket_b", F.lit(0).alias("side")).alias("task")).unionByName(met.where("bucket < bucket_b").select("block", F.col("bucket_b").alias("bucket"), F.struct("bucket", "bucket_b", F.lit(1).alias("side")).alias("task")))
    tasks = materialize(ends.groupBy("block", "bucket").agg(F.collect_list("task").alias("tasks")))

    salted = full.join(many, ["id", "sig"], "left_anti").join(cut, ["block", "size"], "left").withColumn("bucket", F.coalesce(F.floor((F.col("before") + F.pmod(F.col("sig"), F.col("weight"))) / bucket), F.lit(0)))
    sent = salted.join(tasks, ["block", "bucket"], "left").withColumn("task", F.explode(F.coalesce("tasks", F.array(F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("bucket_b"), F.lit(0).alias("side"))))))
    sent = sent.select("id", "shingles", F.xxhash64("block", "task.bucket", "task.bucket_b").alias("task_id"), "block", "task.side")
    pairs = sent.groupBy("task_id", "block").applyInArrow(_join_of(tau), "id_a long, id_b long, similarity double")
    # Repeated rows of one id meet the same partners again.
    return pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity")), classed.select("id", "block", "class_id").distinct()


def _join_of(tau: float):
    def join(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        # Of equal sets the smallest id stands for all.
        least: dict[tuple, int] = {}
        for i, s, b in zip(table["id"].to_pylist(), side.tolist(), table["shingles"].to_pylist(), strict=True):
            if i < least.get((s, b), i + 1):
                least[s, b] = i
        side = np.array([s for s, _ in least], np.int64)
        ids = np.array(list(least.values()), np.int64)
        sets = [_unpack(b) for _, b in least]
        middling = float(np.median([len(h) for h in sets]))
        groups = 1 << int(np.clip(np.ceil(np.log2(GROUPS_PER_SHINGLE * middling)), 6, 16))
        trees, names = [], []
        for s in (0, 1):
            at = np.flatnonzero(side == s)
            if len(at):
                tree = CountTree([sets[i] for i in at], groups)
                trees.append(tree)
                names.append(ids[at][tree.order])
        out: list[tuple[int, int, float]] = []
        for i, j, shared in tree_join(trees[0], trees[-1], tau):
            a, b = int(names[0][i]), int(names[-1][j])
            if a != b:
                union = len(trees[0].sets[i]) + len(trees[-1].sets[j]) - shared
                out.append((min(a, b), max(a, b), shared / union))
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"id_a": pa.array(a, pa.int64()), "id_b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return join


def alike_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) of all texts alike, copies expanded: for results that must name every pair."""
    m = members.select("class_id", "id")
    a, b = m.toDF("class_a", "x"), m.toDF("class_b", "y")
    across = pairs.select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b")).join(a, "class_a").join(b, "class_b").select("x", "y")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per text; group_id is the smallest id connected by likeness, n_links the links of its class to other classes."""
    pairs = materialize(pairs)
    groups = connected_components(pairs, "id_a", "id_b").select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    links = pairs.select(F.col("id_a").alias("class_id")).unionByName(pairs.select(F.col("id_b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = members.join(groups, "class_id", "left").join(links, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
