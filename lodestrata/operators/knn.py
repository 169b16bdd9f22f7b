"""Exact nearest neighbours and similar pairs of vectors, by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import materialize


def usable(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, *keep: str) -> DataFrame:
    """(id, v) and the columns to keep, of the rows whose vector is of dim finite numbers that are not all zero, with a known id."""
    v = F.col(vector_col).cast("array<float>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    some = F.exists(v, lambda e: e != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *keep).where(F.col("id").isNotNull() & (F.size("v") == dim) & fine & some)


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(found: DataFrame, of: str, other: str, k: int, by: str = "similarity") -> DataFrame:
    """The k best of each, the smaller id first on a tie; the limit is applied within tasks before the shuffle too."""
    order = Window.partitionBy(of).orderBy(F.desc(by), other)
    # The limit must be on the row number itself for Spark to apply it before the shuffle.
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).withColumn("rank", F.col("_place") - 1).drop("_place")


#: Bytes of query vectors that are broadcast at once; a larger query set takes several passes over the rows.
SENT = 64 << 20


def _blocked(vectors: DataFrame, size: int, mark: str) -> DataFrame:
    """Rows (id, v, part) in blocks of ids, vectors and parts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                block = batch.slice(at, size)
                columns = (block["id"].to_numpy(), matrix(block["v"]).astype(np.float32), block["part"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in columns], [f"{mark}{c}" for c in "ixp"])

    return vectors.mapInArrow(run, ", ".join(f"{mark}{c} binary" for c in "ixp"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, itself: bool = False, within: str | None = None, size: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank) of the k rows of vectors(id, v) most similar to each of queries(id, v).

    With within, a column of both frames, only rows of the query's own value
    count, null as a value. A stated query set meets all rows in blocks: the
    queries are counted (but for a known size, the numbers of all their vectors)
    and sent to every task, SENT bytes at most at once, and
    the rows are read where they lie, without a shuffle; a block of at most 512
    queries and one of at most 8192 rows are one matrix product, of which the k
    best leave the task. The similarity is the cosine in double, rounded to 6
    places. A row is not its own neighbour unless itself is set. Filter before:
    the limit comes last. No rows or no queries give no rows.
    """
    part = F.lit(0).cast("long") if within is None else F.xxhash64(F.col(within).cast("string"), F.col(within).isNull())
    rows, asked = (df.select("id", "v", part.alias("part")) for df in (vectors, queries))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ri"], np.int64), np.frombuffer(r["qi"], np.int64)
                parts, q_parts = np.frombuffer(r["rp"], np.int64), np.frombuffer(r["qp"], np.int64)
                x, q = (unit(np.frombuffer(b, np.float32).reshape(len(i), -1)) for b, i in ((r["rx"], ids), (r["qx"], q_ids)))
                for of in np.intersect1d(parts, q_parts):
                    yield _top(ids[parts == of], x[parts == of], q_ids[q_parts == of], q[q_parts == of], k, itself)

    if size is None:
        size = asked.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    passes = max(1, -(-4 * size // SENT))
    found = None
    for one in range(passes):
        own = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == one)
        met = _blocked(rows, 8192, "r").crossJoin(F.broadcast(_blocked(own, 512, "q"))).mapInArrow(compare, "id long, neighbour long, similarity double")
        found = met if found is None else found.unionByName(met)
    return best(found, "id", "neighbour", k)


def _top(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, itself: bool) -> pa.RecordBatch:
    """The k nearest rows of a block for each query of another, as one batch."""
    s = np.round(q @ x.T, 6)
    if not itself:
        s[q_ids[:, None] == ids[None, :]] = -9
    # All that tie with the k-th stay, for the smaller id to win.
    least = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q_ids), -8.0)
    row, col = np.nonzero(s >= np.maximum(least, -8.0)[:, None])
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), pa.array(s[row, col])], ["id", "neighbour", "similarity"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double, for a few pairs of rows that are already joined."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def similar_pairs(vectors: DataFrame, block: list[str], at_least: float, part: int = 8192) -> DataFrame:
    """(id_a, id_b, cosine): pairs of vectors(id, v, *block) of one block with a cosine of at_least or more, the smaller id first.

    Blocks are cut by a hash into parts of about so many rows; each pair of parts
    is one matrix product in a task of its own, and only the pairs that pass
    leave it. So nothing is missed, and the price is a product for every two
    rows of a block, and a copy of each row for every part of its block. Null
    block columns compare as equal.
    """
    key = F.xxhash64(F.to_json(F.struct(*block)))
    rows = vectors.select("id", "v", key.alias("block"))
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / part).alias("parts"))
    placed = rows.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sent = met.select("id", "v", "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, second, x = t["id"].to_numpy(), t["second"].to_numpy(zero_copy_only=False), unit(matrix(t["v"].combine_chunks()))
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        if t["a"][0].as_py() == t["b"][0].as_py():
            right = left
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 512):
            s = np.round(x[left[at : at + 512]] @ x[right].T, 6)
            i, j = np.nonzero(s >= at_least)
            a, b = ids[left[at + i]], ids[right[j]]
            keep = a != b if right is not left else a < b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[i, j][keep]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"id_a": a, "id_b": b, "cosine": s})

    return sent.groupBy("block", "a", "b").applyInArrow(join, "id_a long, id_b long, cosine double")


def similar_classes(vectors: DataFrame, block: list[str], at_least: float, part: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): similar_pairs() between classes of equal vectors of a block, and members(id, class_id) of all rows.

    A class is known by its smallest id. Copies are never expanded into pairs,
    so a group of any number of copies is one row to compare and a row each
    among the members; no link between different vectors is lost.
    """
    key = F.xxhash64(F.to_json(F.struct(*block)))
    rows = vectors.select("id", "v", *block, key.alias("_block"), F.xxhash64("v").alias("_h1"), F.xxhash64(F.lit(1), "v").alias("_h2"))
    keys = ["_block", "_h1", "_h2"]
    members = materialize(rows.select("id", *keys).join(rows.groupBy(*keys).agg(F.min("id").alias("class_id")), keys).select("id", "class_id"))
    first = members.where("id = class_id").select("id")
    return similar_pairs(rows.join(first, "id", "left_semi").select("id", "v", *block), block, at_least, part), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b, cosine) of all rows of similar_classes(), copies expanded: for what must see every pair."""
    a, b = members.toDF("x", "class_a"), members.toDF("y", "class_b")
    across = pairs.toDF("class_a", "class_b", "cosine").join(a, "class_a").join(b, "class_b").select("x", "y", "cosine")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine")
