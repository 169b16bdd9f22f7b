"""Filling containers of fixed capacity by patterns of few items.

Only the histogram of sizes, bounded by the capacity, reaches the driver:
patterns of up to three sizes that fill a container are enumerated, repeat
counts are fitted to the histogram by non-negative least squares and rounded
down, and what is left over is packed by histogram too, largest first into the
container with the least room. The plan is a short table of patterns with
repeat counts; items find their container by their rank among those of their
size, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranks import spread_rank
from lodestrata.session import materialize

#: Sizes in patterns are multiples of capacity / BINS, rounded up.
BINS = 128


def patterns(bins: int) -> np.ndarray:
    """Counts per size 1..bins of every pattern of one to three sizes that add up to bins."""
    out = []
    for a in range(1, bins + 1):
        for b in range(0, min(a, bins - a) + 1):
            c = bins - a - b
            if c <= b:
                v = np.zeros(bins, np.float64)
                for x in (a, b, c):
                    if x:
                        v[x - 1] += 1
                out.append(v)
    return np.array(out).T


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by accelerated projected gradients."""
    scale = np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - a.T @ (a @ y - b) / scale)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / s * (nxt - x)
        x, t = nxt, s
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, repeats) of the containers that hold every item of the histogram of sizes 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    out: list[tuple[tuple[int, ...], int]] = []
    bins = min(BINS, capacity)
    width = -(-capacity // bins)
    bins = capacity // width
    of = np.minimum(bins, -(-np.arange(capacity + 1) // width))
    a = patterns(bins)
    coarse = np.bincount(of[1:], weights=left[1:], minlength=bins + 1)[1:]
    # Sizes over bins * width cannot share a container by the coarse sizes; they stay for the rest.
    wide = (np.arange(capacity + 1) > bins * width).nonzero()[0]
    coarse[bins - 1] -= left[wide].sum()
    if coarse.sum():
        # Small items fill any gap, so large ones weigh more in the fit.
        weight = np.arange(1, bins + 1) / bins
        fit = np.floor(nnls(a * weight[:, None], coarse * weight) + 1e-6).astype(np.int64)
        for p in np.argsort(-fit, kind="stable"):
            want = int(fit[p])
            need = [int(x) + 1 for x in np.repeat(np.arange(bins), a[:, p].astype(np.int64))][::-1]
            while want > 0:
                # The largest sizes left in each coarse size, so many containers at once as all of them allow.
                taken: list[int] = []
                for coarse_size in need:
                    own = range(min(coarse_size * width, capacity), (coarse_size - 1) * width, -1)
                    size = next((s for s in own if left[s] > taken.count(s)), 0)
                    if not size:
                        break
                    taken.append(size)
                if len(taken) < len(need):
                    break
                n = min(want, *(int(left[s]) // taken.count(s) for s in taken))
                for s in taken:
                    left[s] -= n
                out.append((tuple(taken), n))
                want -= n
    return out + _fill(left, out, capacity)


def _fill(left: np.ndarray, patterned: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs the rest, largest first, into the containers with the least room that do; changes patterned in place."""
    room: dict[int, list[list]] = {}
    full: list[list] = []

    def keep(sizes: tuple[int, ...], n: int, gap: int) -> None:
        (room.setdefault(gap, []) if gap else full).append([sizes, n])

    for sizes, n in patterned:
        keep(sizes, n, capacity - sum(sizes))
    patterned.clear()
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            gap = min((g for g in room if g >= size), default=0)
            if not gap:
                each = capacity // size
                count, n_last = divmod(n, each)
                if count:
                    keep((size,) * each, count, capacity - each * size)
                if n_last:
                    keep((size,) * n_last, 1, capacity - n_last * size)
                n = 0
                continue
            sizes, have = room[gap].pop()
            if not room[gap]:
                del room[gap]
            each = gap // size
            if n >= each:
                used = min(have, n // each)
                keep(sizes + (size,) * each, used, gap - each * size)
                n -= used * each
            else:
                used = 1
                keep(sizes + (size,) * n, 1, gap - n * size)
                n = 0
            if have > used:
                keep(sizes, have - used, gap)
    return [(s, n) for s, n in full] + [(s, n) for kept in room.values() for s, n in kept]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, chars: int = 4) -> DataFrame:
    """(doc_id, piece_no, start, n_chars, tokens, container_id): every item in a container of the capacity.

    Sizes are tokens: 0 for an empty or null text, else the larger of 1 and
    characters div chars. A text over the capacity is cut into pieces of exactly
    the capacity and a last one; every other is one piece of its whole. Items of
    0 tokens need no room and are spread over the containers (container 0 if
    there are no others). Rows with a null id take no part; repeated rows are
    items of their own. The sum of tokens in a container never is over the
    capacity.
    """
    step = capacity * chars
    n = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("chars")).where("doc_id is not null")
    # A remainder of less than a token would need one; it stays with the piece before, whose tokens it does not change.
    items = items.withColumn("count", F.greatest(F.lit(1), F.ceil((F.col("chars") - (chars - 1)) / step)).cast("long"))
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("start", F.col("piece_no") * step)
    items = items.withColumn("n_chars", F.when(F.col("piece_no") == F.col("count") - 1, F.col("chars") - F.col("start")).otherwise(F.lit(step)).cast("long"))
    items = items.withColumn("tokens", F.when(F.col("n_chars") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n_chars") / chars))).cast("long"))
    items = materialize(items.select("doc_id", "piece_no", "start", "n_chars", "tokens"))
    # At most one row for each size up to the capacity.
    histogram = {r["tokens"]: r["count"] for r in items.where("tokens > 0").groupBy("tokens").count().collect()}
    slots, containers = _slots(plan(histogram, capacity))
    ranked = spread_rank(items.where("tokens > 0"), "tokens", F.struct("doc_id", "piece_no"), "rank")
    names = ["doc_id", "piece_no", "start", "n_chars", "tokens"]
    found = ranked.select(*names, "rank").mapInArrow(_placing(slots), "doc_id long, piece_no long, start long, n_chars long, tokens long, container_id long")
    empty = items.where("tokens = 0").select(*names, F.pmod(F.xxhash64("doc_id"), F.lit(max(1, containers))).alias("container_id"))
    return found.unionByName(empty)


def _placing(slots: list[tuple[int, int, int, int]]):
    """Places items by size and rank among those of their size; the plan's slots are few, bounded by the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(sorted(slots), np.int64).reshape(-1, 4)
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            size, rank = batch["tokens"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, (size << 48) + rank, side="right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 2]
            columns = {c: batch[c] for c in batch.schema.names if c != "rank"}
            yield pa.RecordBatch.from_pydict(columns | {"container_id": pa.array(container, pa.int64())})

    return run


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int]], int]:
    """(size, first rank, items a container, first container) of each size in each pattern; the number of containers."""
    used: dict[int, int] = {}
    slots, container = [], 0
    for sizes, repeats in planned:
        for size in set(sizes):
            each = sizes.count(size)
            slots.append((size, used.get(size, 0), each, container))
            used[size] = used.get(size, 0) + each * repeats
        container += repeats
    return slots, container
