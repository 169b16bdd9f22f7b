"""The most similar vectors of every vector, by robust-pruned directed graphs.

Vectors are put into shards of bounded size around centroids fitted on a bounded
sample. Each shard builds one graph in memory: vectors join in growing batches,
a greedy search on the graph so far proposes their neighbours, relaxed distance
pruning keeps diverse edges, and edges back are added and pruned the same way.
Beam searches then answer the queries that ask the shard. All steps run on many
vectors at once as array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import knn
from lodestrata.session import materialize

#: Edges out of a node after pruning, and before it is pruned again; the relaxation of distances in pruning.
DEGREE, SLACK, ALPHA = 16, 24, 1.2
#: Beam widths of the searches that build the graph and of those that answer; nodes expanded at once.
BUILD_BEAM, BEAM, EXPAND = 32, 96, 4
#: Candidates of a node that are looked at in pruning, the nearest.
CAP = 40
#: Vectors searched at once; vectors that join the graph at once; nodes that searches may start from, and how many of them do.
BLOCK, BATCH, GATES, STARTS = 512, 2048, 1024, 8
#: Vectors of a shard on average.
SHARD = 6_000
#: Vectors sampled for centroids: so many at least, so many a shard, and so many at most.
SAMPLE, SAMPLE_EACH, SAMPLE_MOST = 20_000, 16, 400_000
#: Similarities in single precision that differ by less may be equal when rounded to 6 places.
TIE = 4e-6
#: With a positive at_least, a beam full of similarities that fall short by this much at most is too narrow to trust.
DENSE = 0.1
#: Times a beam that is too narrow is widened, once; what does not do either is compared with all nodes of the shard.
WIDER = 4
#: Unit vectors in double whose places differ by no more are of one direction: the rounding of single precision.
SAME = 3e-7


class Graph:
    """A directed graph over unit vectors, for searches from a few gates."""

    def __init__(self, x: np.ndarray, seed: int = 1, degree: int = DEGREE, beam: int = BUILD_BEAM):
        self.order = np.random.default_rng(seed).permutation(len(x))
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.n, self.degree = 0, degree
        self.edges = np.full((len(x), SLACK), -1, np.int32)
        self.sims = np.full((len(x), SLACK), -9, np.float32)
        while self.n < len(x):
            size = min(len(x) - self.n, BATCH, max(512, self.n // 2))
            self._join(np.arange(self.n, self.n + size), beam)

    def _join(self, new: np.ndarray, beam: int) -> None:
        q = self.x[new]
        mates = q @ q.T
        np.fill_diagonal(mates, -9)
        width = min(len(new) - 1, 64 if self.n == 0 else 12)
        ids, sims = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -9, np.float32)
        if width > 0:
            near = np.argpartition(-mates, width - 1, axis=1)[:, :width]
            ids, sims = new[near].astype(np.int32), np.take_along_axis(mates, near, 1)
        if self.n:
            found, close = self.search(q, beam)
            ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, close], 1)
        for at in range(0, len(new), 512):
            rows = new[at : at + 512]
            self.edges[rows, : self.degree], self.sims[rows, : self.degree] = self._prune(ids[at : at + 512], sims[at : at + 512])
        self.n += len(new)
        self._back(new)

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The diverse neighbours among candidates: the nearest is kept, and drops those ALPHA times nearer to it than to the node."""
        if ids.shape[1] > CAP:
            near = np.argpartition(-sims, CAP - 1, axis=1)[:, :CAP]
            ids, sims = np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x.take(np.maximum(ids, 0).ravel(), axis=0).reshape(*ids.shape, -1)
        between = (1 - v @ v.transpose(0, 2, 1)) * ALPHA
        live = sims > -9
        away = 1 - sims
        out, close = np.full((len(ids), self.degree), -1, np.int32), np.full((len(ids), self.degree), -9, np.float32)
        rows = np.arange(len(ids))
        for k in range(self.degree):
            pick = live.argmax(1)
            some = live[rows, pick]
            if not some.any():
                break
            out[some, k], close[some, k] = ids[rows, pick][some], sims[rows, pick][some]
            live &= between[rows, pick] > away
            live[rows, pick] = False
        return out, close

    def _back(self, new: np.ndarray) -> None:
        """Adds the edges back to new nodes, and prunes the nodes that get too many."""
        to, sim = self.edges[new, : self.degree].ravel(), self.sims[new, : self.degree].ravel()
        of = np.repeat(new.astype(np.int32), self.degree)
        keep = to >= 0
        to, sim, of = to[keep], sim[keep], of[keep]
        order = np.lexsort((-sim, to))
        to, sim, of = to[order], sim[order], of[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        nodes = to[first]
        row = np.repeat(np.arange(len(nodes)), np.diff(np.r_[first, len(to)]))
        keep = rank < SLACK
        added, close = np.full((len(nodes), SLACK), -1, np.int32), np.full((len(nodes), SLACK), -9, np.float32)
        added[row[keep], rank[keep]], close[row[keep], rank[keep]] = of[keep], sim[keep]
        known = (added[:, :, None] == self.edges[nodes][:, None, :]).any(2) if len(nodes) * SLACK * SLACK < 2e7 else self._known(added, nodes)
        added[known], close[known] = -1, -9
        ids = np.concatenate([self.edges[nodes], added], 1)
        sims = np.concatenate([self.sims[nodes], close], 1)
        full = (ids >= 0).sum(1) > SLACK
        plain = ~full
        order = np.argsort(-sims[plain], axis=1)[:, :SLACK]
        self.edges[nodes[plain]], self.sims[nodes[plain]] = np.take_along_axis(ids[plain], order, 1), np.take_along_axis(sims[plain], order, 1)
        full = np.flatnonzero(full)
        for at in range(0, len(full), 512):
            part = full[at : at + 512]
            out, close = self._prune(ids[part], sims[part])
            self.edges[nodes[part]], self.sims[nodes[part]] = -1, -9
            self.edges[nodes[part], : self.degree], self.sims[nodes[part], : self.degree] = out, close

    def _known(self, added: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(added.shape, bool)
        for at in range(0, len(nodes), 4096):
            out[at : at + 4096] = (added[at : at + 4096, :, None] == self.edges[nodes[at : at + 4096]][:, None, :]).any(2)
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of a beam for each query, in no order; -1 and -9 where it holds fewer."""
        seen = np.empty(min(BLOCK, len(queries)) * self.n, np.uint8)
        parts = [self._search(queries[at : at + BLOCK], beam, seen) for at in range(0, len(queries), BLOCK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), self.n
        starts = min(STARTS, n, GATES, beam)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -9, np.float32)
        at, first = self._starts(q, starts)
        ids[:, :starts], sims[:, :starts] = at, first
        done = ids < 0
        # The place, from 1 on, of the edge by which a query met a node.
        seen[: b * n] = 0
        seen[(np.arange(b)[:, None] * n + at).ravel()] = 1
        place = np.arange(1, EXPAND * SLACK + 1, dtype=np.uint8)
        active = np.arange(b)
        while len(active):
            open_sims = np.where(done[active], -9, sims[active])
            pick = np.argpartition(-open_sims, EXPAND - 1, axis=1)[:, :EXPAND]
            live = np.take_along_axis(open_sims, pick, 1) > -9
            some = live.any(1)
            active, pick, live = active[some], pick[some], live[some]
            if not len(active):
                break
            done[active[:, None], pick] = True
            near = self.edges.take(np.where(live, ids[active[:, None], pick], 0).ravel(), axis=0)
            near[~live.ravel()] = -1
            near = near.reshape(len(active), -1)
            spot = np.flatnonzero(near >= 0)
            key = ((active * n).astype(np.int32)[:, None] + near).ravel().take(spot)
            fresh = np.flatnonzero(seen.take(key) == 0)
            key, by = key.take(fresh), np.broadcast_to(place, near.shape).ravel().take(spot.take(fresh))
            # Of the edges of one step to the same node, one leaves its place.
            seen[key] = by
            key = key.take(np.flatnonzero(seen.take(key) == by))
            row = key // n
            sim = _dots(q, self.x, row, key - row * n)
            better = np.flatnonzero(sim > sims.min(1).take(row))
            if not len(better):
                continue
            key, sim, row = key.take(better), sim.take(better), row.take(better)
            node = key - row * n
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            count = np.diff(np.r_[head, len(row)])
            rows = row[head]
            width = beam + int(count.max())
            wide_sims = np.full((len(rows), width), -9, np.float32)
            # A node's number, or -2 less it once it was expanded.
            wide_ids = np.full((len(rows), width), -1, np.int32)
            old, finished = ids.take(rows, axis=0), done.take(rows, axis=0)
            wide_sims[:, :beam], wide_ids[:, :beam] = sims.take(rows, axis=0), np.where(finished, -2 - old, old)
            spot = np.arange(len(row)) + np.repeat(np.arange(len(rows)) * width + beam - head, count)
            wide_sims.ravel()[spot], wide_ids.ravel()[spot] = sim, node
            best = np.argpartition(-wide_sims, beam - 1, axis=1)[:, :beam] + (np.arange(len(rows)) * width)[:, None]
            kept = wide_ids.ravel().take(best)
            sims[rows], ids[rows], done[rows] = wide_sims.ravel().take(best), np.where(kept < 0, -2 - kept, kept), kept < 0
        return ids, sims

    def _starts(self, q: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(gates, similarities) of the gates nearest to each query; few queries at once, so that the products stay in the cache."""
        at, close = np.empty((len(q), starts), np.int64), np.empty((len(q), starts), np.float32)
        gates = self.x[: min(GATES, self.n)].T
        for i in range(0, len(q), 64):
            first = q[i : i + 64] @ gates
            at[i : i + 64] = np.argpartition(-first, starts - 1, axis=1)[:, :starts]
            close[i : i + 64] = np.take_along_axis(first, at[i : i + 64], 1)
        return at, close


def _dots(a: np.ndarray, b: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Products of pairs (row of a, row of b); 1,024 at once are gathered in the cache."""
    out = np.empty(len(row), np.float32)
    x, y = np.empty((1024, a.shape[1]), np.float32), np.empty((1024, a.shape[1]), np.float32)
    for at in range(0, len(row), 1024):
        n = min(1024, len(row) - at)
        # Without "clip", take() writes through a copy.
        a.take(row[at : at + n], axis=0, out=x[:n], mode="clip")
        b.take(node[at : at + n], axis=0, out=y[:n], mode="clip")
        np.vecdot(x[:n], y[:n], out=out[at : at + n])
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return knn.unit(v).astype(np.float32)


def directions(u: np.ndarray) -> np.ndarray:
    """A number for each of the unit vectors, equal for vectors of one direction but for rounding; a few of those may differ too."""
    times = np.random.default_rng(2).integers(-(2**62), 2**62, u.shape[1])
    key = np.concatenate([(np.round(u[at : at + 8192] * 1e5).astype(np.int64) * times).sum(1) for at in range(0, len(u), 8192)])
    of, left = np.arange(len(u)), np.arange(len(u))
    # Vectors that share a key but not a direction are looked at again; what is still left is on its own.
    for _ in range(8):
        _, first, back = np.unique(key[left], return_index=True, return_inverse=True)
        least = left[first][back]
        same = np.abs(u[left] - u[least]).max(1) <= SAME
        of[left[same]] = least[same]
        left = left[~same]
        if not len(left):
            break
    return np.unique(of, return_inverse=True)[1]


class _Held:
    """The rows of a shard by id. Rows of one direction are one node of the graph, so they do not crowd it."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, asked: np.ndarray, beam: int):
        order = np.argsort(ids)
        self.ids, self.raw, self.asked = ids[order], raw[order], asked[order]
        u = knn.unit(self.raw)
        self.of = directions(u)
        self.members = np.argsort(self.of, kind="stable")
        self.count = np.bincount(self.of)
        self.first = np.cumsum(self.count) - self.count
        own = self.members[self.first]
        #: How far a node's rows lie from the one that stands for it.
        self.spread = np.zeros(len(own))
        np.maximum.at(self.spread, self.of, np.linalg.norm(u - u[own[self.of]], axis=1))
        self.graph = Graph(u[own].astype(np.float32), beam=beam)

    def rows(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
        """How many rows of each node must be looked at: those of the k + 1 smallest ids, or all where some may round otherwise."""
        count = np.minimum(self.count[node], k + 1)
        many = np.flatnonzero(self.count[node] > k + 1)
        close = _cosines(queries, self.raw, row[many], self.members[self.first[node[many]]]) * 1e6
        unsure = np.abs(close - np.floor(close) - 0.5) <= self.spread[node[many]] * 1e6 + 1e-6
        count[many[unsure]] = self.count[node[many[unsure]]]
        return count


def nearest(held: _Held, queries: np.ndarray, query_ids: np.ndarray, k: int, at_least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, id, similarity) of the k nearest others in a shard, cosines in double rounded to 6 places.

    A beam that ends in a tie with the k-th, or that is full of vectors of nearly
    a positive at_least, is too narrow: its query is searched again with a wider
    one, and if that is full too, compared with all vectors of the graph. own:
    the queries' nodes, if they are of this shard.
    """
    q, graph = unit(queries), held.graph
    parts, left, width = [], np.arange(len(q)), max(beam, k + 1, EXPAND)
    for width in (width, width * WIDER):
        found, sims = graph.search(q[left], width)
        # The query itself may be among the k + 1 best.
        best, last = -np.partition(-sims, k, axis=1)[:, k], sims.min(1)
        least = np.maximum(best - TIE, at_least - 1e-4)
        full = (last > -9) & ((last >= least) | (at_least > 0) & (last >= at_least - DENSE))
        row, col = np.nonzero((found >= 0) & (sims >= least[:, None]) & ~full[:, None])
        row, node = left[row], graph.order[found[row, col]]
        if own is not None:
            add = left[~full]
            key = np.unique(np.concatenate([row * len(held.count) + node, add * len(held.count) + own[add]]))
            row, node = key // len(held.count), key % len(held.count)
        parts.append(_exact(held, queries, query_ids, row, node, k, at_least))
        left, least = left[full], least[full]
        if not len(left):
            break
    for at in range(0, len(left), 64):
        row, node = np.nonzero(q[left[at : at + 64]] @ graph.x.T >= least[at : at + 64, None])
        parts.append(_exact(held, queries, query_ids, left[at : at + 64][row], graph.order[node], k, at_least))
    row, other, similarity = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, other, similarity


def _cosines(a: np.ndarray, b: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cosines in double of pairs (row of a, row of b)."""
    out = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        x, y = a.take(row[at : at + (1 << 16)], axis=0).astype(np.float64), b.take(node[at : at + (1 << 16)], axis=0).astype(np.float64)
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x)) / np.sqrt(np.einsum("ij,ij->i", y, y))
    return out


def _exact(held: _Held, queries: np.ndarray, query_ids: np.ndarray, row: np.ndarray, node: np.ndarray, k: int, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (row of queries, in order; node) as rows with their exact similarity, the k best of each row."""
    count = held.rows(queries, row, node, k)
    parts, total, at = [], np.cumsum(count), 0
    while at < len(row) or not parts:
        # About a million rows at once, and all of a query.
        to = np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")
        to = max(np.searchsorted(row, row[to]), np.searchsorted(row, row[at], "right")) if to < len(row) else len(row)
        n = count[at:to]
        of = np.repeat(row[at:to], n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        parts.append(_best_rows(held, queries, query_ids, of, held.members[np.repeat(held.first[node[at:to]], n) + place], k, at_least))
        at = to
    row, other, exact = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, other, exact


def _best_rows(held: _Held, queries: np.ndarray, query_ids: np.ndarray, row: np.ndarray, of: np.ndarray, k: int, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    exact = np.round(_cosines(queries, held.raw, row, of), 6)
    keep = (exact >= at_least) & (held.ids[of] != query_ids[row])
    row, other, exact = row[keep], held.ids[of[keep]], exact[keep]
    order = np.lexsort((other, -exact, row))
    row, other, exact = row[order], other[order], exact[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[keep], other[keep], exact[keep]


def centroids(x: np.ndarray, count: int, rounds: int = 8, cut: bool = True) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors, in two levels beyond 256 clusters; those of over twice the usual size are cut again."""
    if count > 256:
        top = centroids(x, int(np.sqrt(count)), rounds)
        of = _closest(x, top)
        return np.concatenate([centroids(x[of == k], max(1, round(count * (of == k).mean())), rounds) for k in np.unique(of)])
    c = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        of = _closest(x, c)
        for k in range(count):
            own = x[of == k]
            if len(own):
                m = own.mean(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    of = _closest(x, c)
    size = np.bincount(of, minlength=count)
    large = np.flatnonzero(size > 2 * len(x) / count) if cut and count > 1 else []
    parts = [centroids(x[of == k], int(np.ceil(size[k] * count / len(x))), rounds, False) for k in large]
    return np.concatenate([np.delete(c, large, 0), *parts]) if len(large) else c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[at : at + 8192] @ c.T).argmax(1) for at in range(0, len(x), 8192)])


def neighbours(vectors: DataFrame, k: int = 10, at_least: float = -2.0, queries: DataFrame | None = None, gap: float | None = None, shard: int = SHARD, sample: int = SAMPLE, beam: int = BEAM, build_beam: int = BUILD_BEAM) -> DataFrame:
    """(id, neighbour, similarity) of the k most similar other rows of every row of vectors(id, v), as knn.usable() gives them.

    With queries, a frame (id), only those rows are asked for, against all. The
    similarity is the cosine in double, rounded to 6 places; on a tie the
    smaller id comes first, and no neighbour below at_least is given. The search
    is approximate: a true neighbour can be missed.

    Every row lives in the shard of its nearest centroid and is searched, by a
    beam search on the shard's graph, in each shard whose centroid is less
    similar to it by gap at most, or in every shard if gap is None. With a gap
    and no queries, a pair found from one side counts for the other too, so only
    one of the two must ask the other's shard. How many shards a row asks hardly
    grows with their number, and so does the work; what is missed by not asking
    is measured for several numbers of shards (see the README).

    Rows of equal vectors are one node, so copies neither crowd the graph nor
    each other out: their k + 1 smallest ids stand for them. So are, within a
    shard, rows of one direction, whatever their length. A cluster of over twice
    the stated size is split into several shards by a hash, all of which are
    asked where one is. Ids must be unique; an empty frame gives no rows.

    The centroids are fitted on a bounded sample, the rows that come first by a
    hash of their id: sample rows, SAMPLE_EACH a shard if that is more, at most
    SAMPLE_MOST. Every row is indexed. A shard is built and searched by one task
    that holds its vectors and streams its queries, so a task's memory is
    bounded by the size of a shard.
    """
    rows = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    least = rows.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    members = materialize(rows.select("id", "h1", "h2").join(least.where("n > 1"), ["h1", "h2"]).select("id", "node"))
    copies = members.where("id <> node").select("id")
    nodes = vectors.select("id", "v").join(copies, "id", "left_anti")
    if queries is None:
        nodes = nodes.withColumn("asked", F.lit(True))
    else:
        of = queries.select("id").join(members, "id", "left").select(F.coalesce("node", "id").alias("id"), F.lit(True).alias("asked")).distinct()
        nodes = nodes.join(of, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    nodes = materialize(nodes)
    shards = _Shards(nodes, shard, sample, gap)
    sent = nodes.mapInArrow(shards.route, "shard int, away boolean, id long, asked boolean, v array<float>")
    sent = sent.repartitionById(shards.count, F.col("shard")).sortWithinPartitions("shard", "away")
    found = sent.mapInArrow(_answers(k, at_least, beam, build_beam), "node long, other long, similarity double")
    if gap is not None and queries is None:
        # Others may be copies' stand-ins by direction, never copies that are left out, so both ends are nodes.
        found = found.select(F.explode(F.array(F.struct("node", "other", "similarity"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"), "similarity"))).alias("e")).select("e.*").distinct()
    if shards.count > 1:
        found = _best(found, "node", "other", k)
    # Copies: a neighbour stands for its smallest ids, an asked node for all of its rows, and copies are neighbours of each other.
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1).select(F.col("node").alias("other"), F.col("id").alias("neighbour"))
    found = found.join(few, "other", "left").select("node", F.coalesce("neighbour", "other").alias("neighbour"), "similarity")
    own = few.select(F.col("other").alias("node"), "neighbour", F.lit(1.0).alias("similarity")).where(F.lit(1.0) >= at_least)
    out = found.unionByName(own).join(members, "node", "left").select(F.coalesce("id", "node").alias("id"), "neighbour", "similarity").where("id <> neighbour")
    if queries is not None:
        out = out.join(queries.select("id").distinct(), "id", "left_semi")
    return _best(out, "id", "neighbour", k)


def _best(found: DataFrame, of: str, other: str, k: int) -> DataFrame:
    """The k best of each; the limit is applied within tasks before the shuffle too."""
    order = Window.partitionBy(of).orderBy(F.desc("similarity"), other)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


class _Shards:
    """Where a vector lives and which shards its query asks."""

    def __init__(self, nodes: DataFrame, shard: int, sample: int, gap: float | None):
        self.gap = np.inf if gap is None else gap
        self.parts, self.centres = np.ones(1, np.int64), np.zeros((1, 1), np.float32)
        clusters = max(1, -(-nodes.count() // shard))
        if clusters > 1:
            some = min(max(sample, SAMPLE_EACH * clusters), SAMPLE_MOST)
            rows = nodes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(some).toArrow()
            self.centres = centroids(unit(knn.matrix(rows["v"].combine_chunks())), min(clusters, rows.num_rows))
            self.parts = np.ones(len(self.centres), np.int64)
            # One count for each shard's worth of vectors.
            for r in nodes.select("v").mapInArrow(self._home, "cluster int, n long").groupBy("cluster").agg(F.sum("n").alias("n")).collect():
                self.parts[r["cluster"]] = max(1, -(-r["n"] // (2 * shard)))
        self.first = np.r_[0, np.cumsum(self.parts)]
        self.count = int(self.first[-1])

    def _close(self, v: pa.Array) -> np.ndarray:
        return unit(knn.matrix(v)) @ self.centres.T

    def _home(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, n = np.unique(self._close(batch["v"]).argmax(1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(n, pa.int64())], ["cluster", "n"])

    def route(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids, asked = batch["id"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)
                close = np.zeros((len(ids), 1)) if len(self.parts) == 1 else self._close(batch["v"])
                near = close.argmax(1)
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                home = self.first[near] + (spread % self.parts[near].astype(np.uint64)).astype(np.int64)
                row, cluster = np.nonzero(asked[:, None] & (close >= close.max(1, keepdims=True) - self.gap))
                # All parts of the clusters asked, but for the row's own.
                n = self.parts[cluster]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, to = np.repeat(row, n), np.repeat(self.first[cluster], n) + part
                away = to != home[row]
                yield self._sent(batch, np.arange(len(ids)), home, False)
                if away.any():
                    yield self._sent(batch, row[away], to[away], True)

    def _sent(self, batch: pa.RecordBatch, row: np.ndarray, shard: np.ndarray, away: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(row), away)), batch["id"].take(pa.array(row)), batch["asked"].take(pa.array(row)), batch["v"].take(pa.array(row))], ["shard", "away", "id", "asked", "v"])


def _answers(k: int, at_least: float, beam: int, build_beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own: _Held | None = None
        now = -1

        def reply(query_ids: np.ndarray, queries: np.ndarray, nodes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(query_ids), 8192):
                row, other, similarity = nearest(own, queries[at : at + 8192], query_ids[at : at + 8192], k, at_least, beam, None if nodes is None else nodes[at : at + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at : at + 8192][row]), pa.array(other), pa.array(similarity)], ["node", "other", "similarity"])

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal own, held
            ids, raw, asked = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            own = _Held(ids, raw, asked, build_beam)
            rows = np.flatnonzero(own.asked)
            yield from reply(own.ids[rows], own.raw[rows], own.of[rows])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, away = batch["shard"].to_numpy(), batch["away"].to_numpy(zero_copy_only=False)
            bid, basked, v = batch["id"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False), knn.matrix(batch["v"])
            for s in np.unique(shard):
                if s != now:
                    if held:
                        yield from build()
                    now, own = s, None
                home = (shard == s) & ~away
                if home.any():
                    held.append((bid[home], v[home].copy(), basked[home]))
                out = (shard == s) & away
                if out.any():
                    if held:
                        yield from build()
                    if own is not None:
                        yield from reply(bid[out], v[out])
        if held:
            yield from build()

    return run


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(id, neighbour, similarity) as neighbours() gives them, by brute force for a stated query set (id)."""
    asked = vectors.join(queries.select("id").distinct(), "id", "left_semi")
    return knn.nearest(vectors, asked, k).select("id", "neighbour", "similarity")
