"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint
from tripfold.llm.vectors import KEYS, best, dealt, distinct_ids, in_blocks, matrix, one_row_each, one_vector_each, per_block, shard_count, usable

NODES = "dim int, shard int, node int, vec array<double>, ids array<long>, edges array<int>"
FOUND = "query_id long, vec_id long, score double"
#: Candidate lists per block of points searched together, in floats.
HELD = 1 << 22


class Frame:
    """Points and queries moved and scaled, in double precision, to where single precision tells them apart.

    The middle of each component becomes 0 and the typical size of a point 1, whatever the offset or
    unit of the data. Middle and size are medians, so that a few far points do not flatten the others;
    those are cut off at 1e15, far out still. Only the search sees these; scores come from the originals.
    """

    def __init__(self, points: np.ndarray):
        # Halves, as a sum of two of the largest doubles is none.
        self.middle = np.median(points / 2, axis=0) * 2
        with np.errstate(over="ignore"):
            size = np.abs(points - self.middle).max(axis=1)
        size = size[(size > 0) & np.isfinite(size)]
        self.size = float(np.median(size)) if len(size) else 1.0

    def __call__(self, points: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((points - self.middle) / self.size, -1e15, 1e15).astype(np.float32)


class Graph:
    """Out-edges of each point (-1: none) and the point where searches enter."""

    def __init__(self, points: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2):
        self.x = points.astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.width, self.alpha = degree, width, alpha
        # Some places more than the degree, for edges that only keep every point in reach.
        self.edges = np.full((len(points), degree + 8), -1, np.int32)
        self.entry = 0

    @classmethod
    def built(cls, points: np.ndarray, seed: int = 5, **options) -> Graph:
        """Points join in seeded order, in batches that double; then all search once more."""
        graph = cls(points, **options)
        n = len(points)
        graph.entry = int(np.argmin(((graph.x - graph.x.mean(axis=0)) ** 2).sum(axis=1)))
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[graph.entry, order[order != graph.entry]].astype(np.int64)
        at = 1
        while at < n:
            upto = min(n, at + max(16, min(at, 1024)))
            graph.insert(order[at:upto])
            at = upto
        for at in range(0, n, 1024):
            graph.insert(order[at : at + 1024])
        graph.connect()
        return graph

    def beam(self, queries: np.ndarray, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest points met by a greedy search for each query: numbers, distances.

        Every step opens the `ahead` nearest points not yet opened, for all queries at once; a
        query is done when its list holds opened points only. Distances are squared; unused places
        hold -1 and infinity.
        """
        n, slots = len(self.x), self.edges.shape[1]
        block = max(1, min(HELD // (ahead * slots * self.x.shape[1]), (1 << 25) // n))
        parts = [self._beam(queries[i : i + block], ahead) for i in range(0, len(queries), block)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, queries: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        q = queries.astype(np.float32)
        own = np.einsum("ij,ij->i", q, q)
        m, width = len(q), self.width
        lines = np.arange(m)[:, None]
        ids = np.full((m, width), -1, np.int64)
        gap = np.full((m, width), np.inf, np.float32)
        opened = np.ones((m, width), bool)
        seen = np.zeros((m, len(self.x)), bool)
        ids[:, 0], opened[:, 0], seen[:, self.entry] = self.entry, False, True
        gap[:, 0] = self.norm[self.entry] - 2 * (q @ self.x[self.entry]) + own
        active = np.arange(m)
        while len(active):
            rank = np.where(opened[active], np.inf, gap[active])
            picks = np.argpartition(rank, min(ahead, width - 1), axis=1)[:, :ahead]
            fresh = np.isfinite(np.take_along_axis(rank, picks, 1))
            opened[active[:, None], picks] = True
            nodes = np.where(fresh, ids[active[:, None], picks], -1)
            near = np.where((nodes >= 0)[:, :, None], self.edges[nodes], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            bad = (near < 0) | np.c_[np.zeros(len(near), bool), near[:, 1:] == near[:, :-1]]
            bad |= seen[active[:, None], near]
            rows, columns = np.nonzero(~bad)
            seen[active[rows], near[rows, columns]] = True
            # Distances to new points only.
            flat = near[rows, columns]
            who = active[rows]
            d = self.norm[flat] - 2 * np.einsum("ij,ij->i", self.x[flat], q[who]) + own[who]
            new = np.full(near.shape, np.inf, np.float32)
            new[rows, columns] = d
            all_ids = np.concatenate([ids[active], np.where(bad, -1, near)], axis=1)
            all_gap = np.concatenate([gap[active], new], axis=1)
            all_open = np.concatenate([opened[active], bad], axis=1)
            keep = np.argpartition(all_gap, width - 1, axis=1)[:, :width]
            ids[active], gap[active] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_gap, keep, 1)
            opened[active] = np.take_along_axis(all_open, keep, 1)
            active = active[~opened[active].all(axis=1)]
        order = np.argsort(gap, axis=1, kind="stable")
        return ids[lines, order], gap[lines, order]

    def prune(self, points: np.ndarray, ids: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Of each point's candidates (by distance), those that no nearer kept one makes needless.

        A candidate goes if it lies closer to a kept one than to the point, by the factor alpha.
        """
        alive = (ids >= 0) & (ids != points[:, None])
        near = self.x[ids]
        out = np.full((len(points), self.edges.shape[1]), -1, np.int32)
        lines = np.arange(len(points))
        for slot in range(self.degree):
            if not alive.any():
                break
            pick = np.argmax(alive, axis=1)
            has = alive[lines, pick]
            kept = ids[lines, pick]
            out[has, slot] = kept[has]
            apart = self.norm[ids] + self.norm[kept][:, None] - 2 * (near @ self.x[kept][:, :, None])[:, :, 0]
            alive &= self.alpha**2 * apart > gap
            alive[lines, pick] = False
        return out

    def _sorted(self, points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct candidates of each point by distance, -1 last."""
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        apart = self.norm[ids] + self.norm[points][:, None] - 2 * (self.x[ids] @ self.x[points][:, :, None])[:, :, 0]
        gap = np.where(ids < 0, np.inf, np.maximum(apart, 0))
        order = np.argsort(gap, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(gap, order, 1)

    def insert(self, batch: np.ndarray) -> None:
        """New edges for the points of a batch, and back; lists grown too long are pruned."""
        ids, _ = self.beam(self.x[batch])
        for at in range(0, len(batch), 256):
            some = batch[at : at + 256]
            both = np.concatenate([ids[at : at + 256], self.edges[some]], axis=1)
            self.edges[some] = self.prune(some, *self._sorted(some, both))
        edges = self.edges[batch, : self.degree]
        source = np.repeat(batch, self.degree)
        target = edges.reshape(-1)
        source, target = source[target >= 0], target[target >= 0].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owners, starts, counts = np.unique(target, return_index=True, return_counts=True)
        by_count = np.argsort(counts, kind="stable")
        owners, starts, counts = owners[by_count], starts[by_count], counts[by_count]
        at = 0
        while at < len(owners):
            # So many lists that the padded block stays small; a very long list is alone.
            upto = at + 1
            while upto < min(len(owners), at + 256) and (upto + 1 - at) * (counts[upto] + 40) <= 1 << 15:
                upto += 1
            own, most = owners[at:upto], counts[upto - 1]
            back = np.full((len(own), most), -1, np.int64)
            for line, (s, c) in enumerate(zip(starts[at:upto], counts[at:upto], strict=True)):
                back[line, :c] = source[s : s + c]
            ids, gap = self._sorted(own, np.concatenate([self.edges[own].astype(np.int64), back], axis=1))
            size = (ids >= 0).sum(axis=1)
            short = size <= self.degree
            held = np.full((len(own), max(self.edges.shape[1], ids.shape[1])), -1, np.int64)
            held[:, : ids.shape[1]] = ids
            self.edges[own[short]] = held[short][:, : self.edges.shape[1]]
            if (~short).any():
                self.edges[own[~short]] = self.prune(own[~short], ids[~short], gap[~short])
            at = upto

    def reached(self) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        front = np.array([self.entry])
        seen[front] = True
        while len(front):
            near = np.unique(self.edges[front])
            near = near[near >= 0]
            front = near[~seen[near]]
            seen[front] = True
        return seen

    def connect(self) -> None:
        """An edge to each part of the graph that searches could not reach, from a near point."""
        while not (seen := self.reached()).all():
            lost = int(np.argmin(seen))
            ids, _ = self.beam(self.x[[lost]])
            free = [int(i) for i in ids[0] if i >= 0 and (self.edges[i] < 0).any()]
            if not free:
                inside = np.flatnonzero(seen)
                free = [int(i) for i in inside if (self.edges[i] < 0).any()][:1]
            if not free:  # every list is full: the last edge of the nearest gives way
                free = [int(ids[0][0])]
                self.edges[free[0], -1] = -1
            row = self.edges[free[0]]
            row[np.argmax(row < 0)] = lost


def index_shard(frame: pd.DataFrame, **options) -> pd.DataFrame:
    """The graph of a shard as rows, a row per distinct vector with the ids that hold it."""
    frame = distinct_ids(frame)
    points, group = np.unique(matrix(frame["vec"]), axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.argsort(group, kind="stable")
    ids = np.split(frame["vec_id"].to_numpy()[order], np.cumsum(np.bincount(group))[:-1])
    graph = Graph.built(Frame(points)(points), **options)
    # The entry comes first.
    place = np.r_[graph.entry, np.delete(np.arange(len(points)), graph.entry)]
    number = np.empty(len(points), np.int64)
    number[place] = np.arange(len(points))
    edges = [number[e[e >= 0]].astype(np.int32) for e in graph.edges[place]]
    return pd.DataFrame({
        "dim": points.shape[1],
        "shard": frame["shard"].iloc[0],
        "node": np.arange(len(points), dtype=np.int32),
        "vec": list(points[place]),
        "ids": [ids[i] for i in place],
        "edges": edges,
    })


def search_shard(nodes: pd.DataFrame, wanted: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """Each query's k nearest ids among the points its beam search met, by exact distance."""
    nodes = nodes.sort_values("node", kind="stable", ignore_index=True)
    points = matrix(nodes["vec"])
    most = max(1, int(nodes["edges"].map(len).max()))
    frame = Frame(points)
    graph = Graph(frame(points), degree=max(1, most - 8), width=max(width, 2 * k + 2))
    for line, edges in enumerate(nodes["edges"]):
        graph.edges[line, : len(edges)] = edges
    queries = matrix(wanted["vec"])
    near, _ = graph.beam(frame(queries))
    rows = []
    for query_id, q, found in zip(wanted["vec_id"], queries, near, strict=True):
        found = found[found >= 0]
        gap = np.sqrt(((points[found] - q) ** 2).sum(axis=1))
        best_of: list[tuple[float, int]] = []
        for i in np.argsort(gap, kind="stable"):
            if len(best_of) >= k and gap[i] > best_of[-1][0]:
                break
            ids = nodes["ids"][found[i]]
            best_of += [(float(gap[i]), int(v)) for v in ids[: k + 1] if v != query_id]
            best_of = sorted(best_of)[:k]
        rows += [(query_id, v, d) for d, v in best_of]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 1 << 14,
    block_rows: int = 1 << 10,
    width: int = 96,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k nearest found, by Euclidean distance.

    Every row is in the graph of its shard (dealt by id), equal vectors as one point with all their
    ids, so copies do not crowd out other neighbours. Graphs are built once, kept in the shared
    folder, and every block of queries goes to every shard. A query meets rows of its own length
    but not those of its own id; ties go to the smaller vec_id; an id that repeats counts once, with
    its smallest vector. Rows without id and vectors that are NULL, empty, zero or have a NULL or
    non-finite component take no part. Empty tables give no rows.
    """
    rows = one_row_each(usable(vectors, key, vector, float("inf"), zero=False))
    shards = shard_count(rows, shard_rows)
    asked, blocks = in_blocks(
        one_vector_each(usable(queries, key, vector, float("inf"), zero=False)), shards, block_rows
    )
    def built(frame: pd.DataFrame) -> pd.DataFrame:
        return index_shard(frame)

    graphs = checkpoint(dealt(rows, shards).groupBy("dim", "shard").applyInPandas(built, NODES))

    def searched(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(wanted):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search_shard(nodes, wanted, k, width)

    found = per_block(graphs, blocks).groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(searched, FOUND)
    return best(found, k, nearest=True)
