"""Exact top-k inner products by dual-tree search of cover trees."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import saved

#: The expansion of the levels: a child's scale is at most its parent's divided by this.
BASE = 1.3
#: Points of a leaf, at most; bytes of vectors in a block of candidates, and of queries; candidate blocks in one lot.
LEAF, CANDIDATE_BYTES, QUERY_BYTES, LOT_BLOCKS = 64, 4 << 20, 512 << 10, 16
#: Tasks of the search, at most; further lots follow each other.
MOST_TASKS = 20_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Indexed:
    """Integer vectors in the order of their cover tree.

    A node of level i holds points within BASE**i of its centre. Its children are centred on points of its own that are
    more than BASE**(i-1) apart from each other and cover all its points within that distance, the node's centre first;
    each has the level of its own farthest point, so levels without a branch are left out. A node of at most LEAF points
    or of equal points is a leaf; neighbouring small children share one. Nodes are numbered so that a node's children
    lie together, points so that each node is a range [lo, hi). radius is that of the farthest point.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points = vectors.astype(np.float64)
        order = np.arange(len(points))
        nodes: list[tuple[int, int, int, int]] = []  # lo, hi, first child, end of children
        centres: list[np.ndarray] = []
        queue = [(order, 0)] if len(points) else []
        self.levels: list[int | None] = [None] * len(queue)
        for own, lo in queue:  # grows while it is read
            hi, begin = lo + len(own), len(queue)
            order[lo:hi] = own
            mine = points[own]
            leaf = len(own) <= LEAF
            centre = mine.mean(axis=0) if leaf else mine[0]
            radius = np.sqrt(((mine - centre) ** 2).sum(axis=1).max())
            if not leaf and radius > 0:
                level = math.ceil(math.log(radius, BASE))
                self.levels[len(nodes)] = level
                for part in self._net(mine - centre, min(BASE ** (level - 1), radius / 1.01)):
                    queue.append((own[part], lo))
                    self.levels.append(None)
                    lo += len(part)
            nodes.append((hi - len(own), hi, begin, len(queue)))
            centres.append(np.append(centre, radius))
        self.lo, self.hi, self.first, self.end = (np.array(x, dtype=np.int64) for x in zip(*nodes, strict=True)) if nodes else [np.empty(0, np.int64)] * 4
        both = np.array(centres) if nodes else np.empty((0, vectors.shape[1] + 1))
        self.centre, self.radius = both[:, :-1], both[:, -1]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.leaf = self.first == self.end
        self.ids, self.floats, self.whole = ids[order], points[order], vectors[order]
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.longest = float(self.norms.max(initial=0.0))

    @staticmethod
    def _net(points: np.ndarray, cover: float) -> list[np.ndarray]:
        """The points' numbers by the first of a net that covers them; parts that fit a leaf together are joined."""
        squares = (points**2).sum(axis=1)
        alive, parts = np.ones(len(points), dtype=bool), []
        small: list[np.ndarray] = []
        held, step = 0, 8  # a net is often small, so the first looks are few
        while alive.any():
            some = np.flatnonzero(alive)[:step]
            step = min(256, 2 * step)
            far = np.maximum(squares[None, :] + squares[some][:, None] - 2 * (points[some] @ points.T), 0)
            for row, c in zip(far, some.tolist(), strict=True):
                if not alive[c]:
                    continue
                alive[c] = False
                near = np.flatnonzero(alive & (row <= cover * cover))
                alive[near] = False
                near = np.append(c, near)
                if len(near) > LEAF:
                    parts.append(near)
                    continue
                if held + len(near) > LEAF:
                    parts.append(np.concatenate(small))
                    small, held = [], 0
                small.append(near)
                held += len(near)
        return [*parts, *([np.concatenate(small)] if small else [])]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))


def products(queries: Indexed, rows: np.ndarray, points: Indexed, part: np.ndarray) -> np.ndarray:
    """Exact inner products as int64. float64 is exact below 2**53; int64 up to 2**63; beyond, Python's integers, whose
    products must fit a long."""
    most = queries.longest * points.longest
    if most < 2**52:
        return (queries.floats[rows] @ points.floats[part].T).astype(np.int64)
    if most < 2**62:
        return queries.whole[rows] @ points.whole[part].T
    exact = queries.whole[rows].astype(object) @ points.whole[part].T.astype(object)
    if exact.size and (max(exact.flat) > _MOST or min(exact.flat) <= _LEAST):
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class Search:
    """The best k of each query of a block so far, over the candidate blocks that it has met."""

    def __init__(self, queries: Indexed, k: int) -> None:
        self.queries = queries
        self.scores = np.full((len(queries.ids), k), _LEAST)
        self.found = np.full((len(queries.ids), k), _MOST)
        self.scored = self.met = 0

    def add(self, points: Indexed) -> None:
        """Descends pairs of nodes. No product of two nodes' points is over <cq, cp> + |cq| rp + |cp| rq + rq rp; a pair
        whose bound stays below the worst kth score of the query node's own queries is pruned (equal scores are looked
        at, since ids decide them). Of a pair that is left, the wider node is replaced by its children."""
        queries = self.queries
        self.met += len(queries.ids) * len(points.ids)
        stack = [(0, np.zeros(1, dtype=np.int64))] if len(queries.ids) and len(points.ids) else []
        while stack:
            q, nodes = stack.pop()
            wide = points.radius[nodes] + points.norm[nodes]
            bound = points.centre[nodes] @ queries.centre[q] + queries.norm[q] * points.radius[nodes] + queries.radius[q] * wide
            bound += 1e-9 * (queries.norm[q] + queries.radius[q]) * wide + 1e-6
            fine = bound >= self.scores[queries.lo[q] : queries.hi[q], -1].min()
            nodes = nodes[fine]
            inner = ~points.leaf[nodes]
            open_ = inner if queries.leaf[q] else inner & (points.radius[nodes] >= queries.radius[q])
            if not len(nodes):
                continue
            if open_.any():
                n = nodes[open_]
                stack.append((q, np.append(nodes[~open_], _ranges(points.first[n], points.end[n]))))
            elif queries.leaf[q]:
                self._look(q, points, nodes)
            else:
                stack.extend((c, nodes) for c in range(int(queries.end[q]) - 1, int(queries.first[q]) - 1, -1))

    def _look(self, q: int, points: Indexed, nodes: np.ndarray) -> None:
        """The last level of the queries: each of the node's queries by itself against leaves, which are pruned for it
        by <q, cp> + |q| rp. Queries without any score begin with their best leaf; then the leaf of the highest bound
        is scored, together with those that about the same queries need."""
        lo, hi = int(self.queries.lo[q]), int(self.queries.hi[q])
        spans = [(c, min(c + LEAF, hi)) for c in range(lo, hi, LEAF)]  # a leaf of equal points may be long
        sizes = points.hi[nodes] - points.lo[nodes]
        for a, b in spans:
            own, norm = self.queries.floats[a:b], self.queries.norms[a:b, None]
            bound = own @ points.centre[nodes].T + norm * points.radius[nodes]
            bound += 1e-9 * norm * (points.norm[nodes] + points.radius[nodes]) + 1e-6
            new = np.flatnonzero(self.scores[a:b, -1] == _LEAST)
            first = bound[new].argmax(axis=1)
            for n in np.unique(first).tolist():
                self._score(a + new[first == n], points, nodes[n : n + 1])
                bound[new[first == n], n] = -np.inf
            done = np.isneginf(bound)
            left = np.argsort(-bound.max(axis=0), kind="stable")
            while True:
                needed = bound[:, left] >= self.scores[a:b, -1:]
                some = needed.any(axis=0)
                left, needed = left[some], needed[:, some]
                if not len(left):
                    break
                alike = 2 * (needed ^ needed[:, :1]).sum(axis=0) <= needed[:, 0].sum()
                alike &= np.cumsum(np.where(alike, sizes[left], 0)) <= 1024
                alike[0] = True
                rows = np.flatnonzero(needed[:, alike].any(axis=1))
                self._score(a + rows, points, nodes[left[alike]], done[np.ix_(rows, left[alike])])
                left = left[~alike]

    def _score(self, rows: np.ndarray, points: Indexed, nodes: np.ndarray, done: np.ndarray | None = None) -> None:
        """The products of some queries with all points of some leaves, and what enters the best k by them; pairs of a
        query and a leaf that are done already do not count again."""
        every, k = _ranges(points.lo[nodes], points.hi[nodes]), self.scores.shape[1]
        self.scored += len(rows) * len(every)
        for at in range(0, len(every), 1024):
            part = every[at : at + 1024]
            s = products(self.queries, rows, points, part)
            s[self.queries.ids[rows, None] == points.ids[part][None, :]] = _LEAST
            if done is not None and done.any():
                s[np.repeat(done, points.hi[nodes] - points.lo[nodes], axis=1)[:, at : at + 1024]] = _LEAST
            better = np.flatnonzero(s.max(axis=1) >= self.scores[rows, -1])
            s, own = s[better], rows[better]
            if s.shape[1] > 4 * k:  # only those at or over the kth of these can enter
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k:-k + 1]
                most = int((s >= kth).sum(axis=1).max(initial=0))
                use = np.argsort(~s, axis=1, kind="stable")[:, :most]
                s, ids = np.take_along_axis(s, use, axis=1), points.ids[part][use]
            else:
                ids = np.broadcast_to(points.ids[part], s.shape)
            scores, found = np.concatenate([self.scores[own], s], axis=1), np.concatenate([self.found[own], np.where(s > _LEAST, ids, _MOST)], axis=1)
            top = np.lexsort((found, ~scores), axis=1)[:, :k]  # ~ falls as its integer rises, and has no overflow
            self.scores[own], self.found[own] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(found, top, axis=1)

    def result(self) -> list[tuple[int, int, int]]:
        rows, places = np.nonzero(self.scores > _LEAST)
        return list(zip(self.queries.ids[rows].tolist(), self.found[rows, places].tolist(), self.scores[rows, places].tolist(), strict=True))


def search(queries: Indexed, points: Indexed, k: int) -> list[tuple[int, int, int]]:
    """(query id, point id, score) of each query's k best points other than itself; ties go to smaller ids. Integers."""
    run = Search(queries, k)
    run.add(points)
    return run.result()


def pack_vectors(ids: list[int], vectors: list[np.ndarray]) -> bytes:
    data = np.array(vectors, dtype="<i8")
    return struct.pack("<qq", *data.shape) + np.array(ids, dtype="<i8").tobytes() + data.tobytes()


def unpack_vectors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<qq", data)
    return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i8", n * width, 16 + 8 * n).reshape(n, width)


def quantised(vectors: DataFrame, *, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(factor * x) of each component x as double. Vectors that are null, or hold a null, NaN or infinite
    component, and rows without an id are left out. A component whose floor does not fit a long is an error."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x * factor) < float(1 << 63), F.floor(x * factor)).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    return rows.filter(F.col("id").isNotNull() & F.col("_v").isNotNull() & fine).select("id", F.transform("_v", whole).alias("v"))


def _blocks(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Rows (id, v) in binary blocks of one dimension in the order they come: norm (the longest vector's), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, vs = held.pop(width)
            longest = max(float(np.linalg.norm(v.astype(np.float64))) for v in vs)
            return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([pack_vectors(ids, vs)], pa.binary())], ["norm", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v.values.to_numpy(zero_copy_only=False))
                if 8 * len(ids) * max(1, len(v)) >= most_bytes:
                    yield out(len(v))
        for width in list(held):
            yield out(width)

    return rows.select("id", "v").mapInArrow(run, "norm double, data binary")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the highest inner product, without itself.

    Both sides are (id, v) with integer vectors. Candidates are ranged by length, longest first, and written once in
    blocks of CANDIDATE_BYTES, each of which becomes a cover tree. Blocks are dealt into lots of LOT_BLOCKS (fewer while
    there are not enough lots for all tasks), and each lot meets all query blocks: a task first reads its lot's blocks
    and indexes them, then streams the query blocks, each of which descends the lot's trees, longest vectors first,
    with the kth scores it has so far. Memory is one lot and one query block; nothing is broadcast, and one number, that
    of the blocks, reaches the driver. A lot gives k rows for each query at most; a window that drops the rest before
    its shuffle takes the best k of these. The number of block pairs is the product that exact search of a stated query
    set has, less what the trees prune; vectors without clusters in many dimensions leave nothing to prune.

    Repeated ids are candidates of their own, and queries of one id share one ranking; equal scores go to smaller ids;
    vectors of unlike dimension never meet; an empty side gives no rows. A product beyond a long is an error.
    """
    spark = candidates.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    order = [F.desc("_n"), "_row"]
    ranged = candidates.select("id", "v", squares.alias("_n"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = saved(_blocks(ranged, CANDIDATE_BYTES), "vectors")
    n, tasks = blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, min(n, max(-(-n // LOT_BLOCKS), tasks)))
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)).cast("int")
    own = blocks.select(lot.alias("lot"), F.lit(0).alias("kind"), (-F.col("norm")).alias("at"), "data")
    every = _blocks(queries.hint("rebalance"), QUERY_BYTES).select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(1).alias("kind"), F.lit(0.0).alias("at"), "data")
    parts = min(lots, MOST_TASKS)
    dealt = own.unionByName(every).repartitionById(parts, F.pmod("lot", F.lit(parts)).cast("int")).sortWithinPartitions("lot", "kind", "at").select("lot", "kind", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for at, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at != now:
                    now, held = at, []
                index = Indexed(*unpack_vectors(data.as_py()))
                if not kind:
                    held.append(index)
                    continue
                found = Search(index, k)
                for points in held:
                    if points.centre.shape[1] == index.centre.shape[1]:
                        found.add(points)
                rows = found.result()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
