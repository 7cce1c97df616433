"""Approximate nearest neighbours on robust-pruned directed graphs, a graph for each shard.

Vectors are dealt to shards by hash.  In a shard, batches of vectors run greedy
searches from a few far-apart nodes over the graph so far; the best nodes a
search meets (its final beam) and the node's edges so far are the candidates,
of which relaxed distance pruning keeps diverse edges (an edge is dropped if a
kept neighbour is closer to the candidate than the node is, by a factor).
Reverse edges are added and pruned alike.  A query beam-searches every shard,
and the shards' best are merged.

Equal vectors are one row that holds the least ids (as many as a result can
need), and rows of one direction (to single precision) are one node, so a large
group of copies neither bends the graph nor fills a shard.  Vectors keep their
double precision throughout: every row of the nodes that a search finds is
scored by it, and only the unit vectors by which searches go are narrower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Distinct vectors in a shard: the square root of all times GROWTH, within these bounds.  Every query visits
#: every shard, so that shards grow with the index; the upper bound is what a task holds and builds.
SHARD, SHARD_MOST, GROWTH = 8192, 1 << 17, 36
DEGREE, BEAM, RELAX = 32, 64, 1.2
#: Nodes a query's beam holds in each shard.
QUERY_BEAM = 160
#: Searches begin at this many nodes, each the farthest from those before, so that no dense group captures them.
ENTRIES = 32
BATCH = 256
#: Queries that a task answers, about: more are spread over tasks that hold the same shard.
BLOCK = 1 << 18


def _valid(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part (not null, no null or non-finite component, not zero) and their vectors."""
    rows, out = [], []
    for i, v in enumerate(lists.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                out.append(x)
    return np.array(rows, np.int64), out


def _scaled(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length, each times a power of two that brings it near one (so no square over- or underflows), and their norms."""
    x = np.stack([np.frombuffer(k, np.float64) for k in keys])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def _merge_ids(held: dict[bytes, list[int]], key: bytes, ids: list[int], most: int) -> None:
    """Keep the ``most`` least ids of a vector; an id that repeats counts once."""
    have = held.get(key)
    held[key] = sorted(set(ids) if have is None else {*have, *ids})[:most]


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """``v`` (a vector's double-precision bytes) and ``ids`` (its ``most`` least ids), pre-merged in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            rows, found = _valid(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, x in zip(rows.tolist(), found):
                _merge_ids(held, x.tobytes(), [ids[i]], most)
            if len(held) >= 1 << 16:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def _rows(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "ids"])

    narrow = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null")
    return narrow.mapInArrow(run, "v binary, ids array<long>")


def _far_apart(unit: np.ndarray, count: int) -> np.ndarray:
    """Nodes chosen one by one, each the farthest from those chosen."""
    found: list[int] = []
    near = unit @ unit.mean(axis=0) if count else np.empty(0, np.float32)
    while len(found) < count:
        found.append(int(near.argmin()))
        near = unit @ unit[found[-1]] if len(found) == 1 else np.maximum(near, unit @ unit[found[-1]])
        near[found] = np.inf
    return np.array(found, np.int64)


class Graph:
    """A shard's graph over unit vectors; searches go in batches, one step of all searches at a time."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 5):
        self.unit, self.degree, self.beam, self.relax = unit, degree, beam, relax
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, np.int32)
        if n > 1:  # a random graph to begin with
            k = min(degree, n - 1, 8)
            self.edges[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
        self.entries = _far_apart(unit, min(n, ENTRIES))
        for relax_now in (1.0, relax):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                self._insert(order[at : at + BATCH], relax_now)

    def _insert(self, nodes: np.ndarray, relax: float) -> None:
        found, _ = self.search(self.unit[nodes], self.beam)
        self.edges[nodes] = self._prune(nodes, np.concatenate([found, self.edges[nodes]], axis=1), relax)
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, starts, counts = np.unique(target, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        new = np.full((len(touched), width), -1, np.int32)
        new[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
        both = np.concatenate([self.edges[touched], new], axis=1)
        for at in range(0, len(touched), BATCH):
            part = slice(at, at + BATCH)
            self.edges[touched[part]] = self._prune(touched[part], both[part], relax)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Robust pruning of a row of candidates for each node (-1: none)."""
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == nodes[:, None]] = -1
        vectors = self.unit[candidates]
        away = 2 - 2 * np.einsum("bcd,bd->bc", vectors, self.unit[nodes])
        away[candidates < 0] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        width = min(candidates.shape[1], max(self.beam, 2 * self.degree))
        order = order[:, :width]
        candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
        vectors = self.unit[candidates]
        between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        out, rows, open_ = np.full((len(nodes), self.degree), -1, np.int32), np.arange(len(nodes)), np.isfinite(away)
        for k in range(self.degree):
            pick = open_.argmax(axis=1)
            some = open_[rows, pick]
            if not some.any():
                break
            out[some, k] = candidates[some, pick[some]]
            open_[rows, pick] = False
            # squared distances, so the factor is squared too
            open_ &= ~((relax * relax * between[rows, pick] <= away) & some[:, None])
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of unit queries: the ``beam`` best nodes met by each (-1: none) and their cosines."""
        b, n = len(queries), len(self.unit)
        if not n:
            return np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        ids, near, done = np.full((b, beam), -1, np.int32), np.full((b, beam), -np.inf, np.float32), np.ones((b, beam), bool)
        start = queries @ self.unit[self.entries].T
        first = np.argsort(-start, axis=1, kind="stable")[:, :beam]
        k = first.shape[1]
        ids[:, :k], near[:, :k], done[:, :k] = self.entries[first], np.take_along_axis(start, first, 1), False
        seen[:, self.entries] = True
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                return ids, near
            pick = (~done[live]).argmax(axis=1)
            done[live, pick] = True
            edges = self.edges[ids[live, pick]]
            fresh = (edges >= 0) & ~seen[live[:, None], edges]
            seen[live[:, None], np.where(fresh, edges, ids[live, pick][:, None])] = True
            score = np.einsum("brd,bd->br", self.unit[edges], queries[live])
            score[~fresh] = -np.inf
            all_ids = np.concatenate([ids[live], np.where(fresh, edges, -1)], axis=1)
            all_near = np.concatenate([near[live], score], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            ids[live], near[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_done))


def build(vectors: DataFrame, most: int = 6, shard: int | None = None, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """The index: ``shard, node, entries, v, ids, edges``, a row for each distinct vector.

    The first row of a node has its ``edges``, the first of all the ``entries``.

    A task holds one shard.  ``shard`` is the number of distinct vectors in one,
    by default grown with the index.  Rows without an id, null or zero vectors
    and those with null or non-finite components take no part; rows that repeat
    id and vector count once.
    """
    pieces = materialize(distinct_vectors(vectors, most), "vectors")
    n = pieces.count()
    size = shard or min(SHARD_MOST, max(SHARD, int(GROWTH * n**0.5)))
    shards = max(1, -(-n // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        number = 0
        for batch in batches:
            for number, v, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _merge_ids(held, v, ids, most)
        for width in sorted({len(k) for k in held}):  # vectors of another length share no measure
            keys = sorted(k for k in held if len(k) == width)
            raw, norm = _scaled(keys)
            unit, node = np.unique((raw / norm[:, None]).astype(np.float32) + np.float32(0), axis=0, return_inverse=True)
            node = node.ravel()
            order = np.argsort(node, kind="stable")
            first = np.concatenate(([True], np.diff(node[order]) > 0))
            graph = Graph(unit, degree, beam, relax)
            for at in range(0, len(keys), 4096):
                part, lead = order[at : at + 4096], first[at : at + 4096]
                columns = [
                    pa.array([number] * len(part), pa.int32()), pa.array(node[part].astype(np.int32)), pa.array([graph.entries.tolist() if at + i == 0 else None for i in range(len(part))], pa.list_(pa.int32())), pa.array([keys[i] for i in part], pa.binary()),
                    pa.array([held[keys[i]] for i in part], pa.list_(pa.int64())), pa.array([graph.edges[n].tolist() if f else None for n, f in zip(node[part], lead)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "entries", "v", "ids", "edges"])

    dealt = pieces.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids").repartitionById(shards, "shard")
    return materialize(dealt.mapInArrow(run, "shard int, node int, entries array<int>, v binary, ids array<long>, edges array<int>"), "graph")


class _Loaded(Graph):
    """A graph read back from its rows."""

    def __init__(self, unit, edges, entries):
        self.unit, self.edges, self.entries = unit, edges, np.array(entries, np.int64)


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = QUERY_BEAM, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query by cosine, ties to the smaller id.

    ``queries`` has ``vec_id, embedding``; a query's own id is no result, and
    queries that share an id are answered as one.  Queries go to every shard in
    blocks of about ``block``; a task holds one shard's graph and answers one block.
    Scores are computed anew from the original vectors in double precision.  An index needs
    ``k + 1`` ids for each vector to be whole.
    """
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _valid(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "v"])

    asked = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null").mapInArrow(taken, "id long, v binary")
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    none = lambda kind: F.expr(f"cast(null as {kind})")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("id").alias("node"), none("array<int>").alias("entries"), "v", none("array<long>").alias("ids"), none("array<int>").alias("edges"))
    nodes = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), F.col("node").cast("long").alias("node"), "entries", "v", "ids", "edges")
    both = nodes.unionByName(asked).withColumn("task", F.col("shard") * blocks + F.col("block")).drop("shard", "block")
    both = both.repartitionById(shards * blocks, "task").sortWithinPartitions("kind", F.length("v"), "node", F.isnull("edges")).drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by the vectors' length
        graphs: dict[int, tuple] = {}
        block: list[tuple[int, bytes]] = []

        def load() -> None:
            for width, rows in held.items():
                raw, size = _scaled([r[0] for r in rows])
                first = np.array([i for i, r in enumerate(rows) if r[2] is not None])
                unit = (raw[first] / size[first][:, None]).astype(np.float32) + np.float32(0)
                graph = _Loaded(unit, np.array([rows[i][2] for i in first], np.int32), rows[0][3])
                graphs[width] = graph, np.append(first, len(rows)), raw, size, [r[1] for r in rows]
            held.clear()

        def ask() -> Iterator[pa.RecordBatch]:
            """Answer the first of the waiting queries, those of one length."""
            width, out = len(block[0][1]), []
            part = [x for x in block[:BATCH] if len(x[1]) == width]
            del block[: len(part)]
            if width not in graphs:
                return
            graph, first, raw, size, members = graphs[width]
            q, length = _scaled([v for _, v in part])
            found, _ = graph.search((q / length[:, None]).astype(np.float32), beam)
            for i, (one, _) in enumerate(part):
                nodes = np.unique(found[i][found[i] >= 0])
                rows = np.concatenate([np.arange(a, b) for a, b in zip(first[nodes], first[nodes + 1])])
                score = (raw[rows] * q[i]).sum(axis=1) / (size[rows] * length[i])
                best = sorted(((-s, m) for s, row in zip(score.tolist(), rows.tolist()) for m in members[row] if m != one))[:k]
                out.extend((one, m, -s) for s, m in best)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:  # nodes come first
            for kind, node, entries, v, ids, edges in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    held.setdefault(len(v), []).append((v, ids, edges, entries))
                    continue
                if held:
                    load()
                block.append((node, v))
                if len(block) >= 2 * BATCH:
                    yield from ask()
        while block:
            yield from ask()

    best = both.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
