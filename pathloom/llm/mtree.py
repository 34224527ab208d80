"""Exact top-k search by inner product: M-trees searched best first.

Vectors are put on one sphere by a further coordinate, so that the highest
inner product is the smallest Euclidean distance. The candidates are dealt out
in blocks, each with one M-tree of paged nodes with covering radii and the
distances to their parents. Batches of queries stream past a tree and descend it
together: in each wave every query opens the pages with its lowest bounds, and
queries at one page share its matrix products. A child, or an entry of a leaf,
is ruled out by the triangle inequality on its stored distance to the parent
before any distance to it is computed, then by its covering radius. Scores are
exact integers; bounds are widened by more than their rounding error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle


@dataclass(frozen=True)
class SearchConfig:
    k: int = 20
    #: Components are turned into floor(scale * x).
    scale: float = 64.0
    #: Candidates of a block, and how many blocks there are at least, so that few
    #: candidates are searched in parallel too; queries that descend a tree together.
    block: int = 16384
    min_blocks: int = 8
    queries: int = 256
    #: Entries of a page.
    page: int = 256
    fanout: int = 16


class Node:
    """A page: a leaf has entries sorted by their distance to its routing vector."""

    __slots__ = ("center", "radius", "to_parent", "children", "places", "rows", "gaps")

    def __init__(self, center: np.ndarray, radius: float, to_parent: float) -> None:
        self.center, self.radius, self.to_parent = center, radius, to_parent
        self.children: list[Node] = []
        self.places = self.rows = self.gaps = np.zeros(0, int)


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, config: SearchConfig) -> None:
        self.vectors, self.ids, self.config = vectors, ids, config
        with np.errstate(over="ignore"):
            norms = (vectors * vectors).sum(1)
        self.limit = float(norms.max(initial=0.0))
        # scores are exact in doubles only below 2**53; beyond, in Python's integers
        self.exact = self.limit < 2.0**52
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.limit - norms, 0))[:, None]])
        self.slack = 1e-6 * (1 + np.sqrt(self.limit))
        self.computed = 0
        self.root = self._build(np.arange(len(vectors)), None)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> Node:
        center = self.points[rows[0]]
        gaps = np.sqrt(((self.points[rows] - center) ** 2).sum(1))
        node = Node(center, float(gaps.max(initial=0.0)), 0.0 if parent is None else float(np.linalg.norm(center - parent)))
        if len(rows) <= self.config.page:
            order = np.argsort(gaps, kind="stable")
            node.rows, node.gaps = rows[order], gaps[order]
            return node
        # routing vectors far from each other; every row goes to its nearest
        nearest, owner = gaps, np.zeros(len(rows), np.int64)
        fanout = max(2, min(self.config.fanout, -(-4 * len(rows) // (3 * self.config.page))))
        for i in range(1, fanout):
            own = np.sqrt(((self.points[rows] - self.points[rows[int(nearest.argmax())]]) ** 2).sum(1))
            owner[own < nearest] = i
            nearest = np.minimum(nearest, own)
        if (owner == owner[0]).all():  # equal vectors: pages of even size
            owner = np.arange(len(rows)) * fanout // len(rows)
        node.children = [self._build(rows[owner == i], center) for i in np.unique(owner)]
        return node

    def _nodes(self) -> list[Node]:
        """All nodes, parents first; each node knows its children's places."""
        nodes, at = [self.root], 0
        while at < len(nodes):
            nodes[at].places = np.arange(len(nodes), len(nodes) + len(nodes[at].children))
            nodes += nodes[at].children
            at += 1
        return nodes

    def search_many(self, queries: np.ndarray, own_ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same as ``search`` for many queries.

        Each query opens its pages in the order of their lower bounds, in waves
        of 1, 1, 2, 4, ... pages.
        """
        k, n = self.config.k, len(self.ids)
        with np.errstate(over="ignore"):
            lengths = (queries * queries).sum(1)
        wide = 1 << max(1, int(n).bit_length())
        if not (self.exact and float(lengths.max(initial=0.0)) * self.limit < (2.0**60 / wide) ** 2 and float(lengths.max(initial=0.0)) < 2.0**52):
            return [self.search(q, int(i)) for q, i in zip(queries, own_ids)]
        # one integer for score and id: larger is better, ties go to the smaller id
        by_id = np.argsort(self.ids, kind="stable")
        place = np.empty(n, np.int64)
        place[by_id] = np.arange(n)
        nodes = self._nodes()
        radii, to_parent = np.array([x.radius for x in nodes]), np.array([x.to_parent for x in nodes])
        centers = np.array([x.center for x in nodes])
        squares = (centers**2).sum(1)
        points = np.hstack([queries, np.zeros((len(queries), 1))])

        def distances(asks: np.ndarray, to: np.ndarray) -> np.ndarray:
            self.computed += len(asks) * len(to)
            return np.sqrt(np.maximum(0, lengths[asks, None] + squares[to] - 2 * points[asks] @ centers[to].T))

        never = np.iinfo(np.int64).min
        best = np.full((len(queries), k), never)
        reach = np.full(len(queries), np.inf)
        slack = self.slack + 1e-6 * np.sqrt(lengths)
        # bounds of the pages that a query may open; none of the others
        low, gaps = np.full((len(queries), len(nodes)), np.inf), np.zeros((len(queries), len(nodes)))
        gaps[:, 0] = distances(np.arange(len(queries)), np.zeros(1, int))[:, 0]
        low[:, 0] = np.maximum(0, gaps[:, 0] - radii[0])
        wave, opened = 0, 1
        while True:
            low[low > (reach + slack)[:, None]] = np.inf
            many = min(opened, len(nodes))
            first = np.argpartition(low, many - 1, axis=1)[:, :many]
            asking, which = np.nonzero(np.isfinite(np.take_along_axis(low, first, 1)))
            if not len(asking):
                break
            pages = first[asking, which]
            low[asking, pages] = np.inf
            order = np.argsort(pages, kind="stable")
            asking, pages = asking[order], pages[order]
            for j, asks in zip(pages[np.append(True, pages[1:] != pages[:-1])], np.split(asking, np.flatnonzero(pages[1:] != pages[:-1]) + 1)):
                node, span = nodes[j], (reach + slack)[asks]
                if node.children:
                    # by the stored distances to the parent first, without a distance of their own
                    hopeful = np.abs(gaps[asks, j][:, None] - to_parent[node.places]) - radii[node.places] <= span[:, None]
                    for c in np.flatnonzero(hopeful.any(0)):
                        to, child = asks[hopeful[:, c]], node.places[c]
                        own = distances(to, np.array([child]))[:, 0]
                        gaps[to, child] = own
                        low[to, child] = np.maximum(0, own - radii[child])
                    continue
                a, b = np.searchsorted(node.gaps, ((gaps[asks, j] - span).min(), (gaps[asks, j] + span).max()))
                rows = node.rows[a:b]
                if not len(rows):
                    continue
                self.computed += len(asks) * len(rows)
                keys = (queries[asks] @ self.vectors[rows].T).astype(np.int64) * wide - place[rows]
                keys[self.ids[rows][None] == own_ids[asks][:, None]] = never
                better = np.flatnonzero(keys.max(1) > best[asks, 0])
                if len(better):
                    both = np.hstack([best[asks[better]], keys[better]])
                    best[asks[better]] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
            full = best[:, 0] != never
            kth = -((-best[full, 0]) // wide)
            reach[full] = np.sqrt(np.maximum(0, lengths[full] + self.limit - 2 * kth.astype(float)))
            wave += 1
            opened = max(1, 1 << max(0, wave - 2))
        out = []
        for own in best:
            keys = own[own != never][::-1]
            scores = -((-keys) // wide)
            out.append((self.ids[by_id[scores * wide - keys]], scores))
        return out

    def search(self, query: np.ndarray, own_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best entries other than ``own_id``, ties to smaller ids."""
        k = self.config.k
        with np.errstate(over="ignore"):
            length = float(query @ query)
        exact = self.exact and length < 2.0**52 and length * self.limit < 2.0**104
        point = np.append(query, 0.0)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)
        reach = np.inf
        slack = self.slack + 1e-6 * np.sqrt(length)
        top = float(np.linalg.norm(point - self.root.center))
        heap = [(0.0, 0, top, self.root)]
        pushed = 0
        while heap:
            bound, _, gap, node = heapq.heappop(heap)
            if bound > reach + slack:
                break
            if node.children:
                for child in node.children:
                    if abs(gap - child.to_parent) - child.radius > reach + slack:
                        continue
                    own = float(np.linalg.norm(point - child.center))
                    self.computed += 1
                    low = max(0.0, own - child.radius)
                    if low <= reach + slack:
                        pushed += 1
                        heapq.heappush(heap, (low, pushed, own, child))
                continue
            a, b = (0, len(node.rows)) if reach == np.inf else np.searchsorted(node.gaps, (gap - reach - slack, gap + reach + slack))
            rows = node.rows[a:b]
            self.computed += len(rows)
            if exact:
                found = self.vectors[rows] @ query
            else:
                found = np.array([sum(int(x) * int(y) for x, y in zip(self.vectors[r], query)) for r in rows], object)
            names = self.ids[rows]
            good = names != own_id if own_id is not None else np.ones(len(names), bool)
            if len(scores) == k:
                good &= (found >= scores[-1]).astype(bool)
            if not good.any():
                continue
            ids, scores = np.append(ids, names[good]), np.append(scores, found[good])
            order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]) if not exact else np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if len(ids) == k:
                reach = float(np.sqrt(max(0.0, length + self.limit - 2 * float(scores[-1]))))
        if not exact:
            scores = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], np.int64)
        return ids, scores.astype(np.int64)


def _whole(config: SearchConfig):
    """Rows whose vectors are whole: their quantised components and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten()
            lengths = np.diff(vectors.offsets.to_numpy())
            nulls = vectors.is_null().to_numpy(zero_copy_only=False)
            values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * config.scale)
            lengths = np.where(nulls, 0, lengths)
            ends = np.append(0, np.cumsum(lengths))
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            kept = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & ~nulls)
            own = [values[ends[i] : ends[i + 1]].astype("<f8").tobytes() for i in kept]
            yield pa.record_batch([batch.column("id").take(pa.array(kept)), pa.array(own, pa.binary()), pa.array(lengths[kept], pa.int32())], names=["id", "vector", "dim"])

    return run


def _search(config: SearchConfig):
    def answers(tree: MTree, asked: list) -> pa.RecordBatch:
        keys, ids, vectors = zip(*asked)
        # a query without an id excludes nothing: no candidate has the smallest id
        own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        found = tree.search_many(np.array(vectors), own)
        many = [len(f) for f, _ in found]
        return pa.record_batch(
            [
                pa.array(np.repeat(np.array(keys, np.int64), many)),
                pa.array([i for i, n in zip(ids, many) for _ in range(n)], pa.int64()),
                pa.array(np.concatenate([f for f, _ in found])),
                pa.array(np.concatenate([x for _, x in found])),
            ],
            names=["key", "query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each block the candidates come first, then all queries
        now, held, names, asked, tree = None, [], [], [], None
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "block"))))
            sides, ids, keys = (batch.column(c).to_pylist() for c in ("asks", "id", "key"))
            vectors = batch.column("vector")
            for i, group in enumerate(groups):
                if group != now:
                    if asked:
                        yield answers(tree, asked)
                    now, held, names, asked, tree = group, [], [], [], None
                vector = np.frombuffer(vectors[i].as_py(), "<f8")
                if not sides[i]:
                    held.append(vector)
                    names.append(ids[i])
                elif held:
                    tree = tree or MTree(np.array(held), np.array(names, np.int64), config)
                    asked.append((keys[i], ids[i], vector))
                    if len(asked) == config.queries:
                        yield answers(tree, asked)
                        asked = []
        if asked:
            yield answers(tree, asked)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``candidates(id, vector)`` and ``queries(id, vector)`` to ``(query_id, rank, vec_id, score)``.

    Each query row gets its k highest integer inner products over all
    candidates but those of its own id (all, if there are fewer), ties to the
    smaller vec_id. Vectors that are null or hold null or non-finite components
    (also after scaling) take no part, nor do candidates without an id; vectors
    of different length don't meet, empty ones score 0. Repeated candidates count
    each; rows that repeat a query get their answers each. Other columns take no
    part. Scores beyond 64 bits are clipped. Empty tables give none.

    Candidates are sent once, each to its block; queries to every block.
    """
    def plain(frame: DataFrame) -> DataFrame:
        slim = frame.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        return slim.mapInArrow(_whole(config), "id long, vector binary, dim int")

    held = plain(candidates).where("id is not null")
    asked = settle(plain(queries).withColumn("key", F.monotonically_increasing_id()))
    blocks = F.lit(max(config.min_blocks, -(-held.count() // config.block)))
    # of each block of candidates one tree; every query comes to every block
    left = held.select(F.lit(False).alias("asks"), "dim", F.pmod(F.xxhash64("id", "vector"), blocks).cast("int").alias("block"), "id", F.lit(0).cast("long").alias("key"), "vector")
    right = asked.select(F.lit(True).alias("asks"), "dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "id", "key", "vector")
    grouped = left.unionByName(right).repartition("dim", "block").sortWithinPartitions("dim", "block", "asks")
    found = grouped.mapInArrow(_search(config), "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
