"""Nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node with its smallest ids. Nodes are dealt to shards of bounded size by hash; a shard's graph is
one row: vectors, level sizes and the neighbours of all levels as one flat array of 32-bit numbers. Nodes stand in random
order and the upper levels are its prefixes, so that a level is a slice of that array. Nodes are inserted in growing
batches: a batch is searched in the graph of those before it, its own nodes are met by one product, and of what was found those
are linked that are nearer to the node than to a neighbour already chosen, then the nearest of the rest. One more
component brings all vectors of a shard to the same length, which makes the largest inner product the smallest distance.

Queries meet every shard in blocks: a task holds one shard and one block. What it returns is scored again in double precision on
the original vectors, and the nearest of all shards stay.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without vec_id; vectors of
different lengths never meet. A row that is there twice counts once. Rows of one vec_id with different vectors are a query
each, and none of them is a candidate of the others. Fewer candidates than k: all of them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 8192
#: Neighbours of a node, on the lowest level and above; each level has about one node in FAN of the one below.
LOW, HIGH, FAN = 32, 16, 16
#: Places of the list of best nodes: while building, searching and on upper levels.
EF_BUILD, EF_SEARCH, EF_HIGH = 96, 160, 16
#: Nodes that a step looks beyond, queries and inserted nodes that go together.
STEP, TOGETHER = 4, 512
#: The top level is searched whole.
TOP = 64
_NONE = np.float32(-np.inf)


# ---------------------------------------------------------------- the graph of one shard


def _level_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """The vectors in single precision with one more component, after which all are equally long."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    more = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    scale = np.sqrt(squares.max(initial=0)) or 1.0
    return (np.column_stack((vectors, more)) / scale).astype(np.float32)


class Graph:
    """points: equally long rows in random order. A node's neighbours on a level are a row of links[level]; -1 is none."""

    def __init__(self, points: np.ndarray, links: list[np.ndarray] | None = None):
        self.points, self.sizes = points, _level_sizes(len(points))
        if links is None:
            self.links = [np.full((n, LOW if level == 0 else HIGH), -1, np.int32) for level, n in enumerate(self.sizes)]
            self._build()
        else:
            self.links = links

    # ---- search

    def walk(self, queries: np.ndarray, begin: np.ndarray, level: int, places: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found on a level and their products, best first, -1 and -inf beyond; begin: nodes to start from."""
        rows, points, links = len(queries), self.points, self.links[level]
        seen = np.zeros((rows, known + 1), bool)
        seen[:, known] = True  # for -1
        begin = np.sort(begin, axis=1)
        begin[:, 1:][begin[:, 1:] == begin[:, :-1]] = -1
        best, score = begin, self._products(queries, begin)
        seen[np.arange(rows)[:, None], begin] = True
        best, score, open_ = self._cut(best, score, np.ones(best.shape, bool), places)
        active = np.arange(rows)
        while len(active):
            b, o = best[active], open_[active]
            at = np.argsort(~o, axis=1, kind="stable")[:, :STEP]
            here = np.arange(len(active))[:, None]
            nodes = np.where(o[here, at], b[here, at], -1)
            o[here, at] = False
            found = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[active[:, None], found]] = -1
            seen[active[:, None], found] = True
            both = np.concatenate((b, found), axis=1)
            product = np.concatenate((score[active], self._products(queries[active], found)), axis=1)
            best[active], score[active], open_[active] = self._cut(both, product, np.concatenate((o, found >= 0), axis=1), places)
            active = active[open_[active].any(1)]
        return best, score

    def _products(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.full(nodes.shape, _NONE, np.float32)
        row, at = np.nonzero(nodes >= 0)
        out[row, at] = np.einsum("ij,ij->i", queries[row], self.points[nodes[row, at]])
        return out

    @staticmethod
    def _cut(nodes: np.ndarray, score: np.ndarray, open_: np.ndarray, places: int):
        """The best places of each row, best first; what is no node has none left to open."""
        if nodes.shape[1] < places:
            gap = ((0, 0), (0, places - nodes.shape[1]))
            nodes, score, open_ = np.pad(nodes, gap, constant_values=-1), np.pad(score, gap, constant_values=_NONE), np.pad(open_, gap)
        here = np.arange(len(nodes))[:, None]
        top = np.argpartition(-score, places - 1, axis=1)[:, :places]
        top = top[here, np.argsort(-score[here, top], axis=1, kind="stable")]
        nodes = nodes[here, top]
        return nodes, score[here, top], open_[here, top] & (nodes >= 0)

    def descend(self, queries: np.ndarray, known: int, down_to: int = 0) -> np.ndarray:
        """Nodes to start from on level down_to: the best of the level above it."""
        top = len(self.sizes) - 1
        begin = np.tile(np.arange(min(self.sizes[top], known)), (len(queries), 1))
        for level in range(top, down_to, -1):
            begin = self.walk(queries, begin, level, EF_HIGH, min(self.sizes[level], known))[0]
        return begin

    def search(self, queries: np.ndarray, places: int = EF_SEARCH) -> np.ndarray:
        """The best nodes for each query, -1 beyond."""
        out = np.full((len(queries), places), -1, np.int64)
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER]
            out[at : at + len(q)] = self.walk(q, self.descend(q, len(self.points)), 0, places, len(self.points))[0]
        return out

    # ---- building

    def _build(self) -> None:
        n, at = len(self.points), 0
        while at < n:
            # a batch is at most as large as what is there, and lies on the same levels throughout
            end = min(n, at + max(1, min(at, TOGETHER)), *(s for s in self.sizes if s > at))
            q, begin = self.points[at:end], None
            levels = [level for level, s in enumerate(self.sizes) if s > at]
            if at:
                begin = self.descend(q, at, levels[-1])
            for level in reversed(levels):
                found = np.empty((len(q), 0), np.int64)
                if at:
                    found = self.walk(q, begin, level, EF_BUILD, at)[0]
                    begin = found[:, :EF_HIGH]
                self._link(level, at, end, found)
            at = end

    def _link(self, level: int, at: int, end: int, found: np.ndarray) -> None:
        q, degree = self.points[at:end], self.links[level].shape[1]
        own = np.arange(at, end)
        if len(own) > 1:
            product = q @ q.T
            np.fill_diagonal(product, _NONE)
            near = np.argpartition(-product, min(degree, len(own) - 1) - 1, axis=1)[:, : min(degree, len(own) - 1)]
            found = np.concatenate((found, near + at), axis=1)
        chosen = self._chosen(own, found, degree)
        self.links[level][own] = chosen
        # and back: each node that was linked chooses anew among its neighbours and those that came
        source, to = np.repeat(own, degree), chosen.ravel()
        source, to = source[to >= 0], to[to >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.points[source], self.points[to]), to))
        source, to = source[order], to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
        number = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        nodes, row = np.unique(to, return_inverse=True)
        # a node that many came to at once sees them in rounds, so that none is left unseen
        for lower in range(0, int(number.max(initial=-1)) + 1, degree):
            here = (number >= lower) & (number < lower + degree)
            rows, at_row = np.unique(row[here], return_inverse=True)
            came = np.full((len(rows), degree), -1, np.int64)
            came[at_row, number[here] - lower] = source[here]
            for part in range(0, len(rows), TOGETHER):
                some = nodes[rows[part : part + TOGETHER]]
                self.links[level][some] = self._chosen(some, np.concatenate((self.links[level][some], came[part : part + TOGETHER]), axis=1), degree)

    def _chosen(self, nodes: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
        """Of the nodes found for each node: those nearer to it than to one already chosen, then the nearest."""
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found, score, _ = self._cut(found, self._products(self.points[nodes], found), found >= 0, found.shape[1])
        rows, width = found.shape
        out = np.full((rows, degree), -1, np.int32)
        if not width:
            return out
        vectors = self.points[found]
        among = vectors @ vectors.transpose(0, 2, 1)
        chosen, closest = np.zeros(found.shape, bool), np.full(found.shape, _NONE, np.float32)
        left = np.full(rows, degree)
        for j in range(width):
            takes = (found[:, j] >= 0) & (left > 0) & (closest[:, j] < score[:, j])
            chosen[takes, j] = True
            left -= takes
            closest[takes] = np.maximum(closest[takes], among[takes, j])
        order = np.argsort(np.where(found < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
        out[:, : order.shape[1]] = found[np.arange(rows)[:, None], order]
        return out

    # ---- one flat array

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.links])

    @classmethod
    def of(cls, points: np.ndarray, flat: np.ndarray) -> Graph:
        links, at = [], 0
        for level, n in enumerate(_level_sizes(len(points))):
            degree = LOW if level == 0 else HIGH
            links.append(flat[at : at + n * degree].reshape(n, degree))
            at += n * degree
        return cls(points, links)


# ---------------------------------------------------------------- shards and blocks of queries

_NODES = "dim int, shard int, block int, vectors binary, ids array<array<long>>, links binary"
_FOUND = "query_id long, form long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


def _sound(v: Column) -> Column:
    each = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(each, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _built(t: pa.Table) -> pa.Table:
    """The one row of a shard. The order of its nodes is that of the hashes of their vectors."""
    dim, shard = t["dim"][0].as_py(), t["shard"][0].as_py()
    order = np.argsort(t["form"].to_numpy(), kind="stable")
    vectors = _matrix(t["vector"], dim)[order]
    graph = Graph(lengthened(vectors))
    ids = t["ids"].take(pa.array(order)).to_pylist()
    row = ([dim], [shard], [0], [vectors.tobytes()], [ids], [graph.flat().tobytes()])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary())
    return pa.table([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["dim", "shard", "block", "vectors", "ids", "links"])


def _searched(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest of the shard for each query of the block."""
    names = ["query_id", "form", "vec_id", "score"]
    if not shard.num_rows or not queries.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
    dim = shard["dim"][0].as_py()
    vectors = np.frombuffer(shard["vectors"][0].as_buffer(), np.float64).reshape(-1, dim)
    graph = Graph.of(lengthened(vectors), np.frombuffer(shard["links"][0].as_buffer(), np.int32))
    ids = shard["ids"].combine_chunks().flatten()
    sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
    starts, ids = np.cumsum(sizes) - sizes, ids.flatten().to_numpy()
    wanted, own, form = _matrix(queries["vector"], dim), queries["query_id"].to_numpy(), queries["form"].to_numpy()
    places = max(EF_SEARCH, 2 * k + 2)
    # a query's length is no matter for the order, its further component is 0
    asked = wanted / np.maximum(np.sqrt(np.einsum("ij,ij->i", wanted, wanted)), np.finfo(float).tiny)[:, None]
    nodes = graph.search(np.column_stack((asked, np.zeros(len(asked)))).astype(np.float32), places)
    row, at = np.nonzero(nodes >= 0)
    node = nodes[row, at]
    score = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):
        score[a : a + (1 << 16)] = (wanted[row[a : a + (1 << 16)]] * vectors[node[a : a + (1 << 16)]]).sum(1)
    many = sizes[node]
    row, score = np.repeat(row, many), np.repeat(score, many)
    vec = ids[np.repeat(starts[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    other = vec != own[row]
    row, score, vec = row[other], score[other], vec[other]
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    first = np.searchsorted(row, np.arange(len(own)))
    near = np.arange(len(row)) - first[row] < k
    row = row[near]
    return pa.table([pa.array(own[row]), pa.array(form[row]), pa.array(vec[near]), pa.array(score[near])], names=names)


def index(rows: DataFrame, scratch: Scratch, k: int, shard_nodes: int = SHARD) -> tuple[DataFrame, int]:
    """The written table of shards (_NODES) over rows (vec_id, vector, form, dim), and the number of shards of a length.

    Of equal vectors the k + 1 smallest ids are kept, as no query can return more of them.
    """
    by = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("number", F.row_number().over(by)).where(F.col("number") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("form").alias("form"), F.first("dim").alias("dim"))
    nodes = scratch.write(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int"))
    return scratch.write(dealt.groupBy("dim", "shard").applyInArrow(_built, _NODES), "graphs"), shards


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_nodes: int = SHARD, block: int = BLOCK) -> DataFrame:
    """RESULT: the k nearest found for every row whose vec_id is divisible by every, ties to the smaller vec_id."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _sound(F.col("vector"))).dropDuplicates()
    rows = scratch.write(rows.withColumns({"form": F.xxhash64("vector"), "dim": F.size("vector")}), "vectors")
    graphs, shards = index(rows, scratch, k, shard_nodes)
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "form"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = held.groupBy(key).cogroup(asked.groupBy(key)).applyInArrow(partial(_searched, k=k), _FOUND)
    best = Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
