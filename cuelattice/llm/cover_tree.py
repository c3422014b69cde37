"""Exact pairs of close vectors by dual traversal of cover trees.

On the unit sphere a cosine of c is a distance of sqrt(2 - 2c). The upper levels of the tree are made by
Spark: nodes with many vectors are split around centres that stand apart by a radius which halves from
level to level, and every node knows its measured covering radius. Pairs of nodes are followed from the
roots down; a pair is dropped when its centres are further apart than both radii and the threshold. Leaves, or
chunks of leaves, hold a bounded number of vectors, and bundles a bounded number of neighbouring leaves. A pair of
bundles with a pair of leaves left is one group of a grouped map, which goes on with the lower levels of each leaf's
tree, made once for all its pairs, and compares vectors at the end.

Equal vectors are one vector with a weight. A group returns the number of links of each vector and a
spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, small
from .components import connected_components

#: Vectors of a leaf; children of a node at most.
LEAF, FAN = 2048, 64
#: Radii of the levels inside a task.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Leaves' worth of vectors of a bundle: what a task holds of each side.
BUNDLE = 8
#: Levels that Spark makes at most; leaves that are still too large are cut into chunks.
DEPTH = 6
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _vectors(column) -> np.ndarray:
    """An Arrow column of equally long lists as unit rows; no rows give none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


class CoverTree:
    """Levels of nodes over the rows of x: parent, centre (a row of x) and measured covering radius of each node.

    The last level has a node for each row, with radius 0.
    """

    def __init__(self, x: np.ndarray, radii: tuple[float, ...] = RADII):
        self.x, n = x, len(x)
        between = _distance(x @ x.T)
        node = np.zeros(n, np.int64)
        self.levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([between[0].max()]))]
        for radius in radii:
            old = self.levels[-1][1]
            # nodes of one row stay as they are
            alone = np.flatnonzero(np.bincount(node, minlength=len(old))[node] == 1)
            made, parents, centres = np.full(n, -1), list(node[alone]), list(alone)
            made[alone] = np.arange(len(alone))
            rest = np.flatnonzero(made < 0)
            # a node's centre stays the centre of its first child
            for at in [*old[np.bincount(node, minlength=len(old)) > 1], *rest]:
                if made[at] < 0:
                    near = rest[(made[rest] < 0) & (between[at, rest] <= radius) & (node[rest] == node[at])]
                    made[near] = len(centres)
                    parents.append(node[at])
                    centres.append(at)
            node = made
            reach = np.zeros(len(centres))
            np.maximum.at(reach, node, between[np.asarray(centres)[node], np.arange(n)])
            self.levels.append((np.asarray(parents), np.asarray(centres), reach))
        self.levels.append((node, np.arange(n), np.zeros(n)))


def dual(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, close): rows of both trees that may have partners, and which of these have the cosine."""
    most = float(_distance(np.float64(cosine))) + _SLACK
    alive = np.ones((1, 1), bool)
    for (pa_, ca, ra), (pb, cb, rb) in zip(a.levels[:-1], b.levels[:-1], strict=True):
        alive = alive[np.ix_(pa_, pb)]
        if 2 * len(ca) * len(cb) > len(a.x) * len(b.x):
            continue  # hardly fewer pairs than those of the rows themselves
        alive &= _distance(a.x[ca] @ b.x[cb].T) <= ra[:, None] + rb[None, :] + most
        if not alive.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0), bool)
    node_a, node_b = a.levels[-1][0], b.levels[-1][0]
    rows, columns = np.flatnonzero(alive.any(1)[node_a]), np.flatnonzero(alive.any(0)[node_b])
    close = alive[np.ix_(node_a[rows], node_b[columns])] & (a.x[rows] @ b.x[columns].T >= cosine)
    return rows, columns, close


def forest(src: np.ndarray, dst: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Edges of src, dst that connect what all of them connect."""
    up = list(range(size))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for i, j in zip(src.tolist(), dst.tolist(), strict=True):
        p, q = top(i), top(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((i, j))
    return kept


_FOUND = "cid long, links long, partner long"


def _compare(cosine: float):
    """One pair of bundles: a row with links for each vector that has any, and one with a partner for each forest edge."""

    def run(t: pa.Table) -> pa.Table:
        # equal rows in equal order, so that reruns agree
        t = t.sort_by([("side", "ascending"), ("unit", "ascending"), ("cid", "ascending")])
        cid, weight, side, leaf = (t.column(c).to_numpy() for c in ("cid", "m", "side", "unit"))
        x = _vectors(t.column("vec"))
        cuts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (side[1:] != side[:-1])))) if len(cid) else np.empty(0, np.int64)
        places = np.split(np.arange(len(cid)), cuts[1:])
        trees = [CoverTree(x[p]) for p in places]
        left, right = ([i for i, p in enumerate(places) if side[p[0]] == k] for k in (0, 1))
        # one bundle with itself: each pair of its leaves once
        pairs = [(i, j) for i in left for j in right] if right else [(i, j) for i in left for j in left if i <= j]
        links, src, dst = np.zeros(len(cid), np.int64), [], []
        for i, j in pairs:
            rows, columns, close = dual(trees[i], trees[j], cosine)
            if i == j:
                close &= rows[:, None] != columns[None, :]
            a, b = places[i][rows], places[j][columns]
            links[a] += close @ weight[b]
            if i != j:
                links[b] += weight[a] @ close
            p, q = np.nonzero(np.triu(close)) if i == j else np.nonzero(close)
            for s, d in forest(a[p], b[q], len(cid)):
                src.append(s)
                dst.append(d)
        edges = forest(np.array(src, np.int64), np.array(dst, np.int64), len(cid))
        hit = np.flatnonzero(links)
        ids = [*cid[hit].tolist(), *(cid[i] for i, _ in edges)]
        return pa.table(
            {
                "cid": pa.array(ids, pa.int64()),
                "links": pa.array([*links[hit].tolist(), *([None] * len(edges))], pa.int64()),
                "partner": pa.array([*([None] * len(hit)), *(cid[j] for _, j in edges)], pa.int64()),
            }
        )

    return run


def _net(radius: float):
    """Of each node's candidates those that stand apart by the radius."""

    def run(batches):
        for batch in batches:
            out = []
            for vectors, fan in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, kept = unit(np.array(vectors, np.float64)), []
                for i in range(len(x)):
                    if len(kept) < fan and (not kept or _distance(x[kept] @ x[i]).min() > radius):
                        kept.append(i)
                out.append([vectors[i] for i in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["node", "centres"])

    return run


#: Rows of a node that meet its centres in one task, where the centres of all nodes are too many to be sent around.
PART = 16_384


def _nearest(x: np.ndarray, centres: np.ndarray, node: str) -> tuple[list[str], np.ndarray]:
    """The child of the node that each vector goes to, and its distance from that child's centre."""
    dots = x @ centres.T
    k = dots.argmax(1)
    return [f"{node}/{i}" for i in k], _distance(dots[np.arange(len(x)), k])


def _assign(sent):
    """The nearest centre of each vector, and its distance. sent holds the centres of nodes."""

    def run(batches):
        for batch in batches:
            node, vec = np.array(batch.column(1).to_pylist(), object), batch.column(2)
            name, far = node.copy(), np.full(len(node), np.nan)
            for own in np.unique(node.astype(str)):
                rows = np.flatnonzero(node == own)
                if (centres := sent.value.get(own)) is not None:
                    name[rows], far[rows] = _nearest(_vectors(vec.take(pa.array(rows))), centres, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), vec, batch.column(3), pa.array(node, pa.string()), pa.array(far, pa.float64(), mask=np.isnan(far))], names=["cid", "node", "vec", "m", "parent", "far"])

    return run


def _assign_part(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """As _assign, for some rows of one node and its centres, which are there once."""
    own = rows["node"][0].as_py()
    name, far = _nearest(_vectors(rows["vec"]), unit(np.array(centres["centres"][0].as_py(), np.float64)), own)
    return pa.table([rows["cid"], pa.array(name, pa.string()), rows["vec"], rows["m"], rows["node"], pa.array(far, pa.float64())], names=["cid", "node", "vec", "m", "parent", "far"])


def _upper(classes: DataFrame, scratch: Scratch, cosine: float, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the leaf of each class, and the pairs of leaves that the traversal leaves."""
    members = classes
    most = float(_distance(np.float64(cosine))) + _SLACK
    pairs = scratch.write(classes.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct(), "roots")
    for level in range(DEPTH):
        large = members.groupBy("node").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).where(F.col("n") > leaf)
        large = scratch.write(large.withColumn("fan", F.least(F.ceil(2 * F.col("n") / leaf), F.lit(FAN)).cast("int")), "large")
        count, dim = large.agg(F.count("*"), F.max("dim")).first()
        if not count:
            break
        # FAN candidates at most, each the least of its own slot
        slot = F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(FAN))
        picked = members.join(small(large.select("node", "fan"), 64, count), "node").groupBy("node", slot.alias("slot"), "fan").agg(F.min_by("vec", F.xxhash64("cid")).alias("vec"))
        picked = picked.groupBy("node", "fan").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "vec"))), lambda s: s["vec"].cast("array<double>")).alias("vecs"))
        centres = scratch.write(picked.select("node", "vecs", "fan").mapInArrow(_net(2.0**-level), "node string, centres array<array<double>>"), "centres")
        ddl = f"{members.schema.toDDL()}, parent string, far double"
        if count * (FAN * 8 * dim + 64) <= BROADCAST_BYTES:
            of = {r["node"]: unit(np.array(r["centres"], np.float64)) for r in centres.collect()}
            moved = members.mapInArrow(_assign(members.sparkSession.sparkContext.broadcast(of)), ddl)
        else:
            parts = large.select("node", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
            held = members.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).select("cid", "node", "vec", "m", "part")
            given = centres.join(parts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centres")
            moved = held.groupBy("node", "part").cogroup(given.groupBy("node", "part")).applyInArrow(_assign_part, ddl)
            whole = members.join(parts, "node", "left_anti")
            moved = moved.unionByName(whole.select(*members.columns, F.col("node").alias("parent"), F.lit(None).cast("double").alias("far")))
        moved = scratch.write(moved, "members")
        # a node that was not split has neither centre nor radius; its pairs stay as they are
        nodes = moved.groupBy("node", "parent").agg(F.max("far").alias("radius"))
        placed = centres.select("node", F.posexplode("centres").alias("k", "v"))
        placed = placed.select(F.concat_ws("/", "node", "k").alias("node"), F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).alias("centre"))
        nodes = scratch.write(nodes.join(placed, "node", "left"), "nodes")
        a, b = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in "ab")
        both = pairs.join(a, F.col("a") == F.col("a_parent")).join(b, F.col("b") == F.col("b_parent"))
        dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        apart = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) - F.col("a_radius") - F.col("b_radius")
        both = both.where(apart.isNull() | (apart <= most))
        pairs = scratch.write(both.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "pairs")
        members = moved.select(classes.columns)
    return members, pairs


def close_vectors(vectors: DataFrame, cosine: float = 0.98, leaf: int = LEAF, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Vectors of equal labels and lengths are linked if their cosine in double precision is at least the given
    one. A label that is null, and a vector that is null, empty, zero or holds null or non-finite numbers,
    links with nothing: the row is its own component. Rows may repeat, and count as vectors of their own. A
    row without id is linked and counted, but names no component of others; alone it has a null one. Other
    columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "cover-tree")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("node", F.when(F.coalesce(finite, F.lit(False)), F.concat_ws(":", F.size("vec"), "label")))
    v = v.withColumn("node", F.when(F.col("label").isNotNull(), F.col("node")))
    classes = v.where("node is not null").groupBy("node", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("cid"), "node", "vec", "m", "least"), "classes")
    members, pairs = _upper(classes.select("cid", "node", "vec", "m"), scratch, cosine, leaf)

    # leaves too large are cut into chunks; neighbouring chunks of one root make a bundle
    size = members.groupBy("node").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / leaf).cast("int"))
    root = F.substring_index("node", "/", 1)
    units = size.select("node", root.alias("root"), (F.col("n") / F.col("chunks")).alias("n"), F.posexplode(F.sequence(F.lit(1), F.col("chunks"))).alias("chunk", "of"), "chunks")
    upto = F.sum("n").over(Window.partitionBy("root").orderBy("node", "chunk").rowsBetween(Window.unboundedPreceding, 0))
    bundle = F.floor((upto - F.col("n") / 2) / (leaf * BUNDLE)).cast("long")
    units = scratch.write(units.select(F.monotonically_increasing_id().alias("unit"), "node", "chunk", "chunks", F.xxhash64("root", bundle).alias("bundle")), "units")
    n = units.count()
    of = scratch.write(units.groupBy("node").agg(F.collect_set("bundle").alias("bundles")), "bundles")
    a, b = (of.select(F.col("node").alias(s), F.explode("bundles").alias(f"{s}_bundle")) for s in "ab")
    blocks = pairs.join(a, "a").join(b, "b").select(F.least("a_bundle", "b_bundle").alias("p"), F.greatest("a_bundle", "b_bundle").alias("q")).distinct()
    blocks = scratch.write(blocks.select(F.monotonically_increasing_id().alias("block"), "p", "q"), "blocks")
    sides = blocks.select("block", F.col("p").alias("bundle"), F.lit(0).alias("side")).unionByName(blocks.where("p <> q").select("block", F.col("q").alias("bundle"), F.lit(1).alias("side")))
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    counts = units.select("node", "chunks").distinct()
    dealt = members.join(small(counts, 64, n), "node").withColumn("chunk", chunk).join(small(units.drop("chunks"), 80, n), ["node", "chunk"])
    dealt = dealt.join(sides, "bundle").select("block", "side", "unit", "cid", "m", "vec")
    found = scratch.write(dealt.groupBy("block").applyInArrow(_compare(cosine), _FOUND), "found")

    links = found.where("links is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.where("partner is not null").select(F.col("cid").alias("src"), F.col("partner").alias("dst"))
    roots = connected_components(edges, scratch)
    classes = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    classes = scratch.write(classes.select("cid", "node", "vec", "m", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "linked")
    named = scratch.write(classes.groupBy("root").agg(F.min("least").alias("component")), "named")
    classes = classes.join(named, "root").select("node", "vec", (F.col("links") + F.col("m") - 1).alias("n_links"), "component")
    out = v.join(classes, ["node", "vec"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
