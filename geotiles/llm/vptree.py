"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt by a hash into shards of bounded size.  Every shard builds a
tree: a node's vantage point splits the node's vectors at the median of their
distances to it.  A query goes down to the nearer side first and skips the other
where the triangle inequality, relaxed by ``factor``, says that it holds nothing
nearer than the worst of the neighbours found: |d - median| * factor >= worst.
With factor 1 that is exact; a larger factor prunes more and may lose some.

Each shard's tree is built and written once, as one packed row; so is each block of
queries.  Each block meets each shard in one task, so neither side is ever in one
place, and a block's queries go down the tree together, some ``TURN`` at a time, as arrays.
What is shipped is (rows / shard_rows) copies of the queries and (queries /
block_queries) copies of the vectors.  Distances are those of the original vectors in double
precision, by the difference of the components.

Defined cases: vectors that are null, empty, all zero or hold null or
non-finite components take no part, neither as queries nor as candidates; nor do
candidates of another length than the query's.  Ties go to the smaller id.  A
query's own row is no candidate; every other row is, also one of the same id and
vector.  Fewer candidates than k give them all.  Rows with a null id take no part;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotiles.llm.common import materialize, table

#: Vectors of a shard, about.
SHARD_ROWS = 8192
#: Queries of a block, about.
BLOCK_QUERIES = 8192
#: Queries that go down a tree together.
TURN = 1024
#: Vectors of a leaf, which are compared one by one.
LEAF = 256
#: How far pruning is relaxed; 1 is exact.
FACTOR = 1.0
K = 10


@dataclass
class Node:
    """``low`` and ``high`` bound the distances of a side's vectors to the vantage point."""

    members: np.ndarray | None = None
    vantage: int = -1
    inner: Node | None = None
    outer: Node | None = None
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = points - to
    return np.sqrt(np.einsum("...i,...i->...", gap, gap))


def build(points: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF, rng: np.random.Generator | None = None) -> Node:
    """The tree of a shard's points; the vantage point is the best spread of a few random ones."""
    members = np.arange(len(points)) if members is None else members
    rng = rng or np.random.default_rng(7)
    if len(members) <= leaf:
        return Node(members=members)
    tried = rng.choice(members, min(5, len(members)), replace=False)
    some = points[rng.choice(members, min(100, len(members)), replace=False)]
    vantage = int(max(tried, key=lambda v: float(np.var(distances(some, points[v])))))
    rest = members[members != vantage]
    far = distances(points[rest], points[vantage])
    order = np.argsort(far, kind="stable")
    rest, far = rest[order], far[order]
    half = len(rest) // 2
    return Node(
        None, vantage, build(points, rest[:half], leaf, rng), build(points, rest[half:], leaf, rng), (float(far[0]), float(far[half - 1])), (float(far[half]), float(far[-1]))
    )


def pack(tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """A tree as arrays: its leaves' members one after the other, and a row for each node, children after parents."""
    members, rows = [], []

    def add(node: Node) -> int:
        at = len(rows)
        rows.append([-1.0] * 9)
        if node.members is not None:
            first = sum(map(len, members))
            members.append(node.members)
            rows[at] = [first, first + len(node.members), -1, -1, -1, 0, 0, 0, 0]
        else:
            inner, outer = add(node.inner), add(node.outer)
            rows[at] = [0, 0, node.vantage, inner, outer, *node.inner_range, *node.outer_range]
        return at

    add(tree)
    return np.concatenate(members).astype(np.int64), np.array(rows, float)


def unpack(members: np.ndarray, rows: np.ndarray, at: int = 0) -> Node:
    first, last, vantage, inner, outer, *ranges = rows[at].tolist()
    if vantage < 0:
        return Node(members=members[int(first) : int(last)])
    return Node(None, int(vantage), unpack(members, rows, int(inner)), unpack(members, rows, int(outer)), tuple(ranges[:2]), tuple(ranges[2:]))


class Search:
    """The k nearest of a shard for some queries; ``seen`` counts the distances computed.

    ``rows`` are numbers of the points' rows and ``own`` those of the queries' (without them, ids serve).
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float, rows: np.ndarray | None = None) -> None:
        self.points, self.ids, self.queries, self.own, self.k, self.factor = points, ids, queries, own, k, factor
        self.rows = ids if rows is None else rows
        self.best = np.full((len(queries), k), np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.seen = 0

    def offer(self, asked: np.ndarray, members: np.ndarray, far: np.ndarray) -> None:
        """Merge distances (asked x members) into the nearest so far, ties to the smaller id."""
        ids = np.broadcast_to(self.ids[members], far.shape)
        far = np.where(self.own[asked][:, None] == self.rows[members], np.inf, far)  # a query's own row
        every, every_id = np.concatenate([self.best[asked], far], axis=1), np.concatenate([self.best_id[asked], ids], axis=1)
        every_id = np.where(np.isinf(every), np.iinfo(np.int64).max, every_id)
        order = np.lexsort((every_id, every), axis=1)[:, : self.k]
        self.best[asked], self.best_id[asked] = np.take_along_axis(every, order, 1), np.take_along_axis(every_id, order, 1)

    def visit(self, node: Node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if node.members is not None:
            if len(node.members):
                far = np.stack([distances(self.points[node.members], q) for q in self.queries[asked]])
                self.seen += far.size
                self.offer(asked, node.members, far)
            return
        at = np.array([node.vantage])
        far = distances(self.queries[asked], self.points[node.vantage])
        self.seen += len(far)
        self.offer(asked, at, far[:, None])
        # the side that may hold the nearer vectors goes first, which tightens the bound for the other
        sides = ((node.inner, node.inner_range), (node.outer, node.outer_range))
        near = far <= (node.inner_range[1] + node.outer_range[0]) / 2
        for turn in (0, 1):
            for side in (0, 1):
                child, (low, high) = sides[side]
                mine = near == (side == turn)
                bound = np.maximum(np.maximum(low - far[mine], far[mine] - high), 0)
                # a tie at the bound may still win by its id, hence not >=
                self.visit(child, asked[mine][bound * self.factor * (1 - 1e-12) <= self.best[asked[mine], -1]])


def nearest(vectors: DataFrame, k: int = K, every: int = 100, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id that ``every`` divides, its ``k`` nearest other rows.

    ``vectors`` has ``vec_id`` and ``embedding`` (array of numbers).
    """
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    # tasks draw from every part of the input; repeated rows are spread by their order
    good = materialize(good.withColumn("n", F.monotonically_increasing_id()))
    asked = good.where(F.col("vec_id") % every == 0)
    shards, blocks = max(1, -(-good.count() // shard_rows)), max(1, -(-asked.count() // block_queries))
    size = F.size("v").alias("size")
    shard = F.pmod(F.xxhash64("vec_id", "n"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("n", F.lit(1)), F.lit(blocks)).cast("int").alias("block")

    def packed(rows: pa.Table, key: str, planted: bool) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("n", "ascending")])
        points = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        arrays = {"ids": rows.column("vec_id").to_numpy(), "ns": rows.column("n").to_numpy(), "points": points}
        if planted:
            arrays["members"], arrays["nodes"] = pack(build(points))
        held = {name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for name, x in arrays.items()}
        return pa.table({key: rows.column(key).slice(0, 1).combine_chunks(), "size": rows.column("size").slice(0, 1).combine_chunks(), **held})

    both = "size int, ids binary, ns binary, points binary"
    trees = materialize(good.select(shard, size, "vec_id", "n", "v").groupBy("shard", "size").applyInArrow(lambda t: packed(t, "shard", True), f"shard int, {both}, members binary, nodes binary"))
    queries = materialize(asked.select(block, size, "vec_id", "n", "v").groupBy("block", "size").applyInArrow(lambda t: packed(t, "block", False), f"block int, {both}"))
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(key: tuple, tree: pa.Table, asked: pa.Table) -> pa.Table:
        names = ("row", "query_id", "vec_id", "score")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        if not tree.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        of = lambda t, name, kind: np.frombuffer(t.column(name)[0].as_py(), kind)
        ids, ns, own_ids, own = of(tree, "ids", np.int64), of(tree, "ns", np.int64), of(asked, "ids", np.int64), of(asked, "ns", np.int64)
        points, wanted = of(tree, "points", np.float64).reshape(len(ids), -1), of(asked, "points", np.float64).reshape(len(own), -1)
        root = unpack(of(tree, "members", np.int64), of(tree, "nodes", np.float64).reshape(-1, 9))
        out = []
        for at in range(0, len(own), TURN):
            part = slice(at, at + TURN)
            search = Search(points, ids, wanted[part], own[part], k, factor, ns)
            search.visit(root, np.arange(len(own[part])))
            found = np.isfinite(search.best)
            row, _ = np.nonzero(found)
            out.append(pa.table([pa.array(x, t) for x, t in zip((own[part][row], own_ids[part][row], search.best_id[found], search.best[found]), kinds, strict=True)], names=names))
        return pa.concat_tables(out)

    keys = ["shard", "block", "size"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
