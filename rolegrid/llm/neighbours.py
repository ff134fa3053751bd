"""Nearest neighbours by largest inner product: a vantage-point tree for each shard of the table.

A shard is a hash of the id and holds about ``shard_rows`` vectors. In a shard, vectors get one more component that
gives all of them the same length; then the largest inner product is the smallest Euclidean distance, a metric. A
node of the tree has a vantage point and two halves of its vectors with the least and greatest distance to that
point. By the triangle inequality a half cannot hold anything nearer than ``bound``, the gap between the query's
distance to the vantage point and that range. A half is skipped if ``factor * bound`` exceeds the distance of the
k-th best so far: factor one is exact search, a larger factor prunes more. The best k of all shards are merged.

Queries meet every shard in blocks of ``block_rows``; scores are computed on the original vectors in double
precision, ties go to the smaller id.

Defined results: null ids, null or zero vectors, and vectors with null or non-finite components take no part;
vectors of different length never meet; of rows with one id the smallest vector counts; a query never finds its own
id; an empty table gives an empty table. Only the id and the vector column are read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.llm.common import staged

LEAF = 128


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a last component that makes all of them as long as the longest."""
    squares = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], axis=1)


def build(points: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points and the nodes: (low, high) for a leaf, else (low, high, vantage, (near, far) children
    as (node, least, greatest distance))."""
    order, nodes = np.arange(len(points)), []

    def grow(low: int, high: int) -> int:
        at = len(nodes)
        nodes.append((low, high))
        if high - low > LEAF:
            vantage = points[order[low]].copy()
            distance = np.sqrt(((points[order[low:high]] - vantage) ** 2).sum(axis=1))
            by = np.argsort(distance, kind="stable")
            order[low:high] = order[low:high][by]
            distance, middle = distance[by], (high - low) // 2
            children = []
            for a, b in ((0, middle), (middle, high - low)):
                children.append((grow(low + a, low + b), distance[a], distance[b - 1]))
            nodes[at] = (low, high, vantage, children)
        return at

    grow(0, len(points))
    return order, nodes


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last, so that equal vectors score alike."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


class Search:
    """Search of one shard by one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: list[tuple], query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.vectors, self.nodes, self.k, self.factor = ids, vectors, nodes, k, factor
        self.query_ids, self.queries = query_ids, queries
        self.lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        # squared distance = base - 2 * inner product
        self.base = (queries * queries).sum(axis=1) + (vectors * vectors).sum(axis=1).max(initial=0)
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(0, np.arange(len(queries)))

    def visit(self, node: int, active: np.ndarray) -> None:
        low, high, *split = self.nodes[node]
        if not split:
            self.leaf(low, high, active)
            return
        vantage, children = split
        distance = np.sqrt(((self.lifted[active] - vantage) ** 2).sum(axis=1))
        nearer = distance <= (children[0][2] + children[1][1]) / 2
        for part, order in ((nearer, children), (~nearer, children[::-1])):
            for child, least, greatest in order:
                mine, d = active[part], distance[part]
                bound = np.maximum(np.maximum(d - greatest, least - d), 0)
                reach = np.sqrt(np.maximum(self.base[mine] - 2 * self.best[mine, -1], 0))
                mine = mine[self.factor * bound <= reach + 1e-9]
                if len(mine):
                    self.visit(child, mine)

    def leaf(self, low: int, high: int, active: np.ndarray) -> None:
        ids, vectors = self.ids[low:high], self.vectors[low:high]
        rough = self.queries[active] @ vectors.T
        slack = 1e-9 * np.maximum(1, np.abs(rough).max(initial=0))
        near = (rough >= self.best[active, -1][:, None] - slack) & (self.query_ids[active][:, None] != ids)
        row, column = np.nonzero(near)
        if not len(row):
            return
        score = products(self.queries[active[row]], vectors[column])
        touched, of = np.unique(row, return_inverse=True)
        lines = active[touched]
        rows = np.concatenate([np.repeat(np.arange(len(lines)), self.k), of])
        scores = np.concatenate([self.best[lines].ravel(), score])
        names = np.concatenate([self.found[lines].ravel(), ids[column]])
        by = np.lexsort((names, -scores, rows))
        starts = np.searchsorted(rows[by], np.arange(len(lines)))
        take = by[starts[:, None] + np.arange(self.k)]
        self.best[lines], self.found[lines] = scores[take], names[take]


def usable(vector: Column) -> Column:
    """True where a vector takes part."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(table: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``is_query`` holds."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = staged(rows.withColumn("dim", F.size("v")), "vectors")
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("bigint")), F.lit(0))).first()
    shards, blocks = max(1, math.ceil(total / shard_rows)), max(1, math.ceil(asked / block_rows))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def plant(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        vectors = _matrix(group["v"].combine_chunks())
        order, nodes = build(lifted(vectors))
        ids = group["id"].to_numpy()[order]
        return pa.table({"dim": group["dim"][:1], "shard": group["shard"][:1], "tree": pa.array([pickle.dumps((ids, vectors[order], nodes))], pa.binary())})

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"dim": group["dim"][:1], "block": pa.array([group["block"][0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps((group["id"].to_numpy(), _matrix(group["v"].combine_chunks())))], pa.binary())})

    trees = staged(rows.withColumn("shard", shard).select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInArrow(plant, "dim int, shard int, tree binary"), "trees")
    packed = rows.where("q").withColumn("block", block).select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, queries binary")
    meetings = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, ["dim", "shard"]).select("queries", "tree")

    def search(batches):
        for batch in batches:
            for queries, tree in zip(batch.column(0), batch.column(1)):
                query_ids, asked_for = pickle.loads(queries.as_py())
                found = Search(*pickle.loads(tree.as_py()), query_ids, asked_for, k, factor)
                row, rank = np.nonzero(found.best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found.found[row, rank]), pa.array(found.best[row, rank])], ["query_id", "vec_id", "score"])

    near = meetings.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
