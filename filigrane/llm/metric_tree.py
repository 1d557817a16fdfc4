"""Exact top-k by inner product with an M-tree and best-first search.

One more coordinate, sqrt(M - |x|^2), puts all vectors on a sphere, where a larger inner product is a smaller
distance.  The candidates are dealt into shards of bounded size, each an M-tree of paged nodes: a routing
vector, the radius that covers the node, and its distance to the parent's routing vector.  A query walks a
shard's nodes by their largest possible score; the distance to the parent and the stored one bound the
distance of a node, and of each vector of a leaf, before that is computed.  Queries stream past every shard, whose
tree is built once for them, and the shards' results are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.llm.shared import lean, prepare, table

SCALE = 256
TOP = 5
EVERY = 50
#: Vectors of a shard, and of a leaf page.
SHARD_ROWS = 16_384
PAGE_ROWS = 1024
FAN_OUT = 16
#: Queries that a task answers on a shard, a batch at a time: so many that building the shard's tree costs nothing beside them.
BLOCK_ROWS = 262_144
#: What components and scores are held to: numbers beyond count as these.
LEAST, MOST = -(2**63), 2**63 - 1


class Node:
    """A page. An inner one: its children, and as arrays their routing vectors, covering radii and distances to its own.

    A leaf: rows in order of their ids, their vectors and their distances to its routing vector.
    """

    __slots__ = ("away", "centre", "centres", "children", "least_id", "radii", "radius", "rows", "to_parent", "vectors")


class MTree:
    """Over integer vectors (rows of x, int64 or float64 below 2**53) with their ids. Scores are exact, held to 64 bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        real = x.astype(np.float64)
        self.largest = int(np.abs(real).max(initial=0.0))
        self.ids, self.x = ids, real if self.largest < 2**53 else x
        norms = (real**2).sum(1)
        self.most = float(norms.max(initial=0.0))
        self.points = np.column_stack([real, np.sqrt(np.maximum(0.0, self.most - norms))])
        self.root = self._build(np.arange(len(ids))) if len(ids) else None

    def products(self, vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products with an integer vector, exact, then held to 64 bits."""
        most = int(np.abs(q.astype(np.float64)).max(initial=0.0))
        if max(1, most) * max(1, self.largest) * max(1, len(q)) < 2**53:
            return vectors @ q.astype(np.float64)
        whole = np.array([int(c) for c in q], object)
        return np.array([min(max(int(s), LEAST), MOST) for s in np.array([[int(c) for c in v] for v in vectors], object).reshape(len(vectors), len(q)) @ whole], object)

    def _build(self, rows: np.ndarray) -> Node:
        points = self.points[rows]
        node = Node()
        centre = points.mean(0)
        node.centre = centre = points[((points - centre) ** 2).sum(1).argmin()]
        away = np.sqrt(((points - centre) ** 2).sum(1))
        node.radius, node.least_id = float(away.max()), int(self.ids[rows].min())
        node.children = None
        if len(rows) <= PAGE_ROWS or node.radius == 0.0:
            order = np.argsort(self.ids[rows], kind="stable")
            node.rows, node.away = rows[order], away[order]
            node.vectors = self.x[node.rows[:1]] if node.radius == 0.0 else self.x[node.rows]
            return node
        picks = [int(away.argmax())]  # routing vectors far from each other
        near = np.full(len(rows), np.inf)
        owner = np.zeros(len(rows), np.int64)
        fan = max(2, min(FAN_OUT, -(-len(rows) // PAGE_ROWS)))
        for k in range(fan):
            d = ((points - points[picks[-1]]) ** 2).sum(1)
            closer = d < near
            near[closer], owner[closer] = d[closer], k
            if near.max() == 0.0:
                break
            picks.append(int(near.argmax()))
        node.children = [self._build(rows[owner == k]) for k in np.unique(owner)]
        node.centres = np.array([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.to_parent = np.sqrt(((node.centres - centre) ** 2).sum(1))
        return node

    def search(self, q: np.ndarray, own: int | None, k: int) -> tuple[list[tuple], int, int]:
        """The k best (score, id), ties to the smaller id, without rows of id own; how many pages were read, and products made."""
        if self.root is None:
            return [], 0, 0
        query = np.append(q.astype(np.float64), 0.0)
        base = float((query**2).sum()) + self.most
        slack = 1e-6 * (base + 1.0)

        def upper(distance):  # the largest inner product at so small a distance
            return np.maximum((base - np.maximum(0.0, distance) ** 2) / 2 + slack, float(LEAST))

        best: list[tuple] = []  # heap of (score, -id)
        first = float(np.sqrt(((query - self.root.centre) ** 2).sum()))
        queue, tie, pages = [(-float(upper(first - self.root.radius)), 0, first, self.root)], 0, 0
        products = 0
        while queue:
            bound, _, distance, node = heapq.heappop(queue)
            full = len(best) == k
            if full and -bound < best[0][0]:
                break
            if node.children is not None:
                near = np.arange(len(node.children))
                if full:  # those that the stored distances don't rule out
                    near = np.flatnonzero(upper(np.abs(distance - node.to_parent) - node.radii) >= best[0][0])
                d = np.sqrt(((node.centres[near] - query) ** 2).sum(1))
                for i, at, b in zip(near.tolist(), d.tolist(), upper(d - node.radii[near]).tolist(), strict=True):
                    if not full or b >= best[0][0]:
                        tie += 1
                        heapq.heappush(queue, (-b, tie, at, node.children[i]))
                continue
            rows, vectors = node.rows, node.vectors
            if full and node.radius > 0.0:  # the same for its vectors; a few less are not worth a copy
                near = upper(np.abs(distance - node.away)) >= best[0][0]
                if 2 * np.count_nonzero(near) < len(rows):
                    rows, vectors = rows[near], vectors[near]
            if not len(rows):
                continue
            products += len(vectors)
            scores = self.products(vectors, q)
            if full and (most := scores.max()) <= best[0][0] and (most < best[0][0] or node.least_id >= -best[0][1]):
                pages += node.radius > 0.0
                continue
            pages += 1
            if node.radius == 0.0:  # equal vectors share one score
                scores = scores.repeat(len(rows))
            top = np.flatnonzero(scores >= best[0][0]) if full else np.arange(len(rows))
            if own is not None:  # before the cut, as an id may have any number of rows
                top = top[self.ids[rows[top]] != own]
            top = top[np.argsort(-scores[top], kind="stable")][:k]  # rows are in order of their ids
            for i in top.tolist():
                vec, score = int(self.ids[rows[i]]), int(scores[i])
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
        return [(s, -v) for s, v in sorted(best, reverse=True)], pages, products


def exact_matrix(vectors: list[np.ndarray], scale: int = SCALE, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of float64 components as int64, held to 64 bits; rows are cut or filled with zeros to the width, else to the longest."""
    width = max((len(v) for v in vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width), np.int64)
    with np.errstate(over="ignore"):
        for row, v in zip(out, vectors, strict=True):
            real = np.floor(scale * np.asarray(v[:width], np.float64))
            inside = np.abs(real) < 2.0**63
            row[: len(real)] = np.where(inside, np.where(inside, real, 0.0).astype(np.int64), np.where(real > 0, MOST, LEAST))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k largest inner products with every vector but its own.

    Both tables have vec_id and embedding.  Rows whose vec_id or embedding is null, or whose embedding holds a
    null or a component that isn't finite, take no part; missing components of shorter vectors count as 0.
    A query's own rows are all those of its vec_id; rows repeated under other ids are candidates like any, and
    a vec_id that is repeated can come up once a row.  Ties go to the smaller vec_id.  Scaled components outside 64 bits
    count as the nearest number inside, and so do scores, which then tie.  Vectors of any length are read; other
    columns, whatever their names, are ignored.  Without queries or candidates there are no rows.  One job counts
    both tables.
    """

    def usable(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).filter("vec_id is not null and embedding is not null").filter(~bad)

    candidates, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id", "embedding"])
    n, m = candidates.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # rows of one vec_id are dealt apart too: a repeated one is no shard of its own
    deal = lambda n_own: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_own))
    copied = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = candidates.withColumn("shard", deal(shards)).withColumn("block", copied(blocks)).withColumn("asks", F.lit(False))
    right = asked.withColumn("block", deal(blocks)).withColumn("shard", copied(shards)).withColumn("asks", F.lit(True))

    def search(batches):
        import pyarrow as pa

        key, ids, vectors, tree = None, [], [], None
        for batch in batches:
            found: list[tuple] = []
            for shard, block, asks, vec, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "asks", "vec_id", "embedding")), strict=True):
                if (shard, block) != key:
                    key, ids, vectors, tree = (shard, block), [], [], None
                if not asks:
                    ids.append(vec)
                    vectors.append(np.array(v, np.float64))
                elif ids:
                    if tree is None:  # a shard's candidates come before its questions
                        tree = MTree(np.array(ids, np.int64), exact_matrix(vectors, scale))
                        vectors = []
                    q = exact_matrix([np.array(v, np.float64)], scale, tree.x.shape[1])[0]
                    found += [(vec, other, score) for score, other in tree.search(q, vec, k)[0]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])
        lean()

    rows = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    some = rows.select("shard", "block", "asks", "vec_id", "embedding").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_metric_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every 50th vector among all others."""
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
