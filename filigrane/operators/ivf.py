"""Vector search over inverted lists: approximate by the nearest lists, or exact by a bound of every list.

Centroids are learned from a bounded sample; every vector is stored, at unit length, in the partition of its nearest
centroid.  A query reads the lists of its nearest centroids only.  In the exact form its k-th best score then is a
floor, and lists are read besides whose angle to the query could hold a better vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are learned from, rounds of learning, and the most lists.
SAMPLE_ROWS = 20_000
ROUNDS = 8
MOST_LISTS = 4096
#: Share of the sample's own nearest neighbours that the lists a query reads by default must hold.
RECALL = 0.95
#: Queries of one search: their vectors go to every task.
MOST_QUERIES = 10_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length; zeros stay zeros."""
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1.0)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector (array<double>) of rows whose vector is neither null nor empty and holds finite numbers only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.size(F.coalesce(vector, F.array())) > 0).filter(~bad).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by cosine: k-means from evenly taken rows; an empty centre keeps its place."""
    centre = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        met = np.bincount(own, minlength=lists) > 0
        centre[met] = unit(sums[met])
    return centre


def enough_lists(sample: np.ndarray, centre: np.ndarray, k: int = 10, share: float = RECALL) -> int:
    """How many of its nearest lists a query must read to find a share of its k nearest neighbours, by the sample itself."""
    asked = sample[:: max(1, len(sample) // 200)][:200]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    own = (sample @ centre.T).argmax(1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), share, method="higher")) + 1


def write_lists(vectors: DataFrame, key: str, vector: str, path: str, lists: int | None = None) -> None:
    """path/lists (by list) and path/centres. Every usable vector is stored; one of another length than most is an error.

    lists: by default the root of the number of vectors, at most MOST_LISTS.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    n = rows.count()
    lists = max(1, min(MOST_LISTS, lists or round(n**0.5), n))
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64("key", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(SAMPLE_ROWS).select("vector").toArrow()  # bounded
    told = picked.column("vector").to_pylist()
    if len({len(v) for v in told}) > 1:
        raise ValueError("vectors are not of one length")
    found = np.array(told, np.float64) if told else np.zeros((0, 1))
    centre = centroids(unit(found), min(lists, max(1, len(found)))) if len(found) else np.zeros((1, 1))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("vector")
            if not len(column):
                continue
            if set(column.value_lengths().to_numpy().tolist()) != {centre.shape[1]}:
                raise ValueError(f"a vector's length is not {centre.shape[1]}")
            own = unit(column.flatten().to_numpy().reshape(len(column), -1))
            near = own @ centre.T
            at = near.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(range(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel())), pa.array(near[np.arange(len(at)), at]), pa.array(at.astype(np.int32))], names=["key", "vector", "cosine", "list"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"key {kind}, vector array<double>, cosine double, list int")
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("key"), F.lit(max(1, n // 1_000_000)))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")  # a list that many share has many files
    probes = enough_lists(unit(found), centre) if len(found) else 1
    known = spark.createDataFrame([(i, c.tolist(), probes, kind) for i, c in enumerate(centre)], "list int, centre array<double>, probes int, kind string")
    spans = spark.read.schema(f"key {kind}, vector array<double>, cosine double, list int").parquet(f"{path}/lists").groupBy("list").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    known.join(spans, "list", "left").write.mode("overwrite").parquet(f"{path}/centres")


def search_lists(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, key: str = "key") -> DataFrame:
    """query_id, key, score, rank: the k stored vectors of the largest cosine for each query (query_id, vector).

    probes: lists that a query reads, by default as many as enough_lists told when the lists were written.
    exact: also reads each list that may hold a better one.  Scores count to twelve places, ties go to the smaller
    key.  Queries with a null, empty or not finite vector have no row; more than MOST_QUERIES are an error, search
    them in blocks.
    """
    asked = usable(queries, "query_id", "vector").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search them in blocks")
    every = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most MOST_LISTS
    known = [r for r in every if r["n"]]
    kind, of = every[0]["kind"], queries.schema["query_id"].dataType.simpleString()
    rows = spark.read.schema(f"key {kind}, vector array<double>, cosine double, list int").parquet(f"{path}/lists")
    shape = f"query_id {of}, {key} {kind}, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    if not asked or not known:
        return spark.createDataFrame([], shape + ", rank int")
    ids, wanted = [r["key"] for r in asked], unit(np.array([r["vector"] for r in asked], np.float64))
    names = np.array([r["list"] for r in known])
    near = wanted @ np.array([r["centre"] for r in known]).T

    def read(take: np.ndarray) -> DataFrame:
        """The best k of each query in each batch of the lists it takes (queries by lists)."""
        here = {int(names[j]): np.flatnonzero(take[:, j]) for j in np.flatnonzero(take.any(0))}

        def score(batches):
            import pyarrow as pa

            for batch in batches:
                lists = batch.column("list").to_numpy()
                vectors = batch.column("vector").flatten().to_numpy().reshape(len(lists), -1)
                who, which, what = [], [], []
                for one in np.unique(lists).tolist():
                    at, by = np.flatnonzero(lists == one), here[one]
                    scores = np.round(wanted[by] @ vectors[at].T, 12)
                    floor = np.partition(scores, -k, axis=1)[:, -k:].min(1) if scores.shape[1] > k else np.full(len(by), -2.0)
                    q, r = np.nonzero(scores >= floor[:, None])  # ties of the last one too
                    who.append(by[q])
                    which.append(at[r])
                    what.append(scores[q, r])
                if who:
                    who, which, what = map(np.concatenate, (who, which, what))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who.tolist()]), batch.column("key").take(pa.array(which)), pa.array(what)], names=["query_id", key, "score"])

        best = rows.filter(F.col("list").isin(sorted(here))).mapInArrow(score, shape)
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = np.zeros(near.shape, bool)
    top = np.argsort(-near, axis=1, kind="stable")[:, : max(1, known[0]["probes"] if probes is None else probes)]
    np.put_along_axis(first, top, True, axis=1)
    found = read(first)
    if not exact:
        return found
    got = found.toArrow().to_pydict()  # k rows a query
    floors = {q: s for q, s, r in zip(got["query_id"], got["score"], got["rank"], strict=True) if r == k}
    floor = np.array([floors.get(i, -2.0) for i in ids])
    radius = np.arccos(np.clip([r["least"] for r in known], -1, 1))
    reach = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius)) + 1e-9
    rest = (reach >= floor[:, None]) & ~first
    both = spark.createDataFrame(list(zip(got["query_id"], got[key], got["score"], strict=True)), shape)
    if rest.any():
        both = both.unionByName(read(rest).drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
