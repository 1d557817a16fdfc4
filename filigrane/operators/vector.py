"""Exact vector search and the deterministic hash embedding, computed once into an index or as a text is searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from filigrane.functions import text as T
from filigrane.functions import vectors as V
from filigrane.operators.bm25 import ranked
from filigrane.session import bounded

BUCKETS = 128
#: Words whose buckets a task keeps; beyond, they are asked anew.
KNOWN_WORDS = 200_000


def search(items: DataFrame, key: str, vector: str, query: DataFrame, query_vector: str, k: int, boost: Column | None = None) -> DataFrame:
    """key, score, rank of the k nearest by cosine; query is one row with its vector; a second row is an error, none finds nothing. Ties go to the smaller key."""
    told = query.select(F.col(query_vector).alias("__q")).limit(2).agg(F.collect_list("__q").alias("all"))
    one = told.filter(F.size("all") > 0).select(F.when(F.size("all") == 1, F.get("all", 0)).otherwise(F.raise_error(F.lit("more than one query vector")).cast("array<double>")).alias("__q"))
    score = V.cosine(F.col(vector), F.col("__q"))
    score = score + boost if boost is not None else score
    return ranked(items.crossJoin(F.broadcast(one)).select(F.col(key), score.alias("score")), key, k)


def bucket_of(word: str, buckets: int = BUCKETS) -> int:
    """The bucket that functions.text.bucket gives."""
    import hashlib

    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % buckets


def hash_vectors(tokens, buckets: int, known: dict[str, int]):
    """A row of unit length for each list of an Arrow array of token lists: word i adds 1/(i+1) to its bucket. No words: zeros."""
    import numpy as np

    n = len(tokens)
    words = tokens.flatten().dictionary_encode()
    own = words.dictionary.to_pylist()
    if len(known) > KNOWN_WORDS:  # a vocabulary grows with the texts
        known.clear()
    for w in own:
        if w not in known:
            known[w] = bucket_of(w, buckets)
    bucket = np.fromiter((known[w] for w in own), np.int64, len(own))[words.indices.to_numpy()] if own else np.zeros(0, np.int64)
    ends = tokens.offsets.to_numpy().astype(np.int64) - (tokens.offsets[0].as_py() if n else 0)
    sizes = np.diff(ends)
    place = np.arange(len(bucket)) - np.repeat(ends[:-1], sizes)
    sums = np.bincount(np.repeat(np.arange(n), sizes) * buckets + bucket, 1.0 / (place + 1), n * buckets).reshape(n, buckets)
    norm = np.sqrt((sums * sums).sum(1))
    return sums / np.where(norm > 0, norm, 1.0)[:, None]


def embedded(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """key, embedding array<double>, boost of every text, in one pass without a shuffle.

    embed: any function from texts to vectors, called a batch at a time in the workers, instead of hash vectors.
    """

    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what it frees
        known: dict[str, int] = {}
        for batch in batches:
            if embed is None:
                rows = hash_vectors(batch.column(2), buckets, known)
                vectors = pa.ListArray.from_arrays(pa.array(range(0, rows.size + 1, buckets), pa.int32()), pa.array(rows.ravel()))
            else:
                vectors = pa.array(embed([t or "" for t in batch.column(2).to_pylist()]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, batch.column(1)], names=[key, "embedding", "boost"])

    bounded(docs.sparkSession)
    said = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key), V.table_boost(said).alias("boost"), (T.tokens(said) if embed is None else said).alias("words"))
    return source.mapInArrow(run, StructType([source.schema[0], StructField("embedding", ArrayType(DoubleType())), StructField("boost", DoubleType())]))


def write_index(docs: DataFrame, key: str, text: str, path: str, **options) -> None:
    """Store the vectors of all texts, so that searches read (key, embedding, boost) and no text."""
    embedded(docs, key, text, **options).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(index: DataFrame, key: str, queries: list[list[float]], k: int, boosted: bool = False) -> DataFrame:
    """asked (the query's place), key, score, rank: of each query vector the k best of an index, all queries in one pass.

    Vectors have unit length, so the dot product is the cosine. Ties go to the smaller key.
    """

    def dot(q: list[float]) -> Column:
        parts = [(i, x) for i, x in enumerate(q) if x]
        score = F.lit(0.0)
        for i, x in parts if len(parts) <= 32 else ():
            score = score + F.get("embedding", F.lit(i)) * F.lit(x)
        if len(parts) > 32:
            score = V.dot(F.col("embedding"), F.array(*map(F.lit, q)))
        return score + F.col("boost") if boosted else score

    rows = index.select(F.col(key), F.posexplode(F.array(*map(dot, queries))).alias("asked", "score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("asked", key, "score", "rank")


def hash_embedding(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """key, bucket, value: the non-zero parts of the L2-normalized vector; word i adds 1/(i+1) to its bucket."""
    rows = embedded(docs, key, text, buckets).select(F.col(key), F.posexplode("embedding").alias("bucket", "value"))
    return rows.filter("value > 0")


def query_vector(query: str, buckets: int = BUCKETS) -> list[float]:
    """The hash vector of one query, on the driver."""
    out = [0.0] * buckets
    for i, w in enumerate(query.lower().split()):
        out[bucket_of(w, buckets)] += 1 / (i + 1)
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def query_embedding(query: str, buckets: int = BUCKETS) -> dict[int, float]:
    """Its parts that are not zero: bucket -> value."""
    return {b: x for b, x in enumerate(query_vector(query, buckets)) if x}


def search_texts(docs: DataFrame, key: str, text: str, queries: list[str], k: int, boosted: bool = False) -> DataFrame:
    """asked, key, score, rank: search_index over the hash vectors of docs, made on the way."""
    return search_index(embedded(docs, key, text), key, [query_vector(q) for q in queries], k, boosted)


def search_text(docs: DataFrame, key: str, text: str, query: str, k: int, boosted: bool = False) -> DataFrame:
    """key, score, rank by the cosine of hash vectors. A text without words scores 0 (plus its boost)."""
    return search_texts(docs, key, text, [query], k, boosted).drop("asked")
