"""BM25 over postings in blocks, each with the largest score in it, so that a search skips blocks that can't matter.

Documents are dealt to segments by their length, since short texts score highest: a term's block is its postings in
one segment.  The sum of a query's largest block scores bounds every document of a segment.  A search first scores
the segments of the highest bounds; the k-th best score found is a floor, and only segments whose bound reaches it
are read besides.  The result is that of a search without blocks.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.operators import bm25
from filigrane.operators.store import TERM_BUCKETS, term_bucket
from filigrane.session import bounded, shared_path, write_by

SEGMENT_DOCS = 512
#: Segments that are scored before there is a floor, a query.
SEEDS = 4
#: Terms and segments up to which their numbers go into the scan's filter; beyond, a join alone picks them.
NAMED = 10_000


def write_blocks(docs: DataFrame, key: str, text: str, path: str, segment_docs: int = SEGMENT_DOCS) -> None:
    """path/blocks (by a bucket of the term) and path/stats. Null texts count as empty ones; rows that share a key are one document each.

    One shuffle, of the texts, brings a segment's documents into one task, which makes the segment's blocks and writes
    a file a bucket.
    """
    spark = docs.sparkSession
    bounded(spark)
    stats = bm25.corpus_stats(docs, key, text)
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.schema(stats.schema).parquet(f"{path}/stats")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("said")).withColumn("len", F.size(T.tokens(F.col("said"))))
    placed = rows.repartitionByRange("len", "key").sortWithinPartitions("len", "key").withColumn("row", F.monotonically_increasing_id())
    placed = placed.select("row", "key", "len", F.floor(F.col("row") / segment_docs).alias("segment"), T.tokens(F.col("said")).alias("tokens"))  # rows of a partition count on, so segments are as long
    kind = placed.schema["key"].dataType.simpleString()
    blocks = placed.mapInArrow(segment_blocks, f"term string, segment long, n long, docs array<struct<row:long,key:{kind},tf:long,len:int>>")
    part = lambda d: bm25.term_score(F.lit(1.0), d["tf"].cast("double"), d["len"], F.col("avgdl"))
    blocks = blocks.crossJoin(F.broadcast(stats.select("avgdl"))).select("term", "segment", F.array_max(F.transform("docs", part)).alias("top"), "n", "docs", term_bucket(F.col("term")).alias("bucket"))
    write_by(blocks, "bucket", TERM_BUCKETS, f"{path}/blocks")


def segment_blocks(batches):
    """A row for each term of each segment, from documents (row, key, len, segment, tokens) in order of their segments."""
    import numpy as np
    import pyarrow as pa

    def made(held):
        part = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: part.column(c).chunk(0)
        tokens = one("tokens")
        words = tokens.flatten().dictionary_encode()
        if not len(words):
            return
        doc = np.repeat(np.arange(len(part)), tokens.value_lengths().to_numpy())
        met, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(part) + doc, return_counts=True)
        code, at = np.divmod(met, len(part))
        own = pa.array(at)
        docs = pa.StructArray.from_arrays([one("row").take(own), one("key").take(own), pa.array(tf.astype(np.int64)), one("len").take(own)], ["row", "key", "tf", "len"])
        sizes = np.bincount(code, minlength=len(words.dictionary))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        segment = pa.array(np.full(len(sizes), one("segment")[0].as_py()))
        yield from pa.table([words.dictionary, segment, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(ends, docs)], ["term", "segment", "n", "docs"]).to_batches(max_chunksize=1000)

    held: list = []
    for batch in batches:
        segment = batch.column("segment").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                if held and held[-1].column("segment")[0].as_py() != segment[a]:
                    yield from made(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield from made(held)


def _blocks(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/blocks")
    if len(terms) > NAMED:
        return rows
    return rows.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in terms})) & F.col("term").isin(terms))


def bounds(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """query_id, segment, bound, blocks of every segment that a query's terms are in; query_id, term, weight; and the terms.

    Reads the blocks' heads only.  The terms of all queries go through the driver.
    """
    asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = [r[0] for r in asked.select("term").distinct().collect()]
    heads = _blocks(spark, path, terms).select("term", "segment", "top", "n")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    stats = spark.read.parquet(f"{path}/stats")
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("times") * bm25.idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl")
    weights = _kept(spark, weights, "weights")
    found = heads.join(weights, "term").groupBy("query_id", "segment").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.count("*").alias("blocks"))
    return _kept(spark, found, "bounds"), weights, terms


def _kept(spark: SparkSession, rows: DataFrame, tag: str) -> DataFrame:
    where = shared_path(spark, tag)
    rows.write.parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def search_blocks(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "key", seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """query_id, key, score, rank of the k best matches of each query (query_id, query); and query_id, blocks, read: how many blocks its terms have and how many of them were read.

    Ties go to the smaller key.  A query without a match has no row.
    """
    every, weights, terms = bounds(spark, path, queries)
    order = Window.partitionBy("query_id")
    first = _kept(spark, every.withColumn("place", F.row_number().over(order.orderBy(F.desc("bound"), "segment"))).filter(F.col("place") <= seeds).drop("place"), "seeds")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = _blocks(spark, path, terms)
        named = [r[0] for r in pairs.select("segment").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            rows = rows.filter(F.col("segment").isin(named))
        rows = rows.join(weights, "term").join(pairs.select("query_id", "segment"), ["query_id", "segment"])
        rows = rows.select("query_id", "weight", "avgdl", F.explode("docs").alias("d"))
        part = bm25.term_score(F.col("weight"), F.col("d.tf").cast("double"), F.col("d.len"), F.col("avgdl"))
        return rows.groupBy("query_id", F.col("d.row").alias("row")).agg(F.first("d.key").alias(key), F.sum(part).alias("score"))

    best = order.orderBy(F.desc("score"), key)
    start = _kept(spark, scored(first).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first")
    floor = start.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = every.join(first.select("query_id", "segment"), ["query_id", "segment"], "left_anti").join(floor, "query_id", "left")
    rest = _kept(spark, rest.filter(F.col("bound") * (1 + 1e-9) >= F.coalesce("floor", F.lit(0.0))).drop("floor"), "rest")
    both = start.drop("rank").unionByName(scored(rest)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    read = first.unionByName(rest).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    share = every.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id")
    return both.select("query_id", key, "score", "rank"), share
