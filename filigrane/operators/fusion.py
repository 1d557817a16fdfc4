"""Reciprocal-rank fusion, the confidence gate and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.operators import bm25, chunking, vector

RRF_K = 60
LOW_CONFIDENCE = 0.3
SIDE_K = 8

# fixed values: what a query gains when it names a section, else the general words
EXPANSIONS = {
    "expansion_plans": "expansion capex new projects infrastructure capacity addition buildout targets",
    "company_operations": "business segments core operations verticals revenue drivers",
    "clients_market": "key customers client concentration market share competitive positioning moat",
    "financial_results": "quarterly revenue sales net profit PAT EBITDA margins YoY QoQ trajectory",
}
GENERAL_EXPANSION = "financial growth revenue operations capex data"


def rewrite(query: Column) -> Column:
    """The query and the words of the first section it names, else the general ones."""
    more = F.lit(GENERAL_EXPANSION)
    for key, words in reversed(EXPANSIONS.items()):
        more = F.when(F.lower(query).contains(key), words).otherwise(more)
    return F.concat(query, F.lit(" "), more)


def rewrite_text(query: str) -> str:
    return f"{query} {next((w for k, w in EXPANSIONS.items() if k in query.lower()), GENERAL_EXPANSION)}"


def gated(original: DataFrame, rewritten: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """The hits of the original query if its best score reaches the threshold, else those of the rewritten one.

    Both are searched and one is kept by a one-row flag: no round trip to the driver.
    """
    flag = original.agg((F.coalesce(F.max("score"), F.lit(0.0)) < threshold).alias("__low"))
    both = original.withColumn("rewritten", F.lit(False)).unionByName(rewritten.withColumn("rewritten", F.lit(True)))
    return both.crossJoin(F.broadcast(flag)).filter(F.col("rewritten") == F.col("__low")).drop("__low")


def fuse(lists: list[DataFrame], key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """key, score, rank: the sum of 1 / (rrf_k + rank) over ranked lists (key, rank).

    A key that a list has several times counts each time; ties go to the key met first, list by list.
    """
    marked = [d.select(F.col(key), (1.0 / (rrf_k + F.col("rank"))).alias("part"), (F.lit(i * 1_000_000) + F.col("rank")).alias("met")) for i, d in enumerate(lists)]
    every = marked[0]
    for d in marked[1:]:
        every = every.unionByName(d)
    fused = every.groupBy(key).agg(F.sum("part").alias("score"), F.min("met").alias("met"))
    top = fused.orderBy(F.desc("score"), "met").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "met"))).drop("met")


def hybrid(docs: DataFrame, source: str, text: str, query: str, k: int = 5, section: str | None = None, section_column: str | None = None) -> DataFrame:
    """rank, score, content of the k best parent chunks by BM25 and hash vectors of their children.

    Parents with equal text are one, whichever file they come from.  If the best vector score is low the
    query is rewritten once and searched without the section filter.  It runs a job for the vector hits, SIDE_K
    rows, and only then the searches that are still needed.
    """
    where = F.col(section_column) if section_column else None
    parts = chunking.children(chunking.parents(docs, F.col(source), F.col(text), where)).withColumn("ord", F.struct("source", "parent_idx", "child_idx"))

    def near(asked: str, kept: DataFrame) -> list:
        return vector.search_text(kept.withColumn("content", F.substring("content", 1, chunking.EMBEDDED_CHARS)), "ord", "content", asked, SIDE_K, boosted=True).collect()

    hits = near(query, parts.filter(bm25.section_kept(F.col("section"), section)))
    if max((h["score"] for h in hits), default=0.0) < LOW_CONFIDENCE:
        query, section = rewrite_text(query), None
        hits = near(query, parts)
    words = bm25.search(parts, "ord", "content", query, SIDE_K, section, "section").collect()
    found = [[(h["rank"], h["ord"]["source"], h["ord"]["parent_idx"]) for h in side] for side in (hits, words)]
    named = sorted({s for side in found for _, s, _ in side})
    parents = chunking.parents(docs.filter(F.col(source).cast("string").isin(named)), F.col(source), F.col(text), where)  # of 2 * SIDE_K files at most
    lists = [docs.sparkSession.createDataFrame(side, "rank int, source string, parent_idx int").join(parents, ["source", "parent_idx"]).select("content", "rank") for side in found]
    return fuse(lists, "content", k).select("rank", "score", "content")
