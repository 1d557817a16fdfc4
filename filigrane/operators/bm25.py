"""BM25: corpus statistics, a persisted index, and search.

A search for given terms needs no postings: one pass counts documents, tokens and the terms' document
frequencies into a single row, a second scores every document by expressions and keeps the top.  The index
form serves many searches over one corpus.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.session import repeats

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_score(weight: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(F.lit(1.0), avgdl)))


def tokenized(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return docs.select(F.col(key), *more, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("len", F.size("tokens"))


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """key, term, tf, len, of all terms or of those in terms (term).

    A document's terms are counted in its row; only if keys repeat, which a job over the keys tells, are equal terms of a key
    brought together by a shuffle.
    """
    rows = tokenized(docs, key, text).select(key, "len", F.explode(T.counts(F.col("tokens"))).alias("t")).select(key, "t.term", "t.tf", "len")
    rows = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi").select(key, "term", "tf", "len")
    return rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("len").alias("len")) if repeats(docs, key) else rows


def corpus_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: n and avgdl over all documents, empty ones included."""
    return tokenized(docs, key, text).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def term_stats(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """term, df, idf of every term, or of those in terms (term)."""
    every = tokenized(docs, key, text).select(F.explode(F.array_distinct("tokens")).alias("term"))
    every = every if terms is None else every.join(terms.select("term").distinct(), "term", "left_semi")
    df = every.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def section_kept(section: Column, wanted: str | None) -> Column:
    """No filter, or the general section, or the wanted one."""
    return F.lit(True) if wanted is None else F.coalesce(section, F.lit("")).isin("general", wanted)


def search(docs: DataFrame, key: str, text: str, query: str, k: int, section: str | None = None, section_column: str | None = None, drop_zero: bool = False) -> DataFrame:
    """key, score, rank of the k best documents; a query term counts as often as it occurs.

    Documents that match nothing score 0 and are kept unless drop_zero; ties go to the smaller key.
    Statistics are those of all documents, the section filter chooses among them before scoring.
    """
    terms = Counter(query.lower().split())
    rows = tokenized(docs, key, text, *([section_column] if section_column else []))
    names = {t: f"df{i}" for i, t in enumerate(terms)}
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.sum(F.array_contains("tokens", t).cast("long")).alias(c) for t, c in names.items()))
    chosen = rows.filter(section_kept(F.col(section_column) if section_column else F.lit("general"), section)) if section is not None else rows
    score = F.lit(0.0)
    for term, times in terms.items():
        tf = (F.col("len") - F.size(F.array_remove("tokens", term))).cast("double")
        score = score + F.when(tf > 0, term_score(F.lit(float(times)) * idf(F.col("n"), F.col(names[term])), tf, F.col("len"), F.col("avgdl"))).otherwise(0.0)
    scored = chosen.crossJoin(F.broadcast(stats)).select(F.col(key), score.alias("score"))  # stats is one row
    if drop_zero:
        scored = scored.filter("score > 0")
    return ranked(scored, key, k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # over k rows


def asked_terms(queries: DataFrame) -> DataFrame:
    """term: those of queries (query_id, query)."""
    return queries.select(F.explode(T.tokens(F.col("query"))).alias("term")).distinct()


def search_many(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """search_index without an index: only the asked terms' postings and statistics are made, before any shuffle."""
    terms = asked_terms(queries)
    return search_index(postings(docs, key, text, terms), term_stats(docs, key, text, terms), corpus_stats(docs, key, text), queries, key, k)


def search_index(index: DataFrame, terms: DataFrame, stats: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """query_id, key, score, rank for many queries (query_id, query) over a persisted index.

    index: postings, clustered by term; terms: term_stats; stats: corpus_stats. Only matches are scored.
    """
    asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    hits = index.join(asked.join(terms, "term"), "term").crossJoin(F.broadcast(stats))
    scored = hits.groupBy("query_id", key).agg(F.sum(term_score(F.col("times") * F.col("idf"), F.col("tf").cast("double"), F.col("len"), F.col("avgdl"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def write_index(docs: DataFrame, key: str, text: str, name: str, buckets: int = 64) -> None:
    """Save postings bucketed by term, and the statistics, as tables name_postings, name_terms, name_stats."""
    postings(docs, key, text).write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_postings")
    term_stats(docs, key, text).write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_terms")
    corpus_stats(docs, key, text).write.mode("overwrite").saveAsTable(f"{name}_stats")
