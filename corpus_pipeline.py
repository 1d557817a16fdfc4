"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept.
run() writes each stage's rows to the folder that all executors share and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm import jaccard_join, language_id, packing, quality
from filigrane.llm.shared import annotated, prepare, staged, table

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.5
#: A document goes if its language is unknown or its score is below this.
LEAST_LANGUAGE = 0.3

#: SQL can't express the classifiers. tests/llm holds quality against a walk node by node and rows that were not learned, languages
#: against plain parses, near duplicates against all pairs, and packing against the tokenizers library.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on labelled documents of its input.

    A null text is scored as the empty one; rows that repeat are scored alike; a null doc_id is only never learned from.
    """
    prepare(spark)
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees, "__quality").filter(F.col("__quality") >= LEAST_QUALITY).drop("__quality")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the languages are learned from its input.

    A text that is null or has no letter goes, as do all if no row has a lang; rows that repeat are told alike.
    """
    prepare(spark)
    told = language_id.identified(docs, language_id.fit(docs), ("__lang", "__score"))
    return told.filter((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE)).drop("__lang", "__score")


def _longs(values):
    import pyarrow as pa

    return pa.array(values, pa.int64())


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarity links join, the one with the smallest doc_id.

    Rows that repeat that doc_id are documents of their own: those of one group stay once, the first by text,
    those of other groups stay too.  Null and empty texts, and rows with a null doc_id, have no group and stay.
    """
    prepare(spark)
    groups = staged(spark, jaccard_join.similar_components(docs.select("doc_id", "text"), labelled_sets=True).filter("doc_id is not null"), "groups")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("first"))
    gone = staged(spark, ids.filter("n = 1 and first < doc_id").select("doc_id"), "gone")
    if gone.count() <= jaccard_join.BROADCAST_ROWS:  # else both sides are shuffled
        gone = F.broadcast(gone)
    kept = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti")
    twice = staged(spark, ids.filter("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        heads = groups.join(twice, "doc_id", "left_semi").filter("component_id = doc_id").select("doc_id", F.col("set_id").alias("__set"), F.col("label").alias("__label")).distinct()
        own = annotated(kept.join(twice, "doc_id", "left_semi"), lambda: lambda texts: [_longs(jaccard_join.set_ids(texts))], "__set long").join(heads, ["doc_id", "__set"])
        one = own.filter("__label is not null").groupBy("doc_id", "__label").agg(F.min_by(F.struct(*docs.columns), "text").alias("__r")).select("__r.*")
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(one).unionByName(own.filter("__label is null").select(docs.columns))
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, and their places in sequences; a null or empty text is a piece of one token."""
    prepare(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near duplicates", keep_one_of_similar), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = staged(spark, out, f"stage{k}")
    return out
