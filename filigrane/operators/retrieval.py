"""Filing passages for every section of every company at once.

Each company's chunks are a corpus of their own: document frequencies and mean length count within the company.  All
sections are searched in one plan.  A chunk is read once and leaves a small row without its text: its length, how
often it holds each asked term, and its cosine with each query.  Statistics are joined to these rows by company, and
the best of each (company, section) are cut by ranked windows, which Spark limits before the shuffle too.  Only
sections without a confident hit are searched again, by their rewritten query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.functions import vectors as V
from filigrane.operators import chunking, vector
from filigrane.operators.bm25 import idf, term_score
from filigrane.operators.fusion import LOW_CONFIDENCE, RRF_K, SIDE_K, rewrite_text
from filigrane.session import shared_path

PASSAGES = 5
#: Companies up to which their statistics (some 500 bytes each) are broadcast; chunks from which a company's are all the same.
SMALL_SIDE = 20_000
LARGE_COMPANY = 50_000

# fixed values: what is searched for each section in the filings, and (with the symbol before it) on the web
FILING_QUERIES = {
    "company_overview": "company background profile market cap industry overview",
    "company_operations": "business verticals products core operations revenue drivers",
    "expansion_plans": "expansion capex projects new capacity buildout targets",
    "clients_market": "key clients concessions government enterprise contracts market footprint",
    "financial_results": "quarterly revenue net profit PAT QoQ YoY growth EBITDA sales trend",
    "dupont_analysis": "dupont analysis ROE ROCE net profit margin asset turnover financial leverage",
    "balance_sheet": "total debt equity net worth cash balance solvency debt to equity ratio",
    "strengths_weaknesses": "financial strengths bull case bear case risks debt asset quality",
}
WEB_QUERIES = {
    "company_overview": "market capitalization in crores USD market cap profile",
    "company_operations": "business segments operating divisions revenue drivers",
    "expansion_plans": "expansion capex projects artificial intelligence cloud investment",
    "clients_market": "major clients enterprise customers competitive moat market footprint",
}
PASSAGE_LEAD = "> **Targeted Filing Context Chunk**: "


def web_query(symbol: Column, section: str) -> Column:
    """What is searched on the web for a section; null for those that take nothing from there."""
    words = WEB_QUERIES.get(section)
    return F.concat(symbol, F.lit(f" {words}")) if words else F.lit(None).cast("string")


def web_requests(symbols: DataFrame) -> DataFrame:
    """symbol, section, query: what is searched on the web for every symbol; sections that take nothing from there have no row."""
    words = F.create_map(*(F.lit(x) for pair in WEB_QUERIES.items() for x in pair))
    rows = symbols.select("symbol", F.explode(words).alias("section", "words"))
    return rows.select("symbol", "section", F.concat_ws(" ", "symbol", "words").alias("query"))


def searched(chunks: DataFrame, queries: list[str]) -> tuple[DataFrame, list[str]]:
    """chunks without their text: len, terms (term's place, times) of asked terms, near: the boosted cosine with each query; and the asked terms.

    chunks: symbol, section, source, parent_idx, child_idx, content.  Hash vectors; no shuffle.
    """
    asked = sorted({w for q in queries for w in q.lower().split()})
    place = {t: i for i, t in enumerate(asked)}
    sides = [vector.query_vector(q) for q in queries]
    keys = ["symbol", "section", "source", "parent_idx", "child_idx"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[str, int] = {}
        each = np.array(sides).T
        for batch in batches:
            tokens, n = batch.column("tokens"), len(batch)
            near = vector.hash_vectors(tokens, vector.BUCKETS, known) @ each + batch.column("boost").to_numpy()[:, None]
            words = tokens.flatten().dictionary_encode()
            own = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
            term = own[words.indices.to_numpy()] if own.size else np.zeros(0, np.int64)
            row = np.repeat(np.arange(n), tokens.value_lengths().to_numpy())
            met, times = np.unique((row * len(place) + term)[term >= 0], return_counts=True)
            ends = np.searchsorted(met, np.arange(n + 1) * len(place))
            pairs = pa.StructArray.from_arrays([pa.array((met % max(1, len(place))).astype(np.int32)), pa.array(times.astype(np.int32))], ["term", "times"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), batch.column("len"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs), pa.ListArray.from_arrays(pa.array(range(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))],
                names=[*keys, "len", "terms", "near"],
            )

    tokens = T.tokens(F.coalesce(F.col("content"), F.lit("")))
    rows = chunks.select(*keys, tokens.alias("tokens"), F.size(tokens).alias("len"), V.table_boost(F.col("content")).alias("boost"))
    shape = "symbol string, section string, source string, parent_idx int, child_idx int, len int, terms array<struct<term:int,times:int>>, near array<double>"
    return rows.mapInArrow(run, shape), asked


def statistics(rows: DataFrame, asked: list[str]) -> DataFrame:
    """symbol, n, avgdl, df (in how many of its chunks each asked term is): one row a company."""
    whole = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    each = rows.select("symbol", F.explode("terms").alias("t")).groupBy("symbol", F.col("t.term").alias("term")).agg(F.count("*").alias("df"))
    known = each.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("known"))  # at most the asked terms
    df = F.transform(F.sequence(F.lit(0), F.lit(len(asked) - 1)), lambda t: F.coalesce(F.try_element_at("known", t), F.lit(0)).cast("long"))
    return whole.join(known, "symbol", "left").select("symbol", "n", "avgdl", F.when(F.col("known").isNotNull(), df).alias("df"))


def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows with the one row that side has of their symbol (n: its chunks), however many rows a symbol has.

    A small side is broadcast; of a larger one the symbols with many chunks, of which there can be few, so that no task
    gets a whole large company.
    """
    side = _stored(rows.sparkSession, side, "side")
    if side.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE:
        return rows.join(F.broadcast(side), "symbol")
    large = F.broadcast(side.filter(F.col("n") > LARGE_COMPANY))
    return rows.join(large, "symbol").unionByName(rows.join(large.select("symbol"), "symbol", "left_anti").join(side, "symbol"))


def hits(rows: DataFrame, stats: DataFrame, asked: list[str], queries: list[tuple[str, str, int]], wanted: DataFrame | None = None, k: int = SIDE_K) -> DataFrame:
    """symbol, section, list (0 vectors, 1 words), source, parent_idx, score, rank: the k best chunks of each list.

    queries: (section, query, its place in near).  A section takes the general chunks and its own; with wanted
    (symbol, sections) only those sections of those companies are searched, among all chunks.  Scores count to nine
    places; ties go to the smaller place in the filings.
    """
    rows = joined(rows.withColumnRenamed("section", "own"), stats if wanted is None else stats.join(wanted, "symbol"))
    part = lambda t: term_score(idf(F.col("n"), F.get("df", t["term"])), t["times"].cast("double"), F.col("len"), F.col("avgdl"))
    parts = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), part(t).alias("score")))
    place = {t: i for i, t in enumerate(asked)}

    def words(parts_: Column, query: str) -> Column:
        times: dict[int, int] = {}
        for w in query.lower().split():
            times[place[w]] = times.get(place[w], 0) + 1
        weight = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))
        return F.round(F.aggregate(parts_, F.lit(0.0), lambda s, p: s + p["score"] * F.coalesce(F.try_element_at(weight, p["term"]), F.lit(0))), 9)

    def choices(parts_: Column) -> Column:
        every = []
        for section, query, at in queries:
            kept = F.coalesce(F.col("own"), F.lit("")).isin("general", section) if wanted is None else F.array_contains("sections", section)
            one = F.struct(F.lit(section).alias("section"), F.round(F.get("near", F.lit(at)), 9).alias("near"), words(parts_, query).alias("words"))
            every.append(F.when(kept, one))
        return F.filter(F.array(*every), lambda c: c.isNotNull())

    chosen = rows.select("symbol", "source", "parent_idx", "child_idx", F.explode(F.element_at(F.transform(F.array(parts), choices), 1)).alias("c"))
    every = None
    for i, by in enumerate(("near", "words")):
        order = Window.partitionBy("symbol", "section").orderBy(F.desc("score"), "source", "parent_idx", "child_idx")
        one = chosen.select("symbol", "c.section", F.lit(i).alias("list"), "source", "parent_idx", "child_idx", F.col(f"c.{by}").alias("score"))
        one = one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("child_idx")
        every = one if every is None else every.unionByName(one)
    return every


def section_passages(filings: DataFrame, queries: dict[str, str] | None = None, k: int = PASSAGES) -> DataFrame:
    """symbol, section, rank, score, rewritten, content: the k best parent chunks of every section of every company.

    filings: symbol, source, section, content; a null or blank content has no chunk, a null section counts as none,
    rows without a symbol take no part.  Parents of equal text are one.  queries: the text searched for each section.  A
    company without a chunk has no passage.  Stages the searched rows, which hold no text, and the hits.
    """
    spark = filings.sparkSession
    queries = FILING_QUERIES if queries is None else queries
    texts = [(s, q, i) for i, (s, q) in enumerate(queries.items())]
    again = [(s, rewrite_text(q), len(texts) + i) for s, q, i in texts]
    docs = filings.filter("symbol is not null").select(F.col("symbol").cast("string").alias("symbol"), "source", "section", "content")
    parents = chunking.parents(docs, F.col("source"), F.col("content"), F.col("section"), keep=("symbol",))
    rows, asked = searched(chunking.children(parents, keep=("symbol",)), [q for _, q, _ in texts + again])
    rows = _stored(spark, rows, "searched")
    stats = _stored(spark, statistics(rows, asked), "statistics")
    first = _stored(spark, hits(rows, stats, asked, texts), "hits")
    sections = spark.createDataFrame([(s,) for s in queries], "section string")  # as many as there are sections
    sure = first.filter((F.col("list") == 0) & (F.col("rank") == 1) & (F.col("score") >= LOW_CONFIDENCE)).select("symbol", "section")
    unsure = _stored(spark, rows.select("symbol").distinct().crossJoin(F.broadcast(sections)).join(sure, ["symbol", "section"], "left_anti"), "unsure")
    wanted = unsure.groupBy("symbol").agg(F.collect_set("section").alias("sections"))
    second = hits(rows, stats, asked, again, wanted)
    found = first.join(unsure, ["symbol", "section"], "left_anti").withColumn("rewritten", F.lit(False)).unionByName(second.withColumn("rewritten", F.lit(True)))
    found = _stored(spark, found, "found")

    met = found.join(parents.select("symbol", "source", "parent_idx", "content"), ["symbol", "source", "parent_idx"])
    fused = met.groupBy("symbol", "section", "rewritten", "content").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("met"))
    order = Window.partitionBy("symbol", "section").orderBy(F.desc(F.round("score", 12)), "met")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("symbol", "section", "rank", "score", "rewritten", "content")


def _stored(spark, rows: DataFrame, tag: str) -> DataFrame:
    path = shared_path(spark, tag)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def with_passages(sections: DataFrame, passages: DataFrame) -> DataFrame:
    """sections (symbol, section, markdown) with a company's passages, cut to what is shown, after each section."""
    shown = F.concat(F.lit(PASSAGE_LEAD), F.substring("content", 1, chunking.SHOWN_CHARS))
    rows = passages.withColumn("shown", shown).groupBy("symbol", "section").agg(F.sort_array(F.collect_list(F.struct("rank", "shown"))).alias("p"))  # a few a section
    text = F.array_join(F.transform("p", lambda x: x["shown"]), "\n\n")
    both = sections.join(rows, ["symbol", "section"], "left")
    return both.withColumn("markdown", F.when(F.col("p").isNull(), F.col("markdown")).otherwise(F.concat("markdown", F.lit("\n\n"), text))).drop("p")
