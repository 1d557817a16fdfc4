"""Queries over filing passages and JSON in free text; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.api import Engine
from filigrane.functions import spans
from filigrane.operators import fusion, ivf, report, retrieval, store, vector
from filigrane.plans.catalogue import BUCKET, DOUBLES, WORDS, kept, query, r6, stored
from filigrane.sources.report_store import ReportStore
from filigrane.sources.statements import comment_lines
from filigrane.session import shared_path
from filigrane.sources.tables import table
from filigrane.streaming import index

# ---- JSON in free text

#: A brace and a quote inside a string, the key inside a string, and objects 50 deep.
ODD = '{"a": "one } two ' + "\\" + '"[", "said": "' + "\\" + '"_comments' + "\\" + '": {' + "\\" + '"no' + "\\" + '": 1}", "_comments": {"x": "line %s", "n": 5, "y": "} not the end"}}'
DEEP = '{"d":' * 50 + '{"_comments": {"z": "deep %s", "o": {"p": "no"}}}' + "}" * 50


@query("SELECT event_id, ['line ' || user_id, '} not the end', 'deep ' || event_type] AS lines FROM events")
def comment_lines_text(spark, sf):
    text = F.format_string(f'Odd "prose" ] first\n[{ODD}, {DEEP}]\nand "more', F.col("user_id").cast("string"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", comment_lines(text, 8).alias("lines"))


@query(
    "SELECT event_id, 3 AS items, 'a ] b ' || event_type AS first, user_id AS k, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'b } ' || event_id END AS name FROM events"
)
def json_after_header(spark, sf):
    kind, user, event = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    array = F.format_string('["a ] b %s", {"k": %s, "t": "[[ ' + "\\" + '""}, [1, [2]]]', kind, user)
    object_ = F.when(F.col("user_id") % 3 == 0, F.lit('{"name": "never ends"')).otherwise(F.format_string('{"name": "b } %s", "more": {"x": [{}]}}', event))
    text = F.concat(F.lit("Notes [1] {no} \n=== Income ===\nof the year:\n"), array, F.lit("\n=== Profile ===\n"), object_)
    rows = table(spark, sf, "events").select("event_id", spans.array_after(text, "=== Income ===").alias("a"), spans.object_after(text, "=== Profile ===").alias("o"))
    field = lambda i, path, kind: F.try_variant_get(F.get("a", F.lit(i)), path, kind)
    return rows.select("event_id", F.size("a").alias("items"), field(0, "$", "string").alias("first"), field(1, "$.k", "bigint").alias("k"), F.variant_get(F.try_element_at("o", F.lit("name")), "$", "string").alias("name"))


# ---- passages of every section of every company

SECTION_NAMES = (*retrieval.FILING_QUERIES, "general")
#: Words that some documents get, so that searches find more than one kind of text.
EXTRA = ("revenue growth and net profit trend", "total debt and equity ratio | cash", "key clients of the enterprise market", "expansion capex projects and new capacity", "")


def filings(spark, sf):
    """The documents as filings: dealt to the suppliers, a third of them to the first, and to the sections and none."""
    n = F.broadcast(table(spark, sf, "supplier").agg(F.count("*").alias("n")))  # one row
    key = F.col("doc_id")
    symbol = F.concat(F.lit("s"), F.when(key % 3 == 0, 1).otherwise(key % F.col("n") + 1).cast("string"))
    section = F.get(F.array(*map(F.lit, SECTION_NAMES)), (key % len(SECTION_NAMES)).cast("int"))
    extra = F.get(F.array(*map(F.lit, EXTRA)), (key % len(EXTRA)).cast("int"))
    return table(spark, sf, "documents").crossJoin(n).select(symbol.alias("symbol"), key.cast("string").alias("source"), section.alias("section"), F.concat(extra, F.lit("\n"), "text").alias("content"))


FILINGS_SQL = f"""SELECT 's' || CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % n + 1 END AS VARCHAR) AS symbol, CAST(doc_id AS VARCHAR) AS source, {list(SECTION_NAMES)}[doc_id % {len(SECTION_NAMES)} + 1] AS section,
  {list(EXTRA)}[doc_id % {len(EXTRA)} + 1] || chr(10) || text AS content FROM documents, (SELECT count(*) AS n FROM supplier)"""


def passages_sql() -> str:
    asked = [(s, q, i) for i, (s, q) in enumerate(retrieval.FILING_QUERIES.items())]
    asked += [(s, fusion.rewrite_text(q), i + len(asked)) for s, q, i in asked]
    terms = ", ".join(f"({i}, '{w}', {q.lower().split().count(w)})" for _, q, i in asked for w in dict.fromkeys(q.lower().split()))
    sides = ", ".join(f"({i}, {b}, {v!r}::DOUBLE)" for _, q, i in asked for b, v in vector.query_embedding(q).items())
    kinds = ", ".join(f"({i}, '{s}', {str(i >= len(asked) // 2).lower()})" for s, _, i in asked)
    return f"""
WITH docs AS (SELECT * FROM ({FILINGS_SQL}) WHERE NOT regexp_full_match(content, '\\s*')
), parents AS (
  SELECT symbol, source, section, i AS p, substr(content, i * 974 + 1, 1024) AS content FROM (SELECT *, unnest(range(0, CAST(ceil(length(content) / 974.0) AS BIGINT))) AS i FROM docs)
), parts AS MATERIALIZED (
  SELECT row_number() OVER () AS id, *, {WORDS.format('text')} AS w FROM (SELECT symbol, source, section, p, j AS c, substr(content, j * 250 + 1, 300) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(content) / 250.0) AS BIGINT))) AS j FROM parents))
), q AS (SELECT * FROM (VALUES {kinds}) v(q, section, wide)), terms AS (SELECT * FROM (VALUES {terms}) v(q, term, times)), sides AS (SELECT * FROM (VALUES {sides}) v(q, bucket, x)
), stats AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM parts GROUP BY symbol
), tf AS MATERIALIZED (
  SELECT id, symbol, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, symbol, len(w) AS l, unnest(w) AS term FROM parts) WHERE term IN (SELECT term FROM terms) GROUP BY ALL
), df AS (SELECT symbol, term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL
), bm AS (
  SELECT id, q, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / greatest(1, avgdl)))) AS score
  FROM tf JOIN df USING (symbol, term) JOIN stats USING (symbol) JOIN terms USING (term) GROUP BY ALL
), value AS (
  SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM (SELECT id, {BUCKET} AS bucket, sum(1.0::DOUBLE / i) AS v FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM parts) GROUP BY ALL)
), near AS (SELECT id, q, sum(value * x) AS score FROM value JOIN sides USING (bucket) GROUP BY ALL
), every AS MATERIALIZED (
  SELECT p.id, p.symbol, p.source, p.p, p.c, q.q, q.section, q.wide, round(coalesce(n.score, 0) + CASE WHEN contains(p.text, '|') THEN 0.05::DOUBLE ELSE 0 END, 9) AS near, round(coalesce(b.score, 0), 9) AS words
  FROM parts p JOIN q ON q.wide OR p.section IN ('general', q.section) LEFT JOIN near n ON n.id = p.id AND n.q = q.q LEFT JOIN bm b ON b.id = p.id AND b.q = q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, q ORDER BY near DESC, source, p, c) AS r0, row_number() OVER (PARTITION BY symbol, q ORDER BY words DESC, source, p, c) AS r1 FROM every
), sure AS (SELECT DISTINCT symbol, section FROM ranked WHERE NOT wide AND r0 = 1 AND near >= 0.3
), lists AS (
  SELECT symbol, section, wide, source, p, 0 AS list, r0 AS rank FROM ranked WHERE r0 <= 8 UNION ALL SELECT symbol, section, wide, source, p, 1, r1 FROM ranked WHERE r1 <= 8
), fused AS (
  SELECT l.symbol, l.section, l.wide AS rewritten, pa.content, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000000 + rank) AS met
  FROM lists l LEFT JOIN sure s ON s.symbol = l.symbol AND s.section = l.section JOIN parents pa ON pa.symbol = l.symbol AND pa.source = l.source AND pa.p = l.p WHERE l.wide = (s.symbol IS NULL) GROUP BY ALL
)
SELECT symbol, section, CAST(row_number() OVER (PARTITION BY symbol, section ORDER BY round(score, 12) DESC, met) AS INTEGER) AS rank, score, rewritten, content FROM fused QUALIFY rank <= 5"""


@query(f"SELECT symbol, section, rank, round(score, 6) AS score, rewritten, content FROM ({passages_sql()})")
def section_passages(spark, sf):
    return retrieval.section_passages(filings(spark, sf)).select("symbol", "section", "rank", r6("score").alias("score"), "rewritten", "content")


def _bundles(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("symbol", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    return stored(rows, "full_financial_bundle", F.concat(F.lit('{"name": "'), "s_name", F.lit('"}')))


@query(
    f"""WITH p AS ({passages_sql()}), x AS (SELECT symbol, string_agg('{retrieval.PASSAGE_LEAD}' || substr(content, 1, 1200), chr(10) || chr(10) ORDER BY rank) AS t FROM p WHERE section = 'clients_market' GROUP BY symbol)
    SELECT s.symbol, 'clients_market' AS section, '{report.HEADINGS['clients_market']}' || chr(10) || chr(10) || '#### Enterprise Footprint & Market Standing' || chr(10) || 'No live market-footprint headlines available for ' || upper(s.symbol) || '; see the filing passages below.'
      || coalesce(chr(10) || chr(10) || x.t, '') AS markdown FROM (SELECT 's' || s_suppkey AS symbol FROM supplier) s LEFT JOIN x USING (symbol)"""
)
def section_context(spark, sf):
    return Engine(spark, stored=_bundles(spark, sf), filed=filings(spark, sf)).section_context("market_footprint")


@query("SELECT 's' || s_suppkey AS symbol, section, 's' || s_suppkey || ' ' || words AS query FROM supplier, (VALUES " + ", ".join(f"('{s}', '{w}')" for s, w in retrieval.WEB_QUERIES.items()) + ") q(section, words)")
def web_section_queries(spark, sf):
    return retrieval.web_requests(table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol")))


# ---- an index that follows a landing folder

#: About so many bytes a landed file, so that a batch has work for all tasks.
LANDED_BYTES = 16 << 20
REPLACED = "doc_id % 10 = 3"


@query(
    f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (
      SELECT doc_id, p, c, term, count(*) AS tf FROM (SELECT doc_id, p, c, unnest({WORDS.format('content')}) AS term FROM (
        SELECT doc_id, p, j AS c, substr(content, j * 250 + 1, 300) AS content FROM (SELECT *, unnest(range(0, CAST(ceil(length(content) / 250.0) AS BIGINT))) AS j FROM (
          SELECT doc_id, i AS p, substr(text, i * 974 + 1, 1024) AS content FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 974.0) AS BIGINT))) AS i FROM (
            SELECT doc_id, CASE WHEN {REPLACED} THEN 'new text ' || doc_id ELSE text END AS text FROM documents) WHERE trim(text) <> ''))))
      ) GROUP BY ALL) GROUP BY term"""
)
def stream_index_terms(spark, sf):
    """Documents arrive in several batches; a tenth of them come again with a new text."""
    base = shared_path(spark, "landing")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("lang").alias("section"), F.col("text").alias("content"), "doc_id")
    files = max(3, -(-int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // LANDED_BYTES))
    docs.drop("doc_id").repartition(files).write.parquet(f"{base}/files")
    again = docs.filter(REPLACED).withColumn("content", F.concat(F.lit("new text "), "source")).drop("doc_id")
    own = store.Store(spark, f"{base}/index")
    stream = spark.readStream.schema(again.schema).option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(f"{base}/files")
    index.index_stream(stream, own, f"{base}/checkpoint").awaitTermination()
    again.repartition(max(1, files // 10)).write.mode("append").parquet(f"{base}/files")
    index.index_stream(stream, own, f"{base}/checkpoint").awaitTermination()
    own.compact()
    return own.read("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# ---- reports that are made anew when their input changes


@query(
    "SELECT 's' || s_suppkey AS symbol, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS generation, '### Section Financial Analysis' || chr(10) || chr(10) || '{\"name\": \"' || s_name || CASE WHEN s_suppkey % 7 = 0 THEN '!' ELSE '' END || '\"}' AS report FROM supplier"
)
def reports_refresh(spark, sf):
    """Reports of all suppliers; then the payload of each seventh changes, rows come in another order, and all are asked for again."""
    own = ReportStore(spark, shared_path(spark, "reports"))
    first = _bundles(spark, sf)
    changed = F.when(F.expr("cast(substr(symbol, 2) as long) % 7 = 0"), F.replace("payload", F.lit('"}'), F.lit('!"}'))).otherwise(F.col("payload"))
    for rows in (first, first.withColumn("payload", changed).repartition(3), first.withColumn("payload", changed)):
        engine = Engine(spark, stored=rows)
        own.refresh(engine.fingerprints(), lambda symbols, engine=engine: engine.only(symbols).section("something_else").withColumnRenamed("markdown", "report"))
    return own.latest().select("symbol", "generation", "report")


# ---- inverted lists of vectors


@query(
    f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity({DOUBLES.format("e.embedding")}, {DOUBLES.format("q.embedding")}), 12) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 10"""
)
def vector_lists_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    path = kept(spark, sf, "lists", lambda where: ivf.write_lists(vectors, "vec_id", "embedding", where))
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.search_lists(spark, path, queries, 10, exact=True, key="vec_id")
    return found.select("query_id", "rank", "vec_id", r6("score").alias("score"))
