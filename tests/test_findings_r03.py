"""Cases of the findings of round 3."""

import duckdb
import pytest

from filigrane.plans import catalogue


@pytest.mark.parametrize("name", ["html_unescape", "html_snippets"])
def test_bare_ampersands_are_text_as_in_the_sql(spark, tmp_path, name):
    html = ["<title>von&&& é and&amp</title>", "&amp;lt; &lt &copy &middot;&amp;amp; &#39; &#39 a&b & c", '<a href="x">one &amp</a> <a href="y">&copy; &nbsp a</a>', "&", ""]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())


def test_counts_of_shingles_take_work_and_bytes_that_follow_the_shingles():
    import time

    import numpy as np

    from filigrane.llm.jaccard_join import _deltas, _numbers, heavy_buckets

    rng = np.random.default_rng(5)
    size = 1 << 23
    lists = [np.sort(np.concatenate([rng.integers(0, size, 1000), np.full(3, 77), [0, size - 1]])) for _ in range(300)]
    counted = [_deltas(x) for x in lists]
    assert all((_numbers(d) == x).all() for d, x in zip(counted, lists, strict=True)) and not _numbers(_deltas(lists[0][:0])).size
    assert sum(map(len, counted)) < 3 * sum(map(len, lists))  # a byte for each 255 that a difference skips made 33 of each
    began = time.process_time()
    at, n = heavy_buckets(counted, size, 32)
    assert time.process_time() - began < 2  # a table of the whole range for each list took 5 s
    want = np.bincount(np.concatenate(lists), minlength=size)
    assert (at == np.flatnonzero(want > 32)).all() and (n == want[at]).all() and 77 in at


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_rows(spark):
    from filigrane.operators import bm25, store

    rows = [(1, "b a  b A zz"), (2, ""), (3, None), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bm25.postings(docs, "doc_id", "text")
    assert "Exchange" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2, 5), (1, "b", 2, 5), (1, "zz", 1, 5), (4, "x", 1, 1)]
    twice = spark.createDataFrame([*rows, (1, "b q")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in bm25.postings(twice, "doc_id", "text").collect()) == [(1, "a", 2), (1, "b", 3), (1, "q", 1), (1, "zz", 1), (4, "x", 1)]
    made = store.entries(docs.selectExpr("cast(doc_id as string) source", "'de' section", "text content"))["postings"]
    assert "Exchange" not in _plan(made)
    assert sorted((r.source, r.term, r.tf, r.len) for r in made.collect()) == [("1", "a", 2, 5), ("1", "b", 2, 5), ("1", "zz", 1, 5), ("4", "x", 1, 1)]
    again = store.entries(twice.selectExpr("cast(doc_id as string) source", "'de' section", "text content"))["postings"]
    assert sorted((r.source, r.term, r.tf) for r in again.filter("source = '1'").collect()) == [("1", "a", 2), ("1", "b", 3), ("1", "q", 1), ("1", "zz", 1)]


def test_a_large_company_is_not_one_task(spark, monkeypatch):
    from filigrane.operators import retrieval

    rows = spark.range(400).selectExpr("if(id < 300, 's1', concat('s', id)) symbol", "id")
    side = rows.groupBy("symbol").count().withColumnRenamed("count", "n")
    for most in (1_000, 5):
        monkeypatch.setattr(retrieval, "SMALL_SIDE", most)
        monkeypatch.setattr(retrieval, "LARGE_COMPANY", 200)
        got = retrieval.joined(rows, side)
        assert sorted((r.id, r.n) for r in got.collect()) == [(i, 300 if i < 300 else 1) for i in range(400)]
        assert "BroadcastHashJoin" in _plan(got)


def test_words_kept_by_a_task_are_bounded(monkeypatch):
    import pyarrow as pa

    from filigrane.operators import vector

    monkeypatch.setattr(vector, "KNOWN_WORDS", 50)
    known = {}
    for k in range(20):
        vector.hash_vectors(pa.array([[f"w{k}_{i}" for i in range(30)]]), 128, known)
        assert len(known) <= 50 + 30


def test_blocks_are_made_without_a_shuffle_of_postings(spark, tmp_path):
    from filigrane.operators import blockmax

    docs = spark.range(300).selectExpr("id doc_id", "concat('a b ', repeat('c ', cast(id % 7 as int)), id) text")
    spark.sparkContext.setJobGroup("blocks", "")
    blockmax.write_blocks(docs, "doc_id", "text", f"{tmp_path}/b", 20)
    found = spark.read.parquet(f"{tmp_path}/b/blocks")
    assert {r["term"]: r["n"] for r in found.groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").filter("term in ('a', 'b', 'c')").collect()} == {"a": 300, "b": 300, "c": 257}
    assert found.filter("term = 'a'").selectExpr("max(size(docs)) m").first().m == 20
    plan = spark.range(1).sparkSession._jsparkSession.sharedState().statusStore().executionsList()
    plans = [plan.apply(i).physicalPlanDescription() for i in range(plan.size())]
    last = next(p for p in reversed(plans) if f"{tmp_path}/b/blocks" in p and "Insert" in p)
    assert last.count("rangepartitioning") >= 1 and "hashpartitioning" not in last
