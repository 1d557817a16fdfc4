"""Stored indexes against searches without one."""

import random

from pyspark.sql import functions as F

from filigrane.operators import blockmax, bm25, fusion, store
from filigrane.streaming import index, ingest

DDL = "source string, section string, content string"
WORDS = "company market debt equity total capex projects revenue ratio key clients the of and cash | net profit".split()


def made(n, seed=1):
    rng = random.Random(seed)
    return [(f"f{i:03}", rng.choice(["general", "de", None]), " ".join(rng.choice(WORDS[: rng.randrange(3, 18)]) for _ in range(rng.choice([0, 3, 20, 200, 900])))) for i in range(n)]


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_blocks_find_what_a_full_search_finds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], weights=[1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 8, 40, 200])))) for i in range(900)]
    rows += [(950, ""), (951, None), (5, "w1 w50")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blockmax.write_blocks(docs, "doc_id", "text", f"{tmp_path}/b", segment_docs=20)
    asked = spark.createDataFrame([(0, "w0 w1"), (1, "w40 w55 w40"), (2, "w3 w0 zzz"), (3, "zzz"), (4, ""), (5, "w59")], "query_id long, query string")
    want = rows_of(bm25.search_many(docs, "doc_id", "text", asked, 4), "query_id", "rank", "doc_id", "score")
    for seeds in (1, 4, 10_000):
        found, share = blockmax.search_blocks(spark, f"{tmp_path}/b", asked, 4, "doc_id", seeds)
        got = rows_of(found, "query_id", "rank", "doc_id", "score")
        # rows that share a doc_id are documents of their own here, one document there
        assert [r for r in got if r[0] != 1 or r[2] != 5][:3] == [r for r in want if r[0] != 1 or r[2] != 5][:3]
        assert {r[0] for r in got} == {0, 1, 2, 5}
        told = {r["query_id"]: (r["read"], r["blocks"]) for r in share.collect()}
        assert all(a <= b for a, b in told.values()) and (seeds > 4 or told[0][0] < 0.6 * told[0][1])
    unique = docs.filter("doc_id <> 5")
    blockmax.write_blocks(unique, "doc_id", "text", f"{tmp_path}/u", segment_docs=20)
    got = rows_of(blockmax.search_blocks(spark, f"{tmp_path}/u", asked, 4, "doc_id")[0], "query_id", "rank", "doc_id", "score")
    assert got == rows_of(bm25.search_many(unique, "doc_id", "text", asked, 4), "query_id", "rank", "doc_id", "score")


def live(own):
    return {kind: rows_of(own.read(kind).select(*sorted(c for c in own.read(kind).columns if c != "embedding")), *sorted(c for c in own.read(kind).columns if c != "embedding")) if kind != "parents" else sorted(map(repr, own.read(kind).collect())) for kind in ("parents", "files")}


def test_batches_add_up_to_the_index_of_all_files(spark, tmp_path):
    rows = made(24)
    changed = [("f003", "general", "another text about debt"), ("f004", "de", " ")]
    own, whole = store.Store(spark, f"{tmp_path}/own"), store.Store(spark, f"{tmp_path}/whole")
    last = {r[0]: r for r in rows + changed}
    whole.add(spark.createDataFrame(list(last.values()), DDL), 0)
    same = lambda: all(rows_of(own.read(k).drop("embedding", "section").fillna(""), *c) == rows_of(whole.read(k).drop("embedding", "section").fillna(""), *c) for k, c in {
        "parents": ["source", "parent_idx", "content"], "chunks": ["source", "parent_idx", "child_idx", "len", "boost"], "postings": ["source", "parent_idx", "child_idx", "term", "tf", "len"], "files": ["source"]}.items())
    for b in range(3):
        own.add(spark.createDataFrame(rows[b * 8 : b * 8 + 8], DDL), b)
    assert not same()
    own.add(spark.createDataFrame(changed, DDL), 3)
    assert same()
    own.add(spark.createDataFrame([("f000", "de", "a replay with other rows")], DDL), 1)  # a whole batch stays as it is
    assert same()
    own.compact()
    own.compact()
    assert own.current() == (1, 3) and same()
    own.clean()
    own.add(spark.createDataFrame(rows[:8], DDL), 0)  # folded already
    assert own.current() == (1, 3) and same()
    own.add(spark.createDataFrame([("new", "general", "new text"), (None, "de", "no source")], DDL), 4)
    assert not same() and own.read("files").count() == 25
    docs = spark.createDataFrame(list(last.values()), DDL)
    for query, section in (("total debt and equity", "de"), ("zz yy", None)):
        want = rows_of(fusion.hybrid(docs, "source", "content", query, 5, section, "section"), "rank", "score", "content")
        assert rows_of(whole.hybrid(query, 5, section), "rank", "score", "content") == want


def test_index_follows_a_landing_folder(spark, tmp_path):
    landing = tmp_path / "landing"
    (landing / "1").mkdir(parents=True)
    for name, text in (("a.txt", "total debt"), ("b.md", "cash flow of the year"), ("report.md", "no filing")):
        (landing / "1" / name).write_text(text)
    own = store.Store(spark, f"{tmp_path}/index")
    run = lambda: index.index_stream(ingest.filing_stream(spark, str(landing), 1), own, f"{tmp_path}/checkpoint", 2).awaitTermination()
    run()
    assert rows_of(own.read("postings"), "source", "term", "tf") == sorted([("a.txt", "total", 1), ("a.txt", "debt", 1)] + [("b.md", t, 1) for t in "cash flow of the year".split()])
    (landing / "2").mkdir()
    (landing / "2" / "a.txt").write_text("net cash")
    (landing / "2" / "c.pdf").write_bytes(b"%PDF-1.4 damaged")
    run()
    run()
    assert {r[0] for r in rows_of(own.read("postings"), "source", "term")} == {"a.txt", "b.md"}
    assert rows_of(own.read("postings").filter("source = 'a.txt'"), "term") == [("cash",), ("net",)]
    assert own.current()[0] >= 1
