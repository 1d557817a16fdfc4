"""Filing passages by company and section, against a plain search of each company."""

import math

from pyspark.sql import functions as F

from filigrane.api import Engine
from filigrane.operators import fusion, retrieval, vector

DDL = "symbol string, source string, section string, content string"


def plain(rows, section, query, k=5):
    """The passages of one company by loops over its chunks."""
    chunks, parents = [], {}
    for source, own, text in rows:
        if text is None or not text.strip():
            continue
        for p in range(math.ceil(len(text) / 974)):
            parents[source, p] = text[p * 974 : p * 974 + 1024]
            for c in range(math.ceil(len(parents[source, p]) / 250)):
                chunks.append((source, p, c, own, parents[source, p][c * 250 : c * 250 + 300]))
    words = [x[4].lower().split() for x in chunks]
    if not chunks:
        return []
    avg = sum(map(len, words)) / len(words)

    def lists(query, kept):
        side = vector.query_vector(query)
        near, bm = [], []
        for x, w in zip(chunks, words, strict=True):
            if not kept(x[3]):
                continue
            own = vector.query_vector(x[4])
            near.append((-round(sum(a * b for a, b in zip(side, own, strict=True)) + 0.05 * ("|" in x[4]), 9), x[:3]))
            score = 0.0
            for t in query.lower().split():
                df = sum(t in v for v in words)
                tf = w.count(t)
                score += math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / max(1, avg))) if tf else 0
            bm.append((-round(score, 9), x[:3]))
        return sorted(near)[:8], sorted(bm)[:8]

    near, bm = lists(query, lambda s: s in ("general", section))
    wide = not near or -near[0][0] < fusion.LOW_CONFIDENCE
    if wide:
        near, bm = lists(fusion.rewrite_text(query), lambda s: True)
    scores, met = {}, {}
    for i, side in enumerate((near, bm)):
        for rank, (_, (source, p, _)) in enumerate(side, 1):
            text = parents[source, p]
            scores[text] = scores.get(text, 0) + 1 / (60 + rank)
            met[text] = min(met.get(text, (9, 9)), (i, rank))
    return [(r, round(scores[t], 9), wide, t) for r, t in enumerate(sorted(scores, key=lambda t: (-round(scores[t], 12), met[t]))[:k], 1)]


def test_passages_equal_a_search_of_each_company(spark):
    words = "company market debt equity total capex projects revenue ratio key clients the of and cash | net profit".split()
    texts = [" ".join(words[(i * 7 + j * j) % (5 + i % 13)] for j in range(20 + 60 * (i % 6))) for i in range(40)]
    rows = [("a" if i % 2 else f"s{i % 5}", f"f{i}", ("general", "balance_sheet", "clients_market", None)[i % 4], t) for i, t in enumerate(texts)]
    rows += [("blank", "f", "general", " \n"), ("null", "f", "general", None), (None, "f", "general", "debt"), ("one", "f", "expansion_plans", "Total debt"), ("a", "g", "general", rows[1][3])]
    asked = {s: retrieval.FILING_QUERIES[s] for s in ("balance_sheet", "clients_market", "expansion_plans")}
    got = retrieval.section_passages(spark.createDataFrame(rows, DDL).repartition(3), asked).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r["symbol"], r["section"]), []).append((r["rank"], round(r["score"], 9), r["rewritten"], r["content"]))
    want = {(s, q): plain([r[1:] for r in rows if r[0] == s], q, text) for s in {r[0] for r in rows} - {None} for q, text in asked.items()}
    assert found == {k: v for k, v in want.items() if v}
    assert {v[0][2] for v in found.values()} == {True, False}


def test_no_filings(spark):
    assert retrieval.section_passages(spark.createDataFrame([], DDL)).collect() == []


def test_reports_hold_passages(spark):
    stored = spark.createDataFrame([("ABC", "solvency", "{}", "ok"), ("XY", "solvency", "{}", "ok")], "symbol string, endpoint string, payload string, status string")
    filed = spark.createDataFrame([("ABC", "10k.txt", "general", "Total debt fell and cash rose. " * 60)], DDL)
    engine = Engine(spark, stored=stored, filed=filed)
    one = {r["symbol"]: r["markdown"] for r in engine.section_context("solvency_analysis", "own words").filter("section = 'balance_sheet'").collect()}
    assert one["ABC"].count(retrieval.PASSAGE_LEAD) == 2 and retrieval.PASSAGE_LEAD not in one["XY"]
    reports = {r["symbol"]: r["report"] for r in engine.report().collect()}
    assert reports["ABC"].count(retrieval.PASSAGE_LEAD) == 16 and retrieval.PASSAGE_LEAD not in reports["XY"]
    assert spark.range(1).select(retrieval.web_query(F.lit("ABC"), "clients_market")).first()[0].startswith("ABC major clients")
