"""Readers, the façade and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from filigrane.api import Engine
from filigrane.operators import report
from filigrane.operators.prompts import prompt
from filigrane.sources import dictionary, filings, sinks, statements
from filigrane.sources.endpoints import ENDPOINTS, EndpointSource
from filigrane.streaming import ingest


def payload_rows():
    quarters = [{"displayPeriod": f"Q{i}", "qIncTrev": 100.0 + i, "qIncEbit": 10, "qIncNinc": "n/a", "qIncEps": 1.5} for i in range(10)]
    years = [{"displayPeriod": "FY1", "qIncTrev": 5, "incEbi": 1}, {"displayPeriod": "FY2", "incTrev": 10, "incEbit": 2, "incNinc": 1, "incEps": 0.5}]
    balance = [{"displayPeriod": "B1", "balTeq": 100, "balTdeb": 50, "balCsti": 5}, {"displayPeriod": "B2", "balTeq": 0, "balTdeb": 50}]
    solvency = {"solvency_ratios": {"is_debt_safe": True}, "_comments": {"a": "line [one]", "b": "line [one]", "c": 3, "d": "two"}}
    return [
        ("ab", "quarterly_income", json.dumps(quarters), None), ("ab", "annual_income", json.dumps({"data": years}), "ok"), ("ab", "balance_sheet", json.dumps(balance), None), ("ab", "solvency", json.dumps(solvency), None),
        ("ab", "cagr", None, "unavailable: HTTPError"), ("ab", "dupont", json.dumps({"period": "FY", "dupont_5_factor": {"asset_turnover_x": "n/a", "factor_check_roe_pct": 9}, "raw_variables": {"pat": 1, "revenue": 8, "ebit": True}}), None), ("ab", "stock_peers", json.dumps({"peers": [{"name": "AB"}, {"name": "Other"}, {"x": 1}, {"name": "Third"}]}), None), ("ab", "stock_summary", json.dumps({"name": "AB", "x": 1}), None),
        ("ab", "full_financial_bundle", json.dumps({"info": "old", "k": [1, 2], "full": 1}), None), ("cd", "stock_summary", None, None),
    ]


def stored(spark, tmp_path):
    path = tmp_path / "payloads.json"
    path.write_text("\n".join(json.dumps(dict(zip(("symbol", "endpoint", "payload", "status"), r))) for r in payload_rows()))
    return statements.read_payloads(spark, str(path))


def test_payloads(spark, tmp_path):
    rows = stored(spark, tmp_path)
    assert rows.filter("status = 'unavailable'").count() == 1
    income = statements.periods(rows.filter("endpoint = 'quarterly_income'"), "income").orderBy("ordinal").collect()
    assert [r.qIncTrev for r in income] == [100.0 + i for i in range(10)] and income[0].qIncNinc is None
    assert statements.periods(rows.filter("endpoint = 'annual_income'"), "income").count() == 2
    lines = rows.filter("endpoint = 'solvency'").select(statements.comment_lines(F.col("payload"), 12).alias("x")).first().x
    assert lines == ["line [one]", "two"]
    odd = [("s", '[{"displayPeriod": "A", "incTrev": "123", "incEbi": 1e3, "incEps": true}, 5, null, {"displayPeriod": null, "incNinc": -2}]', "ok"), ("t", "not json", "ok"), ("u", None, "ok"), ("v", '{"data": {}}', "ok")]
    typed = statements.periods(spark.createDataFrame(odd, "symbol string, payload string, status string"), "income").orderBy("ordinal").collect()
    assert [(r.displayPeriod, r.incTrev, r.incEbi, r.incEps, r.incNinc) for r in typed] == [("A", None, 1000.0, None, None), (None, None, None, None, -2.0)]
    nested = '{"x": {"_comments": {"a": "1", "b": {"c": "no"}, "d": 2}}, "y": [{"_comments" :{"e": "2", "f": "1"}}], "_comments": "text"}'
    assert spark.range(1).select(statements.comment_lines(F.lit(nested), 9).alias("x"), statements.comment_lines(F.lit(None).cast("string"), 9).alias("y")).first()[:] == (["1", "2"], [])


def test_facade(spark, tmp_path):
    engine = Engine(spark, spark.createDataFrame([("AB Limited", "ab")], "name string, ticker string"), stored(spark, tmp_path))
    assert engine.search("limit").first().ticker == "ab"
    table = engine.income().first().table.split("\n")
    assert len(table) == 8 and table[0] == "| Q9 | ₹109.00 | ₹10.00 | N/A | ₹1.50 | [+] +0.93% |"
    assert engine.income(annual=True).first().table.split("\n") == ["| FY2 | ₹10.00 | ₹2.00 | ₹1.00 | ₹0.50 | [+] +100.00% |", "| FY1 | ₹5.00 | ₹1.00 | N/A | N/A | [+] Growth |"]
    assert engine.balance().first().table.split("\n")[1] == "| B1 | ₹100.00 | ₹50.00 | ₹5.00 | 0.50x | Healthy Solvency |"
    bundle = {r.key: r.value for r in engine.bundle("AB").collect()}
    assert bundle["ticker"] == "AB" and json.loads(bundle["info"])["name"] == "AB" and json.loads(bundle["k"]) == [1, 2] and engine.bundle("cd").count() == 0
    assert "line [one]" in engine.section("strengths_weaknesses").first().markdown
    dupont = engine.section("dupont_analysis").filter("symbol = 'ab'").first().markdown
    assert "| Net Profit Margin | PAT ÷ Revenue | 12.50% |" in dupont and "| Asset Turnover | Revenue ÷ Total Assets | N/A |" in dupont and "| Return on Equity (ROE) | PAT ÷ Net Worth | 9.00% |" in dupont
    thesis = engine.section("strengths_weaknesses").filter("symbol = 'ab'").first().markdown
    assert "1. Balance-sheet leverage is within safe limits" in thesis and "- two" in thesis
    web = Engine(spark, None, stored(spark, tmp_path), spark.createDataFrame([("ab", "worth ₹ 5 Crore")], "symbol string, web string"))
    assert "| Market Cap | ₹ 5 Crore |" in web.section("executive_summary").filter("symbol = 'ab'").first().markdown
    peers = web.section("clients_market").filter("symbol = 'ab'").first().markdown
    assert peers.endswith("  - Other\n  - Third") and "worth" in peers
    assert "full" in web.section("unknown").first().markdown
    results = engine.section("financial_performance").filter("symbol = 'ab'").first().markdown
    assert results.startswith(report.HEADINGS["financial_results"] + "\n\n#### Latest Quarterly") and results.count("| :--- | :--- | :--- | :--- | :--- | :--- |") == 2 and "| FY2 |" in results
    assert report.MISSING_ROW in engine.section("financial_results").filter("symbol = 'cd'").first().markdown
    assert engine.section("balance_sheet").filter("symbol = 'ab'").first().markdown.endswith(":\n1. line [one]\n2. two")
    valued = engine.dcf_report(spark.createDataFrame([("ab", 100.0, 10.0, 50.0)], "grp string, fcf double, shares double, price double"), 0.03).first()
    assert valued.symbol == "ab" and "| Intrinsic value | ₹1,225" in valued.report and "| Upside to the price | " in valued.report
    done = engine.report().collect()
    own = next(r for r in done if r.symbol == "ab")
    assert not own.is_accurate and report.HEADINGS["financial_results"] in own.report and own.report.endswith("*end of report*\n")


def test_folder_scan(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "b.md": "é\n".encode(), "report.md": b"no", "DCF_Report.md": b"no", "blank.txt": b" \n", "c.pdf": b"%PDF broken", "d.csv": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.source: (r.content, r.status) for r in filings.scan_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("hello", "ok"), "b.md": ("é\n", "ok"), "c.pdf": (None, "unreadable")}


def test_ingest_and_providers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" * 10)
    (tmp_path / "empty.pdf").write_bytes(b"")
    land, asked = str(tmp_path / "land"), []
    url = lambda name: (tmp_path / name).as_uri()
    assert sinks.download(spark, url("a.pdf"), land, "AB", "x.pdf") == 40
    saved = sinks.ingest(spark, land, "AB", {"presentation.pdf": b"p"}, {"annual_report.pdf": url("a.pdf"), "other.pdf": url("none.pdf")}, asked.append)
    assert saved == ["annual_report.pdf", "presentation.pdf"] and asked == ["AB"] and (tmp_path / "land/ab/annual_report.pdf").read_bytes() == b"%PDF" * 10
    with pytest.raises(ValueError):
        sinks.ingest(spark, land, "AB", {}, {"annual_report.pdf": url("empty.pdf")}, asked.append)
    assert sinks.ingest(spark, land, "AB", {}, {}, asked.append) == [] and asked == ["AB"]
    slow = lambda c, p: __import__("time").sleep(1) or "late"
    assert report.chain((slow, 0.05), (lambda c, p: " ", 1), (lambda c, p: f" {c}{p} ", 1))("a", "b") == "ab"
    with pytest.raises(RuntimeError):
        report.chain((slow, 0.05))("a", "b")
    assert report.missing_settings("Gemini", {}) == ["GEMINI_API_KEY"] and report.missing_settings("gemini", {"GEMINI_API_KEY": "x"}) == report.missing_settings("local", {}) == []


def test_endpoints(spark):
    spark.dataSource.register(EndpointSource)
    rows = spark.read.format("endpoints").options(base="http://127.0.0.1:9", symbols="a,b", endpoints="solvency,cagr", timeout="1").load().collect()
    assert len(rows) == 4 and all(r.payload is None and r.status.startswith("unavailable") for r in rows) and len(ENDPOINTS) == 16


def test_dictionary(spark):
    d = dictionary.metric_dictionary(spark)
    assert d.count() == 70 and d.filter("code = 'incEbit'").first().label == "EBIT"


def test_stream_takes_new_files_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    docs = spark.createDataFrame([("a", "x" * 2000), ("b", " ")], "name string, text string")
    docs.write.parquet(landing)
    run = lambda: ingest.chunk_stream(ingest.landing_stream(spark, landing, docs.schema), "name", "text", out, checkpoint).awaitTermination()
    run()
    assert spark.read.parquet(out).count() == 3
    spark.createDataFrame([("c", "new")], docs.schema).write.mode("append").parquet(landing)
    run()
    assert {r.source for r in spark.read.parquet(out).collect()} == {"a", "c"} and spark.read.parquet(out).count() == 4
    run()
    assert spark.read.parquet(out).count() == 4


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "reports")
    sinks.write_reports(spark.createDataFrame([("A", "one\ntwo\n"), ("B", "b")], "symbol string, report string"), path)
    sinks.write_reports(spark.createDataFrame([("B", "new")], "symbol string, report string"), path)
    assert sinks.cached_report(spark, path, "b").strip() == "new" and sinks.cached_report(spark, path, "A").strip() == "one\ntwo" and sinks.cached_report(spark, path, "zz") is None
    symbols = str(tmp_path / "symbols")
    sinks.register_symbol(spark, symbols, " AB ")
    assert spark.read.parquet(symbols).first().symbol == "ab"
    where = sinks.save_upload(spark, str(tmp_path / "landing"), "AB", "presentation.pdf", b"%PDF")
    assert where.endswith("/ab/presentation.pdf")
    for call in (lambda: sinks.register_symbol(spark, symbols, None), lambda: sinks.save_upload(spark, path, "a", "x", b""), lambda: prompt("nothing")):
        with pytest.raises(ValueError):
            call()
    assert "SECTION" in prompt("critique", section="SECTION", context="c") and "Answer" in prompt("critique")


def test_json_spans_of_any_depth(spark):
    from filigrane.functions import spans

    deep = '{"a":' * 50 + '{"_comments": {"k": "deep } [ \\" x"}}' + "}" * 50
    lines = {
        '{"_comments": {"a": "one } two", "b": "z"}}': ["one } two", "z"],
        deep: ['deep } [ " x'],
        '{"x": "say \\"_comments\\": {\\"q\\": \\"no\\"} ", "_comments" : {"a":"yes","_comments":{"n":"nested"},"z":"after"}}': ["yes", "after", "nested"],
        'prose } "open\n ]] {"_comments"\n:\n {"a":"ok"}} and "x': ["ok"],
        '{"_comments": {"a": bad}, "b": {"_comments": {"q":"fine"}}}': ["fine"],
        '{"_comments": {"o": {"p": {"q": {"r": {"s": {"t": {"u": {"v": "w"}}}}}}}, "c": "seven"}}': ["seven"],
        '{"_comments": {"a": "never closed"}': ["never closed"],
        '{"_comments": {"a": "never closed"': [],
        '{"_comments": [{"a": "no object"}], "_comments_": {"a": "another key"}}': [],
        "": [],
    }
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", statements.comment_lines(F.col("t"), 9).alias("x")).collect()
    assert {r.t: r.x for r in rows} == lines
    many = '{"a": [' + ",".join('{"_comments": {"k": "v%d \\" }"}}' % i for i in range(3000)) + "]}"
    assert spark.createDataFrame([(many,)], "t string").select(F.size(statements.comment_lines(F.col("t"), 10**6)).alias("n")).first().n == 3000
    after = {
        '## A\n[1, {"x": "] [ \\"", "y": [2, "}"]}] tail ## B [3]': (["1", '{"x":"] [ \\"","y":[2,"}"]}'], {}),
        "## A unavailable": ([], {}),
        "## A [1, 2": ([], {}),
        "## A [1, oops]": ([], {}),
        '## B {"k": {"z": "}"}} ## A [7]': (["7"], {"k": '{"z":"}"}'}),
        "## A [] ## B {} ## A [1]": ([], {}),
        "no header [1] {}": ([], {}),
    }
    shown = [F.transform(spans.array_after(F.col("t"), "## A"), lambda v: F.to_json(v)).alias("a"), F.transform_values(spans.object_after(F.col("t"), "## B"), lambda _, v: F.to_json(v)).alias("o")]
    assert {r.t: (r.a, r.o) for r in spark.createDataFrame([(k,) for k in after], "t string").select("t", *shown).collect()} == after
    nothing = spark.range(1).select(spans.array_after(F.lit(None).cast("string"), "x").alias("a"), spans.object_after(F.lit(None).cast("string"), "x").alias("o")).first()
    assert (nothing.a, nothing.o) == ([], {})
