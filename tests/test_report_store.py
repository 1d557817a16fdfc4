"""Reports are made anew when their input changes, and only then."""

from filigrane.api import Engine
from filigrane.operators import prompts
from filigrane.sources import sinks
from filigrane.sources.report_store import ReportStore, fingerprints

STORED = "symbol string, endpoint string, payload string, status string"
ROWS = [("A:B", "solvency", "{}", "ok"), ("A:B", "liquidity", None, "unavailable"), ("P%Q", "solvency", '{"x": 1}', "ok"), (None, "solvency", "{}", "ok")]
FILED = "symbol string, source string, section string, content string"


def prints(spark, rows, version="v"):
    return {r["symbol"]: r["fingerprint"] for r in fingerprints({"p": spark.createDataFrame(rows, STORED)}, version).collect()}


def test_fingerprints_tell_any_change(spark):
    base = prints(spark, ROWS)
    assert set(base) == {"A:B", "P%Q"} and prints(spark, ROWS[::-1]) == base
    for other in ([ROWS[0]], ROWS[:2] + [ROWS[1]], [("A:B", "solvency", "{}", "ok"), ("A:B", "liquidity", "", "unavailable")], [("A:B", "solvency", "{}", "ok"), ("A:B", None, "liquidity", "unavailable")]):
        assert prints(spark, other)["A:B"] != base["A:B"]
    assert prints(spark, ROWS, "w")["A:B"] != base["A:B"]


def test_only_changed_reports_are_made(spark, tmp_path, monkeypatch):
    own = ReportStore(spark, f"{tmp_path}/reports")
    filed = spark.createDataFrame([("A:B", "f", "general", "old words"), ("Z", "f", "general", "of nobody")], FILED)
    engine = lambda rows=ROWS, filings=filed: Engine(spark, stored=spark.createDataFrame(rows, STORED), filed=filings)
    assert own.report("A:B") is None and engine().refresh_reports(own) == 2
    first = own.report("a:b")
    assert "old words" in first and own.report("P%Q") and own.report("none") is None
    assert engine(ROWS[::-1]).refresh_reports(own) == 0
    new = spark.createDataFrame([("A:B", "f", "general", "new words"), ("Z", "f", "general", "of nobody")], FILED)
    assert engine(filings=new).refresh_reports(own) == 1
    assert "new words" in own.report("A:B") and {(r["symbol"], r["generation"]) for r in own.latest().collect()} == {("A:B", 2), ("P%Q", 1)}
    monkeypatch.setitem(prompts.PROMPTS, "critique", "another prompt")
    assert engine(filings=new).refresh_reports(own) == 2


def test_written_reports_are_found_whatever_their_symbol(spark, tmp_path):
    rows = [("A:B", "one\ntwo"), ("P%Q", "three"), ("a/b", "four"), ("007", "five")]
    sinks.write_reports(spark.createDataFrame(rows, "symbol string, report string"), f"{tmp_path}/r")
    assert {s: sinks.cached_report(spark, f"{tmp_path}/r", s) for s, _ in rows} == {s: t + "\n" for s, t in rows}
    assert sinks.cached_report(spark, f"{tmp_path}/r", "x") is None and sinks.cached_report(spark, f"{tmp_path}/none", "x") is None
