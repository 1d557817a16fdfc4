"""Completions and endpoints are asked once, tried again where that helps, and only for what is read."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from filigrane.operators import report
from filigrane.sources import endpoints

ROWS = [(i, f"context {i % 7}", "prompt") for i in range(20)] + [(90, None, "prompt"), (91, "", "prompt"), (92, "bad", "prompt")]


def model(folder, dies=None):
    """A model that notes each call in a file of its own; it dies once at a question."""

    def complete(context, prompt):
        import os
        import uuid

        if dies and context == dies and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(repr(context))
        if context == "bad":
            raise ValueError("no answer")
        return f"answer to {context}"

    return complete


def calls(folder):
    return Counter(p.read_text() for p in folder.glob("*.call"))


def test_answers_are_kept_over_runs_and_lost_workers(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "i int, context string, prompt string").repartition(3)
    folder, kept = tmp_path / "calls", f"{tmp_path}/answers"
    folder.mkdir()
    one = lambda dies=None, version="": {r["i"]: r["answer"] for r in report.completed(rows, model(str(folder), dies), kept, version).collect()}
    with pytest.raises(Exception, match="(?i)python worker|crash|exit"):  # this session tries a task once; on a cluster it would be tried again
        one(dies="context 3")
    answered = {k for p in (tmp_path / "answers").rglob("*.json") for k in p.read_text().splitlines()}
    assert (folder / "died").exists()
    first = one("context 3")
    assert first[3] == first[10] == "answer to context 3" and first[91] == "answer to " and first[90] == "answer to None"
    assert first[92] == "bad\nprompt"  # a failure passes the context through
    count = calls(folder)
    assert all(n <= 2 for n in count.values()) and answered
    assert one() == first and calls(folder) == count + Counter({repr("bad"): 1})  # only what failed is asked again
    assert one(version="v2") == first and calls(folder)[repr("context 1")] == count[repr("context 1")] + 1


def test_answers_without_a_store(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "i int, context string, prompt string").coalesce(1)
    got = {r["i"]: r["answer"] for r in report.completed(rows, model(str(tmp_path))).collect()}
    assert got[5] == "answer to context 5" and got[92] == "bad\nprompt" and sum(calls(tmp_path).values()) == len(ROWS)


@pytest.fixture
def server():
    asked, busy, lock = [], Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked.append(self.path)
                busy[self.path] += 1
                first = busy[self.path] == 1
            code = 429 if first and "/LATE/" in self.path else 404 if "/NONE/" in self.path else 200
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0.1")
            self.end_headers()
            self.wfile.write(json.dumps({"success": "/BAD/" not in self.path, "data": {"path": self.path}}).encode())

        def log_message(self, *_):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", asked
    own.shutdown()


def test_filters_ask_only_for_what_is_read(spark, server):
    base, asked = server
    spark.dataSource.register(endpoints.EndpointSource)
    read = lambda **o: spark.read.format("endpoints").options(base=base, wait="0.05", pushdown="true", **o).load()
    rows = read(symbols="A,B,LATE").filter("symbol in ('A', 'LATE') and endpoint = 'dupont'").collect()
    assert {(r.symbol, r.status) for r in rows} == {("A", "ok"), ("LATE", "ok")}
    assert Counter(asked) == {"/api/v1/stocks/A/dupont": 1, "/api/v1/stocks/LATE/dupont": 2}  # 429 is tried again
    asked.clear()
    rows = read().filter(F.col("symbol").isin("NONE", "BAD")).filter("endpoint in ('stock_summary', 'cagr') and status <> 'ok'").collect()
    assert sorted((r.symbol, r.endpoint, r.status) for r in rows) == [("BAD", "stock_summary", "unavailable"), ("NONE", "cagr", "unavailable: HTTPError 404"), ("NONE", "stock_summary", "unavailable: HTTPError 404")]
    assert len(asked) == 4 and read().count() == 0  # no symbol is named
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:  # without pushdown all that the options name is asked
        rows = spark.read.format("endpoints").options(base=base, symbols="A,B", endpoints="cagr").load().filter("symbol = 'A'").collect()
        assert [(r.symbol, r.status) for r in rows] == [("A", "ok")] and len(asked) == 6
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_fetched_pairs_are_kept(spark, server, tmp_path):
    base, asked = server
    symbols = spark.createDataFrame([("A B",), ("LATE",), ("NONE",), ("A B",)], "symbol string")
    get = lambda version: endpoints.fetched(symbols, base, f"{tmp_path}/a", ("dupont", "stock_summary"), version, wait=0.05).orderBy("symbol", "endpoint").collect()
    rows = get("monday")
    assert [(r.symbol, r.endpoint, r.status) for r in rows] == [("A B", "dupont", "ok"), ("A B", "stock_summary", "ok"), ("LATE", "dupont", "ok"), ("LATE", "stock_summary", "ok"), ("NONE", "dupont", "unavailable"), ("NONE", "stock_summary", "unavailable")]
    assert json.loads(rows[1].payload) == {"path": "/api/v1/stocks/A%20B/summary"}
    asked.clear()
    assert get("monday") == rows and set(asked) == {"/api/v1/stocks/NONE/dupont", "/api/v1/stocks/NONE/summary"}
    asked.clear()
    assert get("tuesday") == rows and len(asked) == 8


def test_stream_of_rounds_asks_nothing_twice(spark, server, tmp_path):
    base, asked = server
    spark.dataSource.register(endpoints.EndpointSource)

    def run(checkpoint):
        stream = spark.readStream.format("endpoints").options(base=base, symbols="A,B", endpoints="dupont,cagr", every="100000000", answers=f"{tmp_path}/answers").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{checkpoint}").option("checkpointLocation", f"{tmp_path}/c-{checkpoint}").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(f"{tmp_path}/{checkpoint}").count()

    assert run("one") == 4 and len(asked) == 4
    assert run("one") == 4 and len(asked) == 4  # the round was read
    assert run("two") == 4 and len(asked) == 4  # a reader that starts over in the same round finds the answers
