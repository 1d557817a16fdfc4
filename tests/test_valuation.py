"""As-of joins, forecasts, labels and cash flows on odd rows."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from filigrane.api import Engine
from filigrane.operators import valuation

START = datetime(2024, 1, 1)


def test_as_of_equals_a_plain_search(spark):
    rng = random.Random(2)
    day = lambda: START + timedelta(seconds=rng.randrange(200_000))
    known = [(rng.choice("abc"), day(), rng.choice([None, 1, 2, 3]), f"v{i}") for i in range(60)]
    known += [("a", known[0][1], 9, "tie"), ("a", None, 5, "no time"), (None, START, 5, "no symbol")]
    rows = [(i, rng.choice("abcd"), day()) for i in range(150)] + [(900, "a", None), (901, None, START), (902, known[0][0], known[0][1])]
    left, right = spark.createDataFrame(rows, "fact int, symbol string, at timestamp"), spark.createDataFrame(known, "symbol string, since timestamp, n int, label string")
    for span in (3_000, 86_400, 10**9):  # many spans a symbol, some, and one
        got = valuation.as_of(left, right, ["symbol"], "at", "since", span)
        assert got.columns == ["fact", "symbol", "at", "n", "label"]
        want = []
        for i, s, t in rows:
            own = [(k[1], (k[2] is not None, k[2] or 0, k[3]), k[2:]) for k in known if t is not None and s is not None and k[0] == s and k[1] is not None and k[1] <= t]
            want.append((i, *(max(own)[2] if own else (None, None))))
        assert sorted((r["fact"], r["n"], r["label"]) for r in got.collect()) == sorted(want, key=lambda w: w[0])
    assert valuation.as_of(left.limit(0), right, ["symbol"], "at", "since").count() == 0
    assert {r["label"] for r in valuation.as_of(left, right.limit(0), ["symbol"], "at", "since").collect()} == {None}


def test_forecast_equals_least_squares(spark):
    rows = [("a", 2000 + i, v) for i, v in enumerate([10.0, 12.5, 11.0, 15.0, 18.0])] + [("b", 2001, 1.0), ("b", 2002, 2.0), ("c", 2003, 5.0), ("c", 2004, None), ("c", None, 1.0), ("d", 2000, 1.0), ("d", 2000, 2.0), ("d", 2000, 3.0)]
    got = {(r["s"], r["year"]): r for r in valuation.forecast(spark.createDataFrame(rows, "s string, y int, v double"), ["s"], "y", "v").collect()}
    assert {s for s, _ in got} == {"a", "b", "c", "d"} and {r["forecast"] for (s, _), r in got.items() if s != "a"} == {None}
    x, y = np.arange(2000, 2005), np.array([10, 12.5, 11, 15, 18])
    slope, start = np.polyfit(x, y, 1)
    error = np.sqrt(((y - start - slope * x) ** 2).sum() / 3)
    for k in range(2005, 2010):
        margin = 2 * error * np.sqrt(1 + 1 / 5 + (k - 2002) ** 2 / 10)
        assert np.allclose([got["a", k][c] for c in ("forecast", "low", "high")], [start + slope * k, start + slope * k - margin, start + slope * k + margin])


def test_labels_replace_whole_tokens_only(spark):
    labels = {"incTrev": "Total Revenue", "incTrevX": "Longer", "cafFee": "", "balTota": "Total $1 \\ Assets"}
    texts = {"incTrev, incTrevX; incTrev2 xincTrev incTrev_": "Total Revenue, Longer; incTrev2 xincTrev incTrev_", "(balTota)cafFee": "(Total $1 \\ Assets)cafFee", "": "", "é incTrev é": "é Total Revenue é", "no code": "no code"}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", valuation.labelled(F.col("t"), labels).alias("x")).collect()
    assert {r.t: r.x for r in rows} == texts | {None: None}
    long = "incTrev " * 200_000
    assert spark.createDataFrame([(long,)], "t string").select(valuation.labelled(F.col("t"), labels).alias("x")).first().x == "Total Revenue " * 200_000


def test_stored_cash_flow_gives_a_valuation(spark):
    stored = spark.createDataFrame(
        [("A", "cash_flow", '[{"cafFcf": 5}, {"cafFcf": 100}, {"cafCfoa": 1}]', "ok"), ("B", "cash_flow", '{"data": [{"cafCfoa": 100, "cafCexp": -40}]}', "ok"), ("C", "cash_flow", "[]", "ok"), ("D", "cash_flow", None, "unavailable")],
        "symbol string, endpoint string, payload string, status string",
    )
    prices = spark.createDataFrame([(s, 10.0, 50.0) for s in "ABCDE"], "symbol string, shares double, price double")
    got = {r["grp"]: r for r in Engine(spark, stored=stored).stored_dcf(prices, 0.03).collect()}
    assert {s: r["fcf"] for s, r in got.items()} == {"A": 100.0, "B": 60.0} and abs(got["A"]["intrinsic"] / got["B"]["intrinsic"] - 100 / 60) < 1e-9


def test_multiples_of_losses_and_zeros(spark):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in {"price": 2.0, "shares": 5.0, "debt": 4.0, "cash": 1.0, "equity": -3.0, "ttm_revenue": 0.0, "ttm_pat": -1.0, "ttm_ebitda": 2.0, "ttm_fcf": 1.0, "ttm_growth_pct": 5.0}.items()))
    got = valuation.multiples(row).first()
    assert (got.market_cap, got.enterprise_value, got.pe, got.pb, got.ps, got.ev_ebitda, got.ev_sales, got.peg, got.fcf_yield_pct) == (10.0, 13.0, None, None, None, 6.5, None, None, 10.0)
