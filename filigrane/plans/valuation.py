"""Queries of valuation: as-of metrics, cash-flow DCF, forecast, and codes in prose; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import statements, valuation
from filigrane.plans.catalogue import YEARLY_SQL, query, r6, statement, statement_sql, yearly
from filigrane.sources import dictionary, statements as payloads
from filigrane.sources.tables import table

QUARTER = {"pat": "revenue - cost - tax", "ebitda": "(revenue - cost) * 1.1::DOUBLE", "fcf": "(revenue - cost) * 0.7::DOUBLE - tax"}
LEVELS = {"debt": "cost * 0.5::DOUBLE", "cash": "cost * 0.1::DOUBLE", "equity": "cost * 1.2::DOUBLE + tax"}
TTM = ("revenue", "pat", "ebitda", "fcf")
SHOWN = ("market_cap", "enterprise_value", "pe", "pb", "ps", "ev_ebitda", "ev_sales", "peg", "fcf_yield_pct")
KNOWN_SQL = f"""SELECT nation, period, CAST(period || '-01' AS TIMESTAMP) + INTERVAL 135 DAY AS known, {', '.join(LEVELS)}, {', '.join(f'ttm_{v}' for v in TTM)}, CASE WHEN lag(ttm_pat, 4) OVER w > 0 THEN (ttm_pat - lag(ttm_pat, 4) OVER w) / lag(ttm_pat, 4) OVER w * 100 END AS ttm_growth_pct
  FROM (SELECT *, {', '.join(f'CASE WHEN count({v}) OVER y = 4 THEN sum({v}) OVER y END AS ttm_{v}' for v in TTM)}
    FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in (QUARTER | LEVELS).items())} FROM ({statement_sql('quarter')})) WINDOW y AS (PARTITION BY nation ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY nation ORDER BY period)"""


@query(
    f"""SELECT o_orderkey, period, round(cap, 4) AS market_cap, round(ev, 4) AS enterprise_value, round(pe, 6) AS pe, round(cap / CASE WHEN equity > 0 THEN equity END, 6) AS pb, round(cap / nullif(ttm_revenue, 0), 6) AS ps,
      round(ev / CASE WHEN ttm_ebitda > 0 THEN ttm_ebitda END, 6) AS ev_ebitda, round(ev / nullif(ttm_revenue, 0), 6) AS ev_sales, round(pe / CASE WHEN ttm_growth_pct > 0 THEN ttm_growth_pct END, 6) AS peg, round(ttm_fcf / nullif(cap, 0) * 100, 6) AS fcf_yield_pct
    FROM (SELECT *, cap / CASE WHEN ttm_pat > 0 THEN ttm_pat END AS pe, cap + debt - cash AS ev FROM (
      SELECT p.o_orderkey, p.cap, k.* FROM (SELECT o_orderkey, c_nationkey AS nation, o_orderdate, o_totalprice * 100 AS cap FROM orders JOIN customer ON o_custkey = c_custkey) p
      ASOF LEFT JOIN ({KNOWN_SQL}) k ON p.nation = k.nation AND p.o_orderdate >= k.known))"""
)
def valuation_as_of(spark, sf):
    """Every order is a price of its nation's shares, valued by the statement known on its day, 135 days after its quarter began."""
    of = {n: F.expr(e.replace("::DOUBLE", "D")) for n, e in (QUARTER | LEVELS).items()}
    quarters = valuation.trailing(statement(spark, sf, "quarter").withColumns(of), ["nation"], "period", list(TTM))
    from pyspark.sql import Window

    year_ago = F.lag("ttm_pat", 4).over(Window.partitionBy("nation").orderBy("period"))
    known = quarters.withColumn("ttm_growth_pct", F.when(year_ago > 0, (F.col("ttm_pat") - year_ago) / year_ago * 100))
    known = known.select("nation", "period", F.expr("to_timestamp(period || '-01') + INTERVAL 135 DAYS").alias("known"), *LEVELS, *(f"ttm_{v}" for v in TTM), "ttm_growth_pct")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    prices = orders.select("o_orderkey", F.col("c_nationkey").alias("nation"), "o_orderdate", F.col("o_totalprice").alias("price"), F.lit(100.0).alias("shares"))
    out = valuation.multiples(valuation.as_of(prices, known, ["nation"], "o_orderdate", "known"))
    return out.select("o_orderkey", "period", *(F.round(c, 4 if c in SHOWN[:2] else 6).alias(c) for c in SHOWN))


@query(
    """SELECT event_id, e.user_id, seen, round(last_value, 6) AS last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase') e
      ASOF LEFT JOIN (SELECT user_id, ts AS seen_at, max(event_id) AS seen, max_by(value, event_id) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.seen_at"""
)
def event_as_of(spark, sf):
    """The last purchase before each other event of a user."""
    events = table(spark, sf, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen"), F.col("value").alias("last_value"))
    rest = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return valuation.as_of(rest, bought, ["user_id"], "ts", "seen_at", 86_400).select("event_id", "user_id", "seen", r6("last_value").alias("last_value"))


RISK = {"retained": "equity * 0.6::DOUBLE", "payables": "cost * 0.2::DOUBLE", "cfo": "pat * 1.1::DOUBLE", "market_cap": "revenue * 3"}


@query(
    f"""SELECT nation, period, round(eva, 4) AS eva, round(z, 6) AS altman_z, CASE WHEN z < 1.81 THEN 'distress' WHEN z <= 2.99 THEN 'grey' WHEN z > 2.99 THEN 'safe' END AS altman_zone, round(pat / nullif(assets, 0) * 100, 6) AS roa_pct, round(365 * payables / nullif(cogs, 0), 6) AS dpo,
      round(365 * receivables / nullif(revenue, 0) + 365 * inventory / nullif(cogs, 0) - 365 * payables / nullif(cogs, 0), 6) AS cash_conversion_cycle, round(cfo / nullif(current_liabilities, 0), 6) AS operating_cash_ratio, round(cfo / nullif(pat, 0), 6) AS earnings_quality
    FROM (SELECT *, ebit * 0.75::DOUBLE - 0.13::DOUBLE * (equity + debt - cash) AS eva, 1.2::DOUBLE * (current_assets - current_liabilities) / nullif(assets, 0) + 1.4::DOUBLE * retained / nullif(assets, 0) + 3.3::DOUBLE * ebit / nullif(assets, 0)
        + 0.6::DOUBLE * market_cap / nullif(assets - equity, 0) + revenue / nullif(assets, 0) AS z
      FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RISK.items())} FROM ({YEARLY_SQL})))"""
)
def quality_and_risk(spark, sf):
    rows = yearly(spark, sf).withColumns({n: F.expr(e.replace("::DOUBLE", "D")) for n, e in RISK.items()})
    out = valuation.quality_and_risk(rows)
    return out.select("nation", "period", F.round("eva", 4).alias("eva"), r6("altman_z").alias("altman_z"), "altman_zone", *(r6(c).alias(c) for c in ("roa_pct", "dpo", "cash_conversion_cycle", "operating_cash_ratio", "earnings_quality")))


@query(
    """WITH f AS (SELECT 'c' || c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_acctbal - abs(c_acctbal / 2) ELSE 100 END AS fcf FROM customer),
      v AS (SELECT symbol, fcf, sum(fcf * pow(1.06::DOUBLE, least(y, 5)) * pow(1.05::DOUBLE, greatest(y - 5, 0)) / pow(1.13::DOUBLE, y)) AS pv_fcf,
        max(CASE WHEN y = 10 THEN 1 END) * fcf * pow(1.06::DOUBLE, 5) * pow(1.05::DOUBLE, 5) * 1.03::DOUBLE / 0.1::DOUBLE / pow(1.13::DOUBLE, 10) AS pv_terminal FROM f, (SELECT CAST(unnest(range(1, 11)) AS DOUBLE) AS y) GROUP BY symbol, fcf)
      SELECT symbol, round(fcf, 4) AS fcf, round(pv_fcf, 2) AS pv_fcf, round(pv_terminal, 2) AS pv_terminal, round((pv_fcf + pv_terminal) * 0.8::DOUBLE / 50, 2) AS price_mos20 FROM v"""
)
def dcf_from_cash_flow(spark, sf):
    """Stored cash flows: told, made of operations and spending, or only in an older period."""
    key, flow = F.col("c_custkey") % 3, F.col("c_acctbal").cast("string")
    half = (F.col("c_acctbal") / 2).cast("string")
    last = F.when(key == 0, F.concat(F.lit('{"cafFcf": '), flow, F.lit(', "cafCfoa": 1, "cafCexp": 1}'))).when(key == 1, F.concat(F.lit('{"cafCfoa": '), flow, F.lit(', "cafCexp": '), half, F.lit("}"))).otherwise('{"cafCfoa": 7}')
    rows = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol"), F.concat(F.lit('[{"cafFcf": 9}, {"cafFcf": 100}, '), last, F.lit("]")).alias("payload"), F.lit("ok").alias("status"))
    flows = valuation.free_cash_flow(payloads.periods(rows, "cashflow")).withColumns({"shares": F.lit(50.0), "price": F.lit(10.0)})
    return statements.dcf(flows, 0.03).select("symbol", F.round("fcf", 4).alias("fcf"), *(F.round(c, 2).alias(c) for c in ("pv_fcf", "pv_terminal", "price_mos20")))


LINE = "regr_slope(y, x) AS slope, avg(y) AS centre, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n, avg(x) AS mean, max(x) AS last"


@query(
    f"""SELECT nation, CAST(ahead AS INTEGER) AS year, round(CASE WHEN n >= 3 THEN line END, 0) AS forecast, round(CASE WHEN n >= 3 THEN line - margin END, 0) AS low, round(CASE WHEN n >= 3 THEN line + margin END, 0) AS high FROM (
      SELECT *, centre + slope * (ahead - mean) AS line, 2 * sqrt(greatest(0, syy - slope * sxy) / nullif(n - 2, 0)) * sqrt(1 + 1.0::DOUBLE / n + (ahead - mean) * (ahead - mean) / nullif(sxx, 0)) AS margin FROM (
        SELECT *, last + k AS ahead FROM (SELECT nation, {LINE} FROM (SELECT nation, revenue AS y, CAST(period[1:4] AS DOUBLE) - CASE WHEN nation % 7 = 0 THEN 1 ELSE 0 END AS x FROM ({YEARLY_SQL}) WHERE nation % 6 <> 0 OR period >= '2000') GROUP BY nation), (SELECT unnest(range(1, 6)) AS k)))"""
)
def five_year_forecast(spark, sf):
    year = F.substring("period", 1, 4).cast("int") - F.when(F.col("nation") % 7 == 0, 1).otherwise(0)
    rows = yearly(spark, sf).filter("nation % 6 <> 0 or period >= '2000'").withColumn("year", year)
    return valuation.forecast(rows, ["nation"], "year", "revenue").select("nation", "year", *(F.round(c, 0).alias(c) for c in ("forecast", "low", "high")))


CODES = dictionary.labels()
SAID = [(c, label) for c, label in CODES.items() if label]


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'In ' || label || ', not x' || code || ' or ' || code || '_2: ' || substr(text, 1, 400) || ' (' || label || ')' WHEN doc_id % 4 = 1 THEN text || chr(10) || label ELSE text END AS prose FROM (
      SELECT *, {[c for c, _ in SAID]}[doc_id % {len(SAID)} + 1] AS code, {[label.replace("'", "’") for _, label in SAID]}[doc_id % {len(SAID)} + 1] AS label FROM documents)"""
)
def codes_to_labels(spark, sf):
    code = F.get(F.array(*(F.lit(c) for c, _ in SAID)), (F.col("doc_id") % len(SAID)).cast("int"))
    kind = F.col("doc_id") % 4
    held = F.concat(F.lit("In "), code, F.lit(", not x"), code, F.lit(" or "), code, F.lit("_2: "), F.substring("text", 1, 400), F.lit(" ("), code, F.lit(")"))
    text = F.when(kind == 0, held).when(kind == 1, F.concat("text", F.lit("\n"), code)).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", valuation.labelled(text, {c: label.replace("'", "’") for c, label in CODES.items()}).alias("prose"))
