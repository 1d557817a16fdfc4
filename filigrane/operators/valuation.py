"""Valuation at a point in time: the statement known on each day, trailing figures, multiples and a forecast.

Formulas are the textbook's.  A ratio whose divisor is 0 or null is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions import finance as X

#: Seconds of a span of time that one task joins: a symbol's rows are split by it, however many it has.
SPAN = 90 * 86_400


def as_of(rows: DataFrame, known: DataFrame, by: list[str], at: str, since: str, span: int = SPAN) -> DataFrame:
    """rows with the columns of the row of known that is in force: the last whose since isn't after at, of the same by.

    Of several with one since, the one of the largest values, column by column.  Rows of which none is in force, or
    that lack a by or at, have nulls.  Each (by, span of time) is sorted by itself; what was in force when it begins comes from one small row for
    each such span, so that a symbol with a large share of all rows is no task of its own.
    """
    more = [c for c in known.columns if c not in (*by, since)]
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (span * 1_000_000)).cast("long")
    left = rows.select(*by, F.struct(*(F.col(c) for c in rows.columns)).alias("row"), F.col(at).cast("timestamp").alias("time"), slot(at).alias("slot"), F.lit(1).alias("kind"))
    facts = known.dropna(subset=[*by, since]).select(*by, F.col(since).cast("timestamp").alias("time"), slot(since).alias("slot"), F.struct(*more).alias("fact"))
    order = Window.partitionBy(*by, "slot").orderBy("time", "kind", "fact")
    both = left.withColumn("fact", F.lit(None).cast(facts.schema["fact"].dataType)).unionByName(facts.withColumns({"kind": F.lit(0), "row": F.lit(None).cast(left.schema["row"].dataType)}))
    inside = both.withColumn("own", F.last("fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 1")
    last = facts.groupBy(*by, "slot").agg(F.max_by("fact", F.struct("time", "fact")).alias("fact"))
    slots = left.groupBy(*by, "slot").agg(F.lit(1).alias("asked")).join(last, [*by, "slot"], "full")
    before = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    entry = slots.select(*by, "slot", F.last("fact", ignorenulls=True).over(before).alias("entry"))  # a row for each span of a symbol
    found = inside.join(entry, [*by, "slot"], "left").withColumn("fact", F.when(F.col("time").isNotNull(), F.coalesce("own", "entry")))
    return found.select("row.*", *(F.col(f"fact.{c}").alias(c) for c in more))


def trailing(quarters: DataFrame, by: list[str], order: str, values: list[str], periods: int = 4) -> DataFrame:
    """quarters with ttm_<value>: the sum of the last so many periods, null before there are so many or if one is null."""
    last = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - periods, 0)
    return quarters.withColumns({f"ttm_{v}": F.when(F.count(v).over(last) == periods, F.sum(v).over(last)) for v in values})


def multiples(rows: DataFrame) -> DataFrame:
    """market_cap, enterprise_value, pe, pb, ps, ev_ebitda, ev_sales, peg, fcf_yield_pct from price, shares, debt, cash, equity, ttm_revenue, ttm_pat, ttm_ebitda, ttm_fcf, ttm_growth_pct.

    P/E, EV/EBITDA and PEG are null for losses, and PEG without growth, as such multiples say nothing then.
    """
    c = F.col
    above = lambda x: F.when(x > 0, x)
    cap = c("price") * c("shares")
    value = cap + c("debt") - c("cash")
    pe = X.ratio(cap, above(c("ttm_pat")))
    return rows.withColumns(
        {
            "market_cap": cap, "enterprise_value": value, "pe": pe, "pb": X.ratio(cap, above(c("equity"))), "ps": X.ratio(cap, c("ttm_revenue")), "ev_ebitda": X.ratio(value, above(c("ttm_ebitda"))),
            "ev_sales": X.ratio(value, c("ttm_revenue")), "peg": X.ratio(pe, above(c("ttm_growth_pct"))), "fcf_yield_pct": X.percent(c("ttm_fcf"), cap),
        }
    )


def quality_and_risk(rows: DataFrame, tax_rate: float = 0.25, wacc: float = 0.13) -> DataFrame:
    """eva, altman_z and its zone, roa_pct, cash_conversion_cycle, dpo, operating_cash_ratio, earnings_quality.

    From ebit, pat, revenue, assets, equity, debt, cash, current_assets, current_liabilities, retained, market_cap,
    receivables, inventory, payables, cogs, cfo.  The zones are those of listed manufacturers: below 1.81, up to 2.99, above.
    """
    c = F.col
    invested = c("equity") + c("debt") - c("cash")
    liabilities = c("assets") - c("equity")
    z = (
        1.2 * X.ratio(c("current_assets") - c("current_liabilities"), c("assets")) + 1.4 * X.ratio(c("retained"), c("assets")) + 3.3 * X.ratio(c("ebit"), c("assets"))
        + 0.6 * X.ratio(c("market_cap"), liabilities) + X.ratio(c("revenue"), c("assets"))
    )
    days = lambda a, b: X.ratio(365 * c(a), c(b))
    return rows.withColumns(
        {
            "eva": c("ebit") * (1 - tax_rate) - wacc * invested, "altman_z": z, "altman_zone": F.when(z < 1.81, "distress").when(z <= 2.99, "grey").when(z > 2.99, "safe"), "roa_pct": X.percent(c("pat"), c("assets")),
            "dpo": days("payables", "cogs"), "cash_conversion_cycle": days("receivables", "revenue") + days("inventory", "cogs") - days("payables", "cogs"),
            "operating_cash_ratio": X.ratio(c("cfo"), c("current_liabilities")), "earnings_quality": X.ratio(c("cfo"), c("pat")),
        }
    )


def free_cash_flow(periods: DataFrame) -> DataFrame:
    """symbol, fcf of the newest period of stored cash flows (symbol, ordinal, cafFcf, cafCfoa, cafCexp) that tells it.

    Where a period lacks the free cash flow, it is that of operations less what is spent on assets, whichever sign that has.
    """
    fcf = F.coalesce("cafFcf", F.col("cafCfoa") - F.abs("cafCexp"))
    return periods.filter(fcf.isNotNull()).groupBy("symbol").agg(F.max_by(fcf, "ordinal").alias("fcf"))


def forecast(periods: DataFrame, by: list[str], year: str, value: str, years: int = 5, errors: float = 2.0) -> DataFrame:
    """by, year, forecast, low, high: a straight line through each symbol's years, carried on so many years, with prediction bounds of so many standard errors.

    One aggregation.  Null with fewer than three years; a symbol without a year has no row.
    """
    x, y = F.col(year).cast("double"), F.col(value).cast("double")
    use = periods.filter(x.isNotNull() & y.isNotNull())
    line = use.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(x).alias("last"), F.avg(x).alias("mean"), F.regr_slope(y, x).alias("slope"), F.avg(y).alias("centre"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    ahead = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("k")).withColumn("at", F.col("last") + F.col("k"))
    enough = (F.col("n") >= 3) & (F.col("sxx") > 0)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    margin = errors * spread * F.sqrt(1 + 1 / F.col("n") + F.pow(F.col("at") - F.col("mean"), 2) / F.col("sxx"))
    line = F.col("centre") + F.col("slope") * (F.col("at") - F.col("mean"))  # through the centre: no digits are lost to large years
    return ahead.select(*by, F.col("at").cast("int").alias("year"), F.when(enough, line).alias("forecast"), F.when(enough, line - margin).alias("low"), F.when(enough, line + margin).alias("high"))


def labelled(text: Column, labels: dict[str, str]) -> Column:
    """text with each metric code, where it stands as a whole token, replaced by its label; codes without one stay.

    A token is a run of letters, digits and underscores, so that a code is never found inside another.  Linear in the text.
    """
    known = {c: label for c, label in labels.items() if label}
    if not known:
        return text
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    token = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]++|[^A-Za-z0-9_]++"), F.lit(0))
    leads = "|".join(sorted({c[:3] for c in known}))  # most tokens are no code: only those are looked up that begin as one
    return F.when(text.rlike(rf"(?:{leads})"), F.array_join(F.transform(token, lambda t: F.when(t.rlike(rf"^(?:{leads})"), F.coalesce(F.try_element_at(table, t), t)).otherwise(t)), "")).otherwise(text)
