"""Statement operators: growth, latest-first tables, balance-sheet health, ratio families, flags and DCF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions import finance as X
from filigrane.functions import text as T

SHOWN_PERIODS = 8
# fixed values: the flag checks, as payload, flag, strength and watch-point
FLAGS = (
    ("solvency_ratios", "is_debt_safe", "Balance-sheet leverage is within safe limits", "Elevated debt levels warrant monitoring"),
    ("liquidity_ratios", "is_liquidity_healthy", "Working-capital liquidity is healthy", "Working-capital liquidity is stretched"),
    ("capital_efficiency", "is_earnings_high_quality", "Reported earnings convert strongly into free cash flow", "Weak earnings-to-cash conversion"),
)


def with_growth(periods: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """growth_pct (null without a period before that is above 0) and its label."""
    pct = X.growth_pct(F.col(value), Window.partitionBy(*by).orderBy(order))
    return periods.withColumn("growth_pct", pct).withColumn("trend", T.trend(F.col("growth_pct")))


def latest_first(periods: DataFrame, by: list[str], order: str, value: str, most: int = SHOWN_PERIODS) -> DataFrame:
    """The last so many periods, newest first as position 1; growth sees the period past the cut."""
    grown = with_growth(periods, by, order, value)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return grown.withColumn("position", position).filter(F.col("position") <= most)


def balance_health(rows: DataFrame, equity: str = "equity", debt: str = "debt") -> DataFrame:
    """debt_to_equity, its text, the health label, and whether equity is negative (which the label calls healthy)."""
    de = X.debt_to_equity(F.col(debt), F.col(equity))
    return rows.withColumns(
        {"debt_to_equity": de, "de_text": F.coalesce(F.concat(T.plain(de), F.lit("x")), F.lit("N/A")), "health": X.health(F.col(debt), F.col(equity)), "equity_negative": F.col(equity) < 0}
    )


def dupont(rows: DataFrame) -> DataFrame:
    """Three and five factors and ROCE from pat, pbt, ebit, revenue, assets, equity, debt."""
    c = F.col
    return rows.withColumns(
        {
            "net_margin_pct": X.percent(c("pat"), c("revenue")), "asset_turnover": X.ratio(c("revenue"), c("assets")), "equity_multiplier": X.ratio(c("assets"), c("equity")),
            "tax_burden": X.ratio(c("pat"), c("pbt")), "interest_burden": X.ratio(c("pbt"), c("ebit")), "operating_margin": X.ratio(c("ebit"), c("revenue")),
            "roe_pct": X.percent(c("pat"), c("equity")), "roce_pct": X.roce(c("ebit"), c("equity"), c("debt")),
        }
    )


def solvency(rows: DataFrame) -> DataFrame:
    c = F.col
    net = c("debt") - c("cash")
    return rows.withColumns({"interest_coverage": X.ratio(c("ebit"), c("interest")), "net_debt": net, "net_debt_to_ebitda": X.ratio(net, c("ebitda")), "debt_to_equity": X.ratio(c("debt"), c("equity")), "is_debt_safe": X.ratio(c("debt"), c("equity")) < 1})


def liquidity(rows: DataFrame) -> DataFrame:
    c = F.col
    current = X.ratio(c("current_assets"), c("current_liabilities"))
    return rows.withColumns(
        {"current_ratio": current, "quick_ratio": X.ratio(c("current_assets") - c("inventory"), c("current_liabilities")), "dso": X.ratio(365 * c("receivables"), c("revenue")), "dio": X.ratio(365 * c("inventory"), c("cogs")), "is_liquidity_healthy": current >= 1}
    )


def capital_efficiency(rows: DataFrame, tax_rate: float = 0.25) -> DataFrame:
    c = F.col
    conversion = X.ratio(c("fcf"), c("pat"))
    return rows.withColumns({"roic_pct": X.percent(c("ebit") * (1 - tax_rate), c("equity") + c("debt") - c("cash")), "fcf_conversion": conversion, "fixed_asset_turnover": X.ratio(c("revenue"), c("net_ppe")), "is_earnings_high_quality": conversion >= 0.8})


def cagr(periods: DataFrame, by: list[str], order: str, values: list[str], years: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Of each value, growth a year over so many years up to each period."""
    w = Window.partitionBy(*by).orderBy(order)
    return periods.withColumns({f"{v}_cagr{n}": X.cagr(F.lag(v, n).over(w), F.col(v), n) for v in values for n in years})


def strengths_and_watch_points(flags: DataFrame) -> DataFrame:
    """A row a group: numbered strengths and watch-points. flags: grp and a boolean column for each flag; null is neither."""
    def side(when: bool) -> Column:
        texts = F.array(*(F.when(F.col(f) if when else ~F.col(f), yes if when else no) for _, f, yes, no in FLAGS))
        return T.numbered(F.array_compact(texts))

    return flags.select("grp", side(True).alias("strengths"), side(False).alias("watch_points"))


def dcf(rows: DataFrame, terminal_growth: float | Column, growth: tuple[float, float] = (0.06, 0.05), wacc: float | Column = 0.13, margins: tuple[float, float] = (0.2, 0.3)) -> DataFrame:
    """Ten years of free cash flow, five at each growth, a terminal value, and prices with a margin of safety.

    rows: grp, fcf, shares, price.  terminal_growth and wacc are numbers or columns of rows, so that one pass
    values many scenarios.  An error if terminal growth is not below the discount rate.
    """
    if not isinstance(terminal_growth, Column) and not isinstance(wacc, Column) and terminal_growth >= wacc:
        raise ValueError("terminal growth must be below the discount rate")
    terminal, rate = (x if isinstance(x, Column) else F.lit(x) for x in (terminal_growth, wacc))
    spread = F.when(terminal < rate, rate - terminal).otherwise(F.raise_error(F.lit("terminal growth must be below the discount rate")).cast("double"))

    def flow(y: Column) -> Column:
        return F.col("fcf") * F.pow(F.lit(1 + growth[0]), F.least(y, F.lit(5))) * F.pow(F.lit(1 + growth[1]), F.greatest(y - 5, F.lit(0)))

    years = F.sequence(F.lit(1), F.lit(10))
    present = F.aggregate(F.transform(years, lambda y: flow(y) / F.pow(1 + rate, y)), F.lit(0.0), lambda s, x: s + x)
    last = flow(F.lit(10)) * (1 + terminal) / spread / F.pow(1 + rate, F.lit(10))
    out = rows.withColumns({"pv_fcf": present, "pv_terminal": last}).withColumn("intrinsic", F.col("pv_fcf") + F.col("pv_terminal"))
    for m in margins:
        out = out.withColumn(f"price_mos{round(m * 100)}", X.ratio(F.col("intrinsic") * (1 - m), F.col("shares")))
    return out.withColumn("upside_pct", X.percent(F.col(f"price_mos{round(margins[0] * 100)}") - F.col("price"), F.col("price")))
