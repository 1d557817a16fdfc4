"""Section text from stored payloads, as expressions over one row a symbol.

wide() turns payload rows into a column an endpoint; each section is then a Column.  A payload that is missing,
unavailable or not JSON counts as absent: its fields are null, and headings, defaults and tables stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions import finance as X
from filigrane.functions import text as T
from filigrane.operators import report, statements
from filigrane.sources.statements import comment_lines
from filigrane.sources.statements import number as typed

# fixed values: the headings inside the sections
ABOUT = "#### Corporate Overview"
SEGMENTS = "#### Revenue Drivers & Operating Divisions"
INITIATIVES = "#### Live Strategic Initiatives & Capex Pipeline"
CAPITAL = "- **Computed Capital Allocation & Liquidity Metrics (TTM)**:"
FOOTPRINT = "#### Enterprise Footprint & Market Standing"
PEERS = "- **Listed Peer Companies (Live)**:"
STRENGTHS = "#### Quantitative Strengths"
WATCH_POINTS = "#### Quantitative Watch-Points"
EVIDENCE = "#### Supporting Computed Metrics (TTM)"

ENDPOINTS = ("stock_summary", "stock_peers", "dupont", "solvency", "liquidity", "capital_efficiency")


def wide(stored: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """symbol, a payload column for each of ENDPOINTS, and web: the search text by symbol (symbol, web).

    Of several payloads of an endpoint the newest counts, by the column at of stored; without one, or at one time, the
    last in the order of texts.
    """
    ok = (F.col("status") == "ok") & F.col("payload").isNotNull()
    age = F.struct("at", "payload") if "at" in stored.columns else F.struct("payload")
    newest = lambda e: F.max(F.when(ok & (F.col("endpoint") == e), age))["payload"]
    rows = stored.groupBy("symbol").agg(*(newest(e).alias(e) for e in ENDPOINTS))
    return rows.join(web, "symbol", "left") if web is not None else rows.withColumn("web", F.lit(None).cast("string"))


def said(payload: str, path: str) -> Column:
    """A field as text; null if it is absent or empty."""
    return F.nullif(F.get_json_object(payload, path), F.lit(""))


def number(payload: str, path: str) -> Column:
    """A field that is a JSON number; text and booleans are null."""
    return typed(F.try_variant_get(F.try_parse_json(payload), path, "variant"))


def _comments(*payloads: str, most: int) -> Column:
    every = F.flatten(F.array(*(F.coalesce(comment_lines(F.col(p), 1000), F.array().cast("array<string>")) for p in payloads)))
    return F.slice(F.array_distinct(every), 1, most)


def numbered_comments(*payloads: str, most: int, head: str) -> Column:
    lines = _comments(*payloads, most=most)
    return _block(lines, head, T.numbered(lines))


def _block(lines: Column, head: str, text: Column) -> Column:
    """A blank line, a heading and text, or nothing without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{head}\n"), text)).otherwise("")


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _absent(what: str) -> Column:
    return F.concat(F.lit(f"No live {what} available for "), F.upper("symbol"), F.lit("; see the filing passages below."))


def overview() -> Column:
    """Name, symbol, sector, industry and market value; the latter from the web text if the summary lacks it."""
    peers = "$.aboutAndPeers[0]"
    name = F.coalesce(said("stock_summary", f"{peers}.name"), said("stock_summary", "$.name"), F.upper("symbol"))
    about = F.coalesce(said("stock_summary", f"{peers}.description"), said("stock_summary", "$.description"), said("stock_summary", "$.company_brief"), _absent("profile"))
    value = F.coalesce(said("stock_summary", "$.marketCap"), T.money(F.col("web")), F.lit("N/A"))
    fields = (("Company Name", name), ("Symbol", F.upper("symbol")), ("Sector", F.coalesce(said("stock_summary", "$.sector"), F.lit("N/A"))), ("Industry", F.coalesce(said("stock_summary", "$.industry"), F.lit("N/A"))), ("Market Cap", value))
    table = [report.markdown_row(F.lit(label), v) for label, v in fields]
    return _lines(report.HEADINGS["company_overview"], "", ABOUT, about, "", "| Profile Field | Details |", "| :--- | :--- |", *table)


def operations() -> Column:
    text = F.concat_ws("\n\n", said("stock_summary", "$.aboutAndPeers[0].description"), F.nullif(F.col("web"), F.lit("")))
    return _lines(report.HEADINGS["company_operations"], "", SEGMENTS, F.coalesce(F.nullif(text, F.lit("")), _absent("business-segment data")))


def expansion() -> Column:
    lines = _comments("capital_efficiency", "liquidity", most=8)
    text = _lines(report.HEADINGS["expansion_plans"], "", INITIATIVES, F.coalesce(F.nullif(F.col("web"), F.lit("")), _absent("expansion headlines")))
    return F.concat(text, _block(lines, CAPITAL, T.bullets(lines, "  - ")))


def clients() -> Column:
    """Web text and up to six peers, other than the company itself; peers may be under `peers` or the payload itself."""
    kind = "ARRAY<STRUCT<name: STRING>>"
    listed = F.coalesce(F.when(F.ltrim("stock_peers").startswith("["), F.from_json("stock_peers", kind)), F.from_json("stock_peers", f"STRUCT<peers: {kind}>")["peers"], F.array().cast(kind.replace(": ", ":")))
    names = F.filter(F.transform(listed, lambda p: p["name"]), lambda n: (F.coalesce(n, F.lit("")) != "") & (F.upper(n) != F.upper("symbol")))
    names = F.slice(names, 1, 6)
    text = _lines(report.HEADINGS["clients_market"], "", FOOTPRINT, F.coalesce(F.nullif(F.col("web"), F.lit("")), _absent("market-footprint headlines")))
    return F.concat(text, _block(names, PEERS, T.bullets(names, "  - ")))


def dupont() -> Column:
    """The returns table: each part N/A unless its numbers are there; ROE may come from the factors' own check."""
    n = lambda path: number("dupont", path)
    show = lambda v, unit: F.coalesce(F.concat(T.plain(v), F.lit(unit)), F.lit("N/A"))
    raw, factor = "$.raw_variables.", "$.dupont_5_factor."
    rows = (
        ("Net Profit Margin", "PAT ÷ Revenue", show(X.percent(n(raw + "pat"), n(raw + "revenue")), "%")),
        ("Asset Turnover", "Revenue ÷ Total Assets", show(n(factor + "asset_turnover_x"), "x")),
        ("Financial Leverage", "Total Assets ÷ Net Worth", show(n(factor + "equity_multiplier_x"), "x")),
        ("Return on Equity (ROE)", "PAT ÷ Net Worth", show(F.coalesce(n(factor + "return_on_equity_roe_pct"), n(factor + "factor_check_roe_pct")), "%")),
        ("ROCE", "EBIT ÷ (Equity + Debt)", show(X.roce(n(raw + "ebit"), n(raw + "equity"), n(raw + "debt")), "%")),
    )
    table = [report.markdown_row(F.lit(a), F.lit(b), v) for a, b, v in rows]
    period = F.concat(F.lit("Period: "), F.coalesce(said("dupont", "$.period"), F.lit("TTM")))
    return _lines(report.HEADINGS["dupont_analysis"], "", period, "", "| Driver | Formula | Value |", "| :--- | :--- | :--- |", *table)


def thesis() -> Column:
    """Strengths, watch-points and up to ten lines of evidence; a flag that is absent is neither."""
    payload = {"solvency_ratios": "solvency", "liquidity_ratios": "liquidity", "capital_efficiency": "capital_efficiency"}

    def side(wanted: bool) -> Column:
        found = []
        for key, flag, yes, no in statements.FLAGS:
            v = F.get_json_object(payload[key], f"$.{key}.{flag}")
            true = v.isNotNull() & ~v.isin("false", "0", "0.0", "")
            found.append(F.when(true if wanted else v.isNotNull() & ~true, yes if wanted else no))
        return F.array_compact(F.array(*found))

    good, bad, lines = side(True), side(False), _comments("capital_efficiency", "liquidity", "solvency", most=10)
    text = _lines(
        report.HEADINGS["strengths_weaknesses"], "", STRENGTHS, F.coalesce(F.nullif(T.numbered(good), F.lit("")), F.lit("No strength could be computed.")), "",
        WATCH_POINTS, F.coalesce(F.nullif(T.numbered(bad), F.lit("")), F.lit("No computed ratio raises a flag.")),
    )
    return F.concat(text, _block(lines, EVIDENCE, T.bullets(lines)))


SECTIONS = {"company_overview": overview, "company_operations": operations, "expansion_plans": expansion, "clients_market": clients, "dupont_analysis": dupont, "strengths_weaknesses": thesis}
