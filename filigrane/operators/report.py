"""Routing, section text, the language model's place, assembly and audit of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.operators import asking

# fixed values: which endpoints a section reads, in order, and the older names of sections
ROUTES = {
    "dupont_analysis": ("dupont", "cagr"),
    "balance_sheet": ("solvency", "balancesheet_growth", "balance_sheet"),
    "financial_results": ("quarterly_income", "quarterly_growth", "annual_income", "annual_growth"),
    "company_overview": ("stock_summary", "stock_peers"),
    "company_operations": ("stock_summary", "stock_peers"),
    "clients_market": ("stock_summary", "stock_peers"),
    "expansion_plans": ("capital_efficiency", "liquidity"),
    "strengths_weaknesses": ("capital_efficiency", "liquidity", "solvency"),
}
ALIASES = {
    "solvency_analysis": "balance_sheet",
    "financial_performance": "financial_results",
    "core_business": "company_operations",
    "market_footprint": "clients_market",
    "executive_summary": "company_overview",
    "investment_thesis": "expansion_plans",
}
DEFAULT_ROUTE = ("full_financial_bundle",)
WEB_SECTIONS = ("company_overview", "company_operations", "expansion_plans", "clients_market")
SECTIONS = ("company_overview", "company_operations", "expansion_plans", "clients_market", "financial_results", "dupont_analysis", "balance_sheet", "strengths_weaknesses")
AUDIT_MARKERS = ("DuPont Return Decomposition", "Financial Performance & Growth Metrics", "Simple Summary for Investors")
TASK_MARKER = "=== TASK INSTRUCTIONS ==="
CONTEXT_MARKER = "=== CONTEXT ==="
NO_CONTEXT = "### Section Financial Analysis\nNo data was available for this section."
RULE = "\n\n---\n\n"


def routing(spark: SparkSession) -> DataFrame:
    """section, ordinal, endpoint: a small fixed table."""
    every = ROUTES | {a: ROUTES[s] for a, s in ALIASES.items()}
    return spark.createDataFrame([(s, i, e) for s, own in every.items() for i, e in enumerate(own)], "section string, ordinal int, endpoint string")


def routed(sections: DataFrame, routes: DataFrame) -> DataFrame:
    """sections (section, ...) with ordinal, endpoint, web; one that no route names reads the full bundle."""
    hit = sections.join(F.broadcast(routes), "section", "left")
    return hit.select(*sections.columns, F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.coalesce("endpoint", F.lit(DEFAULT_ROUTE[0])).alias("endpoint"), F.col("section").isin(*WEB_SECTIONS).alias("web"))


def pass_through(context: Column, prompt: Column) -> Column:
    """What stands in for a model: the context without markers and task; a stock sentence if nothing is left."""
    both = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"), prompt)).otherwise(prompt)
    kept = F.replace(F.substring_index(both, TASK_MARKER, 1), F.lit(CONTEXT_MARKER), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), F.lit("")), F.lit(NO_CONTEXT))


#: Environment variables that a provider of completions needs.
PROVIDER_KEYS = {"groq": ("GROQ_API_KEY",), "gemini": ("GEMINI_API_KEY",)}


def missing_settings(provider: str, environment: dict[str, str]) -> list[str]:
    """The variables that a provider needs and the environment lacks."""
    return [k for k in PROVIDER_KEYS.get(provider.lower(), ()) if not environment.get(k)]


def chain(*providers: tuple[Callable[[str, str], str], float]) -> Callable[[str, str], str]:
    """One completion function of several, each with its time limit in seconds: the first that answers in time with text.

    It raises if none does, which completed() turns into the passed-through context.
    """

    def complete(context: str, prompt: str) -> str:
        from concurrent.futures import ThreadPoolExecutor

        failed: Exception | None = None
        for ask, limit in providers:
            pool = ThreadPoolExecutor(1)
            try:
                said = pool.submit(ask, context, prompt).result(limit)
                if said and said.strip():
                    return said.strip()
            except Exception as e:  # an outside service: the next one is asked
                failed = e
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        raise RuntimeError("no provider answered") from failed

    return complete


def completed(rows: DataFrame, complete: Callable[[str, str], str] | None = None, store: str | None = None, version: str = "") -> DataFrame:
    """rows (context, prompt, ...) with column answer; a failure passes the context through.

    complete runs in Arrow batches, a few calls at a time.  With a store, a path that all executors share, answers are
    kept there under a hash of version, context and prompt, and what was answered once is never asked again, in this
    run or another.
    """
    passed = pass_through(F.col("context"), F.col("prompt"))
    if complete is None:
        return rows.withColumn("answer", passed)
    if store is not None:
        return asking.answered(rows, ["context", "prompt"], complete, store, version).withColumn("answer", F.coalesce("answer", passed))
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def ask(context, prompt):
        import pandas as pd

        told = asking.ask_all([(str(i), q) for i, q in enumerate(zip(context, prompt, strict=True))], complete, None)
        return pd.Series([told.get(str(i)) for i in range(len(context))], dtype=object)

    return rows.withColumn("answer", F.coalesce(ask("context", "prompt"), passed))


# fixed values: headings of the sections
HEADINGS = {
    "company_overview": "### Executive Summary & Corporate Profile",
    "company_operations": "### Core Business Segments & Revenue Engine",
    "expansion_plans": "### Strategic Expansion & Capital Allocation Pipeline",
    "clients_market": "### Competitive Moat, Concessions & Market Footprint",
    "financial_results": "### Financial Performance & Growth Metrics",
    "dupont_analysis": "### DuPont Return Decomposition (ROE & ROCE Analysis)",
    "balance_sheet": "### Capital Structure & Solvency Analysis",
    "strengths_weaknesses": "### Investment Thesis & Strategic Risk Audit",
}
# fixed values: titles and header rows of the statement tables
TABLES = {
    "quarterly": ("#### Latest Quarterly Financial Results Table (in ₹ Cr)", "| Quarter Period | Total Sales / Revenue | Operating Profit | Net Profit (PAT) | EPS (₹) | Quarterly Sales Trend |"),
    "annual": ("#### Latest Annual Financial Results Table (in ₹ Cr)", "| Fiscal Year | Total Sales / Revenue | Operating Profit | Net Profit (PAT) | EPS (₹) | Yearly Sales Growth |"),
    "balance": ("#### Balance Sheet Capital Structure (in ₹ Cr)", "| Fiscal Period | Company Net Worth (Equity) | Total Loans (Debt) | Cash & Short-Term Investments | Debt-to-Equity | Financial Health |"),
}
SOLVENCY_HEAD = "💡 **Computed Solvency Metrics (TTM)**:"
READING = "Newest periods first. Operating profit is before interest and tax; net profit is what shareholders earn, with EPS per share."
MISSING_ROW = "| Data unavailable from live API | — | — | — | — | — |"


def whole_table(kind: str, rows: Column) -> Column:
    """A titled Markdown table of ready rows; a row that says so if there are none."""
    title, head = TABLES[kind]
    return F.concat(F.lit(f"{title}\n{head}\n{'| :--- ' * head.count(' | ')}| :--- |\n"), F.coalesce(rows, F.lit(MISSING_ROW)))


def ordered_text(order: str, text: str, separator: str) -> Column:
    """An aggregate: texts in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def income_table(latest: DataFrame, by: str, revenue: str, ebit: str, pat: str, eps: str, period: str) -> DataFrame:
    """by, table: a Markdown row for each of the (at most 8) latest periods, newest first."""
    row = markdown_row(F.col(period), T.rupees(F.col(revenue)), T.rupees(F.col(ebit)), T.rupees(F.col(pat)), F.coalesce(F.concat(F.lit("₹"), T.plain(F.col(eps))), F.lit("N/A")), F.col("trend"))
    return latest.withColumn("__row", row).groupBy(by).agg(ordered_text("position", "__row", "\n").alias("table"))


def balance_table(latest: DataFrame, by: str, period: str) -> DataFrame:
    row = markdown_row(F.col(period), T.rupees(F.col("equity")), T.rupees(F.col("debt")), T.rupees(F.col("cash")), F.col("de_text"), F.col("health"))
    return latest.withColumn("__row", row).groupBy(by).agg(ordered_text("position", "__row", "\n").alias("table"))


def peers(rows: DataFrame, symbol: str, by: str, order: str, name: str, most: int = 6) -> DataFrame:
    """The first so many names in order that are not empty and not the symbol itself."""
    from pyspark.sql import Window

    kept = rows.filter((F.coalesce(F.col(name), F.lit("")) != "") & (F.upper(name) != F.upper(F.lit(symbol))))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("ordinal") <= most)


def assemble(sections: DataFrame, title: Column, footer: str) -> DataFrame:
    """symbol, report: title, sections in order, each with a rule after it, then the footer.

    sections: symbol, ordinal, markdown. A report is a bounded number of sections.
    """
    body = sections.groupBy("symbol").agg(ordered_text("ordinal", "markdown", RULE).alias("body"))
    return body.select("symbol", F.concat(title, F.lit("\n\n"), F.col("body"), F.lit(RULE + footer + "\n")).alias("report"))


def dcf_text(symbol: Column, terminal_growth: float) -> Column:
    """A valuation report over the columns of statements.dcf; a figure that can't be computed is N/A."""
    row = lambda label, c: markdown_row(F.lit(label), T.rupees(F.col(c)))
    upside = F.coalesce(F.concat(T.plain(F.col("upside_pct")), F.lit("%")), F.lit("N/A"))
    return F.concat_ws(
        "\n", F.concat(F.lit("# Discounted Cash Flow: "), F.upper(symbol)), F.lit(""), F.lit(f"Terminal growth: {terminal_growth * 100:.2f}%"), F.lit(""), F.lit("| Figure | Value |"), F.lit("| :--- | :--- |"),
        row("Present value of cash flows", "pv_fcf"), row("Present value of the terminal value", "pv_terminal"), row("Intrinsic value", "intrinsic"), row("Price with a 20% margin of safety", "price_mos20"),
        row("Price with a 30% margin of safety", "price_mos30"), markdown_row(F.lit("Upside to the price"), upside),
    )


def audited(reports: DataFrame) -> DataFrame:
    """reports with is_accurate: all markers are there."""
    ok = F.lit(True)
    for m in AUDIT_MARKERS:
        ok = ok & F.col("report").contains(m)
    return reports.withColumn("is_accurate", ok)


def merged(left: Column, right: Column) -> Column:
    """Two maps; the right one's values win."""
    keep = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)


def ticker_search(listings: DataFrame, name: str, query: str) -> DataFrame:
    """Listings whose name holds the query, whatever the case; a trimmed query under 3 characters finds none."""
    q = query.strip()
    return listings.filter(F.lit(len(q) >= 3) & F.contains(F.lower(name), F.lit(q.lower())))
