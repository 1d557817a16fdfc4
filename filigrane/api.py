"""The façade: what a user of the report service calls."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.operators import fusion, report, retrieval, sections, statements, valuation
from filigrane.operators.prompts import PROMPTS, prompt
from filigrane.sources import filings, report_store, statements as payloads


class Engine:
    """Over listings (name, ticker), payload rows (symbol, endpoint, payload, status), search text (symbol, web) and filings.

    filed: filings of companies (symbol, source, section, content), whose passages sections and reports then hold.
    """

    def __init__(self, spark: SparkSession, listings: DataFrame | None = None, stored: DataFrame | None = None, web: DataFrame | None = None, filed: DataFrame | None = None):
        self.spark, self.listings, self.stored, self.web, self.filed = spark, listings, stored, web, filed

    def search(self, query: str) -> DataFrame:
        return report.ticker_search(self.listings, "name", query)

    def bundle(self, symbol: str) -> DataFrame:
        """symbol, key, value of the full bundle with the summary under info and the ticker; no row if both are unavailable."""
        own = self.stored.filter((F.upper("symbol") == symbol.upper()) & F.col("endpoint").isin("stock_summary", "full_financial_bundle") & (F.col("status") == "ok"))
        entries = F.coalesce(F.from_json("payload", "MAP<STRING, VARIANT>"), F.create_map().cast("map<string, variant>"))
        bundle = own.filter("endpoint = 'full_financial_bundle'").select(F.explode(F.transform_values(entries, lambda _, v: F.to_json(v))).alias("key", "value")).filter("key not in ('info', 'ticker')")
        info = own.filter("endpoint = 'stock_summary'").select(F.lit("info").alias("key"), F.col("payload").alias("value"))
        ticker = own.select(F.lit("ticker").alias("key"), F.lit(symbol.upper()).alias("value")).distinct()
        return bundle.unionByName(info).unionByName(ticker).select(F.lit(symbol.upper()).alias("symbol"), "key", "value")

    def context(self, section: str) -> DataFrame:
        """symbol, ordinal, endpoint, payload, status: what a section reads, payload by payload."""
        routes = report.routed(self.spark.createDataFrame([(section,)], "section string"), report.routing(self.spark))
        return self.stored.join(F.broadcast(routes), "endpoint").select("symbol", "ordinal", "endpoint", "payload", "status")

    def income(self, annual: bool = False) -> DataFrame:
        """symbol, table: the latest periods of every symbol."""
        own = self.stored.filter(F.col("endpoint") == ("annual_income" if annual else "quarterly_income"))
        rows = payloads.periods(own, "income").withColumns(
            {
                "revenue": payloads.either("incTrev", "qIncTrev") if annual else payloads.either("qIncTrev"),
                "ebit": payloads.either("incEbi", "incEbit") if annual else payloads.either("qIncEbi", "qIncEbit"),
                "pat": payloads.either("incNinc") if annual else payloads.either("qIncNinc"),
                "eps": payloads.either("incEps") if annual else payloads.either("qIncEps"),
            }
        )
        latest = statements.latest_first(rows, ["symbol"], "ordinal", "revenue")
        return report.income_table(latest, "symbol", "revenue", "ebit", "pat", "eps", "displayPeriod")

    def balance(self) -> DataFrame:
        rows = payloads.periods(self.stored.filter("endpoint = 'balance_sheet'"), "balancesheet").withColumnsRenamed({"balTeq": "equity", "balTdeb": "debt", "balCsti": "cash"})
        latest = statements.latest_first(rows, ["symbol"], "ordinal", "equity")
        return report.balance_table(statements.balance_health(latest), "symbol", "displayPeriod")

    def section(self, name: str) -> DataFrame:
        """symbol, markdown of a section (older names count too); an unknown one is the payloads of the full bundle."""
        name = report.ALIASES.get(name, name)
        if name in sections.SECTIONS:
            return sections.wide(self.stored, self.web).select("symbol", sections.SECTIONS[name]().alias("markdown"))
        head = report.HEADINGS.get(name, "### Section Financial Analysis")
        symbols = self.stored.select("symbol").distinct()
        if name == "financial_results":
            rows = symbols.join(self.income().withColumnRenamed("table", "q"), "symbol", "left").join(self.income(annual=True).withColumnRenamed("table", "a"), "symbol", "left")
            body = F.concat_ws("\n\n", report.whole_table("quarterly", F.col("q")), report.whole_table("annual", F.col("a")), F.lit(report.READING))
            return rows.select("symbol", F.concat(F.lit(head + "\n\n"), body).alias("markdown"))
        if name == "balance_sheet":
            rows = symbols.join(self.balance(), "symbol", "left").join(sections.wide(self.stored), "symbol", "left")
            lines = sections.numbered_comments("solvency", most=6, head=report.SOLVENCY_HEAD)
            return rows.select("symbol", F.concat(F.lit(head + "\n\n"), report.whole_table("balance", F.col("table")), lines).alias("markdown"))
        rows = self.context(name).withColumn("__t", F.when(F.col("status") == "ok", F.col("payload")).otherwise(F.col("status")))
        body = rows.groupBy("symbol").agg(report.ordered_text("ordinal", "__t", "\n\n").alias("body"))
        return body.select("symbol", F.concat(F.lit(head + "\n\n"), "body").alias("markdown"))

    def section_context(self, *names: str) -> DataFrame:
        """symbol, section, markdown of sections, each with the company's passages; an unknown section is searched by its name."""
        names = [report.ALIASES.get(n, n) for n in names]
        every = None
        for name in dict.fromkeys(names):
            one = self.section(name).select("symbol", F.lit(name).alias("section"), "markdown")
            every = one if every is None else every.unionByName(one)
        if self.filed is None:
            return every
        queries = {n: retrieval.FILING_QUERIES.get(n, n) for n in names}
        return retrieval.with_passages(every, retrieval.section_passages(self.filed, queries))

    def report(self, complete=None, answers: str | None = None) -> DataFrame:
        """symbol, report, is_accurate for all symbols at once: sections are rows, so they run in parallel. answers: where completions are kept."""
        ordinal, asked = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i, name in enumerate(report.SECTIONS):
            ordinal = F.when(F.col("section") == name, i).otherwise(ordinal)
            asked = F.when(F.col("section") == name, f"{report.TASK_MARKER}\n{prompt(name)}").otherwise(asked)
        every = self.section_context(*report.SECTIONS).withColumns({"ordinal": ordinal, "prompt": asked})
        answers = report.completed(every.withColumnRenamed("markdown", "context"), complete, answers)
        done = answers.select("symbol", "ordinal", T.strip_fences(F.col("answer")).alias("markdown"))
        return report.audited(report.assemble(done, F.concat(F.lit("# Financial Analyst Report: "), F.col("symbol")), "*end of report*"))

    def fingerprints(self) -> DataFrame:
        """symbol, fingerprint of all that a symbol's report is made from, the prompts included."""
        parts = {"stored": self.stored} | ({"web": self.web} if self.web is not None else {}) | ({"filed": self.filed.select("symbol", "source", "section", "content")} if self.filed is not None else {})
        return report_store.fingerprints(parts, hashlib.sha256(repr(sorted(PROMPTS.items())).encode()).hexdigest())

    def only(self, symbols: DataFrame) -> Engine:
        """The engine over a table of symbols (symbol)."""
        cut = lambda rows: rows if rows is None else rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        return Engine(self.spark, self.listings, cut(self.stored), cut(self.web), cut(self.filed))

    def refresh_reports(self, store: report_store.ReportStore, complete=None) -> int:
        """Make the reports whose input, or prompt, changed since they were stored; how many. Those of unchanged symbols aren't touched."""
        known = self.stored.select("symbol").distinct()  # filings of symbols that nothing is stored of have no report
        return store.refresh(self.fingerprints().join(known, "symbol", "left_semi"), lambda symbols: self.only(symbols).report(complete).select("symbol", "report"))

    def dcf_report(self, rows: DataFrame, terminal_growth: float) -> DataFrame:
        """symbol, report: the valuation of each row of dcf() as text. rows: grp (the symbol), fcf, shares, price."""
        return statements.dcf(rows, terminal_growth).select(F.col("grp").alias("symbol"), report.dcf_text(F.col("grp").cast("string"), terminal_growth).alias("report"))

    def stored_dcf(self, prices: DataFrame, terminal_growth: float) -> DataFrame:
        """dcf() of every symbol with a stored cash flow and a price. prices: symbol, shares, price."""
        flows = valuation.free_cash_flow(payloads.periods(self.stored.filter("endpoint = 'cash_flow'"), "cashflow"))
        return statements.dcf(flows.join(prices.select("symbol", "shares", "price"), "symbol").withColumnRenamed("symbol", "grp"), terminal_growth)

    def filings(self, path: str, query: str, k: int = 2) -> DataFrame:
        """The best parent chunks of a folder of filings for a query."""
        return fusion.hybrid(filings.scan_folder(self.spark, path).filter("status = 'ok'"), "source", "content", query, k)

    def dcf(self, rows: DataFrame, terminal_growth: float) -> DataFrame:
        return statements.dcf(rows, terminal_growth)
