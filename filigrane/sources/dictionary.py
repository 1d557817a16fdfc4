"""The metric dictionary: statement codes and their labels."""

from pyspark.sql import DataFrame, SparkSession

# fixed values: codes of the statement payloads and their labels
METRICS = {
    "interim": {
        "qIncTrev": "Total Revenue",
        "qIncOper": "Operating & Other Expenses",
        "qIncEbit": "EBIT",
        "qIncDep": "Depreciation",
        "qIncPbi": "PBIT (Profit Before Interest and Tax)",
        "qIncIoi": "Interest & Other Items",
        "qIncPbt": "PBT (Profit Before Tax)",
        "qIncToi": "Tax on Income",
        "qIncNinc": "Net Income",
        "qIncEps": "Earnings Per Share",
        "qIncDps": "Dividends Per Share",
        "qIncPyr": "Payout Ratio",
    },
    "annual": {
        "qIncTrev": "Total Revenue",
        "incRaw": "Cost of Goods Sold",
        "incPfc": "Power & Fuel Cost",
        "incEpc": "Employee Cost",
        "incSga": "Selling, General & Administrative Expenses",
        "incOpe": "Other Operating Expenses",
        "incEbit": "EBIT",
        "incDep": "Depreciation",
        "incPbi": "PBIT (Profit Before Interest and Tax)",
        "incIoi": "Interest & Other Items",
        "incPbt": "PBT (Profit Before Tax)",
        "incToi": "Tax on Income",
        "incNinc": "Net Income",
        "incEps": "Earnings Per Share",
        "incDps": "Dividends Per Share",
        "incPyr": "Payout Ratio",
    },
    "balancesheet": {
        "balCsti": "Cash & Short Term Investments",
        "balTrec": "Total Receivables",
        "balTinv": "Total Inventories",
        "balOca": "Other Current Assets",
        "balTca": "Total Current Assets",
        "balNetl": "Loans & Advances",
        "balNppe": "Net Property, Plant & Equipment",
        "balGint": "Goodwill & Intangible Assets",
        "balLti": "Long Term Investments",
        "balOtha": "Other Assets",
        "balTota": "Total Assets",
        "balAccp": "Accounts Payable",
        "balTdep": "Total Deposits",
        "balOcl": "Other Current Liabilities",
        "balTcl": "Total Current Liabilities",
        "balTltd": "Total Long Term Debt",
        "balTdeb": "Total Debt",
        "balDit": "Deferred Tax Liabilities (Net)",
        "balMint": "Minority Interest",
        "balOthl": "Other Liabilities",
        "balTotl": "Total Liabilities",
        "balComs": "Common Stock",
        "balApic": "Additional Paid In Capital",
        "balRtne": "Reserves & Surplus",
        "balOeq": "Other Equity",
        "balTeq": "Total Equity",
        "balTlse": "Total Liabilities & Shareholders' Equity",
        "balTcso": "Total Common Shares Outstanding",
        "balTpso": "Total Preferred Shares Outstanding",
        "balNca": "Net Current Assets",
        "balCa": "Current Assets",
        "balNcl": "Net Current Liabilities",
        "balDta": "Deferred Tax Assets",
    },
    "cashflow": {
        "cafCiwc": "Changes in Working Capital",
        "cafCfoa": "Cash Flow from Operations",
        "cafCexp": "Capital Expenditures",
        "cafCfia": "Cash Flow from Investing Activities",
        "cafTcdp": "Total Cash Dividends Paid",
        "cafCffa": "Cash Flow from Financing Activities",
        "cafFee": "",
        "cafNcic": "Net Change in Cash",
        "cafFcf": "Free Cash Flow",
    },
}


def rows() -> list[tuple[str, int, str, str]]:
    return [(statement, i, code, label) for statement, own in METRICS.items() for i, (code, label) in enumerate(own.items())]


def metric_dictionary(spark: SparkSession) -> DataFrame:
    """statement, ordinal, code, label: 70 rows, so any join to it may broadcast it."""
    return spark.createDataFrame(rows(), "statement string, ordinal int, code string, label string")


def labels() -> dict[str, str]:
    """The label of each code; a code of several statements has that of the first."""
    out: dict[str, str] = {}
    for _, _, code, label in rows():
        out.setdefault(code, label)
    return out
