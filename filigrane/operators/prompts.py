"""Prompt templates by section, in this library's own words."""

from __future__ import annotations

from filigrane.operators.report import HEADINGS

_TASKS = {
    "company_overview": "Introduce the company: name, ticker, sector, industry, market capitalization and standing. End with a table of these fields.",
    "company_operations": "Describe the business segments and what drives the revenue of each.",
    "expansion_plans": "List announced projects, capacity and capital spending, with amounts and dates where they are given.",
    "clients_market": "Describe customers, contracts, competitive position and listed peers.",
    "financial_results": "Show quarterly and yearly results, latest first, with growth, and explain the trend in a sentence each.",
    "dupont_analysis": "Break the return on equity into margin, turnover and leverage, and state the return on capital employed.",
    "balance_sheet": "Show equity, debt, cash and debt to equity by period, and judge solvency.",
    "strengths_weaknesses": "Weigh computed strengths against watch-points and cite the figures behind each.",
}
PROMPTS = {k: f"{HEADINGS[k]}\n\n{task}\nUse only figures of the context, write N/A for what it lacks, and never print raw field codes." for k, task in _TASKS.items()} | {
    "critique": "Compare the section with its context. Answer with JSON: is_accurate (boolean) and issues (a list of texts).\n\nSection:\n{section}\n\nContext:\n{context}"
}


def prompt(kind: str, **fields: str) -> str:
    """A template, filled in if fields are given. ValueError for an unknown kind."""
    if kind not in PROMPTS:
        raise ValueError(f"no prompt {kind!r}; there are {', '.join(PROMPTS)}")
    return PROMPTS[kind].format(**fields) if fields else PROMPTS[kind]
