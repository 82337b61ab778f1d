"""Queries of the language-model problems and their SQL."""

from __future__ import annotations

from sluice.llm.langid import p9_documents, p9_found
from sluice.llm.leak import p7_found
from sluice.llm.mix import P8_BUDGETS_SQL, p8_budgets, p8_mix, p8_shares, p8_short

QUERIES = {"p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_short": p8_short, "p8_budgets": p8_budgets, "p9_found": p9_found, "p9_documents": p9_documents}

SQL: dict[str, str] = {"p8_budgets": P8_BUDGETS_SQL}
