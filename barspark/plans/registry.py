"""All queries of the package and their SQL twins."""

from __future__ import annotations

from barspark.plans import bar_queries, ledger_queries, research_queries, signal_queries, trade_queries

MODULES = (bar_queries, signal_queries, trade_queries, research_queries, ledger_queries)


def queries() -> dict:
    out = {"flagship_breakout": signal_queries.flagship}
    for m in MODULES:
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = {"flagship_breakout": signal_queries.FLAGSHIP_SQL}
    for m in MODULES:
        out |= m.oracle_sql()
    return out
