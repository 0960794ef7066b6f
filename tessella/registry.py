"""The queries of the observation side and their DuckDB SQL.

`query(sql)` registers a function (spark, sf_dir) -> DataFrame under its name. The
SQL names the views of `views.SQL`; those it uses are put in front of it as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .plans import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """sql with the views that it uses, and those that they use, as CTEs in order of need."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in views.SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({views.SQL[n]})" for n in needed)
    if not ctes:
        return sql
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].strip()}"
    return f"WITH {ctes}, {body[4:].strip()}" if re.match(r"with\b", body, re.I) else f"WITH {ctes} {body}"


def query(sql: str | None = None):
    def put(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put
