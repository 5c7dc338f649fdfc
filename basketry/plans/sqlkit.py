"""Composition of the DuckDB oracle SQL from named common table expressions.

Each oracle query is ``WITH <the CTEs it needs, in dependency order> SELECT``.
CTE names end in ``_t`` so they never shadow the pre-registered views
(``orders``, ``part``, ``lineitem`` ...).
"""

from __future__ import annotations

import re


class CteBook:
    def __init__(self) -> None:
        self._sql: dict[str, str] = {}

    def add(self, name: str, sql: str) -> None:
        if name in self._sql:
            raise KeyError(f"duplicate CTE {name}")
        self._sql[name] = sql.strip()

    def _deps(self, sql: str) -> list[str]:
        words = set(re.findall(r"\b([a-z0-9_]+_t)\b", sql))
        return sorted(w for w in words if w in self._sql)

    def query(self, select: str) -> str:
        order: list[str] = []
        seen: set[str] = set()

        def visit(name: str, stack: tuple[str, ...]) -> None:
            if name in seen:
                return
            if name in stack:
                raise ValueError(f"CTE cycle through {name}")
            for dep in self._deps(self._sql[name]):
                visit(dep, stack + (name,))
            seen.add(name)
            order.append(name)

        for dep in self._deps(select):
            visit(dep, ())
        if not order:
            return select.strip()
        body = ",\n".join(f"{n} AS (\n{self._sql[n]}\n)" for n in order)
        return f"WITH {body}\n{select.strip()}"

