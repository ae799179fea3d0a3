"""Collects queries and oracles of one area."""

from __future__ import annotations

from cairn.plans.views import sql


class Area:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, *ctes: str):
        """Register a query under its function's name, with its oracle if it has one."""

        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = sql(oracle, *ctes)
            return f

        return add

    def also(self, name: str, of: str) -> None:
        """A second name of a query."""
        self.queries[name] = self.queries[of]
        if of in self.oracles:
            self.oracles[name] = self.oracles[of]
