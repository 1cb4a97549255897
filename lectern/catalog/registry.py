"""Registration of queries with their SQL."""

from __future__ import annotations

from lectern.catalog.sql import doubles


class Area:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def query(self, name: str, oracle: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = doubles(oracle)
            return fn

        return register
