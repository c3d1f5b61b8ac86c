"""How a jobs module registers its jobs."""

from __future__ import annotations

from collections.abc import Callable


class Jobs:
    """Collects jobs under their function names, each with SQL that gives the same rows, if there is any."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(job: Callable) -> Callable:
            self.queries[job.__name__] = job
            if sql:
                self.oracles[job.__name__] = sql
            return job

        return add
