"""Named queries: one Spark plan and, where SQL can say it, one checking text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundplan.sources.tables import view, view_ctes

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """A set of named queries over a data folder."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, reads: str, sql: str | None = None, ctes: str = "", also: str = "") -> Callable:
        """Register a plan over views; the function gets one frame per view.

        ``sql`` is the checking query over the same views, ``ctes`` are extra
        common table expressions it needs and ``also`` views only they read.
        """
        views = reads.split()

        def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.plans[name] = lambda spark, folder: build(*[view(spark, folder, v) for v in views])
            if sql is not None:
                self.sql[name] = self._text(sql, ctes, [*views, *also.split()])
            return build

        return register

    def add_plan(self, name: str, plan: Plan, reads: str, sql: str) -> None:
        """Register a plan that opens the data folder itself, such as a stream."""
        self.plans[name] = plan
        self.sql[name] = self._text(sql, "", reads.split())

    @staticmethod
    def _text(sql: str, ctes: str, views: list[str]) -> str:
        head = view_ctes(*views).removeprefix("WITH RECURSIVE ").strip()
        parts = [p for p in (head, ctes.strip()) if p]
        return (f"WITH RECURSIVE {','.join(parts)}\n" if parts else "") + sql.strip()
