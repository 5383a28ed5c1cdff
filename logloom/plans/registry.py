"""Registry of the named queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the equal SQL where one exists."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """The parquet tables of one scale folder, read lazily so that pruning reaches the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def logs(self) -> DataFrame:
        from logloom.plans.logview import log_view
        return log_view(self.events)

    @property
    def wide_logs(self) -> DataFrame:
        """The log view over a spread scan, for work that is heavy per row."""
        from logloom.plans.logview import log_view
        return log_view(spread(self.events))

    @property
    def wide_pages(self) -> DataFrame:
        return spread(self.pages.select("page_id", "html"))

    @property
    def templates(self) -> DataFrame:
        from logloom.plans.logview import template_view
        return template_view(self.logs)

    @property
    def vectors(self) -> DataFrame:
        from logloom.plans.logview import vector_view
        return vector_view(self.embeddings)
