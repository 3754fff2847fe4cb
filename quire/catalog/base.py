"""Registration of queries with their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.views import load as table  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def per_session(fn):
    """Build a derived table once per session and data folder. ``built`` gives the table if it is there already."""
    tables: dict = {}

    def key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
        return spark.sparkContext.applicationId, sf_dir

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if key(spark, sf_dir) not in tables:
            tables[key(spark, sf_dir)] = fn(spark, sf_dir)
        return tables[key(spark, sf_dir)]
    run.built = lambda spark, sf_dir: tables.get(key(spark, sf_dir))
    return run
