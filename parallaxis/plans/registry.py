"""The registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import recordings_on_events as events


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drop_rate_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(events.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(events.ORACLES)
