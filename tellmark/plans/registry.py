"""Queries over the reference's operators, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellmark.plans import catalogue, game, holdings, readings, telemetry, ways

assert game and holdings and readings and telemetry and ways  # their import registers their queries

flagship = catalogue.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
