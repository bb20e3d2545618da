"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tellmark.llm import articles, chat, fill_middle, lines, mixing, near_copies, negatives, packing, private, quality, substrings, topk, warc

_MODULES = (articles, chat, fill_middle, lines, mixing, near_copies, negatives, packing, private, quality, substrings, topk, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
