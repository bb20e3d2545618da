"""Paths of labels: compression, common prefixes, and prefix trees as flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellmark.operators.runs import without_repeats


def label_paths(df: DataFrame, by: list[str], order: list[str], label: str, name: str = "path") -> DataFrame:
    """One row per ``by``: its labels in order, repeats in a row once."""
    row = F.struct(*order, F.col(label).alias("_label"))
    return without_repeats(df, by, order, label).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_label"]).alias(name)
    )


def collapse_returns(path: Column) -> Column:
    """A, B, A, B becomes the one step ``A<>B``: left to right, without overlap, at least back once (A, B, A)."""
    return fold_returns(path, "string", lambda x, y: x == y, lambda a, b: F.array(F.concat(a, F.lit("<>"), b)))


def fold_returns(path: Column, kind: str, same: Callable[[Column, Column], Column], written: Callable[[Column, Column], Column]) -> Column:
    """Runs that alternate between two neighbours, at least back once (A, B, A), as the steps ``written(A, B)``.

    Runs are found left to right and don't overlap; ``kind`` is the type of a
    step and ``same`` tells whether two are one place.
    """
    none, empty = F.lit(None).cast(kind), F.expr(f"CAST(array() AS array<{kind}>)")

    def made(out: Column, a: Column, b: Column, n: Column) -> Column:
        return F.struct(out.alias("out"), a.alias("a"), b.alias("b"), n.alias("n"))

    def flush(acc: Column) -> Column:
        a, b, n = acc["a"], acc["b"], acc["n"]
        return F.concat(acc["out"], F.when(n >= 3, written(a, b)).when(n == 2, F.array(a, b)).when(n == 1, F.array(a)).otherwise(empty))

    def step(acc: Column, x: Column) -> Column:
        expected = F.when(acc["n"] % 2 == 0, acc["a"]).otherwise(acc["b"])
        # two steps wait: if the third isn't a return, the first is settled and the second may begin one
        shifted = made(F.concat(acc["out"], F.array(acc["a"])), acc["b"], x, F.lit(2))
        fresh = made(flush(acc), x, none, F.lit(1))
        return (
            F.when(acc["n"] == 0, made(acc["out"], x, none, F.lit(1)))
            .when(acc["n"] == 1, made(acc["out"], acc["a"], x, F.lit(2)))
            .when(same(x, expected), made(acc["out"], acc["a"], acc["b"], acc["n"] + 1))
            .when(acc["n"] == 2, shifted)
            .otherwise(fresh)
        )

    return F.aggregate(path, made(empty, none, none, F.lit(0)), step, flush)


def from_first(path: Column, keep: Column) -> Column:
    """The path from its first label among ``keep`` on; empty if there is none."""
    hit = F.transform(path, lambda x: F.array_contains(keep, x))
    at = F.array_position(hit, True)
    return F.when(at > 0, F.slice(path, at, F.size(path))).otherwise(F.slice(path, 1, 0))


def prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every prefix of every path as ``prefix`` with its ``depth``."""
    return paths.where(F.size(path) > 0).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(path)))).withColumn(
        "prefix", F.slice(path, 1, F.col("depth"))
    )


def prefix_patterns(paths: DataFrame, group: list[str], unit: str, who: str, least_who: int, least_units: int) -> DataFrame:
    """Prefixes that at least ``least_who`` walkers share within a unit, in at least ``least_units`` units of a group."""
    per_unit = prefixes(paths).groupBy(*group, unit, "prefix").agg(F.countDistinct(who).alias("walkers")).where(F.col("walkers") >= least_who)
    return per_unit.groupBy(*group, "prefix").agg(F.count("*").alias("units"), F.max("walkers").alias("most")).where(F.col("units") >= least_units)


def without_subsumed(patterns: DataFrame, group: list[str], prefix: str, units: str) -> DataFrame:
    """Drop a pattern that a longer one extends if its units are among the longer one's.

    A longer pattern goes to each of its proper prefixes, so that patterns meet only those they begin.
    """
    names = {c: f"_l_{c}" for c in [*group, units]}
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.size(prefix) - 1), lambda n: F.slice(prefix, 1, n))).alias("_begin")
    longer = patterns.where(F.size(prefix) > 1).select(*(F.col(c).alias(n) for c, n in names.items()), begins)
    on = [F.col(c).eqNullSafe(F.col(names[c])) for c in group]
    on += [F.col("_begin") == F.col(prefix), F.size(F.array_except(units, names[units])) == 0]
    return patterns.join(longer, on, "left_anti")


def prefix_tree(paths: DataFrame, unit: list[str], who: str) -> DataFrame:
    """The tree of a unit's paths as rows: node and parent (prefixes), depth, walkers, and stayers whose path ends there."""
    nodes = prefixes(paths)
    ends = F.size("path") == F.col("depth")
    return nodes.groupBy(*unit, "prefix", "depth").agg(
        F.array_sort(F.collect_set(who)).alias("walkers"), F.array_sort(F.collect_set(F.when(ends, F.col(who)))).alias("stayers")
    ).withColumn("parent", F.slice("prefix", F.lit(1), F.col("depth") - 1))
