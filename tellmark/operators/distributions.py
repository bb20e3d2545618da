"""Counted evidence: histograms of counts with their denominators, zero-filled scaffolds, samples, modes, order statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.session import cut


def count_of_counts(counts: DataFrame, by: list[str], count: str, also: dict[str, Column] | None = None) -> DataFrame:
    """How many units have each count, per ``by``, with further aggregates of ``also``."""
    more = [c.alias(name) for name, c in (also or {}).items()]
    return counts.groupBy(*by, count).agg(F.count("*").alias("n"), *more)


def counts_with_matches(counts: DataFrame, by: list[str], count: str, match: str, newest: Column) -> DataFrame:
    """How many units have each count per ``by``, of how many matches, and whether the newest match is among them (unknown: no)."""
    recent = F.coalesce(F.bool_or(F.col(match).eqNullSafe(newest) & newest.isNotNull()), F.lit(False))
    return count_of_counts(counts, by, count, {"matches": F.countDistinct(match), "in_newest": recent})


def zero_filled(units: DataFrame, labels: DataFrame, seen: DataFrame, by: list[str], unit: list[str], label: list[str], count: str) -> DataFrame:
    """Every (unit, label) of one ``by`` group with its count, 0 where nothing was seen.

    Units and labels meet through ``by`` only; keys compare null-safe, as an
    unknown label is a label.
    """
    grid = units.join(labels, by) if by else units.crossJoin(labels)
    keys = [*by, *unit, *label]
    names = {c: f"_s_{c}" for c in keys}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = grid.join(seen.withColumnsRenamed(names), on, "left")
    return joined.select(*keys, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def presence_distribution(samples: DataFrame, by: list[str], unit: list[str], label: str, alive: Column, who: str) -> DataFrame:
    """Per ``by`` and label: players, n units with so many, m units of the ``by`` group.

    A unit counts for the denominator as soon as it has a row, alive or not;
    every pair of unit and label counts, so the n of a label sum to m.
    """
    units = samples.select(*by, *unit).distinct()
    live = samples.where(alive)
    labels = live.select(*by, label).distinct()
    seen = live.groupBy(*by, *unit, label).agg(F.countDistinct(who).alias("players"))
    full = zero_filled(units, labels, seen, by, unit, [label], "players")
    m = Window.partitionBy(*by, label)
    return full.groupBy(*by, label, "players").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(m))


def bucket_counts(df: DataFrame, by: list[str], bucket: Column, buckets: list[str], distinct: list[str]) -> DataFrame:
    """Distinct values of each column per bucket, one column ``<column>_<bucket>`` each, in one aggregation."""
    each = [F.countDistinct(F.when(bucket == b, F.col(c))).alias(f"{c}_{b}") for c in distinct for b in buckets]
    return df.groupBy(*by).agg(*each) if by else df.agg(*each)


def most_frequent(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent non-null value per ``by``, ties to the smallest."""
    each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def null_dominant_max(value: str) -> Column:
    """The maximum, but null as soon as one value is null."""
    return F.when(F.count_if(F.col(value).isNull()) == 0, F.max(value))


def consensus(value: str) -> Column:
    """The value that all rows agree on, nulls counting as a value of their own; else null."""
    return F.when((F.countDistinct(value) == 1) & (F.count_if(F.col(value).isNull()) == 0), F.min(value))


def order_statistic(value: str, share: float) -> Column:
    """The value at place int(n * share) of the sorted values, at most the last; counted by distinct value, without an array of all."""
    place = min(share + 1e-12, 1.0)  # the discrete percentile of a share is the place before the next whole one
    return F.expr(f"percentile_disc({place!r}D) WITHIN GROUP (ORDER BY `{value}`)")


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at place round(q * (n - 1)), half to even, of the sorted non-null values, by ranks instead of arrays."""
    some = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    ranked = some.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.bround((F.col("_n") - 1) * F.lit(q), 0).cast("int")).select(*by, F.col(value).alias(name))


def top_with_ties(df: DataFrame, by: list[str], measure: str, k: int) -> DataFrame:
    """Rows whose measure is among the k largest of their group, equal ones all kept; k below 1 keeps everything."""
    if k < 1:
        return df
    w = Window.partitionBy(*by).orderBy(F.col(measure).desc())
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k).drop("_rank")


def top_groups(df: DataFrame, by: list[str], group: list[str], measure: str, k: int) -> DataFrame:
    """All rows of the k groups with the largest measure in each ``by`` (ties between groups by name)."""
    tops = df.groupBy(*by, *group).agg(F.max(measure).alias("_top"))
    w = Window.partitionBy(*by).orderBy(F.col("_top").desc(), *group)
    kept = tops.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).select(*by, *group)
    return df.join(kept, [*by, *group], "left_semi")


def capped(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, Column]:
    """The first n rows, and an aggregate that tells how many are left out."""
    return df.orderBy(*order).limit(n), F.greatest(F.count("*") - n, F.lit(0)).alias("left_out")


def latest_owner(df: DataFrame, item: str, owner: str, at: str) -> DataFrame:
    """Each item's owner by the latest sighting; several owners at that time share it (owner null, owners counted)."""
    last = df.groupBy(item, owner).agg(F.max(at).alias("_t"))
    w = Window.partitionBy(item)
    top = last.withColumn("_m", F.max("_t").over(w)).where(F.col("_t").eqNullSafe(F.col("_m")))
    return top.groupBy(item).agg(F.count("*").alias("owners"), F.when(F.count("*") == 1, F.min(owner)).alias(owner))


def biggest_pair(df: DataFrame, by: list[str], part: str, member: str) -> DataFrame:
    """The one or two parts that cover most members of each group.

    One part before two on equal cover, then larger sets first, then names: the
    parts are ranked by (size, name) and pairs compared in that order.
    """
    members = df.where(F.col(member).isNotNull()).select(*by, part, member).distinct()
    sizes = members.groupBy(*by, part).agg(F.count("*").cast("int").alias("n"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), part)))
    one = lambda p, k: ranked.select(*by, F.col(part).alias(p), F.col("r").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    a, b = one("first", 1), one("second", 2)
    # members of two parts are counted once each: what both have is taken off
    other = members.withColumnRenamed(part, "second")
    shared = members.withColumnRenamed(part, "first").join(other, [*by, member]).where("first <> second").groupBy(*by, "first", "second").agg(F.count("*").cast("int").alias("both"))
    pairs = a.join(b, by).where("r1 < r2").join(shared, [*by, "first", "second"], "left")
    pairs = pairs.select(*by, "first", "second", (F.col("n1") + F.col("n2") - F.coalesce("both", F.lit(0))).alias("covered"), "r1", "r2")
    ones = a.select(*by, "first", F.lit(None).cast("string").alias("second"), F.col("n1").alias("covered"), "r1", F.lit(0).alias("r2"))
    both = ones.unionByName(pairs)
    order = F.struct(-F.col("covered"), F.when(F.col("second").isNull(), 1).otherwise(2), F.col("r1"), F.col("r2"))
    best = both.groupBy(*by).agg(F.min_by(F.struct("first", "second", "covered"), order).alias("b"))
    return best.select(*by, "b.first", "b.second", "b.covered")


def best_cover(sets: list[list[str]], counts: np.ndarray, k: int) -> tuple[list[str], int]:
    """At most k parts that together hold most members, and how many; ``counts[i]`` members are in exactly the parts ``sets[i]``.

    Parts are tried by size, then name, fewer parts first; only a better cover
    replaces one. A branch ends when its members and the largest gains left can't
    better the best cover.
    """
    sizes: dict[str, int] = {}
    for parts, n in zip(sets, counts, strict=True):
        for p in parts:
            sizes[p] = sizes.get(p, 0) + int(n)
    ranked = sorted(sizes, key=lambda p: (-sizes[p], p))
    place = {p: i for i, p in enumerate(ranked)}
    holds = np.zeros((len(sets), len(ranked)), bool)
    for i, parts in enumerate(sets):
        holds[i, [place[p] for p in parts]] = True
    best: tuple[list[int], int] = ([], 0)

    def grow(chosen: list[int], open_: np.ndarray, covered: int, more: int) -> None:
        nonlocal best
        start = chosen[-1] + 1 if chosen else 0
        gains = counts[open_] @ holds[open_, start:]
        for j in range(len(gains) - more + 1):
            rest = np.partition(gains[j + 1 :], len(gains) - j - more)[len(gains) - j - more :].sum() if more > 1 else 0
            if covered + gains[j] + rest <= best[1]:
                continue
            now = [*chosen, start + j]
            if more == 1:
                best = (now, int(covered + gains[j]))
            else:
                grow(now, open_[~holds[open_, start + j]], covered + int(gains[j]), more - 1)

    for size in range(1, min(k, len(ranked)) + 1):
        grow([], np.arange(len(sets)), 0, size)
    return [ranked[i] for i in best[0]], best[1]


def max_cover(df: DataFrame, by: list[str], part: str, member: str, k: int) -> DataFrame:
    """parts (largest first, ties by name) and covered: the at most k parts of a group that most members are in.

    Members count once; on equal cover fewer parts win, then larger ones, then
    names. Members in the same parts are counted before they meet in a group, so
    that a group holds one row per combination of parts that occurs, however many
    members it has. Null parts and members count for nothing.
    """
    if k < 1:
        raise ValueError("a cover needs at least one part")
    some = df.where(F.col(part).isNotNull() & F.col(member).isNotNull()).select(*by, F.col(part).cast("string").alias("_part"), member).distinct()
    sets = some.groupBy(*by, member).agg(F.array_sort(F.collect_list("_part")).alias("_set"))
    kinds = sets.groupBy(*by, "_set").agg(F.count("*").alias("_n"))

    def cover(group: pa.Table) -> pa.Table:
        parts, covered = best_cover(group.column("_set").to_pylist(), group.column("_n").to_numpy(), k)
        return group.select(by).slice(0, 1).append_column("parts", pa.array([parts], pa.list_(pa.string()))).append_column("covered", pa.array([covered], pa.int64()))

    kinds_of = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return kinds.groupBy(*by).applyInArrow(cover, f"{kinds_of}, parts array<string>, covered long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in one order over the whole table, without bringing them into one task.

    Ranges of the order are numbered each on their own; the rows of all earlier
    ranges, one number per range, are added. Equal rows stay in one range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, (within + F.col("_before")).cast("int")).drop("_part", "_before")
