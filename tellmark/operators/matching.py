"""Joins beyond equality: as-of, intervals, look-back, nearest cell, regions, and matches by overlap of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.functions.scalars import finite_point
from tellmark.operators import overlaps as O
from tellmark.operators.clouds import nearest_cell
from tellmark.session import dealt

__all__ = ["as_of", "assign_interval", "best_overlap", "grid_cells", "in_region", "interval_pairs", "look_back", "nearest_cell", "overlaps", "overlaps_at_least", "prefix_pairs"]


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], tolerance: Column | None = None) -> DataFrame:
    """For each left row the last right row of equal ``by`` at or before ``at``, as right_<at> and right_<c>.

    One shuffle on ``by``: both sides in one sorted window, right rows first on
    equal times. A null key matches nothing; beyond the tolerance there is no match.
    """
    names = [at, *(c for c in take if c != at)]
    empty = F.lit(None)
    marked = left.withColumn("_side", F.lit(1)).withColumn("_hit", empty.cast(f"struct<{', '.join(f'{c}: {right.schema[c].dataType.simpleString()}' for c in names)}>"))
    other = right.select(
        *(F.col(c) if c in by or c == at else empty.cast(left.schema[c].dataType).alias(c) for c in left.columns),
        F.lit(0).alias("_side"),
        F.struct(*names).alias("_hit"),
    )
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("_hit", ignorenulls=True).over(w)
    for c in by:
        hit = F.when(F.col(c).isNotNull(), hit)
    found = marked.unionByName(other).withColumn("_hit", hit).where("_side = 1")
    if tolerance is not None:
        found = found.withColumn("_hit", F.when(F.col(at) - F.col(f"_hit.{at}") <= tolerance, F.col("_hit")))
    return found.select(*left.columns, *(F.col(f"_hit.{c}").alias(f"right_{c}") for c in names))


def look_back(df: DataFrame, by: list[str], at: str, value: str, lag: int, name: str) -> DataFrame:
    """The value of the group's latest row at least ``lag`` before each row; of rows at one time the least value, null last."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(Window.unboundedPreceding, -lag)
    per_time = Window.partitionBy(*by, at)
    one = F.struct(F.col(at).alias("t"), F.col("_least").alias("v"))
    return df.withColumn("_least", F.min(value).over(per_time)).withColumn(name, F.max(one).over(w)["v"]).drop("_least")


def assign_interval(points: DataFrame, windows: DataFrame, by: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points joined to the windows that hold them, ends included.

    Windows are cut into buckets of ``width``, so that the join is on equality
    and no point meets windows far from it.
    """
    cut = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    names = {c: f"_w_{c}" for c in by}
    cut = cut.withColumnsRenamed(names)
    placed = points.withColumn("_p", F.floor(F.col(at) / width))
    on = [F.col(c) == F.col(n) for c, n in names.items()] + [F.col("_p") == F.col("_b"), F.col(at).between(F.col(start), F.col(end))]
    return placed.join(cut, on, how).drop("_p", "_b", *names.values())


def _blocks(df: DataFrame, keys: list[str], name: str, each: int) -> DataFrame:
    """Rows of equal keys in arrays of about ``each``, dealt by the hash of their other columns; null keys are left out."""
    values = [c for c in df.columns if c not in keys]
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / each).alias("_shares"))
    share = F.pmod(F.xxhash64(*values), F.col("_shares")).alias("_share")
    return df.join(sizes, keys).groupBy(*keys, share).agg(F.collect_list(F.struct(*values)).alias(name)).drop("_share")


def interval_pairs(points: DataFrame, windows: DataFrame, by: list[str], at: str, start: str, end: str, width: int, each: int = 1024) -> DataFrame:
    """Rows of ``assign_interval``, for windows that overlap, so that pairs far outnumber both tables.

    Points of a bucket, and windows with equal ends, meet as blocks of about ``each``;
    pairs are made only behind the join, a point with a block's windows at a time. So
    neighbouring rows of the result repeat either a point or a run of windows, and
    a bucket stays in one partition: columnar files of the result keep to few values.
    """
    held = [c for c in windows.columns if c not in (*by, start, end)]
    groups = _blocks(windows if held else windows.withColumn("_w", F.lit(0)), [*by, start, end], "_windows", each)
    cut = groups.withColumn("_p", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = _blocks(points.withColumn("_p", F.floor(F.col(at) / width)), [*by, "_p"], "_points", each)
    met = dealt(placed, points.count(), *by, "_p", each=16 * each).hint("merge").join(cut, [*by, "_p"])
    inside = met.withColumn("_points", F.filter("_points", lambda p: p[at].between(F.col(start), F.col(end))))
    pairs = inside.withColumn("_point", F.explode("_points")).withColumn("_window", F.explode("_windows"))
    return pairs.select(
        *(F.col(c) if c in by else F.col(f"_point.{c}") for c in points.columns),
        *(F.col(f"_window.{c}") if c in held else F.col(c) for c in windows.columns if c not in by),
    )


def grid_cells(df: DataFrame, axes: list[str], grid: float, label: str, by: list[str] = ()) -> DataFrame:
    """Cells of a grid with the most frequent label (ties to the smallest) and the number of observations.

    Rows with a null or blank label or a coordinate that is no finite number don't
    count. Floors, so that negative coordinates fall below.
    """
    sound = (F.trim(label) != "") & finite_point(*(F.col(a) for a in axes))
    cells = [F.floor(F.col(a).cast("double") / grid).cast("int").alias(f"cell_{a}") for a in axes]
    each = df.where(sound).groupBy(*by, *cells, label).agg(F.count("*").alias("_n"))
    keys = [*by, *(f"cell_{a}" for a in axes)]
    return each.groupBy(*keys).agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label), F.sum("_n").alias("observations")
    )


def in_region(points: DataFrame, boxes: DataFrame, by: list[str], x: str, y: str, part: str, priority: str) -> DataFrame:
    """Points with the part of the first box (by ``priority``) that holds them; null if none does.

    A box holds its lower sides and not its upper ones, so that a point on a side
    that two boxes share is in one of them only.

    Boxes are a small dimension table keyed by ``by``: those of a key travel as one
    array, so the join is on the key alone and every point stays one row.
    """
    names = {c: f"_b_{c}" for c in by}
    box = F.struct(F.col(priority).alias("priority"), F.col(part).alias("part"), "x_min", "x_max", "y_min", "y_max")
    small = boxes.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    joined = points.join(small, [F.col(c) == F.col(n) for c, n in names.items()], "left")
    holds = lambda b: (F.col(x) >= b["x_min"]) & (F.col(x) < b["x_max"]) & (F.col(y) >= b["y_min"]) & (F.col(y) < b["y_max"])
    return joined.withColumn(part, F.get(F.filter("_boxes", holds), F.lit(0))["part"]).drop("_boxes", *names.values())


def overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str) -> DataFrame:
    """(left_key, right_key, common): number of shared members of every pair of sets that share one."""
    return overlaps_at_least(left, right, left_key, right_key, member, 1)


def _firsts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str, least: int) -> list[DataFrame]:
    """The rarest size - least + 1 members of every set of both sides; a member of one side only pairs nothing and is left out."""
    holders = [s.groupBy(member).agg(F.count("*").alias(n)) for s, n in ((left, "_l"), (right, "_r"))]
    cost = holders[0].join(holders[1], member).select(member, (F.col("_l") * F.col("_r")).alias("_cost"))
    firsts = []
    for s, key in ((left, left_key), (right, right_key)):
        w = Window.partitionBy(key)
        ranked = s.join(cost, member).withColumn("_size", F.count("*").over(w)).withColumn("_place", F.row_number().over(w.orderBy("_cost", member)))
        firsts.append(ranked.where(F.col("_place") <= F.col("_size") - least + 1).select(key, member))
    return firsts


def prefix_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str, least: int, share: int = 1024) -> DataFrame:
    """(left_key, right_key): every pair of sets that may share ``least`` members, each once.

    Members are ordered from rare to common. Two sets that share ``least`` members
    share one of the first size - least + 1 of each, so only these are paired;
    what all sets have stands last and pairs nothing. A member that many sets
    still begin with is dealt over shares of about ``share`` right sets, each
    with all its left ones. Sides have (key, member) without repeats and nulls.
    """
    firsts = _firsts(left, right, left_key, right_key, member, least)
    parts = firsts[1].groupBy(member).agg(F.ceil(F.count("*") / share).cast("int").alias("_parts"))
    a = firsts[0].join(parts, member).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    b = firsts[1].join(parts, member).withColumn("_share", F.pmod(F.xxhash64(right_key), F.col("_parts")).cast("int")).drop("_parts")
    return a.join(b, [member, "_share"]).select(left_key, right_key).distinct()


def _shape(a: DataFrame, b: DataFrame, left_key: str, right_key: str, member: str) -> dict[str, int]:
    """Meetings in all and of the left set with most, left sets that meet any and their members, right sets, and most left and right sets of a member; runs a job."""
    left, right = a.groupBy(member).agg(F.count("*").alias("_l")), b.groupBy(member).agg(F.count("*").alias("_r"))
    each = a.join(right, member).groupBy(left_key).agg(F.sum("_r").alias("_m"), F.count("*").alias("_k"))
    met = each.agg(F.sum("_m").alias("met"), F.max("_m").alias("most"), F.count("*").alias("lefts"), F.sum("_k").alias("rows"))
    held = left.join(right, member).agg(F.max("_l").alias("held_l"), F.max("_r").alias("held_r"))
    found = met.crossJoin(held).crossJoin(b.groupBy(right_key).agg(F.count("*")).agg(F.count("*").alias("rights"))).first()
    return {k: v or 0 for k, v in found.asDict().items()}


#: Meetings up to which pairs are counted without asking whether the prefix filter would save some.
FEW = 1 << 26


def overlaps_at_least(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str, least: int, share: int = 1024, above: bool = False) -> DataFrame:
    """(left_key, right_key, common) of the pairs of sets that share at least ``least`` members; null keys and members count for nothing.

    Pairs are counted in cells of whole left sets (``overlaps.counted``). Where
    members that most sets share make these many, and ``prefix_pairs`` leaves so few
    pairs that counting each of them whole is less work, they come from there. With
    ``above`` only pairs whose right key is greater are returned.
    """
    if least < 1:
        raise ValueError("pairs share at least one member")
    a, b = O.sets(left, left_key, member), O.sets(right, right_key, member)
    if least == 1:
        return O.pairs(a, b, left_key, right_key, member, least, int(above), O.meetings(a, b, left_key, member))
    shape = _shape(a, b, left_key, right_key, member)
    size = shape["met"], shape["most"]
    # a set leaves out least - 1 members, each met by no more sets than its commonest: where too much is left, both sides need not be ranked to tell
    kept = size[0] - (least - 1) * (shape["lefts"] * shape["held_r"] + shape["rights"] * shape["held_l"])
    if size[0] <= FEW or kept * shape["rows"] * 4 > size[0] * shape["lefts"]:
        return O.pairs(a, b, left_key, right_key, member, least, int(above), size)
    first = [f.groupBy(member).agg(F.count("*").alias(n)) for f, n in zip(_firsts(a, b, left_key, right_key, member, least), ("_l", "_r"), strict=True)]
    mean = a.agg(F.count("*") / F.countDistinct(left_key)).first()[0]
    # a pair of the filter is sent, made one, and counted by its members
    filtered = first[0].join(first[1], member).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if filtered * mean * 4 > size[0]:
        return O.pairs(a, b, left_key, right_key, member, least, int(above), size)
    pairs = prefix_pairs(a, b, left_key, right_key, member, least, share)
    pairs = pairs.where(F.col(right_key) > F.col(left_key)) if above else pairs
    both = pairs.join(a, left_key).join(b, [right_key, member], "left_semi")
    return both.groupBy(left_key, right_key).agg(F.count("*").alias("common")).where(F.col("common") >= least)


def best_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str) -> DataFrame:
    """The right set that shares most members with each left set that shares any; null on a tie."""
    return O.best(left, right, left_key, right_key, member)
