"""Spatial rules: who holds an area, where the two sites' areas lie, and the three kinds of unusual positions.

Presences are rows of unit (recording), round_no, player_id, side, sample_kind,
sample_t_s, area, is_alive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.functions.scalars import blank_to_null, same_moment
from tellmark.operators.distributions import biggest_pair, max_cover, order_statistic

SITE_A, SITE_B = "BombsiteA", "BombsiteB"
SPAWNS = ("CTSpawn", "TSpawn")
SAVING = ("eco", "half", "force")


def _time_rows(presences: DataFrame) -> DataFrame:
    return presences.where("sample_kind = 'time' AND is_alive AND side IN ('T', 'CT')").withColumn("area", blank_to_null(F.col("area")))


def orientation(presences: DataFrame, unit: list[str]) -> DataFrame:
    """Observations of each area and those of T, over both teams' living time samples."""
    return _time_rows(presences).where("area IS NOT NULL").groupBy(*unit, "area").agg(
        F.count("*").alias("total"), F.count_if(F.col("side") == "T").alias("t")
    )


def held_areas(presences: DataFrame, unit: list[str], share: float, per_point: int) -> DataFrame:
    """Areas that T holds: a share of at least ``share`` of at least ``per_point`` observations per sample point of the unit."""
    points = presences.where("sample_kind = 'time'").groupBy(*unit).agg(F.countDistinct("sample_t_s").alias("points"))
    seen = orientation(presences, unit).join(points, unit)
    return seen.withColumn("t_share", F.col("t") / F.col("total")).where(
        (F.col("points") > 0) & (F.col("total") >= per_point * F.col("points")) & (F.col("t_share") >= share)
    )


def advance_hits(presences: DataFrame, rounds: DataFrame, unit: list[str], held: DataFrame, until: float, players: int) -> DataFrame:
    """Saving rounds in which at least ``players`` CTs are in a held area at one sample point up to ``until``."""
    saving = rounds.where(F.col("round_type").isin(*SAVING)).select(*unit, "round_no").distinct()
    rows = _time_rows(presences).where((F.col("side") == "CT") & (F.col("sample_t_s") <= until))
    met = rows.join(saving, [*unit, "round_no"]).join(held, [*unit, "area"])
    hits = met.groupBy(*unit, "round_no", "sample_t_s", "area", "t_share", "total").agg(F.countDistinct("player_id").alias("players"))
    return hits.where(F.col("players") >= players)


def sources(presences: DataFrame, unit: list[str], back: float) -> DataFrame:
    """CT rows with ``source``: the player's area at the latest own sample at least ``back`` seconds before.

    A sample without an area gives none, of several areas at one sample the least counts.
    """
    rows = _time_rows(presences).where("side = 'CT'")
    keys = [*unit, "round_no", "player_id"]
    ms = F.bround(F.col("sample_t_s") * 1000, 0).cast("long")
    rows = rows.withColumn("_ms", ms).withColumn("_least", F.min("area").over(Window.partitionBy(*keys, "_ms")))
    w = Window.partitionBy(*keys).orderBy("_ms").rangeBetween(Window.unboundedPreceding, -round(back * 1000))
    return rows.withColumn("source", F.max(F.struct("_ms", "_least")).over(w)["_least"]).drop("_ms", "_least")


def crunch_hits(presences: DataFrame, unit: list[str], held: DataFrame, until: float, back: float, players: int, origins: int) -> DataFrame:
    """Sample points at which several CTs have come into a held area from several other areas."""
    came = sources(presences, unit, back).where(
        F.col("source").isNotNull() & (F.col("source") != F.col("area")) & (F.col("sample_t_s") <= until)
    )
    met = came.join(held.select(*unit, "area", "t_share", "total"), [*unit, "area"])
    hits = met.groupBy(*unit, "round_no", "sample_t_s", "area", "t_share", "total").agg(
        F.countDistinct("player_id").alias("players"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    return hits.where((F.col("players") >= players) & (F.size("sources") >= origins))


def stack_hits(presences: DataFrame, unit: list[str], groups: DataFrame, at: float, players: int) -> DataFrame:
    """Rounds in which at least ``players`` CTs stand in at most two areas of one site's group at one moment."""
    rows = _time_rows(presences).where(
        (F.col("side") == "CT") & same_moment(F.col("sample_t_s"), F.lit(at)) & F.col("area").isNotNull() & ~F.col("area").isin(*SPAWNS)
    )
    best = biggest_pair(rows.join(groups.select(*unit, "area", "site"), [*unit, "area"]), [*unit, "round_no", "site"], "area", "player_id")
    return best.where(F.col("covered") >= players)


def crowds(presences: DataFrame, unit: list[str], groups: DataFrame, at: float, players: int, areas: int) -> DataFrame:
    """Rounds in which at least ``players`` CTs stand in at most ``areas`` areas of one site's group at one moment.

    site, areas (largest first), area (the first), sample_t_s, players and alive:
    all living CTs of that moment, wherever they stand. Spawns and areas without a
    group hold nobody.
    """
    moment = _time_rows(presences).where((F.col("side") == "CT") & same_moment(F.col("sample_t_s"), F.lit(at)))
    alive = moment.groupBy(*unit, "round_no").agg(F.countDistinct("player_id").alias("alive"))
    placed = moment.where(F.col("area").isNotNull() & ~F.col("area").isin(*SPAWNS)).join(groups.select(*unit, "area", "site"), [*unit, "area"])
    best = max_cover(placed, [*unit, "round_no", "site"], "area", "player_id", areas).where(F.col("covered") >= players)
    return best.join(alive, [*unit, "round_no"]).select(
        *unit, "round_no", "site", F.lit(float(at)).alias("sample_t_s"), F.get("parts", F.lit(0)).alias("area"), F.col("parts").alias("areas"), F.col("covered").alias("players"), "alive"
    )


def site_groups(
    cells: DataFrame, unit: list[str], margin: float = 1.25, separation: float = 2.0, gap_ratio: float = 0.40,
    trim: float = 0.05, floor_weight: float = 3.0, bridge: float = 0.10,
) -> DataFrame:
    """(unit, area, site) of areas that clearly belong to one of the two sites; units whose sites can't be told apart have no rows.

    Centres are medians over cells. Sites on top of each other (their height
    bands are apart) are told apart by weighted height, and areas in between are
    left out; others must lie further apart than they spread.
    """
    c = cells.withColumn("area", blank_to_null(F.col("area"))).where("area IS NOT NULL")
    for a in "xyz":
        c = c.withColumn(a, F.col(f"cell_{a}").cast("double"))
    centre = c.groupBy(*unit, "area").agg(*(F.median(a).alias(f"c{a}") for a in "xyz"))
    site = c.where(F.col("area").isin(SITE_A, SITE_B)).join(centre, [*unit, "area"])
    dist = F.sqrt(sum(F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in "xyz"))
    per = site.groupBy(*unit, "area", "cx", "cy", "cz").agg(
        F.median(dist).alias("spread"), order_statistic("z", trim).alias("low"), order_statistic("z", 1 - trim).alias("high")
    )
    one = lambda name, s: per.where(F.col("area") == name).select(*unit, *(F.col(k).alias(f"{s}_{k}") for k in ("cx", "cy", "cz", "spread", "low", "high")))
    both = one(SITE_A, "a").join(one(SITE_B, "b"), unit)
    apart = F.sqrt(sum(F.pow(F.col(f"a_c{k}") - F.col(f"b_c{k}"), 2) for k in "xyz"))
    span = F.col("a_spread") + F.col("b_spread")
    both = both.withColumn("void_low", F.least("a_high", "b_high")).withColumn("void_high", F.greatest("a_low", "b_low"))
    heights = (F.col("a_high") - F.col("a_low")) + (F.col("b_high") - F.col("b_low"))
    gap = F.col("void_high") - F.col("void_low")
    both = both.withColumn("stacked", F.when(heights > 0, gap / heights >= gap_ratio).otherwise(gap > 0))
    both = both.where((span > 0) & (apart > 0) & (F.col("stacked") | (apart >= separation * span)))
    weight = F.when(F.col("stacked"), floor_weight).otherwise(1.0)
    inside = (F.col("z") > F.col("void_low")) & (F.col("z") < F.col("void_high"))
    void = c.join(both, unit).groupBy(*unit, "area").agg(F.avg(inside.cast("double")).alias("void"))
    placed = centre.join(both, unit).join(void, [*unit, "area"])
    away = lambda s: F.sqrt(
        F.pow(F.col("cx") - F.col(f"{s}_cx"), 2) + F.pow(F.col("cy") - F.col(f"{s}_cy"), 2) + F.pow((F.col("cz") - F.col(f"{s}_cz")) * weight, 2)
    )
    placed = placed.where(~F.col("stacked") | F.col("area").isin(SITE_A, SITE_B) | (F.col("void") < bridge))
    placed = placed.withColumn("to_a", away("a")).withColumn("to_b", away("b"))
    closer: Column = F.when((F.col("to_a") < F.col("to_b")) & (F.col("to_b") >= margin * F.col("to_a")), "A").when(
        (F.col("to_b") < F.col("to_a")) & (F.col("to_a") >= margin * F.col("to_b")), "B"
    )
    return placed.select(*unit, "area", closer.alias("site")).where("site IS NOT NULL")
