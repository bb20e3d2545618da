"""Ends of trajectories made into events with round, side, lineup and area, each unit by its own cloud, counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tellmark.operators.clouds import nearest_found
from tellmark.operators.matching import assign_interval

THROWN, DETONATED = "grenade_thrown", "grenade_detonate"
#: What ``named_events`` counts, all but the last two in throws.
COUNTS = (
    "without_thrower", "outside_rounds", "unknown_side", "unknown_type", "throwers_without_row", "detonating_after_round", "events"
)


def named_events(
    endpoints: DataFrame, windows: DataFrame, sides: DataFrame, lineups: DataFrame, positions: DataFrame, cells: DataFrame, unit: list[str],
    rate: Column | float, grid: float, limit: float, types: list[str], width: int, z_weight: float = 1.5, z_tolerance: float = 72.0,
) -> tuple[DataFrame, Observation]:
    """Events of numbered throws, and an observation of what was left out, to be read after the events were written.

    ``endpoints`` has unit, grenade_no, event_kind, grenade_type, thrower_id, tick, x, y, z;
    ``windows`` unit, round_raw, start_tick, stop_tick; ``sides`` unit, round_raw, player_id, side;
    ``lineups`` unit, round_raw, side, lineup_key; ``positions`` unit, tick, player_id, area;
    ``cells`` the cells of each unit's cloud with their area.

    The throw decides the round, a detonation inherits it. A throw's area is where
    its thrower stood (``observed``); a detonation's is the nearest cell's of its
    unit's cloud (``point_cloud``), if one is within ``limit``. Throws without a
    thrower, outside of the rounds or of a thrower without a side go with their
    detonations. They are counted where they are dropped, in the same pass: no
    table is read again for a counter. Repeated endpoint rows stay apart as rows;
    grenade_no names a throw within its unit. Null coordinates give no area.
    """
    observed = Observation()
    throw = F.col("event_kind") == THROWN
    owned = F.col("thrower_id").isNotNull()
    stood = positions.groupBy(*unit, "tick", F.col("player_id").alias("thrower_id")).agg(F.min("area").alias("_own"))
    # a throw's place and round are looked up with few columns and come back to it: its events meet all they need by one key
    place = F.when(F.col("_there"), F.struct("tick", "thrower_id", "_own"))
    found = endpoints.where(throw).select(*unit, "grenade_no", "tick", "thrower_id").join(stood.withColumn("_there", F.lit(True)), [*unit, "tick", "thrower_id"], "left")
    found = found.groupBy(*unit, "grenade_no").agg(F.min(F.when(owned, F.col("tick"))).alias("_tick"), F.collect_set(place).alias("_stood"))
    placed = assign_interval(found, windows, unit, "_tick", "start_tick", "stop_tick", width, "left")
    round_ = F.when(F.col("start_tick").isNotNull(), F.struct("round_raw", "start_tick", "stop_tick"))
    of_throw = placed.groupBy(*unit, "grenade_no").agg(F.min(round_).alias("_w"), F.first("_stood").alias("_stood"))
    of_player = sides.where("side IS NOT NULL").groupBy(*unit, F.col("round_raw").alias("_round"), F.col("player_id").alias("thrower_id")).agg(F.min("side").alias("side"))
    of_side = lineups.groupBy(*unit, F.col("round_raw").alias("_round"), "side").agg(F.min("lineup_key").alias("lineup_key"))
    rows = endpoints.join(of_throw, [*unit, "grenade_no"], "left").withColumn("_round", F.col("_w.round_raw"))
    rows = rows.join(of_player, [*unit, "_round", "thrower_id"], "left").join(of_side, [*unit, "_round", "side"], "left")
    here = F.filter("_stood", lambda x: (x["tick"] == F.col("tick")) & (x["thrower_id"] == F.col("thrower_id")))
    rows = rows.withColumn("_here", F.get(here, F.lit(0))).withColumns({"_own": F.col("_here._own"), "_seen": F.when(F.col("_here").isNotNull(), True)}).drop("_stood", "_here")
    inside, sided = F.col("_w").isNotNull(), F.col("side").isNotNull()
    kept = owned & inside & sided
    known = F.coalesce(F.col("grenade_type").isin(*types), F.lit(False))
    count = lambda name, which: F.count_if(F.coalesce(which, F.lit(False))).alias(name)
    rows = rows.observe(
        observed,
        count("without_thrower", throw & ~owned), count("outside_rounds", throw & owned & ~inside), count("unknown_side", throw & owned & inside & ~sided),
        count("unknown_type", throw & owned & ~known), count("throwers_without_row", throw & kept & F.col("_seen").isNull()),
        count("detonating_after_round", ~throw & kept & (F.col("tick") > F.col("_w.stop_tick"))), count("events", kept),
    )
    rows = rows.where(kept)
    # only what stands in a kept round is searched; a throw has at most one detonation place
    ends = endpoints.where(~throw).groupBy(*unit, "grenade_no").agg(F.min(F.struct("x", "y", "z")).alias("p")).select(*unit, "grenade_no", "p.*")
    near = nearest_found(ends, cells, ["grenade_no"], grid, z_weight, z_tolerance, unit).where(F.col("distance") <= limit)
    near = near.select(*unit, "grenade_no", F.col("_label").alias("_near"), F.col("distance").alias("_far"))
    rows = rows.join(near, [*unit, "grenade_no"], "left")
    area = F.when(throw, F.col("_own")).otherwise(F.col("_near"))
    out = rows.select(
        *unit, F.col("_round").alias("round_raw"), "event_kind", "grenade_no", "grenade_type", "thrower_id", "lineup_key", "side",
        ((F.col("tick") - F.col("_w.start_tick")) / (rate if isinstance(rate, Column) else F.lit(float(rate)))).alias("t_s"), "x", "y", "z",
        area.alias("area"), F.when(area.isNotNull(), F.when(throw, "observed").otherwise("point_cloud")).alias("area_source"),
        F.when(~throw & F.col("_near").isNotNull(), F.col("_far")).alias("snap_distance"),
    )
    return out, observed
