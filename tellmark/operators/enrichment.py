"""Raw tables made into contract tables: numbering joins, round windows, sides, ambiguous classes, scores and readings.

Every join that may lose rows has a counter beside it, as one aggregate row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.operators.matching import as_of, assign_interval

TEAM_SIDES = {2: "T", 3: "CT"}


def numbered(rows: DataFrame, rounds: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of numbered rounds with their round_no instead of round_raw; rows of unnumbered rounds are left out."""
    numbers = rounds.where("round_no IS NOT NULL").select(*unit, "round_raw", "round_no").distinct()
    return rows.join(numbers, [*unit, "round_raw"])


def lost_rows(rows: DataFrame, rounds: DataFrame, unit: list[str], counts: Column) -> DataFrame:
    """One row: how many of the rows that count have no numbered round."""
    numbers = rounds.where("round_no IS NOT NULL").select(*unit, "round_raw").distinct()
    return rows.where(counts).join(numbers, [*unit, "round_raw"], "left_anti").agg(F.count("*").alias("lost"))


def wanted_ticks(ticks: DataFrame, wanted: DataFrame, unit: list[str]) -> DataFrame:
    """The readings at wanted ticks only; a semi-join, so that the scan keeps its columns and no row repeats."""
    return ticks.join(wanted.select(*unit, "tick").distinct(), [*unit, "tick"], "left_semi")


def pawnless(calls: DataFrame, unit: list[str]) -> DataFrame:
    """Rows without a pawn per unit: the most that any call saw at a tick, summed over ticks."""
    per = calls.groupBy(*unit, "tick", "call").agg(F.count_if(F.col("x").isNull()).alias("n"))
    return per.groupBy(*unit, "tick").agg(F.max("n").alias("n")).groupBy(*unit).agg(F.sum("n").alias("pawnless"))


def round_windows(segments: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, round_raw, start_tick, stop_tick) of segments with both ends; ``overlaps`` marks one that begins before its predecessor ends."""
    w = Window.partitionBy(*unit).orderBy("freeze_end_tick", "end_tick").rowsBetween(Window.unboundedPreceding, -1)
    whole = segments.where("freeze_end_tick IS NOT NULL AND end_tick IS NOT NULL AND round_raw IS NOT NULL")
    return whole.select(
        *unit, "round_raw", F.col("freeze_end_tick").alias("start_tick"), F.col("end_tick").alias("stop_tick"),
        F.coalesce(F.col("freeze_end_tick") <= F.max("end_tick").over(w), F.lit(False)).alias("overlaps"),
    )


def player_sides(players: DataFrame, lineups: DataFrame, observed: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, round_raw, player_id, side): by the player's lineup, else as observed at the earliest tick of the round.

    ``players`` are the (unit, round_raw, player_id) asked for, ``lineups`` has
    unit, round_raw, player_id and side. A player of both lineups of a round has none
    of them; without an observation either the side is null.
    """
    keys = [*unit, "round_raw", "player_id"]
    own = lineups.groupBy(*keys).agg(F.when(F.countDistinct("side") == 1, F.min("side")).alias("own"))
    seen = observed.where("side IS NOT NULL").groupBy(*keys).agg(F.min_by("side", F.struct("tick", "side")).alias("seen"))
    asked = players.select(*keys).distinct()
    return asked.join(own, keys, "left").join(seen, keys, "left").select(*keys, F.coalesce("own", "seen").alias("side"))


def enriched_deaths(deaths: DataFrame, windows: DataFrame, sides: DataFrame, lineups: DataFrame, unit: list[str], rate: float, width: int) -> DataFrame:
    """Deaths with the round that holds their tick, seconds from its start, and side and lineup of victim and attacker.

    A death outside every round, or whose victim has no side, is left out; an
    unknown attacker leaves nulls.
    """
    held = assign_interval(deaths, windows.drop("overlaps"), unit, "tick", "start_tick", "stop_tick", width)
    out = held.withColumn("t_s", (F.col("tick") - F.col("start_tick")) / F.lit(float(rate)))
    for who in ("victim", "attacker"):
        one = sides.select(*unit, "round_raw", F.col("player_id").alias(f"{who}_id"), F.col("side").alias(f"{who}_side"))
        out = out.join(one, [*unit, "round_raw", f"{who}_id"], "left")
        key = lineups.select(*unit, "round_raw", F.col("side").alias(f"{who}_side"), F.col("lineup_key").alias(f"{who}_lineup_key"))
        out = out.join(key, [*unit, "round_raw", f"{who}_side"], "left")
    return out.where("victim_side IS NOT NULL").drop("start_tick", "stop_tick")


def death_losses(deaths: DataFrame, windows: DataFrame, sides: DataFrame, unit: list[str], width: int) -> DataFrame:
    """One row: deaths in all, outside every round, and within one but with a victim of no side."""
    held = assign_interval(deaths, windows.drop("overlaps"), unit, "tick", "start_tick", "stop_tick", width)
    known = sides.where("side IS NOT NULL").select(*unit, "round_raw", F.col("player_id").alias("victim_id"))
    inside = held.agg(F.count("*").alias("inside"))
    nobody = held.join(known, [*unit, "round_raw", "victim_id"], "left_anti").agg(F.count("*").alias("without_side"))
    every = deaths.agg(F.count("*").alias("deaths"))
    joined = every.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(nobody))  # three single rows
    return joined.select("deaths", (F.col("deaths") - F.col("inside")).alias("outside"), "without_side")


def event_rounds(events: DataFrame, windows: DataFrame, unit: list[str], width: int) -> DataFrame:
    """Events with their throw's round: the throw's tick decides, a detonation inherits it even if it falls later."""
    thrown = events.where("event_kind = 'grenade_thrown'").select(*unit, "grenade_no", F.col("tick").alias("_tick"))
    placed = assign_interval(thrown, windows.drop("overlaps"), unit, "_tick", "start_tick", "stop_tick", width)
    return events.join(placed.select(*unit, "grenade_no", "round_raw", "start_tick"), [*unit, "grenade_no"])


def own_areas(rows: DataFrame, positions: DataFrame, unit: list[str], player: str) -> DataFrame:
    """Rows with ``own_area``, where the player stood at that tick; of several readings the least area."""
    there = positions.groupBy(*unit, "tick", F.col("player_id").alias(player)).agg(F.min("area").alias("own_area"))
    return rows.join(there, [*unit, "tick", player], "left")


def without_owner(rows: DataFrame, owner: str) -> tuple[DataFrame, Column]:
    """Rows that have an owner, and an aggregate over all rows that counts the others."""
    return rows.where(F.col(owner).isNotNull()), F.count_if(F.col(owner).isNull()).alias("without_owner")


def unknown_values(column: str, known: list[str]) -> Column:
    """An aggregate: rows whose value is not among the known ones, nulls included."""
    return F.count_if(~F.coalesce(F.col(column).isin(*known), F.lit(False))).alias("unknown")


def resolve_class(throws: DataFrame, candidates: DataFrame, by: list[str], at: str, key: str, kinds: list[str], tolerance: float) -> DataFrame:
    """(key, kind, hits) of every throw: the one kind of which a candidate row lies within ``tolerance`` before it, else null.

    One as-of join per kind; a throw that none or several kinds hit is unresolved.
    """
    out = throws.select(*by, at, key)
    for kind in kinds:
        own = candidates.where(F.col("kind") == kind).select(*by, at, F.lit(True).alias("hit")).distinct()
        out = as_of(out, own, by, at, ["hit"], F.lit(tolerance)).drop(f"right_{at}").withColumnRenamed("right_hit", f"_{kind}")
    flags = [F.coalesce(f"_{k}", F.lit(False)) for k in kinds]
    hits = sum(f.cast("int") for f in flags)
    named = F.coalesce(*(F.when(f, F.lit(k)) for f, k in zip(flags, kinds, strict=True)))
    return out.select(key, F.when(hits == 1, named).alias("kind"), hits.alias("hits"))


def renamed_class(rows: DataFrame, resolved: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose class is the resolved one where there is one, else their own."""
    known = resolved.where("kind IS NOT NULL").select(key, F.col("kind").alias("_kind"))
    return rows.join(known, key, "left").withColumn(column, F.coalesce("_kind", column)).drop("_kind")


def shared_entities(rows: DataFrame, unit: list[str], entity: str, thing: str) -> DataFrame:
    """One row: things that share their entity number with another thing of the unit."""
    per = rows.groupBy(*unit, entity).agg(F.countDistinct(thing).alias("n")).where("n > 1")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("shared"))


def total_scores(readings: DataFrame, keys: list[str]) -> DataFrame:
    """score of both sides together at a tick: the least reading of each side, null unless both have one."""
    per = readings.where("team_score IS NOT NULL AND side IN ('T', 'CT')").groupBy(*keys, "side").agg(F.min("team_score").alias("s"))
    known = per.groupBy(*keys).agg(F.when(F.count("*") == 2, F.sum("s")).alias("score"))
    return readings.select(*keys).distinct().join(known, keys, "left")


def score_before(segments: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """score_before of each segment: the nearest earlier reading, of a restart (no round_raw) its anchor's, of others their end's."""
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reading = F.when(F.col("round_raw").isNull(), F.col("anchor_score")).otherwise(F.col("end_score"))
    return segments.withColumn("score_before", F.last(reading, ignorenulls=True).over(w))


def saved_before(segments: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """survivors_equip_prev: what survivors of the team's previous segment had saved; null after a restart and in the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    restart = F.lag("round_raw").over(w).isNull()
    return segments.withColumn("survivors_equip_prev", F.when(~restart, F.lag("saved").over(w)))


def gap_ticks(rate: Column, seconds: float = 0.125) -> Column:
    """The gap that ends a run, in ticks: the seconds at this rate, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(seconds) * rate, 0).cast("int"))


def inventory(items: Column) -> Column:
    """Trimmed items without blank ones; null stays null."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def side_of(known: Column, team: Column) -> Column:
    """A player's known side, else that of the team number."""
    named = F.create_map(*(x for number, side in TEAM_SIDES.items() for x in (F.lit(number), F.lit(side))))
    return F.coalesce(known, F.try_element_at(named, team))


def cloud_observations(frame: DataFrame) -> DataFrame:
    """area (blank is null), is_alive (life state 0) and coordinates as doubles."""
    return frame.select(
        F.nullif(F.trim("place"), F.lit("")).alias("area"), (F.col("life_state") == 0).alias("is_alive"), *(F.col(a).cast("double").alias(a) for a in "xyz")
    )


def trajectory_frame(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns of a raw trajectory scan under their contract names, ticks as integers and coordinates as doubles."""
    kinds = {"tick": "int", "x": "double", "y": "double", "z": "double"}
    return raw.select(*(F.col(old).cast(kinds.get(new, "string")).alias(new) for old, new in names.items()))
