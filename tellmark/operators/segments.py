"""Rounds out of raw ticks: anchors paired with ends, sides of two changing lineups, sums and comparisons of readings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.operators.runs import fill_number


def pair_anchors(anchors: DataFrame, ends: DataFrame, unit: list[str]) -> DataFrame:
    """One row per end with the last anchor before it, and one per anchor that no end owns; in order of ticks.

    ``anchors`` has unit and tick, ``ends`` unit, tick, round and what else is
    known of a round. Anchors between two ends belong to the later one; of
    several the last does, the others are on their own.
    """
    carried = [c for c in ends.columns if c not in (*unit, "tick")]
    marks = anchors.select(*unit, "tick", F.lit(1).alias("_anchor"), *(F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in carried))
    both = marks.unionByName(ends.withColumn("_anchor", F.lit(0)))
    # an anchor at an end's own tick comes after it
    w = Window.partitionBy(*unit).orderBy("tick", "_anchor")
    ahead = both.withColumn("_next", F.lead("_anchor").over(w)).withColumn("_before", F.lag("_anchor").over(w)).withColumn("_tick", F.lag("tick").over(w))
    is_end = F.col("_anchor") == 0
    owned = F.col("_next") == 0
    rows = ahead.where(is_end | ~F.coalesce(owned, F.lit(False)))
    anchor = F.when(is_end, F.when(F.col("_before") == 1, F.col("_tick"))).otherwise(F.col("tick"))
    return rows.select(*unit, F.col("tick").alias("at"), anchor.alias("freeze_end_tick"), F.when(is_end, F.col("tick")).alias("end_tick"), *carried)


def number_segments(segments: DataFrame, unit: list[str]) -> DataFrame:
    """round_raw: the known numbers, counted on behind the last and back before the first; from 1 if none is known.

    Between known numbers a segment gets one only if there is room for exactly
    the segments in between; else those are restarts and stay without.
    """
    w = Window.partitionBy(*unit).orderBy("at")
    whole = Window.partitionBy(*unit)
    df = segments.withColumn("_k", F.row_number().over(w))
    none = F.count("round").over(whole) == 0
    df = df.withColumn("_round", F.when(none & (F.col("_k") == 1), F.lit(1)).otherwise(F.col("round")))
    filled = fill_number(df, unit, ["at"], "_round", "_forward")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    shift = F.col("_round") - F.col("_k")
    before, after = F.last(shift, ignorenulls=True).over(back), F.first(shift, ignorenulls=True).over(ahead)
    fits = before.isNull() | after.isNull() | (before == after) | F.col("_round").isNotNull()
    return filled.withColumn("round_raw", F.when(fits, F.col("_forward")).cast("int")).drop("_k", "_round", "_forward")


#: Restarts of a unit that are accepted; more are a phenomenon that nobody has seen.
MAX_RESTARTS = 2


def number_rounds(segments: DataFrame, unit: list[str]) -> DataFrame:
    """Segments (unit, at, round, end_tick, ...) with round_raw, and what the gap between two known numbers is that they lie in.

    ``gap`` is resolved (a segment of it has an end: its segments are rounds and are
    counted on from the number before), restart (no end, and the numbers around
    continue by one: its segments stay without a number), jump (no end, and a number
    is left out: a round was lost, nothing is guessed) or null outside of gaps.
    Before the first known number it is counted back, behind the last on; from 1
    if none is known. All windows are within a unit and in one order, so its rows are sorted once.
    """
    w = Window.partitionBy(*unit).orderBy("at")
    known = F.col("round").isNotNull()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    # segments without a number that have an end, so far: a gap has one if these differ at its two sides
    ends = F.sum((~known & F.col("end_tick").isNotNull()).cast("int")).over(back)
    df = segments.withColumns({"_k": F.row_number().over(w), "_ends": ends})
    place = F.struct(F.col("round").alias("n"), F.col("_k").alias("k"), F.col("_ends").alias("ends"))
    df = df.withColumn("_before", F.last(F.when(known, place), ignorenulls=True).over(back)).withColumn("_after", F.first(F.when(known, place), ignorenulls=True).over(ahead))
    inside = ~known & F.col("_before").isNotNull() & F.col("_after").isNotNull()
    ended = F.col("_after.ends") > F.col("_before.ends")
    continues = F.col("_after.n") == F.col("_before.n") + 1
    df = df.withColumn("gap", F.when(inside, F.when(ended, "resolved").when(continues, "restart").otherwise("jump")))
    none = F.col("_before").isNull() & F.col("_after").isNull()
    number = (
        F.when(known, F.col("round"))
        .when(none, F.col("_k"))
        .when(F.col("_before").isNull(), F.col("_after.n") - (F.col("_after.k") - F.col("_k")))
        .when(F.col("_after").isNull() | (F.col("gap") == "resolved"), F.col("_before.n") + (F.col("_k") - F.col("_before.k")))
    )
    return df.withColumn("round_raw", number.cast("int")).drop("_k", "_ends", "_before", "_after")


def round_gaps(numbered: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, before, after, gap, segments, ticks) of every gap between known numbers; ``ticks`` are its anchors in order."""
    w = Window.partitionBy(*unit).orderBy("at")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = numbered.withColumn("before", F.last("round", ignorenulls=True).over(back)).withColumn("after", F.first("round", ignorenulls=True).over(ahead))
    df = df.withColumn("_from", F.max(F.when(F.col("round").isNotNull(), F.col("at"))).over(back))
    found = df.where("gap IS NOT NULL").groupBy(*unit, "_from", "before", "after", "gap").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list("at")).alias("ticks"))
    return found.drop("_from")


def round_faults(numbered: DataFrame, unit: list[str], limit: int = MAX_RESTARTS) -> DataFrame:
    """(unit, fault, n, ticks): jumps, more restarts than ``limit``, and numbers that do not rise (a derived one collides)."""
    w = Window.partitionBy(*unit).orderBy("at")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    df = numbered.withColumns({"_top": F.max("round_raw").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_from": F.max(F.when(F.col("round").isNotNull(), F.col("at"))).over(back)})
    # a segment of a jump or restart has no number, so none has two faults
    fault = F.when(F.col("gap") == "jump", "jump").when(F.col("gap") == "restart", "restarts").when(F.col("round_raw") <= F.col("_top"), "order")
    found = df.withColumn("fault", fault).where("fault IS NOT NULL").withColumn("_from", F.when(F.col("fault") == "jump", F.col("_from")))
    each = found.groupBy(*unit, "fault", "_from").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("at")).alias("ticks"))
    return each.where((F.col("fault") != "restarts") | (F.col("n") > limit)).select(*unit, "fault", "n", "ticks")


def checked_rounds(numbered: DataFrame, unit: list[str], limit: int = MAX_RESTARTS) -> DataFrame:
    """Numbered segments; a unit with a fault fails the job, with its fault and ticks in the error."""
    faults = round_faults(numbered, unit, limit).groupBy(*unit).agg(F.min(F.concat("fault", F.lit(" at "), F.array_join(F.col("ticks").cast("array<string>"), ", "))).alias("_fault"))
    joined = numbered.join(faults, unit, "left")
    return joined.withColumn("round_raw", F.when(F.col("_fault").isNull(), F.col("round_raw")).otherwise(F.raise_error(F.col("_fault")).cast("int"))).drop("_fault")


def assign_sides(players: DataFrame, unit: str, order: str, side: str = "side", player: str = "player_id") -> DataFrame:
    """(unit, order, first_side): the side of the lineup that began as T, for every segment of a unit.

    A lineup is the set of all players seen on its side so far, so each segment
    hangs on those before it: one group per unit, a few hundred rows, in pandas.
    The arrangement that shares more players with the lineups wins; a tie and a
    segment without players keep the one before.
    """
    kinds = dict(players.dtypes)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        lineups: tuple[set, set] = (set(), set())
        sides, out = None, []
        for at, part in rows.groupby(order, sort=True):
            seen = {s: set(part.loc[part[side] == s, player]) for s in ("T", "CT")}
            if not seen["T"] and not seen["CT"]:
                pass
            elif not lineups[0] and not lineups[1]:
                if not seen["T"] or not seen["CT"]:
                    raise ValueError(f"{rows[unit].iloc[0]}: the first players are on one side only")
                sides = ("T", "CT")
            else:
                share = lambda pair: sum(len(seen[s] & members) for s, members in zip(pair, lineups))  # noqa: E731, B023
                straight, crossed = share(("T", "CT")), share(("CT", "T"))
                if straight != crossed:
                    sides = ("T", "CT") if straight > crossed else ("CT", "T")
            if sides is None:
                raise ValueError(f"{rows[unit].iloc[0]}: no sides are known at {at}")
            for s, members in zip(sides, lineups):
                members |= seen[s]
            out.append((rows[unit].iloc[0], at, sides[0]))
        return pd.DataFrame(out, columns=[unit, order, "first_side"])

    return players.select(unit, order, side, player).groupBy(unit).applyInPandas(walk, f"{unit} {kinds[unit]}, {order} {kinds[order]}, first_side string")


def all_or_null(value: Column, usable: Column) -> Column:
    """How many rows have the value, but null unless every row is usable and there is one."""
    return F.when((F.count("*") > 0) & (F.count_if(~F.coalesce(usable, F.lit(False))) == 0), F.count_if(F.coalesce(value, F.lit(False))))


def economy_sums(readings: DataFrame, by: list[str], arming: list[str]) -> DataFrame:
    """Money, spending, equipment, balances (largest first), readable, armed and armoured players per side and round.

    Only players with all four readings count for the sums, which are null
    without any; armed (armour and a weapon of the arming kinds) and armoured are
    null unless every readable player shows them.
    """
    four = ["balance", "cash_spent", "equip_current", "equip_round_start"]
    readable = F.lit(True)
    for c in four:
        readable = readable & F.col(c).isNotNull()
    some = readings.where(readable)
    armoured = F.col("armor_value") > 0
    armed = armoured & F.arrays_overlap("inventory", F.array(*map(F.lit, arming)))
    return some.groupBy(*by).agg(
        F.sum("balance").cast("int").alias("money_buy_end"),
        F.sum("cash_spent").cast("int").alias("money_spent"),
        F.sum("equip_current").cast("int").alias("equip_buy_end"),
        F.sum("equip_round_start").cast("int").alias("equip_round_start"),
        F.count("*").cast("int").alias("players_buy_end"),
        F.sort_array(F.collect_list("balance"), asc=False).alias("money_players_buy_end"),
        all_or_null(armed, F.col("armor_value").isNotNull() & F.col("inventory").isNotNull()).cast("int").alias("players_armed_buy_end"),
        all_or_null(armoured, F.col("armor_value").isNotNull()).cast("int").alias("players_armored_buy_end"),
    )


def _twice(before: DataFrame, after: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    return before.select(*keys, *(F.col(c).alias(f"{c}_before") for c in take)).join(after.select(*keys, *take), keys)


def later_purchases(measured: DataFrame, window_end: DataFrame, keys: list[str]) -> DataFrame:
    """One row: players compared, and those who spent more by the end of the window."""
    both = _twice(measured, window_end, keys, ["cash_spent"]).where("cash_spent IS NOT NULL AND cash_spent_before IS NOT NULL")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("cash_spent") > F.col("cash_spent_before")).alias("missed"))


def refunds_and_stale(anchor: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row: players whose spending fell, and those whose equipment rose while nothing was bought, worn or carried anew."""
    take = ["cash_spent", "equip_current", "armor_value", "inventory"]
    both = _twice(anchor, measured, keys, take)
    same = lambda c: F.col(c) == F.col(f"{c}_before")
    nothing = F.expr("CAST(array() AS array<string>)")
    carried = F.coalesce("inventory", nothing) == F.coalesce("inventory_before", nothing)
    stale = (F.col("equip_current") > F.col("equip_current_before")) & same("cash_spent") & same("armor_value") & carried
    return both.agg(
        F.count_if(F.col("cash_spent") < F.col("cash_spent_before")).alias("refunds"), F.count_if(F.coalesce(stale, F.lit(False))).alias("stale")
    )


def tick_rate(times: DataFrame, unit: list[str], default: float = 64.0, low: float = 16.0, high: float = 256.0) -> DataFrame:
    """The median ticks per second between consecutive readings, as a whole number; the default outside the range."""
    w = Window.partitionBy(*unit).orderBy("tick")
    steps = times.select(*unit, ((F.col("tick") - F.lag("tick").over(w)) / F.nullif(F.col("seconds") - F.lag("seconds").over(w), F.lit(0.0))).alias("_r"))
    rate = F.bround(F.median(F.when(F.col("_r") > 0, F.col("_r"))), 0)
    return steps.groupBy(*unit).agg(F.when(rate.between(low, high), rate).otherwise(default).alias("tick_rate"))


def named_areas(rows: DataFrame, callouts: DataFrame, columns: list[str], unit: str = "map_name") -> DataFrame:
    """Area columns renamed to callouts, with <column>_flag: no_table, no_callout, coarse, inferred or null.

    Callouts are a small dimension of (map_name, area, callout, coarse, confidence).
    An area without a callout keeps its name; a map without any table is flagged.
    """
    maps = callouts.select(F.col(unit).alias("_map")).distinct()
    out = rows.join(maps, F.col(unit) == F.col("_map"), "left")
    for c in columns:
        one = callouts.select(F.col(unit).alias("_m"), F.col("area").alias("_a"), "callout", "coarse", "confidence")
        out = out.join(one, (F.col(unit) == F.col("_m")) & (F.col(c) == F.col("_a")), "left")
        flag = (
            F.when(F.col(c).isNull(), F.lit(None).cast("string")).when(F.col("_map").isNull(), "no_table").when(F.col("callout").isNull(), "no_callout")
            .when(F.col("coarse") & (F.col("confidence") == "inferred"), "coarse_inferred").when(F.col("coarse"), "coarse").when(F.col("confidence") == "inferred", "inferred")
        )
        out = out.withColumn(f"{c}_flag", flag).withColumn(c, F.coalesce("callout", c)).drop("_m", "_a", "callout", "coarse", "confidence")
    return out.drop("_map")
