"""All spatial rules over all rounds: hits of every rule, anomalies by branch with the rule's own denominator, and what was looked at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellmark.operators import spatial as X

RULES = ("ct_advance", "crunch", "stack")
RULE_SIDE = "CT"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the three rules."""

    t_share: float
    per_point: int
    until: float
    advance_players: int
    crunch_players: int
    crunch_sources: int
    back: float
    stack_at: float
    stack_players: int
    stack_areas: int


def rule_hits(presences: DataFrame, everyone: DataFrame, rounds: DataFrame, groups: DataFrame, unit: list[str], limits: Limits) -> DataFrame:
    """unit, round_no, rule, site (of stacks), area, sample_t_s and players of every hit in the given rounds.

    ``presences`` are the subject's rows; who holds an area is told by
    ``everyone``, the unfiltered rows of the same units, or the anomaly would
    take part in its own measure. Sample points are those of the subject's rows.
    """
    held = held_by_t(presences, everyone, unit, limits)
    own = presences.join(rounds.select(*unit, "round_no").distinct(), [*unit, "round_no"], "left_semi")
    keys = [*unit, "round_no"]
    advance = X.advance_hits(own, rounds, unit, held, limits.until, limits.advance_players)
    crunch = X.crunch_hits(own, unit, held, limits.until, limits.back, limits.crunch_players, limits.crunch_sources)
    stack = X.crowds(own, unit, groups, limits.stack_at, limits.stack_players, limits.stack_areas)
    named = lambda df, rule: df.select(*keys, F.lit(rule).alias("rule"), (F.col("site") if "site" in df.columns else F.lit(None).cast("string")).alias("site"), "area", "sample_t_s", F.col("players").cast("long").alias("players"))
    return named(advance, RULES[0]).unionByName(named(crunch, RULES[1])).unionByName(named(stack, RULES[2]))


def held_by_t(presences: DataFrame, everyone: DataFrame, unit: list[str], limits: Limits) -> DataFrame:
    """Areas that T holds by everyone's rows, per sample point of the subject's rows."""
    points = presences.where("sample_kind = 'time'").groupBy(*unit).agg(F.countDistinct("sample_t_s").alias("points"))
    seen = X.orientation(everyone, unit).join(points, unit)
    return seen.withColumn("t_share", F.col("t") / F.col("total")).where(
        (F.col("points") > 0) & (F.col("total") >= limits.per_point * F.col("points")) & (F.col("t_share") >= limits.t_share)
    )


def eligible(rounds: DataFrame, separated: DataFrame, unit: list[str]) -> DataFrame:
    """One row per round and rule that can see it: advances only saving rounds, stacks only units whose sites separate."""
    seen = rounds.where("round_type IS NOT NULL").join(separated.select(*unit, F.lit(True).alias("_apart")).distinct(), unit, "left")
    able = F.array(
        F.when(F.col("round_type").isin(*X.SAVING), RULES[0]), F.lit(RULES[1]), F.when(F.coalesce("_apart", F.lit(False)), RULES[2])
    )
    return seen.withColumn("rule", F.explode(F.filter(able, lambda r: r.isNotNull()))).drop("_apart")


def branches(seen: DataFrame, hits: DataFrame, unit: list[str]) -> DataFrame:
    """map_name, side, rule, rounds m that the rule can see and rounds n that it hit: also where it hit none."""
    hit = hits.select(*unit, "round_no", "rule").distinct().withColumn("_hit", F.lit(1))
    return seen.join(hit, [*unit, "round_no", "rule"], "left").groupBy("map_name", "side", "rule").agg(F.count("*").alias("m"), F.count("_hit").alias("n"))


def anomalies(seen: DataFrame, hits: DataFrame, unit: list[str]) -> DataFrame:
    """Hits by map, side, rule, site and area: n rounds of the branch's m, matches, round types, and the rounds with their sample points.

    The same area in two rounds is one row with two rounds, two sample points of
    one round are one round.
    """
    branch = ["map_name", "side", "rule"]
    m = seen.groupBy(*branch).agg(F.count("*").alias("m"))
    found = hits.join(seen.select(*unit, "round_no", *branch, "round_type", "match_id"), [*unit, "round_no", "rule"])
    row = [*branch, "site", "area"]
    per = found.groupBy(*row, *unit, "round_no", "round_type", "match_id").agg(F.array_sort(F.collect_list(F.struct("sample_t_s", "players"))).alias("points"))
    grouped = per.groupBy(*row).agg(
        F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.array_sort(F.collect_set("round_type")).alias("round_types"),
        F.array_sort(F.collect_list(F.struct(*unit, "round_no", "points"))).alias("rounds"),
    )
    return grouped.join(m, branch)


def coverage(seen: DataFrame, rounds: DataFrame, held: DataFrame, separated: DataFrame, unit: list[str]) -> DataFrame:
    """One row of what the rules looked at: rounds in all and per rule (its side only), and units without held areas or separate sites.

    "No anomaly" says something only about these rounds.
    """
    typed = rounds.where("round_type IS NOT NULL")
    per = seen.where(F.col("side") == RULE_SIDE).agg(*(F.count_if(F.col("rule") == r).alias(f"{r}_rounds") for r in RULES))
    units = typed.select(*unit).distinct()
    missing = lambda df, name: units.join(df.select(*unit).distinct(), unit, "left_anti").agg(F.count("*").alias(name))
    out = typed.agg(F.count("*").alias("rounds_scanned"))
    for one in (per, missing(held, "units_without_orientation"), missing(separated, "units_without_site_groups")):
        out = out.crossJoin(F.broadcast(one))  # single rows
    return out
