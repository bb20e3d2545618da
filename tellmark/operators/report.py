"""The report cube: evidence per map, side and round type, every count with the sample behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.functions.scalars import seconds_bucket
from tellmark.operators.distributions import presence_distribution, top_with_ties

LEVELS = ["map_name", "side", "round_type"]


def samples(rounds: DataFrame) -> DataFrame:
    """Rounds, demos and distinct matches for each leaf, side, map and the whole, with the league's share; unclassified rounds apart."""
    known = rounds.where("round_type IS NOT NULL")
    league = F.col("is_league")
    cube = known.rollup(*LEVELS).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("rounds"),
        F.countDistinct("map_demo_id").alias("demos"),
        F.countDistinct("match_id").alias("matches"),
        *(F.count_if(F.coalesce(league == b, F.lit(False))).alias(f"rounds_{n}") for n, b in (("league", True), ("other", False))),
        F.count_if(league.isNull()).alias("rounds_unknown"),
    )
    return cube


BUCKETS = ("league", "other", "unknown")


def bucketed_samples(rounds: DataFrame) -> DataFrame:
    """``samples`` with demos per bucket as well: demos_league, demos_other, demos_unknown."""
    known = rounds.where("round_type IS NOT NULL")
    league = F.col("is_league")
    of = {"league": F.coalesce(league, F.lit(False)), "other": F.coalesce(~league, F.lit(False)), "unknown": league.isNull()}
    return known.rollup(*LEVELS).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("rounds"), F.countDistinct("map_demo_id").alias("demos"), F.countDistinct("match_id").alias("matches"),
        *(F.count_if(which).alias(f"rounds_{b}") for b, which in of.items()), *(F.countDistinct(F.when(which, F.col("map_demo_id"))).alias(f"demos_{b}") for b, which in of.items()),
    )


def cube_faults(cube: DataFrame) -> DataFrame:
    """(level, map_name, side, measure, claimed, least, most): numbers of a level that its children's don't allow.

    Rounds sum at every level, in all and in each bucket. Demos sum only from maps
    to the whole, as a demo is on one map and in one bucket. Matches sum nowhere:
    a level has at least as many as its largest child and at most as many as all
    together. A level whose children are missing is at fault in rounds; one
    self-join of levels on the parent's keys.
    """
    rounds = ["rounds", *(f"rounds_{b}" for b in BUCKETS)]
    demos = ["demos", *(f"demos_{b}" for b in BUCKETS)]
    parent = {0: 1, 1: 3, 3: 7}
    child = cube.where(F.col("level").isin(*parent)).withColumn("_of", F.element_at(F.create_map(*(F.lit(x) for kv in parent.items() for x in kv)), F.col("level")))
    keep = lambda c, n: F.when(F.col("_of") <= n, F.col(c))
    child = child.select("_of", keep("map_name", 3).alias("_map"), keep("side", 1).alias("_side"), *rounds, *demos, "matches")
    sums = child.groupBy("_of", "_map", "_side").agg(*(F.sum(c).alias(f"_{c}") for c in (*rounds, *demos, "matches")), F.max("matches").alias("_largest"))
    upper = cube.where(F.col("level") > 0)
    on = (F.col("level") == F.col("_of")) & F.col("map_name").eqNullSafe(F.col("_map")) & F.col("side").eqNullSafe(F.col("_side"))
    both = upper.join(sums, on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = lambda name, least, most: F.struct(F.lit(name).alias("measure"), F.col(name).alias("claimed"), zero(F.col(least)).alias("least"), zero(F.col(most)).alias("most"))
    checks = [row(c, f"_{c}", f"_{c}") for c in rounds]
    whole = [F.when(F.col("level") == 7, row(c, f"_{c}", f"_{c}")) for c in demos]
    matches = F.when(F.col("_of").isNotNull(), row("matches", "_largest", "_matches"))
    found = both.select("level", "map_name", "side", F.explode(F.array(*checks, *whole, matches)).alias("c")).where("c IS NOT NULL")
    return found.select("level", "map_name", "side", "c.*").where("claimed < least OR claimed > most")


def records(rounds: DataFrame) -> DataFrame:
    """Wins, losses and rounds of unknown result per leaf."""
    won = F.col("won")
    return rounds.where("round_type IS NOT NULL").groupBy(*LEVELS).agg(
        F.count_if(F.coalesce(won, F.lit(False))).alias("wins"), F.count_if(F.coalesce(~won, F.lit(False))).alias("losses"), F.count_if(won.isNull()).alias("unknown")
    )


def positions(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per leaf, sample point and area: players, the n rounds with so many, and m, the rounds that have the point at all."""
    leaf = rounds.where("round_type IS NOT NULL").select("map_demo_id", "round_no", *LEVELS)
    rows = ticks.drop("side", "map_name", "round_type").join(leaf, ["map_demo_id", "round_no"])
    alive = F.coalesce("is_alive", F.lit(False))
    return presence_distribution(rows, [*LEVELS, "sample_kind", "sample_t_s"], ["map_demo_id", "round_no"], "area", alive, "player_id")


def utility(events: DataFrame, rounds: DataFrame, edges: list[float]) -> DataFrame:
    """Per leaf, grenade type, target and time of the throw: rounds n and throws; a detonation stays with its throw whatever its tick."""
    leaf = rounds.where("round_type IS NOT NULL").select("map_demo_id", "round_no", *LEVELS)
    keys = ["map_demo_id", "grenade_no"]
    thrown = events.where("event_kind = 'grenade_thrown'").select(*keys, "round_no", "grenade_type", F.col("area").alias("from_area"), "t_s")
    landed = events.where("event_kind = 'grenade_detonate'").select(*keys, F.col("area").alias("target"))
    pairs = thrown.join(landed, keys, "left").join(leaf, ["map_demo_id", "round_no"])
    return pairs.groupBy(*LEVELS, "grenade_type", "from_area", "target", seconds_bucket(F.col("t_s"), edges).alias("bucket")).agg(
        F.countDistinct("map_demo_id", "round_no").alias("n"), F.count("*").alias("throws")
    )


def unpaired(events: DataFrame) -> DataFrame:
    """Detonations that no throw belongs to."""
    keys = ["map_demo_id", "grenade_no"]
    return events.where("event_kind = 'grenade_detonate'").join(events.where("event_kind = 'grenade_thrown'"), keys, "left_anti")


def throws_per_round(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per leaf and grenade type: how many rounds had how many throws, rounds without any included.

    Rounds without a throw are those of the leaf less those seen; they are never made as rows.
    """
    leaf = rounds.where("round_type IS NOT NULL").select("map_demo_id", "round_no", *LEVELS)
    thrown = events.where("event_kind = 'grenade_thrown'").select("map_demo_id", "round_no", "grenade_type").join(leaf, ["map_demo_id", "round_no"])
    seen = thrown.groupBy(*LEVELS, "map_demo_id", "round_no", "grenade_type").agg(F.count("*").alias("throws"))
    some = seen.groupBy(*LEVELS, "grenade_type", "throws").agg(F.count("*").alias("n"))
    rounds_of = leaf.distinct().groupBy(*LEVELS).agg(F.count("*").alias("_m"))
    none = some.groupBy(*LEVELS, "grenade_type").agg(F.sum("n").alias("_n")).join(rounds_of, LEVELS)
    zeros = none.select(*LEVELS, "grenade_type", F.lit(0).cast("long").alias("throws"), (F.col("_m") - F.col("_n")).alias("n")).where("n > 0")
    return some.unionByName(zeros)


def first_deaths(deaths: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per leaf and area: rounds whose first own death fell there, out of the rounds with one, and the median time."""
    leaf = rounds.where("round_type IS NOT NULL").select("map_demo_id", "round_no", "lineup_key", *LEVELS)
    own = deaths.join(leaf, ["map_demo_id", "round_no"]).where("victim_lineup_key = lineup_key")
    order = F.struct(F.col("t_s").isNull(), "t_s", F.col("victim_id").isNull(), "victim_id", F.col("victim_area").isNull(), "victim_area")
    first = own.groupBy("map_demo_id", "round_no", *LEVELS).agg(F.min_by(F.struct("victim_area", "t_s"), order).alias("d"))
    per = first.groupBy(*LEVELS, F.col("d.victim_area").alias("area")).agg(F.count("*").alias("n"), F.bround(F.median("d.t_s"), 3).alias("median_t_s"))
    return per.withColumn("m", F.sum("n").over(Window.partitionBy(*LEVELS)))


def kills(deaths: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per leaf and area: own kills out of all own kills; a suicide is a death but no kill."""
    leaf = rounds.where("round_type IS NOT NULL").select("map_demo_id", "round_no", "lineup_key", *LEVELS)
    own = deaths.join(leaf, ["map_demo_id", "round_no"]).where("attacker_lineup_key = lineup_key AND attacker_id <> victim_id")
    per = own.groupBy(*LEVELS, F.col("attacker_area").alias("area")).agg(F.count("*").alias("n"))
    return per.withColumn("m", F.sum("n").over(Window.partitionBy(*LEVELS)))


def least_rounds(threshold: int, rounds: Column) -> Column:
    """The repetition that a line of a block needs: the threshold, but no more than the block's rounds and at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(threshold), rounds))


def shown_bars(bars: DataFrame, threshold: int, k: int) -> DataFrame:
    """Bars worth a line: somebody there, often enough, the k most frequent of a block with ties."""
    some = bars.where((F.col("players") > 0) & (F.col("n") >= least_rounds(threshold, F.col("m"))))
    return top_with_ties(some, [*LEVELS, "sample_kind", "sample_t_s"], "n", k)


def nested(leaves: DataFrame, bars: DataFrame) -> DataFrame:
    """One document per map: sides, round types, and their bars as nested arrays."""
    own = bars.groupBy(*LEVELS).agg(F.array_sort(F.collect_list(F.struct("sample_kind", "sample_t_s", "area", "players", "n", "m"))).alias("bars"))
    leaf = leaves.where("level = 0").join(own, LEVELS, "left")
    sides = leaf.groupBy("map_name", "side").agg(F.array_sort(F.collect_list(F.struct("round_type", "rounds", "matches", "bars"))).alias("round_types"))
    return sides.groupBy("map_name").agg(F.array_sort(F.collect_list(F.struct("side", "round_types"))).alias("sides"))


def newest_match(matches: DataFrame) -> DataFrame:
    """One row: the match of least rank; null if any of several matches has no rank."""
    only = F.when(F.count("*") == 1, F.min("match_id"))
    ranked = F.when(F.count_if(F.col("rank").isNull()) == 0, F.min_by("match_id", "rank"))
    return matches.select("match_id", "rank").distinct().agg(F.coalesce(only, ranked).alias("match_id"))


def used_thresholds(classified: DataFrame, inputs: str, names: list[str]) -> DataFrame:
    """(name, value, values): what each threshold was when rounds were classified; value is null if rounds differ."""
    flat = classified.select(*(F.col(f"{inputs}.{n}").cast("long").alias(n) for n in names))
    long = flat.unpivot([], names, "name", "value").where("value IS NOT NULL")
    return long.groupBy("name").agg(
        F.when(F.countDistinct("value") == 1, F.min("value")).alias("value"), F.countDistinct("value").alias("values")
    )


def threshold_faults(classified: DataFrame, inputs: str, now: dict[str, int]) -> DataFrame:
    """(name, fault, values): thresholds that rounds were not classified with alike or not as they are ``now``.

    differs (several values; they are listed), stale (one, but not today's) or
    missing (in no round). An empty table has no rounds, so all are missing.
    """
    flat = classified.agg(*(F.array_sort(F.collect_set(F.col(f"{inputs}.{n}").cast("long"))).alias(n) for n in now))
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("long").alias("now"), F.col(n).alias("values")) for n, v in now.items()))
    long = flat.select(F.explode(each).alias("t")).select("t.*")
    fault = F.when(F.size("values") > 1, "differs").when(F.size("values") == 0, "missing").when(F.get("values", F.lit(0)) != F.col("now"), "stale")
    return long.select("name", fault.alias("fault"), "values").where("fault IS NOT NULL")


def weakest_source(rows: DataFrame, by: list[str], source: str, order: list[str]) -> DataFrame:
    """The least trustworthy source per ``by``; ``order`` names them from strong to weak, unknown ones are weakest."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    rank = F.when(place > 0, place).otherwise(len(order) + 1)
    return rows.groupBy(*by).agg(F.max_by(source, F.struct(rank, F.col(source))).alias(source))


def anomaly_rows(hits: DataFrame, rounds: DataFrame, unit: list[str], denominator: Column) -> DataFrame:
    """Hits by map, side and area: rounds n with their sample points nested, matches, and m rounds that the rule applies to."""
    leaf = rounds.where("round_type IS NOT NULL")
    m = leaf.where(denominator).groupBy("map_name", "side").agg(F.count("*").alias("m"))
    found = hits.join(leaf.select(*unit, "round_no", "map_name", "side", "round_type", "match_id"), [*unit, "round_no"])
    per = found.groupBy("map_name", "side", "area", *unit, "round_no", "round_type", "match_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_t_s", "players"))).alias("points")
    )
    grouped = per.groupBy("map_name", "side", "area").agg(
        F.count("*").alias("n"),
        F.countDistinct("match_id").alias("matches"),
        F.array_sort(F.collect_set("round_type")).alias("round_types"),
        F.array_sort(F.collect_list(F.struct(*unit, "round_no", "points"))).alias("rounds"),
    )
    return grouped.join(m, ["map_name", "side"])


def repeated(rows: DataFrame, block: list[str], n: str, m: str, threshold: int, k: int) -> DataFrame:
    """Lines of a block that repeat often enough for it, the k most frequent with ties."""
    return top_with_ties(rows.where(F.col(n) >= least_rounds(threshold, F.col(m))), block, n, k)


def unsaturated(rows: DataFrame, block: list[str], value: str) -> DataFrame:
    """Rows of blocks whose value isn't the same everywhere; a block of one row stays, as does the first row of any block."""
    w = Window.partitionBy(*block)
    varied = (F.min(value).over(w) != F.max(value).over(w)) | (F.count("*").over(w) == 1)
    first = F.row_number().over(w.orderBy(value)) == 1
    return rows.withColumn("_keep", F.coalesce(varied, F.lit(True)) | first).where("_keep").drop("_keep")


def equipment_lines(bars: DataFrame, block: list[str], metric: str, count: str, n: str, unknown: str, full: int, pair: tuple[str, str]) -> DataFrame:
    """Lines of equipment that say something: block, metrics and bars (arrays of count and n, by count).

    ``bars`` has one row per block, metric and count: how many of its rounds have
    it, and how many rounds could not be read (``unknown``, the same in all rows of
    a metric). A metric goes if one bar holds every round and is the full team, as
    nothing else could be expected; a line at zero and one with unread rounds stay.
    The two metrics of ``pair`` become one line if their bars are equal. If
    nothing of a block would be left, the first metric of the pair stays.
    """
    keys = [*block, metric]
    lines = bars.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(count).alias("count"), F.col(n).alias("n")))).alias("bars"), F.max(F.coalesce(unknown, F.lit(0))).alias("_unread")
    )
    some = F.filter("bars", lambda b: b["n"] > 0)
    alone = (F.size(some) == 1) & (some[0]["count"] == full) & (F.col("_unread") == 0)
    lines = lines.withColumn("_gone", alone)
    sides = lambda name: F.max(F.when(F.col(metric) == name, F.struct("bars", "_unread"))).over(Window.partitionBy(*block))
    equal = F.coalesce(sides(pair[0]) == sides(pair[1]), F.lit(False)) & F.col(metric).isin(*pair) & ~F.col("_gone")
    left = F.min("_gone").over(Window.partitionBy(*block))
    lines = lines.withColumn("_equal", equal).withColumn("_none", left)
    kept = (~F.col("_gone") & ~(F.col("_equal") & (F.col(metric) == pair[1]))) | (F.col("_none") & (F.col(metric) == pair[0]))
    named = F.when(F.col("_equal"), F.array(*map(F.lit, pair))).otherwise(F.array(F.col(metric)))
    return lines.where(kept).select(*block, named.alias("metrics"), "bars", F.col("_unread").alias("unread"))


def not_covered(presence: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Presence rows that no shown position covers; unknown areas compare as areas."""
    names = {c: f"_s_{c}" for c in keys}
    seen = shown.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    return presence.join(seen, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left_anti")
