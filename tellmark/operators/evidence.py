"""Evidence blocks of a report: readings with their unknowns, presence at first contact, rosters, played maps, line choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.operators.distributions import top_groups, top_with_ties
from tellmark.operators.report import least_rounds

ROSTER_BUCKETS = {"5/5": "full", "4/5": "partial"}


def histogram_with_unknown(rounds: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per ``by`` and known value: n rounds, m rounds with a value, and the rounds without one; unknown is not zero.

    A group whose rounds are all unknown has one row with a null value and n 0.
    """
    w = Window.partitionBy(*by)
    per = rounds.groupBy(*by, value).agg(F.count("*").alias("_n"))
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    out = per.withColumn("m", F.sum(known).over(w)).withColumn("rounds_unknown", F.sum(F.col("_n") - known).over(w)).withColumn("n", known)
    return out.where(F.col(value).isNotNull() | (F.col("m") == 0)).select(*by, value, "n", "m", "rounds_unknown")


def reading_per_key(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one reading of every complete key; two different ones are an error as soon as the row is read."""
    some = rows.where(F.col(value).isNotNull())
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    wrong = F.raise_error(F.concat(F.lit(f"several {value} for "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys))))
    return some.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).select(
        *keys, F.when(F.col("_a") != F.col("_b"), wrong.cast("int")).otherwise(F.col("_a")).alias(value)
    )


def first_contact_presence(ticks: DataFrame, rounds: DataFrame, unit: list[str], match: Column, newest: Column) -> DataFrame:
    """Per area: n rounds with a living player there at first contact, m rounds with such a sample, their matches, and whether the newest is among them.

    One round counts for every area that it has somebody in; an unknown area is an area.
    """
    keys = rounds.select(*unit).distinct()
    rows = ticks.where("sample_kind = 'first_contact'").join(keys, unit, "left_semi").withColumn("_match", match)
    whole = rows.agg(F.countDistinct(*unit).alias("m"), F.countDistinct("_match").alias("matches_m"))
    there = rows.where(F.coalesce("is_alive", F.lit(False))).groupBy("area").agg(
        F.countDistinct(*unit).alias("n"), F.countDistinct("_match").alias("matches"), F.max(F.col("_match") == newest).alias("newest")
    )
    return there.crossJoin(F.broadcast(whole))  # one row


def roster_buckets(rows: DataFrame, demo: str, value: str) -> DataFrame:
    """(demo, bucket, fault) of every demo: its rounds' one roster class as a bucket.

    ``fault`` tells why there is none: contradictory (two classes), interrupted
    (some rounds without a class) or not allowed; rounds without any class are unknown.
    """
    per = rows.groupBy(demo).agg(F.countDistinct(value).alias("k"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("v"))
    names = F.create_map(*(F.lit(x) for kv in ROSTER_BUCKETS.items() for x in kv))
    bucket = F.try_element_at(names, F.col("v"))
    fault = F.when(F.col("k") > 1, "contradictory").when((F.col("k") == 1) & (F.col("nulls") > 0), "interrupted").when((F.col("k") == 1) & bucket.isNull(), "not allowed")
    return per.select(demo, F.when(fault.isNull(), F.when(F.col("k") == 0, "unknown").otherwise(bucket)).alias("bucket"), fault.alias("fault"))


def map_name(demo: Column, observed: Column, pool: list[str]) -> tuple[Column, Column]:
    """A demo's map and where it is from: the header, else the one pool name among the words of the id, else the id itself."""
    words = F.split(F.lower(demo), "[^a-z0-9_]+|_")
    whole = F.split(F.lower(demo), "[^a-z0-9_]+")
    hits = F.array(*(F.when(F.array_contains(words, p.lower().removeprefix("de_")) | F.array_contains(whole, p.lower()), F.lit(p)) for p in sorted(set(pool))))
    hits = F.filter(hits, lambda h: h.isNotNull())
    seen = F.nullif(F.trim(observed), F.lit(""))
    name = F.coalesce(seen, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))), demo)
    source = F.when(seen.isNotNull(), "demo_header").when(F.size(hits) == 1, "map_demo_id").otherwise("unknown")
    return name, source


def played_maps(demos: DataFrame, matches: DataFrame, match: str, demo: str) -> DataFrame:
    """Every demo with its match's place, date and opponent, and its own place: ranked matches first, then by id.

    ``matches`` has match, rank, played_on and opponent; demos of unknown matches come last.
    """
    facts = matches.groupBy(match).agg(F.min("rank").alias("rank"), F.min_by(F.struct("played_on", "opponent"), "rank").alias("f"))
    joined = demos.join(facts, match, "left")
    return joined.select(demo, F.col("rank").isNotNull().alias("indexed"), "rank", "f.played_on", "f.opponent")


def opponent_name(teams: Column, roster: Column) -> Column:
    """Of a match's two teams (name, roster) the other one's name, if exactly one shares players with the roster and has all of it."""
    ours = F.filter(teams, lambda t: F.arrays_overlap(t["roster"], roster))
    others = F.filter(teams, lambda t: ~F.arrays_overlap(t["roster"], roster))
    sure = (F.size(teams) == 2) & (F.size(ours) == 1) & (F.size(F.array_except(roster, F.get(ours, F.lit(0))["roster"])) == 0)
    return F.when(sure, F.get(others, F.lit(0))["name"])


def lineup_stats(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Per lineup: rows, rows without a name, and the different names in order."""
    return rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_if(F.col(name).isNull()).alias("without_name"), F.array_sort(F.collect_set(name)).alias("names")
    )


def table_stats(rows: DataFrame, distinct: dict[str, list[str]], nulls: list[str], tops: list[str]) -> DataFrame:
    """One row: rows, n_<name> different tuples, null_<column> nulls and max_<column>, in one aggregation."""
    tuple_of = lambda cs: F.struct(*cs) if len(cs) > 1 else F.col(cs[0])
    return rows.agg(
        F.count("*").alias("rows"), *(F.countDistinct(tuple_of(cs)).alias(f"n_{name}") for name, cs in distinct.items()),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls), *(F.max(c).alias(f"max_{c}") for c in tops),
    )


def lineup_summary(rounds: DataFrame, key: str) -> DataFrame:
    """Per lineup: its side in the first round, rounds, wins, and rounds of unknown result."""
    return rounds.groupBy(key).agg(
        F.min_by("side", "round_no").alias("starting_side"), F.count("*").alias("rounds"),
        F.count_if(F.coalesce("won", F.lit(False))).alias("wins"), F.count_if(F.col("won").isNull()).alias("unknown"),
    )


def selection_counts(selections: DataFrame, classes: list[str]) -> DataFrame:
    """One row with the counts of a selection: accepted, rejected, league, rosters by source, drifted, uncertain and each class."""
    ok = F.coalesce("roster_ok", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return selections.agg(
        F.count("*").alias("map_demos"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(yes("is_league")).alias("league"),
        *(F.count_if(F.col("roster_source") == s).alias(s) for s in ("observed", "predicted")),
        F.count_if(yes("drifted")).alias("drifted"), F.count_if(~yes("certainly_played")).alias("uncertain"),
        *(F.count_if(ok & (F.col("roster_class") == c)).alias(f"class_{k}") for k, c in enumerate(classes)),
    )


def drift(observed: Column, predicted: Column) -> tuple[Column, Column]:
    """Who was observed and not predicted, and the other way round, in order."""
    return F.array_sort(F.array_except(observed, predicted)), F.array_sort(F.array_except(predicted, observed))


def first_reason(entries: DataFrame, included: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first entry by ``order``; keys that are included after all have none."""
    one = F.struct(*order, *(c for c in entries.columns if c not in (key, *order)))
    first = entries.groupBy(key).agg(F.min(one).alias("_e")).select(key, "_e.*")
    return first.join(included.select(key).distinct(), key, "left_anti")


def pending(wanted: DataFrame, present: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Wanted rows, the first of each key, with ``is_present``."""
    one = F.struct(*order, *(c for c in wanted.columns if c not in (key, *order)))
    first = wanted.groupBy(key).agg(F.min(one).alias("_e")).select(key, "_e.*")
    here = present.select(key).distinct().withColumn("_here", F.lit(True))
    return first.join(here, key, "left").withColumn("is_present", F.coalesce("_here", F.lit(False))).drop("_here")


def plan_matches(matches: DataFrame, competitions: list[str]) -> DataFrame:
    """Every match with ``reason``: null if it was played in a wanted competition and has maps, else why it is left out."""
    reason = (
        F.when(~F.coalesce(F.col("competition_id").isin(*competitions), F.lit(False)), "other competition")
        .when(F.coalesce(F.upper("status"), F.lit("")) != "FINISHED", "not played")
        .when(F.coalesce(F.size("map_picks"), F.lit(0)) < 1, "no maps")
    )
    return matches.withColumn("reason", reason)


def route_deaths(rounds: DataFrame, deaths: DataFrame, unit: list[str]) -> DataFrame:
    """The earliest death of each own player of a round at or after its start: victim_id, t_s and victim_area."""
    own = deaths.join(rounds.select(*unit, "lineup_key"), unit).where("victim_lineup_key = lineup_key AND t_s >= 0")
    return own.groupBy(*unit, "victim_id").agg(F.min(F.struct("t_s", "victim_area")).alias("d")).select(*unit, "victim_id", "d.t_s", "d.victim_area")


def count_lines(bars: DataFrame, block: list[str], kinds: list[str], threshold: int) -> DataFrame:
    """Bars of throws worth a line, in order within a block: somebody threw, often enough; by kind, most throws first."""
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("grenade_type"))
    some = bars.where((F.col("throws") > 0) & (F.col("n") >= least_rounds(threshold, F.col("m"))))
    w = Window.partitionBy(*block).orderBy(F.when(kind > 0, kind).otherwise(len(kinds) + 1), F.col("throws").desc(), "grenade_type")
    return some.withColumn("line", F.row_number().over(w))


def target_lines(uses: DataFrame, block: list[str], threshold: int, k: int) -> DataFrame:
    """Uses that repeat, of the k most used targets of a block, in order: most rounds first, then by target, origin and time."""
    kept = top_groups(uses.where((F.col("n") >= least_rounds(threshold, F.col("m"))) & F.col("target").isNotNull()), block, ["target"], "n", k)
    w = Window.partitionBy(*block).orderBy(F.col("n").desc(), "target", F.col("from_area").asc_nulls_last(), "bucket")
    return kept.withColumn("line", F.row_number().over(w))


def death_lines(deaths: DataFrame, block: list[str], threshold: int, k: int) -> DataFrame:
    """Areas of first deaths that repeat, the k most frequent of a block with ties, in order."""
    kept = top_with_ties(deaths.where(F.col("n") >= least_rounds(threshold, F.col("m"))), block, "n", k)
    w = Window.partitionBy(*block).orderBy(F.col("n").desc(), F.col("area").asc_nulls_last())
    return kept.withColumn("line", F.row_number().over(w))


def shown_points(rows: DataFrame, skipped: list[float], at: str = "sample_t_s") -> DataFrame:
    """Rows of sample points that aren't skipped; equal means within a millionth."""
    out = F.lit(False)
    for s in skipped:
        out = out | (F.abs(F.col(at) - s) <= 1e-6)
    return rows.where(~F.coalesce(out, F.lit(False)))


def of_lineups(rows: DataFrame, lineups: DataFrame, columns: list[str], key: str = "lineup_key") -> DataFrame:
    """Rows in which any of the columns is one of the lineups; an unknown lineup (null) is none, and no row repeats."""
    wanted = lineups.select(key).where(F.col(key).isNotNull()).distinct()
    out, flags = rows, []
    for k, c in enumerate(columns):
        own = wanted.select(F.col(key).alias(f"_k{k}"), F.lit(True).alias(f"_in{k}"))
        out = out.join(own, F.col(c) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        flags.append(F.coalesce(F.col(f"_in{k}"), F.lit(False)))
    some = flags[0]
    for f in flags[1:]:
        some = some | f
    return out.where(some).drop(*(f"_in{k}" for k in range(len(columns))))


def habits(anomalies: DataFrame, matches: int) -> DataFrame:
    """Unusual positions seen in enough different matches to be a habit."""
    return anomalies.where(F.col("matches") >= matches)


def by_round_type(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves of a map regrouped from side over type to type over side, in the order of types: sides is an array of (side, rounds)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("round_type"))
    grouped = leaves.groupBy("map_name", "round_type").agg(F.array_sort(F.collect_list(F.struct("side", "rounds"))).alias("sides"))
    return grouped.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def pixel(x: Column, y: Column, left: float, top: float, scale: float) -> tuple[Column, Column]:
    """A point of the world on the map's image: y grows downwards there."""
    return (x - left) / scale, (F.lit(top) - y) / scale


def grid_square(x: Column, y: Column, left: float, top: float, width: float) -> Column:
    """The name of the square of a lettered grid that holds a point: A1 is at the upper left."""
    column, row = F.floor((x - left) / width).cast("int"), F.floor((F.lit(top) - y) / width).cast("int")
    return F.when(column.between(0, 25) & (row >= 0), F.concat(F.char(column + 65), (row + 1).cast("string")))


def seconds_label(seconds: Column) -> Column:
    """Seconds as text with a comma: 7,5 s; whole ones without a fraction."""
    return F.concat(F.replace(F.regexp_replace(F.format_string("%.3f", seconds.cast("double")), r"\.?0+$", ""), F.lit("."), F.lit(",")), F.lit(" s"))


def round_list(classified: DataFrame) -> DataFrame:
    """The rows of a round list: number, class, readable players as a ratio and whole units per player."""
    ratio = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("players_buy_end").cast("string"))
    return classified.select("map_demo_id", "round_no", "round_type", "equip_pp", ratio("players_armed_buy_end").alias("armed"), ratio("buyers").alias("buyers"))
