"""Teams from changing rosters: clusters by shared players, roster selection, and names by votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.operators import overlaps as O
from tellmark.operators.distributions import global_rank, most_frequent, null_dominant_max
from tellmark.operators.matching import overlaps
from tellmark.session import cut


def factions(observations: DataFrame, key: str) -> DataFrame:
    """One row per faction: its members, distinct matches, first and last sighting (the last is null if one is unknown)."""
    return observations.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("roster")))).alias("members"),
        F.countDistinct("match_id").alias("matches"),
        F.min("observed_at").alias("first_seen"),
        null_dominant_max("observed_at").alias("last_seen"),
    )


#: Groups of a unit that are clustered in one row; more are clustered in rounds. Both ways give the same clusters.
FOLD = 512
#: Bits of a group's place within its unit.
PLACES = 40


def cluster_in_order(groups: DataFrame, by: list[str], key: str, members: str, order: str, common: int) -> DataFrame:
    """(by, key, cluster): each group, in order, joins the cluster whose first group shares most members, if at least ``common``.

    The earlier cluster wins a tie, no cluster starts a new one. The order matters
    and only first groups are compared, so this is a fold over the ordered groups
    of each ``by``, not connected components. Leagues of at most ``FOLD`` groups are
    folded in one row each; larger ones are clustered in rounds, and so never are
    in one row or task.
    """
    ranks = {"_n": F.count("*").over(Window.partitionBy(*by)), "_place": F.row_number().over(Window.partitionBy(*by).orderBy(order, key))}
    sized = cut(groups.select(*by, key, members, order).withColumns(ranks))
    small = _folded(sized.where(F.col("_n") <= FOLD), by, key, members, order, common)
    large = sized.where(F.col("_n") > FOLD)
    if large.isEmpty():
        return small
    return small.unionByName(_in_rounds(large, by, key, members, common))


def _folded(groups: DataFrame, by: list[str], key: str, members: str, order: str, common: int) -> DataFrame:
    row = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(members).alias("m"))
    kind = dict(groups.dtypes)
    zero = F.struct(
        F.expr(f"CAST(array() AS array<struct<k: {kind[key]}, m: {kind[members]}>>)").alias("heads"),
        F.expr(f"CAST(array() AS array<struct<k: {kind[key]}, c: {kind[key]}>>)").alias("out"),
    )

    def step(acc, x):
        shared = F.transform(acc["heads"], lambda h, i: F.struct(F.size(F.array_intersect(h["m"], x["m"])).alias("n"), (-i).alias("i"), h["k"].alias("k")))
        best = F.array_max(shared)
        joins = F.coalesce(best["n"] >= common, F.lit(False))
        head = F.when(joins, best["k"]).otherwise(x["k"])
        grown = F.when(joins, acc["heads"]).otherwise(F.concat(acc["heads"], F.array(F.struct(x["k"].alias("k"), x["m"].alias("m")))))
        return F.struct(grown.alias("heads"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), head.alias("c")))).alias("out"))

    folded = groups.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_g"))
    return folded.select(*by, F.explode(F.aggregate("_g", zero, step, lambda a: a["out"])).alias("x")).select(*by, F.col("x.k").alias(key), F.col("x.c").alias("cluster"))


def _in_rounds(groups: DataFrame, by: list[str], key: str, members: str, common: int) -> DataFrame:
    """The same clusters of groups with their ``_place``, without pairs of all groups: only first groups are compared with the others.

    Groups come in batches, each as long as all before it. Those of a batch near a
    first group of an earlier batch join; the others are paired among themselves. Of
    these a group is first as soon as every earlier one near it is known to have
    joined another, and joins as soon as one near it is first. At the end every group
    that joins is compared with its unit's first groups. Groups of fewer than
    ``common`` members are near none.
    """
    units = groups.select(*by).distinct().withColumn("_unit", F.row_number().over(Window.orderBy(*by)).cast("long")).withColumnsRenamed({c: f"_u_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in by]
    ident = (F.shiftleft("_unit", PLACES) + F.col("_place")).alias("id")
    ranked = groups.join(F.broadcast(cut(units)), same).select(*by, key, ident, F.col("_place").alias("place"), F.array_distinct(F.filter(members, lambda m: m.isNotNull())).alias("_m"))
    able = ranked.where(F.size("_m") >= max(common, 1)).select("id", "place", "_m")
    unit = lambda k: F.shiftright(k, PLACES)
    # a member counts within its own unit only; sets are cut and joined as arrays
    m = F.concat_ws("\0", unit("id").cast("string"), F.col("member").cast("string")).alias("m")
    named = lambda df, name: df.select("id", F.explode("_m").alias("member")).select(F.col("id").alias(name), m)
    left = lambda df: named(df, "later")
    right = lambda df: named(df, "earlier")
    last = able.agg(F.max("place")).first()[0] or 0
    heads, low, high = None, 0, max(FOLD, 32)
    while low < last:
        batch = able.where((F.col("place") > low) & (F.col("place") <= high))
        if heads is not None:
            near_old = O.firsts(left(batch), right(able.where(F.col("place") <= low).join(heads, "id", "left_semi")), "later", "earlier", "m", -1, unit)
            batch = batch.join(near_old.where(F.col("_top") >= common).select(F.col("_left").alias("id")), "id", "left_anti")
        batch = cut(batch)
        a, b = left(batch), right(batch)
        near = cut(O.pairs(a, b, "later", "earlier", "m", common, -1, None, unit))
        # is a group first? unknown while it isn't settled
        waiting = near.select(F.col("later").alias("id"), F.lit(True).alias("_waits")).distinct()
        state = cut(batch.select("id").distinct().join(waiting, "id", "left").select("id", F.when(F.col("_waits").isNull(), True).alias("first")))
        while not state.where("first IS NULL").isEmpty():
            known = near.join(state.withColumnRenamed("id", "earlier"), "earlier")
            told = known.groupBy(F.col("later").alias("id")).agg(F.coalesce(F.bool_or("first"), F.lit(False)).alias("_joins"), F.count_if(F.col("first").isNull()).alias("_open"))
            settled = F.when(F.col("_joins"), False).when(F.col("_open") == 0, True)
            state = cut(state.join(told, "id", "left").select("id", F.coalesce("first", settled).alias("first")))
        fresh = state.where("first").select("id")
        heads = cut(fresh if heads is None else heads.unionByName(fresh))
        low, high = high, 2 * high
    if heads is None:
        return ranked.select(*by, key, F.col(key).alias("cluster"))
    rest = left(able.join(heads, "id", "left_anti"))
    taken = O.firsts(rest, right(able.join(heads, "id", "left_semi")), "later", "earlier", "m", -1, unit).select(F.col("_left").alias("id"), F.col("_right").alias("_of"))
    names = ranked.select(F.col("id").alias("_of"), F.col(key).alias("cluster"))
    out = ranked.join(taken, "id", "left").withColumn("_of", F.coalesce("_of", "id"))
    return out.join(names, "_of").select(*by, key, "cluster")


def standing_teams(observations: DataFrame, by: list[str], common: int) -> DataFrame:
    """Teams with their standing rosters from observed lineups; one row per team.

    ``observations`` holds by, match_id, faction_id, name, played, observed_at and
    members, an array of (player_id, nickname). Factions join in the order they were
    first observed (unknown moments last) as in ``cluster_in_order``; a team's key is
    its first faction. A player belongs to the team that saw them last (released
    elsewhere); equally late or unknown moments are shared and move nobody. Names
    and nicknames are the most frequent, ties by lower case, then as they stand.
    """
    moment = F.struct(F.col("observed_at").isNull().alias("late"), F.col("observed_at").alias("at"), F.col("match_id").alias("match_id"), F.col("faction_id").alias("faction_id"))
    met = observations.withColumn("_moment", moment)
    players = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("members.player_id")), lambda p: p.isNotNull())))
    sets = met.groupBy(*by, "faction_id").agg(F.min("_moment").alias("_first"), players.alias("_members"))
    clusters = cluster_in_order(sets, by, "faction_id", "_members", "_first", common)
    team = [*by, "team_key"]
    keys = cut(clusters.withColumnRenamed("cluster", "team_key"))
    # a team's rows are brought together once for its players and once for all else; what is grouped by more stays there
    whole = lambda *columns: met.select(*by, "faction_id", *columns).join(keys, [*by, "faction_id"]).repartition(*team)

    def voted(value: str) -> Column:
        """How a value with ``_n`` votes stands, null for none: the least is the most frequent."""
        return F.when(F.col(value) != "", F.struct((-F.col("_n")).alias("n"), F.lower(value).alias("low"), F.col(value).alias("v")))

    people = whole("observed_at", "members").select(*team, "observed_at", F.explode("members").alias("_m")).select(*team, "observed_at", "_m.*")
    named = people.groupBy(*team, "player_id", "nickname").agg(null_dominant_max("observed_at").alias("_last"), F.count("*").alias("_n"))
    last = named.groupBy(*team, "player_id").agg(null_dominant_max("_last").alias("_last"), F.min(voted("nickname"))["v"].alias("nickname"))
    w = Window.partitionBy(*by, "player_id")
    newest = F.max("_last").over(w)
    last = last.withColumns({"_teams": F.count("*").over(w), "_unknown": F.count_if(F.col("_last").isNull()).over(w), "_newest": newest})
    last = last.withColumn("_top", F.count_if(F.col("_last") == F.col("_newest")).over(w))
    verdict = (
        F.when(F.col("_teams") == 1, "own").when(F.col("_unknown") > 0, "shared").when(F.col("_last") < F.col("_newest"), "released")
        .when(F.col("_top") == 1, "own").otherwise("shared")
    )
    # a null player has no name
    member = F.struct(F.col("nickname").isNull().alias("nameless"), "nickname", "player_id")
    full = last.withColumns({"_verdict": verdict, "nickname": F.when(F.col("player_id").isNotNull(), F.col("nickname"))})
    bare = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["player_id"].alias("player_id"), x["nickname"].alias("nickname")))
    rosters = full.groupBy(*team).agg(
        bare(F.when(F.col("_verdict") != "released", member)).alias("roster"), bare(F.when(F.col("_verdict") == "released", member)).alias("released"),
        F.array_sort(F.collect_list(F.when(F.col("_verdict") == "shared", F.col("player_id")))).alias("shared_players"),
    )
    # matches and factions stand where their first observation does
    seen = F.struct(F.col("_moment").alias("o"), F.coalesce("played", F.lit(False)).alias("p"))
    per_name = whole("_moment", "played", "name").groupBy(*team, "name").agg(F.collect_list(seen).alias("_o"), F.count("*").alias("_n"))
    own = per_name.groupBy(*team).agg(F.array_sort(F.flatten(F.collect_list("_o"))).alias("_o"), F.array_sort(F.collect_list(voted("name"))).alias("_names"))
    ids = lambda rows, c: F.array_distinct(F.transform(rows, lambda x: x["o"][c]))
    best = F.array_min("_names")["v"]
    others = F.array_sort(F.transform(F.filter("_names", lambda x: x["v"] != best), lambda x: F.struct(x["low"].alias("low"), x["v"].alias("v"))))
    parts = own.select(
        *team, ids("_o", "faction_id").alias("faction_ids"), ids("_o", "match_id").alias("match_ids"), F.array_intersect(ids("_o", "match_id"), ids(F.filter("_o", lambda x: x["p"]), "match_id")).alias("played_match_ids"),
        best.alias("name"), F.when(best.isNotNull(), F.transform(others, lambda x: x["v"])).alias("other_names"),
    )
    return parts.join(rosters, team, "left").select(*team, "faction_ids", "match_ids", "played_match_ids", "roster", "released", "shared_players", "name", "other_names")


def select_by_roster(candidates: DataFrame, roster: list[str], full: int, least: int) -> DataFrame:
    """Verdict on each candidate map: regulars, outsiders, class full, partial or null, and why it is out.

    An observed lineup counts before the match roster; a map that was neither
    played for sure nor observed is out, outsiders alone don't put one out.
    """
    regular = F.array(*map(F.lit, sorted(roster)))
    seen = F.coalesce("observed_players", "match_roster")
    out = candidates.withColumn("regulars", F.array_sort(F.array_intersect(seen, regular))).withColumn(
        "outsiders", F.array_sort(F.array_except(seen, regular))
    )
    n = F.size("regulars")
    reason = (
        F.when(~F.col("certainly_played") & F.col("observed_players").isNull(), "not certainly played")
        .when(seen.isNull(), "no players known")
        .when(n < least, "too few regulars")
    )
    kind = F.when(reason.isNull() & (n >= full), "full").when(reason.isNull(), "partial")
    return out.withColumn("roster_class", kind).withColumn("reason", reason)


def lineups_like(lineups: DataFrame, target: str, key: str, member: str, common: int) -> DataFrame:
    """The target and all lineups that share at least ``common`` members with it."""
    pairs = overlaps(lineups.where(F.col(key) == target).withColumnRenamed(key, "_target"), lineups, "_target", key, member)
    return pairs.where((F.col("common") >= common) | (F.col(key) == target)).select(key, "common")


def voted_name(rows: DataFrame, unit: str, key: str, value: str) -> DataFrame:
    """Each key's name by a vote within every unit and then between units; ties go to the smaller name."""
    first = most_frequent(rows, [key, unit], value, "_vote")
    return most_frequent(first, [key], "_vote", value)


def ranked_matches(matches: DataFrame, at: str, key: str) -> DataFrame:
    """Matches with rank 1 for the newest; equal times by key, downwards."""
    return global_rank(matches, [F.col(at).desc_nulls_last(), F.col(key).desc()], "rank")


def find_by_name(teams: DataFrame, query: str, key: str, name: str) -> DataFrame:
    """Teams that fit a query best: exact name, else exact key, else a prefix, else a part of the name."""
    q, low = query.strip().lower(), F.lower(F.trim(name))
    tier = F.when(low == q, 0).when(F.col(key) == query.strip(), 1).when(low.startswith(q), 2).when(F.contains(low, F.lit(q)), 3)
    ranked = teams.withColumn("tier", tier).where("tier IS NOT NULL")
    best = F.broadcast(ranked.agg(F.min("tier").alias("_best")))  # one row
    return ranked.crossJoin(best).where("tier = _best").drop("_best")
