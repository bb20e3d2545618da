"""Routes: each player's way through a round as junctions, the tree of a round's ways, and ways that rounds repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellmark.operators.distributions import global_rank
from tellmark.operators.paths import fold_returns

STEP = "struct<fate: string, label: string, flag: string, other: string, other_flag: string, seconds: double, kept: boolean>"
PLACE = ["label", "flag", "other", "other_flag"]


def _step(fate: str, label: Column, flag: Column, seconds: Column, kept: Column, other: Column | None = None, other_flag: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    other, other_flag = none if other is None else other, none if other_flag is None else other_flag
    return F.struct(
        F.lit(fate).alias("fate"), label.alias("label"), flag.alias("flag"), other.alias("other"), other_flag.alias("other_flag"),
        seconds.cast("double").alias("seconds"), kept.alias("kept"),
    ).cast(STEP)


def _same(x: Column, y: Column) -> Column:
    return x["label"].eqNullSafe(y["label"]) & x["flag"].eqNullSafe(y["flag"])


def _once(path: str) -> Column:
    """The steps that differ from the one before."""
    return F.filter(path, lambda x, i: (i == 0) | ~_same(x, F.get(F.col(path), i - 1)))


def junction_paths(seen: DataFrame, deaths: DataFrame, unit: list[str]) -> DataFrame:
    """One row per unit and player: path, an array of STEP, and last_seen.

    ``seen`` holds unit, player_id, sample_kind, sample_t_s, is_alive, label, flag
    and kept, a row for every player at every moment of the round, dead or alive;
    ``deaths`` holds unit, player_id, t_s, label and flag. Of a path remain its
    first and last place and the kept ones between them, no place twice in a row.
    A place gone to and left again (A, B, A) is A and the one step B with other A.
    The path ends with ``died`` if the player was killed by the round's last
    moment, with ``gone`` if a later moment doesn't see them alive. Of several rows
    of a player and moment the least alive one counts, of several deaths the
    earliest at or after the round's start.
    """
    keys = [*unit, "player_id"]
    place = F.struct("label", "flag", "kept")
    per = seen.where("sample_kind = 'time'").groupBy(*keys, "sample_t_s").agg(F.min(F.when(F.col("is_alive"), place)).alias("p"))
    points = per.groupBy(*unit).agg(F.array_sort(F.collect_set("sample_t_s")).alias("_points"))
    own = deaths.where("t_s >= 0").groupBy(*keys).agg(F.min(F.struct("t_s", "label", "flag")).alias("_death"))
    at = F.when(F.col("p").isNotNull(), F.struct("sample_t_s", "p.label", "p.flag", "p.kept"))
    walked = per.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("_path"), F.max(F.when(F.col("p").isNotNull(), F.col("sample_t_s"))).alias("last_seen"))
    last = F.size("_path") - 1
    walked = walked.withColumn("_path", _once("_path")).withColumn("_path", F.filter("_path", lambda x, i: x["kept"] | (i == 0) | (i == last)))
    walked = walked.withColumn("_path", _once("_path"))
    steps = F.transform("_path", lambda x: _step("seen", x["label"], x["flag"], x["sample_t_s"], x["kept"]))
    walked = walked.withColumn("_path", steps).withColumn("_path", fold_returns(F.col("_path"), STEP, _same, lambda a, b: F.array(
        a, _step("seen", b["label"], b["flag"], b["seconds"], b["kept"], a["label"], a["flag"])
    )))
    joined = walked.join(points, unit).join(own, keys, "left")
    final, d = F.element_at("_points", -1), F.col("_death")
    lost = F.get(F.filter("_points", lambda m: F.col("last_seen").isNull() | (m > F.col("last_seen"))), F.lit(0))
    end = (
        F.when(d["t_s"] <= final, F.array(_step("died", d["label"], d["flag"], d["t_s"], F.lit(True))))
        .when(F.col("last_seen").isNull() | (F.col("last_seen") < final), F.array(_step("gone", F.lit(None), F.lit(None), lost, F.lit(True))))
        .otherwise(F.expr(f"CAST(array() AS array<{STEP}>)"))
    )
    return joined.select(*keys, F.concat("_path", end).alias("path"), "last_seen")


def route_tree(paths: DataFrame, unit: list[str]) -> DataFrame:
    """The tree of a unit's paths as rows: parent and node, the places so far, depth, STEP's columns, players, leaf, stays and place.

    Every player of a node is in one of its children or it has none: who stops
    where others go on becomes a child at the same place (``stays``, at the moment
    they were last seen). Deaths in one place at different moments are different
    nodes. place orders a division: seen, died, gone; most players; a death's
    moment; then by name, nameless last.
    """
    names = lambda x: F.struct(x["fate"].alias("fate"), *(x[c].alias(c) for c in PLACE), F.when(x["fate"] == "died", x["seconds"]).alias("at"))
    rows = paths.withColumn("_node", F.transform("path", names)).withColumn("_full", F.size("path"))
    rows = rows.select(*unit, "last_seen", "_full", "_node", F.posexplode("path").alias("_i", "_s"))
    ends = F.col("_full") == F.col("_i") + 1
    nodes = rows.withColumn("node", F.slice("_node", F.lit(1), F.col("_i") + 1)).groupBy(*unit, "node").agg(
        F.count("*").alias("players"), F.count_if(ends).alias("_staying"), F.min(F.when(ends, F.col("last_seen"))).alias("_stayed"), F.min("_s.seconds").alias("seconds")
    )
    head = F.element_at("node", -1)
    flat = nodes.select(*unit, F.slice("node", F.lit(1), F.size("node") - 1).alias("parent"), "node", F.size("node").alias("depth"), head.alias("_h"), "players", "seconds", (F.col("_staying") == F.col("players")).alias("leaf"), F.lit(False).alias("stays"), "_staying", "_stayed")
    divided = flat.where("NOT leaf AND _staying > 0").withColumns(
        {"parent": F.col("node"), "depth": F.col("depth") + 1, "players": F.col("_staying"), "seconds": F.coalesce("_stayed", "seconds"), "leaf": F.lit(True), "stays": F.lit(True)}
    )
    fate = F.col("fate")
    order = [
        F.when(fate == "seen", 0).when(fate == "died", 1).otherwise(2), F.col("players").desc(), F.when(fate == "died", F.col("seconds")).otherwise(0.0),
        F.col("label").asc_nulls_last(), F.col("other").asc_nulls_last(), F.col("flag").asc_nulls_last(), F.col("other_flag").asc_nulls_last(), F.col("stays"),
    ]
    both = flat.unionByName(divided).select(*unit, "parent", "node", "depth", "_h.fate", *(f"_h.{c}" for c in PLACE), "players", "seconds", "leaf", "stays")
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*unit, "parent").orderBy(*order)))


def merged_leaves(tree: DataFrame, unit: list[str], text: Column) -> DataFrame:
    """A division's parts as they read: leaves of one text are one part with their players, others stay apart; in order."""
    own = F.when(~F.col("leaf"), F.col("place"))
    parts = tree.withColumn("text", text).groupBy(*unit, "parent", "text", own.alias("_own")).agg(F.sum("players").alias("players"), F.min("place").alias("place"))
    return parts.drop("_own")


def routes(rounds: DataFrame, tree: DataFrame, demos: DataFrame) -> DataFrame:
    """One row per round, newest demo first, then by number: its steps in order (empty without a route) and its rank.

    ``demos`` holds map_demo_id and rank; a demo it doesn't rank comes last.
    """
    unit = ["map_demo_id", "round_no"]
    steps = tree.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("depth", "parent", "place", "fate", *PLACE, "players", "seconds", "stays"))).alias("steps"))
    placed = rounds.join(steps, unit, "left").join(demos.select("map_demo_id", F.col("rank").alias("_rank")), "map_demo_id", "left")
    ranked = global_rank(placed, [F.col("_rank").asc_nulls_last(), F.col("map_demo_id"), F.col("round_no")], "rank").drop("_rank")
    return ranked.withColumn("steps", F.coalesce("steps", F.expr(f"CAST(array() AS {dict(steps.dtypes)['steps']})")))


def route_patterns(paths: DataFrame, rounds: DataFrame, block: list[str], unit: list[str], match: str, spawns: list[str], newest: str | None, least: int = 2) -> DataFrame:
    """Ways that at least ``least`` rounds of a block repeat: path, stayed, rounds, matches, players (most in a round) and newest.

    A way begins at the first kept place that is no spawn; players without one only
    count into the side. Moved: two or more begin with it and not all were last
    seen alive at its end. Stayed: who was, one player suffices. A way of one place
    counts only if it isn't the whole side's (or is one player's). newest tells
    whether the named match is among the rounds', null if none is named.
    """
    side = F.count("*").over(Window.partitionBy(*unit))
    seen = F.filter("path", lambda x: x["fate"] == "seen")
    begins = lambda x: x["kept"] & ~F.coalesce(x["label"].isin(*spawns), F.lit(False))
    ways = paths.select(*unit, side.alias("_side"), seen.alias("_seen"), (~F.exists("path", lambda x: x["fate"] != "seen")).alias("_alive"))
    first = F.array_position(F.transform("_seen", begins), True)
    ways = ways.withColumn("_at", first).where("_at > 0").withColumn("_way", F.slice("_seen", F.col("_at").cast("int"), F.size("_seen")))
    ways = ways.withColumn("_way", F.transform("_way", lambda x: F.struct(*(x[c].alias(c) for c in PLACE)))).withColumn("_d", F.explode(F.sequence(F.lit(1), F.size("_way"))))
    here = F.col("_alive") & (F.col("_d") == F.size("_way"))
    groups = ways.withColumn("_here", here).withColumn("path", F.slice("_way", F.lit(1), F.col("_d"))).groupBy(*unit, "_side", "path").agg(
        F.count("*").alias("_reach"), F.count_if("_here").alias("_stay")
    )
    long = F.size("path") > 1
    moved = (F.col("_reach") >= 2) & (F.col("_reach") > F.col("_stay")) & (long | (F.col("_reach") < F.col("_side")))
    stayed = (F.col("_stay") == 1) | ((F.col("_stay") > 1) & (long | (F.col("_stay") < F.col("_side"))))
    kinds = F.array(F.struct(F.lit(False).alias("stayed"), F.when(moved, F.col("_reach")).alias("players")), F.struct(F.lit(True).alias("stayed"), F.when(stayed, F.col("_stay")).alias("players")))
    taken = groups.select(*unit, "path", F.explode(kinds).alias("_k")).select(*unit, "path", "_k.*").where("players IS NOT NULL")
    own = rounds.select(*unit, *(c for c in block if c not in unit), *([match] if match not in [*unit, *block] else []))
    among = F.lit(None).cast("boolean") if newest is None else F.max(F.col(match) == newest)
    found = taken.join(own, unit).groupBy(*block, "path", "stayed").agg(
        F.count("*").alias("rounds"), F.countDistinct(match).alias("matches"), F.max("players").alias("players"), among.alias("newest")
    )
    return found.where(F.col("rounds") >= least)


def step_text(step: Column, seconds: Column) -> Column:
    """A step as text: ``label``, ``label<>other``, ``died label@seconds`` or ``gone``; nameless places read ``?``."""
    name = F.coalesce(step["label"], F.lit("?"))
    pair = F.when(step["other"].isNotNull(), F.concat(name, F.lit("<>"), step["other"])).otherwise(name)
    return F.when(step["fate"] == "died", F.concat(F.lit("died "), name, F.lit("@"), seconds.cast("string"))).when(step["fate"] == "gone", "gone").otherwise(pair)
