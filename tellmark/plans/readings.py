"""Readings, memberships and small rules applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellmark.functions import scalars as C
from tellmark.operators import distributions as D
from tellmark.operators import enrichment as E
from tellmark.operators import evidence as V
from tellmark.operators import matching as M
from tellmark.operators import report as Q
from tellmark.operators import rounds as G
from tellmark.plans.catalogue import query
from tellmark.plans.game import _ROUNDS, rounds_of
from tellmark.plans.telemetry import _THROW_ROWS, _throw_tables
from tellmark.session import table
from tellmark.sources import archive as A
from tellmark.sources import catalog as K


@query("SELECT o_custkey AS unit, l_returnflag AS lineup_key, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS members FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 13 <> 0 GROUP BY 1, 2")
def lineup_member_sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(F.col("o_custkey").alias("unit"), F.col("l_returnflag").alias("lineup_key"), F.when(F.col("l_suppkey") % 13 != 0, F.col("l_suppkey")).alias("player_id"))
    return A.lineup_members(rows, "unit").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT user_id AS unit, event_id AS tick, event_type, value FROM events e WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey % 500 = event_id % 500)")
def wanted_tick_rows(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), (F.col("event_id") % 500).alias("tick"), "event_id", "event_type", "value")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 500).alias("tick"))
    return E.wanted_ticks(ticks, wanted, ["unit"]).select("unit", F.col("event_id").alias("tick"), "event_type", "value")


@query("""SELECT nullif(trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS area, event_id % 3 = 0 AS is_alive, CAST(event_id % 11 AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, value AS z FROM events""")
def cloud_frames(spark, sf_dir):
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("place"), (k % 3).alias("life_state"), (k % 11).alias("x"), F.col("user_id").alias("y"), F.col("value").alias("z")
    )
    return E.cloud_observations(raw)


@query("SELECT CAST(event_id AS INTEGER) AS tick, CAST(user_id AS VARCHAR) AS thrower_id, event_type AS grenade_type, value AS x, CAST(event_id % 9 AS DOUBLE) AS y, CAST(user_id AS DOUBLE) AS z FROM events")
def trajectory_frames(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("user_id").alias("steamid"), F.col("event_type").alias("name"), F.col("value").alias("X"), (F.col("event_id") % 9).alias("Y"))
    raw = raw.withColumn("Z", F.col("steamid"))
    return E.trajectory_frame(raw, {"t": "tick", "steamid": "thrower_id", "name": "grenade_type", "X": "x", "Y": "y", "Z": "z"})


@query("""SELECT p_partkey, sha256('{"size":' || p_size || ',"brand":"' || p_brand || '"}') AS key FROM part""")
def parameter_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.params_key(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))).alias("key"))


@query("SELECT CAST(count(*) FILTER (l_partkey % 23 = 0) AS BIGINT) AS without_owner, CAST(count(*) FILTER (l_partkey % 23 <> 0) AS BIGINT) AS kept, CAST(count(*) FILTER (l_partkey % 23 <> 0 AND (l_returnflag IS NULL OR l_returnflag NOT IN ('R', 'N'))) AS BIGINT) AS unknown FROM lineitem")
def owners_and_types(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 23 != 0, F.col("l_suppkey")).alias("thrower_id"), "l_returnflag")
    kept, dropped = E.without_owner(rows, "thrower_id")
    of_kept = kept.agg(F.count("*").alias("kept"), E.unknown_values("l_returnflag", ["R", "N"]))
    return rows.agg(dropped).crossJoin(F.broadcast(of_kept))  # single rows


@query(f"WITH {_THROW_ROWS}, rd AS (SELECT ep.unit, grenade_no, round_raw, start_tick FROM ep JOIN w ON w.unit = ep.unit AND tick BETWEEN start_tick AND stop_tick WHERE event_kind = 'grenade_thrown') SELECT unit, grenade_no, event_kind, tick, round_raw, start_tick FROM ep JOIN rd USING (unit, grenade_no)")
def throw_rounds(spark, sf_dir):
    t = _throw_tables(spark, sf_dir)
    return E.event_rounds(t["endpoints"], t["windows"], ["unit"], 1000).select("unit", "grenade_no", "event_kind", "tick", "round_raw", "start_tick")


@query(f"WITH {_THROW_ROWS} SELECT ep.unit, grenade_no, ep.thrower_id, area AS own_area FROM ep LEFT JOIN ps ON ps.unit = ep.unit AND ps.tick = ep.tick AND ps.player_id = ep.thrower_id WHERE event_kind = 'grenade_thrown'")
def thrower_areas(spark, sf_dir):
    t = _throw_tables(spark, sf_dir)
    rows = t["endpoints"].where("event_kind = 'grenade_thrown'").select("unit", "grenade_no", "tick", "thrower_id")
    return E.own_areas(rows, t["positions"], ["unit"], "thrower_id").select("unit", "grenade_no", "thrower_id", "own_area")


@query("""WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM g)
 SELECT p_brand, CAST(n AS BIGINT) AS n, CAST((SELECT greatest(count(*) - 10, 0) FROM g) AS BIGINT) AS left_out FROM r WHERE k <= 10""")
def capped_brands(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    rows, left_out = D.capped(g, [F.col("n").desc(), F.col("p_brand")], 10)
    return rows.crossJoin(F.broadcast(g.agg(left_out)))  # a single row


@query(f"WITH {_ROUNDS}, a AS (SELECT map_name, side, round_type, count(*) AS n, count(DISTINCT match_id) AS matches FROM r WHERE o_orderkey % 97 = 0 GROUP BY 1, 2, 3) SELECT map_name, side, round_type, CAST(n AS BIGINT) AS n, CAST(matches AS BIGINT) AS matches FROM a WHERE matches >= 3")
def repeated_habits(spark, sf_dir):
    some = rounds_of(spark, sf_dir).where("o_orderkey % 97 = 0").groupBy("map_name", "side", "round_type").agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"))
    return V.habits(some, 3)


_DEATHS = "dt AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN 'L' || (user_id % 20) END AS victim_lineup_key, CASE WHEN event_id % 4 <> 0 THEN 'L' || (event_id % 20) END AS attacker_lineup_key FROM events), wn AS (SELECT DISTINCT 'L' || (c_custkey % 3) AS lineup_key FROM customer)"


@query(f"WITH {_DEATHS} SELECT event_id FROM dt WHERE coalesce(victim_lineup_key IN (SELECT lineup_key FROM wn), FALSE) OR coalesce(attacker_lineup_key IN (SELECT lineup_key FROM wn), FALSE)")
def deaths_of_lineups(spark, sf_dir):
    k, name = F.col("event_id"), lambda n: F.concat(F.lit("L"), n.cast("string"))
    deaths = table(spark, sf_dir, "events").select("event_id", F.when(k % 6 != 0, name(F.col("user_id") % 20)).alias("victim_lineup_key"), F.when(k % 4 != 0, name(k % 20)).alias("attacker_lineup_key"))
    lineups = table(spark, sf_dir, "customer").select(name(F.col("c_custkey") % 3).alias("lineup_key"))
    return V.of_lineups(deaths, lineups, ["victim_lineup_key", "attacker_lineup_key"]).select("event_id")


def _lineups(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("team"), F.col("s_suppkey").alias("lineup_key"))
    classified = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("lineup_key"))
    return found, classified


_CANDIDATES = "ca AS (SELECT s_nationkey % 5 AS team, s_suppkey AS lineup_key FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49))"


@query(f"WITH {_CANDIDATES} SELECT lineup_key FROM ca")
def candidate_lineups(spark, sf_dir):
    return K.candidate_lineups(*_lineups(spark, sf_dir))


@query(f"WITH {_CANDIDATES} SELECT team, coalesce(min(lineup_key) FILTER (lineup_key % 4 = 3), min(lineup_key)) AS lineup_key FROM ca GROUP BY 1")
def report_lineups(spark, sf_dir):
    found, classified = _lineups(spark, sf_dir)
    candidates = found.join(K.candidate_lineups(found, classified), "lineup_key")
    return K.report_keys(candidates, found.where("lineup_key % 4 = 3"), ["team"])


@query(f"WITH {_CANDIDATES} SELECT lineup_key FROM ca WHERE lineup_key % 3 <> 1")
def lineups_left_out(spark, sf_dir):
    found, classified = _lineups(spark, sf_dir)
    return K.lineups_left_out(K.candidate_lineups(found, classified), found.where("lineup_key % 3 = 1"))


@query(f"""WITH {_ROUNDS}, p AS (SELECT CAST(map_demo_id AS BIGINT) // 3 AS unit, lineup_key || (CAST(map_demo_id AS BIGINT) % 3) AS team, round_no FROM r WHERE o_orderkey % 5 <> 0 UNION ALL SELECT CAST(map_demo_id AS BIGINT) // 3, lineup_key || (CAST(map_demo_id AS BIGINT) % 3), round_no FROM r WHERE o_orderkey % 31 = 1)
 SELECT unit, round_no, CAST(count(DISTINCT team) AS BIGINT) AS teams, CAST(count(*) AS BIGINT) AS rows FROM p GROUP BY 1, 2 HAVING count(DISTINCT team) > 2 OR count(*) > count(DISTINCT team)""")
def opponent_faults(spark, sf_dir):
    r = rounds_of(spark, sf_dir)
    demo = F.col("map_demo_id").cast("long")
    team = F.concat("lineup_key", (demo % 3).cast("string")).alias("team")
    row = [F.floor(demo / 3).alias("unit"), team, "round_no"]
    return G.opponent_faults(r.where("o_orderkey % 5 <> 0").select(*row).unionByName(r.where("o_orderkey % 31 = 1").select(*row)), ["unit"], "team")


@query("""WITH t AS (SELECT o_orderkey % 2 * 0 + 4 AS a, 10 AS b, o_orderkey % 3 AS c FROM orders) SELECT 'b' AS name, 'stale' AS fault, string_agg(DISTINCT b, ',' ORDER BY b) AS "values" FROM t HAVING max(b) <> 11 UNION ALL SELECT 'c', 'differs', string_agg(DISTINCT c, ',' ORDER BY c) FROM t HAVING count(DISTINCT c) > 1
 UNION ALL SELECT 'd', 'missing', '' UNION ALL SELECT 'a', 'stale', '' FROM t HAVING max(a) <> 4""")
def threshold_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    rounds = table(spark, sf_dir, "orders").select(F.struct((k % 2 * 0 + 4).alias("a"), F.lit(10).alias("b"), (k % 3).alias("c"), F.lit(None).cast("long").alias("d")).alias("inputs"))
    found = Q.threshold_faults(rounds, "inputs", {"a": 4, "b": 11, "c": 1, "d": 2})
    return found.withColumn("values", F.array_join(F.col("values").cast("array<string>"), ","))


@query(f"WITH {_ROUNDS} SELECT map_name, players_armed_buy_end, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT match_id) AS BIGINT) AS matches, coalesce(bool_or(match_id = 7), FALSE) AS in_newest FROM r WHERE o_orderkey % 7 = 0 GROUP BY 1, 2")
def counts_with_matches(spark, sf_dir):
    return D.counts_with_matches(rounds_of(spark, sf_dir).where("o_orderkey % 7 = 0"), ["map_name"], "players_armed_buy_end", "match_id", F.lit(7))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 60 AS m FROM lineitem WHERE l_orderkey % 3 = 0), t AS (SELECT DISTINCT l_orderkey % 400 AS b, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey % 60 END AS m FROM lineitem WHERE l_orderkey % 3 <> 0)
 SELECT a, b, CAST(count(*) AS BIGINT) AS common FROM s JOIN t USING (m) GROUP BY 1, 2 HAVING count(*) >= 8""")
def overlaps_at_least(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = F.col("l_partkey") % 60
    left = li.where("l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("a"), m.alias("m"))
    right = li.where("l_orderkey % 3 <> 0").select((F.col("l_orderkey") % 400).alias("b"), F.when(F.col("l_linenumber") == 1, 0).otherwise(m).alias("m"))
    return M.overlaps_at_least(left, right, "a", "b", "m", 8)
