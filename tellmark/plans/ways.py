"""Routes and standing teams on the driver's tables: a day of events is a round, an hour a moment, five users a side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.operators import rounds as G
from tellmark.operators import routes as W
from tellmark.operators import teams as K
from tellmark.plans.catalogue import query
from tellmark.plans.game import _CLASSIFIED, rounds_of
from tellmark.session import table

UNIT = ["map_demo_id", "round_no"]
SPAWNS = ["signup"]

_SEEN = """e AS (SELECT 'd' || (extract(day FROM ts) % 10) AS map_demo_id, CAST(extract(day FROM ts) // 10 AS INTEGER) AS round_no, user_id % 5 AS player_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'first_contact' ELSE 'time' END AS kind,
 CAST(extract(hour FROM ts) * 60 AS DOUBLE) AS t, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS DOUBLE) AS t_s, CASE WHEN value < 60 THEN event_type ELSE '?' END AS p, value > 1 AS alive, event_type = 'error' AND value > 70 AS dies FROM events)"""

#: each path by its tokens, the alternating runs by a walk over them
_FULL = f"""WITH RECURSIVE {_SEEN}, s AS (SELECT map_demo_id, round_no, player_id, t, min(CASE WHEN alive THEN p END) AS p FROM e WHERE kind = 'time' GROUP BY ALL),
 r AS (SELECT *, lag(p) OVER (PARTITION BY map_demo_id, round_no, player_id ORDER BY t) AS b FROM s WHERE p IS NOT NULL),
 a AS (SELECT *, row_number() OVER o AS i, lead(p) OVER o IS NULL AS ends FROM r WHERE b IS DISTINCT FROM p WINDOW o AS (PARTITION BY map_demo_id, round_no, player_id ORDER BY t)),
 m AS (SELECT *, lag(p) OVER (PARTITION BY map_demo_id, round_no, player_id ORDER BY t) AS c FROM a WHERE i = 1 OR ends OR p IN ('click', 'error', 'signup', '?')),
 k AS (SELECT map_demo_id, round_no, player_id, list(p ORDER BY t) AS toks, list(t ORDER BY t) AS ts FROM m WHERE c IS DISTINCT FROM p GROUP BY ALL),
 walk AS (SELECT map_demo_id, round_no, player_id, toks, ts, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS steps, CAST([] AS DOUBLE[]) AS tm FROM k
 UNION ALL SELECT map_demo_id, round_no, player_id, toks, ts, CASE WHEN back THEN beyond ELSE i + 1 END, steps || CASE WHEN back THEN [toks[i], CASE WHEN toks[i] = '?' THEN toks[i + 1] ELSE toks[i + 1] || '<>' || toks[i] END] ELSE [toks[i]] END,
 tm || CASE WHEN back THEN [ts[i], ts[i + 1]] ELSE [ts[i]] END FROM (SELECT *, i + 2 <= len(toks) AND toks[i + 2] = toks[i] AS back, coalesce(list_min(list_filter(range(i + 3, len(toks) + 1), lambda j: toks[j] <> toks[j - 2])), len(toks) + 1) AS beyond FROM walk WHERE i <= len(toks))),
 u AS (SELECT map_demo_id, round_no, list_sort(list(DISTINCT t)) AS points FROM s GROUP BY 1, 2), pl AS (SELECT map_demo_id, round_no, player_id, max(t) FILTER (p IS NOT NULL) AS last_seen FROM s GROUP BY 1, 2, 3),
 d AS (SELECT map_demo_id, round_no, player_id, min(t_s) AS t_s, arg_min(p, (t_s, p)) AS area FROM e WHERE dies GROUP BY 1, 2, 3),
 j AS (SELECT pl.*, coalesce(steps, []) AS steps, coalesce(tm, []) AS tm, CASE WHEN t_s <= points[-1] THEN 'died ' || area || '@' || t_s WHEN last_seen IS NULL OR last_seen < points[-1] THEN 'gone' END AS fin,
 CASE WHEN t_s <= points[-1] THEN t_s ELSE list_min(list_filter(points, lambda q: last_seen IS NULL OR q > last_seen)) END AS fin_at
 FROM pl JOIN u USING (map_demo_id, round_no) LEFT JOIN (SELECT * FROM walk WHERE i > len(toks)) w USING (map_demo_id, round_no, player_id) LEFT JOIN d USING (map_demo_id, round_no, player_id)),
 f AS (SELECT *, CASE WHEN fin IS NULL THEN steps ELSE steps || [fin] END AS path, CASE WHEN fin IS NULL THEN tm ELSE tm || [fin_at] END AS ats FROM j)"""

_TREE = _FULL + """, x AS (SELECT *, unnest(range(1, len(path) + 1)) AS depth FROM f),
 n AS (SELECT map_demo_id, round_no, path[1:depth] AS node, depth, count(*) AS players, count(*) FILTER (len(path) = depth) AS st, min(last_seen) FILTER (len(path) = depth) AS sl, min(ats[depth]) AS seconds FROM x GROUP BY map_demo_id, round_no, path[1:depth], depth),
 z AS (SELECT map_demo_id, round_no, node[1:depth - 1] AS parent, node, depth, players, seconds, st = players AS leaf, FALSE AS stays FROM n
 UNION ALL SELECT map_demo_id, round_no, node, node, depth + 1, st, coalesce(sl, seconds), TRUE, TRUE FROM n WHERE st > 0 AND st < players),
 h AS (SELECT *, CASE WHEN node[-1] LIKE 'died %' THEN 1 WHEN node[-1] = 'gone' THEN 2 ELSE 0 END AS fate, nullif(CASE WHEN node[-1] = 'gone' THEN '?' ELSE split_part(split_part(replace(node[-1], 'died ', ''), '<>', 1), '@', 1) END, '?') AS label, nullif(split_part(node[-1], '<>', 2), '') AS other FROM z),
 t AS (SELECT *, row_number() OVER (PARTITION BY map_demo_id, round_no, parent ORDER BY fate, players DESC, CASE WHEN fate = 1 THEN seconds ELSE 0 END, label NULLS LAST, other NULLS LAST, stays) AS place FROM h)"""


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), (F.dayofmonth("ts") % 10).cast("string")).alias("map_demo_id"), F.floor(F.dayofmonth("ts") / 10).cast("int").alias("round_no"), (F.col("user_id") % 5).alias("player_id"),
        F.when(F.col("event_id") % 7 == 0, "first_contact").otherwise("time").alias("sample_kind"), (F.hour("ts") * 60).cast("double").alias("sample_t_s"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("t_s"),
        F.when(F.col("value") < 60, F.col("event_type")).alias("label"), (F.col("value") > 1).alias("is_alive"), ((F.col("event_type") == "error") & (F.col("value") > 70)).alias("_dies"),
    )
    label = F.col("label")
    e = e.withColumn("flag", F.when(label == "signup", "coarse")).withColumn("kept", label.isNull() | label.isin("click", "error", "signup"))
    return e.drop("_dies", "t_s"), e.where("_dies").select(*UNIT, "player_id", "t_s", "label", "flag")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.junction_paths(*_rows(spark, sf_dir), UNIT)


def _text(path: str):
    return F.array_join(F.transform(path, lambda x: W.step_text(x, x["seconds"])), ">")


@query(_FULL + " SELECT map_demo_id, round_no, player_id, array_to_string(path, '>') AS path, last_seen FROM f")
def junction_ways(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("path", _text("path"))


def _node(c: str):
    return F.array_join(F.transform(c, lambda x: W.step_text(x, x["at"])), ">").alias(c)


@query(_TREE + " SELECT map_demo_id, round_no, array_to_string(parent, '>') AS parent, array_to_string(node, '>') AS node, CAST(depth AS INTEGER) AS depth, CAST(players AS BIGINT) AS players, seconds, leaf, stays, CAST(place AS INTEGER) AS place FROM t")
def route_divisions(spark, sf_dir):
    tree = W.route_tree(_paths(spark, sf_dir), UNIT)
    return tree.select(*UNIT, _node("parent"), _node("node"), "depth", "players", "seconds", "leaf", "stays", "place")


@query(_TREE + """, q AS (SELECT *, CASE WHEN fate = 1 THEN 'died ' || coalesce(label, '?') || '@' || CAST(floor(seconds / 240) AS BIGINT) ELSE node[-1] END AS text FROM t)
 SELECT map_demo_id, round_no, array_to_string(parent, '>') AS parent, text, CAST(sum(players) AS BIGINT) AS players, CAST(min(place) AS INTEGER) AS place FROM q GROUP BY map_demo_id, round_no, parent, text, CASE WHEN NOT leaf THEN place END""")
def route_parts_as_read(spark, sf_dir):
    tree = W.route_tree(_paths(spark, sf_dir), UNIT)
    text = W.step_text(F.element_at("node", -1), F.floor(F.col("seconds") / 240))
    return W.merged_leaves(tree, UNIT, text).select(*UNIT, _node("parent"), "text", "players", "place")


_ROUNDS = "rd AS (SELECT DISTINCT 'd' || (extract(day FROM ts) % 10) AS map_demo_id, CAST(extract(day FROM ts) // 10 AS INTEGER) AS round_no FROM events UNION ALL SELECT 'd11', 1)"


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, _ = _rows(spark, sf_dir)
    found = seen.select(*UNIT).distinct().unionByName(spark.range(1).select(F.lit("d11").alias("map_demo_id"), F.lit(1).alias("round_no")))
    return found.withColumn("side", F.when(F.right("map_demo_id", F.lit(1)).cast("int") % 2 == 0, "T").otherwise("CT"))


@query(_TREE + f""", {_ROUNDS}, c AS (SELECT map_demo_id, round_no, count(*) AS n, string_agg(node[-1] || ' ' || players, '|' ORDER BY place) FILTER (depth = 1) AS first FROM t GROUP BY 1, 2)
 SELECT map_demo_id, round_no, CAST(coalesce(n, 0) AS INTEGER) AS steps, coalesce(first, '') AS first, CAST(row_number() OVER (ORDER BY CASE WHEN map_demo_id NOT IN ('d3', 'd11') THEN -CAST(map_demo_id[2:] AS INTEGER) END NULLS LAST, map_demo_id, round_no) AS INTEGER) AS rank FROM rd LEFT JOIN c USING (map_demo_id, round_no)""")
def routes_newest_first(spark, sf_dir):
    r = _rounds(spark, sf_dir)
    demos = r.select("map_demo_id").distinct().where("map_demo_id NOT IN ('d3', 'd11')").withColumn("rank", -F.substring("map_demo_id", 2, 9).cast("int"))
    out = W.routes(r, W.route_tree(_paths(spark, sf_dir), UNIT), demos)
    heads = F.array_sort(F.filter("steps", lambda s: s["depth"] == 1), lambda a, b: a["place"] - b["place"])
    first = F.array_join(F.transform(heads, lambda s: F.concat(W.step_text(s, s["seconds"]), F.lit(" "), s["players"].cast("string"))), "|")
    return out.select(*UNIT, F.size("steps").alias("steps"), first.alias("first"), "rank")


@query(_FULL + """, y AS (SELECT map_demo_id, round_no, steps, fin IS NULL AS alive, count(*) OVER (PARTITION BY map_demo_id, round_no) AS side, list_position(list_transform(steps, lambda v: split_part(v, '<>', 1) IN ('click', 'error', '?')), TRUE) AS k FROM f),
 v AS (SELECT *, steps[k:] AS way FROM y WHERE k > 0), x AS (SELECT *, unnest(range(1, len(way) + 1)) AS depth FROM v),
 g AS (SELECT map_demo_id, round_no, side, way[1:depth] AS path, count(*) AS reach, count(*) FILTER (alive AND depth = len(way)) AS stay FROM x GROUP BY map_demo_id, round_no, side, way[1:depth]),
 kk AS (SELECT map_demo_id, round_no, path, FALSE AS stayed, reach AS players FROM g WHERE reach >= 2 AND reach > stay AND (len(path) > 1 OR reach < side) UNION ALL SELECT map_demo_id, round_no, path, TRUE, stay FROM g WHERE stay = 1 OR (stay > 1 AND (len(path) > 1 OR stay < side)))
 SELECT CASE WHEN CAST(right(map_demo_id, 1) AS INTEGER) % 2 = 0 THEN 'T' ELSE 'CT' END AS side, array_to_string(path, '>') AS path, stayed, CAST(count(*) AS BIGINT) AS rounds, CAST(count(DISTINCT map_demo_id) AS BIGINT) AS matches, CAST(max(players) AS BIGINT) AS players,
 bool_or(map_demo_id = 'd4') AS newest FROM kk GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def repeated_ways(spark, sf_dir):
    found = W.route_patterns(_paths(spark, sf_dir), _rounds(spark, sf_dir), ["side"], UNIT, "map_demo_id", SPAWNS, "d4")
    named = F.transform("path", lambda x: F.concat(F.coalesce(x["label"], F.lit("?")), F.coalesce(F.concat(F.lit("<>"), x["other"]), F.lit(""))))
    return found.withColumn("path", F.array_join(named, ">"))


_OBSERVED = """ob AS (SELECT c_nationkey, o_orderkey AS match_id, o_custkey AS faction_id, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'n' END || (o_custkey % 40) END AS name, o_orderstatus = 'F' AS played,
 CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END AS observed_at FROM orders JOIN customer ON o_custkey = c_custkey),
 mb AS (SELECT DISTINCT l_orderkey AS match_id, CAST(l_partkey % 60 AS VARCHAR) AS player_id, CASE WHEN l_suppkey % 4 <> 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'P' ELSE 'p' END || (l_partkey % 60) END AS nickname FROM lineitem),
 o AS (SELECT *, {'l': observed_at IS NULL, 'a': coalesce(observed_at, DATE '1970-01-01'), 'm': match_id, 'f': faction_id} AS mo FROM ob), fl AS (SELECT o.*, player_id, nickname FROM o LEFT JOIN mb USING (match_id)),
 fs AS (SELECT c_nationkey, faction_id, min(mo) AS mo, list(DISTINCT player_id) FILTER (player_id IS NOT NULL) AS ms FROM fl GROUP BY 1, 2), gs AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY mo) AS i FROM fs),
 fold AS (SELECT DISTINCT c_nationkey, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k BIGINT, m VARCHAR[])[]) AS heads, CAST(NULL AS BIGINT) AS faction_id, CAST(NULL AS BIGINT) AS team FROM gs
 UNION ALL SELECT c_nationkey, i, CASE WHEN best.n >= 22 THEN heads ELSE heads || [{'k': CAST(fid AS BIGINT), 'm': ms}] END, fid, CASE WHEN best.n >= 22 THEN best.k ELSE fid END FROM
 (SELECT g.c_nationkey, g.i, heads, g.faction_id AS fid, g.ms, list_max(list_transform(heads, lambda h, x: {'n': len(list_intersect(h.m, g.ms)), 'x': -x, 'k': h.k})) AS best FROM fold f JOIN gs g ON g.c_nationkey = f.c_nationkey AND g.i = f.i + 1)),
 tm AS (SELECT c_nationkey, faction_id, team AS team_key FROM fold WHERE i > 0), fx AS (SELECT fl.*, team_key FROM fl JOIN tm USING (c_nationkey, faction_id)),
 pp AS (SELECT c_nationkey, team_key, player_id, CASE WHEN count(*) = count(observed_at) THEN max(observed_at) END AS seen FROM fx WHERE player_id IS NOT NULL GROUP BY 1, 2, 3),
 pv AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (seen IS NULL) OVER w AS u, max(seen) OVER w AS top FROM pp WINDOW w AS (PARTITION BY c_nationkey, player_id)), pt AS (SELECT *, count(*) FILTER (seen = top) OVER (PARTITION BY c_nationkey, player_id) AS at_top FROM pv),
 pz AS (SELECT *, CASE WHEN n = 1 THEN 'own' WHEN u > 0 THEN 'shared' WHEN seen < top THEN 'released' WHEN at_top = 1 THEN 'own' ELSE 'shared' END AS v FROM pt),
 nk AS (SELECT c_nationkey, team_key, player_id, nickname, count(*) AS c FROM fx WHERE nickname IS NOT NULL GROUP BY 1, 2, 3, 4), nb AS (SELECT c_nationkey, team_key, player_id, arg_min(nickname, (-c, lower(nickname), nickname)) AS nickname FROM nk GROUP BY 1, 2, 3),
 ro AS (SELECT c_nationkey, team_key, coalesce(string_agg(player_id || ':' || coalesce(nickname, ''), ',' ORDER BY nickname NULLS LAST, player_id) FILTER (v <> 'released'), '') AS roster,
 coalesce(string_agg(player_id, ',' ORDER BY nickname NULLS LAST, player_id) FILTER (v = 'released'), '') AS released, coalesce(string_agg(player_id, ',' ORDER BY player_id) FILTER (v = 'shared'), '') AS shared FROM pz LEFT JOIN nb USING (c_nationkey, team_key, player_id) GROUP BY 1, 2),
 tn AS (SELECT c_nationkey, team_key, name, count(*) AS c FROM o JOIN tm USING (c_nationkey, faction_id) WHERE name IS NOT NULL GROUP BY 1, 2, 3), tb AS (SELECT c_nationkey, team_key, arg_min(name, (-c, lower(name), name)) AS name, CAST(count(*) - 1 AS INTEGER) AS other_names FROM tn GROUP BY 1, 2),
 mt AS (SELECT c_nationkey, team_key, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY mo) AS match_ids, CAST(count(*) FILTER (played) AS INTEGER) AS played FROM o JOIN tm USING (c_nationkey, faction_id) GROUP BY 1, 2),
 ft AS (SELECT c_nationkey, team_key, string_agg(CAST(faction_id AS VARCHAR), ',' ORDER BY mo) AS faction_ids FROM fs JOIN tm USING (c_nationkey, faction_id) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_OBSERVED} SELECT c_nationkey, team_key, faction_ids, match_ids, played, name, coalesce(other_names, -1) AS other_names, roster, released, shared FROM ft JOIN mt USING (c_nationkey, team_key) LEFT JOIN ro USING (c_nationkey, team_key) LEFT JOIN tb USING (c_nationkey, team_key)")
def standing_rosters(spark, sf_dir):
    k, s = F.col("l_partkey") % 60, F.col("l_suppkey")
    # a player and the kind of nickname (0 for none) travel as one number
    kind = F.when(F.coalesce(s % 4 == 0, F.lit(True)), 0).when(s % 2 == 0, 1).otherwise(2)
    codes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.collect_set((k * 4 + kind).cast("short")).alias("codes"))
    name_of = lambda k, kind: F.when(kind > 0, F.concat(F.when(kind == 1, "P").otherwise("p"), k))
    player = lambda c: F.struct((k := F.floor(c / 4).cast("string")).alias("player_id"), name_of(k, F.pmod(c, F.lit(4))).alias("nickname"))
    members = F.transform("codes", player).alias("members")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    seen = o.select(
        "c_nationkey", key.alias("match_id"), c.alias("faction_id"), F.when(key % 5 != 0, F.concat(F.when(key % 2 == 0, "N").otherwise("n"), (c % 40).cast("string"))).alias("name"), (F.col("o_orderstatus") == "F").alias("played"),
        F.when(key % 41 != 0, F.col("o_orderdate")).alias("observed_at"),
    ).join(codes, "match_id", "left").select("c_nationkey", "match_id", "faction_id", "name", "played", "observed_at", members)
    t = K.standing_teams(seen, ["c_nationkey"], 22)
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    roster = F.array_join(F.transform("roster", lambda m: F.concat(m["player_id"], F.lit(":"), F.coalesce(m["nickname"], F.lit("")))), ",")
    return t.select(
        "c_nationkey", "team_key", ids("faction_ids"), ids("match_ids"), F.size("played_match_ids").alias("played"), "name", F.coalesce(F.size("other_names"), F.lit(-1)).alias("other_names"),
        roster.alias("roster"), F.array_join(F.transform("released", lambda m: m["player_id"]), ",").alias("released"), F.array_join("shared_players", ",").alias("shared"),
    )


@query(_CLASSIFIED + """ SELECT map_demo_id, round_no, concat_ws('; ', 'available ' || CAST(round_even(money_buy_end / players, 0) AS INTEGER), 'left ' || CAST(round_even(money_buy_end / players, 0) AS INTEGER),
 'equipment ' || CAST(round_even(equip_buy_end / players, 0) AS INTEGER), 'bought ' || CAST(round_even(bought / players, 0) AS INTEGER), 'losses ' || CAST(loss_count AS INTEGER),
 CASE WHEN players_buy_end IS NULL THEN 'divided by 5, players unread' ELSE 'divided by 5' END) AS reason FROM t""")
def classification_reasons(spark, sf_dir):
    r = rounds_of(spark, sf_dir).withColumn("money_spent", F.lit(None).cast("int"))
    return G.classify(r, ["map_demo_id"]).select(*UNIT, G.reason().alias("reason"))
