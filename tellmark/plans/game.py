"""The game's operators applied to the driver's tables: orders are rounds, events are positions and hits, lines are throws.

Each table is brought under the operators' column names once, in Spark and as a
DuckDB view of the same rows; every query calls its operator on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.operators import enrichment as E
from tellmark.operators import evidence as V
from tellmark.operators import paths as P
from tellmark.operators import report as Q
from tellmark.operators import rounds as G
from tellmark.operators import segments as T
from tellmark.operators import spatial as X
from tellmark.operators import teams as K
from tellmark.plans.catalogue import events, query
from tellmark.session import dealt, table

UNIT = ["map_demo_id", "round_no"]
LEAF = Q.LEVELS

_ROUNDS = """o AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS round_no FROM orders),
 r AS (SELECT CAST(o_custkey AS VARCHAR) AS map_demo_id, round_no, o_orderkey, CASE WHEN round_no <= 6 THEN 'T' ELSE 'CT' END AS side,
 CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS won, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey * 37 % 20000 AS INTEGER) END AS money_buy_end,
 CAST(floor(o_totalprice / 20) AS INTEGER) AS equip_buy_end, CAST(floor(o_totalprice / 60) AS INTEGER) AS equip_round_start,
 CASE WHEN o_orderkey % 11 <> 0 THEN 5 END AS players_buy_end, CAST(o_orderkey % 6 AS INTEGER) AS players_armed_buy_end,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS players_armored_buy_end,
 list_transform(range(5), lambda i: (o_orderkey * 7 + i * 1931) % 9000) AS money_players, CASE WHEN o_orderkey % 17 = 0 THEN 'no_freeze_end' ELSE 'ok' END AS status,
 'map' || (o_custkey % 3) AS map_name, 'L' || (o_custkey % 2) AS lineup_key, o_custkey % 40 AS match_id, CASE WHEN o_custkey % 10 < 7 THEN o_custkey % 2 = 0 END AS is_league,
 CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_totalprice >= 250000 THEN 'full' ELSE 'eco' END END AS round_type FROM o)"""


def rounds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price, state = F.col("o_totalprice"), F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders")
    o = dealt(o.withColumn("map_demo_id", c.cast("string")), o.count(), "map_demo_id")
    o = o.withColumn("round_no", F.row_number().over(Window.partitionBy("map_demo_id").orderBy("o_orderdate", "o_orderkey")))
    return o.select(
        "map_demo_id", "round_no", "o_orderkey", F.when(F.col("round_no") <= 6, "T").otherwise("CT").alias("side"),
        F.when(state == "F", True).when(state == "O", False).alias("won"), F.when(k % 19 != 0, (k * 37 % 20000).cast("int")).alias("money_buy_end"),
        F.floor(price / 20).cast("int").alias("equip_buy_end"), F.floor(price / 60).cast("int").alias("equip_round_start"),
        F.when(k % 11 != 0, 5).alias("players_buy_end"), (k % 6).cast("int").alias("players_armed_buy_end"),
        F.when(k % 7 != 0, (k % 5).cast("int")).alias("players_armored_buy_end"), F.array(*(((k * 7 + i * 1931) % 9000).cast("int") for i in range(5))).alias("money_players_buy_end"),
        F.when(k % 17 == 0, "no_freeze_end").otherwise("ok").alias("status"), F.concat(F.lit("map"), (c % 3).cast("string")).alias("map_name"),
        F.concat(F.lit("L"), (c % 2).cast("string")).alias("lineup_key"), (c % 40).alias("match_id"), F.when(c % 10 < 7, c % 2 == 0).alias("is_league"),
        F.when(state != "P", F.when(price >= 250000, "full").otherwise("eco")).alias("round_type"),
    )


_CLASSIFIED = f"""WITH RECURSIVE {_ROUNDS}, h AS (SELECT *, CASE WHEN lag(side) OVER w IS DISTINCT FROM side THEN 1 ELSE 0 END AS f,
 CASE WHEN lag(round_no) OVER w = round_no - 1 AND lag(side) OVER w = side THEN lag(won) OVER w END AS prev_won FROM r WINDOW w AS (PARTITION BY map_demo_id ORDER BY round_no)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY map_demo_id ORDER BY round_no) AS half FROM h),
 s AS (SELECT *, row_number() OVER (PARTITION BY map_demo_id, half ORDER BY round_no) AS n, CASE WHEN won THEN -1 WHEN NOT won THEN 1 ELSE 0 END AS d FROM g),
 c AS (SELECT map_demo_id, half, n, 1 AS loss_count, greatest(0, least(4, 1 + d)) AS after FROM s WHERE n = 1
 UNION ALL SELECT s.map_demo_id, s.half, s.n, c.after, greatest(0, least(4, c.after + s.d)) FROM c JOIN s ON s.map_demo_id = c.map_demo_id AND s.half = c.half AND s.n = c.n + 1),
 v AS (SELECT s.*, loss_count, coalesce(players_buy_end, 5) AS players, equip_buy_end - equip_round_start AS bought, NOT (round_no + 1 IN (1, 13) OR round_no + 1 > 24) AS carries FROM s JOIN c USING (map_demo_id, half, n)),
 e AS (SELECT *, CAST(round_even(equip_buy_end / players, 0) AS INTEGER) AS equip_pp, CAST(round_even(bought / players, 0) AS INTEGER) AS bought_pp,
 CASE WHEN carries THEN CAST(len(list_filter(money_players, lambda m: least(m + [1400, 1900, 2400, 2900, 3400][1 + least(loss_count, 4)], 16000) >= 4000)) AS INTEGER) END AS buyers FROM v),
 t AS (SELECT *, CASE WHEN status <> 'ok' OR money_buy_end IS NULL THEN NULL WHEN round_no IN (1, 13) THEN 'pistol' WHEN round_no > 24 THEN 'ot' WHEN bought < 0 THEN 'anomaly' WHEN equip_pp >= 4000 THEN 'full'
 WHEN prev_won IS NULL THEN 'anomaly' WHEN prev_won AND equip_pp <= 2000 THEN 'anomaly' WHEN prev_won THEN 'full' WHEN bought_pp < 1500 THEN 'eco' WHEN players_buy_end IS NULL THEN NULL
 WHEN players_armed_buy_end < 3 THEN 'eco' WHEN NOT carries THEN 'force' WHEN buyers >= 3 THEN 'half' ELSE 'force' END AS kind FROM e)"""


@query(_CLASSIFIED + " SELECT map_demo_id, round_no, kind AS round_type, prev_won, CAST(loss_count AS INTEGER) AS loss_count, equip_pp, bought_pp, buyers FROM t")
def classified_rounds(spark, sf_dir):
    return G.classify(rounds_of(spark, sf_dir), ["map_demo_id"]).select(*UNIT, "round_type", "prev_won", "loss_count", "equip_pp", "bought_pp", "buyers")


@query(_CLASSIFIED + """ SELECT map_demo_id, round_no, kind AS round_type, equip_pp, CAST(players_armed_buy_end AS VARCHAR) || '/' || CAST(players_buy_end AS VARCHAR) AS armed,
 CAST(buyers AS VARCHAR) || '/' || CAST(players_buy_end AS VARCHAR) AS buyers FROM t""")
def round_list_rows(spark, sf_dir):
    return V.round_list(G.classify(rounds_of(spark, sf_dir), ["map_demo_id"]))


@query(f"""WITH {_ROUNDS}, p AS (SELECT CAST(map_demo_id AS BIGINT) // 2 AS unit, lineup_key, round_no, round_type FROM r)
 SELECT p.unit, p.lineup_key, p.round_no, p.round_type, q.round_type AS opp_round_type FROM p LEFT JOIN p q ON p.unit = q.unit AND p.round_no = q.round_no AND p.lineup_key <> q.lineup_key""")
def opponent_rounds(spark, sf_dir):
    r = rounds_of(spark, sf_dir).select(F.floor(F.col("map_demo_id").cast("long") / 2).alias("unit"), "lineup_key", "round_no", "round_type")
    return G.with_opponent(r, ["unit"], "lineup_key")


@query(f"""WITH {_ROUNDS} SELECT map_name, side, round_type, CAST(grouping(map_name) * 4 + grouping(side) * 2 + grouping(round_type) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS rounds,
 CAST(count(DISTINCT map_demo_id) AS BIGINT) AS demos, CAST(count(DISTINCT match_id) AS BIGINT) AS matches, CAST(count(*) FILTER (is_league) AS BIGINT) AS rounds_league,
 CAST(count(*) FILTER (NOT is_league) AS BIGINT) AS rounds_other, CAST(count(*) FILTER (is_league IS NULL) AS BIGINT) AS rounds_unknown FROM r WHERE round_type IS NOT NULL
 GROUP BY GROUPING SETS ((map_name, side, round_type), (map_name, side), (map_name), ())""")
def sample_cube(spark, sf_dir):
    return Q.samples(rounds_of(spark, sf_dir))


@query(f"""WITH {_ROUNDS} SELECT map_name, side, round_type, CAST(count(*) FILTER (won) AS BIGINT) AS wins, CAST(count(*) FILTER (NOT won) AS BIGINT) AS losses, CAST(count(*) FILTER (won IS NULL) AS BIGINT) AS unknown
 FROM r WHERE round_type IS NOT NULL GROUP BY 1, 2, 3""")
def win_records(spark, sf_dir):
    return Q.records(rounds_of(spark, sf_dir))


def _histogram_sql(value: str) -> str:
    return f"""WITH {_ROUNDS}, g AS (SELECT map_name, side, {value}, count(*) AS k FROM r GROUP BY ALL),
 m AS (SELECT *, sum(CASE WHEN {value} IS NOT NULL THEN k ELSE 0 END) OVER w AS m, sum(CASE WHEN {value} IS NULL THEN k ELSE 0 END) OVER w AS u FROM g WINDOW w AS (PARTITION BY map_name, side))
 SELECT map_name, side, {value}, CAST(CASE WHEN {value} IS NOT NULL THEN k ELSE 0 END AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(u AS BIGINT) AS rounds_unknown FROM m WHERE {value} IS NOT NULL OR m = 0"""


@query(_histogram_sql("players_armed_buy_end"))
def armed_histogram(spark, sf_dir):
    return V.histogram_with_unknown(rounds_of(spark, sf_dir), ["map_name", "side"], "players_armed_buy_end")


@query(_histogram_sql("players_armored_buy_end"))
def armoured_histogram(spark, sf_dir):
    r = rounds_of(spark, sf_dir)
    keys = [*UNIT, "side"]
    return V.histogram_with_unknown(r.drop("players_armored_buy_end").join(V.reading_per_key(r, keys, "players_armored_buy_end"), keys, "left"), ["map_name", "side"], "players_armored_buy_end")


@query(f"""WITH {_ROUNDS} SELECT map_demo_id, arg_min(side, round_no) AS starting_side, CAST(count(*) AS BIGINT) AS rounds, CAST(count(*) FILTER (won) AS BIGINT) AS wins, CAST(count(*) FILTER (won IS NULL) AS BIGINT) AS unknown FROM r GROUP BY 1""")
def lineup_summaries(spark, sf_dir):
    return V.lineup_summary(rounds_of(spark, sf_dir), "map_demo_id")


@query(f"""WITH {_ROUNDS}, g AS (SELECT map_name, side, round_type, count(*) AS rounds FROM r WHERE round_type IS NOT NULL GROUP BY 1, 2, 3)
 SELECT map_name, round_type, CASE round_type WHEN 'eco' THEN 1 ELSE 2 END AS place, string_agg(side || ':' || rounds, ',' ORDER BY side) AS sides FROM g GROUP BY 1, 2, 3""")
def types_by_side(spark, sf_dir):
    leaves = rounds_of(spark, sf_dir).where("round_type IS NOT NULL").groupBy("map_name", "side", "round_type").agg(F.count("*").alias("rounds"))
    text = F.transform("sides", lambda s: F.concat(s["side"], F.lit(":"), s["rounds"].cast("string")))
    return V.by_round_type(leaves, ["eco", "full"]).withColumn("sides", F.array_join(text, ","))


_SEEN = """p AS (SELECT CAST(ts AS DATE) AS day, CAST(floor(extract(hour FROM ts) / 12) AS INTEGER) AS round_no, user_id AS player_id, CASE WHEN user_id % 2 = 0 THEN 'T' ELSE 'CT' END AS side,
 CASE WHEN event_id % 5 = 0 THEN 'first_contact' ELSE 'time' END AS sample_kind, CAST(floor(extract(minute FROM ts) / 15) * 10 AS DOUBLE) AS sample_t_s, CASE WHEN value < 40 THEN event_type END AS area,
 value > 1 AS is_alive FROM events),
 pts AS (SELECT day, count(DISTINCT sample_t_s) AS points FROM p WHERE sample_kind = 'time' GROUP BY 1), live AS (SELECT * FROM p WHERE sample_kind = 'time' AND is_alive),
 ori AS (SELECT day, area, count(*) AS total, count(*) FILTER (side = 'T') AS t FROM live WHERE area IS NOT NULL GROUP BY 1, 2),
 held AS (SELECT day, area, total, t, points, t / total AS t_share FROM ori JOIN pts USING (day) WHERE total >= points AND t / total >= 0.5)"""


def seen_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 12).cast("int").alias("round_no"), F.col("user_id").alias("player_id"), F.when(F.col("user_id") % 2 == 0, "T").otherwise("CT").alias("side"),
        F.when(F.col("event_id") % 5 == 0, "first_contact").otherwise("time").alias("sample_kind"), (F.floor(F.minute("ts") / 15) * 10).cast("double").alias("sample_t_s"),
        F.when(F.col("value") < 40, F.col("event_type")).alias("area"), (F.col("value") > 1).alias("is_alive"),
    )


def _held(seen: DataFrame) -> DataFrame:
    return X.held_areas(seen, ["day"], 0.5, 1)


@query(f"WITH {_SEEN} SELECT day, area, CAST(total AS BIGINT) AS total, CAST(t AS BIGINT) AS t, CAST(points AS BIGINT) AS points, round(t_share, 6) AS t_share FROM held")
def held_areas_rule(spark, sf_dir):
    return _held(seen_of(spark, sf_dir)).withColumn("t_share", F.round("t_share", 6))


@query(f"""WITH {_SEEN} SELECT day, round_no, sample_t_s, area, round(t_share, 6) AS t_share, CAST(total AS BIGINT) AS total, CAST(count(DISTINCT player_id) AS BIGINT) AS players
 FROM live JOIN held USING (day, area) WHERE side = 'CT' AND sample_t_s <= 20 AND (extract(day FROM day) + round_no) % 2 = 0 GROUP BY ALL HAVING count(DISTINCT player_id) >= 2""")
def advance_rule(spark, sf_dir):
    seen = seen_of(spark, sf_dir)
    kind = F.when((F.dayofmonth("day") + F.col("round_no")) % 2 == 0, "eco").otherwise("full")
    rounds = seen.select("day", "round_no").distinct().withColumn("round_type", kind)
    return X.advance_hits(seen, rounds, ["day"], _held(seen), 20, 2).withColumn("t_share", F.round("t_share", 6))


@query(f"""WITH {_SEEN}, ct AS (SELECT *, CAST(sample_t_s * 1000 AS BIGINT) AS ms FROM live WHERE side = 'CT'), l AS (SELECT day, round_no, player_id, ms, min(area) AS source FROM ct GROUP BY ALL),
 c AS (SELECT ct.*, l.source FROM ct ASOF LEFT JOIN l ON ct.day = l.day AND ct.round_no = l.round_no AND ct.player_id = l.player_id AND ct.ms - 10000 >= l.ms)
 SELECT day, round_no, sample_t_s, area, round(t_share, 6) AS t_share, CAST(total AS BIGINT) AS total, CAST(count(DISTINCT player_id) AS BIGINT) AS players, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
 FROM c JOIN held USING (day, area) WHERE source IS NOT NULL AND source <> area AND sample_t_s <= 30 GROUP BY ALL HAVING count(DISTINCT player_id) >= 1 AND count(DISTINCT source) >= 1""")
def crunch_rule(spark, sf_dir):
    seen = seen_of(spark, sf_dir)
    return X.crunch_hits(seen, ["day"], _held(seen), 30, 10, 1, 1).withColumn("t_share", F.round("t_share", 6)).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {_SEEN}, z AS (SELECT day, round_no, CASE WHEN area IN ('click', 'view', 'signup') THEN 'A' ELSE 'B' END AS site, area AS part, list(DISTINCT player_id) AS who FROM live
 WHERE side = 'CT' AND sample_t_s = 10 AND area IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY day, round_no, site ORDER BY len(who) DESC, part) AS r FROM z),
 b AS (SELECT day, round_no, site, part AS first, CAST(NULL AS VARCHAR) AS second, len(who) AS covered, 1 AS k, r AS r1, 0 AS r2 FROM n
 UNION ALL SELECT a.day, a.round_no, a.site, a.part, c.part, len(list_distinct(list_concat(a.who, c.who))), 2, a.r, c.r FROM n a JOIN n c ON a.day = c.day AND a.round_no = c.round_no AND a.site = c.site AND a.r < c.r)
 SELECT day, round_no, site, arg_min(first, (-covered, k, r1, r2)) AS first, nullif(arg_min(coalesce(second, ''), (-covered, k, r1, r2)), '') AS second, CAST(max(covered) AS INTEGER) AS covered FROM b GROUP BY 1, 2, 3 HAVING max(covered) >= 2""")
def stack_rule(spark, sf_dir):
    seen = seen_of(spark, sf_dir)
    groups = seen.where("area IS NOT NULL").select("day", "area", F.when(F.col("area").isin("click", "view", "signup"), "A").otherwise("B").alias("site")).distinct()
    return X.stack_hits(seen, ["day"], groups, 10.0, 2)


@query(f"""WITH {_SEEN}, f AS (SELECT *, extract(day FROM day) % 5 AS match FROM p WHERE sample_kind = 'first_contact'),
 w AS (SELECT count(DISTINCT (day, round_no)) AS m, count(DISTINCT match) AS matches_m FROM f)
 SELECT area, CAST(count(DISTINCT (day, round_no)) AS BIGINT) AS n, CAST(count(DISTINCT match) AS BIGINT) AS matches, bool_or(match = 3) AS newest, CAST(any_value(m) AS BIGINT) AS m, CAST(any_value(matches_m) AS BIGINT) AS matches_m FROM f, w WHERE is_alive GROUP BY 1""")
def first_contact_presence(spark, sf_dir):
    seen = seen_of(spark, sf_dir)
    return V.first_contact_presence(seen, seen.select("day", "round_no"), ["day", "round_no"], F.dayofmonth("day") % 5, F.lit(3))


@query(f"""WITH {_SEEN}, u AS (SELECT DISTINCT day, round_no, sample_t_s FROM p WHERE sample_kind = 'time'), k AS (SELECT DISTINCT sample_t_s, area FROM live),
 s AS (SELECT day, round_no, sample_t_s, area, count(DISTINCT player_id) AS players FROM live GROUP BY ALL),
 f AS (SELECT u.*, k.area, coalesce(s.players, 0) AS players FROM u JOIN k USING (sample_t_s) LEFT JOIN s ON s.day = u.day AND s.round_no = u.round_no AND s.sample_t_s = u.sample_t_s AND s.area IS NOT DISTINCT FROM k.area),
 n AS (SELECT sample_t_s, area, players, count(*) AS n FROM f GROUP BY ALL) SELECT sample_t_s, area, CAST(players AS BIGINT) AS players, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY sample_t_s, area) AS BIGINT) AS m FROM n WHERE sample_t_s <> 20""")
def shown_position_points(spark, sf_dir):
    seen = seen_of(spark, sf_dir).withColumnRenamed("day", "map_demo_id")
    rounds = seen.select(*UNIT).distinct().withColumns({"map_name": F.lit("m"), "side": F.lit("s"), "round_type": F.lit("t")})
    rows = Q.positions(seen, rounds).where("sample_kind = 'time'")
    return V.shown_points(rows, [20.0]).select("sample_t_s", "area", "players", "n", "m")


_THROWS = _ROUNDS + """, g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_quantity) AS q, min(l_suppkey) AS k, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2),
 th AS (SELECT map_demo_id, round_no, map_name, side, round_type, lineup_key, match_id, l_orderkey * 8 + l_linenumber AS grenade_no, f AS grenade_type, 'A' || (k % 4) AS from_area, CASE WHEN s = 'F' THEN 'T' || (k % 3) END AS target, q AS t_s, k, pk FROM g JOIN r ON l_orderkey = o_orderkey)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = dealt(li, li.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").alias("q"), F.min("l_suppkey").alias("k"), F.min("l_partkey").alias("pk")
    )
    return g.join(rounds_of(spark, sf_dir).select(*UNIT, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def throws_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throws, and detonations of those of an F line."""
    g = _lines(spark, sf_dir).withColumn("grenade_no", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    g = dealt(g, table(spark, sf_dir, "lineitem").count(), "map_demo_id", "grenade_no")
    row = lambda kind, letter, n: [*UNIT, "grenade_no", F.lit(kind).alias("event_kind"), F.col("f").alias("grenade_type"), F.concat(F.lit(letter), (F.col("k") % n).cast("string")).alias("area"), F.col("q").alias("t_s")]
    return g.select(*row("grenade_thrown", "A", 4)).unionByName(g.where("s = 'F'").select(*row("grenade_detonate", "T", 3)))


def rounds_of_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in as many partitions as their throws need, so that a join by round sends the throws to these."""
    return dealt(rounds_of(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), *UNIT)


_BUCKET = "CASE WHEN t_s < 10 THEN '0-10' WHEN t_s < 30 THEN '10-30' ELSE '30+' END"
_USES = _THROWS + f""", us AS (SELECT map_name, side, round_type, grenade_type, from_area, target, {_BUCKET} AS bucket, count(DISTINCT (map_demo_id, round_no)) AS n, count(*) AS throws FROM th WHERE round_type IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_USES} SELECT map_name, side, round_type, grenade_type, from_area, target, bucket, CAST(n AS BIGINT) AS n, CAST(throws AS BIGINT) AS throws FROM us")
def utility_uses(spark, sf_dir):
    return Q.utility(throws_of(spark, sf_dir), rounds_of_throws(spark, sf_dir), [10, 30])


@query(f"""WITH {_USES}, lf AS (SELECT map_name, side, round_type, count(*) AS m FROM r WHERE round_type IS NOT NULL GROUP BY 1, 2, 3), x AS (SELECT us.*, m FROM us JOIN lf USING (map_name, side, round_type) WHERE target IS NOT NULL AND n >= greatest(1, least(2, m))),
 t AS (SELECT map_name, side, round_type, target, max(n) AS top FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY map_name, side, round_type ORDER BY top DESC, target) AS rk FROM t)
 SELECT map_name, side, round_type, target, from_area, bucket, grenade_type, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY map_name, side, round_type, grenade_type ORDER BY n DESC, target, from_area, bucket) AS INTEGER) AS line
 FROM (SELECT x.* FROM x JOIN k USING (map_name, side, round_type, target) WHERE rk <= 2)""")
def utility_target_lines(spark, sf_dir):
    rounds = rounds_of_throws(spark, sf_dir)
    m = rounds.where("round_type IS NOT NULL").groupBy(*LEAF).agg(F.count("*").alias("m"))
    uses = Q.utility(throws_of(spark, sf_dir), rounds, [10, 30]).join(m, LEAF)
    lines = V.target_lines(uses, LEAF, 2, 2)
    w = Window.partitionBy(*LEAF, "grenade_type").orderBy("line")
    return lines.select(*LEAF, "target", "from_area", "bucket", "grenade_type", "n", F.row_number().over(w).alias("line"))


_COUNTS = _THROWS + """, lf AS (SELECT map_name, side, round_type, map_demo_id, round_no FROM r WHERE round_type IS NOT NULL), ty AS (SELECT DISTINCT map_name, side, round_type, grenade_type FROM th WHERE round_type IS NOT NULL),
 sn AS (SELECT map_demo_id, round_no, grenade_type, count(*) AS throws FROM th WHERE round_type IS NOT NULL GROUP BY ALL),
 z AS (SELECT lf.map_name, lf.side, lf.round_type, ty.grenade_type, coalesce(throws, 0) AS throws FROM lf JOIN ty USING (map_name, side, round_type) LEFT JOIN sn ON sn.map_demo_id = lf.map_demo_id AND sn.round_no = lf.round_no AND sn.grenade_type = ty.grenade_type),
 ct AS (SELECT map_name, side, round_type, grenade_type, throws, count(*) AS n FROM z GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT map_name, side, round_type, grenade_type, CAST(throws AS BIGINT) AS throws, CAST(n AS BIGINT) AS n FROM ct")
def throws_histogram(spark, sf_dir):
    return Q.throws_per_round(throws_of(spark, sf_dir), rounds_of_throws(spark, sf_dir))


@query(f"""WITH {_COUNTS}, y AS (SELECT *, sum(n) OVER (PARTITION BY map_name, side, round_type, grenade_type) AS m FROM ct)
 SELECT map_name, side, round_type, grenade_type, CAST(throws AS BIGINT) AS throws, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m,
 CAST(row_number() OVER (PARTITION BY map_name, side, round_type ORDER BY CASE grenade_type WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, throws DESC, grenade_type) AS INTEGER) AS line FROM y WHERE throws > 0 AND n >= greatest(1, least(3, m))""")
def utility_count_lines(spark, sf_dir):
    bars = Q.throws_per_round(throws_of(spark, sf_dir), rounds_of_throws(spark, sf_dir))
    bars = bars.withColumn("m", F.sum("n").over(Window.partitionBy(*LEAF, "grenade_type")))
    return V.count_lines(bars, LEAF, ["R", "N"], 3)


_DEATHS = _THROWS + """, dt AS (SELECT map_demo_id, round_no, map_name, side, round_type, lineup_key, CASE WHEN t_s <= 45 THEN t_s END AS t_s, k AS victim_id, 'L' || (k % 2) AS victim_lineup_key, from_area AS victim_area,
 pk % 100 AS attacker_id, 'L' || (pk % 2) AS attacker_lineup_key, 'A' || (pk % 5) AS attacker_area FROM th)"""


def deaths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c, n: F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    return _lines(spark, sf_dir).select(
        *UNIT, F.when(F.col("q") <= 45, F.col("q")).alias("t_s"), F.col("k").alias("victim_id"), name("L", "k", 2).alias("victim_lineup_key"), name("A", "k", 4).alias("victim_area"),
        (F.col("pk") % 100).alias("attacker_id"), name("L", "pk", 2).alias("attacker_lineup_key"), name("A", "pk", 5).alias("attacker_area"),
    )


_FIRST = _DEATHS + """, fd AS (SELECT map_demo_id, round_no, map_name, side, round_type, victim_area, t_s, row_number() OVER (PARTITION BY map_demo_id, round_no ORDER BY t_s IS NULL, t_s, victim_id, victim_area) AS k FROM dt WHERE round_type IS NOT NULL AND victim_lineup_key = lineup_key),
 fa AS (SELECT map_name, side, round_type, victim_area AS area, count(*) AS n, round_even(median(t_s), 3) AS median_t_s FROM fd WHERE k = 1 GROUP BY 1, 2, 3, 4), fm AS (SELECT *, sum(n) OVER (PARTITION BY map_name, side, round_type) AS m FROM fa)"""


@query(f"WITH {_FIRST} SELECT map_name, side, round_type, area, CAST(n AS BIGINT) AS n, median_t_s, CAST(m AS BIGINT) AS m FROM fm")
def first_death_areas(spark, sf_dir):
    return Q.first_deaths(deaths_of(spark, sf_dir), rounds_of(spark, sf_dir))


@query(f"""WITH {_FIRST}, k AS (SELECT *, rank() OVER (PARTITION BY map_name, side, round_type ORDER BY n DESC) AS rk FROM fm WHERE n >= greatest(1, least(2, m)))
 SELECT map_name, side, round_type, area, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(row_number() OVER (PARTITION BY map_name, side, round_type ORDER BY n DESC, area) AS INTEGER) AS line FROM k WHERE rk <= 2""")
def first_death_lines(spark, sf_dir):
    return V.death_lines(Q.first_deaths(deaths_of(spark, sf_dir), rounds_of(spark, sf_dir)), LEAF, 2, 2).drop("median_t_s")


@query(f"""WITH {_DEATHS}, a AS (SELECT map_name, side, round_type, attacker_area AS area, count(*) AS n FROM dt WHERE round_type IS NOT NULL AND attacker_lineup_key = lineup_key AND attacker_id <> victim_id GROUP BY 1, 2, 3, 4)
 SELECT map_name, side, round_type, area, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY map_name, side, round_type) AS BIGINT) AS m FROM a""")
def kill_areas(spark, sf_dir):
    return Q.kills(deaths_of(spark, sf_dir), rounds_of(spark, sf_dir))


@query(f"""WITH {_DEATHS} SELECT map_demo_id, round_no, victim_id, min(t_s) AS t_s, arg_min(victim_area, (t_s, victim_area)) AS victim_area FROM dt WHERE victim_lineup_key = lineup_key AND t_s >= 0 GROUP BY 1, 2, 3""")
def earliest_own_deaths(spark, sf_dir):
    return V.route_deaths(rounds_of(spark, sf_dir), deaths_of(spark, sf_dir), UNIT)


_CLOCK = """k AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS INTEGER) AS tick FROM events),
 seg AS (SELECT DISTINCT day, h AS round_raw, h * 43200 AS freeze_end_tick, CASE WHEN extract(day FROM day) % 3 <> 0 THEN h * 43200 + 43199 END AS end_tick FROM k, (SELECT unnest([0, 1]) AS h))"""


def clock_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("tick"))


def halves_of(clock: DataFrame) -> DataFrame:
    """Two segments a day; the ends of every third day are unknown."""
    h = F.explode(F.array(F.lit(0), F.lit(1)))
    return clock.select("day").distinct().select("day", h.alias("round_raw")).select(
        "day", "round_raw", (F.col("round_raw") * 43200).alias("freeze_end_tick"), F.when(F.dayofmonth("day") % 3 != 0, F.col("round_raw") * 43200 + 43199).alias("end_tick")
    )


@query(f"""WITH {_CLOCK}, x AS (SELECT *, coalesce(end_tick, lead(freeze_end_tick) OVER (PARTITION BY day ORDER BY freeze_end_tick) - 1) AS u FROM seg),
 d AS (SELECT x.day, x.round_raw, min(tick) AS f FROM x JOIN k ON k.day = x.day AND event_type = 'click' AND tick >= freeze_end_tick AND (u IS NULL OR tick <= u) GROUP BY 1, 2)
 SELECT x.day, x.round_raw, greatest(freeze_end_tick, least(freeze_end_tick + 6000, u, f - 1)) AS buy_end_tick FROM x LEFT JOIN d ON d.day = x.day AND d.round_raw = x.round_raw""")
def buy_end_ticks(spark, sf_dir):
    clock = clock_of(spark, sf_dir)
    deaths = clock.where("event_type = 'click'").select("day", "tick")
    return G.buy_end(halves_of(clock), deaths, ["day"], 6000).select("day", "round_raw", "buy_end_tick")


@query(f"""WITH {_CLOCK}, s AS (SELECT day, round_raw, unnest([0.0, 7.5, 10.0]) AS t, freeze_end_tick AS f, end_tick AS e FROM seg WHERE end_tick IS NOT NULL)
 SELECT day, round_raw, CAST(t AS DOUBLE) AS sample_t_s, CAST(f + round_even(t * 63, 0) AS INTEGER) AS tick, round(CAST(round_even(t * 63, 0) AS DOUBLE) / 63, 6) AS t_s FROM s WHERE f + round_even(t * 63, 0) <= e""")
def sample_point_ticks(spark, sf_dir):
    points = G.sample_ticks(halves_of(clock_of(spark, sf_dir)), [10, 0, 7.5, 10], 63)
    return points.select("day", "round_raw", "sample_t_s", "tick", F.round("t_s", 6).alias("t_s"))


_HITS = _CLOCK + """, hit AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN event_id % 150 END AS victim_id, CASE WHEN user_id % 2 = 0 THEN 'T' ELSE 'CT' END AS a_side, CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'CT' END AS v_side,
 CASE event_id % 4 WHEN 0 THEN 'knife' WHEN 1 THEN 'ak47' WHEN 3 THEN 'm4' END AS w FROM k),
 ok AS (SELECT * FROM hit WHERE victim_id IS NOT NULL AND user_id <> victim_id AND v_side IS NOT NULL AND a_side <> v_side AND w IS NOT NULL AND w <> 'knife')"""


@query(f"""WITH {_HITS} SELECT seg.day, round_raw, coalesce(min(tick) FILTER (event_type = 'error'), min(tick) FILTER (event_type = 'click')) AS contact_tick
 FROM seg LEFT JOIN ok ON ok.day = seg.day AND tick BETWEEN freeze_end_tick AND end_tick AND event_type IN ('error', 'click') GROUP BY 1, 2""")
def first_contact_ticks(spark, sf_dir):
    clock, i = clock_of(spark, sf_dir), F.col("event_id")
    weapon = F.when(i % 4 == 0, "weapon_Knife").when(i % 4 == 1, " AK47 ").when(i % 4 == 2, "  ").otherwise("weapon_M4")
    hits = clock.select(
        "day", "tick", "event_type", F.col("user_id").alias("attacker_id"), F.when(i % 13 != 0, i % 150).alias("victim_id"), F.when(F.col("user_id") % 2 == 0, "T").otherwise("CT").alias("attacker_side"),
        F.when(i % 3 == 0, "T").when(i % 3 == 1, "CT").alias("victim_side"), weapon.alias("weapon"),
    )
    of = lambda kind: hits.where(F.col("event_type") == kind).drop("event_type")
    return G.first_contact(halves_of(clock), of("error"), of("click"), ["day"], ["weapon_knife"]).select("day", "round_raw", "contact_tick")


_SIDES = _CLOCK + """, pl AS (SELECT DISTINCT day, tick // 43200 AS round_raw, user_id AS player_id FROM k),
 ln AS (SELECT DISTINCT day, round_raw, player_id, CASE WHEN player_id % 3 = 0 THEN 'T' ELSE 'CT' END AS side FROM pl WHERE player_id % 4 <> 3 UNION SELECT DISTINCT day, round_raw, player_id, 'T' FROM pl WHERE player_id % 10 = 1),
 ow AS (SELECT day, round_raw, player_id, CASE WHEN count(DISTINCT side) = 1 THEN min(side) END AS own FROM ln GROUP BY 1, 2, 3),
 ob AS (SELECT day, tick // 43200 AS round_raw, user_id AS player_id, arg_min(s, (tick, s)) AS seen FROM (SELECT *, CASE event_type WHEN 'view' THEN 'T' WHEN 'error' THEN 'CT' END AS s FROM k) WHERE s IS NOT NULL GROUP BY 1, 2, 3),
 sd AS (SELECT day, round_raw, player_id, coalesce(own, seen) AS side FROM pl LEFT JOIN ow USING (day, round_raw, player_id) LEFT JOIN ob USING (day, round_raw, player_id))"""


def _sides(clock: DataFrame) -> DataFrame:
    keyed = clock.select("day", F.floor(F.col("tick") / 43200).cast("int").alias("round_raw"), F.col("user_id").alias("player_id"), "tick", "event_type")
    players = keyed.select("day", "round_raw", "player_id").distinct()
    first = players.where("player_id % 4 <> 3").withColumn("side", F.when(F.col("player_id") % 3 == 0, "T").otherwise("CT"))
    lineups = first.unionByName(players.where("player_id % 10 = 1").withColumn("side", F.lit("T")))
    observed = keyed.withColumn("side", F.when(F.col("event_type") == "view", "T").when(F.col("event_type") == "error", "CT"))
    return E.player_sides(players, lineups, observed, ["day"])


@query(f"WITH {_SIDES} SELECT day, round_raw, player_id, side FROM sd")
def sides_of_players(spark, sf_dir):
    return _sides(clock_of(spark, sf_dir))


_WINDOWS = _SIDES + ", wd AS (SELECT day, round_raw, freeze_end_tick AS a, end_tick AS b FROM seg WHERE end_tick IS NOT NULL), dd AS (SELECT day, event_id, tick, user_id AS victim_id, event_id % 150 AS attacker_id FROM k WHERE event_type = 'click')"


def _game_deaths(clock: DataFrame) -> DataFrame:
    return clock.where("event_type = 'click'").select("day", "event_id", "tick", F.col("user_id").alias("victim_id"), (F.col("event_id") % 150).alias("attacker_id"))


@query(f"""WITH {_WINDOWS} SELECT dd.event_id, wd.round_raw, round((tick - a) / 64, 6) AS t_s, v.side AS victim_side, t.side AS attacker_side, 'key' || v.side AS victim_lineup_key, 'key' || t.side AS attacker_lineup_key
 FROM dd JOIN wd ON dd.day = wd.day AND tick BETWEEN a AND b JOIN sd v ON v.day = dd.day AND v.round_raw = wd.round_raw AND v.player_id = victim_id AND v.side IS NOT NULL
 LEFT JOIN sd t ON t.day = dd.day AND t.round_raw = wd.round_raw AND t.player_id = attacker_id""")
def enriched_deaths(spark, sf_dir):
    clock = clock_of(spark, sf_dir)
    segments = halves_of(clock)
    keys = segments.select("day", "round_raw", F.explode(F.array(F.lit("T"), F.lit("CT"))).alias("side")).withColumn("lineup_key", F.concat(F.lit("key"), "side"))
    rows = E.enriched_deaths(_game_deaths(clock), E.round_windows(segments, ["day"]), _sides(clock), keys, ["day"], 64, 43200)
    return rows.select("event_id", "round_raw", F.round("t_s", 6).alias("t_s"), "victim_side", "attacker_side", "victim_lineup_key", "attacker_lineup_key")


@query(f"""WITH {_WINDOWS}, i AS (SELECT dd.*, wd.round_raw FROM dd JOIN wd ON dd.day = wd.day AND tick BETWEEN a AND b) SELECT (SELECT CAST(count(*) AS BIGINT) FROM dd) AS deaths,
 (SELECT CAST(count(*) AS BIGINT) FROM dd) - (SELECT CAST(count(*) AS BIGINT) FROM i) AS outside, (SELECT CAST(count(*) AS BIGINT) FROM i LEFT JOIN sd ON sd.day = i.day AND sd.round_raw = i.round_raw AND sd.player_id = victim_id WHERE sd.side IS NULL) AS without_side""")
def lost_deaths(spark, sf_dir):
    clock = clock_of(spark, sf_dir)
    return E.death_losses(_game_deaths(clock), E.round_windows(halves_of(clock), ["day"]), _sides(clock), ["day"], 43200)


@query(f"""WITH {_CLOCK}, n AS (SELECT day, h AS round_raw, CASE WHEN h % 3 <> 0 THEN h * 2 END AS round_no FROM (SELECT DISTINCT day FROM k), (SELECT unnest(range(20)) AS h)) SELECT event_id, CAST(n.round_no AS INTEGER) AS round_no FROM k JOIN n ON k.day = n.day AND tick // 3600 = n.round_raw WHERE n.round_no IS NOT NULL""")
def numbered_events(spark, sf_dir):
    rows, rounds = _hours(clock_of(spark, sf_dir))
    return E.numbered(rows, rounds, ["day"]).select("event_id", "round_no")


def _hours(clock: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = clock.withColumn("round_raw", F.floor(F.col("tick") / 3600).cast("int"))
    hours = clock.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("round_raw"))
    return rows, hours.withColumn("round_no", F.when(F.col("round_raw") % 3 != 0, F.col("round_raw") * 2))


@query(f"WITH {_CLOCK} SELECT CAST(count(*) AS BIGINT) AS lost FROM k WHERE event_type = 'view' AND (tick // 3600 >= 20 OR tick // 3600 % 3 = 0)")
def lost_throws(spark, sf_dir):
    rows, rounds = _hours(clock_of(spark, sf_dir))
    return E.lost_rows(rows, rounds, ["day"], F.col("event_type") == "view")


_ASOF = """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), t AS (SELECT user_id, us, event_id FROM e WHERE event_type = 'purchase'), v AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'view'), c AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'click'),
 h AS (SELECT t.event_id, CASE WHEN t.us - v.us <= 14400000000 THEN 1 ELSE 0 END AS v FROM t ASOF LEFT JOIN v ON t.user_id = v.user_id AND t.us >= v.us), i AS (SELECT t.event_id, CASE WHEN t.us - c.us <= 14400000000 THEN 1 ELSE 0 END AS c FROM t ASOF LEFT JOIN c ON t.user_id = c.user_id AND t.us >= c.us),
 rs AS (SELECT event_id, CASE WHEN v + c = 1 THEN CASE WHEN v = 1 THEN 'view' ELSE 'click' END END AS kind, v + c AS hits FROM h JOIN i USING (event_id))"""


@query(_ASOF + " SELECT event_id, coalesce(kind, 'purchase') AS event_type, hits FROM rs")
def resolved_classes(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "event_type")
    throws = e.where("event_type = 'purchase'")
    found = E.resolve_class(throws, e.withColumnRenamed("event_type", "kind"), ["user_id"], "us", "event_id", ["view", "click"], 4 * 3_600_000_000)
    return E.renamed_class(throws.select("event_id", "event_type"), found, "event_id", "event_type").join(found.select("event_id", "hits"), "event_id")


@query(f"""WITH {_CLOCK}, b AS (SELECT day, tick, event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS a FROM (SELECT CAST(ts AS DATE) AS day, epoch_us(ts) AS tick, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase'))),
 x AS (SELECT *, lead(a) OVER w AS nx, lag(a) OVER w AS bf, lag(tick) OVER w AS bt FROM b WINDOW w AS (PARTITION BY day ORDER BY tick, a))
 SELECT day, tick AS at, CASE WHEN a = 0 THEN CASE WHEN bf = 1 THEN bt END ELSE tick END AS freeze_end_tick, CASE WHEN a = 0 THEN tick END AS end_tick, CASE WHEN a = 0 THEN event_id END AS event_id FROM x WHERE a = 0 OR nx IS DISTINCT FROM 0""")
def paired_anchors(spark, sf_dir):
    e = events(spark, sf_dir).select(F.to_date("ts").alias("day"), F.col("us").alias("tick"), "event_id", "event_type")
    return T.pair_anchors(e.where("event_type = 'signup'").select("day", "tick"), e.where("event_type = 'purchase'").drop("event_type"), ["day"])


@query(f"""WITH {_CLOCK}, s AS (SELECT user_id, event_id, day, tick, CASE WHEN event_type <> 'signup' THEN 1 END AS round_raw, CASE WHEN event_id % 3 <> 0 THEN event_id % 30 END AS anchor_score, CASE WHEN event_id % 4 <> 0 THEN event_id % 20 END AS end_score, event_id % 9 AS saved FROM k)
 SELECT event_id, last_value(CASE WHEN round_raw IS NULL THEN anchor_score ELSE end_score END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS score_before,
 CASE WHEN lag(round_raw) OVER w IS NOT NULL THEN lag(saved) OVER w END AS survivors_equip_prev FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day, tick, event_id)""".replace("OVER (w ROWS", "OVER (PARTITION BY user_id ORDER BY day, tick, event_id ROWS"))
def carried_readings(spark, sf_dir):
    i = F.col("event_id")
    s = clock_of(spark, sf_dir).select(
        "user_id", "event_id", "day", "tick", F.when(F.col("event_type") != "signup", 1).alias("round_raw"), F.when(i % 3 != 0, i % 30).alias("anchor_score"), F.when(i % 4 != 0, i % 20).alias("end_score"), (i % 9).alias("saved")
    )
    order = ["day", "tick", "event_id"]
    return E.saved_before(E.score_before(s, ["user_id"], order), ["user_id"], order).select("event_id", "score_before", "survivors_equip_prev")


@query(f"""WITH {_CLOCK}, s AS (SELECT day, tick // 600 AS slot, CASE WHEN user_id % 2 = 0 THEN 'T' ELSE 'CT' END AS side, min(event_id % 16) AS s FROM k WHERE event_id % 5 <> 0 GROUP BY 1, 2, 3), a AS (SELECT DISTINCT day, tick // 600 AS slot FROM k),
 t AS (SELECT day, slot, CASE WHEN count(*) = 2 THEN sum(s) END AS score FROM s GROUP BY 1, 2) SELECT a.day, a.slot, CAST(score AS BIGINT) AS score FROM a LEFT JOIN t ON a.day = t.day AND a.slot = t.slot""")
def both_sides_scores(spark, sf_dir):
    i = F.col("event_id")
    r = clock_of(spark, sf_dir).select("day", F.floor(F.col("tick") / 600).cast("int").alias("slot"), F.when(F.col("user_id") % 2 == 0, "T").otherwise("CT").alias("side"), F.when(i % 5 != 0, i % 16).alias("team_score"))
    return E.total_scores(r, ["day", "slot"])


@query(f"""WITH {_CLOCK}, c AS (SELECT day, tick // 1800 AS tick, event_type AS call, count(*) FILTER (value > 20) AS n FROM k GROUP BY 1, 2, 3), t AS (SELECT day, tick, max(n) AS n FROM c GROUP BY 1, 2) SELECT day, CAST(sum(n) AS BIGINT) AS pawnless FROM t GROUP BY 1""")
def pawnless_rows(spark, sf_dir):
    calls = clock_of(spark, sf_dir).select("day", F.floor(F.col("tick") / 1800).alias("tick"), F.col("event_type").alias("call"), F.when(F.col("value") <= 20, F.col("value")).alias("x"))
    return E.pawnless(calls, ["day"])


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS shared FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_suppkey) > 1)")
def shared_entity_ids(spark, sf_dir):
    return E.shared_entities(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_suppkey")


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT v) > 1 THEN NULL WHEN count(v) > 0 AND count(v) < count(*) THEN NULL WHEN count(v) = 0 THEN 'unknown' WHEN min(v) = '5/5' THEN 'full' WHEN min(v) = '4/5' THEN 'partial' END AS bucket,
 CASE WHEN count(DISTINCT v) > 1 THEN 'contradictory' WHEN count(v) > 0 AND count(v) < count(*) THEN 'interrupted' WHEN min(v) = '3/5' THEN 'not allowed' END AS fault
 FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '5/5' WHEN 'R' THEN CASE WHEN l_orderkey % 2 = 0 THEN '4/5' ELSE '3/5' END END AS v FROM lineitem) GROUP BY 1""")
def roster_bucket_faults(spark, sf_dir):
    value = F.when(F.col("l_returnflag") == "A", "5/5").when(F.col("l_returnflag") == "R", F.when(F.col("l_orderkey") % 2 == 0, "4/5").otherwise("3/5"))
    return V.roster_buckets(table(spark, sf_dir, "lineitem").select("l_orderkey", value.alias("v")), "l_orderkey", "v")


@query("""WITH d AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_partkey AS demo, CASE p_size % 10 WHEN 0 THEN ' de_x ' WHEN 1 THEN '  ' END AS seen FROM part),
 h AS (SELECT *, list_filter(['de_bolt', 'de_red', 'de_ring', 'de_widget'], lambda p: list_contains(string_split(lower(demo), '-'), p[4:])) AS hits FROM d)
 SELECT p_partkey, coalesce(nullif(trim(seen), ''), CASE WHEN len(hits) = 1 THEN hits[1] END, demo) AS map_name, CASE WHEN nullif(trim(seen), '') IS NOT NULL THEN 'demo_header' WHEN len(hits) = 1 THEN 'map_demo_id' ELSE 'unknown' END AS source FROM h""")
def map_names(spark, sf_dir):
    demo = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    seen = F.when(F.col("p_size") % 10 == 0, " de_x ").when(F.col("p_size") % 10 == 1, "  ")
    name, source = V.map_name(demo, seen, ["de_widget", "de_ring", "de_bolt", "de_red"])
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("map_name"), source.alias("source"))


@query("""WITH m AS (SELECT c_custkey, CAST(c_custkey % 100 AS BIGINT) AS rank, c_mktsegment AS opponent FROM customer WHERE c_nationkey < 12)
 SELECT o_orderkey, rank IS NOT NULL AS indexed, rank, CASE WHEN rank IS NOT NULL THEN DATE '2024-01-01' + CAST(rank AS INTEGER) END AS played_on, opponent FROM orders LEFT JOIN m ON o_custkey = c_custkey""")
def played_map_facts(spark, sf_dir):
    m = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("match"), (F.col("c_custkey") % 100).alias("rank"), F.col("c_mktsegment").alias("opponent"))
    m = m.withColumn("played_on", F.date_add(F.lit("2024-01-01").cast("date"), F.col("rank").cast("int")))
    return V.played_maps(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("match")), m, "match", "o_orderkey")


@query("""WITH t AS (SELECT l_orderkey, l_linestatus AS name, list(DISTINCT l_suppkey % 5) AS roster FROM lineitem GROUP BY 1, 2), h AS (SELECT *, len(list_filter(roster, lambda x: x IN (1, 2))) AS k FROM t)
 SELECT l_orderkey, CASE WHEN count(*) = 2 AND count(*) FILTER (k > 0) = 1 AND max(k) = 2 THEN min(name) FILTER (k = 0) END AS opponent FROM h GROUP BY 1""")
def opponents_by_roster(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.collect_set(F.col("l_suppkey") % 5).alias("roster"))
    m = t.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("name"), "roster")).alias("teams"))
    return m.select("l_orderkey", V.opponent_name(F.col("teams"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("opponent"))


@query("""SELECT l_suppkey, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS without_name, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity <= 40)), ','), '') AS names FROM lineitem GROUP BY 1""")
def lineup_names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") <= 40, F.col("l_returnflag")).alias("n"))
    return V.lineup_stats(li, "l_suppkey", "n").withColumn("names", F.array_join("names", ","))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS n_pairs, CAST(count(*) - count(value) AS BIGINT) AS null_value, max(value) AS max_value FROM events""")
def table_statistics(spark, sf_dir):
    return V.table_stats(table(spark, sf_dir, "events"), {"users": ["user_id"], "pairs": ["user_id", "event_type"]}, ["value"], ["value"])


@query("""WITH s AS (SELECT o_orderkey % 5 <> 0 AS ok, o_orderkey % 3 = 0 AS league, CASE WHEN o_orderkey % 2 = 0 THEN 'observed' ELSE 'predicted' END AS src, o_orderkey % 7 = 0 AS drifted, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 < 5 END AS sure, CASE WHEN o_totalprice > 200000 THEN '5/5' ELSE '4/5' END AS c FROM orders)
 SELECT CAST(count(*) AS BIGINT) AS map_demos, CAST(count(*) FILTER (ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS rejected, CAST(count(*) FILTER (league) AS BIGINT) AS league, CAST(count(*) FILTER (src = 'observed') AS BIGINT) AS observed,
 CAST(count(*) FILTER (src = 'predicted') AS BIGINT) AS predicted, CAST(count(*) FILTER (drifted) AS BIGINT) AS drifted, CAST(count(*) FILTER (sure IS NOT TRUE) AS BIGINT) AS uncertain, CAST(count(*) FILTER (ok AND c = '5/5') AS BIGINT) AS class_0, CAST(count(*) FILTER (ok AND c = '4/5') AS BIGINT) AS class_1 FROM s""")
def selection_counters(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(
        (k % 5 != 0).alias("roster_ok"), (k % 3 == 0).alias("is_league"), F.when(k % 2 == 0, "observed").otherwise("predicted").alias("roster_source"), (k % 7 == 0).alias("drifted"),
        F.when(k % 4 != 0, k % 8 < 5).alias("certainly_played"), F.when(F.col("o_totalprice") > 200000, "5/5").otherwise("4/5").alias("roster_class"),
    )
    return V.selection_counts(s, ["5/5", "4/5"])


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS o, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS p FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, coalesce(o, []) AS o, coalesce(p, []) AS p FROM g)
 SELECT l_orderkey, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(p, x))), ',') AS extra, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(o, x))), ',') AS absent FROM n""")
def roster_drift(spark, sf_dir):
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("R").alias("o"), of("A").alias("p"))
    extra, absent = V.drift(F.col("o"), F.col("p"))
    return g.select("l_orderkey", F.array_join(extra.cast("array<string>"), ",").alias("extra"), F.array_join(absent.cast("array<string>"), ",").alias("absent"))


_ENTRIES = "SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_returnflag) AS k FROM lineitem"


@query(f"WITH e AS ({_ENTRIES}) SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag FROM e WHERE k = 1 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def first_reasons(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    included = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return V.first_reason(li, included, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(f"WITH e AS ({_ENTRIES}) SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AS is_present FROM e WHERE k = 1")
def pending_downloads(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    present = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return V.pending(li, present, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'other competition' WHEN c_nationkey % 5 = 0 THEN 'not played' WHEN c_custkey % 4 = 0 THEN 'no maps' END AS reason FROM customer""")
def planned_matches(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    picks = F.array_repeat(F.lit("m"), (F.col("c_custkey") % 4).cast("int"))
    m = c.select("c_custkey", F.col("c_mktsegment").alias("competition_id"), F.when(F.col("c_nationkey") % 5 != 0, "finished").alias("status"), picks.alias("map_picks"))
    return V.plan_matches(m, ["BUILDING", "MACHINERY"]).select("c_custkey", "reason")


@query("""SELECT p_partkey, round((p_size - 2.0) / 3, 6) AS px, round((2000.0 - p_retailprice) / 3, 6) AS py, CASE WHEN floor((p_size - 2.0) / 40) BETWEEN 0 AND 25 AND floor((2000.0 - p_retailprice) / 40) >= 0 THEN chr(CAST(floor((p_size - 2.0) / 40) AS INTEGER) + 65) || CAST(floor((2000.0 - p_retailprice) / 40) + 1 AS INTEGER) END AS square,
 replace(regexp_replace(printf('%.3f', p_size / 4), '\\.?0+$', ''), '.', ',') || ' s' AS label FROM part""")
def image_points(spark, sf_dir):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    px, py = V.pixel(x, y, 2.0, 2000.0, 3.0)
    square = V.grid_square(x, y, 2.0, 2000.0, 40.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), square.alias("square"), V.seconds_label(x / 4).alias("label"))


@query("""SELECT l_orderkey, l_linestatus, CAST(sum(b) AS INTEGER) AS money_buy_end, CAST(count(*) AS INTEGER) AS players_buy_end, array_to_string(list_reverse(list_sort(list(b))), ',') AS money,
 CASE WHEN count(*) = count(a) AND count(*) = count(i) THEN CAST(count(*) FILTER (a > 0 AND i = 'R') AS INTEGER) END AS players_armed_buy_end, CASE WHEN count(*) = count(a) THEN CAST(count(*) FILTER (a > 0) AS INTEGER) END AS players_armored_buy_end
 FROM (SELECT *, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity AS INTEGER) * 100 END AS b, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 3 * 50 END AS a, CASE WHEN l_partkey % 29 <> 0 THEN l_returnflag END AS i FROM lineitem) WHERE b IS NOT NULL GROUP BY 1, 2""")
def side_economy(spark, sf_dir):
    k = F.col("l_partkey")
    r = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linestatus", F.when(k % 9 != 0, F.col("l_quantity").cast("int") * 100).alias("balance"), F.lit(1).alias("cash_spent"), F.lit(1).alias("equip_current"), F.lit(1).alias("equip_round_start"),
        F.when(k % 11 != 0, k % 3 * 50).alias("armor_value"), E.inventory(F.when(k % 29 != 0, F.array(F.concat(F.lit(" "), "l_returnflag"), F.lit(" ")))).alias("inventory"),
    )
    out = T.economy_sums(r, ["l_orderkey", "l_linestatus"], ["R"])
    return out.select("l_orderkey", "l_linestatus", "money_buy_end", "players_buy_end", F.array_join(F.col("money_players_buy_end").cast("array<string>"), ",").alias("money"), "players_armed_buy_end", "players_armored_buy_end")


_PATHS = """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY us, event_id) AS b FROM e),
 s AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY us, event_id) AS path FROM p WHERE b IS DISTINCT FROM event_type GROUP BY 1, 2), x AS (SELECT user_id, day, path, unnest(range(1, len(path) + 1)) AS depth FROM s)"""


@query(_PATHS + """ SELECT day, array_to_string(path[1:depth], '>') AS prefix, CAST(depth AS INTEGER) AS depth, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS walkers,
 coalesce(array_to_string(list_sort(list(DISTINCT user_id) FILTER (len(path) = depth)), ','), '') AS stayers, array_to_string(path[1:depth - 1], '>') AS parent FROM x GROUP BY day, path[1:depth], depth, path[1:depth - 1]""")
def path_tree(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    tree = P.prefix_tree(P.label_paths(e, ["user_id", "day"], ["us", "event_id"], "event_type"), ["day"], "user_id")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "," if c in ("walkers", "stayers") else ">").alias(c)
    return tree.select("day", text("prefix"), "depth", text("walkers"), text("stayers"), text("parent"))


@query(_PATHS + """, f AS (SELECT user_id, day, path, list_position(list_transform(path, lambda v: v IN ('click', 'error')), TRUE) AS k FROM s) SELECT user_id, day, CASE WHEN k > 0 THEN array_to_string(path[k:], '>') ELSE '' END AS path FROM f""")
def paths_from_junction(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    paths = P.label_paths(e, ["user_id", "day"], ["us", "event_id"], "event_type")
    return paths.withColumn("path", F.array_join(P.from_first(F.col("path"), F.array(F.lit("click"), F.lit("error"))), ">"))


@query("""SELECT c_mktsegment, arg_max(n, (CASE n WHEN 'x0' THEN 1 WHEN 'x1' THEN 2 ELSE 3 END, n)) AS n FROM (SELECT c_mktsegment, 'x' || (c_nationkey % 4) AS n FROM customer) GROUP BY 1""")
def weakest_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.concat(F.lit("x"), (F.col("c_nationkey") % 4).cast("string")).alias("n"))
    return Q.weakest_source(c, ["c_mktsegment"], "n", ["x0", "x1"])


@query("SELECT c_custkey, CAST(2 AS INTEGER) AS tier FROM customer WHERE lower(trim(c_name)) LIKE 'customer#00000000%'")
def names_by_tier(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    return K.find_by_name(c, " CUSTOMER#00000000 ", "key", "c_name").select("c_custkey", "tier")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS INTEGER) AS rank FROM customer")
def matches_newest_first(spark, sf_dir):
    return K.ranked_matches(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "rank")


@query(_PATHS + """, y AS (SELECT day, path[1:depth] AS prefix FROM x GROUP BY day, path[1:depth] HAVING count(DISTINCT user_id) >= 2), u AS (SELECT prefix, list_sort(list(DISTINCT day)) AS units FROM y GROUP BY 1)
 SELECT array_to_string(a.prefix, '>') AS prefix, CAST(len(a.units) AS INTEGER) AS units FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.prefix[1] = a.prefix[1] AND len(b.prefix) > len(a.prefix) AND b.prefix[1:len(a.prefix)] = a.prefix AND len(list_filter(a.units, lambda d: NOT list_contains(b.units, d))) = 0)""")
def longest_patterns(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    paths = P.label_paths(e, ["user_id", "day"], ["us", "event_id"], "event_type")
    shared = P.prefixes(paths).groupBy("day", "prefix").agg(F.countDistinct("user_id").alias("k")).where("k >= 2")
    patterns = shared.groupBy("prefix").agg(F.collect_set("day").alias("units"))
    return P.without_subsumed(patterns, [], "prefix", "units").select(F.array_join("prefix", ">").alias("prefix"), F.size("units").alias("units"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id AS tick, CAST(epoch_us(ts) AS DOUBLE) / 15e9 AS seconds FROM events), s AS (SELECT day, (tick - lag(tick) OVER w) / nullif(seconds - lag(seconds) OVER w, 0) AS r FROM e WINDOW w AS (PARTITION BY day ORDER BY tick)),
 m AS (SELECT day, round_even(median(CASE WHEN r > 0 THEN r END), 0) AS r FROM s GROUP BY 1) SELECT day, CASE WHEN r BETWEEN 16 AND 256 THEN r ELSE 64.0 END AS tick_rate FROM m""")
def tick_rates(spark, sf_dir):
    e = events(spark, sf_dir).select(F.to_date("ts").alias("day"), F.col("event_id").alias("tick"), (F.col("us").cast("double") / 15e9).alias("seconds"))
    return T.tick_rate(e, ["day"])


@query("""WITH n AS (SELECT 'm' || (n_nationkey % 2) AS map_name, 'A' || n_nationkey AS area, 'spot ' || n_nationkey AS callout, n_nationkey % 4 = 0 AS coarse, CASE WHEN n_nationkey % 3 = 0 THEN 'inferred' ELSE 'sure' END AS confidence FROM nation WHERE n_nationkey < 18),
 s AS (SELECT s_suppkey, 'm' || (s_suppkey % 3) AS map_name, CASE WHEN s_suppkey % 11 <> 0 THEN 'A' || s_nationkey END AS area FROM supplier)
 SELECT s_suppkey, s.map_name, coalesce(callout, s.area) AS area, CASE WHEN s.area IS NULL THEN NULL WHEN s.map_name NOT IN (SELECT map_name FROM n) THEN 'no_table' WHEN callout IS NULL THEN 'no_callout' WHEN coarse AND confidence = 'inferred' THEN 'coarse_inferred'
 WHEN coarse THEN 'coarse' WHEN confidence = 'inferred' THEN 'inferred' END AS area_flag FROM s LEFT JOIN n ON s.map_name = n.map_name AND s.area = n.area""")
def called_areas(spark, sf_dir):
    k = F.col("n_nationkey")
    callouts = table(spark, sf_dir, "nation").where("n_nationkey < 18").select(
        F.concat(F.lit("m"), (k % 2).cast("string")).alias("map_name"), F.concat(F.lit("A"), k.cast("string")).alias("area"), F.concat(F.lit("spot "), k.cast("string")).alias("callout"),
        (k % 4 == 0).alias("coarse"), F.when(k % 3 == 0, "inferred").otherwise("sure").alias("confidence"),
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("map_name"), F.when(F.col("s_suppkey") % 11 != 0, F.concat(F.lit("A"), F.col("s_nationkey").cast("string"))).alias("area"))
    return T.named_areas(rows, callouts, ["area"])


@query("""SELECT 'force_buy_min' AS name, CAST(NULL AS BIGINT) AS value, CAST(count(DISTINCT 1000 + o_custkey % 2) AS BIGINT) AS values FROM orders HAVING count(DISTINCT o_custkey % 2) > 1 UNION ALL SELECT 'full_equip_min', CAST(4000 AS BIGINT), CAST(1 AS BIGINT)""")
def thresholds_in_use(spark, sf_dir):
    inputs = F.struct(F.lit(4000).alias("full_equip_min"), (1000 + F.col("o_custkey") % 2).alias("force_buy_min"))
    return Q.used_thresholds(table(spark, sf_dir, "orders").select(inputs.alias("inputs")), "inputs", ["full_equip_min", "force_buy_min"])


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 'u' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN '-' || (o_orderkey % 4) WHEN 1 THEN '-1-' || (o_orderkey % 4) ELSE '' END AS unit FROM orders)
 SELECT k, coalesce(CASE WHEN k % 5 <> 0 THEN 1 END + CASE WHEN k % 7 <> 0 THEN 2 END, CASE WHEN k % 5 <> 0 THEN 1 END, CASE WHEN k % 7 <> 0 THEN 2 END) AS money, [1400, 1900, 2400, 2900, 3400][CAST(greatest(0, least(k % 9 - 2, 4)) + 1 AS INTEGER)] AS bonus,
 'u' || c AS match, CASE WHEN k % 3 < 2 THEN CAST(k % 4 AS INTEGER) END AS number, CAST(k % 6 // 2 + 1 AS INTEGER) AS sure, CASE WHEN k % 12 BETWEEN 1 AND 9 THEN CAST(k % 12 AS INTEGER) END AS best,
 CASE k % 4 WHEN 0 THEN 'ak47' WHEN 1 THEN 'm4' ELSE NULL END AS weapon, k % 4 < 2 AS steam, CASE k % 3 WHEN 0 THEN 'molotov' ELSE 'g' || (k % 3) END AS kind, CAST(k % 3 AS INTEGER) AS place, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'x' || k END AS id,
 greatest(1, CAST(round_even(0.125 * (k % 200), 0) AS INTEGER)) AS gap, CASE WHEN k % 5 = 0 THEN 'T' WHEN k % 4 = 2 THEN 'T' WHEN k % 4 = 3 THEN 'CT' END AS side,
 CASE WHEN k % 3 = 0 THEN DATE '2024-03-01' WHEN k % 3 = 1 THEN DATE '2024-02-29' END AS day FROM o""")
def scalar_rules(spark, sf_dir):
    from tellmark.functions import scalars as S

    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    unit = F.concat(F.lit("u"), text(F.col("o_custkey")), F.when(k % 3 == 0, F.concat(F.lit("-"), text(k % 4))).when(k % 3 == 1, F.concat(F.lit("-1-"), text(k % 4))).otherwise(""))
    steam = F.when(k % 4 == 0, "76561197960265729").when(k % 4 == 1, "76561198000000000").when(k % 4 == 2, "76561197960265728").otherwise("7656119800000000")
    kind = F.when(k % 3 == 0, "inferno").otherwise(F.concat(F.lit("g"), text(k % 3)))
    weapon = F.when(k % 4 == 0, " weapon_AK47 ").when(k % 4 == 1, "M4").when(k % 4 == 2, "  ")
    day = F.when(k % 3 == 0, "2024-03-01T00:30:00Z").when(k % 3 == 1, "2024-03-01T00:30:00+02:00").otherwise("2024-03-01T00:30:00")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), S.available(F.when(k % 5 != 0, 1), F.when(k % 7 != 0, 2)).alias("money"), S.ladder([1400, 1900, 2400, 2900, 3400], k % 9 - 2).alias("bonus"), S.match_of(unit).alias("match"),
        S.unit_number(unit).alias("number"), S.sure_maps(k % 6).alias("sure"), S.best_of(text(k % 12)).alias("best"), S.weapon_name(weapon).alias("weapon"), S.is_steam_id(steam).alias("steam"),
        S.recode(kind, {"inferno": "molotov"}).alias("kind"), S.strict_rank(F.concat(F.lit("g"), text(k % 3)), ["g0", "g1", "g2"]).alias("place"),
        S.id_text(F.when(k % 2 == 0, F.concat(text(k), F.lit(".0"))).otherwise(F.concat(F.lit("x"), text(k)))).alias("id"), E.gap_ticks(k % 200).alias("gap"),
        E.side_of(F.when(k % 5 == 0, "T"), (k % 4).cast("int")).alias("side"), S.utc_date(day).alias("day"),
    )


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), p AS (SELECT b.l_suppkey, count(*) AS common FROM s a JOIN s b USING (l_partkey) WHERE a.l_suppkey = 1 GROUP BY 1) SELECT l_suppkey, CAST(common AS BIGINT) AS common FROM p WHERE common >= 4 OR l_suppkey = 1""")
def similar_lineups(spark, sf_dir):
    return K.lineups_like(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), 1, "l_suppkey", "l_partkey", 4)


@query("""WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS match_id, CAST(c_custkey % 5 + 1 AS INTEGER) AS best_of, unnest(range(c_custkey % 4)) AS i FROM customer) SELECT match_id, CAST(i AS INTEGER) AS map_index, 'map' || i AS map_name, match_id || '-' || (i + 1) AS map_demo_id, i < best_of // 2 + 1 AS certainly_played FROM m""")
def candidate_map_rows(spark, sf_dir):
    from tellmark.sources.archive import candidate_maps

    k = F.col("c_custkey")
    picks = F.transform(F.array_repeat(F.lit("map"), (k % 4).cast("int")), lambda x, i: F.concat(x, i.cast("string")))
    m = table(spark, sf_dir, "customer").select(k.cast("string").alias("match_id"), (k % 5 + 1).cast("int").alias("best_of"), picks.alias("map_picks"))
    return candidate_maps(m).select("match_id", "map_index", "map_name", "map_demo_id", "certainly_played")
