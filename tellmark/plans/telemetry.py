"""Operators on positions and throws applied to the driver's tables: lines as throws of many units, events as positions on pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.operators import anomalies as A
from tellmark.operators import grids as H
from tellmark.operators import report as Q
from tellmark.operators import segments as S
from tellmark.operators import spatial as X
from tellmark.operators import throws as W
from tellmark.operators.matching import grid_cells
from tellmark.plans.catalogue import query
from tellmark.plans.game import _ROUNDS, _SEEN, rounds_of, seen_of
from tellmark.session import dealt, shared_dir, table
from tellmark.sources import generations as B

# -- throws of many units, each by its own cloud --------------------------------

UNITS = 20
_THROW_ROWS = f"""g AS (SELECT l_orderkey * 8 + l_linenumber AS grenade_no, l_orderkey % {UNITS} AS unit, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) AS f, min(l_linestatus) AS st, min(l_linenumber) AS ln, min(l_orderkey) AS k
 FROM lineitem GROUP BY l_orderkey, l_linenumber),
 ep AS (SELECT unit, grenade_no, 'grenade_thrown' AS event_kind, f AS grenade_type, CASE WHEN p % 23 <> 0 THEN s % 10 END AS thrower_id, (k * 977 + ln * 131) % 40000 AS tick, CAST(p % 500 AS DOUBLE) AS x, CAST(s * 7 % 500 AS DOUBLE) AS y, CAST(ln * 40 AS DOUBLE) AS z FROM g
 UNION ALL SELECT unit, grenade_no, 'grenade_detonate', f, CASE WHEN p % 23 <> 0 THEN s % 10 END, (k * 977 + ln * 131) % 40000 + CAST(q * 10 AS BIGINT), CASE WHEN p % 41 <> 0 THEN CAST(p * 3 % 700 AS DOUBLE) END, CAST(s * 11 % 700 AS DOUBLE), CAST(p % 300 AS DOUBLE) FROM g WHERE st = 'F'),
 w AS (SELECT DISTINCT o_custkey % {UNITS} AS unit, o_orderkey % 40 AS round_raw, o_orderkey % 40 * 1000 AS start_tick, o_orderkey % 40 * 1000 + 799 AS stop_tick FROM orders),
 sd AS (SELECT unit, round_raw, r.i AS player_id, CASE WHEN (r.i + round_raw) % 2 = 0 THEN 'T' ELSE 'CT' END AS side FROM w, (SELECT unnest(range(10)) AS i) r WHERE (r.i * 7 + round_raw + unit) % 11 <> 0),
 ps AS (SELECT unit, tick, thrower_id AS player_id, min(CASE WHEN s % 13 <> 0 THEN 'A' || (s % 5) END) AS area FROM ep JOIN g USING (unit, grenade_no) WHERE event_kind = 'grenade_thrown' AND p % 7 <> 0 GROUP BY ALL),
 cl AS (SELECT p_partkey % {UNITS} AS unit, CAST(p_partkey * 13 % 20 AS INTEGER) AS cell_x, CAST(p_size % 20 AS INTEGER) AS cell_y, CAST(p_partkey % 6 AS INTEGER) AS cell_z, p_brand AS area FROM part WHERE p_partkey % {UNITS} <> 3),
 ce AS (SELECT unit, cell_x, cell_y, cell_z, arg_min(area, (-n, area)) AS area FROM (SELECT unit, cell_x, cell_y, cell_z, area, count(*) AS n FROM cl GROUP BY ALL) GROUP BY 1, 2, 3, 4)"""
_KEPT_ROWS = f"""WITH {_THROW_ROWS}, rd AS (SELECT ep.unit, grenade_no, round_raw, start_tick, stop_tick FROM ep JOIN w ON w.unit = ep.unit AND tick BETWEEN start_tick AND stop_tick WHERE event_kind = 'grenade_thrown' AND thrower_id IS NOT NULL),
 j AS (SELECT ep.*, rd.round_raw, start_tick, stop_tick, side, ps.area AS own, ps.unit IS NOT NULL AS seen FROM ep LEFT JOIN rd USING (unit, grenade_no)
  LEFT JOIN sd ON sd.unit = ep.unit AND sd.round_raw = rd.round_raw AND sd.player_id = ep.thrower_id LEFT JOIN ps ON ps.unit = ep.unit AND ps.tick = ep.tick AND ps.player_id = ep.thrower_id)"""


def _throw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p, s, k, ln = (F.col(c) for c in ("p", "s", "l_orderkey", "l_linenumber"))
    ident = [(k % UNITS).alias("unit"), (k * 8 + ln).alias("grenade_no")]
    # lines are dealt by the throw's key, so that what is grouped or joined by it stays where it is
    g = table(spark, sf_dir, "lineitem").repartition(k % UNITS, k * 8 + ln).select("*", *ident).groupBy("unit", "grenade_no", "l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("st")
    )
    tick = (k * 977 + ln * 131) % 40000
    g = g.select("unit", "grenade_no", p, s, "q", "f", "st", tick.alias("tick"), ln)
    number = lambda c: c.cast("double")
    names = [F.col("f").alias("grenade_type"), F.when(p % 23 != 0, s % 10).alias("thrower_id")]
    # both events of a line come from one row, so that lines are grouped once for them
    event = lambda kind, at, x, y, z: F.struct(F.lit(kind).alias("event_kind"), at.cast("long").alias("tick"), x.alias("x"), y.alias("y"), z.alias("z"))
    thrown = event(W.THROWN, F.col("tick"), number(p % 500), number(s * 7 % 500), number(ln * 40))
    gone = event(W.DETONATED, F.col("tick") + (F.col("q") * 10).cast("long"), F.when(p % 41 != 0, number(p * 3 % 700)), number(s * 11 % 700), number(p % 300))
    each = F.explode(F.when(F.col("st") == "F", F.array(thrown, gone)).otherwise(F.array(thrown)))
    endpoints = g.select("unit", "grenade_no", *names, each.alias("e")).select("unit", "grenade_no", "e.event_kind", "grenade_type", "thrower_id", "e.tick", "e.x", "e.y", "e.z")
    o = table(spark, sf_dir, "orders")
    r = F.col("o_orderkey") % 40
    windows = o.select((F.col("o_custkey") % UNITS).alias("unit"), r.alias("round_raw"), (r * 1000).alias("start_tick"), (r * 1000 + 799).alias("stop_tick")).distinct()
    players = windows.select("unit", "round_raw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("player_id"))
    odd = (F.col("player_id") + F.col("round_raw")) % 2
    sides = players.where((F.col("player_id") * 7 + F.col("round_raw") + F.col("unit")) % 11 != 0).withColumn("side", F.when(odd == 0, "T").otherwise("CT"))
    lineups = windows.select("unit", "round_raw", F.explode(F.array(F.lit("T"), F.lit("CT"))).alias("side")).withColumn("lineup_key", F.concat("side", (F.col("unit") % 3).cast("string")))
    area = F.when(s % 13 != 0, F.concat(F.lit("A"), (s % 5).cast("string")))
    positions = g.where((p % 23 != 0) & (p % 7 != 0)).select("unit", "tick", (s % 10).alias("player_id"), area.alias("area"))
    k = F.col("p_partkey")
    cloud = table(spark, sf_dir, "part").where(k % UNITS != 3).select((k % UNITS).alias("unit"), (k * 13 % 20).alias("x"), (F.col("p_size") % 20).alias("y"), (k % 6).alias("z"), F.col("p_brand").alias("area"))
    # at most 40 rounds of each of UNITS, however large the tables are
    windows, sides, lineups = (F.broadcast(d) for d in (windows, sides, lineups))
    return {"endpoints": endpoints, "windows": windows, "sides": sides, "lineups": lineups, "positions": positions, "cells": grid_cells(cloud, ["x", "y", "z"], 1, "area", ["unit"])}


def _named(spark: SparkSession, sf_dir: str):
    return W.named_events(**_throw_tables(spark, sf_dir), unit=["unit"], rate=64.0, grid=32.0, limit=100.0, types=["R", "N"], width=1000)


@query(_KEPT_ROWS + """, d AS (SELECT j.unit, grenade_no, area, sqrt(pow(x - (cell_x + 0.5) * 32, 2) + pow(y - (cell_y + 0.5) * 32, 2) + pow(greatest(0.0, abs(z - (cell_z + 0.5) * 32) - 72) * 1.5, 2)) AS dist FROM j JOIN ce ON ce.unit = j.unit WHERE event_kind = 'grenade_detonate' AND x IS NOT NULL),
 m AS (SELECT unit, grenade_no, min(dist) AS dist, arg_min(area, (dist, area)) AS area FROM d GROUP BY 1, 2)
 SELECT j.unit, round_raw, event_kind, j.grenade_no, grenade_type, thrower_id, side || (j.unit % 3) AS lineup_key, side, (tick - start_tick) / 64.0 AS t_s, x, y, z,
 CASE WHEN event_kind = 'grenade_thrown' THEN own WHEN dist <= 100 THEN m.area END AS area,
 CASE WHEN event_kind = 'grenade_thrown' THEN CASE WHEN own IS NOT NULL THEN 'observed' END WHEN dist <= 100 THEN 'point_cloud' END AS area_source,
 round(CASE WHEN event_kind <> 'grenade_thrown' AND dist <= 100 THEN dist END, 6) AS snap_distance
 FROM j LEFT JOIN m ON m.unit = j.unit AND m.grenade_no = j.grenade_no AND event_kind = 'grenade_detonate' WHERE thrower_id IS NOT NULL AND round_raw IS NOT NULL AND side IS NOT NULL""")
def named_throws(spark, sf_dir):
    return _named(spark, sf_dir)[0].withColumn("snap_distance", F.round("snap_distance", 6))


@query(_KEPT_ROWS + """ SELECT CAST(count(*) FILTER (event_kind = 'grenade_thrown' AND thrower_id IS NULL) AS BIGINT) AS without_thrower, CAST(count(*) FILTER (event_kind = 'grenade_thrown' AND thrower_id IS NOT NULL AND round_raw IS NULL) AS BIGINT) AS outside_rounds,
 CAST(count(*) FILTER (event_kind = 'grenade_thrown' AND thrower_id IS NOT NULL AND round_raw IS NOT NULL AND side IS NULL) AS BIGINT) AS unknown_side,
 CAST(count(*) FILTER (event_kind = 'grenade_thrown' AND thrower_id IS NOT NULL AND grenade_type NOT IN ('R', 'N')) AS BIGINT) AS unknown_type,
 CAST(count(*) FILTER (event_kind = 'grenade_thrown' AND side IS NOT NULL AND NOT seen) AS BIGINT) AS throwers_without_row, CAST(count(*) FILTER (event_kind <> 'grenade_thrown' AND side IS NOT NULL AND tick > stop_tick) AS BIGINT) AS detonating_after_round,
 CAST(count(*) FILTER (side IS NOT NULL) AS BIGINT) AS events FROM j""")
def throw_losses(spark, sf_dir):
    """The counters of the pass that writes the events, read after it."""
    events, observed = _named(spark, sf_dir)
    shared_dir(spark)
    events.write.format("noop").mode("overwrite").save()
    found = observed.get
    return spark.createDataFrame([tuple(found[c] for c in W.COUNTS)], ", ".join(f"{c} long" for c in W.COUNTS))


# -- parts of areas on a picture's grid --------------------------------------------

_GRID_ROWS = """sp AS (SELECT 'm' || m AS map_name, t AS area, m AS mi, 0.5 AS sx, 100.0 AS bx, 0.5 AS sy, 400.0 AS "by", CASE WHEN m = 1 THEN -50.0 END AS zmin, CASE WHEN m = 2 THEN 150.0 END AS zmax, 20.0 AS ox, 30.0 AS oy, 40.0 AS cw, 32.0 AS ch,
  'ABCDEFGH' AS columns, 10 AS rows, t <> 'view' AS coarse FROM (SELECT DISTINCT user_id % 3 AS m, event_type AS t FROM events)),
 hc AS (SELECT s_suppkey AS k, 'm' || (s_suppkey % 3) AS map_name, CASE s_suppkey // 3 % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'error' END AS area, s_suppkey * 7 % 16 AS c, s_suppkey * 5 % 20 AS r, s_suppkey // 12 % 4 AS kd FROM supplier WHERE s_suppkey <= 96),
 cm AS (SELECT *, CAST(k % 5 AS INTEGER) AS part_no, 'p' || (k % 5) AS part, k % 5 > 1 AS broad FROM hc),
 rc AS (SELECT map_name, area, part_no, part, broad, kd, k, c, r, CASE kd WHEN 0 THEN 20.0 + c * 20 WHEN 1 THEN 20.0 + c * 20 + 0.25 * 20 WHEN 2 THEN 20.0 + (c % 15 + 1) * 20 - 10 ELSE 20.0 + c * 8 END AS x0,
  CASE kd WHEN 0 THEN 30.0 + r * 16 WHEN 1 THEN 30.0 + r * 16 WHEN 2 THEN 30.0 + (r % 19 + 1) * 16 - 8 ELSE 30.0 + r * 6 END AS y0,
  CASE kd WHEN 0 THEN 20.0 + (c + 1) * 20 WHEN 1 THEN 20.0 + (c + 1) * 20 WHEN 2 THEN 20.0 + (c % 15 + 1) * 20 + 10 ELSE 20.0 + c * 8 + 12 END AS x1,
  CASE kd WHEN 0 THEN 30.0 + (r + 1) * 16 WHEN 1 THEN 30.0 + r * 16 + 0.5 * 16 WHEN 2 THEN 30.0 + (r % 19 + 1) * 16 + 8 ELSE 30.0 + r * 6 + 12 END AS y1,
  CASE WHEN kd IN (1, 2) AND k % 2 = 0 THEN 0.0 END AS z_low, CASE WHEN kd IN (1, 2) AND k % 2 = 0 THEN 100.0 END AS z_high, CASE WHEN kd = 3 THEN 0 ELSE 1 END AS rk, CASE WHEN kd IN (0, 3) THEN 0 ELSE 1 END AS sb FROM cm),
 nm AS (SELECT map_name, area, c, r, arg_min(part, (part_no, k)) AS part, min((part_no, k)) AS rank FROM rc WHERE kd = 0 GROUP BY 1, 2, 3, 4)"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    one = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("m"), F.col("event_type").alias("area")).distinct()
    return one.select(
        F.concat(F.lit("m"), m.cast("string")).alias("map_name"), "area", *(F.lit(v).alias(n) for n, v in (("sx", 0.5), ("bx", 100.0), ("sy", 0.5), ("by", 400.0))),
        F.when(m == 1, -50.0).alias("zmin"), F.when(m == 2, 150.0).alias("zmax"), *(F.lit(v).alias(n) for n, v in (("ox", 20.0), ("oy", 30.0), ("cw", 40.0), ("ch", 32.0))),
        F.lit("ABCDEFGH").alias("columns"), F.lit(10).alias("rows"), (F.col("area") != "view").alias("coarse"),
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, r = F.col("k"), F.col("c"), F.col("r")
    letters = F.lit("ABCDEFGH")
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 96").select(
        F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7 % 16).cast("int").alias("c"), (F.col("s_suppkey") * 5 % 20).cast("int").alias("r"), F.expr("CAST(s_suppkey div 12 % 4 AS INT)").alias("kd")
    )
    s = s.withColumn("kind", F.element_at(F.array(*map(F.lit, ("cell", "region", "crossing", "box"))), F.col("kd") + 1))
    kind = F.col("kind")
    cc, rr = F.when(kind == "crossing", c % 15).otherwise(c), F.when(kind == "crossing", r % 19).otherwise(r)
    name = lambda dc, dr: H.cell_name(cc + dc, rr + dr, letters)
    only = lambda which, value: F.when(kind == which, value)
    band = kind.isin("region", "crossing") & (k % 2 == 0)
    areas = F.element_at(F.array(*map(F.lit, ("view", "click", "signup", "error"))), F.expr("CAST(k div 3 % 4 AS INT)") + 1)
    return s.select(
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("map_name"), areas.alias("area"), (k % 5).cast("int").alias("part_no"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("part"), (k % 5 > 1).alias("broad"),
        "kind", k.cast("int").alias("claim_no"), F.when(kind.isin("cell", "region"), name(0, 0)).alias("cell"), only("crossing", F.array(name(0, 0), name(1, 1))).alias("cells"),
        F.coalesce(only("box", 20.0 + c * 8), only("region", F.lit(0.25))).alias("x_low"), F.coalesce(only("box", 20.0 + c * 8 + 12), only("region", F.lit(1.0))).alias("x_high"),
        F.coalesce(only("box", 30.0 + r * 6), only("region", F.lit(0.0))).alias("y_low"), F.coalesce(only("box", 30.0 + r * 6 + 12), only("region", F.lit(0.5))).alias("y_high"),
        only("crossing", F.lit(1.0)).alias("size"), F.when(band, 0.0).alias("z_low"), F.when(band, 100.0).alias("z_high"),
    )


_POINTS = "pt AS (SELECT event_id, 'm' || (user_id % 3) AS map_name, event_type AS area, CASE WHEN event_id % 97 <> 0 THEN CAST(event_id * 37 % 900 - 200 AS DOUBLE) END AS x, CAST(event_id * 53 % 900 - 100 AS DOUBLE) AS y, CAST(event_id % 300 - 100 AS DOUBLE) AS z, event_id % 3 <> 0 AS stands FROM events)"


@query(f"""WITH {_GRID_ROWS}, {_POINTS}, q AS (SELECT pt.*, sp.coarse, sp.map_name IS NOT NULL AND x IS NOT NULL AND z >= coalesce(zmin, -1e9) AND z < coalesce(zmax, 1e9) AS placed, sx * x + bx AS px, -sy * y + "by" AS py FROM pt LEFT JOIN sp USING (map_name, area)),
 h AS (SELECT event_id, arg_min(part, (rk, part_no, sb, k)) AS part FROM q JOIN rc USING (map_name, area) WHERE placed AND px >= x0 AND px < x1 AND py >= y0 AND py < y1 AND (z_low IS NULL OR (stands AND z >= z_low AND z < z_high)) GROUP BY 1),
 n AS (SELECT event_id, arg_min(nm.part, (pow((nm.c - floor((px - 20) / 20)) * 20, 2) + pow((nm.r - floor((py - 30) / 16)) * 16, 2), rank)) AS part FROM q JOIN nm USING (map_name, area) WHERE placed AND coarse GROUP BY 1)
 SELECT event_id, coalesce(h.part, n.part) AS part FROM pt LEFT JOIN h USING (event_id) LEFT JOIN n USING (event_id)""")
def grid_parts(spark, sf_dir):
    splits = _splits(spark, sf_dir)
    plans, grid = H.compile_grid(splits, H.claim_rects(splits, _claims(spark, sf_dir)))
    k = F.col("event_id")
    points = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("map_name"), F.col("event_type").alias("area"), F.when(k % 97 != 0, (k * 37 % 900 - 200).cast("double")).alias("x"),
        (k * 53 % 900 - 100).cast("double").alias("y"), (k % 300 - 100).cast("double").alias("z"), (k % 3 != 0).alias("stands"),
    )
    return H.part_at(points, plans, grid, F.col("stands")).select("event_id", "part")


@query(f"""WITH {_GRID_ROWS}, ix AS (SELECT sp.map_name, sp.area, CAST(c.i AS INTEGER) AS c, CAST(r.i AS INTEGER) AS r FROM sp, (SELECT unnest(range(16)) AS i) c, (SELECT unnest(range(20)) AS i) r WHERE coarse),
 d AS (SELECT ix.map_name, ix.area, ix.c, ix.r, arg_min(nm.part, (pow((nm.c - ix.c) * 20, 2) + pow((nm.r - ix.r) * 16, 2), rank)) AS part FROM ix JOIN nm USING (map_name, area) GROUP BY 1, 2, 3, 4)
 SELECT map_name, area, substr('ABCDEFGH', c // 2 + 1, 1) || (r // 2 + 1) || substr('abcd', 2 * (r % 2) + c % 2 + 1, 1) AS cell, part FROM d ANTI JOIN nm USING (map_name, area, c, r)""")
def grid_inherited(spark, sf_dir):
    splits = _splits(spark, sf_dir)
    return H.inherited(*H.compile_grid(splits, H.claim_rects(splits, _claims(spark, sf_dir))))


@query(f"""WITH {_GRID_ROWS}, lv AS (SELECT *, coalesce(z_low, -1e9) AS lo, coalesce(z_high, 1e9) AS hi FROM rc),
 mt AS (SELECT a.map_name, a.area, a.part AS a_part, b.part, a.part_no AS a_no, b.part_no, a.kd AS a_kd, b.kd, b.broad FROM lv a JOIN lv b USING (map_name, area) WHERE (a.rk, a.part_no, a.sb, a.k) < (b.rk, b.part_no, b.sb, b.k)
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND ((a.kd = 3 AND b.kd = 3) OR (a.kd <> 3 AND b.kd <> 3 AND a.lo < b.hi AND b.lo < a.hi)))
 SELECT DISTINCT map_name, area, part, 'two callouts' AS fault FROM mt WHERE kd <> 3 AND a_no < part_no AND NOT broad UNION SELECT DISTINCT map_name, area, part, 'named twice' FROM mt WHERE kd = 0 AND a_kd = 0 AND a_no = part_no
 UNION SELECT DISTINCT map_name, area, part, 'boxes overlap' FROM mt WHERE kd = 3 UNION SELECT DISTINCT map_name, area, part, 'idle broad' FROM lv WHERE broad AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.map_name = lv.map_name AND mt.area = lv.area AND mt.part_no = lv.part_no AND kd <> 3 AND a_no < mt.part_no)""")
def grid_faults(spark, sf_dir):
    return H.split_faults(H.claim_rects(_splits(spark, sf_dir), _claims(spark, sf_dir)))


# -- spatial rules over all rounds ---------------------------------------------------

LIMITS = A.Limits(t_share=0.5, per_point=1, until=20.0, advance_players=2, crunch_players=1, crunch_sources=1, back=10.0, stack_at=10.0, stack_players=2, stack_areas=5)
_RULES = _SEEN + """, su AS (SELECT * FROM p WHERE player_id % 5 <> 4), sl AS (SELECT * FROM su WHERE sample_kind = 'time' AND is_alive AND side = 'CT'),
 rn AS (SELECT day, round_no, 'map' || (extract(day FROM day) % 4) AS map_name, CASE WHEN (extract(day FROM day) + round_no) % 3 < 2 THEN 'CT' ELSE 'T' END AS side, extract(day FROM day) % 7 AS match_id,
  CASE (extract(day FROM day) * 2 + round_no) % 4 WHEN 0 THEN 'eco' WHEN 1 THEN 'full' WHEN 2 THEN 'half' END AS round_type FROM (SELECT DISTINCT day, round_no FROM su)), rt AS (SELECT * FROM rn WHERE round_type IS NOT NULL),
 sg AS (SELECT DISTINCT day, area, CASE WHEN area IN ('click', 'view', 'signup') THEN 'A' ELSE 'B' END AS site FROM p WHERE area IS NOT NULL AND extract(day FROM day) % 6 <> 1),
 spt AS (SELECT day, count(DISTINCT sample_t_s) AS points FROM su WHERE sample_kind = 'time' GROUP BY 1), hd AS (SELECT day, area, total, t FROM ori JOIN spt USING (day) WHERE total >= points AND t / total >= 0.5),
 ha AS (SELECT day, round_no, 'ct_advance' AS rule, NULL::VARCHAR AS site, area, sample_t_s, count(DISTINCT player_id) AS players FROM sl JOIN hd USING (day, area) JOIN rt USING (day, round_no) WHERE sample_t_s <= 20 AND round_type IN ('eco', 'half', 'force') GROUP BY ALL HAVING count(DISTINCT player_id) >= 2),
 cs AS (SELECT *, CAST(sample_t_s * 1000 AS BIGINT) AS ms FROM sl), l AS (SELECT day, round_no, player_id, ms, min(area) AS source FROM cs GROUP BY ALL),
 cc AS (SELECT cs.*, l.source FROM cs ASOF LEFT JOIN l ON cs.day = l.day AND cs.round_no = l.round_no AND cs.player_id = l.player_id AND cs.ms - 10000 >= l.ms),
 hb AS (SELECT day, round_no, 'crunch' AS rule, NULL::VARCHAR AS site, area, sample_t_s, count(DISTINCT player_id) AS players FROM cc JOIN hd USING (day, area) JOIN rt USING (day, round_no) WHERE source IS NOT NULL AND source <> area AND sample_t_s <= 20 GROUP BY ALL),
 sz AS (SELECT day, round_no, site, area, list(DISTINCT player_id) AS who FROM sl JOIN sg USING (day, area) JOIN rt USING (day, round_no) WHERE sample_t_s = 10 GROUP BY ALL),
 sr AS (SELECT *, row_number() OVER (PARTITION BY day, round_no, site ORDER BY len(who) DESC, area) AS r FROM sz),
 sc AS (SELECT day, round_no, site, [area] AS areas, who, [r] AS path FROM sr UNION ALL SELECT sc.day, sc.round_no, sc.site, list_append(areas, sr.area), list_distinct(list_concat(sc.who, sr.who)), list_append(path, sr.r)
  FROM sc JOIN sr ON sc.day = sr.day AND sc.round_no = sr.round_no AND sc.site = sr.site AND sr.r > path[-1] WHERE len(areas) < 5),
 sb AS (SELECT day, round_no, site, arg_min(areas, (-len(who), len(areas), path)) AS areas, max(len(who)) AS players FROM sc GROUP BY 1, 2, 3),
 hc AS (SELECT day, round_no, 'stack' AS rule, site, areas[1] AS area, 10.0 AS sample_t_s, players FROM sb WHERE players >= 2),
 hits AS (SELECT * FROM ha UNION ALL SELECT * FROM hb UNION ALL SELECT * FROM hc),
 el AS (SELECT rt.*, 'crunch' AS rule FROM rt UNION ALL SELECT rt.*, 'ct_advance' FROM rt WHERE round_type IN ('eco', 'half', 'force') UNION ALL SELECT rt.*, 'stack' FROM rt WHERE day IN (SELECT day FROM sg))"""


def _rules(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    everyone = seen_of(spark, sf_dir)
    own = everyone.where(F.col("player_id") % 5 != 4)
    day = F.dayofmonth("day")
    rounds = own.select("day", "round_no").distinct().select(
        "day", "round_no", F.concat(F.lit("map"), (day % 4).cast("string")).alias("map_name"), F.when((day + F.col("round_no")) % 3 < 2, "CT").otherwise("T").alias("side"), (day % 7).alias("match_id"),
        F.element_at(F.array(F.lit("eco"), F.lit("full"), F.lit("half"), F.lit(None)), (day * 2 + F.col("round_no")) % 4 + 1).alias("round_type"),
    )
    site = F.when(F.col("area").isin("click", "view", "signup"), "A").otherwise("B")
    groups = everyone.where(F.col("area").isNotNull() & (day % 6 != 1)).select("day", "area", site.alias("site")).distinct()
    typed = rounds.where("round_type IS NOT NULL")
    return {"everyone": everyone, "own": own, "rounds": rounds, "groups": groups, "hits": A.rule_hits(own, everyone, typed, groups, ["day"], LIMITS), "seen": A.eligible(rounds, groups, ["day"])}


@query(f"WITH RECURSIVE {_RULES} SELECT day, round_no, site, array_to_string(areas, ',') AS areas, CAST(players AS BIGINT) AS players FROM sb WHERE players >= 2")
def stack_areas(spark, sf_dir):
    t = _rules(spark, sf_dir)
    own = t["own"].join(t["rounds"].where("round_type IS NOT NULL").select("day", "round_no"), ["day", "round_no"], "left_semi")
    return X.crowds(own, ["day"], t["groups"], 10.0, 2, 5).select("day", "round_no", "site", F.array_join("areas", ",").alias("areas"), "players")


@query(f"WITH RECURSIVE {_RULES} SELECT day, round_no, rule, site, area, sample_t_s, CAST(players AS BIGINT) AS players FROM hits")
def anomaly_hits(spark, sf_dir):
    return _rules(spark, sf_dir)["hits"]


@query(f"""WITH RECURSIVE {_RULES}, hr AS (SELECT DISTINCT day, round_no, rule, 1 AS hit FROM hits)
 SELECT map_name, side, rule, CAST(count(*) AS BIGINT) AS m, CAST(count(hit) AS BIGINT) AS n FROM el LEFT JOIN hr USING (day, round_no, rule) GROUP BY 1, 2, 3""")
def anomaly_branches(spark, sf_dir):
    t = _rules(spark, sf_dir)
    return A.branches(t["seen"], t["hits"], ["day"])


@query(f"""WITH RECURSIVE {_RULES}, pr AS (SELECT map_name, side, rule, site, area, day, round_no, round_type, match_id, count(*) AS points FROM hits JOIN el USING (day, round_no, rule) GROUP BY ALL), mm AS (SELECT map_name, side, rule, count(*) AS m FROM el GROUP BY ALL)
 SELECT map_name, side, rule, site, area, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT match_id) AS BIGINT) AS matches, array_to_string(list_sort(list(DISTINCT round_type)), ',') AS round_types, CAST(sum(points) AS BIGINT) AS points, CAST(any_value(m) AS BIGINT) AS m
 FROM pr JOIN mm USING (map_name, side, rule) GROUP BY 1, 2, 3, 4, 5""")
def anomaly_table(spark, sf_dir):
    t = _rules(spark, sf_dir)
    rows = A.anomalies(t["seen"], t["hits"], ["day"])
    points = F.aggregate("rounds", F.lit(0), lambda s, r: s + F.size(r["points"])).cast("long")
    return rows.select("map_name", "side", "rule", "site", "area", "n", "matches", F.array_join("round_types", ",").alias("round_types"), points.alias("points"), "m")


@query(f"""WITH RECURSIVE {_RULES}, un AS (SELECT DISTINCT day FROM rt) SELECT CAST((SELECT count(*) FROM rt) AS BIGINT) AS rounds_scanned, CAST((SELECT count(*) FROM el WHERE side = 'CT' AND rule = 'ct_advance') AS BIGINT) AS ct_advance_rounds,
 CAST((SELECT count(*) FROM el WHERE side = 'CT' AND rule = 'crunch') AS BIGINT) AS crunch_rounds, CAST((SELECT count(*) FROM el WHERE side = 'CT' AND rule = 'stack') AS BIGINT) AS stack_rounds,
 CAST((SELECT count(*) FROM un WHERE day NOT IN (SELECT day FROM hd)) AS BIGINT) AS units_without_orientation, CAST((SELECT count(*) FROM un WHERE day NOT IN (SELECT day FROM sg)) AS BIGINT) AS units_without_site_groups""")
def anomaly_coverage(spark, sf_dir):
    t = _rules(spark, sf_dir)
    return A.coverage(t["seen"], t["rounds"], A.held_by_t(t["own"], t["everyone"], ["day"], LIMITS), t["groups"], ["day"])


# -- restarts and lost rounds between known numbers --------------------------------------

_SEGMENTS = """e AS (SELECT user_id AS unit, event_id AS at_, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 f AS (SELECT *, CASE WHEN event_type IN ('click', 'view') OR k % 5 = 1 THEN TRUE ELSE FALSE END AS known FROM e),
 g AS (SELECT unit, at_, CASE WHEN known THEN CAST(sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY at_) + k // 13 AS INTEGER) END AS round, CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN at_ + 1 END AS end_tick, k FROM f),
 b AS (SELECT *, max(CASE WHEN round IS NOT NULL THEN k END) OVER (PARTITION BY unit ORDER BY k) AS bk, min(CASE WHEN round IS NOT NULL THEN k END) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ak FROM g),
 c AS (SELECT b.*, x.round AS br, y.round AS ar FROM b LEFT JOIN g x ON x.unit = b.unit AND x.k = bk LEFT JOIN g y ON y.unit = b.unit AND y.k = ak),
 d AS (SELECT *, CASE WHEN round IS NULL AND bk IS NOT NULL AND ak IS NOT NULL THEN CASE WHEN max(CASE WHEN end_tick IS NOT NULL AND round IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY unit, bk) = 1 THEN 'resolved' WHEN ar = br + 1 THEN 'restart' ELSE 'jump' END END AS gap FROM c),
 n AS (SELECT *, CAST(CASE WHEN round IS NOT NULL THEN round WHEN bk IS NULL AND ak IS NULL THEN k WHEN bk IS NULL THEN ar - (ak - k) WHEN ak IS NULL OR gap = 'resolved' THEN br + (k - bk) END AS INTEGER) AS round_raw FROM d)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("at"), "event_type")
    e = dealt(e, e.count(), "unit")
    w = Window.partitionBy("unit").orderBy("at")
    e = e.withColumn("k", F.row_number().over(w)).withColumn("known", F.col("event_type").isin("click", "view") | (F.col("k") % 5 == 1))
    number = F.sum(F.col("known").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.expr("k div 13")
    end = F.when((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0), F.col("at") + 1)
    return e.select("unit", "at", F.when(F.col("known"), number).cast("int").alias("round"), end.alias("end_tick"))


@query(f"WITH {_SEGMENTS} SELECT unit, at_ AS \"at\", round_raw, gap FROM n")
def numbered_rounds(spark, sf_dir):
    return S.number_rounds(_segments(spark, sf_dir), ["unit"]).select("unit", "at", "round_raw", "gap")


@query(f"WITH {_SEGMENTS} SELECT unit, any_value(br) AS before, any_value(ar) AS after, gap, CAST(count(*) AS BIGINT) AS segments, string_agg(at_, ',' ORDER BY at_) AS ticks FROM n WHERE gap IS NOT NULL GROUP BY unit, bk, gap")
def round_gaps(spark, sf_dir):
    gaps = S.round_gaps(S.number_rounds(_segments(spark, sf_dir), ["unit"]), ["unit"])
    return gaps.withColumn("ticks", F.array_join(F.col("ticks").cast("array<string>"), ","))


@query(f"""WITH {_SEGMENTS}, j AS (SELECT unit, 'jump' AS fault, count(*) AS n FROM n WHERE gap = 'jump' GROUP BY unit, bk), r AS (SELECT unit, 'restarts' AS fault, count(*) AS n FROM n WHERE gap = 'restart' GROUP BY unit HAVING count(*) > 2),
 t AS (SELECT *, max(round_raw) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM n), o AS (SELECT unit, 'order' AS fault, count(*) AS n FROM t WHERE round_raw <= top GROUP BY unit)
 SELECT unit, fault, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS gaps FROM (SELECT * FROM j UNION ALL SELECT * FROM r UNION ALL SELECT * FROM o) GROUP BY 1, 2""")
def round_faults(spark, sf_dir):
    faults = S.round_faults(S.number_rounds(_segments(spark, sf_dir), ["unit"]), ["unit"], 2)
    return faults.groupBy("unit", "fault").agg(F.sum("n").alias("n"), F.count("*").alias("gaps"))


# -- checks between the levels of the report --------------------------------------------

_CUBE = _ROUNDS + """, cu AS (SELECT map_name, side, round_type, CAST(grouping(map_name) * 4 + grouping(side) * 2 + grouping(round_type) AS INTEGER) AS level, count(*) AS rounds, count(DISTINCT map_demo_id) AS demos, count(DISTINCT match_id) AS matches,
 count(*) FILTER (is_league) AS rounds_league, count(*) FILTER (NOT is_league) AS rounds_other, count(*) FILTER (is_league IS NULL) AS rounds_unknown, count(DISTINCT map_demo_id) FILTER (is_league) AS demos_league, count(DISTINCT map_demo_id) FILTER (NOT is_league) AS demos_other,
 count(DISTINCT map_demo_id) FILTER (is_league IS NULL) AS demos_unknown FROM r WHERE round_type IS NOT NULL GROUP BY GROUPING SETS ((map_name, side, round_type), (map_name, side), (map_name), ())),
 sp AS (SELECT map_name, side, round_type, level, rounds, demos + CASE WHEN level = 7 THEN 1 ELSE 0 END AS demos, CASE WHEN level = 3 AND map_name = 'map1' THEN 0 WHEN level = 1 AND side = 'CT' THEN matches + 100 ELSE matches END AS matches,
 rounds_league + CASE WHEN level = 1 AND map_name = 'map2' AND side = 'T' THEN 1 ELSE 0 END AS rounds_league, rounds_other, rounds_unknown, demos_league, demos_other - CASE WHEN level = 7 THEN 1 ELSE 0 END AS demos_other, demos_unknown FROM cu)"""


@query(f"WITH {_CUBE} SELECT map_name, side, round_type, level, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("rounds", "demos", "matches", *(f"{m}_{b}" for m in ("rounds", "demos") for b in Q.BUCKETS))) + " FROM cu")
def bucketed_cube(spark, sf_dir):
    return Q.bucketed_samples(rounds_of(spark, sf_dir))


@query(f"""WITH {_CUBE}, ch AS (SELECT CASE level WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 7 END AS up, CASE WHEN level < 3 THEN map_name END AS mp, CASE WHEN level < 1 THEN side END AS sd, * EXCLUDE (level, side, map_name, round_type) FROM sp WHERE level < 7),
 lg AS (SELECT up, mp, sd, u.name, sum(u.v) AS total, max(u.v) AS top FROM (SELECT up, mp, sd, unnest([{{'name': 'rounds', 'v': rounds}}, {{'name': 'rounds_league', 'v': rounds_league}}, {{'name': 'rounds_other', 'v': rounds_other}}, {{'name': 'rounds_unknown', 'v': rounds_unknown}}, {{'name': 'demos', 'v': demos}}, {{'name': 'demos_league', 'v': demos_league}}, {{'name': 'demos_other', 'v': demos_other}}, {{'name': 'demos_unknown', 'v': demos_unknown}}, {{'name': 'matches', 'v': matches}}]) AS u FROM ch) GROUP BY 1, 2, 3, 4),
 ow AS (SELECT level, map_name, side, unnest([{{'name': 'rounds', 'v': rounds}}, {{'name': 'rounds_league', 'v': rounds_league}}, {{'name': 'rounds_other', 'v': rounds_other}}, {{'name': 'rounds_unknown', 'v': rounds_unknown}}, {{'name': 'demos', 'v': demos}}, {{'name': 'demos_league', 'v': demos_league}}, {{'name': 'demos_other', 'v': demos_other}}, {{'name': 'demos_unknown', 'v': demos_unknown}}, {{'name': 'matches', 'v': matches}}]) AS u FROM sp WHERE level > 0)
 SELECT level, map_name, side, u.name AS measure, CAST(u.v AS BIGINT) AS claimed, CAST(CASE WHEN u.name = 'matches' THEN top ELSE total END AS BIGINT) AS least, CAST(total AS BIGINT) AS most
 FROM ow JOIN lg ON up = level AND mp IS NOT DISTINCT FROM map_name AND sd IS NOT DISTINCT FROM side AND lg.name = u.name WHERE (u.name NOT LIKE 'demos%' OR level = 7) AND (u.v > total OR u.v < CASE WHEN u.name = 'matches' THEN top ELSE total END)""")
def cube_faults(spark, sf_dir):
    """The checks find what was spoiled, and nothing else."""
    level, m, s = F.col("level"), F.col("map_name"), F.col("side")
    cube = Q.bucketed_samples(rounds_of(spark, sf_dir))
    spoiled = cube.withColumns({
        "demos": F.col("demos") + F.when(level == 7, 1).otherwise(0), "demos_other": F.col("demos_other") - F.when(level == 7, 1).otherwise(0),
        "matches": F.when((level == 3) & (m == "map1"), 0).when((level == 1) & (s == "CT"), F.col("matches") + 100).otherwise(F.col("matches")),
        "rounds_league": F.col("rounds_league") + F.when((level == 1) & (m == "map2") & (s == "T"), 1).otherwise(0),
    })
    return Q.cube_faults(spoiled)


_BARS = """br AS (SELECT o_custkey % 700 AS block, o_orderkey % 2 + 4 AS armed, CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 14 < 13 THEN o_orderkey % 2 + 4 ELSE 0 END END AS armored FROM orders),
 ln AS (SELECT block, 'armed' AS metric, armed AS v FROM br UNION ALL SELECT block, 'armored', armored FROM br), hs AS (SELECT block, metric, v, count(*) AS n FROM ln WHERE v IS NOT NULL GROUP BY ALL),
 un AS (SELECT block, metric, count(*) FILTER (v IS NULL) AS unread FROM ln GROUP BY ALL)"""


@query(f"""WITH {_BARS}, li AS (SELECT block, metric, list({{'c': v, 'n': n}} ORDER BY v) AS bars, any_value(unread) AS unread FROM hs JOIN un USING (block, metric) GROUP BY 1, 2),
 st AS (SELECT *, len(bars) = 1 AND bars[1].c = 5 AND unread = 0 AS gone FROM li), pr AS (SELECT a.block, a.bars = b.bars AND a.unread = b.unread AS equal FROM li a JOIN li b ON a.block = b.block AND a.metric = 'armed' AND b.metric = 'armored'),
 fl AS (SELECT st.*, coalesce(equal, FALSE) AND NOT gone AS equal, bool_and(gone) OVER (PARTITION BY st.block) AS nothing FROM st LEFT JOIN pr USING (block))
 SELECT block, CASE WHEN equal THEN 'armed,armored' ELSE metric END AS metrics, array_to_string(list_transform(bars, lambda b: b.c || 'x' || b.n), ' ') AS bars, CAST(unread AS BIGINT) AS unread FROM fl
 WHERE (NOT gone AND NOT (equal AND metric = 'armored')) OR (nothing AND metric = 'armed')""")
def equipment_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    side = k % 2 + 4
    rounds = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 700).alias("block"), side.alias("armed"), F.when(k % 9 != 0, F.when(k % 14 < 13, side).otherwise(0)).alias("armored"))
    long = rounds.unpivot(["block"], ["armed", "armored"], "metric", "v")
    unread = long.groupBy("block", "metric").agg(F.count_if(F.col("v").isNull()).alias("unread"))
    bars = long.where("v IS NOT NULL").groupBy("block", "metric", "v").agg(F.count("*").alias("n")).join(unread, ["block", "metric"])
    lines = Q.equipment_lines(bars, ["block"], "metric", "v", "n", "unread", 5, ("armed", "armored"))
    text = F.transform("bars", lambda b: F.concat(b["count"].cast("string"), F.lit("x"), b["n"].cast("string")))
    return lines.select("block", F.array_join("metrics", ",").alias("metrics"), F.array_join(text, " ").alias("bars"), "unread")


# -- what is to be made again ----------------------------------------------------------------


@query("""WITH now AS (SELECT CAST(o_custkey AS VARCHAR) AS unit, CAST(count(*) AS VARCHAR) AS digest FROM orders WHERE o_custkey % 11 <> 3 GROUP BY 1),
 was AS (SELECT CAST(o_custkey AS VARCHAR) AS unit, CAST(count(*) + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS digest, CASE WHEN o_custkey % 13 = 0 THEN 'old' ELSE 'p' END AS params, CASE WHEN o_custkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders WHERE o_custkey % 7 <> 2 GROUP BY o_custkey)
 SELECT coalesce(now.unit, was.unit) AS unit, CASE WHEN now.unit IS NULL THEN 'gone' WHEN was.unit IS NULL THEN 'new' WHEN status <> 'ok' THEN 'failed' WHEN params <> 'p' THEN 'params' ELSE 'digest' END AS reason
 FROM now FULL JOIN was ON now.unit = was.unit WHERE now.unit IS NULL OR was.unit IS NULL OR status <> 'ok' OR params <> 'p' OR now.digest <> was.digest""")
def stale_units(spark, sf_dir):
    k = F.col("o_custkey")
    counts = table(spark, sf_dir, "orders").groupBy(k).agg(F.count("*").alias("n"))
    unit = k.cast("string").alias("unit")
    now = counts.where(k % 11 != 3).select(unit, F.col("n").cast("string").alias("digest"))
    was = counts.where(k % 7 != 2).select(
        unit, (F.col("n") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string").alias("digest"), F.when(k % 13 == 0, "old").otherwise("p").alias("params"), F.when(k % 17 == 0, "failed").otherwise("ok").alias("status")
    )
    return B.stale_units(now, was, "p")
