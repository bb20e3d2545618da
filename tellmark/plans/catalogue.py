"""The operators applied to the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.contracts import duplicate_keys, score_jumps, uneven_sums, wrong_row_counts
from tellmark.functions import scalars as S
from tellmark.operators import distributions as D
from tellmark.operators import matching as M
from tellmark.operators import paths as P
from tellmark.operators import runs as R
from tellmark.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with us, the microseconds since 1970, whatever the session's time zone."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))


HOUR = 3_600_000_000
_EVENTS = "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
 OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS round_no FROM orders""")
def played_numbering(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.running_number(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", "round_no").select("o_custkey", "o_orderkey", "round_no")


_RUNS = _EVENTS + """, m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR us - lag(us) OVER w > 21600000000
 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


def _runs(spark, sf_dir):
    e = events(spark, sf_dir)
    return R.mark_runs(e, ["user_id"], ["us", "event_id"], ["event_type"], "us", F.lit(6 * HOUR), "run")


@query(_RUNS + """ SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS rows, min(us) AS first_us, max(us) AS last_us,
 arg_min(event_id, (us, event_id)) AS first_event_id, arg_max(event_id, (us, event_id)) AS last_event_id FROM r GROUP BY 1, 2, 3""")
def gaps_islands_runs(spark, sf_dir):
    ends = R.run_ends(_runs(spark, sf_dir), ["user_id", "run", "event_type"], ["us", "event_id"], ["us", "event_id"])
    return ends.select("user_id", F.col("run").cast("long"), "event_type", "rows", "first_us", "last_us", "first_event_id", "last_event_id")


@query(_RUNS + """, g AS (SELECT user_id, run, count(*) AS n, arg_min(event_id, (us, event_id)) AS a, arg_max(event_id, (us, event_id)) AS b, min(us) AS ta, max(us) AS tb FROM r GROUP BY 1, 2),
 u AS (SELECT user_id, 'throw' AS kind, a AS event_id, ta AS us FROM g UNION ALL SELECT user_id, 'detonate', b, tb FROM g WHERE n > 1)
 SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS INTEGER) AS no FROM u""")
def endpoints_union(spark, sf_dir):
    ends = R.run_ends(_runs(spark, sf_dir), ["user_id", "run"], ["us", "event_id"], ["event_id", "us"])
    rows = R.endpoint_rows(ends, ["user_id"], ["event_id", "us"], ("throw", "detonate"))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN lag(l_linenumber) OVER w = l_linenumber - 1 AND lag(l_linestatus) OVER w = l_linestatus
 THEN lag(l_quantity) OVER w END AS prev_l_quantity
 FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def previous_contiguous(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    li = li.agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_quantity").alias("l_quantity"))
    return R.contiguous_previous(li, ["l_orderkey"], "l_linenumber", ["l_linestatus"], ["l_quantity"]).drop("l_linestatus", "l_quantity")


@query(""" WITH RECURSIVE s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n,
 CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM events),
 c AS (SELECT user_id, event_id, n, 1 AS loss_count, greatest(0, least(4, 1 + d)) AS after FROM s WHERE n = 1
 UNION ALL SELECT s.user_id, s.event_id, s.n, c.after, greatest(0, least(4, c.after + s.d)) FROM c JOIN s ON s.user_id = c.user_id AND s.n = c.n + 1)
 SELECT user_id, event_id, CAST(loss_count AS INTEGER) AS loss_count FROM c""")
def clamped_counter(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    step = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", -1)
    return R.clamped_counter(e, ["user_id"], ["us", "event_id"], step, 0, 4, 1, "loss_count").select("user_id", "event_id", "loss_count")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER w AS no, lag(o_orderstatus) OVER w AS prev
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
 SELECT o_orderkey, CASE WHEN no IN (1, 13) THEN 'pistol' WHEN no > 24 THEN 'ot' WHEN o_totalprice >= 300000 THEN 'full'
 WHEN prev IS NULL THEN 'anomaly' WHEN prev = 'F' THEN CASE WHEN o_totalprice <= 50000 THEN 'anomaly' ELSE 'full' END
 WHEN o_totalprice < 100000 THEN 'eco' ELSE 'force' END AS round_type FROM o""")
def decision_cascade(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.row_number().over(w).alias("no"), F.lag("o_orderstatus").over(w).alias("prev"))
    price = F.col("o_totalprice")
    kind = (
        F.when(F.col("no").isin(1, 13), "pistol").when(F.col("no") > 24, "ot").when(price >= 300000, "full").when(F.col("prev").isNull(), "anomaly")
        .when(F.col("prev") == "F", F.when(price <= 50000, "anomaly").otherwise("full")).when(price < 100000, "eco").otherwise("force")
    )
    return o.select("o_orderkey", kind.alias("round_type"))


@query("""SELECT l_orderkey, CAST(round_even(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*), 0) AS INTEGER) AS per_line FROM lineitem GROUP BY 1""")
def per_player_bround(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    return g.select("l_orderkey", S.per_player(F.col("q"), F.col("n")).alias("per_line"))


@query("""SELECT b AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN value IS NULL OR isnan(value) OR value < 0 OR isinf(value) THEN 'unknown'
 WHEN value < 5 THEN '0-5' WHEN value < 10 THEN '5-10' WHEN value < 20 THEN '10-20' ELSE '20+' END AS b FROM events) GROUP BY 1""")
def bucket_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(S.seconds_bucket(F.col("value"), [5, 10, 20]).alias("bucket")).agg(F.count("*").alias("n"))


_GRID = """WITH g AS (SELECT CAST(floor(l_quantity / 8) AS INTEGER) AS cell_x, CAST(floor(l_discount * 100 / 3) AS INTEGER) AS cell_y, CAST(floor(l_tax * 100 / 3) AS INTEGER) AS cell_z,
 l_returnflag AS area, count(*) AS n FROM lineitem WHERE trim(l_returnflag) <> '' GROUP BY ALL)"""


@query(_GRID + " SELECT cell_x, cell_y, cell_z, arg_min(area, (-n, area)) AS area, CAST(sum(n) AS BIGINT) AS observations FROM g GROUP BY ALL")
def grid_mode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 8).alias("x"), (F.col("l_discount") * 100 / 3).alias("y"), (F.col("l_tax") * 100 / 3).alias("z"), F.col("l_returnflag").alias("area"))
    return M.grid_cells(li, ["x", "y", "z"], 1, "area")


@query("""WITH p AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 50 AS y, CAST(p_partkey % 7 AS DOUBLE) AS z FROM part),
 c AS (SELECT CAST(floor(s_acctbal / 400) AS INTEGER) AS cell_x, CAST(floor(s_nationkey / 1) AS INTEGER) AS cell_y, CAST(floor(s_suppkey % 3) AS INTEGER) AS cell_z, s_name AS area FROM supplier),
 g AS (SELECT cell_x, cell_y, cell_z, min(area) AS area FROM (SELECT *, count(*) OVER (PARTITION BY cell_x, cell_y, cell_z, area) AS n FROM c) GROUP BY 1, 2, 3),
 d AS (SELECT point_id, area, sqrt(pow(x - (cell_x + 0.5), 2) + pow(y - (cell_y + 0.5), 2) + pow(greatest(0.0, abs(z - (cell_z + 0.5)) - 1) * 2, 2)) AS dist FROM p, g),
 m AS (SELECT point_id, min(dist) AS dist, arg_min(area, (dist, area)) AS area FROM d GROUP BY 1)
 SELECT point_id, CASE WHEN dist <= 6 THEN area END AS area, round(dist, 6) AS distance FROM m""")
def nearest_cell(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z"))
    cloud = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 400).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 3).cast("double").alias("z"), F.col("s_name").alias("area"))
    cells = M.grid_cells(cloud, ["x", "y", "z"], 1, "area")
    found = M.nearest_cell(points, cells, "point_id", 1, "area", 2, 1, 6)
    return found.select("point_id", "area", F.round("distance", 6).alias("distance"))


@query(_EVENTS + """ SELECT p.user_id, p.event_id, CASE WHEN p.us - v.us <= 7200000000 THEN v.us END AS right_us, CASE WHEN p.us - v.us <= 7200000000 THEN v.event_id END AS right_event_id
 FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, us, max(event_id) AS event_id FROM e WHERE event_type = 'view' GROUP BY 1, 2) v
 ON p.user_id = v.user_id AND p.us >= v.us""")
def asof_within(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    bought = e.where("event_type = 'purchase'").drop("event_type")
    seen = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("event_id").alias("event_id"))
    return M.as_of(bought, seen, ["user_id"], "us", ["event_id"], F.lit(2 * HOUR)).select("user_id", "event_id", "right_us", "right_event_id")


@query(_EVENTS + f""", w AS (SELECT p_partkey, 1704067200000000 + p_partkey % 700 * {HOUR} AS s, p_size % 9 * {HOUR} AS n FROM part)
 SELECT event_id, p_partkey, s AS start_us FROM e JOIN w ON us BETWEEN s AND s + n""")
def interval_assign(spark, sf_dir):
    start = F.lit(1704067200000000) + F.col("p_partkey") % 700 * HOUR
    windows = table(spark, sf_dir, "part").select("p_partkey", start.alias("start_us"), (start + F.col("p_size") % 9 * HOUR).alias("end_us"))
    return M.interval_pairs(events(spark, sf_dir).select("event_id", "us"), windows, [], "us", "start_us", "end_us", 4 * HOUR).select("event_id", "p_partkey", "start_us")


@query(_EVENTS + """, l AS (SELECT user_id, us, min(event_type) AS v FROM e GROUP BY 1, 2)
 SELECT e.event_id, l.v AS source FROM e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.us - 3600000000 >= l.us""")
def lookback_source(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    return M.look_back(e, ["user_id"], "us", "event_type", HOUR, "source").select("event_id", "source")


@query(_EVENTS + """ SELECT user_id, coalesce(min(us) FILTER (event_type = 'error'), min(us) FILTER (event_type = 'click')) AS contact_us FROM e GROUP BY 1""")
def first_of_two(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.coalesce(F.min(F.when(kind == "error", F.col("us"))), F.min(F.when(kind == "click", F.col("us")))).alias("contact_us")
    )


_SETS = """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"""


@query("""WITH c AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
 p AS (SELECT o_custkey, l_suppkey, count(*) AS common FROM c JOIN s USING (l_partkey) GROUP BY 1, 2),
 t AS (SELECT *, max(common) OVER (PARTITION BY o_custkey) AS top FROM p)
 SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS l_suppkey, CAST(min(common) AS BIGINT) AS common FROM t WHERE common = top GROUP BY 1""")
def best_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    mine = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    return M.best_overlap(mine, li, "o_custkey", "l_suppkey", "l_partkey")


@query(_SETS + """ SELECT a.l_suppkey AS one, b.l_suppkey AS other, CAST(count(*) AS BIGINT) AS common FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey
 GROUP BY 1, 2 HAVING count(*) >= 3""")
def overlap_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    return M.overlaps_at_least(li.withColumnRenamed("l_suppkey", "one"), li.withColumnRenamed("l_suppkey", "other"), "one", "other", "l_partkey", 3, above=True)


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 AND count(*) = count(l_linestatus) THEN min(l_linestatus) END AS status FROM lineitem GROUP BY 1")
def consensus_value(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(D.consensus("l_linestatus").alias("status"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS lines, min(l_shipdate) AS d FROM lineitem GROUP BY 1)
 SELECT CAST(lines AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT strftime(d, '%Y-%m')) AS BIGINT) AS months FROM c GROUP BY 1""")
def count_of_counts(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.min("l_shipdate").alias("d"))
    return D.count_of_counts(c, [], "lines", {"months": F.countDistinct(F.date_format("d", "yyyy-MM"))})


@query("""WITH c AS (SELECT c_nationkey, o_orderstatus, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
 SELECT n_nationkey, s.o_orderstatus, CAST(coalesce(n, 0) AS BIGINT) AS customers FROM nation CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s
 LEFT JOIN c ON c_nationkey = n_nationkey AND c.o_orderstatus IS NOT DISTINCT FROM s.o_orderstatus""")
def zero_filled_dist(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    seen = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderstatus").agg(F.countDistinct("c_custkey").alias("customers"))
    units = table(spark, sf_dir, "nation").select("n_nationkey")
    return D.zero_filled(units, o.select("o_orderstatus").distinct(), seen, [], ["n_nationkey"], ["o_orderstatus"], "customers")


@query("""WITH x AS (SELECT *, extract(hour FROM ts) AS h FROM events), u AS (SELECT DISTINCT event_type, h, user_id FROM x WHERE value >= 1 OR value IS NULL OR value < 1),
 k AS (SELECT DISTINCT event_type, h, CAST(event_id % 3 AS BIGINT) AS area FROM x WHERE value > 1), s AS (SELECT event_type, h, user_id, event_id % 3 AS area, count(DISTINCT event_id) AS players FROM x WHERE value > 1 GROUP BY ALL),
 f AS (SELECT u.event_type, u.h, k.area, coalesce(s.players, 0) AS players FROM u JOIN k ON u.event_type = k.event_type AND u.h = k.h LEFT JOIN s ON s.event_type = u.event_type AND s.h = u.h AND s.user_id = u.user_id AND s.area = k.area),
 n AS (SELECT event_type, h, area, players, count(*) AS n FROM f GROUP BY ALL)
 SELECT event_type, CAST(h AS INTEGER) AS hour, area, CAST(players AS BIGINT) AS players, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY event_type, h, area) AS BIGINT) AS m FROM n""")
def presence_distribution(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.hour("ts").alias("hour"), "user_id", (F.col("event_id") % 3).alias("area"), "event_id", "value")
    return D.presence_distribution(e, ["event_type", "hour"], ["user_id"], "area", F.col("value") > 1, "event_id")


@query("""SELECT o_orderstatus, """ + ", ".join(f"CAST(count(DISTINCT {c}) FILTER (b = '{b}') AS BIGINT) AS {c}_{b}" for c in ("o_custkey", "o_orderkey") for b in ("high", "low", "unknown")) + """
 FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE 'low' END AS b FROM orders) GROUP BY 1""")
def bucket_pivot_sample(spark, sf_dir):
    p = F.col("o_orderpriority")
    bucket = F.when(p.like("1%") | p.like("2%"), "high").when(p.like("5%"), "unknown").otherwise("low")
    return D.bucket_counts(table(spark, sf_dir, "orders"), ["o_orderstatus"], bucket, ["high", "low", "unknown"], ["o_custkey", "o_orderkey"])


@query("""SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(c_mktsegment) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS customers,
 CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, n_name), (r_name), ())""")
def rollup_samples(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cube = joined.rollup("r_name", "n_name", "c_mktsegment")
    return cube.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("nations"))


@query("""WITH a AS (SELECT s_nationkey, l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
 b AS (SELECT s_nationkey, l_suppkey, arg_min(p_brand, (-n, p_brand)) AS v FROM a GROUP BY 1, 2), c AS (SELECT s_nationkey, v, count(*) AS n FROM b GROUP BY 1, 2)
 SELECT s_nationkey, arg_min(v, (-n, v)) AS p_brand FROM c GROUP BY 1""")
def two_level_mode(spark, sf_dir):
    from tellmark.operators.teams import voted_name

    li, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return voted_name(rows, "l_suppkey", "s_nationkey", "p_brand")


@query("SELECT l_suppkey, CASE WHEN count(*) = count(CASE WHEN l_quantity < 50 THEN l_quantity END) THEN max(l_quantity) END AS top FROM lineitem GROUP BY 1")
def null_dominant_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") < 50, F.col("l_quantity")).alias("q"))
    return li.groupBy("l_suppkey").agg(D.null_dominant_max("q").alias("top"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS t FROM lineitem GROUP BY 1, 2), b AS (SELECT *, max(t) OVER (PARTITION BY l_partkey) AS m FROM a)
 SELECT l_partkey, CAST(count(*) AS BIGINT) AS owners, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS l_suppkey FROM b WHERE t = m GROUP BY 1""")
def ownership_latest(spark, sf_dir):
    return D.latest_owner(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate")


@query("""SELECT p_brand, list_sort(list(p_retailprice))[1 + CAST(floor(count(*) * 0.05) AS INTEGER)] AS low, list_sort(list(p_retailprice))[least(count(*), 1 + CAST(floor(count(*) * 0.95) AS INTEGER))] AS high
 FROM part GROUP BY 1""")
def trimmed_band(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(D.order_statistic("p_retailprice", 0.05).alias("low"), D.order_statistic("p_retailprice", 0.95).alias("high"))


@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
 HAVING count(*) >= 5 AND count(*) FILTER (l_returnflag = 'R') >= 0.25 * count(*)""")
def share_threshold(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("t"))
    return g.where("total >= 5 AND t >= 0.25 * total")


@query("""WITH c AS (SELECT p_brand, median(p_size) AS cx, median(p_retailprice) AS cy FROM part GROUP BY 1)
 SELECT p_brand, round(cx, 6) AS cx, round(cy, 6) AS cy, round(median(sqrt(pow(p_size - cx, 2) + pow(p_retailprice - cy, 2))), 6) AS spread FROM part JOIN c USING (p_brand) GROUP BY ALL""")
def median_center_spread(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.groupBy("p_brand").agg(F.median("p_size").alias("cx"), F.median("p_retailprice").alias("cy"))
    d = F.sqrt(F.pow(F.col("p_size") - F.col("cx"), 2) + F.pow(F.col("p_retailprice") - F.col("cy"), 2))
    g = p.join(c, "p_brand").groupBy("p_brand", "cx", "cy").agg(F.median(d).alias("spread"))
    return g.select("p_brand", *(F.round(x, 6).alias(x) for x in ("cx", "cy", "spread")))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, event_type AS part, list(DISTINCT user_id) AS who FROM events GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY len(who) DESC, part) AS r FROM s),
 b AS (SELECT day, part AS first, CAST(NULL AS VARCHAR) AS second, len(who) AS covered, 1 AS k, r AS r1, 0 AS r2 FROM r
 UNION ALL SELECT a.day, a.part, c.part, len(list_distinct(list_concat(a.who, c.who))), 2, a.r, c.r FROM r a JOIN r c ON a.day = c.day AND a.r < c.r)
 SELECT day, arg_min(first, (-covered, k, r1, r2)) AS first, nullif(arg_min(coalesce(second, ''), (-covered, k, r1, r2)), '') AS second, CAST(max(covered) AS INTEGER) AS covered FROM b GROUP BY 1""")
def max_cover_two(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return D.biggest_pair(e, ["day"], "event_type", "user_id")


@query(_EVENTS + """, l AS (SELECT user_id, us, min(event_type) AS v FROM e GROUP BY 1, 2),
 s AS (SELECT e.*, l.v AS source FROM e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.us - 3600000000 >= l.us)
 SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS players, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM s
 WHERE source IS NOT NULL AND source <> event_type GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2 AND count(DISTINCT source) >= 2""")
def arrivals_sources(spark, sf_dir):
    e = events(spark, sf_dir)
    came = M.look_back(e, ["user_id"], "us", "event_type", HOUR, "source").where("source IS NOT NULL AND source <> event_type")
    g = came.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.countDistinct("user_id").alias("players"), F.array_sort(F.collect_set("source")).alias("s"))
    return g.where((F.col("players") >= 2) & (F.size("s") >= 2)).select("day", "event_type", "players", F.array_join("s", ",").alias("sources"))


@query("""WITH q AS (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY q DESC) AS k FROM q)
 SELECT l_suppkey, l_partkey, CAST(q AS BIGINT) AS q FROM r WHERE k <= 3""")
def topk_with_ties(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return D.top_with_ties(q, ["l_suppkey"], "q", 3)


@query("""WITH t AS (SELECT l_returnflag, l_suppkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m DESC, l_suppkey) AS k FROM t)
 SELECT l_returnflag, l_suppkey, l_orderkey, l_linenumber FROM lineitem JOIN r USING (l_returnflag, l_suppkey) WHERE k <= 2""")
def topk_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return D.top_groups(li, ["l_returnflag"], ["l_suppkey"], "l_extendedprice", 2).drop("l_extendedprice")


@query("""WITH f AS (SELECT l_orderkey, arg_min(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS area FROM lineitem GROUP BY 1)
 SELECT area, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS m FROM f GROUP BY 1""")
def first_row_per_key(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("area"))
    g = f.groupBy("area").agg(F.count("*").alias("n"))
    return g.withColumn("m", F.sum("n").over(Window.partitionBy()))


@query("""SELECT DISTINCT CAST(extract(hour FROM ts) AS INTEGER) AS hour, event_type FROM events WHERE (extract(hour FROM ts), event_type) NOT IN (SELECT extract(hour FROM ts), event_type FROM events WHERE value > 300)""")
def presence_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "event_type", "value")
    return e.select("hour", "event_type").distinct().join(e.where("value > 300"), ["hour", "event_type"], "left_anti")


@query(_EVENTS + """, n AS (SELECT event_id, user_id, event_type, us, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id, lag(event_type) OVER w AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
 SELECT event_id, CASE WHEN next_type = 'purchase' THEN next_id END AS pair_id, CAST((SELECT count(*) FROM n WHERE event_type = 'purchase' AND prev IS DISTINCT FROM 'view') AS BIGINT) AS unpaired FROM n WHERE event_type = 'view'""")
def self_pair(spark, sf_dir):
    from tellmark.operators.report import unpaired

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    n = events(spark, sf_dir).withColumn("k", F.row_number().over(w)).select("user_id", "k", "event_id", "event_type")
    views = n.where("event_type = 'view'").select("user_id", (F.col("k") + 1).alias("k"), "event_id")
    buys = n.where("event_type = 'purchase'").select("user_id", "k", F.col("event_id").alias("pair_id"))
    kinds = [(views, "grenade_thrown"), (buys, "grenade_detonate")]
    both = [df.select(F.col("user_id").alias("map_demo_id"), F.col("k").alias("grenade_no"), F.lit(kind).alias("event_kind")) for df, kind in kinds]
    lost = unpaired(both[0].unionByName(both[1])).agg(F.count("*").alias("unpaired"))
    return views.join(buys, ["user_id", "k"], "left").select("event_id", "pair_id").join(F.broadcast(lost))  # one row


@query(_EVENTS + """, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY us, event_id) AS b FROM e)
 SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, '>' ORDER BY us, event_id) AS path FROM p WHERE b IS DISTINCT FROM event_type GROUP BY 1, 2""")
def path_compress(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return P.label_paths(e, ["user_id", "day"], ["us", "event_id"], "event_type").withColumn("path", F.array_join("path", ">"))


@query(_EVENTS + """, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY us, event_id) AS b FROM e),
 s AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY us, event_id) AS path FROM p WHERE b IS DISTINCT FROM event_type GROUP BY 1, 2),
 x AS (SELECT user_id, day, path, unnest(range(1, len(path) + 1)) AS d FROM s), y AS (SELECT day, array_to_string(path[1:d], '>') AS prefix, count(DISTINCT user_id) AS k FROM x GROUP BY ALL HAVING count(DISTINCT user_id) >= 2)
 SELECT prefix, CAST(count(*) AS BIGINT) AS units, CAST(max(k) AS BIGINT) AS most FROM y GROUP BY 1 HAVING count(*) >= 2""")
def path_prefix_patterns(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    paths = P.label_paths(e, ["user_id", "day"], ["us", "event_id"], "event_type")
    return P.prefix_patterns(paths, [], "day", "user_id", 2, 2).withColumn("prefix", F.array_join("prefix", ">"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations)
 SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, word FROM w""")
def explode_picks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("""SELECT CAST(event_id AS VARCHAR) AS match_id, event_type AS status, CASE WHEN event_id % 3 <> 0 THEN CAST(epoch(ts) AS BIGINT) - epoch_us(ts) % 1000000 * 0 END AS finished_s,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 1 AND 9 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS best_of, 'a,' || event_type AS map_picks FROM events""".replace("CAST(epoch(ts) AS BIGINT) - epoch_us(ts) % 1000000 * 0", "epoch_us(ts) // 1000000"))
def json_extract(spark, sf_dir):
    from tellmark.sources.archive import parse_matches

    e = events(spark, sf_dir)
    moment = F.when(F.col("event_id") % 3 != 0, F.floor(F.col("us") / 1000000)).otherwise(0)
    body = F.struct(
        F.col("event_id").cast("string").alias("match_id"), F.col("event_type").alias("status"), moment.alias("finished_at"), F.get_json_object("props", "$.k").alias("best_of"),
        F.struct(F.struct(F.array(F.lit("a"), F.col("event_type")).alias("pick")).alias("map")).alias("voting"),
    )
    found = parse_matches(e.select(F.to_json(body).alias("payload")))
    return found.select("match_id", "status", F.unix_seconds("finished_at").alias("finished_s"), "best_of", F.array_join("map_picks", ",").alias("map_picks"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("SELECT l_partkey, substr(sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY CAST(s AS VARCHAR))), 1, 16) AS key FROM (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) GROUP BY 1")
def sha_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(S.member_key(F.collect_set(F.col("l_suppkey").cast("string"))).alias("key"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
 p AS (SELECT event_type, value AS p90 FROM r WHERE r = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)),
 g AS (SELECT event_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(value) AS BIGINT) AS nulls, median(value) AS middle, max(value) AS top FROM events GROUP BY 1)
 SELECT event_type, rows, nulls, round(middle, 6) AS middle, round(p90, 6) AS p90, round(top, 6) AS top FROM g LEFT JOIN p USING (event_type)""")
def distribution_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    g = e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.median("value").alias("middle"), F.max("value").alias("top"))
    joined = g.join(D.nearest_rank(e, ["event_type"], "value", 0.9, "p90"), "event_type", "left")
    return joined.select("event_type", "rows", "nulls", *(F.round(c, 6).alias(c) for c in ("middle", "p90", "top")))


@query("""SELECT 'duplicate lines' AS rule, CAST(count(*) AS BIGINT) AS broken FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
 UNION ALL SELECT 'orders with another number of lines than 4', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4)
 UNION ALL SELECT 'line numbers that jump', CAST(count(*) AS BIGINT) FROM (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem) WHERE d > 1
 UNION ALL SELECT 'uneven sums', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING sum(l_linenumber) <> min(l_quantity) OR min(l_quantity) <> max(l_quantity))""")
def constraints_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rules = {
        "duplicate lines": duplicate_keys(li, ["l_orderkey", "l_linenumber"]),
        "orders with another number of lines than 4": wrong_row_counts(li, ["l_orderkey"], 4),
        "line numbers that jump": score_jumps(li, ["l_orderkey"], "l_linenumber", "l_linenumber"),
        "uneven sums": uneven_sums(li, ["l_orderkey"], "l_linenumber", "l_quantity"),
    }
    parts = [df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, df in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(_EVENTS + """, g AS (SELECT CAST(ts AS DATE) AS day, event_type, list_sort(list(DISTINCT user_id)) AS who FROM e GROUP BY 1, 2)
 SELECT a.day, a.event_type AS part, array_to_string(a.who, ',') AS who FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.day = a.day AND b.event_type > a.event_type AND len(list_filter(a.who, lambda x: NOT list_contains(b.who, x))) = 0)""")
def subsumed_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.array_sort(F.collect_set("user_id")).alias("who"))
    b = e.select(F.col("day").alias("d"), F.col("event_type").alias("t"), F.col("who").alias("w"))
    kept = e.join(b, (F.col("day") == F.col("d")) & (F.col("t") > F.col("event_type")) & (F.size(F.array_except("who", "w")) == 0), "left_anti")
    return kept.select("day", F.col("event_type").alias("part"), F.array_join(F.col("who").cast("array<string>"), ",").alias("who"))


@query(_EVENTS + """, s AS (SELECT user_id, us, event_id, event_type, CASE WHEN event_type = 'signup' THEN row_number() OVER w END AS known, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
 SELECT event_id, CAST(CASE WHEN max(known) OVER (PARTITION BY user_id) IS NOT NULL THEN k END AS BIGINT) AS number FROM s""")
def filled_numbers(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("known", F.when(F.col("event_type") == "signup", F.row_number().over(w)))
    return R.fill_number(e, ["user_id"], ["us", "event_id"], "known", "number").select("event_id", F.col("number").cast("long").alias("number"))


@query("""WITH b AS (SELECT 'cheap' AS part, 1 AS prio, 0.0 AS x0, 20.0 AS x1, 900.0 AS y0, 1200.0 AS y1, 'MFGR' AS m UNION ALL SELECT 'small', 2, 0, 10, 0, 99999, 'MFGR' UNION ALL SELECT 'any', 3, 0, 40, 0, 99999, 'MFGR')
 SELECT p_partkey, arg_min(part, prio) AS part FROM part LEFT JOIN b ON p_size >= x0 AND p_size < x1 AND p_retailprice >= y0 AND p_retailprice < y1 GROUP BY 1""")
def region_parts(spark, sf_dir):
    boxes = spark.createDataFrame(
        [("cheap", 1, 0.0, 20.0, 900.0, 1200.0, 1), ("small", 2, 0.0, 10.0, 0.0, 99999.0, 1), ("any", 3, 0.0, 40.0, 0.0, 99999.0, 1)],
        "part string, priority int, x_min double, x_max double, y_min double, y_max double, k int",
    )
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1).alias("k"))
    return M.in_region(p, boxes, ["k"], "p_size", "p_retailprice", "part", "priority").select("p_partkey", "part")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type and hour: how many users had how many events, zero-filled, out of how many users."""
    return presence_distribution(spark, sf_dir)
