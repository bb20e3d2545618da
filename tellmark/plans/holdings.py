"""The archive's catalogue on the driver's tables: suppliers are lineups, orders units, customers teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellmark.plans.catalogue import query
from tellmark.plans.game import _ROUNDS, rounds_of
from tellmark.session import table
from tellmark.sources import catalog as C


@query(f"WITH {_ROUNDS} SELECT lineup_key, string_agg(DISTINCT map_demo_id, ',' ORDER BY map_demo_id) AS units FROM r GROUP BY 1")
def archive_units(spark, sf_dir):
    return C.classified_units(rounds_of(spark, sf_dir)).withColumn("units", F.array_join("units", ","))


@query("SELECT CAST(o_custkey AS VARCHAR) AS unit, CAST(count(*) FILTER (o_orderkey % 9 <> 0) AS BIGINT) AS numbered, CAST(count(DISTINCT CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 50 END) AS BIGINT) AS unnumbered FROM orders GROUP BY 1")
def numbered_and_unnumbered(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unit"), F.when(k % 9 != 0, k).alias("round_no"), (k % 50).alias("round_raw"))
    kept, lost = C.own_rounds(o, "unit")
    n = kept.groupBy("unit").agg(F.count("*").alias("numbered"))
    return lost.join(n, "unit", "left").select("unit", F.coalesce("numbered", F.lit(0)).alias("numbered"), "unnumbered")


@query("SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN 'map' || (o_custkey % 7) END) AS map_name FROM orders GROUP BY 1")
def single_map_names(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("map"), (F.col("o_custkey") % 7).cast("string")))
    return C.only_value(table(spark, sf_dir, "orders").select("o_custkey", name.alias("map_name")), ["o_custkey"], "map_name")


@query("SELECT DISTINCT p_brand FROM part WHERE lower(p_brand) = 'brand#2' OR (lower(p_brand) LIKE 'brand#2%' AND NOT EXISTS (SELECT 1 FROM part WHERE lower(p_brand) = 'brand#2'))")
def keys_by_prefix(spark, sf_dir):
    return C.keys_like(table(spark, sf_dir, "part"), " BRAND#2 ", "p_brand")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), t AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT l_suppkey, o_custkey, count(*) AS common FROM s JOIN t USING (l_partkey) GROUP BY 1, 2 HAVING count(*) >= 10)
 SELECT l_suppkey, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) AS owners, count(*) > 1 AS contested FROM p GROUP BY 1""")
def owned_lineups(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    teams = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("team_key"), F.col("l_partkey").alias("player_id"))
    found = C.lineup_owners(teams, li.select(F.col("l_suppkey").alias("lineup_key"), F.col("l_partkey").alias("player_id")), 10)
    return found.select(F.col("lineup_key").alias("l_suppkey"), F.array_join(F.col("owners").cast("array<string>"), ",").alias("owners"), "contested")


@query("""WITH f AS (SELECT DISTINCT o_custkey, '["' || o_orderstatus || '","' || CAST(o_orderdate AS DATE) || '","' || o_orderpriority || '"]' AS row FROM orders) SELECT o_custkey, sha256(string_agg(row, chr(10) ORDER BY row)) AS digest FROM f GROUP BY 1""")
def unit_digests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return C.facts_digest(o, ["o_custkey"], ["o_orderstatus", "o_orderdate", "o_orderpriority"])
