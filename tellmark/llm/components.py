"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellmark.llm.common import cut
from tellmark.session import ROWS

#: Tasks that the neighbours of one node are dealt over.
SHARES = 32


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them: the larger ones, or the smaller ones and the node. Pairs can come out twice."""
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a root has as many neighbours as its component has nodes: its least one goes to shares of them
    share = F.coalesce(F.pmod(F.xxhash64("v"), F.lit(SHARES)), F.lit(0)).alias("share")
    # repeated pairs meet here too: no step deals pairs out for that alone
    pairs = pairs.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v", share).repartition("u", "share").distinct()
    parts = pairs.groupBy("u", "share").agg(F.min("v").alias("m"))
    least = F.least("u", F.min("m").over(Window.partitionBy("u")))  # of SHARES rows at most
    joined = pairs.join(parts.select("u", "share", least.alias("m")), ["u", "share"])
    moved = F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("m")) if large else F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    # pairs that don't move have become loops
    return joined.select(moved.alias("u"), F.col("m").alias("v")).where("u <> v")


def _state(pairs: DataFrame) -> tuple[int, int]:
    """Number of pairs, and of nodes that keep them from being stars: with two pairs to smaller nodes, or one and a larger node."""
    end = lambda node, down: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = pairs.select(F.inline(F.array(end("u", 1), end("v", 0))))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if((F.col("down") > 0) & (F.col("down") + F.col("up") > 1))).first())


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) of long ids: (node, label), label being the least id of its component.

    Nodes without an edge to another node don't appear. Loops, repeated edges and
    edges with a null end are left out. Each round is a few joins and cuts the
    lineage; the rounds grow with the logarithm of the components' size, and end
    once every component is a star.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    current = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        n, faults = _state(current)
        # tasks follow the pairs, which don't grow: each leaves files of its own for every shuffle
        tasks = max(cores, -(-n // ROWS))
        if not faults:
            break
        current = cut(_star(_star(current.coalesce(tasks), True), False)).coalesce(tasks)
    current = current.coalesce(tasks)
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
