import random

from pyspark.sql import functions as F

from tellmark.operators import runs as R


def test_counter_over_many_blocks_without_python(spark):
    rng = random.Random(4)
    rows = [(g, t, rng.choice([-2, -1, 0, 1, 3, None])) for g, n in (("a", 3000), ("b", 1), (None, 700), ("c", 256), ("d", 257)) for t in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, move int").withColumn("row", F.lit("x")).repartition(3)
    out = R.clamped_counter(df, ["g"], ["t"], F.col("move"), 0, 4, 1, "counter")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["g", "t", "move", "row", "counter"]
    want, value = {}, {}
    for g, t, move in rows:
        v = value.get(g, 1)
        want[g, t] = v
        value[g] = max(0, min(4, v + (move or 0)))
    assert {(r.g, r.t): r.counter for r in out.collect()} == want
    assert not any(x in plan for x in ("MapIn", "EvalPython", "FlatMapGroups")) and plan.count("Exchange hashpartitioning") == 1
    assert R.clamped_counter(df.limit(0), ["g"], ["t"], F.col("move"), 0, 4, 1, "counter").count() == 0
