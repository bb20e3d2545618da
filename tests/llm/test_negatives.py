import duckdb
import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tellmark.llm import negatives
from tellmark.llm.negatives import ORACLES, block_pairs, hard_negatives, index, op12_hard_negatives

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, asks, scale=256):
    """rows: (id, vector, label), sound ones, ids unique."""
    out = []
    whole = {i: [int(np.floor(scale * float(x))) for x in v] for i, v, _ in rows}
    for i, v, label in rows:
        if not asks(i):
            continue
        others = [(-sum(a * b for a, b in zip(whole[i], whole[j])), j, k) for j, w, k in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            fit = sorted(x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_equal_to_the_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = op12_hard_negatives(spark, sf)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(ORACLES["op12_hard_negatives"]).select(*NAMES).fetchall())


def clustered(n, dim, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def test_clustered_rows_match_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = clustered(600, 8, 12, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hard_negatives(df, F.col("vec_id") % 9 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 9 == 0)


def test_far_blocks_are_never_paired(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rows = clustered(4000, 8, 40, 5, 0.01)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = index(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", "label", 256)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    asks = made.anchors.withColumn("radius", F.sqrt(F.col("both") - 1.98 * square))  # scores of 99 % of the anchor's with itself
    met, every = block_pairs(asks, made.blocks).count(), made.anchors.select("asking").distinct().count() * made.blocks.count()
    assert made.blocks.agg(F.sum("n")).first()[0] == 4000
    print(met, every)
    assert 0 < met < every / 2
    # no block that holds something within the radius is left out
    pairs = {tuple(r) for r in block_pairs(asks, made.blocks).select("asking", "block").collect()}
    points = {r.block: np.frombuffer(r.points, np.int16).reshape(r.n, 8).astype(float) for r in made.blocks.collect()}
    top = max((p**2).sum(axis=1).max() for p in points.values())
    for a in asks.collect():
        q = np.array(a.v)
        for block, p in points.items():
            if ((q**2).sum() + top - 2 * p @ q).min() <= a.radius**2:
                assert (a.asking, block) in pairs


def test_ties_nulls_repeats_and_clashing_names(spark):
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.9, 0.1], [0.5, 0.5], [0.0, 0.0], [-1.0, 0.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], [], [1e6, 1.0]]
    rows = [(50 * i, v, (i // 2) % 2) for i, v in enumerate(vectors)] + [(50 * i + 7, v, None if i == 3 else i % 3) for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], 1)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label=k, ID=1, ids="x", Score=2.0) for i, v, k in rows * 2], "vec_id long, embedding array<double>, label int, ID int, ids string, Score double")
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    sound = [(i, v, k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == brute(sound, lambda i: i % 50 == 0) and got
    assert hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, 0.5, 0.0] if i % 3 else rng.normal(size=3).tolist(), i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") % 30 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 30 == 0)
