import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tellmark.llm import topk as K


def brute(rows, asks, k):
    out = []
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        e = tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v)
        ok[i] = min(ok.get(i, e), e)
    for i, q in ok.items():
        if asks(i):
            each = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok.items() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(each[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_trees_find_what_brute_force_finds_and_drop_pairs(spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8))
    points = np.floor(1024 * np.concatenate([c + spread * rng.normal(size=(60, 8)) for c in centres]))
    points[100:400] = points[100]
    ids = rng.permutation(5000)[: len(points)]
    data = K.Tree(*K.build(ids, points))
    for node in range(len(data.start)):
        inside = data.points[data.start[node] : data.end[node]]
        assert np.sqrt(((inside - data.middle[node]) ** 2).sum(axis=1)).max() <= data.radius[node] + 1e-6
    some = rng.choice(len(points), 200, replace=False)
    queries = K.Tree(*K.build(ids[some], points[some]))
    best = K.Best(queries, 10)
    dropped = K.search(queries, data, best)
    assert dropped > 0 if spread < 0.1 else dropped >= 0
    scores = (queries.points @ points.T).astype(np.int64)
    for r, q in enumerate(queries.ids):
        want = sorted((-int(s), int(j)) for s, j in zip(scores[r], ids) if j != q)[:10]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[r], best.ids[r])] == want


def test_small_cases(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(90)] + [(i, [0.5, 0.25, -1.0]) for i in range(100, 140)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 0.0, 0.0]), (204, [1.0, 2.0]), (210, [3.0, 1.0]), (220, []), (None, [1.0, 1.0, 1.0])]
    rows += [(100, [0.5, 0.25, -1.0]), (30, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("IDS", F.lit(1)).withColumn("dim", F.lit("x"))
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 10 == 0, 7).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, 7)
    assert K.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(K.ORACLES["op2_exact_top_k"]).fetchall()
    assert sorted(map(tuple, K.op2_exact_top_k(spark, sf).collect())) == sorted(want)


def test_large_components_keep_their_scores(spark):
    rng = np.random.default_rng(8)
    sizes = [1.0, 5e3, 1e6]
    rows = [(i, np.float32(rng.normal(size=3) * sizes[i % 3]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 10 == 0, 7).collect())) == brute(rows, lambda i: i % 10 == 0, 7)
    far = np.array([[2.0**40, 1 - 2.0**40], [3.0, 4.0]])
    assert K.exact_scores(far, np.array([[2.0**40, 2.0**40], [2.0**60, 1.0]])[:1]).tolist() == [[2**40], [7 * 2**40]]
    with pytest.raises(OverflowError):
        K.exact_scores(far, far * 2.0**30)


def test_query_equals_its_sql_with_repeated_ids_and_large_vectors(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i % 250, np.float32(rng.normal(size=4) * (9000 if i == 333 else 1)).tolist()) for i in range(400)]
    rows += [(200, rows[5][1])] * 2
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(K.ORACLES["op2_exact_top_k"]).fetchall()
    assert sorted(map(tuple, K.op2_exact_top_k(spark, str(tmp_path)).collect())) == sorted(want)


def test_far_blocks_are_never_sent(spark, monkeypatch):
    """In data with structure, floors of the first search rule out most pairs of blocks, and of nodes within the others."""
    monkeypatch.setattr(K, "BLOCK", 50)
    monkeypatch.setattr(K, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(4)
    centres = 10 * rng.normal(size=(40, 6))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=6)).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 10 == 0
    asked, data = K.indexed(df, is_query, "vec_id", "embedding", True)
    first = K.first_pairs(asked, data)
    floor = K.floors(K._search(asked, data, first, 1, 10), asked, 10)
    every, kept = K.block_pairs(asked, data).count(), K.other_pairs(asked, data, first, floor).count()
    print(every, "pairs of blocks,", kept + asked.count(), "sent")
    assert kept + asked.count() < 0.5 * every
    got = sorted(map(tuple, K.top_k(df, is_query, repeats=True).collect()))
    points = np.floor(1024 * np.array([v for _, v in rows]))
    want = []
    for q in range(0, 2400, 10):
        each = sorted((-int(s), j) for j, s in enumerate(points @ points[q]) if j != q)[:10]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(each)]
    assert got == want
