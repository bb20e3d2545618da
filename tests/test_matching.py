import math
import random
import re

from tellmark.operators import matching as M


def test_nearest_cells_near_and_far(spark, monkeypatch):
    rng = random.Random(3)
    inf = float("inf")
    points = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(-200, 200)) for i in range(150)]
    points += [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, inf, 1.0, 1.0), (903, 9000.0, 1.0, 1.0)]
    cells = [(rng.randint(-20, 20), rng.randint(-20, 20), rng.randint(-4, 4), rng.choice("ABC"), 1) for _ in range(60)]
    p = spark.createDataFrame(points, "point_id int, x double, y double, z double")
    c = spark.createDataFrame(cells, "cell_x int, cell_y int, cell_z int, area string, observations int")
    want = {}
    for i, x, y, z in points:
        if i in (900, 901, 902):
            want[i] = (None, None)
            continue
        each = []
        for cx, cy, cz, a, _ in cells:
            dz = max(0.0, abs(z - (cz + 0.5) * 32) - 72) * 1.5
            each.append((math.sqrt((x - (cx + 0.5) * 32) ** 2 + (y - (cy + 0.5) * 32) ** 2 + dz**2), a))
        d, a = min(each)
        want[i] = (a if d <= 100 else None, round(d, 6))
    for bound in (50_000, 10):
        found = M.nearest_cell(p, c, "point_id", 32, "area", 1.5, 72, 100)
        assert {r.point_id: (r.area, r.distance if r.distance is None else round(r.distance, 6)) for r in found.collect()} == want
    assert {(r.area, r.distance) for r in M.nearest_cell(p, c.limit(0), "point_id", 32, "area", 1, 72, 256).collect()} == {(None, None)}


def test_as_of_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), (None, 10)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 12, 2), ("b", 6, 3), (None, 1, 4)], "k string, t int, v int")
    from pyspark.sql import functions as F

    got = {(r.k, r.t): (r.right_t, r.right_v) for r in M.as_of(left, right, ["k"], "t", ["v"], F.lit(8)).collect()}
    assert got == {("a", 10): (10, 1), ("a", 20): (12, 2), ("b", 5): (None, None), (None, 10): (None, None)}


def test_overlaps_of_sets_that_all_share_popular_members(spark):
    rng = random.Random(6)
    sets = lambda n, s: {f"{s}{i}": {"hot", "warm"} | set(rng.sample(range(60), 3)) for i in range(n)}
    left, right = sets(120, "l"), sets(150, "r")
    frame = lambda d, k: spark.createDataFrame([(i, str(m)) for i, ms in d.items() for m in ms] * 2 + [(None, "hot"), ("x", None)], f"{k} string, m string")
    a, b = frame(left, "a"), frame(right, "b")
    for least in (1, 3, 4):
        want = {(i, j, len(left[i] & right[j])) for i in left for j in right if len({str(x) for x in left[i] & right[j]}) >= least}
        for share in (1024, 7):
            assert {tuple(r) for r in M.overlaps_at_least(a, b, "a", "b", "m", least, share).collect()} == want
    sound = [df.dropna().distinct() for df in (a, b)]
    met = M.prefix_pairs(*sound, "a", "b", "m", 3).count()
    # all 18,000 pairs share the popular members; only those with a rare one in common are counted
    print(met, len(want))
    assert met < 120 * 150 / 4 and M.overlaps_at_least(a.limit(0), b, "a", "b", "m", 2).count() == 0


def test_rare_pairs_are_counted_in_cells_and_not_sent_each(spark, monkeypatch):
    from tellmark.operators import overlaps as O

    monkeypatch.setattr(O, "CELL", 500)
    monkeypatch.setattr(O, "HOT", 200)
    rng = random.Random(8)
    sets = lambda n: {i: set(rng.sample(range(40), rng.randint(1, 12))) for i in range(n)}
    left, right = sets(60), sets(50)
    frame = lambda d, k: spark.createDataFrame([(i, m) for i, ms in d.items() for m in ms], f"{k} int, m int")
    a, b = frame(left, "a"), frame(right, "b")
    want = {(i, j, len(left[i] & right[j])) for i in left for j in right if len(left[i] & right[j]) >= 3}
    found = M.overlaps_at_least(a, b, "a", "b", "m", 3)
    assert {tuple(r) for r in found.collect()} == want
    # no join of pairs with their members: the only joined rows are lists of right sets
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "LeftSemi" not in plan


def test_best_set_is_found_in_the_cells_over_several_slices(spark, monkeypatch):
    from tellmark.operators import overlaps as O

    monkeypatch.setattr(O, "CELL", 500)
    monkeypatch.setattr(O, "HOT", 60)
    rng = random.Random(9)
    sets = lambda n: {i: set(rng.sample(range(30), rng.randint(1, 10))) for i in range(n)}
    left, right = sets(50), sets(40)
    frame = lambda d, k: spark.createDataFrame([(i, m) for i, ms in d.items() for m in ms], f"{k} int, m int")
    want = {}
    for i, own in left.items():
        top = max(len(own & s) for s in right.values())
        at = [j for j, s in right.items() if len(own & s) == top]
        want[i] = (at[0] if len(at) == 1 else None, top)
    found = M.best_overlap(frame(left, "a"), frame(right, "b"), "a", "b", "m")
    assert {r.a: (r.b, r.common) for r in found.collect()} == want


def test_pairs_of_one_side_are_counted_once(spark):
    rng = random.Random(10)
    sets = {i: set(rng.sample(range(20), rng.randint(1, 8))) for i in range(40)}
    df = spark.createDataFrame([(i, m) for i, ms in sets.items() for m in ms], "one int, m int")
    found = M.overlaps_at_least(df, df.withColumnRenamed("one", "other"), "one", "other", "m", 2, above=True)
    assert {tuple(r) for r in found.collect()} == {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 2}


def test_dense_sets_are_counted_by_products_and_give_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tellmark.operators import overlaps as O

    rng = np.random.default_rng(11)
    held = rng.random((70, 12)) < 0.7
    a, m = np.nonzero(held)
    left = pa.table({"_left": a, "_member": m})
    index = pa.table({"_met": np.arange(12), "_rights": pa.array([np.flatnonzero(c).tolist() for c in held.T], pa.list_(pa.int64()))})
    monkeypatch.setattr(O, "PASS", 400)
    for side in (0, 1, -1):
        found = []
        for table in (0, 1 << 22):
            monkeypatch.setattr(O, "TABLE", table)
            found.append(O._pairs(3, side)(left, index).to_pylist())
        assert found[0] == found[1] and found[0]


def test_cells_are_dealt_by_their_number(spark, capsys, monkeypatch):
    from tellmark.operators import overlaps as O

    monkeypatch.setattr(O, "CELL", 16)
    df = spark.createDataFrame([(k, m) for k in range(60) for m in range(k % 7, k % 7 + 4)], "a int, m int")
    found = M.best_overlap(df, df.withColumnRenamed("a", "b"), "a", "b", "m")
    found.explain()
    cells = re.findall(r"Exchange hashpartitioning\([^()]*_share#\d+[^()]*, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)
    assert cells and max(map(int, cells)) > 10 and found.count() == 60


def test_sets_without_common_members_are_not_ranked_for_the_filter(spark, monkeypatch):
    from tellmark.operators import matching

    ranked, real = [], matching._firsts
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, "_firsts", lambda *args: ranked.append(1) or real(*args))
    rng = random.Random(13)
    rare = {i: set(rng.sample(range(100), 30)) for i in range(20)}
    common = {i: {0, 1, *rng.sample(range(2, 500), 3)} for i in range(60)}
    for sets, asked in ((rare, False), (common, True)):
        df = spark.createDataFrame([(i, m) for i, ms in sets.items() for m in ms], "a int, m int")
        found = M.overlaps_at_least(df, df.withColumnRenamed("a", "b"), "a", "b", "m", 3)
        assert {tuple(r) for r in found.collect()} == {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if len(sets[i] & sets[j]) >= 3}
        assert bool(ranked) == asked


def test_dense_sets_of_a_unit_lie_in_few_cells(spark, capsys, monkeypatch):
    from pyspark.sql import functions as F

    from tellmark.operators import overlaps as O

    monkeypatch.setattr(O, "CELL", 64)
    monkeypatch.setattr(O, "WIDE", 1000, raising=False)
    rng = random.Random(12)
    sets = {u * 1000 + i: set(rng.sample(range(12), rng.randint(4, 10))) for u in range(2) for i in range(80)}
    df = spark.createDataFrame([(k, f"{k // 1000} {m}") for k, ms in sets.items() for m in ms], "a long, m string")
    other = df.withColumnRenamed("a", "b")
    unit = lambda k: F.floor(k / 1000)
    want, pairs = {}, set()
    for k, own in sets.items():
        shared = {j: len(own & s) for j, s in sets.items() if j // 1000 == k // 1000 and j < k and own & s}
        pairs |= {(k, j, n) for j, n in shared.items() if n >= 6}
        if shared:
            at = [j for j, n in shared.items() if n == max(shared.values())]
            want[k] = (max(shared.values()), len(at), min(at))
    found = O.firsts(df, other, "a", "b", "m", -1, unit)
    assert {r["_left"]: (r["_top"], r["_n"], r["_right"]) for r in found.collect()} == want
    assert {tuple(r) for r in O.pairs(df, other, "a", "b", "m", 6, -1, O.meetings(df, other, "a", "m"), unit).collect()} == pairs
    # by meetings these were over a thousand cells, each with nearly all right sets
    found.explain()
    cells = re.findall(r"Exchange hashpartitioning\([^()]*_share#\d+[^()]*, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)
    assert cells and max(map(int, cells)) <= 8


def test_interval_pairs_are_those_of_assign_interval(spark):
    rng = random.Random(11)
    points = [(rng.choice(["a", "b", None]), i // 2, rng.choice([None, rng.randint(0, 400)])) for i in range(300)]
    points += [("a", 900, 100)] * 3 + [("b", i, 77) for i in range(60)]
    windows = [(rng.choice(["a", "b", None]), s := rng.randint(0, 400), s + rng.randint(-5, 90), rng.choice([None, f"w{i}"])) for i in range(120)]
    windows += [("b", 77, 77, None)] * 2 + [("a", None, 50, "x"), ("a", 50, None, "y")] + [("b", 70, 80, f"v{i}") for i in range(40)]
    p = spark.createDataFrame(points, "k string, i int, t int")
    w = spark.createDataFrame(windows, "k string, s int, e int, w string")
    want = sorted(map(repr, ((k, i, t, s, e, n) for k, i, t in points for j, s, e, n in windows if None not in (k, t, s, e) and k == j and s <= t <= e)))
    for each in (1024, 7):
        found = M.interval_pairs(p, w, ["k"], "t", "s", "e", 32, each)
        assert found.columns == M.assign_interval(p, w, ["k"], "t", "s", "e", 32).columns
        assert sorted(repr(tuple(r)) for r in found.collect()) == want
    bare = M.interval_pairs(p.drop("k"), w.select("s", "e"), [], "t", "s", "e", 32)
    assert bare.count() == M.assign_interval(p.drop("k"), w.select("s", "e"), [], "t", "s", "e", 32).count() > 0
    assert M.interval_pairs(p.limit(0), w, ["k"], "t", "s", "e", 32).count() == 0


def test_files_of_interval_assign_take_few_bytes_a_row(spark, tmp_path):
    import __spark_entry__
    from pyspark.sql import functions as F

    ts = F.timestamp_seconds(1704067200 + F.pmod(F.xxhash64("event_id"), F.lit(144_000)))
    spark.range(3000).select(F.col("id").alias("event_id"), ts.alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(300_000).select(F.col("id").alias("p_partkey"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    __spark_entry__.queries()["interval_assign"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows, size = spark.read.parquet(f"{tmp_path}/out").count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    print(rows, size)
    assert rows > 4_000_000 and size < 0.5 * rows
