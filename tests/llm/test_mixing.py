import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tellmark.llm.mixing import mix, op6_source_mixing, pivot, take_mix, targets


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        goal = {s: most * sizes[s] if s in capped else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in capped and goal[s] > most * sizes[s]}
        if not over:
            return goal
        capped |= over


def check(rows):
    size, taken, goal, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for source, r in rows:
        size[source] += r.size
        taken[source] += r.taken
        goal[source] = r.target
        largest[source] = max(largest[source], r.size)
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(size)
    for s in size:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s


def test_query_meets_targets_and_agrees_on_reruns(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    rows = op6_source_mixing(spark, sf).collect()
    check([(source[r.doc_id], r) for r in rows])
    assert len(rows) == len(source)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op6_source_mixing(spark, sf).collect()))


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr("tellmark.llm.mixing.FAN_IN", 8)
    rng = random.Random(3)
    data = [Row(doc_id=i, source=rng.choice(["a", "b", "c", None, "zz"]), text="w " * rng.randint(0, 40)) for i in range(900)]
    df = spark.createDataFrame(data)
    sizes = {r.doc_id: (r.source, len(r.text.split())) for r in data}
    got = mix(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(got) == 900
    check([(sizes[r.doc_id][0], r) for r in got])


def test_pivot_keeps_mass_and_expectation():
    mass, p = np.array([3.0, 5, 2, 7, 4]), np.array([0.3, 0.5, 0.2, 0.9, 0.6])
    total = np.zeros(5)
    for seed in range(4000):
        up, left, open_at = pivot(mass, p, seed)
        assert left @ mass == pytest.approx(p @ mass)
        total += left
    assert np.abs(total / 4000 - p).max() < 0.03


def test_nulls_repeats_and_taking(spark):
    data = [Row(doc_id=1, source=None, text=None, SIZE=1), Row(doc_id=None, source="a", text="x y", SIZE=2)]
    data += [Row(doc_id=2, source="b", text="p q r", SIZE=k) for k in range(4)] + [Row(doc_id=3, source="a", text="é\x1cb " * 5, SIZE=4)]
    df = spark.createDataFrame(data).repartition(3)
    units = mix(df).collect()
    assert len(units) == len(data) and sum(r.doc_id == 2 for r in units) == 4
    want = Counter()
    for r in units:
        want[r.doc_id, r.source] += r.copies
    rows = take_mix(df).collect()
    assert +want == Counter((r.doc_id, r.source) for r in rows)
    each = Counter(r.SIZE for r in rows if r.doc_id == 2)
    assert max(each.values()) - min(each.get(k, 0) for k in range(4)) <= 1
    assert take_mix(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0 and take_mix(df.limit(0)).count() == 0


def test_rows_without_ids_and_repeated_rows_are_units_of_their_own(spark):
    rng = random.Random(5)
    data = [(None, "a", " ".join(f"w{i}" for i in rng.sample(range(50), 10))) for _ in range(300)] + [(i, "a", "x " * 10) for i in range(300)]
    data += [(7, "b", "the same row again")] * 400 + [(None, None, "one two three")] * 300 + [(None, "b", None)] * 5
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    rows = mix(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(rows) == len(data)
    check([(r.source, r) for r in rows])
    taken = Counter()
    for r in take_mix(df).collect():
        taken[r.source] += len((r.text or "").split())
    assert taken == Counter({s: sum(r.taken for r in rows if r.source == s) for s in ("a", "b", None)})


def test_many_sources_fill_at_many_levels(spark):
    rng = random.Random(9)
    data = [(s if s else None, int(1.5 ** rng.randint(0, 25))) for s in ["", *(f"host{k}" for k in range(300))]]
    sizes = spark.createDataFrame([(s, n, 2) for s, n in data], "source string, size long, rows long")
    got = {r.source: r for r in targets(sizes).collect()}
    want = brute_targets({s: 2 * n for s, n in data})
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1].nth)] == sorted(s for s, _ in data if s) + [None]
    assert len({r.target / r.source_size for r in got.values()}) > 3 and targets(sizes.limit(0)).count() == 0
