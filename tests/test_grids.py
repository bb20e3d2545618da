import itertools

import numpy as np
from pyspark.sql import functions as F

from tellmark.operators import distributions as D
from tellmark.operators import grids as H
from tellmark.operators.clouds import nearest_cell

SPLIT = "map_name string, area string, sx double, bx double, sy double, by double, zmin double, zmax double, ox double, oy double, cw double, ch double, columns string, rows int, coarse boolean"
CLAIM = (
    "map_name string, area string, part_no int, part string, broad boolean, kind string, claim_no int, cell string, cells array<string>, "
    "x_low double, x_high double, y_low double, y_high double, size double, z_low double, z_high double"
)


def split(area, coarse=True, zmin=None, zmax=None):
    # pixels are positions, but upside down; half-cells are 10 by 5
    return ("m", area, 1.0, 0.0, 1.0, 0.0, zmin, zmax, 0.0, 0.0, 20.0, 10.0, "AB", 3, coarse)


def claim(area, no, part, kind, cell=None, cells=None, x=(0.0, 1.0), y=(0.0, 1.0), size=None, z=(None, None), broad=False, n=0):
    return ("m", area, no, part, broad, kind, n, cell, cells, *x, *y, size, *z)


def tables(spark, splits, claims):
    s = spark.createDataFrame(splits, SPLIT)
    return s, H.claim_rects(s, spark.createDataFrame(claims, CLAIM))


def parts(spark, plans, grid, area, points, stands=True):
    df = spark.createDataFrame([(i, "m", area, *p, stands) for i, p in enumerate(points)], "i int, map_name string, area string, x double, y double, z double, stands boolean")
    return [r.part for r in H.part_at(df, plans, grid, F.col("stands")).orderBy("i").collect()]


def test_names_of_half_cells(spark):
    names = ["A1a", "A1b", "A1c", "A1d", "B3d", "B4a", "C1a", "A0a", "A01a", "A1e", "", None, "a1a", "A99999a"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", H.cell_index(F.col("n"), F.lit("AB"), F.lit(3)).alias("i"))
    got = [None if r.i is None else tuple(r.i) for r in df.collect()]
    assert got == [(0, 0), (1, 0), (0, 1), (1, 1), (3, 5)] + [None] * 9
    back = df.where("i IS NOT NULL").select("n", H.cell_name(F.col("i.column"), F.col("i.row"), F.lit("AB")).alias("b")).collect()
    assert all(r.n == r.b for r in back)


def test_order_of_claims_edges_bands_and_the_nearest(spark):
    claims = [
        claim("c", 0, "box", "box", x=(2.0, 4.0), y=(1.0, 2.0)),
        claim("c", 1, "band", "region", "A1a", x=(0.0, 0.5), z=(0.0, 50.0)),
        claim("c", 2, "cross", "crossing", cells=["A1b", "A1c"], size=1.0),
        claim("c", 3, "first", "cell", "A1a", broad=True),
        claim("c", 3, "first", "cell", "A1b", broad=True, n=1),
        claim("c", 4, "far", "cell", "B3d"),
    ]
    s, r = tables(spark, [split("c"), split("fine", coarse=False)], claims + [("m", "fine", *x[2:]) for x in claims])
    assert H.split_faults(r).count() == 0
    plans, grid = H.compile_grid(s, r)
    points = [(2.0, -1.0, 0.0), (4.0, -1.0, 0.0), (0.0, 0.0, 49.0), (0.0, 0.0, 50.0), (5.0, 0.0, 10.0), (10.0, -5.0, 10.0), (6.0, -2.5, 60.0), (14.99, -7.4, 0.0),
              (9.99, -0.1, 0.0), (10.0, 0.0, 0.0), (20.0, -0.1, 0.0), (30.0, -25.0, 0.0), (-500.0, 0.0, 0.0), (500.0, -700.0, 0.0), (None, 0.0, 0.0), (float("nan"), 0.0, 0.0)]
    want = ["box", "band", "band", "first", "first", "cross", "cross", "cross", "first", "first", "first", "far", "first", "far", None, None]
    assert parts(spark, plans, grid, "c", points) == want
    # no half-cell is inherited where the area isn't coarse, and nothing off the claims is placed
    assert parts(spark, plans, grid, "fine", points) == [w if i not in (10, 12, 13) else None for i, w in enumerate(want)]
    # nobody stands: a band holds nothing
    assert parts(spark, plans, grid, "c", points[2:3], stands=False) == ["first"]
    assert parts(spark, plans, grid, "unknown", points[:2]) == [None, None]
    rest = {(r.area, r.cell): r.part for r in H.inherited(plans, grid).collect()}
    assert len(rest) == 24 - 3 and all(a == "c" for a, _ in rest)
    assert rest["c", "A1c"] == "first" and rest["c", "B3c"] == "far"


def test_equally_near_half_cells_go_to_the_first_claim(spark):
    s, r = tables(spark, [split("c", zmin=0.0, zmax=10.0)], [claim("c", 0, "late", "cell", "B1a"), claim("c", 1, "early", "cell", "A1a")])
    plans, grid = H.compile_grid(s, r)
    assert parts(spark, plans, grid, "c", [(15.0, 0.0, 0.0), (5.0, 0.0, 9.9), (5.0, 0.0, 10.0), (5.0, 0.0, -0.1)]) == ["late", "early", None, None]


def test_faults_of_a_split(spark):
    claims = [
        claim("c", 0, "one", "cell", "A1a"), claim("c", 1, "two", "region", "A1a", z=(0.0, 5.0)), claim("c", 2, "wide", "cell", "A2a", broad=True), claim("c", 3, "dup", "cell", "B1a"),
        claim("c", 3, "dup", "cell", "B1a", n=1), claim("c", 4, "off", "cell", "C1a"), claim("c", 5, "apart", "crossing", cells=["A1a", "B3d"], size=1.0), claim("c", 6, "out", "box", x=(0.0, 41.0)),
        claim("c", 7, "left", "box", x=(0.0, 3.0), y=(0.0, 3.0)), claim("c", 8, "right", "box", x=(2.0, 5.0), y=(2.0, 5.0)), claim("c", 9, "touch", "box", x=(5.0, 6.0), y=(2.0, 5.0)),
        claim("c", 10, "low", "region", "B2a", z=(0.0, 5.0)), claim("c", 11, "high", "region", "B2a", z=(5.0, 9.0)),
    ]
    _, r = tables(spark, [split("c")], claims)
    assert {(x.part, x.fault) for x in H.split_faults(r).collect()} == {
        ("two", "two callouts"), ("wide", "idle broad"), ("dup", "named twice"), ("off", "no half-cell"), ("apart", "no crossing"), ("out", "outside the grid"), ("right", "boxes overlap"),
    }


def test_covers_of_any_size_match_all_subsets(spark):
    rng = np.random.default_rng(4)
    for trial in range(60):
        names = [f"p{i}" for i in range(int(rng.integers(1, 7)))]
        sets = [sorted(rng.choice(names, size=int(rng.integers(1, len(names) + 1)), replace=False).tolist()) for _ in range(int(rng.integers(1, 9)))]
        counts = rng.integers(1, 4, len(sets))
        size = {p: sum(int(n) for s, n in zip(sets, counts) if p in s) for p in names}
        ranked = sorted((p for p in names if size[p]), key=lambda p: (-size[p], p))
        for k in range(1, 6):
            best, covered = [], 0
            for r in range(1, min(k, len(ranked)) + 1):
                for combo in itertools.combinations(ranked, r):
                    n = sum(int(c) for s, c in zip(sets, counts) if set(s) & set(combo))
                    if n > covered:
                        best, covered = list(combo), n
            assert D.best_cover(sets, counts, k) == (best, covered), (trial, k)
    rows = [("g", "a", 1), ("g", "a", 1), ("g", "b", 1), ("g", "b", 2), ("g", None, 3), ("g", "c", None), ("h", "z", 9), (None, "n", 1)]
    df = spark.createDataFrame(rows, "g string, part string, who int")
    assert {r.g: (r.parts, r.covered) for r in D.max_cover(df, ["g"], "part", "who", 3).collect()} == {"g": (["b"], 2), "h": (["z"], 1), None: (["n"], 1)}
    assert D.max_cover(df.limit(0), ["g"], "part", "who", 3).count() == 0


def test_every_unit_has_its_own_cloud(spark):
    rng = np.random.default_rng(8)
    cells = [(f"u{i % 3}", int(x), int(y), int(z), f"a{i % 7}") for i, (x, y, z) in enumerate(rng.integers(-9, 9, (400, 3)))] + [("u1", 0, 0, 0, None), (None, 0, 0, 0, "q")]
    points = [(f"u{i % 4}", i, *map(float, p)) for i, p in enumerate(rng.uniform(-300, 300, (500, 3)))] + [(None, 900, 0.0, 0.0, 0.0), ("u1", 901, None, 0.0, 0.0), ("u1", 902, 1e5, 0.0, 0.0)]
    c = spark.createDataFrame(cells, "unit string, cell_x int, cell_y int, cell_z int, area string")
    p = spark.createDataFrame(points, "unit string, id int, x double, y double, z double")
    got = {r.id: (r.area, r.distance) for r in nearest_cell(p, c, "id", 32, "area", 1.5, 20.0, 60.0, ["unit"]).collect()}
    assert len(got) == len(points)
    for u, i, x, y, z in points:
        own = [(((x - (a + 0.5) * 32) ** 2 + (y - (b + 0.5) * 32) ** 2 + (max(0.0, abs(z - (d + 0.5) * 32) - 20) * 1.5) ** 2) ** 0.5, area) for v, a, b, d, area in cells if u and v == u and area and x is not None]
        if not own:
            assert got[i] == (None, None)
            continue
        d, area = min(own)
        assert abs(got[i][1] - d) < 1e-9 and got[i][0] == (area if d <= 60 else None)
