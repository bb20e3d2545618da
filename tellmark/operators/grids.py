"""Parts of an area on a picture's grid: half-cells by name, claims with their rectangles, and the part that holds a position.

A split (one row per map and area) lays a grid over a picture: ``sx bx sy by``
project a position (x to the right, y upward) to pixels (y downward), ``ox oy``
is the grid's corner, ``cw ch`` a cell's size, ``columns`` the letters of its
columns and ``rows`` their number. Every cell has four half-cells a to d, row by
row. ``zmin zmax`` are the heights of the floor the picture shows (null: open).

Claims (rows of map, area, part_no, part, broad, kind, claim_no and what the kind
needs) are a ``box`` of pixels, a whole ``cell`` by name, a ``region`` (fractions
of a named half-cell) or a ``crossing`` (a box of ``size`` half-cells around the
point where named half-cells meet); ``z_low z_high`` is a band of heights.

Splits and claims are a dimension of a few thousand rows. They are compiled once
into one row per half-cell, which holds the claims that reach into it in order and
the nearest named half-cell's part. A position then is one equality join away
from its few candidates, whatever the number of claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellmark.session import cut

KEYS = ["map_name", "area"]
_NAME = r"^([A-Z])([1-9][0-9]{0,4})([abcd])$"
_CLAIM = "struct<rank: struct<kind: int, part_no: int, sub: int, claim_no: int>, part: string, x0: double, y0: double, x1: double, y1: double, z_low: double, z_high: double>"
_NOISE = 1e-9


def cell_index(name: Column, columns: Column, rows: Column) -> Column:
    """column and row of a half-cell, from 0; null if the grid has no half-cell of this name."""
    letter, number = F.regexp_extract(name, _NAME, 1), F.regexp_extract(name, _NAME, 2).try_cast("int")
    q = F.instr(F.lit("abcd"), F.regexp_extract(name, _NAME, 3)) - 1
    at = F.instr(columns, letter) - 1
    held = name.rlike(_NAME) & (at >= 0) & (number <= rows)
    return F.when(held, F.struct((2 * at + q % 2).cast("int").alias("column"), (2 * (number - 1) + F.floor(q / 2)).cast("int").alias("row")))


def cell_name(column: Column, row: Column, columns: Column) -> Column:
    """The name of a half-cell by its index."""
    letter = F.substring(columns, F.floor(column / 2).cast("int") + 1, F.lit(1))
    quarter = F.substring(F.lit("abcd"), (2 * (row % 2) + column % 2).cast("int") + 1, F.lit(1))
    return F.concat(letter, (F.floor(row / 2) + 1).cast("string"), quarter)


def claim_rects(splits: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with ``x0 y0 x1 y1`` in pixels, ``rank`` (boxes, then parts in order, their cells before their regions), ``index`` of a whole half-cell, and ``fault``.

    ``fault`` names what is wrong with a claim itself: a name that is no half-cell
    of the grid, half-cells that meet in no point, a box outside of the grid.
    """
    c = claims.join(splits.select(*KEYS, "ox", "oy", "cw", "ch", "columns", "rows"), KEYS)
    index = lambda name: cell_index(name, F.col("columns"), F.col("rows"))
    c = c.withColumn("at", index(F.col("cell"))).withColumn("_met", F.transform("cells", index))
    hw, hh = F.col("cw") / 2, F.col("ch") / 2
    left, right = F.array_max(F.transform("_met", lambda i: i["column"])), F.array_min(F.transform("_met", lambda i: i["column"] + 1))
    top, bottom = F.array_max(F.transform("_met", lambda i: i["row"])), F.array_min(F.transform("_met", lambda i: i["row"] + 1))
    kind = F.col("kind")
    # a fraction that reaches the far side ends on the next half-cell's side exactly
    far = lambda high, corner, step, at, low: F.when(high == 1.0, corner + (at + 1) * step).otherwise(low + high * step)
    cx, cy = F.col("ox") + F.col("at.column") * hw, F.col("oy") + F.col("at.row") * hh
    half = F.col("size") / 2
    rect = {
        "x0": (F.col("x_low"), cx, cx + F.col("x_low") * hw, F.col("ox") + left * hw - half * hw),
        "y0": (F.col("y_low"), cy, cy + F.col("y_low") * hh, F.col("oy") + top * hh - half * hh),
        "x1": (F.col("x_high"), F.col("ox") + (F.col("at.column") + 1) * hw, far(F.col("x_high"), F.col("ox"), hw, F.col("at.column"), cx), F.col("ox") + left * hw + half * hw),
        "y1": (F.col("y_high"), F.col("oy") + (F.col("at.row") + 1) * hh, far(F.col("y_high"), F.col("oy"), hh, F.col("at.row"), cy), F.col("oy") + top * hh + half * hh),
    }
    for name, (box, cell, region, crossing) in rect.items():
        c = c.withColumn(name, F.when(kind == "box", box).when(kind == "cell", cell).when(kind == "region", region).when(kind == "crossing", crossing))
    outside = (F.col("x0") < F.col("ox")) | (F.col("y0") < F.col("oy")) | (F.col("x1") > F.col("ox") + F.col("cw") * F.length("columns")) | (F.col("y1") > F.col("oy") + F.col("ch") * F.col("rows"))
    fault = (
        F.when(kind.isin("cell", "region") & F.col("at").isNull(), "no half-cell")
        .when((kind == "crossing") & F.exists("_met", lambda i: i.isNull()), "no half-cell")
        .when((kind == "crossing") & ((left != right) | (top != bottom) | (F.size(F.array_distinct("cells")) < 2)), "no crossing")
        .when((kind == "box") & outside, "outside the grid")
        .when((F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1")) | (F.col("z_low") >= F.col("z_high")), "empty")
    )
    rank = F.struct(F.when(kind == "box", 0).otherwise(1).alias("kind"), F.col("part_no"), F.when(kind.isin("box", "cell"), 0).otherwise(1).alias("sub"), F.col("claim_no"))
    out = c.select("*", rank.alias("rank"), fault.alias("fault"), F.when(kind == "cell", F.col("at")).alias("index"))
    # a small table that every later step reads: computed once
    return cut(out.drop("at", "_met", "ox", "oy", "cw", "ch", "columns", "rows"))


def split_faults(rects: DataFrame) -> DataFrame:
    """(map_name, area, part, fault): what would give a position two callouts, or a flag no meaning.

    Besides the faults of single claims: a spot that two parts claim at one height
    unless the later one is broad, a half-cell that a part names twice, a broad
    part that overlaps no earlier one, boxes that overlap.
    """
    own = rects.where("fault IS NOT NULL").select(*KEYS, "part", "fault")
    names = ["part", "part_no", "kind", "broad", "rank", "x0", "y0", "x1", "y1", F.coalesce("z_low", F.lit(float("-inf"))).alias("low"), F.coalesce("z_high", F.lit(float("inf"))).alias("high")]
    sound = rects.where("fault IS NULL").select(*KEYS, F.struct(*names).alias("b"))
    other = sound.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("b").alias("a"))
    a, b = F.col("a"), F.col("b")
    meet = (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    level = (a["low"] < b["high"]) & (b["low"] < a["high"])
    boxes = (a["kind"] == "box") & (b["kind"] == "box")
    others = (a["kind"] != "box") & (b["kind"] != "box")
    # claims of one area only meet each other; they are a few dozen
    met = sound.join(other, [F.col(k) == F.col(f"_{k}") for k in KEYS] + [a["rank"] < b["rank"], meet, boxes | (others & level)], "left")
    earlier = a.isNotNull() & others & (a["part_no"] < b["part_no"])
    some = lambda which: F.coalesce(F.bool_or(which), F.lit(False))
    of_part = met.groupBy(*KEYS, b["part"].alias("part")).agg(
        some(earlier & ~b["broad"]).alias("double"), some(a.isNotNull() & (a["part_no"] == b["part_no"]) & (a["kind"] == "cell") & (b["kind"] == "cell")).alias("twice"),
        some(a.isNotNull() & boxes).alias("over"), (some(b["broad"]) & ~some(earlier)).alias("idle"),
    )
    named = {"double": "two callouts", "twice": "named twice", "over": "boxes overlap", "idle": "idle broad"}
    faults = F.filter(F.array(*(F.when(F.col(c), text) for c, text in named.items())), lambda f: f.isNotNull())
    return own.unionByName(of_part.select(*KEYS, "part", F.explode(faults).alias("fault"))).distinct()


def _nearest(named: Column, column: Column, row: Column, hw: Column, hh: Column) -> Column:
    """The part of the nearest named half-cell: by steps, so that what is equally far is equal; ties to the first claim."""
    steps = lambda n: F.pow((n["index"]["column"] - column) * hw, F.lit(2)) + F.pow((n["index"]["row"] - row) * hh, F.lit(2))
    return F.array_min(F.transform(named, lambda n: F.struct(steps(n).alias("d"), n["rank"].alias("rank"), n["part"].alias("part"))))["part"]


def compile_grid(splits: DataFrame, rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The splits with their named half-cells, and one row per half-cell of every grid.

    A half-cell has ``claims`` (those that reach into it, first claim first),
    ``named`` (the first part that names it whole) and ``nearest`` (its part or
    that of the nearest named half-cell; null in an area that isn't coarse).
    """
    good = rects.where("fault IS NULL")
    first = good.where("index IS NOT NULL").groupBy(*KEYS, "index").agg(F.min(F.struct("rank", "part")).alias("f"))
    named = first.groupBy(*KEYS).agg(F.collect_list(F.struct("index", "f.rank", "f.part")).alias("named"))
    plans = splits.join(named, KEYS, "left")
    hw, hh = F.col("cw") / 2, F.col("ch") / 2
    every = plans.withColumn("column", F.explode(F.sequence(F.lit(0), 2 * F.length("columns") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), 2 * F.col("rows") - 1)))
    reach = lambda low, high, corner, step: F.sequence(F.floor((low - corner) / step - _NOISE).cast("int"), (F.ceil((high - corner) / step + _NOISE) - 1).cast("int"))
    spread = good.join(splits.select(*KEYS, "ox", "oy", "cw", "ch"), KEYS)
    spread = spread.withColumn("column", F.explode(reach(F.col("x0"), F.col("x1"), F.col("ox"), hw))).withColumn("row", F.explode(reach(F.col("y0"), F.col("y1"), F.col("oy"), hh)))
    cells = [*KEYS, "column", "row"]
    claims = spread.groupBy(*cells).agg(F.array_sort(F.collect_list(F.struct("rank", "part", "x0", "y0", "x1", "y1", "z_low", "z_high"))).alias("claims"))
    own = first.select(*KEYS, "index.column", "index.row", F.col("f.part").alias("whole"))
    near = F.when(F.col("coarse"), _nearest(F.col("named"), F.col("column"), F.col("row"), hw, hh))
    grid = every.join(claims, cells, "left").join(own, cells, "left")
    return plans, grid.select(*cells, F.coalesce("claims", F.expr(f"CAST(array() AS array<{_CLAIM}>)")).alias("claims"), F.col("whole").alias("named"), near.alias("nearest"))


def part_at(points: DataFrame, plans: DataFrame, grid: DataFrame, stands: Column | None = None, part: str = "part") -> DataFrame:
    """Points (map_name, area, x, y, z, ...) with the part that each is counted under, null where the split places none.

    In order: the first box, then the first claim that holds the point (lower sides
    included, upper ones not), then in a coarse area the nearest named half-cell's
    part, also off the grid. Bands hold only those who stand (``stands``). Without
    a split, off its floor, or with a coordinate that is null or not finite there is no part.
    """
    stand = F.lit(True) if stands is None else F.coalesce(stands, F.lit(False))
    geometry = ["sx", "bx", "sy", "by", "ox", "oy", "cw", "ch", "zmin", "zmax", "coarse", "named"]
    small = plans.select(*(F.col(k).alias(f"_k_{k}") for k in KEYS), F.struct(*geometry).alias("_s"))
    df = points.withColumn("_stands", stand).join(small, [F.col(k) == F.col(f"_k_{k}") for k in KEYS], "left").drop(*(f"_k_{k}" for k in KEYS))
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    s, z = F.col("_s"), F.col("z")
    on_floor = (z >= F.coalesce(s["zmin"], F.lit(float("-inf")))) & (z < F.coalesce(s["zmax"], F.lit(float("inf"))))
    sound = F.coalesce(finite("x") & finite("y") & finite("z") & on_floor, F.lit(False))
    df = df.withColumn("_px", F.when(sound, s["sx"] * F.col("x") + s["bx"])).withColumn("_py", F.when(sound, -s["sy"] * F.col("y") + s["by"]))
    df = df.withColumn("_column", F.floor((F.col("_px") - s["ox"]) / (s["cw"] / 2))).withColumn("_row", F.floor((F.col("_py") - s["oy"]) / (s["ch"] / 2)))
    names = {c: f"_g_{c}" for c in (*KEYS, "column", "row", "claims", "named", "nearest")}
    found = df.join(grid.withColumnsRenamed(names), [F.col(k) == F.col(names[k]) for k in KEYS] + [F.col("_column") == F.col("_g_column"), F.col("_row") == F.col("_g_row")], "left")
    px, py = F.col("_px"), F.col("_py")

    def holds(c: Column) -> Column:
        banded = c["z_low"].isNotNull() | c["z_high"].isNotNull()
        inside = (z >= F.coalesce(c["z_low"], F.lit(float("-inf")))) & (z < F.coalesce(c["z_high"], F.lit(float("inf"))))
        return (px >= c["x0"]) & (px < c["x1"]) & (py >= c["y0"]) & (py < c["y1"]) & (~banded | (F.col("_stands") & inside))

    claimed = F.get(F.filter("_g_claims", holds), F.lit(0))["part"]
    off = F.when(s["coarse"] & F.col("_g_column").isNull() & px.isNotNull(), _nearest(s["named"], F.col("_column"), F.col("_row"), s["cw"] / 2, s["ch"] / 2))
    out = found.withColumn(part, F.when(px.isNotNull(), F.coalesce(claimed, F.col("_g_nearest"), off)))
    return out.drop("_stands", "_s", "_px", "_py", "_column", "_row", *names.values())


def inherited(plans: DataFrame, grid: DataFrame) -> DataFrame:
    """(map_name, area, cell, part): the half-cells that no part names, and the part that each takes from the nearest named one."""
    rest = grid.where("named IS NULL AND nearest IS NOT NULL").join(plans.select(*KEYS, "columns"), KEYS)
    return rest.select(*KEYS, cell_name(F.col("column"), F.col("row"), F.col("columns")).alias("cell"), F.col("nearest").alias("part"))
