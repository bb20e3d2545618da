"""Nearest labelled cell of each point, many clouds of cells at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellmark.functions.scalars import finite_point

#: Points of a task, cells of a block, and numbers of a matrix of points by blocks.
SHARD, BLOCK, MATRIX = 20_000, 32, 1 << 18


def _blocks(centres: np.ndarray) -> np.ndarray:
    """Numbers of the cells in blocks of at most BLOCK: halved along the widest axis; short blocks are filled with -1."""
    out, left = [], [np.arange(len(centres))]
    while left:
        rows = left.pop()
        if len(rows) <= BLOCK:
            out.append(np.concatenate([rows, np.full(BLOCK - len(rows), -1)]))
            continue
        own = centres[rows]
        half = len(rows) // 2
        order = np.argpartition(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], half)
        left += [rows[order[:half]], rows[order[half:]]]
    return np.array(out)


def search(points: np.ndarray, centres: np.ndarray, ranks: np.ndarray, z_weight: float, z_tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest centre of every point, and the least rank at that distance."""
    blocks = _blocks(centres)
    filled = np.where((blocks >= 0)[:, :, None], centres[blocks], np.inf)
    low = filled.min(axis=1)
    high = np.where((blocks >= 0)[:, :, None], centres[blocks], -np.inf).max(axis=1)
    rank_of = np.where(blocks >= 0, ranks[blocks], np.iinfo(np.int64).max)

    def length(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray) -> np.ndarray:
        dz = np.maximum(0.0, dz - z_tolerance) * z_weight
        return np.sqrt(dx * dx + dy * dy + dz * dz)

    def meet(p: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.abs(points[p][:, None, :] - filled[b])
        d = length(apart[..., 0], apart[..., 1], apart[..., 2])
        least = d.min(axis=1)
        return least, np.where(d == least[:, None], rank_of[b], np.iinfo(np.int64).max).min(axis=1)

    distance, rank = np.empty(len(points)), np.empty(len(points), np.int64)
    step = max(1, MATRIX // len(blocks))
    for at in range(0, len(points), step):
        rows = np.arange(at, min(at + step, len(points)))
        gap = [np.maximum(np.maximum(low[None, :, k] - points[rows, k, None], points[rows, k, None] - high[None, :, k]), 0.0) for k in range(3)]
        bound = length(*gap)
        first = bound.argmin(axis=1)
        best, best_rank = meet(rows, first)
        # blocks that may hold something as near, ties included; rounding is far below this slack
        again = bound <= (best * (1 + 1e-12) + 1e-12)[:, None]
        again[np.arange(len(rows)), first] = False
        p, b = np.nonzero(again)
        for part in range(0, len(p), MATRIX // BLOCK):
            some = slice(part, part + MATRIX // BLOCK)
            d, r = meet(rows[p[some]], b[some])
            order = np.lexsort((r, d, p[some]))
            own, keep = np.unique(p[some][order], return_index=True)
            d, r = d[order][keep], r[order][keep]
            better = (d < best[own]) | ((d == best[own]) & (r < best_rank[own]))
            best[own[better]], best_rank[own[better]] = d[better], r[better]
        distance[rows], rank[rows] = best, best_rank
    return distance, rank


def _nearest(keys: list[str], z_weight: float, z_tolerance: float):
    def run(points: pa.Table, cells: pa.Table) -> pa.Table:
        own = points.select(keys)
        if not points.num_rows or not cells.num_rows:
            return own.slice(0, 0).append_column("distance", pa.array([], pa.float64())).append_column("_label", pa.array([], pa.string()))
        at = lambda t, names: np.stack([t.column(c).to_numpy().astype(float) for c in names], axis=1)
        labels = np.array(cells.column("_label").to_pylist(), object)
        names, ranks = np.unique(labels, return_inverse=True)
        distance, rank = search(at(points, "xyz"), at(cells, ["_x", "_y", "_z"]), ranks.astype(np.int64), z_weight, z_tolerance)
        return own.append_column("distance", pa.array(distance)).append_column("_label", pa.array(list(names[rank]), pa.string()))

    return run


def nearest_cell(
    points: DataFrame, cells: DataFrame, key: str | Sequence[str], grid: float, label: str, z_weight: float, z_tolerance: float, limit: float, unit: Sequence[str] = ()
) -> DataFrame:
    """unit, key, label and distance of each point's nearest cell centre of its own unit's cloud; the label only within ``limit``.

    Heights within the tolerance are free, beyond it weighted. Ties go to the
    smaller label. ``key`` names a point within its unit. Points with a coordinate
    that is null or not finite, with a null in their unit, and all points of a unit
    without cells come back with nulls; cells without a label count for nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    unit = list(unit)
    names = [*unit, *keys]
    out = points.select(*names)
    found = nearest_found(points, cells, keys, grid, z_weight, z_tolerance, unit, label)
    renamed = {c: f"_f_{c}" for c in names}
    back = out.join(found.withColumnsRenamed(renamed), [F.col(c) == F.col(n) for c, n in renamed.items()], "left")
    return back.select(*names, F.when(F.col("distance") <= limit, F.col("_label")).alias(label), "distance")


def nearest_found(points: DataFrame, cells: DataFrame, keys: list[str], grid: float, z_weight: float, z_tolerance: float, unit: Sequence[str] = (), label: str = "area") -> DataFrame:
    """unit, key, distance and _label of the points of ``nearest_cell`` that have a nearest cell, however far.

    A task holds the cells of one unit (their number is bounded by the places of
    a map, not by the points) and at most about ``SHARD`` of its points, however
    many points a unit has; both sides are shuffled once. Cells lie in blocks,
    and only blocks that can hold the nearest cell are compared, point by point.
    """
    unit = list(unit)
    out = points.select(*unit, *keys)
    centre = [((F.col(f"cell_{a}") + 0.5) * grid).alias(f"_{a}") for a in "xyz"]
    cloud = cells.where(F.col(label).isNotNull()).select(*unit, *centre, F.col(label).cast("string").alias("_label"))
    sound = finite_point(*(F.col(a) for a in "xyz"))
    for c in unit:
        sound = sound & F.col(c).isNotNull()
        cloud = cloud.where(F.col(c).isNotNull())
    # shards are dealt by the key; a unit's number of them follows from its points
    asked = points.where(sound).select(*unit, *keys, *(F.col(a).cast("double").alias(a) for a in "xyz"))
    parts = asked.groupBy(*unit).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_parts")).withColumn("_one", F.lit(1))
    on = unit or ["_one"]
    asked, cloud = asked.withColumn("_one", F.lit(1)), cloud.withColumn("_one", F.lit(1))
    wanted = parts.select(*on, "_parts")
    dealt = asked.join(wanted, on).withColumn("_shard", F.pmod(F.xxhash64(*keys), F.col("_parts")).cast("int")).drop("_parts", "_one")
    copies = cloud.join(wanted, on).withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copies = copies.select(*(F.col(c).alias(f"_c_{c}") for c in unit), F.col("_of").alias("_c_shard"), "_x", "_y", "_z", "_label")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    names = [*unit, *keys]
    return dealt.groupBy(*unit, "_shard").cogroup(copies.groupBy(*(f"_c_{c}" for c in unit), "_c_shard")).applyInArrow(_nearest(names, z_weight, z_tolerance), f"{kinds}, distance double, _label string")
