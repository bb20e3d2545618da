"""Order-dependent operators: running numbers, gaps and islands, contiguous predecessors, clamped counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(df: DataFrame, by: list[str], order: list[str], counts: Column, name: str) -> DataFrame:
    """Number the rows that count, in order within ``by``; null on the others."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.when(counts, F.sum(counts.cast("int")).over(so_far)))


def mark_runs(df: DataFrame, by: list[str], order: list[str], same: list[str], at: str, gap: Column, name: str) -> DataFrame:
    """Number the runs within ``by`` from 1: a run breaks where a ``same`` column changes (null-safe) or ``at`` jumps by more than ``gap``."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.row_number().over(w) == 1
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    fresh = fresh | F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False))
    marked = df.withColumn(name, fresh.cast("int"))
    return marked.withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def run_ends(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``by``: first_<c> and last_<c> of every kept column by ``order``, and rows."""
    row, key = F.struct(*keep), F.struct(*order)
    ends = df.groupBy(*by).agg(
        F.min_by(row, key).alias("_first"), F.max_by(row, key).alias("_last"), F.count("*").alias("rows")
    )
    return ends.select(
        *by,
        *(F.col(f"_first.{c}").alias(f"first_{c}") for c in keep),
        *(F.col(f"_last.{c}").alias(f"last_{c}") for c in keep),
        "rows",
    )


def endpoint_rows(ends: DataFrame, by: list[str], keep: list[str], kinds: tuple[str, str]) -> DataFrame:
    """Two rows for a run of several rows, one for a run of one: its first and its last point."""
    side = lambda prefix, kind: [*by, F.lit(kind).alias("kind"), *(F.col(f"{prefix}_{c}").alias(c) for c in keep)]
    last = ends.where("rows > 1").select(*side("last", kinds[1]))
    return ends.select(*side("first", kinds[0])).unionByName(last)


def contiguous_previous(df: DataFrame, by: list[str], number: str, same: list[str], take: list[str]) -> DataFrame:
    """prev_<c> of the row numbered one less within ``by``, only if the ``same`` columns agree."""
    w = Window.partitionBy(*by).orderBy(number)
    ok = F.lag(number).over(w) == F.col(number) - 1
    for c in same:
        ok = ok & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumns({f"prev_{c}": F.when(ok, F.lag(c).over(w)) for c in take})


#: Rows that one clamp function stands for.
BLOCK = 256


def clamped_counter(
    df: DataFrame, by: list[str], order: list[str], step: Column, low: int, high: int, start: int, name: str
) -> DataFrame:
    """The counter before each row: ``start``, then moved by ``step`` (null: not) and clamped after every row.

    Clamping is no running sum, but a row of moves is one function again, min(high',
    max(low', x + shift)), and two such functions make a third. So the sorted rows
    of each ``by`` are cut into blocks of ``BLOCK``, each block becomes a function,
    those of the blocks before give the value at its begin, and the block is walked
    from there: expressions only, one shuffle. A row of a block holds the functions of
    those before it, a group's rows over ``BLOCK``.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    w = Window.partitionBy(*by).orderBy(*order)
    row = F.struct(*(F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)))
    cut = df.select(*by, (F.row_number().over(w) - 1).alias("_k"), F.coalesce(step, F.lit(0)).cast("int").alias("_s"), row.alias("_row"))
    sorted_rows = F.expr("array_sort(collect_list(struct(_k, _s, _row)), (a, b) -> a._k - b._k)")
    blocks = cut.groupBy(*by, F.expr(f"_k div {BLOCK}").alias("_b")).agg(sorted_rows.alias("_rows"))
    clamp = lambda x: f"greatest({low}L, least({high}L, {x}))"
    wide = 1 << 40
    moved = f"named_struct('lo', {clamp('f.lo + x._s')}, 'hi', {clamp('f.hi + x._s')}, 'shift', f.shift + x._s)"
    function = F.expr(f"aggregate(_rows, named_struct('lo', -{wide}L, 'hi', {wide}L, 'shift', 0L), (f, x) -> {moved})")
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_f", function).withColumn("_before", F.collect_list("_f").over(earlier))
    at = placed.withColumn("_at", F.expr(f"aggregate(_before, {start}L, (v, f) -> greatest(f.lo, least(f.hi, v + f.shift)))"))
    values = at.withColumn("_values", F.expr(f"aggregate(_rows, array(_at), (a, x) -> concat(a, array({clamp('element_at(a, -1) + x._s')})))"))
    each = values.select(*by, F.explode(F.expr("zip_with(_rows, slice(_values, 1, size(_rows)), (r, v) -> struct(r._row AS row, CAST(v AS INT) AS v))")).alias("e"))
    # the group's own columns, so that what follows by them needs no other shuffle
    return each.select(*(F.col(c) if c in by else F.col(f"e.row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)), F.col("e.v").alias(name))


def without_repeats(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the one before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_same", (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w)))
        .where("NOT _same")
        .drop("_same")
    )


def fill_number(df: DataFrame, by: list[str], order: list[str], known: str, name: str) -> DataFrame:
    """Missing numbers counted on from the last known one, or back from the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(w)
    shift = F.col(known) - F.col("_place")
    numbered = df.withColumn("_place", place)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    offset = F.coalesce(F.last(shift, ignorenulls=True).over(back), F.first(shift, ignorenulls=True).over(ahead))
    return numbered.withColumn(name, offset + F.col("_place")).drop("_place")
