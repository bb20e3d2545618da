"""Shared members of pairs of sets, counted in cells that hold whole sets of one side and an index of the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellmark.session import cut

#: Meetings (a member of a left set in a right set) of a cell, of one left set in a cell, of a pass within a cell, and right sets of an index row.
CELL, HOT, PASS, ROW = 1 << 22, 1 << 24, 1 << 20, 1024
#: Numbers of a matrix of members by right sets, and its products in the time of a meeting.
TABLE, FASTER = 1 << 22, 1000
#: Numbers in all indexes of a unit from which its cells may follow products, and meetings that such a cell is worth.
WIDE, GRID = 1 << 20, 1 << 26


def _codes(parts: list[pa.ChunkedArray]) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers of the values in their order, and the values."""
    each = pa.chunked_array([c for p in parts for c in p.chunks], parts[0].type).combine_chunks()
    each = (each.combine_chunks() if isinstance(each, pa.ChunkedArray) else each).dictionary_encode()
    order = pc.array_sort_indices(each.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = rank[each.indices.to_numpy(zero_copy_only=False)] if len(each) else np.empty(0, np.int64)
    return np.split(numbers, np.cumsum([len(p) for p in parts])[:-1]), each.dictionary.take(pa.array(order))


def _passes(left: pa.Table, index: pa.Table, side: int, pick: Callable) -> tuple[pa.Array, pa.Array, Iterator[tuple]]:
    """Left keys, right keys, and what ``pick`` makes of (left number, right number, common) of the pairs that share a member; a left set is in one pass.

    ``side`` 1 keeps greater right keys, -1 smaller ones, 0 all. ``pick`` also takes a
    matrix, (left numbers, None, common by right number), where no pair to keep is 0.
    """
    lists = index.column("_rights").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = pa.chunked_array([lists.flatten()])
    (members, listed), _ = _codes([left.column("_member"), index.column("_met")])
    (lefts, rights), keys = _codes([left.column("_left"), flat]) if side else ([None, None], None)
    if not side:
        (lefts,), left_keys = _codes([left.column("_left")])
        (rights,), right_keys = _codes([flat])
    else:
        left_keys = right_keys = keys
    # right sets of each member, one after the other
    size = max(members.max(), listed.max()) + 1
    owner = np.repeat(listed, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    rights = rights[np.argsort(owner, kind="stable")]
    ends = np.cumsum(np.bincount(owner, minlength=size))
    begins = ends - np.bincount(owner, minlength=size)
    order = np.argsort(lefts, kind="stable")
    lefts, members = lefts[order], members[order]
    length = (ends - begins)[members]
    heads = np.flatnonzero(np.r_[True, lefts[1:] != lefts[:-1]])
    before = np.cumsum(np.add.reduceat(length, heads))

    def run() -> Iterator[tuple]:
        at = 0
        while at < len(heads):
            upto = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + PASS, "right")))
            rows = slice(heads[at], heads[upto] if upto < len(heads) else len(lefts))
            at, n = upto, length[rows]
            place = np.repeat(begins[members[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            met, own = rights[place], np.repeat(lefts[rows], n)
            if side:
                kept = (met - own) * side > 0
                met, own = met[kept], own[kept]
            pairs = own * len(right_keys) + met
            pairs.sort()
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
            yield pick(pairs[first] // len(right_keys), pairs[first] % len(right_keys), np.diff(np.r_[first, len(pairs)]))

    def dense() -> Iterator[tuple]:
        table = np.zeros((size, len(right_keys)), np.float32)
        table[np.sort(owner), rights] = 1
        step = max(1, PASS // max(size, len(right_keys)))
        for at in range(0, len(heads), step):
            rows = slice(heads[at], heads[at + step] if at + step < len(heads) else len(lefts))
            own, row = np.unique(lefts[rows], return_inverse=True)
            some = np.zeros((len(own), size), np.float32)
            some[row, members[rows]] = 1
            common = some @ table
            if side:
                common *= (np.arange(len(right_keys)) - own[:, None]) * side > 0
            yield pick(own, None, common)

    # a product of matrices is less work where most members are in most sets
    small = size * len(right_keys) <= TABLE and len(heads) * size * len(right_keys) < before[-1] * FASTER
    return left_keys, right_keys, dense() if small else run()


def _pairs(least: int, side: int) -> Callable:
    def pick(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if b is None:
            row, b = np.nonzero(n >= max(least, 1))
            return a[row], b, n[row, b].astype(np.int64)
        return a[n >= least], b[n >= least], n[n >= least]

    def run(left: pa.Table, index: pa.Table) -> pa.Table:
        if not left.num_rows or not index.num_rows:
            return pa.table({"_left": left.column("_left").slice(0, 0), "_right": index.column("_rights").combine_chunks().flatten().slice(0, 0), "common": pa.array([], pa.int64())})
        left_keys, right_keys, passes = _passes(left, index, side, pick)
        a, b, n = (np.concatenate(c) for c in zip(*passes, strict=True))
        return pa.table({"_left": left_keys.take(pa.array(a)), "_right": right_keys.take(pa.array(b)), "common": pa.array(n, pa.int64())})

    return run


def _most(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each left number with the least right number that shares most, how many members, and how many right numbers share them."""
    if b is None:
        most = n.max(axis=1)
        any_ = np.flatnonzero(most)
        count = np.count_nonzero(n == most[:, None], axis=1)
        return a[any_], n.argmax(axis=1)[any_], most[any_].astype(np.int64), count[any_]
    if not len(a):
        return (np.empty(0, np.int64),) * 4
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    most = np.maximum.reduceat(n, heads)
    top = n == np.repeat(most, np.diff(np.r_[heads, len(a)]))
    count = np.add.reduceat(top.astype(np.int64), heads)
    least = np.flatnonzero(top)[np.cumsum(count) - count]
    return a[heads], b[least], most, count


def _best(side: int) -> Callable:
    def run(left: pa.Table, index: pa.Table) -> pa.Table:
        return _best_of(left, index, side)

    return run


def _best_of(left: pa.Table, index: pa.Table, side: int) -> pa.Table:
    if not left.num_rows or not index.num_rows:
        none = pa.array([], pa.int64())
        return pa.table({"_left": left.column("_left").slice(0, 0), "_right": index.column("_rights").combine_chunks().flatten().slice(0, 0), "common": none, "_n": none})
    left_keys, right_keys, passes = _passes(left, index, side, _most)
    a, b, n, k = (np.concatenate(c) for c in zip(*passes, strict=True))
    return pa.table({"_left": left_keys.take(pa.array(a)), "_right": right_keys.take(pa.array(b)), "common": pa.array(n, pa.int64()), "_n": pa.array(k, pa.int64())})


def sets(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member) without repeats and nulls."""
    return df.select(key, member).where(F.col(key).isNotNull() & F.col(member).isNotNull()).distinct()


def meetings(a: DataFrame, b: DataFrame, left_key: str, member: str) -> tuple[int, int]:
    """How often members of left sets are in right ones, in all and for the left set with most; runs a job."""
    held = b.groupBy(member).agg(F.count("*").alias("_r"))
    each = a.join(held, member).groupBy(left_key).agg(F.sum("_r").alias("_m"))
    found = each.agg(F.sum("_m"), F.max("_m")).first()
    return found[0] or 0, found[1] or 0


def grids(a: DataFrame, b: DataFrame, left_key: str, right_key: str, member: str, unit: Callable) -> DataFrame:
    """(_u, _shares, _slices): over how many shares of left and slices of right sets each unit is dealt; runs a job.

    Cells follow meetings, as ``CELL`` and ``HOT`` say. Where most members are in most
    sets, these are so many that a right set would be sent to nearly every share:
    there a cell counts by products, and holds as many left sets as ``GRID``
    allows and right sets as ``TABLE`` does.
    """
    held = b.groupBy(member).agg(F.count("*").alias("_r"), F.min(unit(F.col(right_key))).alias("_u"))
    each = a.join(held, member).groupBy(left_key).agg(F.sum("_r").alias("_m"))
    met = each.groupBy(unit(F.col(left_key)).alias("_u")).agg(F.sum("_m").alias("_all"), F.max("_m").alias("_most"), F.count("*").alias("_lefts"))
    own = b.groupBy(right_key).agg(F.count("*").alias("_n")).groupBy(unit(F.col(right_key)).alias("_u")).agg(F.count("*").alias("_rights"), F.sum("_n").alias("_rows"))
    known = met.join(own, "_u").join(held.groupBy("_u").agg(F.count("*").alias("_members")), "_u")
    up = lambda n, each: F.greatest(F.ceil(n / each), F.lit(1))
    shares = up(F.col("_all"), CELL)
    products = F.col("_lefts").cast("double") * F.col("_rights") * F.col("_members") / FASTER
    dense = (shares * F.col("_rows") > WIDE) & (products < F.col("_all"))
    return cut(known.select("_u", F.when(dense, up(products, GRID)).otherwise(shares).cast("int").alias("_shares"), F.when(dense, up(F.col("_rights") * F.col("_members"), TABLE)).otherwise(up(F.col("_most"), HOT)).cast("int").alias("_slices")))


def counted(a: DataFrame, b: DataFrame, left_key: str, right_key: str, member: str, run: Callable, more: str, size: tuple[int, int] | None, unit: Callable | None = None) -> DataFrame:
    """``run`` over cells: left sets are dealt whole over shares, and a share gets its members' right sets as lists, each member once.

    So no pair is shuffled, only what a share looks up, and never more than the
    meetings. If one left set meets too many, right sets are dealt over slices too.
    ``unit`` tells a left key's unit where members of one unit never are in sets of
    another; a cell then holds one unit's sets only, and each unit has its own
    number of cells (``grids``), whatever the ``size``.
    """
    left, right = a.select(F.col(left_key).alias("_left"), F.col(member).alias("_member")), b.select(F.col(right_key).alias("_right"), F.col(member).alias("_member"))
    if unit:
        each = grids(a, b, left_key, right_key, member, unit)
        cells = each.agg(F.sum(F.col("_shares") * F.col("_slices"))).first()[0] or 1
        left, right = (d.withColumn("_unit", unit(F.col(k))).join(F.broadcast(each.withColumnRenamed("_u", "_unit")), "_unit") for d, k in ((left, "_left"), (right, "_right")))
    else:
        shares, slices = -(-size[0] // CELL) or 1, -(-size[1] // HOT) or 1
        cells = shares * slices
        left, right = (d.withColumns({"_unit": F.lit(0), "_shares": F.lit(shares), "_slices": F.lit(slices)}) for d in (left, right))
    dealt = left.select("_left", "_member", F.pmod(F.xxhash64("_left"), F.col("_shares")).cast("int").alias("_share"), "_unit", "_slices")
    held = right.groupBy("_member").agg(F.ceil(F.count("*") / ROW).cast("int").alias("_rows"))
    spread = F.pmod(F.xxhash64("_right", F.lit(1)), F.col("_rows")).alias("_row")
    lists = right.join(held, "_member").select("_member", F.pmod(F.xxhash64("_right"), F.col("_slices")).cast("int").alias("_slice"), spread, "_right")
    lists = lists.groupBy("_member", "_slice", "_row").agg(F.collect_list("_right").alias("_rights")).drop("_row")
    index = dealt.select("_member", "_share", "_unit").distinct().join(lists, "_member").select(F.col("_unit").alias("_in"), F.col("_share").alias("_of"), F.col("_slice").alias("_part"), F.col("_member").alias("_met"), "_rights")
    dealt = dealt.select("_left", "_member", "_share", "_unit", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    # so many partitions that one sorts a few cells only
    n = max(a.sparkSession.sparkContext.defaultParallelism, -(-cells // 4))
    dealt, index = dealt.repartition(n, "_unit", "_share", "_slice"), index.repartition(n, "_in", "_of", "_part")
    kinds = f"_left {a.schema[left_key].dataType.simpleString()}, _right {b.schema[right_key].dataType.simpleString()}, common long{more}"
    return dealt.groupBy("_unit", "_share", "_slice").cogroup(index.groupBy("_in", "_of", "_part")).applyInArrow(run, kinds)


def pairs(a: DataFrame, b: DataFrame, left_key: str, right_key: str, member: str, least: int, side: int, size: tuple[int, int] | None, unit: Callable | None = None) -> DataFrame:
    """(left_key, right_key, common) of all pairs that share at least ``least`` members; with ``side`` 1 only those whose right key is greater, with -1 smaller. A pair lies in one slice."""
    return counted(a, b, left_key, right_key, member, _pairs(least, side), "", size, unit).select(F.col("_left").alias(left_key), F.col("_right").alias(right_key), "common")


def firsts(a: DataFrame, b: DataFrame, left_key: str, right_key: str, member: str, side: int, unit: Callable | None = None) -> DataFrame:
    """(_left, _top, _n, _right): how many members each left set shares at most, how many right sets share them, and the least of these.

    Sides have (key, member) without repeats and nulls. A cell gives one row per left set, so that no pair leaves it.
    """
    found = counted(a, b, left_key, right_key, member, _best(side), ", _n long", None if unit else meetings(a, b, left_key, member), unit)
    each = found.groupBy("_left").agg(F.max("common").alias("_top"), F.collect_list(F.struct("common", "_n", "_right")).alias("_e"))
    at_top = F.filter("_e", lambda x: x["common"] == F.col("_top"))
    n = F.aggregate(at_top, F.lit(0).cast("long"), lambda k, x: k + x["_n"])
    return each.select("_left", "_top", n.alias("_n"), F.array_min(F.transform(at_top, lambda x: x["_right"])).alias("_right"))


def best(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str) -> DataFrame:
    """(left_key, right_key, common): the right set that shares most with each left set that shares any; null on a tie."""
    found = firsts(sets(left, left_key, member), sets(right, right_key, member), left_key, right_key, member, 0)
    return found.select(F.col("_left").alias(left_key), F.when(F.col("_n") == 1, F.col("_right")).alias(right_key), F.col("_top").alias("common"))
