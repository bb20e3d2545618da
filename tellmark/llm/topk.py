"""Exact top-k by inner product: cover trees over queries and over data, searched together.

Vectors are dealt to the nearest of some sampled pivots, so that a block of
bounded size holds vectors that are close; each block becomes one row that holds a
cover tree: nodes with a centre point and the radius that covers their points,
each level's radius half of the one above, points that no cover groups being a
leaf of their own. Queries are blocks and trees of their own.

The search prunes twice. Every query block meets its closest data block first;
its worst k-th score then rules out data blocks by centres and radii before their
trees are sent anywhere. A task holds one block of queries and streams the data
trees left, best bound first: pairs of nodes are visited from the top and dropped
when not even the best score that centres and radii allow reaches the worst k-th
score of the query group. What a task returns is k rows per query; they merge in
one window whose partial top-k runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.llm.common import stored
from tellmark.session import table

K = 10
SCALE = 1024
#: Rows of a data tree and of a query tree, points of a leaf, and points that make a cover worth a node.
BLOCK, QUERY_BLOCK, LEAF, GROUP = 1024, 1024, 32, 8
#: Vectors sampled as pivots at most, and data trees that one task streams, about.
PIVOTS, STREAMED = 256, 64
#: Products of norms below which sums of products are exact in doubles and in 64-bit integers, and pairs scored at once beyond the first.
IN_DOUBLE, IN_LONG, WIDE_PAIRS = 2.0**52, 2.0**62, 1 << 14
_NONE = np.iinfo(np.int64).min
_TREE = "dim int, block long, names int, centre array<double>, radius double, ids binary, points binary, nodes binary"


class Tree:
    """Points in depth-first order, and nodes: start, end, centre, radius, first child, end of children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray):
        self.ids, self.points = ids, points
        self.start, self.end, self.centre = (nodes[:, k].astype(np.int64) for k in range(3))
        self.radius = nodes[:, 3]
        self.low, self.high = nodes[:, 4].astype(np.int64), nodes[:, 5].astype(np.int64)
        self.middle = points[self.centre]
        self.norm = np.sqrt((self.middle**2).sum(axis=1))

    def leaf(self, node: int) -> bool:
        return self.low[node] == self.high[node]


def build(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and points in depth-first order of a cover tree, and its nodes."""
    distances = lambda rows, at: np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1))
    nodes: list[list[float]] = []
    order: list[np.ndarray] = []
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (points**2).sum(axis=1)
        apart = squares[:, None] + squares[None, :] - 2 * (points @ points.T)  # tells who is near, radii are exact

    def cover(rows: np.ndarray, scale: float) -> list[np.ndarray]:
        """Parts around one point each; the points of parts too small to be worth a node are the last part."""
        parts, loose, left = [], [], rows
        while len(left):
            near = apart[left[0], left] <= scale * scale
            near[0] = True
            (parts if near.sum() >= GROUP else loose).append(left[near])
            left = left[~near]
        return parts + ([np.concatenate(loose)] if loose else [])

    def grow(at: int, rows: np.ndarray, start: int, splits: bool) -> None:
        middle = points[rows].mean(axis=0) if points.shape[1] else np.zeros(0)
        centre = rows[int(np.argmin(((points[rows] - middle) ** 2).sum(axis=1)))]
        radius = float(distances(rows, centre).max())
        parts = cover(rows, radius / 2) if splits and len(rows) > LEAF and radius > 0 else [rows]
        nodes[at] = [start, start + len(rows), centre, radius, 0, 0]
        if len(parts) < 2:
            order.append(rows)
            return
        low = len(nodes)
        nodes[at][4:] = [low, low + len(parts)]
        nodes.extend([[]] * len(parts))
        for k, part in enumerate(parts):
            grow(low + k, part, start, len(part) < len(rows) and apart[part[0], part].max() <= radius * radius)
            start += len(part)

    nodes.append([])
    grow(0, np.arange(len(ids)), 0, True)
    rows = np.concatenate(order)
    table = np.array(nodes, float)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    table[:, 2] = place[table[:, 2].astype(np.int64)]
    return ids[rows], points[rows], table


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; pairs that a double can't sum exactly are summed as integers.

    A product of norms bounds the sum of the products' sizes. A score beyond 64 bits is an error, as it is in SQL.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((points**2).sum(axis=1))[None, :]
        scores = np.rint(queries @ points.T)
        narrow = bound < IN_DOUBLE
        if narrow.all():
            return scores.astype(np.int64)
        scores = np.where(narrow, scores, 0).astype(np.int64)
    row, column = np.nonzero(~narrow)
    long = bound[row, column] < IN_LONG
    for kept, whole in ((long, lambda x: x.astype(np.int64)), (~long, lambda x: np.frompyfunc(int, 1, 1)(x))):
        r, c = row[kept], column[kept]
        for at in range(0, len(r), WIDE_PAIRS):
            i, j = r[at : at + WIDE_PAIRS], c[at : at + WIDE_PAIRS]
            found = (whole(queries[i]) * whole(points[j])).sum(axis=1)
            if found.dtype == object and not all(_NONE < x < 1 << 63 for x in found):
                raise OverflowError("a score doesn't fit 64 bits")
            scores[i, j] = found.astype(np.int64)
    return scores


class Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: Tree, k: int, floor: int = _NONE):
        n = len(queries.ids)
        self.k, self.queries, self.floor, self.met = k, queries, floor, 0
        self.scores = np.full((n, k), _NONE, np.int64)
        self.ids = np.zeros((n, k), np.int64)

    def worst(self, node: int) -> int:
        return max(self.floor, self.scores[self.queries.start[node] : self.queries.end[node], -1].min())

    def offer(self, node: int, ids: np.ndarray, points: np.ndarray) -> None:
        a, b = self.queries.start[node], self.queries.end[node]
        scores = exact_scores(self.queries.points[a:b], points)
        able = self.queries.ids[a:b, None] != ids[None, :]
        floor = np.maximum(self.scores[a:b, -1], self.floor)
        if len(ids) > self.k:
            kth = np.partition(np.where(able, scores, _NONE), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            floor = np.maximum(floor, kth)
        row, column = np.nonzero(able & (scores >= floor[:, None]))
        if not len(row):
            return
        hit = np.unique(row)
        kept = self.scores[a:b][hit] > _NONE
        old_row = np.repeat(hit, kept.sum(axis=1))
        rows = np.concatenate([old_row, row])
        values = np.concatenate([self.scores[a:b][hit][kept], scores[row, column]])
        names = np.concatenate([self.ids[a:b][hit][kept], ids[column]])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        top = rank < self.k
        self.scores[a + rows[top], rank[top]] = values[top]
        self.ids[a + rows[top], rank[top]] = names[top]


def search(queries: Tree, data: Tree, best: Best) -> int:
    """Offer to best every pair of points that its bound doesn't rule out; the number of node pairs dropped of those met."""
    dropped = 0

    def bounds(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        rq, rp = queries.radius[q], data.radius[p]
        inner = (queries.middle[q] * data.middle[p]).sum(axis=-1)
        spread = queries.norm[q] * rp + data.norm[p] * rq + rq * rp
        return inner + spread + 1e-9 * (queries.norm[q] * data.norm[p] + spread) + 1e-6  # what rounding may have taken

    stack = [(0, 0, float(bounds(np.int64(0), np.int64(0))))]
    while stack:
        q, p, bound = stack.pop()
        best.met += 1
        if bound < best.worst(q):
            dropped += 1
            continue
        q_leaf, p_leaf = queries.leaf(q), data.leaf(p)
        if q_leaf and p_leaf:
            a, b = data.start[p], data.end[p]
            for at in range(a, b, 1024):
                best.offer(q, data.ids[at : min(at + 1024, b)], data.points[at : min(at + 1024, b)])
            continue
        if p_leaf or (not q_leaf and queries.radius[q] * data.norm[p] > data.radius[p] * queries.norm[q]):
            some = np.arange(queries.low[q], queries.high[q])
            each = bounds(some, np.int64(p))
            stack += sorted(((int(c), p, float(x)) for c, x in zip(some, each, strict=True)), key=lambda s: s[2])
        else:
            some = np.arange(data.low[p], data.high[p])
            each = bounds(np.int64(q), some)
            stack += sorted(((q, int(c), float(x)) for c, x in zip(some, each, strict=True)), key=lambda s: s[2])
    return dropped


def _nearest(pivots: dict[int, np.ndarray]):
    """The number of the nearest pivot of a vector's dimension, -1 if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, column = np.asarray(batch.column("dim")), batch.column("v")
            found = np.full(len(dims), -1, np.int32)
            for dim, centres in pivots.items():
                at = np.flatnonzero(dims == dim)
                if len(at) and dim:
                    points = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    with np.errstate(over="ignore", invalid="ignore"):
                        found[at] = np.nan_to_num((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T, nan=0).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "pivot"])

    return run


def _tree_out(part: pa.Table) -> pa.Table:
    """One row with the tree of a block."""
    dim, block = part.column("dim")[0].as_py(), part.column("block")[0].as_py()
    ids = part.column("id").to_numpy()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("v").chunks] or [np.zeros(0)])
    points = np.floor(SCALE * flat.astype(float)).reshape(len(ids), dim)
    if not np.isfinite(points).all():
        raise OverflowError("a scaled component doesn't fit a double")
    order = np.lexsort((*points.T[::-1], ids))
    names = len(np.unique(ids))
    ids, points, nodes = build(ids[order], points[order])
    kind = np.int32 if np.abs(points).max(initial=0) < 1 << 31 else np.float64
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([block], pa.int64()),
            "names": pa.array([names], pa.int32()),
            "centre": pa.array([points[int(nodes[0, 2])]], pa.list_(pa.float64())),
            "radius": pa.array([nodes[0, 3]]),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
            "points": pa.array([points.astype(kind).tobytes()], pa.binary()),
            "nodes": pa.array([nodes.tobytes()], pa.binary()),
        }
    )


def _read(dim: int, ids: bytes, points: bytes, nodes: bytes) -> Tree:
    names = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(points) == 4 * len(names) * dim else np.float64
    return Tree(names, np.frombuffer(points, kind).reshape(len(names), dim).astype(float), np.frombuffer(nodes).reshape(-1, 6))


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, None, None

        def out() -> pa.RecordBatch:
            row, rank = np.nonzero(best.scores > _NONE)
            columns = [pa.array(np.full(len(row), key[1])), *(pa.array(c) for c in (queries.ids[row], best.ids[row, rank], best.scores[row, rank]))]
            return pa.RecordBatch.from_arrays(columns, ["query_block", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                tree = _read(row["dim"], row["ids"], row["points"], row["nodes"])
                if not row["data"]:  # sorted first: the queries that the data trees behind them are for
                    if best is not None:
                        yield out()
                    key, queries = (row["dim"], row["query_block"], row["shard"]), tree
                    best = Best(tree, k, _NONE if row["floor"] is None else row["floor"])
                elif key == (row["dim"], row["query_block"], row["shard"]):
                    search(queries, tree, best)
        if best is not None:
            yield out()

    return run


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """One row per block of about ``size`` of the rows (id, dim, v, pivot)."""
    counts = vectors.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    return (
        vectors.join(counts, ["dim", "pivot"])
        .withColumn("block", F.xxhash64("pivot", part))
        .groupBy("dim", "block")
        .applyInArrow(_tree_out, _TREE)
    )


def block_pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """(dim, query_block, block, inner, bound) of every query block and every data block of its dimension.

    ``bound`` is the best score that centres and radii allow. Rows of the two sides
    are one per block; no tree is read.
    """
    root = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("block", "centre", "radius")]
    both = asked.select("dim", *root("q")).join(data.select("dim", *root("d")), "dim")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q_norm, d_norm = (F.sqrt(dot(f"{p}_centre", f"{p}_centre")) for p in "qd")
    spread = q_norm * F.col("d_radius") + d_norm * F.col("q_radius") + F.col("q_radius") * F.col("d_radius")
    inner = dot("q_centre", "d_centre")
    # what rounding may have taken; a bound that is no number rules nothing out
    bound = inner + spread + 1e-9 * (q_norm * d_norm + spread) + 1e-6
    return both.select(
        "dim", F.col("q_block").alias("query_block"), F.col("d_block").alias("block"), inner.alias("inner"),
        F.when(F.isnan(bound), float("inf")).otherwise(bound).alias("bound"),
    )


def floors(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(dim, query_block, floor): a score that every query of the block has k partners of, or null."""
    of_query = Window.partitionBy("query_block", "query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") == k)
    per = kth.groupBy("query_block").agg(F.count("*").alias("full"), F.min("score").alias("least"))
    return asked.select("dim", F.col("block").alias("query_block"), "names").join(per, "query_block", "left").select(
        "dim", "query_block", F.when(F.col("full") == F.col("names"), F.col("least")).alias("floor")
    )


def _search(asked: DataFrame, data: DataFrame, pairs: DataFrame, shards: int, k: int) -> DataFrame:
    """query_block, query_id, vec_id and score of the search of (dim, query_block, block, bound, floor)."""
    tree = ["ids", "points", "nodes"]
    dealt = pairs.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    keys = ["dim", "query_block", "shard"]
    ask = dealt.select(*keys, "floor").distinct().join(asked.select("dim", F.col("block").alias("query_block"), *tree), ["dim", "query_block"])
    ask = ask.select(*keys, F.lit(False).alias("data"), F.lit(0.0).alias("bound"), "floor", *tree)
    offered = dealt.join(data.select("dim", "block", *tree), ["dim", "block"]).select(*keys, F.lit(True).alias("data"), "bound", "floor", *tree)
    both = ask.unionByName(offered).repartition(*keys).sortWithinPartitions(*keys, "data", F.col("bound").desc())
    return both.mapInArrow(_searched(k), "query_block long, query_id long, vec_id long, score long")


def indexed(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, repeats: bool) -> tuple[DataFrame, DataFrame]:
    """The trees of the queries and of all sound vectors."""
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    marked = vectors.where(sound).select(
        F.col(id_col).cast("long").alias("id"),
        F.size(vector_col).alias("dim"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    if not repeats:
        marked = marked.groupBy("id", "dim").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).select("id", "dim", "v", "asks")
    wanted = min(PIVOTS, -(-marked.count() // BLOCK))
    sample = marked.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    pivots: dict[int, list] = {}
    for dim, v in sample:
        pivots.setdefault(dim, []).append(v)
    def near(rows: DataFrame, most: int) -> DataFrame:
        chosen = {d: np.array(v[:most], float).reshape(-1, d) for d, v in pivots.items()}
        return rows.drop("asks").mapInArrow(_nearest(chosen), "id long, dim int, v array<double>, pivot int")

    asking = marked.where("asks")
    # few queries make few blocks, as every block of theirs meets every data block that isn't ruled out
    few = max(1, 4 * asking.count() // QUERY_BLOCK)
    return stored(trees(near(asking, few), QUERY_BLOCK)), stored(trees(near(marked, PIVOTS), BLOCK))


def first_pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """The closest data block of every query block, without a floor."""
    best = block_pairs(asked, data).groupBy("dim", "query_block").agg(F.max_by(F.struct("block", "bound"), F.struct("inner", "block")).alias("b"))
    return best.select("dim", "query_block", "b.block", "b.bound", F.lit(None).cast("long").alias("floor"))


def other_pairs(asked: DataFrame, data: DataFrame, first: DataFrame, floor: DataFrame) -> DataFrame:
    """The pairs that the floors don't rule out, without those searched first."""
    left = block_pairs(asked, data).join(first.select("dim", "query_block", "block"), ["dim", "query_block", "block"], "left_anti")
    return left.join(floor, ["dim", "query_block"]).where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("inner")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", repeats: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors by inner product of floor(1024 * x).

    Queries are the rows for which ``is_query`` holds; a vector is never its own
    partner. Ties go to the smaller id; fewer partners give fewer rows. Null ids,
    null vectors and vectors with a null or non-finite component take no part;
    vectors of another length than the query's are no partners. With ``repeats``
    each of the rows that share an id is a partner, and a query id has the best
    of all its rows; without, the least vector (component by component) of an id counts. Scores are exact
    for components of any size; one that doesn't fit a long fails the job.
    """
    asked, data = indexed(vectors, is_query, id_col, vector_col, repeats)
    first = first_pairs(asked, data)
    near = stored(_search(asked, data, first, 1, k))
    others = other_pairs(asked, data, first, floors(near, asked, k))
    found = near.unionByName(_search(asked, data, others, -(-data.count() // STREAMED), k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, repeats=True)


ORACLES = {
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
QUERIES = {"op2_exact_top_k": op2_exact_top_k}
