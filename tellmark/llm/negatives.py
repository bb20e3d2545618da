"""Hard negatives by one-dimensional distance keys.

Inner products become distances: with one component more, sqrt(M^2 - |v|^2) for
data and 0 for anchors, M being the largest norm, the squared distance of an
anchor and a vector is |q|^2 + M^2 - 2 score. Every vector has a key: its nearest
sampled pivot and the distance to it. Vectors are stored sorted by key, in blocks
of an interval of keys each.

A search knows an anchor's distance d to every pivot. What lies within r of the
anchor has keys between d - r and d + r (triangle inequality). Rounds of growing r
read the blocks whose intervals that annulus meets and that earlier rounds didn't
read, until the k-th best partner found is within r: then all blocks left are
farther. Positives are such a search among rows of the anchor's label; negatives
are one with a window of scores for each positive, whose annulus starts where the
window's best score would be.

Anchors come in blocks of the same pivot; a task holds one of these and streams
data blocks, nearest first. Only block pairs that an annulus calls for are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.llm.common import stored
from tellmark.llm.topk import exact_scores
from tellmark.session import table

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: A negative's score lies between these percents of the positive's.
LEAST, MOST = 50, 95
#: Rows of a data block and of a block of anchors, sampled pivots at most, data blocks that one task streams, about.
BLOCK, ASKING, PIVOTS, STREAMED = 1024, 256, 64, 64
#: Data blocks that the first annulus is meant to reach, growth of a radius without k partners, rounds after which it is unbounded.
FIRST, GROWTH, ROUNDS = 2, 4.0, 4
_NONE = np.iinfo(np.int64).min
#: Largest square of a norm for which distances are finite; beyond it nothing is ruled out.
_LARGEST = 1e300
_ANY = (-(1 << 63) + 1, (1 << 63) - 1)
_KEYS = ["dim", "asking", "shard"]


@dataclass(frozen=True)
class Pivots:
    """Sampled vectors of one dimension and the largest squared norm of that dimension's vectors."""

    points: np.ndarray
    top: float

    def distances(self, points: np.ndarray, asks: bool) -> np.ndarray:
        """Of every vector, lifted as data or as anchor, to every pivot."""
        lift = lambda x: np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))
        inner = points @ self.points.T
        if asks:
            square = (points**2).sum(axis=1)[:, None] + self.top - 2 * inner
        else:
            square = 2 * (self.top - inner - lift(points)[:, None] * lift(self.points)[None, :])
        return np.sqrt(np.maximum(square, 0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _keyed(pivots: dict[int, Pivots], few: int | None = None):
    """Adds the nearest pivot and the distance to it; for anchors also all distances and the nearest of the first ``few`` pivots.

    Without pivots there is one, and no distance.
    """
    asks = few is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            pivot, near, key = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            every: list[np.ndarray] = [np.zeros(1)] * len(dims)
            for dim, own in pivots.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    apart = own.distances(_vectors(batch.column("v").take(pa.array(at)), dim), asks)
                    pivot[at], key[at], near[at] = apart.argmin(axis=1), apart.min(axis=1), apart[:, :few].argmin(axis=1)
                    for i, row in zip(at, apart, strict=True):
                        every[i] = row
            more = {"pivot": pa.array(pivot)} | ({"near": pa.array(near), "apart": pa.array(every, pa.list_(pa.float64()))} if asks else {"key": pa.array(key)})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return run


def _narrow(points: np.ndarray) -> bytes:
    most = np.abs(points).max(initial=0)
    return points.astype(next((t for t, top in ((np.int16, 1 << 15), (np.int32, 1 << 31)) if most < top), np.float64)).tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(n * dim, 1), np.float64)
    return np.frombuffer(data, kind).reshape(n, dim).astype(float)


_PACKED = "n int, ids binary, labels binary, points binary"


def _columns(part: pa.RecordBatch | pa.Table, dim: int) -> dict[str, object]:
    whole = lambda c: np.asarray(part.column(c)).astype(np.int64).tobytes()
    v = part.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return {"n": part.num_rows, "ids": whole("id"), "labels": whole("label"), "points": _narrow(_vectors(v, dim))}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of at most BLOCK rows of one pivot, sorted by key as they come."""
    for batch in batches:
        dims, pivots, keys = (np.asarray(batch.column(c)) for c in ("dim", "pivot", "key"))
        change = np.flatnonzero((dims[1:] != dims[:-1]) | (pivots[1:] != pivots[:-1])) + 1
        edges = [0, *change, len(dims)]
        rows = []
        for a, b in zip(edges, edges[1:]):
            for at in range(a, b, BLOCK):
                end = min(at + BLOCK, b)
                rows.append({"dim": int(dims[at]), "pivot": int(pivots[at]), "low": keys[at], "high": keys[end - 1]} | _columns(batch.slice(at, end - at), int(dims[at])))
        yield pa.RecordBatch.from_pylist(rows, _ROW)


_ROW = pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "points"))])


@dataclass(frozen=True)
class Index:
    """``blocks`` of data in order of their keys, and ``anchors`` with all their distances to pivots; both are stored tables."""

    blocks: DataFrame
    anchors: DataFrame


def index(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> Index:
    """Keys of all sound vectors; see ``hard_negatives`` for what is left out."""
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(sound).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("asks").alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    marked = stored(one.select("id", "r.label", "r.v", "asks").select("*", F.size("v").alias("dim"), square.alias("square")))
    # a sample of fixed size: least hashes of vectors; it decides which keys vectors have, no result
    count = marked.count()
    sample = marked.select("dim", "v").orderBy(F.xxhash64("v"), "id").limit(max(1, min(PIVOTS, count // BLOCK))).collect()
    tops = {r.dim: r.top for r in marked.where(F.col("dim").isin([r.dim for r in sample] or [0])).groupBy("dim").agg(F.max("square").alias("top")).collect()}
    pivots = {d: Pivots(np.unique(np.array([r.v for r in sample if r.dim == d], float), axis=0), top) for d, top in tops.items() if d and top < _LARGEST}
    kind = "id long, label long, v array<double>, dim int, pivot int"
    keyed = marked.select("id", "label", "v", "dim").mapInArrow(_keyed(pivots), f"{kind}, key double")
    order = ["dim", "pivot", "key", "id"]
    blocks = stored(keyed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, f"dim int, pivot int, low double, high double, {_PACKED}")
    # few anchors make few blocks, as data is sent once for each block whose annulus meets it
    few = max(1, 4 * marked.where("asks").count() // ASKING)
    anchors = stored(marked.where("asks").select("id", "label", "v", "dim").mapInArrow(_keyed(pivots, few), f"{kind}, near int, apart array<double>"))
    parts = anchors.groupBy("dim", "near").agg(F.ceil(F.count("*") / ASKING).alias("parts"))
    top = F.coalesce(*(F.when(F.col("dim") == d, float(p.top)) for d, p in pivots.items()), F.lit(None).cast("double"))
    dealt = anchors.join(parts, ["dim", "near"]).select(
        "dim", F.xxhash64("dim", "near", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("asking"), "id", "label", "v", "pivot", "apart",
        # |q|^2 + M^2; null where distances are unknown
        (F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) + top).alias("both"),
    )
    return Index(stored(blocks.withColumn("block", F.monotonically_increasing_id())), stored(dealt))


def _slack(both: Column) -> Column:
    """What rounding may have taken from or added to a distance."""
    return F.sqrt(both) * 4e-6 + 1e-6


def block_pairs(asks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(dim, asking, block, bound): data blocks that the annulus of some anchor of a block of anchors meets, and how near they can be.

    ``asks`` has dim, asking, apart, both and radius. Intervals of keys meet
    blocks through cells of about one block's width, pivot by pivot.
    """
    spans = blocks.groupBy("dim", "pivot").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("blocks"))
    width = (F.col("most") - F.col("least")) / F.col("blocks")
    spans = spans.withColumn("width", F.when(width > 0, width).otherwise(1.0))
    cell = lambda x: F.floor((x - F.col("least")) / F.col("width"))
    cells = blocks.select("dim", "pivot", "block", "low", "high").join(spans, ["dim", "pivot"])
    cells = cells.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("dim", "pivot", "block", "low", "high", "cell")
    reach = F.col("radius") + F.coalesce(_slack(F.col("both")), F.lit(0.0))
    each = asks.select("dim", "asking", F.posexplode("apart").alias("pivot", "d"), reach.alias("reach"))
    rings = each.groupBy("dim", "asking", "pivot").agg(
        F.min(F.col("d") - F.col("reach")).alias("near"), F.max(F.col("d") + F.col("reach")).alias("far"), F.min("d").alias("d_low"), F.max("d").alias("d_high")
    )
    rings = rings.join(spans, ["dim", "pivot"]).where((F.col("near") <= F.col("most")) & (F.col("far") >= F.col("least")))
    met = F.sequence(cell(F.greatest("near", "least")), cell(F.least("far", "most")))
    rings = rings.select("dim", "pivot", "asking", "near", "far", "d_low", "d_high", F.explode(met).alias("cell"))
    pairs = rings.join(cells, ["dim", "pivot", "cell"]).where((F.col("low") <= F.col("far")) & (F.col("high") >= F.col("near")))
    bound = F.greatest(F.col("low") - F.col("d_high"), F.col("d_low") - F.col("high"), F.lit(0.0))
    return pairs.select("dim", "asking", "block", bound.alias("bound")).distinct()


class Top:
    """The k best partners of every row so far, ties to the smaller id."""

    def __init__(self, rows: int, k: int):
        self.scores, self.ids = np.full((rows, k), _NONE, np.int64), np.zeros((rows, k), np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some rows with all ids; one that is no partner is _NONE."""
        k = self.scores.shape[1]
        floor = np.maximum(self.scores[rows, -1], _NONE + 1)
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        row, column = np.nonzero(scores >= floor[:, None])
        if not len(row):
            return
        hit = rows[np.unique(row)]
        old = self.scores[hit] > _NONE
        at = np.concatenate([np.repeat(hit, old.sum(axis=1)), rows[row]])
        value = np.concatenate([self.scores[hit][old], scores[row, column]])
        name = np.concatenate([self.ids[hit][old], ids[column]])
        order = np.lexsort((name, -value, at))
        at, value, name = at[order], value[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        kept = rank < k
        self.scores[at[kept], rank[kept]], self.ids[at[kept], rank[kept]] = value[kept], name[kept]


class Asking:
    """A block of anchors in a task: their vectors, how far they have searched, and the windows that are open."""

    def __init__(self, row: dict, k: int, same: bool):
        self.n, self.same = row["n"], same
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.points = _wide(row["points"], self.n, row["dim"])
        self.apart = np.frombuffer(row["apart"]).reshape(self.n, -1)
        self.before, self.radius, self.both = np.frombuffer(row["reach"]).reshape(3, -1)
        self.anchor, self.slot, self.least, self.most = np.frombuffer(row["windows"], np.int64).reshape(4, -1)
        self.top = Top(len(self.anchor), k)
        self.slack = np.nan_to_num(np.sqrt(self.both), nan=0.0) * 4e-6 + 1e-6

    def meet(self, row: dict) -> None:
        """Score the anchors whose annulus reaches this block now and didn't before, unless the block can't better what they have."""
        d = self.apart[:, row["pivot"]]
        near = np.maximum(np.maximum(row["low"] - d, d - row["high"]), 0) - self.slack
        with np.errstate(invalid="ignore"):
            best = np.nan_to_num((self.both - np.maximum(near, 0) ** 2) / 2, nan=np.inf) + 1e-6 * np.nan_to_num(self.both, nan=0.0) + 1
            worst = np.nan_to_num((self.both - (d + row["high"] + self.slack) ** 2) / 2, nan=-np.inf) - 1e-6 * np.nan_to_num(self.both, nan=0.0) - 1
        fits = (best[self.anchor] >= np.maximum(self.least, self.top.scores[:, -1])) & (worst[self.anchor] <= self.most)
        reached = (near <= self.radius) & (near > self.before)
        windows = np.flatnonzero(fits & reached[self.anchor])
        if not len(windows):
            return
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        some, at = np.unique(self.anchor[windows], return_inverse=True)
        scores = exact_scores(self.points[some], _wide(row["points"], row["n"], row["dim"]))
        able = ((self.labels[some, None] == labels[None, :]) == self.same) & (self.ids[some, None] != ids[None, :])
        scores = np.where(able, scores, _NONE)[at]
        inside = (scores >= self.least[windows, None]) & (scores <= self.most[windows, None])
        self.top.offer(windows, np.where(inside, scores, _NONE), ids)

    def found(self) -> pa.RecordBatch:
        row, rank = np.nonzero(self.top.scores > _NONE)
        columns = (self.ids[self.anchor[row]], self.slot[row], self.top.ids[row, rank], self.top.scores[row, rank])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "slot", "vec_id", "score"])


def _packed_anchors(part: pa.Table) -> pa.Table:
    """One row per block of anchors; windows by anchor number."""
    dim = part.column("dim")[0].as_py()
    floats = lambda c: np.asarray(part.column(c)).astype(float)
    windows = part.column("windows").combine_chunks()
    inner = windows.flatten()
    owner = np.repeat(np.arange(part.num_rows), np.asarray(windows.value_lengths()))
    columns = _columns(part, dim) | {
        "dim": dim,
        "asking": part.column("asking")[0].as_py(),
        "apart": np.concatenate([np.asarray(x.values) for x in part.column("apart")]).astype(float).tobytes(),
        "reach": np.concatenate([floats(c) for c in ("before", "radius", "both")]).tobytes(),
        "windows": np.concatenate([owner, *(np.asarray(inner.field(c)).astype(np.int64) for c in ("slot", "least", "most"))]).astype(np.int64).tobytes(),
    }
    return pa.Table.from_pylist([columns], _ASKED)


_ASKED = pa.schema([("dim", pa.int32()), ("asking", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "points", "apart", "reach", "windows"))])


def _searched(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                at = tuple(row[c] for c in _KEYS)
                if not row["data"]:  # sorted first: the anchors that the data blocks behind them are for
                    if asking is not None:
                        yield asking.found()
                    key, asking = at, Asking(row, k, same)
                elif at == key:
                    asking.meet(row)
        if asking is not None:
            yield asking.found()

    return run


def _scan(asks: DataFrame, blocks: DataFrame, shards: int, k: int, same: bool) -> DataFrame:
    """id, slot, vec_id and score: the best of each window among the blocks its annulus reaches in this round."""
    dealt = block_pairs(asks, blocks).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    kinds = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long' if f.type == pa.int64() else 'int'}" for f in _ASKED)
    packed = asks.groupBy("dim", "asking").applyInArrow(_packed_anchors, kinds)
    own = ["n", "ids", "labels", "points"]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    ask = dealt.select(*_KEYS).distinct().join(packed, ["dim", "asking"]).select(
        *_KEYS, F.lit(False).alias("data"), F.lit(0.0).alias("bound"), *own, "apart", "reach", "windows", *none("int", "pivot"), *none("double", "low", "high")
    )
    data = dealt.join(blocks, ["dim", "block"]).select(
        *_KEYS, F.lit(True).alias("data"), "bound", *own, *none("binary", "apart", "reach", "windows"), "pivot", "low", "high"
    )
    both = ask.unionByName(data).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "data", "bound")
    return both.mapInArrow(_searched(k, same), "id long, slot long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(made: Index, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """id, slot, vec_id, score and rank: the k best partners of every window, by rounds of growing annuli.

    ``windows`` has id (an anchor), slot, least and most (scores, inclusive).
    Partners share the anchor's label (``same``) or have another one; an anchor is
    never its own partner.
    """
    shards = -(-made.blocks.count() // STREAMED)
    of_pivot = made.blocks.groupBy("dim", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("blocks"))
    own = made.anchors.select("id", "dim", "pivot", "both", F.array_min("apart").alias("d")).join(of_pivot, ["dim", "pivot"], "left")
    square = lambda score: F.col("both") - 2 * score.cast("double")
    apart = lambda score: F.when(square(score).isNotNull(), F.sqrt(F.greatest(square(score), F.lit(0.0))))
    beyond = F.lit(float("inf"))
    # the first annulus is about FIRST blocks wide, behind the nearest block of the pivot and the distance of the window's best score
    wide = F.coalesce((F.col("high") - F.col("low")) / F.col("blocks") * FIRST, F.lit(0.0)) + F.sqrt("both") * 1e-3
    begin = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0), F.when(F.col("most") < _ANY[1], apart(F.col("most"))))
    open_ = windows.join(own, "id").select("id", "slot", "least", "most", (-beyond).alias("before"), F.coalesce(begin + wide, beyond).alias("radius"), "both")
    found, left, of_round = None, stored(open_), 0
    while not left.isEmpty():
        of_anchor = left.groupBy("id").agg(
            F.max("before").alias("before"), F.max("radius").alias("radius"), F.array_sort(F.collect_list(F.struct("slot", "least", "most"))).alias("windows")
        )
        asks = stored(made.anchors.drop("pivot").join(of_anchor, "id"))
        hits = _scan(asks, made.blocks, shards, k, same)
        found = stored(_ranked(hits if found is None else found.drop("rank").unionByName(hits), k))
        kth = found.where(F.col("rank") == k).select("id", "slot", "score")
        of_round += 1
        searched = left.drop("radius", "before").join(of_anchor.select("id", "radius"), "id").join(kth, ["id", "slot"], "left")
        done = (F.col("radius") == beyond) | (F.col("radius") >= apart(F.col("score"))) | ((F.col("least") > _ANY[0]) & (F.col("radius") >= apart(F.col("least"))))
        grown = F.when(F.col("score").isNotNull(), apart(F.col("score")) + _slack(F.col("both"))).otherwise(F.col("radius") * GROWTH)
        further = beyond if of_round >= ROUNDS else F.coalesce(grown, beyond)
        left = stored(
            searched.where(~F.coalesce(done, F.lit(False))).select("id", "slot", "least", "most", F.col("radius").alias("before"), further.alias("radius"), "both")
        )
    return found if found is not None else made.anchors.sparkSession.createDataFrame([], "id long, slot long, vec_id long, score long, rank int")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Scores are inner products of floor(``scale`` * x). An anchor's positives are
    its best other rows of the same label; negatives of an anchor and a positive
    are the best rows of other labels that score between ``least`` and ``most``
    percent of the positive. Ties go to the smaller id; fewer partners give fewer
    rows, and a pair without a negative none. Null ids, labels and vectors, and
    vectors with a null or non-finite component take no part; vectors of another
    length are no partners. Of rows that share an id the one with the least label,
    then vector, counts. Scores are exact; one beyond 64 bits fails the job.
    Other columns are not carried. Empty in, empty out.
    """
    made = index(vectors, is_anchor, id_col, vector_col, label_col, scale)
    whole = made.anchors.select("id", F.lit(0).cast("long").alias("slot"), F.lit(_ANY[0]).alias("least"), F.lit(_ANY[1]).alias("most"))
    good = nearest(made, whole, positives, True).select("id", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    good = stored(good)
    # of a negative score no smaller part is left; the percents are of whole numbers, without overflow
    parts = lambda percent: [F.expr(f"positive_score div 100 * {percent}"), F.expr(f"positive_score % 100 * {percent}")]
    low = parts(least)[0] + F.ceil(parts(least)[1] / 100)
    high = parts(most)[0] + F.floor(parts(most)[1] / 100)
    windows = good.where("positive_score >= 0").select("id", "slot", low.alias("least"), high.alias("most")).where("least <= most")
    bad = nearest(made, windows, negatives, False)
    return bad.join(good, ["id", "slot"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector; every seventh label is one off."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLES = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, d.vec_id AS b, q.label = d.label AS same, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
