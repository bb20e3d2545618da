"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words by its weight; a document's expected number
of copies is its source's target over its source's size. The whole part is
taken, the fraction rounded dependently: two documents' fractions are paired and
word mass moves between them at random until one is integral, in a direction
that keeps both expectations. A move keeps the words of the pair exactly, so a
source misses its target by less than its last unresolved document. Hashed
groups of bounded size are resolved first, what they leave over meets in a tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.llm.common import cut, word_count
from tellmark.operators.distributions import global_rank
from tellmark.session import table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents that one task of the tree resolves, about.
FAN_IN = 4096
_UNITS = "id {kind}, source string, size long, hash long, nth_row long, source_size long, target double, nth int, copies long, fraction double, salt long, settled boolean"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Of (source, size, rows), rows being how many rows have that size: source, nth, source_size, units and target of every source.

    Sources by code point, null last, take ``weights`` in turn. All sizes
    together are shared out; a target stops at ``max_repeats`` times its source
    and the excess is shared anew by weight. Sources are ranked in ranges and the
    common level is found by sums over all of them, so they may be as many as
    hosts; every round of sums closes the sources that are full at its level.
    """
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("units")
    )
    per = global_rank(per, [F.col("source").asc_nulls_last()], "nth").withColumn("nth", F.col("nth") - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("nth") % len(weights) + 1))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    per = cut(per.withColumn("cap", cap).withColumn("fills_at", cap / F.col("w")))
    level, closed = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("fills_at") < level
        total, taken, open_weight, now = per.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("w"))), F.count_if(full)
        ).first()
        if now == closed:
            break
        closed, level = now, (total - taken) / open_weight if open_weight else 0.0
    return per.withColumn("target", F.least("cap", F.col("w") * level)).select("source", "nth", "source_size", "units", "target")


def pivot(mass: np.ndarray, fraction: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Resolve fractions pair by pair: whether each rounds up, the fractions left, and the place of the open one or -1."""
    draws = np.random.default_rng(seed).random(len(mass))
    left, open_at = fraction.tolist(), -1
    mass = mass.tolist()
    done = lambda p: p < 1e-9 or p > 1 - 1e-9
    for j in range(len(mass)):
        if done(left[j]):
            left[j] = round(left[j])
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        gain = min((1 - left[i]) * mass[i], left[j] * mass[j])  # from j to i
        loss = min(left[i] * mass[i], (1 - left[j]) * mass[j])  # from i to j
        move = gain if draws[j] * (gain + loss) < loss else -loss
        left[i] += move / mass[i]
        left[j] -= move / mass[j]
        still = [k for k in (i, j) if not done(left[k])]
        for k in (i, j):
            if k not in still:
                left[k] = round(left[k])
        open_at = still[0] if still else -1
    out = np.array(left, float)
    up = out > 0.5
    if open_at >= 0:
        up[open_at] = False
    return up, out, open_at


def _resolve(seed: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "tie", "hash", "nth_row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        key = [seed, int(part["nth"].iloc[0]), int(part["salt"].iloc[0])]
        up, left, open_at = pivot(part["size"].to_numpy(float), part["fraction"].to_numpy(), key)
        settled = np.ones(len(part), bool)
        if open_at >= 0 and not last:
            settled[open_at] = False
            part.loc[open_at, "fraction"] = left[open_at]
        elif open_at >= 0:
            up[open_at] = np.random.default_rng([*key, 1]).random() < left[open_at]
        part["copies"] += up
        part["settled"] = settled
        return part.drop(columns="tie")

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """One row per row of docs: id, source, size, hash, nth_row, source_size, target and copies (0 to ``max_repeats``).

    ``size`` is the number of words (null text: 0). Every row is a unit of its own
    with its own draw, also among rows without an id and repeated rows: ``hash`` is
    of the text, and rows that agree in it, too, are numbered by ``nth_row``. A null
    source is a source. A document without words gets the whole part of its
    expected copies. Draws depend on ids, sizes, texts and ``seed`` only: reruns
    agree. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col).cast("string")).alias("size"),
            F.xxhash64(F.col(text_col).cast("string")).alias("hash"),
        )
        .groupBy("id", "source", "size", "hash")
        .agg(F.count("*").alias("rows"))
    )
    per = targets(sizes, weights, max_repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    tie = F.xxhash64("id", "size", "hash", "nth_row", F.lit(seed))
    each = sizes.withColumn("nth_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")
    joined = (
        each.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.floor(ratio).cast("long"))
        .withColumn("fraction", F.when((F.col("size") > 0), ratio - F.floor(ratio)).otherwise(0.0))
        .withColumn("salt", F.pmod(tie, F.ceil(F.col("units") / FAN_IN)).cast("long"))
        .withColumn("settled", F.col("fraction") < 1e-9)
    )
    schema = _UNITS.format(kind=kind)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    start = joined.select(*names)
    out = start.where("settled")
    level, rest = 0, start.where("NOT settled")
    groups = (per.agg(F.max("units")).first()[0] or 0) / FAN_IN
    while True:
        last = groups <= 1
        rest = rest.withColumn("tie", tie).groupBy("nth", "salt").applyInPandas(_resolve(seed + level, last), schema)
        rest = cut(rest)
        out = out.unionByName(rest.where("settled"))
        if last:
            break
        groups = -(-groups // FAN_IN)
        rest = rest.where("NOT settled").withColumn("salt", (F.col("salt") / FAN_IN).cast("long"))
        level += 1
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "hash", "nth_row", "source_size", "target", "copies")


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it; columns are kept as they are, whatever their names.

    Nulls and repeated rows are units as in ``mix``. Of rows that agree in id,
    source and text some may be taken once more than others; which of them is left
    open, as their texts are equal. Empty in, empty out.
    """
    units = mix(docs, id_col, source_col, text_col, **options)
    of = [F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.col("size").alias("_n"), F.col("hash").alias("_h")]
    chosen = units.groupBy(*of).agg(F.sum("copies").alias("_taken"), F.count("*").alias("_rows")).where("_taken > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: F.col(names[docs.columns.index(c)]) for c in (id_col, source_col, text_col)}
    text = at[text_col].cast("string")
    same = (
        at[id_col].eqNullSafe(F.col("_i"))
        & at[source_col].cast("string").eqNullSafe(F.col("_s"))
        & (word_count(text) == F.col("_n"))
        & (F.xxhash64(text) == F.col("_h"))
    )
    found = plain.join(chosen, same)
    single = found.where("_rows = 1").withColumn("_copies", F.col("_taken"))
    # equal rows are numbered in the partitions they are in, so that many of them don't meet in one task
    equal = cut(found.where("_rows > 1").withColumn("_part", F.spark_partition_id()))
    group = ["_i", "_s", "_n", "_h"]
    sizes = equal.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(F.struct(*group, "_part").alias("_key"), "_before")
    numbered = equal.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*names[:1])))
    numbered = numbered.join(sizes, F.struct(*group, "_part").eqNullSafe(F.col("_key"))).withColumn("_nth", F.col("_nth") + F.col("_before"))
    spread = F.expr("_taken div _rows") + F.when(F.col("_nth") <= F.col("_taken") % F.col("_rows"), 1).otherwise(0)
    both = single.select(*names, "_copies").unionByName(numbered.withColumn("_copies", spread).where("_copies > 0").select(*names, "_copies"))
    return both.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*names).toDF(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


QUERIES = {"op6_source_mixing": op6_source_mixing}
ORACLES: dict[str, str] = {}
