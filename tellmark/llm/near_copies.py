"""N-gram Jaccard join: MinHash buckets, Bayesian pruning of candidates, exact verification.

Documents are compared by their sets of five-word shingles. Equal texts are one
class from the start. MinHash bands bring candidates together; the MinHash values
of a pair are then compared a few at a time, and the pair is dropped once the
posterior probability that its similarity reaches the threshold is below a
tolerance. What is left connects texts into candidate groups, whose shingle sets
are fetched once, and every pair inside a group is verified exactly.

A text's name is a 64-bit hash of its words; a second one tells whether two texts
share a name, and such texts get another name made of both hashes.

No step emits the pairs of a group: tasks give one row per text, with its number
of links and the root of its tree of links. Large buckets and groups are split
into blocks, and each pair of blocks is a task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.common import cut, stored
from tellmark.llm.components import components
from tellmark.llm.ragged import Texts, mix, slices, stream, windows
from tellmark.session import table

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with probability 3e-6.
BAND_ROWS, BANDS = 5, 32
#: MinHash values compared at a time, and the posterior below which a pair goes.
STEP, TOLERANCE = 32, 1e-6
BLOCK = 256
#: Blocks of texts that one block of signatures stands for.
WIDE = 4
_BASE = 0x9E6C63D0876A9A35


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes text after text, each one's text, and two hashes of every text's word sequence."""
    starts, ends, owner = texts.words()
    codes = texts.hashes(starts, ends, 1)
    hashes, at = windows(codes, owner, SHINGLE, _BASE)
    own = owner[at]
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    if len(hashes):
        once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])])
        hashes, own = hashes[once], own[once]
    n = len(texts)
    first = np.searchsorted(owner, np.arange(n))
    count = np.searchsorted(owner, np.arange(n), side="right") - first
    place = np.arange(len(codes)) - np.repeat(first, count)
    longest = int(count.max()) if n else 0
    whole = []
    for seed in (21, 22):
        factors = stream(longest, seed) | np.uint64(1)
        total = np.zeros(n, np.uint64)
        full = count > 0
        if full.any():
            total[full] = np.add.reduceat(mix(codes ^ np.uint64(seed)) * factors[place], first[full])
        whole.append(mix(total + count.astype(np.uint64)).view(np.int64))
    return hashes, own, whole[0], whole[1]


def _texts_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            _, _, t, t2 = shingles(Texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("nul"), pa.array(t), pa.array(t2)], ["k", "nul", "t", "t2"])


def _sketches_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = stream(BAND_ROWS * BANDS, 31) | np.uint64(1)
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, own, t, t2 = shingles(Texts(part.column("text")))
            who, first, count = np.unique(own, return_index=True, return_counts=True)
            signature = np.zeros((len(who), len(factors)), np.uint32)
            if len(who):
                for k, factor in enumerate(factors):
                    # the product's low bits are weak, its high ones are what is compared
                    signature[:, k] = np.minimum.reduceat(hashes * factor, first) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("k").take(pa.array(who)),
                    part.column("nul").take(pa.array(who)),
                    pa.array(t[who]),
                    pa.array(t2[who]),
                    pa.array(count.astype(np.int32)),
                    pa.array([row.tobytes() for row in signature], pa.binary()),
                ],
                ["k", "nul", "t", "t2", "size", "signature"],
            )


def _bands_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = stream(BANDS, 41)
    factors = stream(BAND_ROWS, 43) | np.uint64(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = _matrix(batch.column("signature")).astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
        keys = mix((signature * factors).sum(axis=2, dtype=np.uint64) ^ salt)
        t = np.repeat(np.asarray(batch.column("t")), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(t)], ["key", "t"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * BAND_ROWS)


@cache
def least_matches(n: int, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among n at which the similarity, uniform before, still reaches the threshold with that probability."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


class Forest:
    """Union-find over 0..n-1; the least member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def candidate_pairs(signature: np.ndarray, size: np.ndarray, cross: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that no step of the incremental comparison drops; cross: the two sides to pair, else all pairs."""
    if cross is None:
        a, b = np.triu_indices(len(size), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(*cross, indexing="ij"))
    fits = np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[fits], b[fits]
    same = np.zeros(len(a), np.int64)
    for k in range(0, signature.shape[1], STEP):
        part = signature[:, k : k + STEP]
        for j in range(0, len(a), 65536):
            same[j : j + 65536] += (part[a[j : j + 65536]] == part[b[j : j + 65536]]).sum(axis=1)
        stay = same >= least_matches(min(k + STEP, signature.shape[1]))
        a, b, same = a[stay], b[stay], same[stay]
    return a, b


def similar_pairs(sets: list[np.ndarray], cross: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of Jaccard similarity of at least the threshold, exactly, by products of the incidence matrix."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    terms, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n))
    width = 4096
    total = int(shared.sum())
    bounds = np.searchsorted(column, np.arange(0, total + width, width))
    for k, (x, y) in enumerate(pairwise(bounds)):
        incidence = np.zeros((n, min(width, total - k * width)), np.float32)
        incidence[owner[x:y], column[x:y] - k * width] = 1
        common += incidence @ incidence.T
    similar = common * (1 + SIMILARITY) >= SIMILARITY * (size[:, None] + size[None, :]) - 1e-9
    if cross is None:
        return np.nonzero(np.triu(similar, 1))
    a, b = np.nonzero(similar[np.ix_(*cross)])
    return cross[0][a], cross[1][b]


def _groups(batches: Iterator[pa.RecordBatch], values: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal (key, low, high) of sorted rows, each with the columns of values."""
    bucket, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", *values)]
        for key, low, high, *row in zip(*columns, strict=True):
            if (key, low, high) != bucket:
                if len(rows) > 1:
                    yield bucket, rows
                bucket, rows = (key, low, high), []
            rows.append(row)
    if len(rows) > 1:
        yield bucket, rows


def _sides(low: int, high: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    return None if low == high else (np.flatnonzero(side == low), np.flatnonzero(side == high))


def _edges_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for (_, low, high), rows in _groups(batches, ["t", "side", "size", "signature"]):
        t, side, size, signature = zip(*rows, strict=True)
        matrix = np.frombuffer(b"".join(signature), np.uint32).reshape(len(t), -1)
        a, b = candidate_pairs(matrix, np.array(size), _sides(low, high, np.array(side)))
        forest = Forest(len(t))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(i, j)
        for i in np.unique(np.concatenate([a, b])).tolist():
            u.append(t[i])
            v.append(t[forest.root(i)])
        if len(u) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _links_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, low, high, t, links, roots in _verified(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(t, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64()), pa.array([low != high] * len(t), pa.bool_())],
            ["t", "n_links", "root", "crosses"],
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (key, low, high), rows in _groups(batches, ["t", "side", "shingles"]):
        t, side, sets = zip(*rows, strict=True)
        a, b = similar_pairs([np.frombuffer(x, np.uint64) for x in sets], _sides(low, high, np.array(side)))
        links = np.bincount(a, minlength=len(t)) + np.bincount(b, minlength=len(t))
        forest = Forest(len(t))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(i, j)
        some = np.flatnonzero(links).tolist()
        yield key, low, high, [t[i] for i in some], links[some], [t[forest.root(i)] for i in some]


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, own, t, t2 = shingles(Texts(part.column("text")))
            bounds = np.searchsorted(own, np.arange(len(t) + 1))
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(t2), pa.array(sets, pa.binary())], ["t", "t2", "shingles"])


def in_blocks(members: DataFrame, size: int | None = None) -> DataFrame:
    """Rows (key, t, n) once for every pair of blocks of about ``size`` rows (``BLOCK``) that theirs is in; n is the number of rows of the key."""
    blocks = F.ceil(F.col("n") / (size or BLOCK)).cast("int")
    return (
        members.withColumn("side", F.pmod(F.xxhash64("t"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("side", "with"))
        .withColumn("high", F.greatest("side", "with"))
        .drop("with")
    )


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a pair of blocks together, by t, so that the trees of all blocks of a group hang on few roots."""
    return df.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "t")


def _key(id_col: Column, text: Column) -> list[Column]:
    """A document's key: its id, or a hash of its text and that it has no id."""
    number = id_col.cast("long")
    return [F.coalesce(number, F.xxhash64(text.cast("string"))).alias("k"), number.isNull().alias("nul")]


def _named(df: DataFrame, clashing: list[int]) -> DataFrame:
    """t replaced where several texts have it; almost always none do."""
    return df.withColumn("t", F.when(F.col("t").isin(clashing), F.xxhash64("t", "t2")).otherwise(F.col("t"))) if clashing else df


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: k, nul, t, t2 (raw hashes), least (nul, k of its class), n_copies and n_links."""
    text = F.col(text_col).cast("string")
    slim = docs.select(*_key(F.col(id_col), text), text.alias("text"))
    raw = stored(slim.mapInArrow(_texts_out, "k long, nul boolean, t long, t2 long"))
    clashing = [r.t for r in raw.groupBy("t").agg(F.min("t2").alias("a"), F.max("t2").alias("b")).where("a <> b").select("t").collect()]
    texts = _named(raw.withColumns({"h": F.col("t"), "h2": F.col("t2")}), clashing)
    first = texts.groupBy("t").agg(F.min(F.struct("nul", "k")).alias("f")).select("t", "f.nul", "f.k")
    sketches = _named(slim.mapInArrow(_sketches_out, "k long, nul boolean, t long, t2 long, size int, signature binary"), clashing)
    sketches = stored(sketches.join(first, ["t", "nul", "k"], "left_semi").select("t", "size", "signature"))
    bands = sketches.select("t", "signature").mapInArrow(_bands_out, "key long, t long")
    buckets = (
        bands.groupBy("key")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("t")).alias("x"), F.min("t").alias("m"))
        .where("n > 1")
        .groupBy("n", "x", "m")  # the same texts meet in many bands: once is enough
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    # signatures are short, and a group of near copies meets in every band: wide blocks send each of them less often
    candidates = in_blocks(bands.join(buckets, "key"), WIDE * BLOCK).join(sketches, "t")
    edges = _dealt(candidates).mapInArrow(_edges_out, "u long, v long")
    groups = components(edges).select(F.col("node").alias("t"), F.col("label").alias("key"))
    members = cut(groups.join(groups.groupBy("key").agg(F.count("*").alias("n")), "key"))
    wanted = members.join(first, "t").select("k", "nul").distinct()
    sets = _named(slim.join(wanted, ["k", "nul"], "left_semi").select("text").mapInArrow(_shingles_of, "t long, t2 long, shingles binary"), clashing)
    sets = sets.groupBy("t").agg(F.max("shingles").alias("shingles"))
    links = cut(
        _dealt(in_blocks(members).join(sets, "t")).mapInArrow(_links_out, "t long, n_links long, root long, crosses boolean")
    )
    counts = links.groupBy("t").agg(F.sum("n_links").alias("n_links"))
    labels = components(links.select(F.col("t").alias("u"), F.col("root").alias("v")))
    # one row per text: copies of a hot text meet no one else's
    copies = texts.groupBy("t").agg(F.count("*").alias("n_copies"))
    known = (
        copies.join(labels.withColumnRenamed("node", "t"), "t", "left")
        .join(counts, "t", "left")
        .join(first, "t")
        .select("t", "n_copies", F.coalesce("label", "t").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "nul", "k")
    )
    least = known.groupBy("label").agg(F.min(F.struct("nul", "k")).alias("least"))
    return texts.join(known.join(least, "label").select("t", "least", "n_copies", "n_links"), "t")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, t, class_id, n_copies and n_links.

    ``t`` is a hash of the text's words; ``n_copies`` counts the rows with the
    same words, ``n_links`` the different texts of similarity 0.8 or more.
    ``class_id`` is the least id of all rows that copies and links connect, null
    if none of them has an id. Texts of fewer than five words, null and empty ones
    included, have no shingles and only copies. Ids must be castable to long; a
    null id counts as the largest. Other columns are not carried. Empty in, empty out.
    """
    known = lambda nul, k, name: F.when(~F.col(nul), F.col(k)).alias(name)
    return _classes(docs, id_col, text_col).select(
        known("nul", "k", id_col), "t", known("least.nul", "least.k", "class_id"), "n_copies", "n_links"
    )


def _unwanted(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                stay = [x is None for x in part.column("_t").to_pylist()]
                hit = [i for i, ok in enumerate(stay) if not ok]
                if hit:
                    _, _, t, t2 = shingles(Texts(part.column(text).take(pa.array(hit))))
                    for i, *mine in zip(hit, t.tolist(), t2.tolist(), strict=True):
                        stay[i] = mine not in [[x["h"], x["h2"]] for x in part.column("_t")[i].as_py()]
                yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))

    return run


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class, with all their columns; repeated rows of that id stay."""
    found = _classes(docs, id_col, text_col)
    later = ~F.col("least.nul") & (F.col("nul") | (F.col("k") > F.col("least.k")))
    losers = found.where(later).groupBy(F.col("k").alias("_k"), F.col("nul").alias("_nul")).agg(F.collect_set(F.struct("h", "h2")).alias("_t"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, none = _key(*(F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)))
    plain = plain.withColumn("_k", key).withColumn("_nul", none)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    joined = plain.join(losers, ["_k", "_nul"], "left").select(*names, "_t")
    return joined.mapInArrow(_unwanted(names[docs.columns.index(text_col)]), schema).toDF(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies(docs).select("doc_id", "class_id", "n_copies", "n_links")


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLES = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS t FROM w), u AS (SELECT t, any_value(w) AS w, count(*) AS n, min(doc_id) AS least FROM d GROUP BY 1),
p AS (SELECT t, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM u),
x AS (SELECT t, CASE WHEN count(*) OVER r = 5 THEN array_to_string(list(word) OVER r, ' ') END AS k FROM p WINDOW r AS (PARTITION BY t ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
g AS (SELECT DISTINCT t, md5(k) AS k FROM x WHERE k IS NOT NULL), z AS (SELECT t, count(*) AS size FROM g GROUP BY 1),
b AS (SELECT a.t AS a, c.t AS c, count(*) AS shared FROM g a JOIN g c ON a.k = c.k AND a.t < c.t GROUP BY 1, 2),
l AS (SELECT a, c FROM b JOIN z za ON za.t = a JOIN z zc ON zc.t = c WHERE 10 * shared >= 8 * (za.size + zc.size - shared)),
e AS (SELECT a, c FROM l UNION ALL SELECT c, a FROM l),
r AS (SELECT t, t AS o FROM u UNION SELECT r.t, e.c FROM r JOIN e ON e.a = r.o),
c AS (SELECT r.t, min(u.least) AS class_id FROM r JOIN u ON u.t = r.o GROUP BY 1), n AS (SELECT a AS t, count(*) AS links FROM e GROUP BY 1)
SELECT d.doc_id, class_id, CAST(u.n AS BIGINT) AS n_copies, CAST(coalesce(links, 0) AS BIGINT) AS n_links FROM d JOIN u USING (t) JOIN c USING (t) LEFT JOIN n USING (t)"""
}
