"""Substring dedup: fixed-length word windows that an earlier document has too are removed.

Every window of ``size`` consecutive words gets a Rabin-Karp hash. The hashes
are dealt out by a second hash, so that equal windows meet in one group, where
those with more than one document are found. Windows of every document but the
one with the smallest id merge into maximal removal intervals.

Shuffle: a window costs eight bytes and a document's id is written once per
group and slice of text, not once per window. A group holds about
``WINDOWS_PER_GROUP`` different windows at any input size, as the number of groups
follows the size of the text. Of a window that several documents of a task hold,
only the least is sent to the group, the others are known to lose it: a hot
window costs its group a few rows per task, not one per document.

A window's identity is a 64-bit hash and its group, which a second hash deals out
(2 to 64 plus log2(groups) bits); the words are not compared again. Two different
windows among n are taken for one with a chance of about n * n / 2 / 2**64 / groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.ragged import Texts, mix, slices, spans, windows
from tellmark.session import table

SIZE = 13
WINDOWS_PER_GROUP = 2_000_000
#: Bytes of text that a task works on at once.
SLICE = 1 << 20
#: Windows that a task remembers as held by several documents; forgetting one costs a row, nothing else.
REMEMBERED = 1 << 18
_BASE, _OTHER_BASE = 0x5851F42D4C957F2D, 0x2C7F9B51E3A4D687
_MOST = np.iinfo(np.int64).max
_PACKED = "docs binary, counts binary, hashes binary"


def _hashed(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, owner = texts.words()
    codes = texts.hashes(starts, ends, 1)
    hashes, at = windows(codes, owner, size, _BASE)
    return starts, ends, owner, hashes, at, owner[at] if len(at) else np.zeros(0, np.int64)


class Remembered:
    """Hashes of windows that several documents hold, and the least of those seen so far."""

    def __init__(self):
        self.hashes, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its least document."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.least[at]

    def learn(self, hashes: np.ndarray, least: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) <= REMEMBERED:
            hashes, least = np.concatenate([self.hashes, hashes]), np.concatenate([self.least, least])
        order = np.argsort(hashes, kind="stable")
        hashes, least = hashes[order], least[order]
        first = _first_of_runs(hashes)
        self.hashes = hashes[first]
        self.least = np.minimum.reduceat(least, first) if len(first) else least


def _windows_out(size: int, groups: int, shards: int):
    """Rows of windows by group; those that a smaller document is known to hold by -1 - shard of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = Texts(part.column("text"))
                starts, ends, owner = texts.words()
                codes, others = texts.several_hashes(starts, ends, 1, 7)
                hashes, at = windows(codes, owner, size, _BASE)
                if not len(hashes):
                    continue
                second, _ = windows(others, owner, size, _OTHER_BASE)
                own = owner[at]
                doc = np.asarray(part.column("k"))[own]
                none = part.column("nul").to_numpy(zero_copy_only=False).astype(bool)[own]
                order = np.lexsort((doc, none, hashes))
                hashes, second, doc, none = hashes[order], second[order], doc[order], none[order]
                once = _first_of_runs(hashes, none, doc)  # a window counts once in a document
                hashes, second, doc, none = hashes[once], second[once], doc[once], none[once]
                first = _first_of_runs(hashes)
                count = np.diff(np.append(first, len(hashes)))
                leads = np.zeros(len(hashes), bool)
                leads[first] = True
                seen, least = known.find(hashes[first])
                seen_by, least_by = np.repeat(seen, count), np.repeat(least, count)
                late = (np.repeat(~none[first], count) & ~leads) | (seen_by & (none | (doc > least_by)))
                sent = ~late & ~(seen_by & ~none & (doc == least_by))
                many = ~none[first] & (seen | (count > 1))
                known.learn(hashes[first][many], np.where(seen, np.minimum(least, doc[first]), doc[first])[many])
                key = np.where(late, -1 - _shard(doc, shards), (second % np.uint64(groups)).astype(np.int64))
                keep = late | sent
                yield pa.RecordBatch.from_arrays(_pack(key[keep], none[keep], doc[keep], hashes[keep]), ["grp", "nul", "docs", "counts", "hashes"])

    return run


def _shard(doc: np.ndarray, shards: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _pack(key: np.ndarray, none: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
    """One row per (key, none): its documents, how many windows each has, and their hashes."""
    order = np.lexsort((doc, none, key))
    key, none, doc, hashes = key[order], none[order], doc[order], hashes[order]
    runs = _first_of_runs(key, none, doc)
    counts = np.diff(np.append(runs, len(doc))).astype(np.uint32)
    docs, key, none = doc[runs], key[runs], none[runs]
    cuts = _first_of_runs(key, none)
    bounds, rows = np.append(cuts, len(key)), np.append(runs, len(doc))
    pairs = list(zip(bounds, bounds[1:]))
    return [
        pa.array(key[cuts], pa.int64()),
        pa.array(none[cuts], pa.bool_()),
        pa.array([docs[a:b].tobytes() for a, b in pairs], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in pairs], pa.binary()),
        pa.array([hashes[rows[a] : rows[b]].tobytes() for a, b in pairs], pa.binary()),
    ]


def _unpack(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, whether it has no id, and hash of every window in packed rows."""
    sizes = [len(x) // 8 for x in part.column("hashes").to_pylist()]
    none = np.repeat(np.array(part.column("nul").to_pylist(), bool), sizes)
    return np.repeat(_read(part, "docs", np.int64), _read(part, "counts", np.uint32)), none, _read(part, "hashes", np.uint64)


def _read(part: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in part.column(name).to_pylist()] or [np.zeros(0, kind)])


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns starts."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    fresh = np.zeros(len(columns[0]) - 1, bool)
    for x in columns:
        fresh |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], fresh]))


def _repeated(shards: int):
    def run(part: pa.Table) -> pa.Table:
        """Of one group: for every document, the windows that a document with a smaller id has too, packed by shard of ids."""
        doc, none, hashes = _unpack(part)
        if part.column("grp")[0].as_py() >= 0:
            order = np.argsort(hashes, kind="stable")
            hashes, doc, none = hashes[order], doc[order], none[order]
            first = _first_of_runs(hashes)
            if len(first):
                count = np.diff(np.append(first, len(doc)))
                least = np.repeat(np.minimum.reduceat(np.where(none, _MOST, doc), first), count)
                named = np.repeat(np.maximum.reduceat(~none, first), count)
                late = np.where(none, named, doc > least)
                hashes, doc, none = hashes[late], doc[late], none[late]
        return pa.table(dict(zip(["shard", "nul", "docs", "counts", "hashes"], _pack(_shard(doc, shards), none, doc, hashes), strict=True)))

    return run


def _by_document(part: pa.Table) -> pa.Table:
    """Of one shard: a row per document with all its repeated windows."""
    doc, none, hashes = _unpack(part)
    order = np.lexsort((doc, none))
    hashes, doc, none = hashes[order], doc[order], none[order]
    first = _first_of_runs(doc, none)
    ends = np.append(first[1:], len(doc)) if len(first) else first
    return pa.table(
        {
            "k": pa.array(doc[first], pa.int64()),
            "nul": pa.array(none[first], pa.bool_()),
            "flags": pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        }
    )


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flags = part.column("flags").to_pylist()
                hit = [i for i, x in enumerate(flags) if x]
                spans_of: list[list[dict]] = [[] for _ in flags]
                kept, n_words = [], []
                texts = Texts(part.column("text"))
                covered_of: dict[int, np.ndarray] = {}
                if hit:
                    some = Texts(part.column("text").take(pa.array(hit)))
                    _, _, owner, hashes, at, own = _hashed(some, size)
                    bound = np.searchsorted(own, np.arange(len(hit) + 1))
                    first = np.searchsorted(owner, np.arange(len(hit) + 1))
                    for k, i in enumerate(hit):
                        mine = np.frombuffer(flags[i], np.uint64)
                        found = at[bound[k] : bound[k + 1]][np.isin(hashes[bound[k] : bound[k + 1]], mine)] - first[k]
                        if not len(found):
                            continue
                        apart = np.flatnonzero(np.diff(found) > size)
                        begin = found[np.concatenate([[0], apart + 1])]
                        end = found[np.concatenate([apart, [len(found) - 1]])] + size
                        spans_of[i] = [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]
                        covered = np.zeros(first[k + 1] - first[k], bool)
                        covered[spans(begin, end - begin)] = True
                        covered_of[i] = covered
                for i in range(len(flags)):
                    words = texts.raw(i).split()
                    n_words.append(len(words))
                    if i in covered_of:
                        words = [w for w, gone in zip(words, covered_of[i].tolist(), strict=True) if not gone]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n_words, pa.int64()),
                        pa.array(spans_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "removed", "kept_text"],
                )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: id, n_words, removed (maximal word intervals, end exclusive) and kept_text.

    A word goes if a window over it also starts in a document with a smaller id.
    Windows are judged on the input. Null and empty texts have no words. A null
    id counts as larger than any other, so such documents lose windows to others
    and not to each other. Rows that share an id count as one document: they
    never take words from each other. Documents shorter than ``size`` words lose
    none. Ids come back as longs. Other columns are not carried. An empty table
    gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, math.ceil(total / 6 / WINDOWS_PER_GROUP))
    shards = max(16, groups // 4)
    # texts without an id are dealt by their words
    keyed = slim.select(F.coalesce("id", F.xxhash64("text")).alias("k"), F.col("id").isNull().alias("nul"), "id", "text")
    flags = (
        keyed.select("k", "nul", "text").mapInArrow(_windows_out(size, groups, shards), f"grp long, nul boolean, {_PACKED}")
        .groupBy("grp")
        .applyInArrow(_repeated(shards), f"shard long, nul boolean, {_PACKED}")
        .groupBy("shard")
        .applyInArrow(_by_document, "k long, nul boolean, flags binary")
    )
    joined = keyed.join(flags, ["k", "nul"], "left").select("id", "text", "flags")
    out = joined.mapInArrow(
        _removed(size),
        "id long, n_words long, removed array<struct<start: long, end: long>>, kept_text string",
    )
    return out.withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from, and kept of, every document."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER r = 13 THEN md5(array_to_string(list(word) OVER r, ' ')) END AS k FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT k, min(doc_id) AS first FROM g WHERE k IS NOT NULL GROUP BY 1),
b AS (SELECT g.doc_id, g.i, g.word, coalesce(f.first < g.doc_id, FALSE) AS begins FROM g LEFT JOIN f ON f.k = g.k),
c AS (SELECT doc_id, i, word, bool_or(begins) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM b),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""
}
