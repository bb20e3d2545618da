"""Best-fit-decreasing packing of token sequences into fixed windows.

Documents are tokenized and cut where they are longer than a window. Best-fit
decreasing then runs over the *histogram* of piece lengths, which has at most
``capacity`` entries however many pieces there are: pieces of one length are
interchangeable, and so are open bins with equal room. A segment tree over
remaining capacities names the tightest open bin in logarithmic time, and a
whole run of equal pieces is placed at once. The resulting plan is the one that
piece-by-piece best-fit decreasing makes; its size depends on the capacity only.
Each piece finds its place through its rank among the pieces of its length; the
ranks are counted in hashed shares, so that a hot length is no hot task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellmark.llm.common import free_name, stored
from tellmark.llm.ragged import Texts, slices, spans
from tellmark.session import table

CAPACITY = 4096
END_ID = 1
#: Pieces whose ranks one task counts.
SHARE = 100_000
#: Words whose ids a Python worker remembers; then it starts anew.
REMEMBERED = 600_000
PIECES = "piece int, start long, length long, ids binary"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that are tokens of their own behind a letter.
_TAILS = ("", ".", ",", ";", ":", "!", "?")


class _Words:
    """Ids of texts, by way of their blank-separated words where the vocabulary allows it.

    If its tokens carry a mark for the end of a word, no token crosses a blank
    and a text's ids are its words' ids, which are remembered. A word of letters
    only is one run of tokens up to such a mark, whatever stands around it, so
    that many new words are encoded as one text. Other vocabularies get whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word = bool(self.last.any())
        self.tails = np.array([self._encode([t])[0][0] if t else 0 for t in _TAILS], np.uint32) if self.by_word else None
        self.clear()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.codes: dict[bytes | None, int] = {None: 0}
        self.stems: dict[str, int] = {}
        self.flat, self.used = np.full(1 << 20, self.end_id, np.uint32), 1
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.stem_starts, self.stem_lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append ids to the pool; where each run starts."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        return starts

    @staticmethod
    def _put(array: np.ndarray, first: int, values: np.ndarray) -> np.ndarray:
        while first + len(values) > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        array[first : first + len(values)] = values
        return array

    def _runs(self, words: list[str], size: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has."""
        parts = [words[k : k + size] for k in range(0, len(words), size)]
        ids, lengths = [], []
        for some in parts:
            found = np.array(self._encode([" ".join(some)])[0], np.uint32)
            ends = np.flatnonzero(self.last[found])
            if len(ends) == len(some):
                ids.append(found)
                lengths.append(np.diff(np.append(-1, ends)))
            else:  # a letter that the vocabulary's rules take for something else
                each = self._encode(some)
                ids.append(np.array([i for x in each for i in x], np.uint32))
                lengths.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[bytes]) -> None:
        stems, known, get = {}, self.stems, self.stems.get
        plain, of, tail, odd = [], [], [], []
        tails = {t: i for i, t in enumerate(_TAILS) if t}
        for w in words:
            text = w.decode()
            stem = text.lower()
            end = tails.get(stem[-1], 0)
            if end:
                stem = stem[:-1]
            if not stem.isalpha() or "\u03a3" in text:  # a capital sigma's lower case hangs on its place
                odd.append(w)
                continue
            code = get(stem)
            if code is None:
                code = stems.get(stem)
                if code is None:
                    code = stems[stem] = len(known) + len(stems)
            plain.append(w)
            of.append(code)
            tail.append(end)
        if stems:
            ids, lengths = self._runs(list(stems))
            self.stem_starts = self._put(self.stem_starts, len(known), self._store(ids, lengths))
            self.stem_lengths = self._put(self.stem_lengths, len(known), lengths)
            known.update(stems)
        of, tail = np.array(of, np.int64), np.array(tail, np.int64)
        starts, lengths = self.stem_starts[of], self.stem_lengths[of].copy()
        marked = np.flatnonzero(tail)
        if len(marked):
            size = lengths[marked]
            copy = np.zeros(int(size.sum()) + len(marked), np.uint32)
            begin = np.cumsum(size + 1) - size - 1
            copy[spans(begin, size)] = self.flat[spans(starts[marked], size)]
            copy[begin + size] = self.tails[tail[marked]]
            starts[marked] = self._store(copy, size + 1)
            lengths[marked] += 1
        if odd:
            each = self._encode([w.decode() for w in odd])
            more = np.array([len(x) for x in each], np.int64)
            starts = np.append(starts, self._store(np.array([i for x in each for i in x], np.uint32), more))
            lengths = np.append(lengths, more)
        first = len(self.codes)
        self.starts, self.lengths = self._put(self.starts, first, starts), self._put(self.lengths, first, lengths)
        self.codes.update(zip([*plain, *odd], range(first, first + len(starts)), strict=True))

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and each text's number of ids."""
        if not self.by_word:
            each = [[*x, self.end_id] for x in self._encode([texts.raw(i).decode() for i in range(len(texts))])]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        words: list[bytes | None] = []
        counts = np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            before = len(words)
            words += texts.raw(i).split()
            words.append(None)
            counts[i] = len(words) - before
        if len(self.codes) > REMEMBERED:
            self.clear()
        get = self.codes.get
        at = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            unseen = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(unseen)))
            at[new] = [get(w) for w in unseen]
        lengths = self.lengths[at]
        flat = self.flat[spans(self.starts[at], lengths)]
        return flat, np.add.reduceat(lengths, np.cumsum(counts) - counts)


_WORKER: dict[tuple[str, int], _Words] = {}


def _pieces_out(path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path or word_bpe_path(), end_id)
        if key not in _WORKER:
            _WORKER[key] = _Words(*key)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = _WORKER[key].ids(Texts(part.column("text")))
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                kind = pa.binary() if offsets[-1] < 2**31 else pa.large_binary()
                ids = pa.Array.from_buffers(
                    kind,
                    len(row),
                    [None, pa.py_buffer(offsets.astype(np.int32 if kind == pa.binary() else np.int64)), pa.py_buffer(flat.astype("<u4"))],
                )
                others = [part.column(c).take(pa.array(row)) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids],
                    [*(c for c in part.schema.names if c != "text"), "piece", "start", "length", "ids"],
                )

    return run


def tokenize(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length and ids (little-endian unsigned 32-bit numbers).

    Every document ends with ``end_id``, so a null, empty or blank text is one
    piece of one id. Only documents longer than ``capacity`` are cut. ``path`` is
    the vocabulary's file on the executors; None is the installed word_bpe_49k.
    Rows that share an id are separate documents. Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(_pieces_out(path, capacity, end_id), f"id {kind}, {PIECES}")
    return out.withColumnRenamed("id", id_col)


class _Tightest:
    """Segment tree over remaining capacities: the least capacity of at least n that has an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def find(self, least: int) -> int | None:
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Runs of equal pieces: those of ``length`` from rank ``first`` on fill bins from ``bin`` on, ``per_bin`` to each, from ``offset``."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    per_bin: np.ndarray
    bins: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over {length: number of pieces}; the same bins as piece by piece."""
    tree, rooms, rows, bins = _Tightest(capacity), {}, [], 0

    def open_bins(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            rooms.setdefault(room, []).append((first, count))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        while left:
            room = tree.find(length)
            if room is None:
                room, per_bin = capacity, capacity // length
                first, count = bins, -(-left // per_bin)
                bins += count
            else:
                per_bin = room // length
                first, count = rooms[room].pop()
                if not rooms[room]:
                    tree.mark(room, False)
            used = min(count, -(-left // per_bin))
            placed = min(left, used * per_bin)
            rows.append((length, rank, first, capacity - room, per_bin))
            full = placed // per_bin
            open_bins(room - per_bin * length, first, full)
            if used > full:
                open_bins(room - (placed - full * per_bin) * length, first + full, 1)
            open_bins(room, first + used, count - used)
            left, rank = left - placed, rank + placed
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


def _places(plan: Plan, length_at: int):
    order = np.lexsort((plan.first, plan.length))
    span = np.int64(1) << np.int64(44)  # ranks stay below
    keys = plan.length[order] * span + plan.first[order]
    first, bins, offsets, per_bin = plan.first[order], plan.bin[order], plan.offset[order], plan.per_bin[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(length_at), np.int64)
            rank = np.asarray(batch.column(batch.num_columns - 1), np.int64)
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(bins[at] + nth // per_bin[at], pa.int64()),
                    pa.array(offsets[at] + nth % per_bin[at] * length, pa.int64()),
                ],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset of best-fit decreasing.

    ``pieces`` is read three times: pass a stored table, not a costly plan.
    Lengths must lie in 1..capacity; null ones, as others, are an error. Equal lengths are ranked by a hash of the
    whole row, so the result is the same on every run; equal rows are
    interchangeable. All columns are kept, whatever they are called, but columns
    named sequence_id or offset are replaced. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().limit(capacity + 1).collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    plan = best_fit_decreasing(histogram, capacity)
    shares = max(1, -(-sum(histogram.values()) // SHARE))
    order, share, rank, before = (free_name(pieces, c) for c in ("_order", "_share", "_rank", "_before"))
    dealt = pieces.withColumn(order, F.xxhash64(*(F.col(f"`{c}`") for c in pieces.columns))).withColumn(
        share, F.pmod(F.col(order), F.lit(shares)).cast("int")
    )
    counts = dealt.groupBy(length_col, share).agg(F.count("*").alias("n"))
    counts = counts.select(
        F.col(length_col).alias("l"),
        F.col(share).alias("s"),
        (F.sum("n").over(Window.partitionBy(length_col).orderBy(share)) - F.col("n")).alias(before),
    )
    ranked = (
        dealt.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, share).orderBy(order)))
        .join(counts, (F.col(f"`{length_col}`") == F.col("l")) & (F.col(share) == F.col("s")))
        .select(*(f"`{c}`" for c in pieces.columns), (F.col(rank) + F.col(before) - 1).cast("long").alias(rank))
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(
        _places(plan, pieces.columns.index(length_col)), f"{fields}, sequence_id long, offset long"
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    pieces = tokenize(table(spark, sf_dir, "documents"))
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(slim))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
