"""Quality rules: word statistics, and lines labelled content or boilerplate by a linear-chain CRF.

A document fails outright if it is very short or mostly repeats itself. Of the
others a Viterbi decoding of its lines decides: a document is kept if enough of
its words stand in content lines. The CRF is fitted on at most ``SAMPLE``
labelled documents of at most ``SAMPLE_LINES`` lines; only line features of that
sample reach the driver. Labels are of documents, states of lines: a line starts
with its document's label, lines that a model without neighbours is sure of
otherwise change theirs, and lines of bad documents set into good ones (and the
other way round) show the chain how content and boilerplate follow each other.
Everything runs in one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.ragged import Texts, mix, slices, windows
from tellmark.session import table

#: Most labelled documents that the model is fitted on.
SAMPLE = 2000
#: Lines of a document of the sample; longer ones are judged like all others, but not fitted on.
SAMPLE_LINES = 500
#: Log odds at which a line's own features outvote its document's label.
SURE = 3.0
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Least share of a document's words in content lines.
MIN_CONTENT = 0.5
_BASE = 0x2545F4914F6CDD1D
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_FEATURES = 12


@dataclass(frozen=True)
class LineModel:
    """A two-state chain: emission weights (feature by state), start and transition weights; state 1 is content."""

    emit: np.ndarray
    start: np.ndarray
    step: np.ndarray


def _any_of(data: np.ndarray, chars: bytes) -> np.ndarray:
    marked = np.zeros(256, bool)
    marked[np.frombuffer(chars, np.uint8)] = True
    return marked[data]


def _counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[ends] - sums[starts]


class Pages:
    """Statistics of a batch of texts and features of their lines that have a word."""

    def __init__(self, texts: Texts):
        data = texts.bytes
        w_start, w_end, w_owner = texts.words()
        codes = texts.hashes(w_start, w_end, 1)
        n = len(texts)
        self.n_words = np.bincount(w_owner, minlength=n)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        points = ((data & 0xC0) != 0x80) & ~blank
        self.word_chars = _counts(points, texts.starts, texts.ends)
        symbols = _any_of(data, b"#*$%&|<>")
        self.n_symbols = _counts(symbols, texts.starts, texts.ends)
        self.n_repeat_words = self._repeats(codes, w_owner, n)

        starts, ends, owner = texts.lines()
        first = np.searchsorted(w_start, starts)
        words = np.searchsorted(w_start, ends) - first
        full = words > 0
        starts, ends, owner, first, words = starts[full], ends[full], owner[full], first[full], words[full]
        repeated = self._seen_before(texts.hashes(starts, ends, 3), owner)
        self.n_dup_lines = np.bincount(owner[repeated], minlength=n)
        self.owner, self.words = owner, words
        self.features = self._features(texts, symbols, blank, starts, ends, first, words, codes, w_start, w_end, repeated)

    @staticmethod
    def _repeats(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        hashes, at = windows(codes, owner, REPEAT_WINDOW, _BASE)
        if not len(hashes):
            return np.zeros(n, np.int64)
        keys = mix(hashes ^ (owner[at].astype(np.uint64) << np.uint64(20)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(codes) + 1, np.int32)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return np.bincount(owner[covered], minlength=n)

    @staticmethod
    def _seen_before(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(hashes)), hashes, owner))
        out = np.zeros(len(hashes), bool)
        out[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        return out

    @staticmethod
    def _features(texts, symbols, blank, starts, ends, first, words, codes, w_start, w_end, repeated) -> np.ndarray:
        data = texts.bytes
        if not len(starts):
            return np.zeros((0, _FEATURES), np.float32)
        last_byte = data[w_end[first + words - 1] - 1]
        size = np.maximum(_counts(~blank, starts, ends), 1)
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]
        same[first] = False
        in_words = lambda mask: _counts(mask, first, first + words) / words
        columns = [
            np.ones(len(starts)),
            np.log1p(words) / 5,
            _any_of(last_byte, b".!?"),
            np.minimum(_counts(symbols, starts, ends) / words, 1),
            np.minimum(_counts(data == ord("|"), starts, ends) / words, 1),
            np.minimum(_counts(data == ord("!"), starts, ends) / words, 2),
            _counts((data >= 65) & (data <= 90), starts, ends) / size,
            _counts((data >= 48) & (data <= 57), starts, ends) / size,
            in_words(same),
            repeated,
            np.minimum(size / words / 10, 3),
            words < 4,
        ]
        return np.stack(columns, 1).astype(np.float32)


def _steps(owner: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For line 0, 1, ...: the row numbers of that line in the texts that have one, longest text first."""
    _, first, count = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    for t in range(int(count.max()) if len(count) else 0):
        alive = int(np.searchsorted(-count, -t, side="left"))
        yield first[:alive] + t, alive


def viterbi(model: LineModel, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The best state of every line; owner is sorted and names the text of a line."""
    if not len(owner):
        return np.zeros(0, np.int64)
    scores = features.astype(float) @ model.emit
    back = np.zeros((len(owner), 2), np.int8)
    best = np.zeros((len(owner), 2))
    steps = list(_steps(owner))
    previous = None
    for rows, alive in steps:
        if previous is None:
            best[rows] = scores[rows] + model.start
        else:
            via = best[previous[:alive]][:, :, None] + model.step[None]
            back[rows] = via.argmax(1)
            best[rows] = via.max(1) + scores[rows]
        previous = rows
    states = best.argmax(1)
    for (rows, _), (after, n) in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
        states[rows[:n]] = back[after, states[after]]
    return states


def fit(features: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> LineModel:
    """Maximum likelihood by forward-backward and Adam; labels has the state of every line. Convex and without randomness."""
    size = features.shape[1]
    theta = np.zeros(2 * size + 6)
    steps = list(_steps(owner)) if len(owner) else []
    x = features.astype(float)
    gold = np.zeros((len(owner), 2))
    gold[np.arange(len(owner)), labels] = 1

    def parts(t: np.ndarray) -> LineModel:
        return LineModel(t[: 2 * size].reshape(size, 2), t[2 * size : 2 * size + 2], t[2 * size + 2 :].reshape(2, 2))

    def moments(emit: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.concatenate([emit.ravel(), start, step.ravel()])

    begin = steps[0][0] if steps else np.zeros(0, np.int64)
    gold_step = np.zeros((2, 2))
    for (rows, _), (after, n) in zip(steps[:-1], steps[1:], strict=True):
        np.add.at(gold_step, (labels[rows[:n]], labels[after]), 1)
    want = moments(x.T @ gold, gold[begin].sum(0), gold_step)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1 if len(owner) else 1):
        model = parts(theta)
        scores = x @ model.emit
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        previous = None
        for rows, n in steps:
            alpha[rows] = scores[rows] + (
                model.start
                if previous is None
                else np.logaddexp.reduce(alpha[previous[:n]][:, :, None] + model.step[None], axis=1)
            )
            previous = rows
        expected_step = np.zeros((2, 2))
        for (rows, _), (after, n) in zip(reversed(steps[:-1]), reversed(steps[1:]), strict=True):
            ahead = model.step[None] + (scores[after] + beta[after])[:, None, :]
            beta[rows[:n]] = np.logaddexp.reduce(ahead, axis=2)
            joint = alpha[rows[:n]][:, :, None] + ahead
            joint -= np.logaddexp.reduce(joint.reshape(n, 4), axis=1)[:, None, None]
            expected_step += np.exp(joint).sum(0)
        both = alpha + beta
        p = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        slope = (want - moments(x.T @ p, p[begin].sum(0), expected_step) - penalty * theta) / len(owner)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return parts(theta)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            page = Pages(Texts(part.column("text")))
            bounds = np.searchsorted(page.owner, np.arange(len(part.column("text")) + 1))
            some = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) <= SAMPLE_LINES))
            features = [page.features[bounds[i] : bounds[i + 1]].astype("<f4").tobytes() for i in some]
            yield pa.RecordBatch.from_arrays(
                [part.column("good").take(pa.array(some)), part.column("key").take(pa.array(some)), pa.array(features, pa.binary())],
                ["good", "key", "features"],
            )


def line_states(lines: list[np.ndarray], good: np.ndarray) -> list[np.ndarray]:
    """A state for every line: its document's label, unless a model of single lines is sure of the other one."""
    every = np.concatenate(lines)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    alone = fit(every, np.arange(len(every)), good[owner])
    odds = every.astype(float) @ (alone.emit[:, 1] - alone.emit[:, 0]) + alone.start[1] - alone.start[0]
    states = np.where(odds > SURE, 1, np.where(odds < -SURE, 0, good[owner]))
    return np.split(states, np.cumsum([len(x) for x in lines])[:-1])


def spliced(lines: list[np.ndarray], states: list[np.ndarray], good: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The documents, and as many mixed ones as the rarer label has: one to three lines of one within another, in turns."""
    of = [np.flatnonzero(good == k) for k in (0, 1)]
    docs = [(lines[i], states[i]) for i in range(len(lines))]
    for n, pair in enumerate(zip(*of)):
        outer, inner = pair if n % 2 else pair[::-1]
        at, some = n % (len(lines[outer]) + 1), 1 + n % 3
        docs.append(tuple(np.concatenate([x[outer][:at], x[inner][:some], x[outer][at:]]) for x in (lines, states)))
    return [x for x, _ in docs], [s for _, s in docs]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineModel:
    """Fit the chain on at most ``sample`` labelled documents, those of least hash of their id.

    ``labels`` has doc_id and quality (1 good, 0 bad; others, null ids and
    documents without text are left out). Of several labels of an id the worst
    counts, of several rows of an id one. Without any labelled line every line
    counts as content. The fit is the same in every run.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
        .withColumn("key", F.xxhash64("doc_id"))
        .orderBy("key", "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("good", "key", "text")  # at most ``sample`` rows
    found = joined.mapInArrow(_line_rows, "good int, key long, features binary").groupBy("key").agg(
        F.min("good").alias("good"), F.min("features").alias("features")
    )
    rows = sorted((r.key, r.good, bytes(r.features)) for r in found.collect())
    if not rows:
        return LineModel(np.zeros((_FEATURES, 2)), np.array([0.0, 1.0]), np.zeros((2, 2)))
    lines = [np.frombuffer(x, "<f4").reshape(-1, _FEATURES) for *_, x in rows]
    good = np.array([g for _, g, _ in rows])
    lines, states = spliced(lines, line_states(lines, good), good)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return fit(np.concatenate(lines), owner, np.concatenate(states))


def verdicts(model: LineModel, page: Pages, min_content: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text fails outright, its share of words in content lines, and whether it is kept."""
    failed = (page.n_words < MIN_WORDS) | (100 * page.n_repeat_words > MAX_REPEAT_PERCENT * page.n_words)
    content = viterbi(model, page.features, page.owner) == 1
    words = np.bincount(page.owner, weights=page.words * content, minlength=len(page.n_words))
    share = words / np.maximum(page.n_words, 1)
    return failed, share, ~failed & (share >= min_content)


def _judged(model: LineModel, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                page = Pages(Texts(part.column("text")))
                failed, share, kept = verdicts(model, page, min_content)
                stats = (page.n_words, page.word_chars, page.n_symbols, page.n_dup_lines, page.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        *(pa.array(x.astype(np.int64)) for x in stats),
                        pa.array(failed),
                        pa.array(share),
                        pa.array(kept),
                    ],
                    ["id", *(x.split()[0] for x in _STATS.split(", ")), "base_failed", "content_share", "kept"],
                )

    return run


def judge(
    docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT
) -> DataFrame:
    """One row per document: id, the word statistics, base_failed, content_share and kept.

    Null, empty and blank texts have no words and fail. Repeated rows and ids are
    judged each on its own; other columns are not carried. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, {_STATS}, base_failed boolean, content_share double, kept boolean"
    return slim.mapInArrow(_judged(model, min_content), schema).withColumnRenamed("id", id_col)


def _kept_rows(model: LineModel, text: str, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(verdicts(model, Pages(Texts(part.column(text))), min_content)[2]))

    return run


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever they are called.

    Null, empty and blank texts go. Repeated rows stay or go alike, each on its own. Empty in, empty out.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    text = names[docs.columns.index(text_col)]
    return docs.toDF(*names).mapInArrow(_kept_rows(model, text, min_content), schema).toDF(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by a model fitted on labelled documents of the same table."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
