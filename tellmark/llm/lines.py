"""Line dedup: lines within a few edits of an earlier line are removed, found by a segment-partition join.

How many edits two lines may be apart follows from the shorter one's length:
one for every ``PER_EDIT`` code points, at most ``edits``. Two edits in a line of
six digits would join most numbers with each other; below ``PER_EDIT`` code points
equality alone decides.

Two lines within e edits agree in one of e + 1 segments of the
shorter one, up to a bounded shift. So every line goes into one index bucket per
segment, and probes, for its own and each slightly shorter length, the buckets
that a partner could be in. Buckets that two different lines reach get the
texts, and a banded bit-parallel edit distance verifies every pair in them.

A task sends the keys of a line once, as long as it remembers the line; a second
hash and the texts themselves tell lines of equal hash apart. A hot
bucket is split into blocks and block pairs are compared, in tasks of their own;
what leaves a task is one row per line with its number of links and the earliest
partner, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.common import stored
from tellmark.llm.ragged import SLICE_BYTES, Texts, mix, slices, stream
from tellmark.session import table

EDITS = 2
#: Code points of the shorter line for every edit that two lines may be apart.
PER_EDIT = 8
#: Lines of fewer code points, without blanks around, are left alone; every line with a word is considered.
MIN_CHARS = 1
#: Lines of a bucket that are compared in one task.
BLOCK = 256
#: Repeated lines whose keys a task remembers to have sent; forgetting one costs rows, nothing else.
REMEMBERED = 1 << 16
#: What is added to the line numbers of documents without an id, which come after all others.
_NAMELESS = 1 << 32
_BASE = 0x9FB21C651E98DF25
_NO_ID = np.iinfo(np.int64).max


class Lines:
    """The lines of a batch with a word and enough code points: owner, number, byte span without blanks around, hash."""

    def __init__(self, texts: Texts, min_chars: int):
        starts, ends, owner = texts.lines()
        number = np.arange(len(starts)) - np.searchsorted(owner, owner)
        w_start, w_end, _ = texts.words()
        first, after = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
        full = after > first
        owner, number, start, end = owner[full], number[full], w_start[first[full]], w_end[after[full] - 1]
        self.texts = texts
        self.lead = (texts.bytes & 0xC0) != 0x80
        index = np.concatenate([[0], np.cumsum(self.lead, dtype=np.int64)])
        size = index[end] - index[start]
        long = size >= min_chars
        self.owner, self.number, self.start, self.end, self.size = (x[long] for x in (owner, number, start, end, size))
        self.c_start = index[self.start]
        self.h = texts.hashes(self.start, self.end, 5).view(np.int64)

    def check(self) -> np.ndarray:
        """A second hash of each line."""
        return self.texts.hashes(self.start, self.end, 9).view(np.int64)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of a polynomial over all characters, and the inverse powers that bring a difference to place 0."""
        data, at = self.texts.bytes, np.flatnonzero(self.lead)
        length = np.diff(np.append(at, len(data)))
        chars = data[at].astype(np.uint64)
        for k in (1, 2, 3):
            more = np.flatnonzero(length > k)
            chars[more] |= data[at[more] + k].astype(np.uint64) << np.uint64(8 * k)
        n = len(chars)
        power = _powers(_BASE, n)
        values = mix(chars + np.uint64(1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:n], dtype=np.uint64)])
        return sums, _powers(pow(_BASE, -1, 1 << 64), n)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of base modulo 2 to the 64; a worker keeps those of usual slices."""
    known = _KNOWN.get(base)
    if known is None or len(known) <= n:
        known = np.ones(max(n, SLICE_BYTES) + 1, np.uint64)
        known[1:] = np.cumprod(np.full(len(known) - 1, base, np.uint64))
        if n <= 2 * SLICE_BYTES:
            _KNOWN[base] = known
    return known


def allowed(size: int | np.ndarray, edits: int, per_edit: int) -> int | np.ndarray:
    """Edits that a line of this size, the shorter one, may be apart from another."""
    return np.minimum(edits, size // per_edit)


def segments(size: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (segment by line) of the edits + 1 segments of lines of these sizes, the last ones the longer."""
    parts = edits + 1
    short, extra = size // parts, size % parts
    lengths = np.stack([short + (i >= parts - extra) for i in range(parts)])
    return np.cumsum(lengths, axis=0) - lengths, lengths


def shifts(i: int, delta: int, edits: int) -> range:
    """Shifts against segment i's own start at which a line longer by delta may hold it (both sides' match-aware bounds)."""
    return range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1)


def bucket_keys(lines: Lines, edits: int, per_edit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Key, line and role of all buckets: 16 times the segment, plus 0 for index and probe or 1 + difference of length for a probe."""
    sums, inverse = lines.prefixes()
    salt = stream(64, 77)
    for limit, delta in ((e, d) for e in range(1, edits + 1) for d in range(e + 1)):
        size = lines.size - delta
        own = (allowed(size, edits, per_edit) == limit) & (size > limit)
        starts, lengths = segments(size, limit)
        for i in range(limit + 1):
            for shift in shifts(i, delta, limit):
                begin = starts[i] + shift
                fits = np.flatnonzero((begin >= 0) & (begin + lengths[i] <= lines.size) & own)
                a = lines.c_start[fits] + begin[fits]
                b = a + lengths[i][fits]
                content = (sums[b] - sums[a]) * inverse[a]
                key = mix(mix(content) ^ (size[fits].astype(np.uint64) * np.uint64(_BASE)) ^ salt[i])
                yield key.view(np.int64), fits, 16 * i + (0 if delta == 0 and shift == 0 else 1 + delta)


def _lines_out(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(Texts(part.column("text")), min_chars)
                nameless = (np.asarray(part.column("sub")) != 0)[lines.owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(lines.owner)),
                        part.column("sub").take(pa.array(lines.owner)),
                        pa.array(lines.number + np.where(nameless, _NAMELESS, 0)),
                        pa.array(lines.h),
                        pa.array(lines.check()),
                    ],
                    ["id", "sub", "no", "h", "h2"],
                )

    return run


def _keys_out(min_chars: int, edits: int, per_edit: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.int64)  # lines that came twice
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(Texts(part.column("text")), min_chars)
                h, once, often = np.unique(lines.h, return_index=True, return_counts=True)
                again = np.isin(h, sent)
                many = h[again | (often > 1)][:REMEMBERED]
                sent = np.union1d(sent, many) if len(sent) + len(many) <= REMEMBERED else many
                once = once[~again]
                for name in ("c_start", "size", "h"):
                    setattr(lines, name, getattr(lines, name)[once])
                found = list(bucket_keys(lines, edits, per_edit))
                key = np.concatenate([k for k, _, _ in found])
                if not len(key):
                    continue
                h = lines.h[np.concatenate([at for _, at, _ in found])]
                role = np.concatenate([np.full(len(at), r, np.uint8) for _, at, r in found])
                group = (mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                key, h, role, group = key[order], h[order], role[order], group[order]
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                pairs = list(zip(cuts, np.append(cuts[1:], len(group))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group[cuts]),
                        *(pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (key, h, role)),
                    ],
                    ["grp", "keys", "lines", "roles"],
                )

    return run


def _shared_buckets(part: pa.Table) -> pa.Table:
    """Of one group: the members of buckets with an indexed line and another one."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in part.column(name).to_pylist()])
    key, h, role = read("keys", np.int64), read("lines", np.int64), read("roles", np.uint8)
    order = np.lexsort((role, h, key))  # of a line's roles in a bucket the least stays, the index
    key, h, role = key[order], h[order], role[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
    key, h, role = key[once], h[once], role[once]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    indexed = np.add.reduceat((role % 16 == 0).astype(np.int64), first)
    keep = np.repeat((count > 1) & (indexed > 0), count)
    n = np.repeat(count, count)[keep]
    return pa.table({"key": key[keep], "h": h[keep], "role": role[keep].astype(np.int32), "n": n})


def _wanted_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                lines = Lines(texts, min_chars)
                wanted = np.unique(np.array([h for some in part.column("wanted").to_pylist() for h in some], np.int64))
                at = np.flatnonzero(np.isin(lines.h, wanted))
                line = [texts.bytes[a:b].tobytes() for a, b in zip(lines.start[at], lines.end[at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.h[at]), pa.array(lines.check()[at]), pa.array(line, pa.binary()).cast(pa.string())], ["h", "h2", "line"]
                )

    return run


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of a and b, or limit + 1 if it is larger.

    Set ``reach[e]`` has a bit for each diagonal of the band of 2 * limit + 1
    that e edits lead to; one step moves all diagonals at once. The places of every
    character of a are the bits of one number, of which a step sees the band.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    full = (1 << (2 * limit + 1)) - 1
    reach = [sum(1 << (limit + d) for d in range(e + 1)) for e in range(limit + 1)]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (limit + i)
    for j, c in enumerate(b):
        same = (places.get(c, 0) >> j) & full
        moved, before = [], 0
        for e, old in enumerate(reach):
            new = old & same
            if e:
                new |= before | (before >> 1) | (moved[-1] << 1)
            moved.append(new & full)
            before = old
        reach = moved
        if not reach[-1]:
            return limit + 1
    end = 1 << (limit + len(a) - len(b))
    return next((e for e, r in enumerate(reach) if r & end), limit + 1)


def near(a: str, b: str, limit: int) -> bool:
    """Whether at most limit edits part a and b; what they share at both ends is cut off first."""
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    head = low
    low, high = 0, n - head
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return edit_distance(a[head : len(a) - low], b[head : len(b) - low], limit) <= limit


def first_segment(x: str, y: str, edits: int) -> int:
    """The first segment of x, not longer than y, that y holds at a probed place."""
    starts, lengths = segments(np.array([len(x)]), edits)
    for i in range(edits + 1):
        a, k = int(starts[i, 0]), int(lengths[i, 0])
        if k and any(0 <= a + s <= len(y) - k and y[a + s : a + s + k] == x[a : a + k] for s in shifts(i, len(y) - len(x), edits)):
            return i
    return -1


def bucket_links(rows: list[tuple], edits: int, per_edit: int, found: dict[int, list]) -> None:
    """Verify the pairs of one block pair: rows of (hashes, role, side, other side or -1, least of its class, line).

    Of a pair the shorter line, or that of smaller hash, is the segmented one;
    the pair counts in the bucket of the first segment that the other one holds.
    """
    for h, role, side, other, least, line in rows:
        limit = int(allowed(len(line), edits, per_edit))
        if role % 16 or not limit:
            continue
        for g, _, side_g, _, least_g, line_g in rows:
            if (other >= 0 and side == side_g) or (len(line), h) >= (len(line_g), g) or len(line_g) - len(line) > limit:
                continue
            if near(line, line_g, limit) and first_segment(line, line_g, limit) == role // 16:
                for me, partner in ((h, least_g), (g, least)):
                    entry = found.setdefault(me, [0, partner])
                    entry[0] += 1
                    entry[1] = min(entry[1], partner)


def _links_out(edits: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, found = None, [], {}

        def out() -> pa.RecordBatch:
            items = list(found.items())
            found.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([h for (h, _), _ in items], pa.int64()),
                    pa.array([h2 for (_, h2), _ in items], pa.int64()),
                    pa.array([n for _, (n, _) in items], pa.int64()),
                    pa.array([x[0] for _, (_, x) in items], pa.int64()),
                    pa.array([x[1] for _, (_, x) in items], pa.int64()),
                ],
                ["h", "h2", "n_links", "id", "no"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "h", "h2", "role", "side", "other", "id", "no", "line")]
            for key, low, high, h, h2, role, side, other, d, no, line in zip(*columns, strict=True):
                if (key, low, high) != bucket:
                    bucket_links(rows, edits, per_edit, found)
                    bucket, rows = (key, low, high), []
                    if len(found) > 10_000:
                        yield out()
                rows.append(((h, h2), role, side, other, (d, no), line))
        bucket_links(rows, edits, per_edit, found)
        yield out()

    return run


def _key(id_col: Column, text: Column) -> list[Column]:
    """A document's number, null ids the largest, and 0 or, without an id, a hash of its text, which deals such documents out."""
    number, sub = id_col.cast("long"), F.xxhash64(text.cast("string"))
    return [
        F.coalesce(number, F.lit(int(_NO_ID))).alias("id"),
        F.when(number.isNotNull(), 0).otherwise(F.when(sub == 0, 1).otherwise(sub)).cast("long").alias("sub"),
    ]


def line_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, per_edit: int = PER_EDIT
) -> DataFrame:
    """One row per considered line: id (null as the largest long), sub (not 0 without an id), no (from 0), h, n_links and removed.

    ``n_links`` is the number of different lines of the whole table that are near
    it: within one edit for every ``per_edit`` code points of the shorter line, at
    most ``edits``;
    ``removed`` says that an equal or linked line stands earlier, by (id, no).
    Blanks around a line don't count.
    """
    slim = docs.select(*_key(F.col(id_col), F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    lines = stored(slim.mapInArrow(_lines_out(min_chars), "id long, sub long, no long, h long, h2 long"))
    classes = lines.groupBy("h", "h2").agg(F.min(F.struct("id", "no", "sub")).alias("least"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, -(-total // 20_000_000))
    members = stored(
        slim.select("text").mapInArrow(_keys_out(min_chars, edits, per_edit, groups), "grp long, keys binary, lines binary, roles binary")
        .groupBy("grp")
        .applyInArrow(_shared_buckets, "key long, h long, role int, n long")
    )
    # all classes of a hash, if there should be several: their texts are compared
    least = members.select("h").distinct().join(classes, "h")
    wanted = least.groupBy("least.id", "least.sub").agg(F.collect_list("h").alias("wanted"))
    texts = (
        slim.join(wanted, ["id", "sub"])
        .select("text", "wanted")
        .mapInArrow(_wanted_lines(min_chars), "h long, h2 long, line string")
        .groupBy("h", "h2")
        .agg(F.first("line").alias("line"))
    )
    known = stored(texts.join(least, ["h", "h2"]).select("h", "h2", "line", "least.id", "least.no"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        members.withColumn("side", F.pmod(F.xxhash64("h"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("side", "with"))
        .withColumn("high", F.greatest("side", "with"))
        .withColumn("other", F.when(F.col("low") < F.col("high"), F.col("with")).otherwise(-1))
    )
    links = (
        dealt.join(known, "h")
        .select("key", "low", "high", "h", "h2", "role", "side", "other", "id", "no", "line")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(_links_out(edits, per_edit), "h long, h2 long, n_links long, id long, no long")
        .groupBy("h", "h2")
        .agg(F.sum("n_links").alias("n_links"), F.min(F.struct("id", "no")).alias("partner"))
    )
    at = F.struct("least.id", "least.no")
    decided = classes.join(links, ["h", "h2"], "left").select(
        "h",
        "h2",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.least(at, F.coalesce("partner", at)).alias("first"),
    )
    return lines.join(decided, ["h", "h2"]).select(
        "id", "sub", (F.col("no") % _NAMELESS).cast("int").alias("no"), "h", "n_links", (F.struct("id", "no") > F.col("first")).alias("removed")
    )


def _cleaned(text: str, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.names.index(text)
                gone = part.column("_gone").to_pylist()
                hit = [i for i, x in enumerate(gone) if x]
                column = part.column(text)
                if hit:
                    some = column.take(pa.array(hit))
                    lines = Lines(Texts(some), min_chars)
                    bounds = np.searchsorted(lines.owner, np.arange(len(hit) + 1))
                    values = column.to_pylist()
                    for k, i in enumerate(hit):
                        a, b = bounds[k], bounds[k + 1]
                        mine = dict(zip(lines.number[a:b].tolist(), lines.h[a:b].tolist(), strict=True))
                        out = {x["no"] for x in gone[i] if mine.get(x["no"]) == x["h"]}
                        values[i] = "\n".join(x for n, x in enumerate(values[i].split("\n")) if n not in out)
                    column = pa.array(values, column.type)
                columns = list(part.columns)
                columns[at] = column
                yield pa.RecordBatch.from_arrays(columns[:-1], part.schema.names[:-1])

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, per_edit: int = PER_EDIT
) -> DataFrame:
    """The rows of ``docs`` with the text less the removed lines, and n_lines, n_removed and n_links at the end.

    ``n_lines`` counts the considered lines, those with a word and at least
    ``min_chars`` code points; all others stay. Lines of at most ``edits`` code
    points go as equal lines only. Order is by (id, line number), null ids last. Null
    texts stay null, a document may end up empty but stays a row. Rows that share
    an id count as one document: none of them loses a line to a line at the same
    or a later place of another. Ids must be integers or castable to long; other
    columns stay, but those named n_lines, n_removed or n_links are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_links")
    verdicts = line_verdicts(docs, id_col, text_col, edits, min_chars, per_edit)
    per = verdicts.groupBy(F.col("id").alias("_id"), F.col("sub").alias("_sub")).agg(
        F.count("*").alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.collect_set(F.when(F.col("removed"), F.struct("no", "h"))).alias("_gone"),
    )
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    number, sub = _key(*(F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)))
    plain = plain.withColumn("_id", number).withColumn("_sub", sub)
    counts = ["n_lines", "n_removed", "n_links"]
    joined = plain.join(per, ["_id", "_sub"], "left").select(
        *names, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), "_gone"
    )
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    schema += ", " + ", ".join(f"{c} long" for c in counts)
    text = names[docs.columns.index(text_col)]
    return joined.mapInArrow(_cleaned(text, min_chars), schema).toDF(*docs.columns, *counts)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted, removed and linked, and what is left, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        "n_links",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
