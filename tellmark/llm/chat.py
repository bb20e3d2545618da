"""Chat formatting: conversations assembled column by column into one byte buffer, with a loss mask.

Turns are dealt by conversation and sorted; a task then works on whole Arrow
batches. Numpy computes the lengths of all parts, their cumulative offsets and
the indices that scatter headers, roles and contents into one preallocated
buffer, which is the output column's own buffer. No turn is handled on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.ragged import Texts, slices, spans
from tellmark.session import table

#: A turn is OPEN role MIDDLE text CLOSE; these strings are broken up inside roles and texts.
OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
CONTROLS = (b"<s>", b"</s>", b"[INST]", b"[/INST]")
ESCAPE = ord("\\")
LEARNED = "assistant"
_SCHEMA = "conv_id {kind}, n_turns long, formatted string, loss array<struct<start: long, end: long>>"


def escaped(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with an escape sign behind each escape sign and behind the first byte of each control string; starts and lengths."""
    data = texts.bytes
    n = len(data)
    mark = data == ESCAPE
    for control in CONTROLS:
        k = len(control)
        if n < k:
            continue
        here = np.flatnonzero(data[: n - k + 1] == control[0])
        for j in range(1, k):
            here = here[data[here + j] == control[j]]
        inside = here + k <= texts.ends[np.searchsorted(texts.ends, here, side="right")]
        mark[here[inside]] = True
    before = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    out = np.empty(n + int(before[-1]), np.uint8)
    place = np.arange(n) + before[:-1]
    out[place] = data
    out[place[mark] + 1] = ESCAPE
    starts, ends = texts.starts + before[texts.starts], texts.ends + before[texts.ends]
    return out, starts, ends - starts


def assemble(conv: pa.Array, roles: pa.Array, contents: pa.Array) -> pa.RecordBatch:
    """One row per run of equal conv: the formatted conversation and the byte spans of what is learned."""
    n = len(conv)
    role, role_start, role_size = escaped(Texts(roles))
    text, text_start, text_size = escaped(Texts(contents))
    size = len(OPEN) + role_size + len(MIDDLE) + text_size + len(CLOSE)
    ends = np.cumsum(size)
    starts = ends - size
    buffer = np.empty(int(ends[-1]) if n else 0, np.uint8)
    at_role = starts + len(OPEN)
    at_middle = at_role + role_size
    at_text = at_middle + len(MIDDLE)
    at_close = at_text + text_size
    for at, piece in ((starts, OPEN), (at_middle, MIDDLE), (at_close, CLOSE)):
        buffer[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    for at, data, begin, k in ((at_role, role, role_start, role_size), (at_text, text, text_start, text_size)):
        buffer[spans(at, k)] = data[spans(begin, k)]
    code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if n else np.zeros(0, np.int64)
    after = np.append(first[1:], n)
    offsets = np.append(starts[first], len(buffer))
    kind, width = (pa.string(), np.int32) if len(buffer) < 2**31 else (pa.large_string(), np.int64)
    formatted = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(buffer)])
    learned = np.asarray(roles.fill_null("").to_numpy(zero_copy_only=False) == LEARNED, bool)
    shift = np.repeat(starts[first], after - first)
    span = pa.StructArray.from_arrays(
        [pa.array((at_text - shift)[learned]), pa.array((at_close - shift)[learned])], ["start", "end"]
    )
    counts = np.concatenate([[0], np.cumsum(learned)])
    loss = pa.ListArray.from_arrays(pa.array(np.append(counts[first], counts[-1]).astype(np.int32)), span)
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(after - first), formatted, loss], ["conv_id", "n_turns", "formatted", "loss"]
    )


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations are sorted together; the last one of a slice may go on in the next."""
    open_rows: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(open_rows).combine_chunks().to_batches()
        assert len(rows) == 1
        return assemble(*(rows[0].column(c) for c in ("conv", "role", "text")))

    for batch in batches:
        for part in slices(batch, "text"):
            conv = part.column("conv")
            last = conv[len(conv) - 1]
            code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut = len(code) - int(np.argmax(code[::-1] != code[-1])) if (code != code[-1]).any() else 0
            if open_rows and open_rows[-1].column("conv")[open_rows[-1].num_rows - 1].as_py() != conv[0].as_py():
                yield out()
                open_rows = []
            if cut:
                open_rows.append(part.slice(0, cut))
                yield out()
                open_rows = []
            open_rows.append(part.slice(cut))
            assert last.as_py() == open_rows[-1].column("conv")[0].as_py()
    if open_rows:
        yield out()


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted and loss (byte spans of assistant texts in the UTF-8 of formatted).

    Turns go by (turn, role, text), null first; equal rows all stay. Null roles
    and texts are empty, a null conversation id is a conversation. A task holds
    one conversation and a slice of others at a time. Other columns are not
    carried. An empty table gives an empty result.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "role", "text").mapInArrow(_formatted, _SCHEMA.format(kind=kind)).withColumnRenamed("conv_id", conv_col)


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns, raw = parse(formatted), formatted.encode()
            learned = "".join(unescaped(raw[s["start"] : s["end"]].decode()) for s in loss)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            row = (conv, len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = format_conversations(turns.unionByName(probe))
    return formatted.mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_ESCAPED = "replace(" * 5 + "{c}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLES = {
    "op3_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
             CAST(sum(20 + length({_ESCAPED.format(c='role')}) + length({_ESCAPED.format(c='text')})) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars FROM g"""
}
QUERIES = {"op3_chat_formatting": op3_chat_formatting}
