"""Numpy over whole Arrow batches of texts: words, lines, hashes and gathers of runs of unequal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17)) * _GOLD)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


class Texts:
    """The UTF-8 bytes of a batch of texts, and where each text starts and ends."""

    def __init__(self, array: pa.Array):
        array = array.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        data = array.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = int(offsets[0]) if len(offsets) else 0
        self.bytes = whole[first : int(offsets[-1]) if len(offsets) else 0]
        self.starts = (offsets[:-1] - first).astype(np.int64)
        self.ends = (offsets[1:] - first).astype(np.int64)
        self._eights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of marked bytes within one text."""
        n = len(inside)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[self.starts[self.starts < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[self.ends[self.ends > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.ends, starts, side="right")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.bytes
        return self.runs(~((b == 32) | ((b >= 9) & (b <= 13))))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the break) and text number of each line, split at line feeds; an empty text has one."""
        breaks = np.flatnonzero(self.bytes == 10)
        of = np.searchsorted(self.ends, breaks, side="right")
        ids = np.arange(len(self))
        starts = np.concatenate([self.starts, breaks + 1])
        owner = np.concatenate([ids, of])
        order = np.lexsort((starts, owner))
        ends = np.concatenate([breaks, self.ends])
        owner_of_end = np.concatenate([of, ids])
        return starts[order], ends[np.lexsort((ends, owner_of_end))], owner[order]

    def eights(self) -> np.ndarray:
        """The bytes as little-endian numbers of eight bytes, with zeros behind the end."""
        if self._eights is None:
            self._eights = np.concatenate([self.bytes, np.zeros(16 - len(self.bytes) % 8, np.uint8)]).view("<u8")
        return self._eights

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        """A 64-bit hash of each span: its bytes, eight at a time, mixed, times multipliers of their place, summed and mixed."""
        return self.several_hashes(starts, ends, seed)[0]

    def several_hashes(self, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> list[np.ndarray]:
        """Independent hashes of each span, one for each seed."""
        lengths = ends - starts
        full = np.flatnonzero(lengths > 0)
        out = [np.zeros(len(starts), np.uint64) for _ in seeds]
        if len(full):
            s, k = starts[full], lengths[full]
            loads = (k + 7) >> 3
            before = np.cumsum(loads) - loads
            place = np.arange(int(loads.sum()), dtype=np.int64) - np.repeat(before, loads)
            at = np.repeat(s, loads) + 8 * place
            shift = ((at & 7) << 3).astype(np.uint64)
            at >>= 3
            eights = self.eights()
            word = (eights[at] >> shift) | ((eights[at + 1] << (np.uint64(63) - shift)) << np.uint64(1))
            last = before + loads - 1
            word[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 * loads - k) << 3).astype(np.uint64)
            for one, seed in zip(out, seeds, strict=True):
                start, first, second = stream(3, seed) | np.uint64(1)
                value = (word ^ start) * first
                value ^= value >> np.uint64(32)
                value *= second
                value ^= value >> np.uint64(29)
                value *= (stream(int(loads.max()), seed + 1) | np.uint64(1))[place]
                one[full] = np.add.reduceat(value, before)
        return [mix(one + lengths.astype(np.uint64) * _GOLD) for one in out]


def windows(codes: np.ndarray, owner: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of size consecutive codes of one owner, and where each starts.

    The polynomial of odd base is taken modulo 2 to the 64; the codes are mixed hashes already.
    """
    if len(codes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - size + 1
    total = np.zeros(n, np.uint64)
    factor = np.uint64(base | 1)
    for j in range(size):
        total = total * factor + codes[j : j + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[at]), at


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about limit bytes of text each."""
    lengths = np.asarray(
        pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    if not len(lengths):
        return
    part = (np.cumsum(lengths) - lengths) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, len(lengths)], strict=True):
        yield batch.slice(int(a), int(b - a))
