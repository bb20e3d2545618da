import numpy as np
import pyarrow as pa

from tellmark.llm.ragged import Texts


def test_equal_spans_have_equal_hashes_wherever_they_stand_and_others_do_not():
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.integers(0, 3, n, dtype=np.uint8) * 64 + 63) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 40) for _ in range(30)]
    pieces += [b"\x80" * 8 + b"\x00" * 8, b"\x00" * 8 + b"\x80" * 8, b"\x00" * 16, b"\x00" * 15, b"\x00"]
    rows = [pieces[i] for i in rng.permutation(np.arange(4 * len(pieces)) % len(pieces))]
    texts = Texts(pa.array(rows, pa.binary()).slice(3))
    one, other = texts.several_hashes(texts.starts, texts.ends, 1, 2)
    for h in (one, other):
        by_text, by_hash = {}, {}
        for row, x in zip(rows[3:], h.tolist(), strict=True):
            assert by_text.setdefault(row, x) == x and by_hash.setdefault(x, row) == row
    assert (one != other)[texts.ends > texts.starts].all()
    bits = np.unpackbits(np.unique(one).view(np.uint8)).reshape(-1, 64).mean(axis=0)
    assert (abs(bits - 0.5) < 0.15).all()


def test_empty_batches():
    for array in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        texts = Texts(array)
        assert len(texts.hashes(texts.starts, texts.ends, 1)) == len(array)
