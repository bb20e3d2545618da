import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tellmark.llm.packing import best_fit_decreasing, op4_best_fit_packing, pack, tokenize, word_bpe_path


def bfd_bins(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bins += room == capacity
        bisect.insort(rooms, room - n)
    return bins


def test_plan_equals_piecewise_best_fit():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan = best_fit_decreasing(histogram, capacity)
        assert plan.bins == bfd_bins(lengths, capacity)


def test_ids_match_whole_text_tokenization(spark):
    texts = [None, "", " \n", "Hello, WORLD's don't 42 é x\x1cy", "ΑΣ ΣΑΣ <|endoftext|> a<|startoftext|>b", "á ́b", "x " * 9000]
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids=1, length=2) for i, t in enumerate(texts)])
    tokenizer = Tokenizer.from_file(word_bpe_path())
    got = defaultdict(list)
    for r in tokenize(df).orderBy("doc_id", "piece").collect():
        assert r.start == len(got[r.doc_id]) and 0 < r.length <= 4096
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert got[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == bfd_bins([r.length for r in rows], capacity)


def test_query_packs_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = op4_best_fit_packing(spark, sf).collect()
    check_packed(rows, 4096)
    tokenizer = Tokenizer.from_file(word_bpe_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    for d, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.piece, r.start, r.length) == (k, 4096 * k, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_ties_repeats_and_clashing_names(spark):
    df = spark.range(500).select((F.col("id") % 3 + 1).alias("length"), F.lit(9).alias("OFFSET"), F.lit(1).alias("_share"), F.lit(2).alias("n"))
    out = pack(df, capacity=7)
    rows = out.collect()
    assert len(rows) == 500 and out.columns == ["length", "_share", "n", "sequence_id", "offset"]
    check_packed(rows, 7)
    assert pack(df.limit(0), capacity=7).count() == 0


def test_ids_of_remembered_words_match_whole_texts(monkeypatch):
    import pyarrow as pa

    from tellmark.llm import packing
    from tellmark.llm.ragged import Texts

    rng = random.Random(1)
    letters = "aBéßΣσİǅ中 \n\t.,;:!?'sS’“1२٣́가ᄀ\x1c\x85\xa0…–_-"
    texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(word_bpe_path())
    words = packing._Words(word_bpe_path(), 1)
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    for k in range(0, len(texts), 300):
        flat, counts = words.ids(Texts(pa.array(texts[k : k + 300])))
        ends = np.cumsum(counts)
        for text, a, b in zip(texts[k : k + 300], ends - counts, ends, strict=True):
            assert flat[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
