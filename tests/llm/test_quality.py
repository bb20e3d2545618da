import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from tellmark.llm.quality import LineModel, Pages, fit, judge, keep_good, op10_quality_rules, train, verdicts, viterbi
from tellmark.llm.ragged import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def row(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_statistics_match_brute_force_and_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_quality_rules(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        assert row(got[d]) == brute(text), d
        assert not (got[d].kept and got[d].base_failed)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where("doc_id % 2 = 0"), 1500)
    rows = judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0 and not r.base_failed]
    print(len(good), sum(r.kept for r in good), len(bad), sum(r.kept for r in bad))
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_mixed_documents_are_told_line_by_line(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where("doc_id % 2 = 0"), 1500)
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").orderBy("doc_id").collect()
    wordy = lambda q: [[x for x in r.text.split("\n") if len(x) > 60] for r in rows if r.quality == q]
    marked = lambda x: all(re.search(r"[|#$%&*]{1}", line) for line in x)
    good = [x for x in wordy(1) if 1 < len(x) < 30][:100]
    bad = [x for x in wordy(0) if 1 < len(x) < 30 and marked(x)][:100]  # other bad ones repeat good-looking lines
    mixed = [b[:1] + g + b[1:] for g, b in zip(good, bad)]
    truth = [[0] + [1] * len(g) + [0] * (len(b) - 1) for g, b in zip(good, bad)]
    page = Pages(Texts(pa.array(["\n".join(x) for x in mixed])))
    right = viterbi(model, page.features, page.owner) == np.concatenate(truth)
    share = verdicts(model, page, 0.5)[1]
    print(len(mixed), right.mean(), ((share > 0) & (share < 1)).mean())
    assert len(mixed) >= 50 and right.mean() >= 0.9 and ((share > 0) & (share < 1)).mean() >= 0.7
    heads = np.flatnonzero(np.concatenate([[True], page.owner[1:] != page.owner[:-1]]))
    assert right[heads].mean() >= 0.7


def test_viterbi_is_the_best_path_and_fit_is_deterministic():
    rng = np.random.default_rng(2)
    model = LineModel(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    owner = np.repeat([0, 1, 2, 5], [1, 6, 3, 4])
    x = rng.normal(size=(len(owner), 3))
    got = viterbi(model, x, owner)
    for k in np.unique(owner):
        at = np.flatnonzero(owner == k)
        score = lambda p: model.start[p[0]] + sum(x[i] @ model.emit[:, s] for i, s in zip(at, p)) + sum(
            model.step[a, b] for a, b in zip(p, p[1:])
        )
        best = max(itertools.product((0, 1), repeat=len(at)), key=score)
        assert tuple(got[at]) == best
    labels = (x[:, 0] > 0).astype(int)
    fitted = fit(x, owner, labels)
    assert (viterbi(fitted, x, owner) == labels).mean() > 0.8
    assert np.array_equal(fitted.emit, fit(x, owner, labels).emit)


def test_nulls_empties_long_texts_and_clashing_names(spark):
    texts = [None, "", " \n\t\n", "a b c d e " * 3000, "One two three four five six seven eight nine ten eleven.", "é\x1cü | x"]
    rows = [Row(doc_id=None if i == 5 else i, text=t, ID=7, KEPT=t, n_words=1) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows)
    model = train(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = sorted((row(r) for r in judge(df, model).collect()))
    assert got == sorted(brute(t) for t in texts * 2)
    assert [tuple(r) for r in keep_good(df, model).collect()] == [tuple(rows[4])] * 2
    assert judge(df.limit(0), model).count() == 0
