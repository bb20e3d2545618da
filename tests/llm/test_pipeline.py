from collections import Counter

import corpus_pipeline
from tests.llm import test_lines, test_mixing, test_near_copies, test_packing
from tellmark.llm.quality import judge, train

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_plain_python(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = [tuple(r) for r in documents.select(COLUMNS).collect()]
    steps = dict(corpus_pipeline.STAGES)
    docs, states = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        states.append((name, docs))
    rows = {name: [tuple(r) for r in df.collect()] for name, df in states}
    assert [n for n, _ in states] == list(steps) and all(df.columns == COLUMNS for _, df in states[:-1])

    verdict = {r.doc_id: r.kept for r in judge(documents, train(documents, labels)).collect()}
    good = rows["quality rules"]
    assert sorted(good) == sorted(r for r in before if verdict[r[0]])
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r in good for r in before if quality.get(r[0]) == 1 and verdict[r[0]])

    lines = {r[0]: r for r in rows["line dedup"]}
    assert lines.keys() == {r[0] for r in good}
    assert all(r[4] == len(r[1]) for r in lines.values())
    least = {}
    for d, text, *_ in sorted(good):
        for no, line in enumerate(text.split("\n")):
            least.setdefault(line.strip(test_lines.BLANKS), (d, no))
    for d, text, *_ in good:
        left = Counter(lines[d][1].split("\n")) if lines[d][1] else Counter()
        assert not left - Counter(text.split("\n"))
        for no, line in enumerate(text.split("\n")):
            key = line.strip(test_lines.BLANKS)
            if len(key) >= 32 and least[key] != (d, no):
                assert least[key][0] == d or line not in left

    classes = test_near_copies.brute([(r[0], r[1]) for r in rows["line dedup"]])
    assert sorted(r[0] for r in rows["n-gram Jaccard join"]) == sorted(d for d, c, *_ in classes if d == c)

    taken = Counter(r[0] for r in rows["mixing sources to target weights"])
    one_each = {r[0]: r for r in rows["n-gram Jaccard join"]}
    assert set(taken) <= set(one_each) and max(taken.values()) <= 3
    size, words = Counter(), Counter()
    for d, r in one_each.items():
        n = len(test_near_copies.WORD.findall(r[1] or ""))
        size[r[3]] += n
        words[r[3]] += n * taken[d]
    want = test_mixing.brute_targets(size)
    largest = max(len(r[1].split()) for r in one_each.values())
    assert all(abs(words[s] - want[s]) <= largest for s in size)

    packed = states[-1][1].collect()
    test_packing.check_packed(packed, 4096)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken


def test_run_and_registration(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
