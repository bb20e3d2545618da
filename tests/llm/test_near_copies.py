import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import Row

from tellmark.llm import components as C
from tellmark.llm import near_copies as N
from tellmark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [tuple(WORD.findall(t or "")) for _, t in rows]
    grams = {w: frozenset(w[i : i + 5] for i in range(len(w) - 4)) for w in set(words)}
    up = {w: w for w in grams}

    def root(w):
        while up[w] != w:
            w = up[w]
        return w

    links = Counter()
    by_gram = defaultdict(set)
    for w, g in grams.items():
        for x in g:
            by_gram[x].add(w)
    for w, g in grams.items():
        for other in {o for x in g for o in by_gram[x] if o < w}:
            both = len(g & grams[other])
            if 10 * both >= 8 * (len(g) + len(grams[other]) - both):
                links[w] += 1
                links[other] += 1
                up[root(w)] = root(other)
    least = {}
    key = lambda d: (d is None, d or 0)
    for (d, _), w in zip(rows, words):
        r = root(w)
        least[r] = d if r not in least else min(least[r], d, key=key)
    n = Counter(words)
    return [(d, least[root(w)], n[w], links[w]) for (d, _), w in zip(rows, words)]


def got(df):
    return sorted(((r[0], r.class_id, r.n_copies, r.n_links) for r in df.collect()), key=str)


def families(seed, sizes):
    rng = random.Random(seed)
    texts = []
    for n in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 160))]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy))
    return texts


def test_links_and_classes_match_brute_force(spark, monkeypatch):
    texts = families(4, [1, 2, 3, 40, 5, 7, 1]) + ["a b c", "a b  c", "", " \n", "é ü ß q r s", "é ü ß q r s t"]
    rows = list(enumerate(texts, 5)) + [(None, texts[3]), (None, None), (2, texts[9]), (2, texts[60] if len(texts) > 60 else "z"), (3, "long " * 30000)]
    df = spark.createDataFrame([Row(ID=d, body=t, T=1, key=2) for d, t in rows])
    for block in (256, 8):
        monkeypatch.setattr(N, "BLOCK", block)
        assert got(N.near_copies(df, "ID", "body")) == sorted(brute(rows), key=str)
    kept = N.keep_one_of_each_class(df, "ID", "body")
    assert kept.columns == df.columns
    want = sorted((d for (d, c, *_) in brute(rows) if d == c), key=str)
    assert sorted((r.ID for r in kept.collect()), key=str) == want
    assert N.near_copies(df.limit(0), "ID", "body").count() == 0


def test_query_matches_brute_force_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(brute(rows), key=str)
    assert got(N.op7_ngram_jaccard_join(spark, sf)) == want
    assert any(x[3] for x in want)


def test_pruning_keeps_what_reaches_the_threshold():
    assert [N.least_matches(n) for n in (32, 160)] == sorted(N.least_matches(n) for n in (32, 160))
    rng = np.random.default_rng(0)
    signature = rng.integers(0, 2**32, (2, 160), dtype=np.uint32)
    signature[1, :132] = signature[0, :132]
    order = rng.permutation(160)
    a, _ = N.candidate_pairs(signature[:, order], np.array([50, 50]), None)
    assert len(a) == 1
    signature[1, 40:] += 1
    assert not len(N.candidate_pairs(signature[:, order], np.array([50, 50]), None)[0])


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 5), (7, 900), (900, 8), (None, 4)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    label = {}
    for u, v in edges:
        if None not in (u, v) and u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    for _ in range(200):
        for u, v in edges:
            if u in label and v in label and u != v:
                label[u] = label[v] = min(label[u], label[v])
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == label


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    names = ["doc_id", "class_id", "n_copies", "n_links"]
    want = con.sql(N.ORACLES["op7_ngram_jaccard_join"]).select(*names).fetchall()
    assert sorted(map(tuple, N.op7_ngram_jaccard_join(spark, "/root/testdata/sf0.01").select(*names).collect())) == sorted(want)


def test_signatures_of_a_large_group_are_sent_less_often_than_shingles(spark):
    members = spark.range(2000).selectExpr("1 AS key", "id AS t", "2000L AS n")
    wide = N.in_blocks(members, N.WIDE * N.BLOCK)
    assert N.in_blocks(members).count() == 8 * 2000 and wide.count() == 2 * 2000
    assert {(r.low, r.high) for r in wide.collect()} == {(0, 0), (0, 1), (1, 1)}


def test_stars_take_no_round_and_a_round_few_shuffles(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(C, "cut", lambda df: cuts.append(df) or N.cut(df))
    stars = spark.range(1, 500).selectExpr("id % 7 AS u", "id + 10 AS v")
    found = {r.node: r.label for r in components(stars).collect()}
    assert found == {i + 10: i % 7 for i in range(1, 500)} | {i: i for i in range(7)}
    assert len(cuts) == 1
    path = N.cut(spark.range(1, 500).selectExpr("id AS u", "id - 1 AS v"))
    turn = C._star(C._star(path, True), False)
    turn.collect()
    final = turn._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"(?<!Reused)Exchange hashpartitioning.*plan_id=(\d+)", final))) <= 9
