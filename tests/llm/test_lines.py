import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tellmark.llm import lines as L

BLANKS = " \t\n\r\x0b\x0c"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("ab\xe9", max_size=14), st.text("ab\xe9", max_size=14), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_edit_distance(a, b, limit):
    assert L.edit_distance(a, b, limit) == min(distance(a, b), limit + 1)
    assert L.near(a, b, limit) == (distance(a, b) <= limit)


@given(st.text("abc", min_size=6, max_size=20), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.sampled_from("abc")), max_size=2))
@settings(max_examples=400, deadline=None)
def test_segments_never_miss_a_near_line(a, changes):
    b = a
    for kind, at, c in changes:
        at %= len(b) + 1
        b = b[:at] + ("" if kind == 0 else c) + b[at + (kind != 1) :]
    x, y = sorted((a, b), key=len)
    if len(x) >= 3:
        assert L.first_segment(x, y, 2) >= 0


def brute(rows, edits, min_chars, per_edit=8):
    key = lambda d: float("inf") if d is None else d
    found = []
    for d, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            s = line.strip(BLANKS)
            if len(s) >= min_chars:
                found.append((key(d), no, s))
    texts = sorted({s for *_, s in found})
    least = {s: min((d, n) for d, n, t in found if t == s) for s in texts}
    near = {s: [t for t in texts if t != s and abs(len(s) - len(t)) <= edits and distance(s, t) <= min(edits, min(len(s), len(t)) // per_edit)] for s in texts}
    out = []
    for d, text in rows:
        n = gone = links = 0
        kept = []
        for no, line in enumerate((text or "").split("\n")):
            s = line.strip(BLANKS)
            if len(s) < min_chars:
                kept.append(line)
                continue
            n, links = n + 1, links + len(near[s])
            if min([least[s], *(least[t] for t in near[s])]) < (key(d), no):
                gone += 1
            else:
                kept.append(line)
        out.append((d, n, gone, links, None if text is None else "\n".join(kept)))
    return out


def test_small_cases_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(7, 20))) for _ in range(14)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            s[rng.randrange(len(s))] = rng.choice(["", "a", "xy", "é"])
        return rng.choice(["", " ", "\t"]) + "".join(s) + rng.choice(["", "  "])

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(None, rows[3][1]), (None, None), (100, None), (101, ""), (102, "short\n\n " + base[0]), (103, base[1] * 400)]
    df = spark.createDataFrame([Row(ID=d, C0=5, body=t, _gone=1) for d, t in rows])
    for block, per in ((256, 8), (4, 8), (256, 3)):
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.dedup_lines(df, "ID", "body", 2, 8, per)
        assert got.columns == ["ID", "C0", "body", "_gone", "n_lines", "n_removed", "n_links"]
        assert sorted(((r.ID, r.n_lines, r.n_removed, r.n_links, r.body) for r in got.collect()), key=str) == sorted(brute(rows, 2, 8, per), key=str)
    assert L.dedup_lines(df.limit(0), "ID", "body").count() == 0
    twice = spark.createDataFrame([Row(doc_id=1, text=base[0])] * 2 + [Row(doc_id=1, text="other\n" + base[0])])
    assert sorted(r.n_removed for r in L.dedup_lines(twice, min_chars=8).collect()) == [1, 1, 1]


def test_query_matches_brute_force_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    firsts, want = {}, {}
    for d, text in sorted(rows):
        for no, line in enumerate(text.split("\n")):
            firsts.setdefault(line.strip(BLANKS), (d, no))
    got = {r.doc_id: r for r in L.op9_line_dedup(spark, sf).collect()}
    linked = [d for d, r in got.items() if r.n_links]
    for d, text in rows:
        if got[d].n_links == 0:  # then exact repeats alone decide
            kept = [x for no, x in enumerate(text.split("\n")) if len(x.strip(BLANKS)) < L.MIN_CHARS or firsts[x.strip(BLANKS)] == (d, no)]
            want[d] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
            assert got[d].kept_sha256 == want[d]
    texts = sorted({x.strip(BLANKS) for _, t in rows for x in t.split("\n") if len(x.strip(BLANKS)) >= L.MIN_CHARS}, key=len)
    pairs = 0
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            pairs += L.near(a, b, min(2, len(a) // 8))
    assert pairs == 0 or linked


def test_short_lines_are_compared_too(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join("".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9))) for _ in range(4))) for i in range(40)]
    rows += [(50, "All rights reserved.\nab\nx"), (51, "All rights reserved.\n ab\ny"), (52, "All right reserved\nabcd\n \nx")]
    flat = [(d, no, x.strip(BLANKS)) for d, text in rows for no, x in enumerate(text.split("\n")) if x.strip(BLANKS)]
    texts = {s for *_, s in flat}
    least = {s: min((d, n) for d, n, t in flat if t == s) for s in texts}
    near = {s: [t for t in texts if t != s and distance(s, t) <= min(2, min(len(s), len(t)) // 8)] for s in texts}
    want = {d: [0, 0, 0] for d, _ in rows}
    for d, no, s in flat:
        gone = min([least[s], *(least[t] for t in near[s])]) < (d, no)
        want[d] = [a + b for a, b in zip(want[d], (1, gone, len(near[s])), strict=True)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.n_lines, r.n_removed, r.n_links] for r in got} == want
    assert want[51][1] >= 2 and want[52][1] >= 2


def test_many_different_short_lines_take_no_longer_than_long_ones(spark):
    """100,000 numbers of six digits: two edits would join most of them, equality joins none."""
    numbers = random.Random(1).sample(range(10**5, 10**6), 100_000)
    rows = [(d, "\n".join(map(str, numbers[1000 * d : 1000 * (d + 1)]))) for d in range(100)] + [(200, str(numbers[5]) + "\nnew line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links) for r in L.dedup_lines(df).collect()}
    took = time.perf_counter() - began
    print(took)
    assert got == {d: (1000, 0, 0) for d in range(100)} | {200: (2, 1, 0)}
    assert took < 60
