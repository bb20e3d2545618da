import hashlib
import re
from collections import defaultdict

import duckdb
from pyspark.sql import Row

from tellmark.llm.substrings import ORACLES, dedup_substrings, op5_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    least = defaultdict(lambda: float("inf"))
    key = lambda d: float("inf") if d is None else d
    for d, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - size + 1):
            least[tuple(w[i : i + size])] = min(least[tuple(w[i : i + size])], key(d))
    out = []
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < key(d):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows_of(df):
    return sorted(
        ((r[0], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_text"]) for r in df.collect()),
        key=str,
    )


def test_small_cases_match_brute_force(spark):
    shared = "a b c d e f"
    rows = [
        (1, f"x {shared} y"),
        (2, f"{shared} {shared} é\x1cz  {shared}"),
        (2, f"tail {shared}"),
        (3, None),
        (4, ""),
        (None, shared),
        (None, shared + " q"),
        (5, "a b"),
        (6, "\tb c d e \n f x " * 50),
    ]
    df = spark.createDataFrame([Row(doc_id=d, text=t, ID=1, grp=2) for d, t in rows])
    for size in (3, 4):
        assert rows_of(dedup_substrings(df, size=size)) == sorted(brute(rows, size), key=str)
    assert dedup_substrings(df.limit(0)).count() == 0


def test_whole_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 13)}
    got = {r[0]: tuple(r[1:]) for r in op5_substring_dedup(spark, sf).collect()}
    assert got == want and any(g for _, g, _ in want.values())


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = con.sql(ORACLES["op5_substring_dedup"]).select(*names).fetchall()
    assert sorted(map(tuple, op5_substring_dedup(spark, "/root/testdata/sf0.01").select(*names).collect())) == sorted(want)
