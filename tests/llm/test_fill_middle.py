import hashlib

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from tellmark.llm.fill_middle import ORACLES, RUN, fill_middle, op13_fill_middle, restore


def brute(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_equal_to_the_sql_on_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op13_fill_middle(spark, sf)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(ORACLES["op13_fill_middle"]).select(*names).fetchall())


def test_hard_texts_are_arranged_and_put_back(spark):
    texts = [None, "", "a", "<", "<<P", "S>x<", "a<P>b", "<M>", "\n\r \u0085\x00", "é👍🏽é" * 9, "<<<" * 200, "S>P>M>" * 90,
             "x" * RUN, "y" * (RUN - 1), "z" * (RUN + 1), "ab\n" * (2 * RUN), "😀" * 300_000]
    rows = [Row(doc_id=None if k == 3 else 100 * k + i, text=t, form="q", N=1, output=t) for i, t in enumerate(texts) for k in range(12)]
    rows += rows[:20]
    df = spark.createDataFrame(rows)
    found = fill_middle(df)
    back = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restore(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[1])
    want = sorted((brute(r.doc_id, r.text) for r in rows), key=key)
    assert sorted((tuple(r)[:6] for r in back), key=key) == want
    assert sorted(r.back for r in back) == sorted(r.text or "" for r in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle(df.limit(0)).count() == 0


def test_foreign_sentinels_are_not_restored(spark):
    df = spark.createDataFrame([("<S>a<P>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "psm"), ("abc", "spm"), ("abc", "other")], "o string, f string")
    assert [r[0] for r in df.select(restore(F.col("o"), F.col("f"))).collect()] == [None, None, "acb", None, None]


def test_no_python_and_no_shuffle(spark):
    plan = op13_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
