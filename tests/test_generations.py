from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tellmark.sources import generations as G


def test_all_tables_or_none(spark, tmp_path):
    root = f"{tmp_path}/archive"
    with pytest.raises(FileNotFoundError):
        G.read(spark, root, "a")
    old = {n: spark.createDataFrame([(n, k)], "n string, k int") for n, k in zip("abcdefg", range(7))}
    first = G.publish(spark, root, old, stamp="1")
    assert {n: G.read(spark, root, n).collect() for n in old} == {n: df.collect() for n, df in old.items()}
    reader = G.read(spark, root, "a")
    bad = {n: df.withColumn("k", F.col("k") + 1) for n, df in old.items()} | {"d": old["d"].withColumn("k", F.raise_error(F.lit("killed")).cast("int"))}
    with pytest.raises(Exception, match="killed"):
        G.publish(spark, root, bad)
    assert G.current(spark, root)["generation"] == first and G.current(spark, root)["facts"] == {"stamp": "1"}
    assert {n: G.read(spark, root, n).first().k for n in old} == dict(zip("abcdefg", range(7)))
    # a generation made from the one that counts
    second = G.publish(spark, root, {n: G.read(spark, root, n).withColumn("k", F.col("k") * 10) for n in old})
    assert reader.first().k == 0 and G.read(spark, root, "g").first().k == 60
    gone = G.sweep(spark, root)
    assert first in gone and len(gone) == 2 and G.read(spark, root, "b").first().k == 10 and G.current(spark, root)["generation"] == second


def test_only_changed_units_are_made_again(spark, tmp_path):
    path, root = f"{tmp_path}/results", f"{tmp_path}/manifest"
    digest = lambda changed: spark.createDataFrame([(f"u{k}", f"d{k}{'x' if k in changed else ''}") for k in range(20)], "unit string, digest string")
    asked = []

    def make(units):
        asked.append(sorted(r.unit for r in units.collect()))
        return units.withColumn("v", F.length("unit"))

    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert G.refresh(spark, digest(()), "p1", make, path, root) == 20
    before = files()
    assert G.refresh(spark, digest(()), "p1", make, path, root) == 0 and len(asked) == 1 and files() == before
    assert G.refresh(spark, digest((7,)), "p1", make, path, root) == 1 and asked[-1] == ["u7"]
    after = files()
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all("unit=u7" in str(p) for p in changed)
    assert spark.read.parquet(path).count() == 20
    # parameters, failures, new and gone units
    few = digest((7,)).where("unit IN ('u1', 'u2')").unionByName(spark.createDataFrame([("new", None)], "unit string, digest string"))
    manifest = G.read(spark, root, "manifest").withColumn("status", F.when(F.col("unit") == "u2", "failed").otherwise(F.col("status")))
    assert {(r.unit, r.reason) for r in G.stale_units(few, manifest.where("unit IN ('u1', 'u2', 'u3')"), "p1").collect()} == {("u2", "failed"), ("u3", "gone"), ("new", "new")}
    assert {r.reason for r in G.stale_units(digest((7,)), G.read(spark, root, "manifest"), "p2").collect()} == {"params"}
    assert G.refresh(spark, digest((7,)).where("unit <> 'u0'"), "p1", make, path, root) == 1 and G.read(spark, root, "manifest").count() == 19


def test_a_run_that_dies_before_the_manifest_is_made_again(spark, tmp_path, monkeypatch):
    path, root = f"{tmp_path}/results", f"{tmp_path}/manifest"
    one = spark.createDataFrame([("u", "d")], "unit string, digest string")
    with monkeypatch.context() as m:
        m.setattr(G, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            G.refresh(spark, one, "p", lambda u: u.withColumn("v", F.lit(1)), path, root)
    assert G.current(spark, root) is None
    assert G.refresh(spark, one, "p", lambda u: u.withColumn("v", F.lit(2)), path, root) == 1
    assert spark.read.parquet(path).collect()[0].v == 2
