"""Tables that change together: all of a generation or none of it, and units that are made again only when their inputs changed.

A generation is a folder of its own; a pointer file that is renamed into place last
says which one counts. A job that dies before leaves the old generation as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"
MANIFEST = "unit string, digest string, params string, status string"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file beside the target, renamed over it: readers see the old text or the new one (where the store renames in one step)."""
    jvm, target = spark._jvm, path
    context, to = _files(spark, target)
    part = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    opts = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    opts[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    out = context.create(part, flags, opts)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, to, how)


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: generation and tables; null before the first one."""
    context, at = _files(spark, f"{root}/{POINTER}")
    if not context.util().exists(at):
        return None
    rows = spark.read.text(f"{root}/{POINTER}", wholetext=True).collect()  # one small file
    return json.loads(rows[0][0])


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], fmt: str = "parquet", **facts: str) -> str:
    """Write all tables into a new generation, then let the pointer name it; what fails before changes nothing for readers.

    Tables may be made from the generation that counts now. ``facts`` are kept with
    the pointer. Old generations stay until ``sweep``.
    """
    name = f"generation-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.format(fmt).save(f"{root}/{name}/{table}")
    _write_text(spark, f"{root}/{POINTER}", json.dumps({"generation": name, "format": fmt, "tables": sorted(tables), "facts": facts}, sort_keys=True))
    return name


def read(spark: SparkSession, root: str, table: str, schema: str | None = None) -> DataFrame:
    """A table of the generation that counts; a reader that began keeps its generation's files."""
    found = current(spark, root)
    if found is None or table not in found["tables"]:
        raise FileNotFoundError(f"no generation under {root} has {table}")
    reader = spark.read.format(found["format"])
    return (reader.schema(schema) if schema else reader).load(f"{root}/{found['generation']}/{table}")


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Remove the generations that don't count, also those that a dead job left; their names. For times without readers of old ones."""
    found = current(spark, root)
    context, at = _files(spark, root)
    gone = []
    if context.util().exists(at):
        for status in context.util().listStatus(at):
            name = status.getPath().getName()
            if name.startswith("generation-") and (found is None or name != found["generation"]):
                context.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)


def stale_units(digests: DataFrame, manifest: DataFrame, params: str) -> DataFrame:
    """(unit, reason): units whose result is not current, by an anti-join on all that a result depends on.

    new (never made), failed, params or digest (what changed), gone (no input any more).
    A null digest is a digest. ``digests`` has unit and digest, one row per unit.
    """
    now = digests.select("unit", F.col("digest").alias("_now"), F.lit(True).alias("_here"))
    was = manifest.select("unit", "digest", "params", "status", F.lit(True).alias("_was"))
    both = now.join(was, "unit", "full")
    reason = (
        F.when(F.col("_here").isNull(), "gone").when(F.col("_was").isNull(), "new").when(F.col("status") != "ok", "failed")
        .when(~F.col("params").eqNullSafe(F.lit(params)), "params").when(~F.col("digest").eqNullSafe(F.col("_now")), "digest")
    )
    return both.select("unit", reason.alias("reason")).where("reason IS NOT NULL")


def refresh(
    spark: SparkSession, digests: DataFrame, params: str, make: Callable[[DataFrame], DataFrame], path: str, root: str
) -> int:
    """Make the stale units' results anew and write them, and only them; the number of stale units.

    ``make`` takes the stale units (unit) and returns rows with unit; whole
    partitions of ``path`` are replaced, others are not touched. A unit that is
    gone loses its manifest row, its partition stays for who removes it. The
    manifest is a generation under ``root``, published after the results: a job
    that dies in between makes the same units again.
    """
    manifest = read(spark, root, "manifest", MANIFEST) if current(spark, root) else spark.createDataFrame([], MANIFEST)
    stale = stale_units(digests, manifest, params)
    units = stale.where("reason <> 'gone'").select("unit")
    count = stale.count()
    if not count:
        return 0
    results = make(units)
    results.write.mode("overwrite").partitionBy("unit").option("partitionOverwriteMode", "dynamic").parquet(path)
    fresh = digests.join(units, "unit", "left_semi").select("unit", "digest", F.lit(params).alias("params"), F.lit("ok").alias("status"))
    kept = manifest.join(stale.select("unit"), "unit", "left_anti")
    publish(spark, root, {"manifest": kept.unionByName(fresh)})
    return count
