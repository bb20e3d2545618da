"""Reading and writing an archive of tables: contracts on the way in, whole partitions on the way out, and result manifests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.contracts import conform, schema


def read_table(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """A Parquet table under its contract: declared types, canonical order; partitions and columns are pruned by the plan."""
    return conform(spark.read.schema(schema(contract)).parquet(path), contract)


def write_tables(tables: dict[str, tuple[DataFrame, str]], unit: str) -> None:
    """Write tables by unit; units that a table doesn't hold stay as they are.

    All plans are checked against their schemas before the first is written, each
    write replaces whole partitions through Spark's commit protocol.
    """
    for name, (df, _) in tables.items():
        if unit not in df.columns:
            raise ValueError(f"{name} has no {unit}")
    for df, path in tables.values():
        df.write.mode("overwrite").partitionBy(unit).option("partitionOverwriteMode", "dynamic").parquet(path)


def lineup_members(lineups: DataFrame, unit: str, key: str = "lineup_key", member: str = "player_id") -> DataFrame:
    """(unit, key, members): each lineup's distinct members, sorted; a scan of three columns."""
    some = lineups.select(unit, key, member).where(F.col(member).isNotNull())
    return some.groupBy(unit, key).agg(F.array_sort(F.collect_set(member)).alias("members"))


MATCHES = (
    "matches array<struct<match_id: string, competition_id: string, status: string, finished_at: string, best_of: int, "
    "map_picks: array<string>, teams: array<struct<faction_id: string, name: string, roster: array<string>>>>>"
)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The match index, one row per match; entries without an id are left out."""
    doc = spark.read.schema(MATCHES).option("multiLine", True).json(path)
    return doc.select(F.explode("matches").alias("m")).select("m.*").where("match_id IS NOT NULL")


def candidate_maps(matches: DataFrame) -> DataFrame:
    """One row per match and picked map: its place, the unit's id and whether it was played for sure."""
    sure = F.floor(F.col("best_of") / 2).cast("int") + 1
    picks = matches.select("*", F.posexplode("map_picks").alias("map_index", "map_name"))
    return picks.withColumn("map_demo_id", F.concat_ws("-", "match_id", (F.col("map_index") + 1).cast("string"))).withColumn(
        "certainly_played", F.coalesce(F.col("map_index") < sure, F.lit(False))
    )


def parse_matches(raw: DataFrame, column: str = "payload") -> DataFrame:
    """API replies as text to match rows; picks that are no strings are dropped, as is what can't be read."""
    shape = "struct<match_id: string, status: string, finished_at: bigint, best_of: string, voting: struct<map: struct<pick: array<string>>>>"
    one = F.from_json(column, shape)
    return raw.select(one.alias("m")).where("m.match_id IS NOT NULL").select(
        "m.match_id", "m.status", F.when(F.col("m.finished_at") > 0, F.timestamp_seconds("m.finished_at")).alias("finished_at"),
        F.when(F.col("m.best_of").try_cast("int").between(1, 9), F.col("m.best_of").try_cast("int")).alias("best_of"), F.col("m.voting.map.pick").alias("map_picks"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """A nested result as JSON lines."""
    report.write.mode("overwrite").json(path)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a few collected rows; bars and line breaks inside cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def params_hash(params: dict) -> str:
    """SHA-256 of the parameters as canonical JSON; numbers that aren't finite are an error."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """What a result was made of: inputs with their fingerprints, parameters, versions; and whether it is still current."""

    stage: str
    inputs: dict[str, str]
    params: str
    versions: dict[str, str] = field(default_factory=dict)
    status: str = "ok"
    created_at: str = ""

    def fingerprint(self) -> str:
        """Of all but the time; the next stage's input."""
        return params_hash({k: v for k, v in asdict(self).items() if k != "created_at"})

    def is_current(self, inputs: dict[str, str], params: str, versions: dict[str, str]) -> bool:
        return self.status == "ok" and (self.inputs, self.params, self.versions) == (inputs, params, versions)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))
