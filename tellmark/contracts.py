"""Table contracts: fixed schemas, and checks of the data that return the rows which break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

ROUNDS = (
    "map_demo_id string, round_raw int, round_no int, lineup_key string, side string, won boolean, win_reason string, "
    "money_buy_end int, money_spent int, equip_buy_end int, equip_round_start int, players_buy_end int, "
    "money_players_buy_end array<int>, players_armed_buy_end int, players_armored_buy_end int, survivors int, "
    "survivors_equip_prev int, freeze_end_tick int, buy_end_tick int, tick_rate float, status string"
)
TICKS = (
    "map_demo_id string, round_no int, lineup_key string, player_id string, side string, sample_kind string, "
    "sample_t_s double, t_s double, x float, y float, z float, area string, is_alive boolean"
)
EVENTS = (
    "map_demo_id string, round_no int, event_kind string, grenade_no int, grenade_entity_id int, grenade_type string, "
    "thrower_id string, lineup_key string, side string, t_s double, x float, y float, z float, area string, "
    "area_source string, snap_distance float"
)
CLOUD = "map_demo_id string, cell_x int, cell_y int, cell_z int, area string, observations int"
#: Category orders; text would sort by letter.
SIDES, EVENT_KINDS, SAMPLE_KINDS = ["T", "CT"], ["grenade_thrown", "grenade_detonate"], ["time", "first_contact"]


def schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def conform(df: DataFrame, contract: str) -> DataFrame:
    """The columns of a contract in its order; missing, extra and differently typed columns are an error, in this order."""
    want = {f.name: f.dataType for f in schema(contract).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    for what, names in (
        ("missing", sorted(want.keys() - have.keys())),
        ("extra", sorted(have.keys() - want.keys())),
        ("of another type", sorted(k for k in want if k in have and have[k] != want[k])),
    ):
        if names:
            raise ValueError(f"columns {what}: {', '.join(names)}")
    return df.select(*want)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or with a null part, and how often."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def wrong_row_counts(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys that don't have exactly so many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != rows)


def uneven_sums(parts: DataFrame, by: list[str], part: str, total: str) -> DataFrame:
    """Groups whose parts don't add up to their total."""
    sums = parts.groupBy(*by).agg(F.sum(part).alias("parts"), F.min(total).alias("low"), F.max(total).alias("high"))
    return sums.where((F.col("parts") != F.col("low")) | (F.col("low") != F.col("high")))


def score_jumps(rounds: DataFrame, by: list[str], order: str, score: str) -> DataFrame:
    """Rounds whose score is more than one above the round before; a drop is a restart and allowed."""
    from pyspark.sql import Window

    before = F.lag(score).over(Window.partitionBy(*by).orderBy(order))
    return rounds.withColumn("_before", before).where(F.col(score) - F.col("_before") > 1).drop("_before")
