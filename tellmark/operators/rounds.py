"""Round economy: losing streaks, carried context, and the classification of rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellmark.functions.scalars import available, can_buy, ladder, per_player
from tellmark.operators.runs import clamped_counter, contiguous_previous, mark_runs


@dataclass(frozen=True)
class Economy:
    """Fixed values of the game's economy and the classification thresholds."""

    pistol_rounds: tuple[int, ...] = (1, 13)
    regulation_rounds: int = 24
    full_equip_min: int = 4000
    force_buy_min: int = 1500
    armed_players_min: int = 3
    buy_money_min: int = 4000
    buy_players_min: int = 3
    low_equip_after_win: int = 2000
    streak_start: int = 1
    streak_min: int = 0
    streak_max: int = 4
    roster_size: int = 5
    max_money: int = 16000
    loss_bonus: tuple[int, ...] = (1400, 1900, 2400, 2900, 3400)


def loss_counts(rounds: DataFrame, by: list[str], rules: Economy = Economy()) -> DataFrame:
    """loss_count before each round: from the start value at every change of side, +1 for a loss, -1 for a win, clamped."""
    halves = mark_runs(rounds, by, ["round_no"], ["side"], "round_no", F.lit(1 << 30), "_half")
    step = F.when(F.col("won"), -1).when(~F.col("won"), 1)
    counted = clamped_counter(
        halves, [*by, "_half"], ["round_no"], step, rules.streak_min, rules.streak_max, rules.streak_start, "loss_count"
    )
    return counted.drop("_half")


def classify(rounds: DataFrame, by: list[str], rules: Economy = Economy()) -> DataFrame:
    """round_type of every round of a team, with what decided: prev_won, loss_count, equip_pp, bought_pp, buyers.

    The first rule that fits decides, as one CASE over the row and its contiguous
    predecessor: no reading -> null; pistol; overtime; a falling value ->
    anomaly; enough equipment -> full; no known predecessor -> anomaly; after a
    win low equipment is an anomaly, else full; after a loss few purchases are an
    eco; else the armed players and the balances tell eco, force and half apart.
    """
    df = contiguous_previous(loss_counts(rounds, by, rules), by, "round_no", ["side"], ["won"])
    readable = F.col("players_buy_end")
    players = F.when(readable.between(1, rules.roster_size), readable).otherwise(rules.roster_size)
    bought = F.col("equip_buy_end") - F.col("equip_round_start")
    money, armed = F.col("money_players_buy_end"), F.col("players_armed_buy_end")
    following = F.col("round_no") + 1
    carries = ~(following.isin(*rules.pistol_rounds) | (following > rules.regulation_rounds))
    bonus = ladder(list(rules.loss_bonus), F.least("loss_count", F.lit(rules.streak_max)))
    df = df.withColumn("equip_pp", F.coalesce(per_player(F.col("equip_buy_end"), players), F.lit(0)))
    df = df.withColumn("bought_pp", F.coalesce(per_player(bought, players), F.lit(0)))
    readings = F.size(money)
    complete = money.isNotNull() & (readings > 0) & ~F.exists(money, lambda m: m.isNull()) & armed.isNotNull()
    df = df.withColumn("buyers", F.when(complete & carries, can_buy(money, bonus, rules.max_money, rules.buy_money_min)))
    agree = F.coalesce((readable == readings) & (armed <= readings), F.lit(False))
    missing = F.col("money_buy_end").isNull() | F.col("equip_buy_end").isNull() | F.col("equip_round_start").isNull()
    unread = F.col("round_no").isNull() | (F.col("status").isNotNull() & (F.col("status") != "ok")) | missing
    after_loss = (
        F.when(~F.coalesce(complete, F.lit(False)) | ~agree, F.lit(None))
        .when(armed < F.least(F.lit(rules.armed_players_min), readings), "eco")
        .when(~carries, "force")
        .when(F.col("buyers") >= F.least(F.lit(rules.buy_players_min), readings), "half")
        .otherwise("force")
    )
    kind = (
        F.when(unread, F.lit(None).cast("string"))
        .when(F.col("round_no").isin(*rules.pistol_rounds), "pistol")
        .when(F.col("round_no") > rules.regulation_rounds, "ot")
        .when(bought < 0, "anomaly")
        .when(F.col("equip_pp") >= rules.full_equip_min, "full")
        .when(F.col("prev_won").isNull(), "anomaly")
        .when(F.col("prev_won") & (F.col("equip_pp") <= rules.low_equip_after_win), "anomaly")
        .when(F.col("prev_won"), "full")
        .when(F.col("bought_pp") < rules.force_buy_min, "eco")
        .otherwise(after_loss)
    )
    return df.withColumn("round_type", kind)


def reason(rules: Economy = Economy()) -> Column:
    """What decided a classified round, as text: money, equipment and purchases per player, losses, and the divisor.

    Parts that can't be read are left out; the divisor says whether it is the
    players read, fewer than a roster, or the roster because none or too many were.
    """
    read = F.col("players_buy_end")
    usable = F.coalesce(read.between(1, rules.roster_size), F.lit(False))
    players = F.when(usable, read).otherwise(rules.roster_size)
    bought = F.col("equip_buy_end") - F.col("equip_round_start")
    amounts = {
        "available": available(F.col("money_buy_end"), F.col("money_spent")), "left": F.col("money_buy_end"), "spent": F.col("money_spent"),
        "equipment": F.col("equip_buy_end"), "bought": bought,
    }
    parts = [F.concat(F.lit(f"{name} "), per_player(value, players).cast("string")) for name, value in amounts.items()]
    note = F.when(read.isNull(), ", players unread").when(~usable, F.concat(F.lit(", not by the "), read.cast("string"), F.lit(" read"))).when(
        read < rules.roster_size, F.concat(F.lit(" read of "), F.lit(str(rules.roster_size)))
    ).otherwise("")
    return F.concat_ws("; ", *parts, F.concat(F.lit("losses "), F.col("loss_count").cast("string")), F.concat(F.lit("divided by "), players.cast("string"), note))


def with_opponent(classified: DataFrame, unit: list[str], team: str) -> DataFrame:
    """opp_round_type: the other team's class of the same round; the two teams of a unit meet by an equality join."""
    keys = [*unit, "round_no"]
    other = classified.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(team).alias("_team"), F.col("round_type").alias("opp_round_type"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(team) != F.col("_team")]
    return classified.join(other, on, "left").drop(*(f"_{k}" for k in keys), "_team")


def opponent_faults(classified: DataFrame, unit: list[str], team: str) -> DataFrame:
    """(unit, round_no, teams, rows): rounds that ``with_opponent`` can't pair one to one, as a team has several rows or there are more than two teams."""
    per = classified.groupBy(*unit, "round_no").agg(F.countDistinct(team).alias("teams"), F.count(team).alias("rows"))
    return per.where((F.col("teams") > 2) | (F.col("rows") > F.col("teams")))


def sample_ticks(rounds: DataFrame, seconds: list[float], rate: float) -> DataFrame:
    """One row per round and sample second up to the round's end: tick, sample_t_s and t_s from the anchor."""
    usable = rounds.where("freeze_end_tick IS NOT NULL AND end_tick IS NOT NULL AND freeze_end_tick <= end_tick")
    points = usable.withColumn("sample_t_s", F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(seconds))))))
    points = points.withColumn("tick", F.col("freeze_end_tick") + F.bround(F.col("sample_t_s") * rate, 0).cast("int"))
    return points.where("tick <= end_tick").withColumn("t_s", (F.col("tick") - F.col("freeze_end_tick")) / F.lit(float(rate)))


def buy_end(rounds: DataFrame, deaths: DataFrame, unit: list[str], window: int) -> DataFrame:
    """buy_end_tick: the first of anchor + window, the round's end (or the next anchor less 1) and the first death less 1; never before the anchor."""
    from pyspark.sql import Window

    w = Window.partitionBy(*unit).orderBy("freeze_end_tick")
    upper = rounds.withColumn("_upper", F.coalesce("end_tick", F.lead("freeze_end_tick").over(w) - 1))
    names = {k: f"_{k}" for k in unit}
    on = [F.col(k) == F.col(n) for k, n in names.items()]
    on += [F.col("_death") >= F.col("freeze_end_tick"), (F.col("_upper").isNull()) | (F.col("_death") <= F.col("_upper"))]
    dead = deaths.select(*(F.col(k).alias(n) for k, n in names.items()), F.col("tick").alias("_death"))
    first = upper.join(dead, on, "left").groupBy(*upper.columns).agg(F.min("_death").alias("_first"))
    end = F.least(F.col("freeze_end_tick") + window, F.col("_upper"), F.col("_first") - 1)
    return first.withColumn("buy_end_tick", F.greatest("freeze_end_tick", end)).drop("_upper", "_first")


def first_contact(rounds: DataFrame, hurts: DataFrame, deaths: DataFrame, unit: list[str], excluded: list[str]) -> DataFrame:
    """contact_tick of each round: the first hurt that counts, else the first death that does.

    Both actors known, different and of opposite sides, a named weapon that isn't
    excluded, a tick within the round.
    """
    from tellmark.functions.scalars import weapon_name

    banned = [w for w in {x.strip().lower().removeprefix("weapon_") for x in excluded} if w]
    name = weapon_name(F.col("weapon"))
    counts = (
        F.col("attacker_id").isNotNull() & F.col("victim_id").isNotNull() & (F.col("attacker_id") != F.col("victim_id"))
        & F.col("attacker_side").isin("T", "CT") & F.col("victim_side").isin("T", "CT")
        & (F.col("attacker_side") != F.col("victim_side")) & name.isNotNull()
    )
    if banned:
        counts = counts & ~name.isin(*banned)
    both = hurts.withColumn("_fatal", F.lit(False)).unionByName(deaths.withColumn("_fatal", F.lit(True)), allowMissingColumns=True).where(counts)
    names = {k: f"_{k}" for k in unit}
    other = both.select(*(F.col(k).alias(n) for k, n in names.items()), F.col("tick").alias("_tick"), "_fatal")
    on = [F.col(k) == F.col(n) for k, n in names.items()] + [F.col("_tick").between(F.col("freeze_end_tick"), F.col("end_tick"))]
    joined = rounds.join(other, on, "left").groupBy(*rounds.columns)
    return joined.agg(
        F.coalesce(F.min(F.when(~F.col("_fatal"), F.col("_tick"))), F.min(F.when(F.col("_fatal"), F.col("_tick")))).alias("contact_tick")
    )
