import random

import pytest
from pyspark.sql import functions as F

from tellmark import contracts as C
from tellmark.functions import scalars as S
from tellmark.operators import rounds as R

ROUND = (
    "demo string, lineup string, round_no int, side string, won boolean, status string, money_buy_end int, equip_buy_end int, "
    "equip_round_start int, players_buy_end int, players_armed_buy_end int, money_players_buy_end array<int>"
)


def row(no, side="T", won=True, status="ok", equip=25000, start=5000, players=5, armed=5, money=(1000,) * 5, lineup="a", total=5000):
    return ("d", lineup, no, side, won, status, total, equip, start, players, armed, None if money is None else list(money))


def kinds(spark, rows):
    df = R.classify(spark.createDataFrame(rows, ROUND), ["demo", "lineup"])
    return {r.round_no: r.round_type for r in df.collect()}


CASES = {
    "pistol": (dict(no=13), dict(no=12), "pistol"),
    "overtime": (dict(no=25), dict(no=24), "ot"),
    "unread": (dict(no=5, equip=None), dict(no=4), None),
    "bad status": (dict(no=5, status="late"), dict(no=4), None),
    "falling value": (dict(no=5, equip=4000), dict(no=4), "anomaly"),
    "full": (dict(no=5, equip=20000), dict(no=4, won=False), "full"),
    "half even rounding": (dict(no=5, equip=19998, start=0, armed=5), dict(no=4, won=False), "full"),
    "no predecessor": (dict(no=5, equip=9000), dict(no=3, won=False), "anomaly"),
    "other side before": (dict(no=5, equip=9000), dict(no=4, won=False, side="CT"), "anomaly"),
    "unknown result before": (dict(no=5, equip=9000), dict(no=4, won=None), "anomaly"),
    "low after a win": (dict(no=5, equip=10000), dict(no=4), "anomaly"),
    "normal after a win": (dict(no=5, equip=10004), dict(no=4), "full"),
    "eco": (dict(no=5, equip=9000, start=5000), dict(no=4, won=False), "eco"),
    "few armed": (dict(no=5, equip=15000, start=5000, armed=2), dict(no=4, won=False), "eco"),
    "force": (dict(no=5, equip=15000, start=5000, armed=4), dict(no=4, won=False), "force"),
    "half": (dict(no=5, equip=15000, start=5000, armed=4, money=(2500,) * 3 + (0, 0)), dict(no=4, won=False), "half"),
    "money resets": (dict(no=12, equip=15000, start=5000, armed=4, money=(9000,) * 5), dict(no=11, won=False), "force"),
    "no balances": (dict(no=5, equip=15000, start=5000, money=None), dict(no=4, won=False), None),
    "a null balance": (dict(no=5, equip=15000, start=5000, money=(1, None, 1, 1, 1)), dict(no=4, won=False), None),
    "counters disagree": (dict(no=5, equip=15000, start=5000, players=4), dict(no=4, won=False), None),
    "two readable": (dict(no=5, equip=6000, start=0, players=2, armed=2, money=(3000, 3000)), dict(no=4, won=False), "half"),
}


@pytest.mark.parametrize("name", CASES)
def test_classification(spark, name):
    this, before, want = CASES[name]
    assert kinds(spark, [row(**this), row(**before)])[this["no"]] == want


def test_all_cases_at_once_agree_with_single_ones(spark):
    rows = []
    for k, (this, before, _) in enumerate(CASES.values()):
        rows += [row(**this, lineup=str(k)), row(**before, lineup=str(k))]
    df = R.classify(spark.createDataFrame(rows, ROUND), ["demo", "lineup"])
    got = {(int(r.lineup), r.round_no): r.round_type for r in df.collect()}
    assert all(got[(k, this["no"])] == want for k, (this, _, want) in enumerate(CASES.values()))


def test_loss_counts_clamp_and_reset(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(20):
        c, side, won = 1, None, None
        for no in range(1, 31):
            now = "T" if (no - 1) // 12 % 2 == 0 else "CT"
            if side != now:
                c = 1
            elif won is True:
                c = max(0, c - 1)
            elif won is False:
                c = min(4, c + 1)
            want[(str(t), no)] = c
            side, won = now, rng.choice([True, False, False, None])
            rows.append(row(no, side=now, won=won, lineup=str(t)))
    rng.shuffle(rows)
    got = {(r.lineup, r.round_no): r.loss_count for r in R.loss_counts(spark.createDataFrame(rows, ROUND), ["demo", "lineup"]).collect()}
    assert got == want


def test_opponent_samples_buy_end_and_contact(spark):
    two = spark.createDataFrame([("d", "a", 1, "eco"), ("d", "b", 1, "full"), ("d", "a", 2, "half")], "demo string, team string, round_no int, round_type string")
    assert {(r.team, r.round_no): r.opp_round_type for r in R.with_opponent(two, ["demo"], "team").collect()} == {("a", 1): "full", ("b", 1): "eco", ("a", 2): None}
    rounds = spark.createDataFrame([("d", 1, 100, 500), ("d", 2, 1000, None), ("d", 3, 2000, 2600)], "demo string, round_raw int, freeze_end_tick int, end_tick int")
    ticks = sorted((r.round_raw, r.sample_t_s, r.tick) for r in R.sample_ticks(rounds, [6, 3, 6, 0.0390625], 64).collect())
    assert ticks == [(1, 0.0390625, 102), (1, 3.0, 292), (1, 6.0, 484), (3, 0.0390625, 2002), (3, 3.0, 2192), (3, 6.0, 2384)]
    deaths = spark.createDataFrame([("d", 150, "A", "B", "T", "CT", "ak47"), ("d", 1000, "A", "B", "T", "CT", " ")], "demo string, tick int, attacker_id string, victim_id string, attacker_side string, victim_side string, weapon string")
    ends = {r.round_raw: r.buy_end_tick for r in R.buy_end(rounds, deaths, ["demo"], 1280).collect()}
    assert ends == {1: 149, 2: 1000, 3: 2600}
    hurts = spark.createDataFrame([("d", 120, "A", "A", "T", "T", "ak47"), ("d", 130, "A", "B", "T", "CT", "weapon_HEgrenade"), ("d", 2100, "A", "B", "T", "CT", "ak47"), ("d", 2050, None, "B", None, "CT", "ak47")], deaths.schema)
    contact = {r.round_raw: r.contact_tick for r in R.first_contact(rounds, hurts, deaths, ["demo"], ["hegrenade"]).collect()}
    assert contact == {1: 150, 2: None, 3: 2100}


def test_scalars(spark):
    df = spark.createDataFrame([("x-1-2", " weapon_AK47 ", "2026-01-02T23:30:00-01:00", "76561198000000001", 5), ("plain", " ", "2026-01-02T23:30:00", "123", None)], "u string, w string, t string, s string, n int")
    a, b = df.orderBy(F.desc("u")).select(
        S.match_of(F.col("u")), S.unit_number(F.col("u")), S.weapon_name(F.col("w")), S.blank_to_null(F.col("w")), S.utc_date(F.col("t")).cast("string"),
        S.is_steam_id(F.col("s")), S.sure_maps(F.col("n")), S.best_of(F.lit("12")), S.recode(F.col("u"), {"plain": "p"}), S.enum_rank(F.lit("CT"), C.SIDES),
        S.seconds_bucket(F.lit(float("nan")), [5, 10]), S.available(F.col("n"), F.lit(None)), S.id_text(F.lit(7)), S.moment(F.lit(0)),
        S.finite_point(F.lit(1.0), F.lit(float("inf"))), S.ladder([1, 2, 3], F.lit(9)),
    ).collect()
    assert tuple(a) == ("x", 2, "ak47", "weapon_AK47", "2026-01-03", True, 3, None, "x-1-2", 1, "unknown", 5, "7", None, False, 3)
    assert tuple(b)[:9] == ("plain", None, None, None, None, False, None, None, "p")
    assert S.bucket_labels([5, 10, 20]) == ["0-5", "5-10", "10-20", "20+"]
    with pytest.raises(ValueError):
        S.bucket_labels([5, 5])


def test_contracts(spark):
    cloud = spark.createDataFrame([("d", 1, 2, 3, "A", 4)], C.CLOUD)
    assert C.conform(cloud.select("area", "observations", "map_demo_id", "cell_z", "cell_y", "cell_x"), C.CLOUD).columns == C.schema(C.CLOUD).names
    for bad, word in ((cloud.drop("area"), "missing"), (cloud.withColumn("q", F.lit(1)), "extra"), (cloud.withColumn("area", F.lit(1)), "type")):
        with pytest.raises(ValueError, match=word):
            C.conform(bad, C.CLOUD)
    keys = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "a int, b int")
    assert {tuple(r) for r in C.duplicate_keys(keys, ["a", "b"]).collect()} == {(1, 1, 2), (2, None, 1)}


def test_rounds_of_orders_are_classified_in_one_shuffle_whose_partitions_follow_the_rows(spark, capsys, monkeypatch):
    from tellmark import session
    from tellmark.plans import game

    game.classified_rounds(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    rows = spark.range(1000)
    assert session.dealt(rows, 1000, "id", each=10).rdd.getNumPartitions() == 100
    assert session.dealt(rows, 1000, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_throws_meet_their_rounds_in_partitions_that_follow_the_throws(spark, capsys, monkeypatch):
    import re
    from functools import partial

    from tellmark.plans import game

    monkeypatch.setattr(game, "dealt", partial(game.dealt, each=100))
    game.utility_uses(spark, "/root/testdata/sf0.001").explain()
    by_round = re.findall(r"Exchange hashpartitioning\(map_demo_id#\d+, round_no#\d+, (\d+)\)", capsys.readouterr().out)
    assert by_round and all(int(n) >= 50 for n in by_round)
