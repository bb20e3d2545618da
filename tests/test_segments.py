import random

import pytest

from tellmark.operators import segments as G


def plain_pairs(anchors, ends):
    out, pending, i = [], [], 0
    for tick, no in ends:
        while i < len(anchors) and anchors[i] < tick:
            pending.append(anchors[i])
            i += 1
        out += [(a, None, None) for a in pending[:-1]]
        out.append((pending[-1] if pending else None, tick, no))
        pending = []
    return out + [(a, None, None) for a in anchors[i:]]


def test_anchors_and_ends(spark):
    rng = random.Random(12)
    a, e, want = [], [], []
    for d in range(25):
        anchors = sorted(rng.sample(range(0, 400, 10), rng.randint(0, 8)))
        ends = [(t, k) for k, t in enumerate(sorted(rng.sample(range(5, 400, 10), rng.randint(0, 6))), 1)]
        a += [(d, t) for t in anchors]
        e += [(d, t, k) for t, k in ends]
        want += [(d, *x) for x in plain_pairs(anchors, ends)]
    pairs = G.pair_anchors(spark.createDataFrame(a, "d int, tick int"), spark.createDataFrame(e, "d int, tick int, round int"), ["d"])
    assert sorted(((r.d, r.freeze_end_tick, r.end_tick, r["round"]) for r in pairs.collect()), key=str) == sorted(want, key=str)


def test_numbers(spark):
    rows = [("a", t, n) for t, n in enumerate([None, None, 3, 4, None, 6, None, 7, None])] + [("b", 1, None), ("b", 2, None)]
    df = spark.createDataFrame(rows, "d string, at int, round int")
    got = {(r.d, r.at): r.round_raw for r in G.number_segments(df, ["d"]).collect()}
    assert [got[("a", t)] for t in range(9)] == [1, 2, 3, 4, 5, 6, None, 7, 8] and got[("b", 2)] == 2


def test_sides_follow_growing_lineups(spark):
    rows = []
    def add(no, t, ct):
        rows.extend([("d", no, "T", p) for p in t] + [("d", no, "CT", p) for p in ct])
    add(1, "abc", "xyz")
    add(2, "abd", "xyw")
    add(3, "xyw", "abd")
    add(4, "w", "d")
    add(5, "q", "r")
    got = {r.no: r.first_side for r in G.assign_sides(spark.createDataFrame(rows, "demo string, no int, side string, player_id string"), "demo", "no").collect()}
    assert got == {1: "T", 2: "T", 3: "CT", 4: "CT", 5: "CT"}
    bad = spark.createDataFrame([("d", 1, "T", "a")], "demo string, no int, side string, player_id string")
    with pytest.raises(Exception, match="one side only"):
        G.assign_sides(bad, "demo", "no").collect()


def test_economy_and_snapshots(spark):
    shape = "r int, side string, steamid string, balance int, cash_spent int, equip_current int, equip_round_start int, armor_value int, inventory array<string>"
    rows = [(1, "T", "a", 100, 5, 7, 1, 100, ["ak47"]), (1, "T", "b", 300, 5, 7, 1, 0, ["ak47"]), (1, "T", "c", None, 1, 1, 1, None, None), (1, "CT", "x", 1, 1, 1, 1, None, ["m4"]), (2, "T", "a", None, 1, 1, 1, 1, [])]
    df = spark.createDataFrame(rows, shape)
    got = {(r.r, r.side): r for r in G.economy_sums(df, ["r", "side"], ["ak47", "m4"]).collect()}
    t = got[(1, "T")]
    assert (t.money_buy_end, t.money_players_buy_end, t.players_buy_end, t.players_armed_buy_end, t.players_armored_buy_end) == (400, [300, 100], 2, 1, 1)
    assert got[(1, "CT")].players_armed_buy_end is None and (2, "T") not in got
    later = spark.createDataFrame([(1, "T", "a", 50, 55, 9, 1, 100, ["ak47"]), (1, "T", "b", 300, 5, 9, 1, 0, ["ak47"]), (1, "CT", "x", 1, 0, 1, 1, None, None)], shape)
    assert tuple(G.later_purchases(df, later, ["r", "steamid"]).first()) == (3, 1)
    assert tuple(G.refunds_and_stale(df, later, ["r", "steamid"]).first()) == (1, 1)


def test_rates_and_names(spark):
    times = spark.createDataFrame([("a", k * 64, k * 1.0) for k in range(9)] + [("b", 0, 0.0), ("b", 5, 5.0)], "d string, tick int, seconds double")
    assert {r.d: r.tick_rate for r in G.tick_rate(times, ["d"]).collect()} == {"a": 64.0, "b": 64.0}
    callouts = spark.createDataFrame([("nuke", "Hut", "hut", True, "inferred"), ("nuke", "Ramp", "ramp", False, "sure")], "map_name string, area string, callout string, coarse boolean, confidence string")
    rows = spark.createDataFrame([("nuke", "Hut", "Pit"), ("nuke", None, "Ramp"), ("dust2", "Hut", "Ramp")], "map_name string, a string, b string")
    got = {(r.a, r.b): (r.a_flag, r.b_flag) for r in G.named_areas(rows, callouts, ["a", "b"]).collect()}
    assert got == {("hut", "Pit"): ("coarse_inferred", "no_callout"), (None, "ramp"): (None, None), ("Hut", "Ramp"): ("no_table", "no_table")}
