import pytest

from tellmark.operators import report as Q
from tellmark.operators import segments as S
from tellmark.operators import throws as W

SEGMENT = "unit string, at int, round int, end_tick int"


def numbers(spark, *rounds):
    """Segments of one unit: a number, None (a boundary without an end) or 'x' (an ended segment without a number)."""
    rows = [("u", t, None if n == "x" else n, 10 * t + 1 if n is not None else None) for t, n in enumerate(rounds)]
    return S.number_rounds(spark.createDataFrame(rows, SEGMENT), ["unit"])


def test_restarts_lost_rounds_and_rounds_without_a_number(spark):
    def of(*rounds):
        df = numbers(spark, *rounds)
        return [r.round_raw for r in df.orderBy("at").collect()], sorted((r.fault, r.n) for r in S.round_faults(df, ["unit"]).collect())

    assert of(1, None, 2) == ([1, None, 2], [])
    assert of(1, "x", 3) == ([1, 2, 3], [])
    assert of(1, None, 3) == ([1, None, 3], [("jump", 1)])
    assert of(1, "x", None, 4) == ([1, 2, 3, 4], [])
    assert of(1, "x", 2) == ([1, 2, 2], [("order", 1)])
    assert of(1, None, 2, None, 3) == ([1, None, 2, None, 3], [])
    assert of(1, None, None, 2, None, 3) == ([1, None, None, 2, None, 3], [("restarts", 3)])
    assert of(None, None, 3, "x") == ([1, 2, 3, 4], [])
    assert of("x", None, "x") == ([1, 2, 3], [])
    assert of(None, 1) == ([0, 1], [])


def test_faulty_units_fail_the_job(spark):
    assert [r.round_raw for r in S.checked_rounds(numbers(spark, 1, None, 2), ["unit"]).orderBy("at").collect()] == [1, None, 2]
    with pytest.raises(Exception, match="jump at 1"):
        S.checked_rounds(numbers(spark, 1, None, 3), ["unit"]).collect()
    with pytest.raises(Exception, match="restarts at 1, 3"):
        S.checked_rounds(numbers(spark, 1, None, 2, None, 3), ["unit"], 1).collect()
    assert S.round_faults(numbers(spark, 1).limit(0), ["unit"]).count() == 0


def test_lines_of_equipment(spark):
    def lines(armed, armored, unread=(0, 0)):
        rows = [("b", m, c, n, u) for m, bars, u in (("armed", armed, unread[0]), ("armored", armored, unread[1])) for c, n in bars]
        df = spark.createDataFrame(rows, "block string, metric string, c int, n int, unread int")
        return sorted((r.metrics, [tuple(b) for b in r.bars]) for r in Q.equipment_lines(df, ["block"], "metric", "c", "n", "unread", 5, ("armed", "armored")).collect())

    assert lines([(5, 4)], [(3, 4)]) == [(["armored"], [(3, 4)])]
    assert lines([(0, 4)], [(5, 4)]) == [(["armed"], [(0, 4)])]
    assert lines([(4, 1), (5, 3)], [(5, 3), (4, 1)]) == [(["armed", "armored"], [(4, 1), (5, 3)])]
    assert lines([(5, 4)], [(5, 4)]) == [(["armed"], [(5, 4)])]
    assert lines([(5, 3)], [(5, 4)], (1, 0)) == [(["armed"], [(5, 3)])]
    assert lines([(4, 3)], [(4, 3)], (1, 0)) == [(["armed"], [(4, 3)]), (["armored"], [(4, 3)])]


def test_a_sound_cube_has_no_faults(spark):
    rows = [("m1", "T", "eco", "d1", "x", True), ("m1", "CT", "full", "d1", "x", True), ("m2", "T", "eco", "d2", "x", None), ("m2", "T", None, "d2", "x", None), (None, "T", "eco", "d3", "y", False)]
    cube = Q.bucketed_samples(spark.createDataFrame(rows, "map_name string, side string, round_type string, map_demo_id string, match_id string, is_league boolean"))
    assert Q.cube_faults(cube).count() == 0 and Q.cube_faults(cube.limit(0)).count() == 0
    lost = Q.cube_faults(cube.where("NOT (level = 0 AND map_name <=> 'm1' AND side = 'T')")).collect()
    assert {(r.level, r.measure) for r in lost} >= {(1, "rounds"), (1, "rounds_league")} and all(r.map_name == "m1" for r in lost)


def test_named_events_and_what_they_lost(spark):
    point = "unit string, grenade_no int, event_kind string, grenade_type string, thrower_id string, tick int, x double, y double, z double"
    t, d = W.THROWN, W.DETONATED
    rows = [("a", 1, t, "smoke", "p", 100, 0.0, 0.0, 0.0), ("a", 1, d, "smoke", "p", 900, 10.0, 10.0, 0.0), ("a", 2, t, "smoke", None, 100, 0.0, 0.0, 0.0), ("a", 2, d, "smoke", None, 200, 0.0, 0.0, 0.0),
            ("a", 3, t, "odd", "p", 999, 0.0, 0.0, 0.0), ("a", 4, t, "flash", "q", 150, 0.0, 0.0, 0.0), ("b", 1, t, "flash", "p", 100, 0.0, 0.0, 0.0), ("b", 1, d, "flash", "p", 150, 10.0, 10.0, 0.0)]
    make = spark.createDataFrame
    events, seen = W.named_events(
        make(rows, point), make([(u, 1, 50, 800) for u in "ab"], "unit string, round_raw int, start_tick int, stop_tick int"), make([(u, 1, "p", "T") for u in "ab"], "unit string, round_raw int, player_id string, side string"),
        make([(u, 1, "T", f"L{u}") for u in "ab"], "unit string, round_raw int, side string, lineup_key string"), make([("a", 100, "p", "Yard")], "unit string, tick int, player_id string, area string"),
        make([("a", 0, 0, 0, "Pit"), ("b", 9, 9, 0, "Far"), ("c", 0, 0, 0, "Else")], "unit string, cell_x int, cell_y int, cell_z int, area string"), ["unit"], 50.0, 32.0, 64.0, ["smoke", "flash"], 100,
    )
    got = {(r.unit, r.grenade_no, r.event_kind): (r.lineup_key, r.t_s, r.area, r.area_source) for r in events.collect()}
    assert got == {
        ("a", 1, t): ("La", 1.0, "Yard", "observed"), ("a", 1, d): ("La", 17.0, "Pit", "point_cloud"), ("b", 1, t): ("Lb", 1.0, None, None), ("b", 1, d): ("Lb", 2.0, None, None),
    }
    assert seen.get == {"without_thrower": 1, "outside_rounds": 1, "unknown_side": 1, "unknown_type": 1, "throwers_without_row": 1, "detonating_after_round": 1, "events": 4}


def test_round_faults_sort_a_unit_once(spark, capsys):
    S.round_faults(numbers(spark, 1, None, 2), ["unit"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_events_of_throws_go_by_the_throw_only(spark):
    import __spark_entry__

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()["named_throws"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line.split("hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # events are not sent to rounds, sides or lineups, nor lines to a group of theirs and then to their throw
    assert dealt and not any(c in keys for keys in dealt for c in ("_round#", "_throw#", "l_orderkey#", "l_linenumber#") if "% 20" not in keys)
