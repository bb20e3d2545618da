import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tellmark.operators import report as P
from tellmark.sources import archive as A
from tellmark.streaming.sessions import sessions, windowed_counts


@pytest.fixture(scope="module")
def game(spark):
    rng = random.Random(6)
    rounds = [
        (d, no, f"m{i // 2}", "mirage" if i % 2 else "nuke", "T" if no < 7 else "CT", rng.choice(["eco", "full", None]), rng.choice([True, False, None]), rng.choice([True, False, None]), "us")
        for i, d in enumerate("abcd") for no in range(1, 13)
    ]
    ticks, events, deaths = [], [], []
    for d, no, *_ in rounds:
        for t in (6.0, 9.0):
            if rng.random() < 0.8:
                ticks += [(d, no, f"p{k}", "time", t, rng.choice(["Pit", "Ramp", None]), rng.random() < 0.7) for k in range(5)]
        for g in range(rng.randint(0, 3)):
            n = len(events)
            events.append((d, n, "grenade_thrown", no, rng.choice(["smoke", "flash"]), rng.choice(["Pit", None]), rng.choice([1.0, 7.0, None])))
            if rng.random() < 0.8:
                events.append((d, n, "grenade_detonate", no + 1, "smoke", rng.choice(["Ramp", None]), 99.0))
        for k in range(rng.randint(0, 3)):
            deaths.append((d, no, f"p{k}", "us", rng.choice(["Pit", None]), rng.choice([f"p{k}", "e1"]), rng.choice(["us", "them"]), "Ramp", rng.choice([None, 3.0, 8.0])))
    events.append(("a", 10_000, "grenade_detonate", 1, "smoke", "Pit", 1.0))
    return (
        spark.createDataFrame(rounds, "map_demo_id string, round_no int, match_id string, map_name string, side string, round_type string, is_league boolean, won boolean, lineup_key string"),
        spark.createDataFrame(ticks, "map_demo_id string, round_no int, player_id string, sample_kind string, sample_t_s double, area string, is_alive boolean"),
        spark.createDataFrame(events, "map_demo_id string, grenade_no int, event_kind string, round_no int, grenade_type string, area string, t_s double"),
        spark.createDataFrame(deaths, "map_demo_id string, round_no int, victim_id string, victim_lineup_key string, victim_area string, attacker_id string, attacker_lineup_key string, attacker_area string, t_s double"),
    )


def test_samples_add_up(game):
    rounds, *_ = game
    rows = P.samples(rounds).collect()
    known = [r for r in rounds.collect() if r.round_type]
    whole = next(r for r in rows if r.level == 7)
    assert whole.rounds == len(known) and whole.matches == len({r.match_id for r in known})
    assert all(r.rounds == r.rounds_league + r.rounds_other + r.rounds_unknown for r in rows)
    for level in (0, 1, 3):
        assert sum(r.rounds for r in rows if r.level == level) == len(known)
    assert sum(r.wins + r.losses + r.unknown for r in P.records(rounds).collect()) == len(known)


def test_positions_match_plain_python(game):
    rounds, ticks, *_ = game
    leaf = {(r.map_demo_id, r.round_no): (r.map_name, r.side, r.round_type) for r in rounds.collect() if r.round_type}
    units, seen, areas = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in ticks.collect():
        u = (r.map_demo_id, r.round_no)
        if u in leaf:
            key = (*leaf[u], r.sample_t_s)
            units[key].add(u)
            if r.is_alive:
                areas[key].add(r.area)
                seen[(key, u, r.area)].add(r.player_id)
    want = Counter((*k, a, len(seen.get((k, u, a), ()))) for k in units for a in areas[k] for u in units[k])
    got = {(r.map_name, r.side, r.round_type, r.sample_t_s, r.area, r.players): (r.n, r.m) for r in P.positions(ticks, rounds).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(want)
    assert all(m == len(units[k[:4]]) for k, (_, m) in got.items())
    shown = P.shown_bars(P.positions(ticks, rounds), 3, 2).collect()
    assert shown and all(r.players > 0 and r.n >= max(1, min(3, r.m)) for r in shown)


def test_utility_and_deaths(game):
    rounds, _, events, deaths = game
    known = {(r.map_demo_id, r.round_no): (r.map_name, r.side, r.round_type) for r in rounds.collect() if r.round_type}
    thrown = [r for r in events.collect() if r.event_kind == "grenade_thrown" and (r.map_demo_id, r.round_no) in known]
    uses = P.utility(events, rounds, [5, 10]).collect()
    assert sum(r.throws for r in uses) == len(thrown) and all(r.n <= r.throws for r in uses)
    assert [r.grenade_no for r in P.unpaired(events).collect()] == [10_000]
    rows = P.throws_per_round(events, rounds).collect()
    leaves = Counter(known.values())
    for leaf in leaves:
        for kind in {r.grenade_type for r in rows if (r.map_name, r.side, r.round_type) == leaf}:
            mine = [r for r in rows if (r.map_name, r.side, r.round_type, r.grenade_type) == (*leaf, kind)]
            assert sum(r.n for r in mine) == leaves[leaf]
            assert sum(r.n * r.throws for r in mine) == sum(known[(t.map_demo_id, t.round_no)] == leaf and t.grenade_type == kind for t in thrown)
    all_deaths = deaths.collect()
    with_death = {(r.map_demo_id, r.round_no) for r in all_deaths} & known.keys()
    firsts = P.first_deaths(deaths, rounds).collect()
    assert sum(r.n for r in firsts) == len(with_death)
    own = [r for r in all_deaths if (r.map_demo_id, r.round_no) in known and r.attacker_lineup_key == "us" and r.attacker_id != r.victim_id]
    assert sum(r.n for r in P.kills(deaths, rounds).collect()) == len(own)


def test_nested_report_and_archive(spark, game, tmp_path):
    rounds, ticks, *_ = game
    doc = P.nested(P.samples(rounds), P.positions(ticks, rounds))
    A.write_report(doc, f"{tmp_path}/report")
    lines = [json.loads(x) for p in (tmp_path / "report").glob("*.json") for x in p.read_text().splitlines()]
    assert {d["map_name"] for d in lines} == {"mirage", "nuke"} and lines[0]["sides"][0]["round_types"][0]["rounds"] > 0

    contract = "map_demo_id string, cell_x int, cell_y int, cell_z int, area string, observations int"
    cells = spark.createDataFrame([("a", 1, 2, 3, "Pit", 4), ("b", 1, 2, 3, "Pit", 4)], contract)
    A.write_tables({"cloud": (cells, f"{tmp_path}/cloud")}, "map_demo_id")
    A.write_tables({"cloud": (cells.where("map_demo_id = 'b'").withColumn("observations", F.lit(9)), f"{tmp_path}/cloud")}, "map_demo_id")
    back = A.read_table(spark, f"{tmp_path}/cloud", contract)
    assert sorted((r.map_demo_id, r.observations) for r in back.collect()) == [("a", 4), ("b", 9)]
    with pytest.raises(ValueError):
        A.write_tables({"x": (cells.drop("map_demo_id"), f"{tmp_path}/x")}, "map_demo_id")

    (tmp_path / "m.json").write_text(json.dumps({"matches": [{"match_id": "m", "best_of": 3, "map_picks": ["nuke", "mirage", "dust2"]}, {"best_of": 1}]}, indent=1))
    maps = A.candidate_maps(A.read_matches(spark, f"{tmp_path}/m.json")).collect()
    assert [(r.map_demo_id, r.map_name, r.certainly_played) for r in maps] == [("m-1", "nuke", True), ("m-2", "mirage", True), ("m-3", "dust2", False)]
    raw = spark.createDataFrame([('{"match_id": "q", "best_of": "3", "finished_at": 0, "voting": {"map": {"pick": ["nuke"]}}}',), ("nonsense",)], "payload string")
    assert [tuple(r) for r in A.parse_matches(raw).collect()] == [("q", None, None, 3, ["nuke"])]
    assert A.markdown_table([{"a": "x|y", "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| x\\|y |  |\n"

    made = A.Manifest("classify", {"rounds": "1"}, A.params_hash({"b": 1, "a": 2}), {"tool": "1"}, created_at="now")
    assert A.Manifest.from_json(made.to_json()) == made and made.is_current({"rounds": "1"}, A.params_hash({"a": 2, "b": 1}), {"tool": "1"})
    assert not made.is_current({"rounds": "2"}, made.params, {"tool": "1"})
    assert made.fingerprint() == A.Manifest("classify", {"rounds": "1"}, made.params, {"tool": "1"}, created_at="later").fingerprint()


def test_streams_give_what_tables_give(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for k, make in enumerate((lambda df: sessions(df, ["user_id"], "ts", "6 hours", "1 hour"), lambda df: windowed_counts(df, ["user_id"], "ts", "1 day", "12 hours", "1 hour"))):
        stream = make(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.outputMode("complete" if k else "append").format("memory").queryName(f"out{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {tuple(r) for r in spark.table(f"out{k}").collect()}
        want = {tuple(r) for r in make(rows).collect()}
        assert got and (got == want if k else got <= want)


def test_selection_and_thresholds(spark):
    m = lambda rows: P.newest_match(spark.createDataFrame(rows, "match_id string, rank int")).first()[0]
    assert (m([("a", 2), ("b", 1), ("b", 1)]), m([("a", None)]), m([("a", None), ("b", 1)]), m([])) == ("b", "a", None, None)
    done = spark.createDataFrame([((4000, 1500),), ((4000, 1600),)], "inputs struct<full: int, force: int>")
    assert {tuple(r) for r in P.used_thresholds(done, "inputs", ["full", "force"]).collect()} == {("full", 4000, 1), ("force", None, 2)}
    src = spark.createDataFrame([("x", "header"), ("x", "id"), ("y", "header"), ("z", "odd"), ("z", "id")], "k string, s string")
    assert {r.k: r.s for r in P.weakest_source(src, ["k"], "s", ["header", "pool", "id"]).collect()} == {"x": "id", "y": "header", "z": "odd"}
    hits = spark.createDataFrame([("d", 1, 6.0, "Pit", 2), ("d", 1, 9.0, "Pit", 1), ("d", 2, 6.0, "Pit", 1), ("d", 3, 6.0, "Pit", 1)], "demo string, round_no int, sample_t_s double, area string, players int")
    rounds = spark.createDataFrame([("d", 1, "nuke", "CT", "eco", "m1"), ("d", 2, "nuke", "CT", "half", "m1"), ("d", 3, "nuke", "CT", None, "m1"), ("d", 4, "nuke", "CT", "full", "m2")], "demo string, round_no int, map_name string, side string, round_type string, match_id string")
    row = P.anomaly_rows(hits, rounds, ["demo"], F.col("round_type") != "full").first()
    assert (row.n, row.matches, row.m, row.round_types, [len(r.points) for r in row.rounds]) == (2, 1, 2, ["eco", "half"], [2, 1])
    lines = spark.createDataFrame([("b", "x", 5, 9), ("b", "y", 5, 9), ("b", "z", 4, 9), ("b", "q", 2, 9), ("c", "x", 1, 1)], "block string, what string, n int, m int")
    assert {(r.block, r.what) for r in P.repeated(lines, ["block"], "n", "m", 3, 1).collect()} == {("b", "x"), ("b", "y"), ("c", "x")}
    flat = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 7)], "block string, v int")
    assert sorted(tuple(r) for r in P.unsaturated(flat, ["block"], "v").collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 7)]
    seen = spark.createDataFrame([("Pit",), (None,), ("Ramp",)], "area string")
    assert [r.area for r in P.not_covered(seen, seen.where("area IS NULL OR area = 'Pit'"), ["area"]).collect()] == ["Ramp"]
