"""Routes against a plain walk over each player's moments, on random rounds with flags and nameless places."""

import random
from collections import defaultdict

from tellmark.operators import routes as W
from tellmark.operators import teams as K

UNIT = ["map_demo_id", "round_no"]
PLACES = [("long", None, True), ("mid", "coarse", False), ("yard", None, True), ("door", None, False), (None, None, True)]


def walk(moments, where, death):
    seen = [(m, where[m]) for m in moments if m in where]
    once = lambda xs: [x for i, x in enumerate(xs) if i == 0 or xs[i - 1][1][:2] != x[1][:2]]
    runs = once(seen)
    runs = once([r for i, r in enumerate(runs) if r[1][2] or i in (0, len(runs) - 1)])
    out, i = [], 0
    while i < len(runs):
        m, (label, flag, kept) = runs[i]
        out.append(("seen", label, flag, None, None, m, kept))
        n = 1
        while i + n < len(runs) and (n < 2 or runs[i + n][1][:2] == runs[i + n - 2][1][:2]):
            n += 1
        if n >= 3:
            went = runs[i + 1]
            out.append(("seen", *went[1][:2], label, flag, went[0], went[1][2]))
            i += n
        else:
            i += 1
    last = seen[-1][0] if seen else None
    if death and death[0] <= moments[-1]:
        out.append(("died", death[1], death[2], None, None, death[0], True))
    elif last is None or last < moments[-1]:
        out.append(("gone", None, None, None, None, min(m for m in moments if last is None or m > last), True))
    return out, last


def made(seed):
    rng = random.Random(seed)
    seen, deaths, want = [], [], {}
    for r in range(6):
        moments = [3.0 * k for k in range(rng.randint(1, 12))]
        for p in "abcde":
            where, death = {}, None
            stops = rng.choice([99.0, 99.0, rng.choice(moments)])
            for m in moments:
                alive = m < stops and rng.random() < 0.9
                place = rng.choice(PLACES[:3] if p < "d" else PLACES)
                if alive:
                    where[m] = place
                seen.append(("d", r, p, "time", m, alive if rng.random() < 0.5 or alive else None, *place))
            seen.append(("d", r, p, "first_contact", 1.0, True, *PLACES[0]))
            if stops < 99 and rng.random() < 0.7:
                death = (stops + 1, "long", None)
                deaths += [("d", r, p, *death), ("d", r, p, -1.0, "mid", None)]
            want[r, p] = walk(moments, where, death)
    s = "map_demo_id string, round_no int, player_id string"
    return (seen, f"{s}, sample_kind string, sample_t_s double, is_alive boolean, label string, flag string, kept boolean"), (deaths, f"{s}, t_s double, label string, flag string"), want


def test_junction_paths_and_tree(spark):
    seen, deaths, want = made(5)
    paths = W.junction_paths(spark.createDataFrame(*seen), spark.createDataFrame(*deaths), UNIT)
    got = {(r.round_no, r.player_id): ([tuple(s) for s in r.path], r.last_seen) for r in paths.collect()}
    assert got == want
    assert any(s[3] for path, _ in want.values() for s in path) and any(s[0] == "died" for path, _ in want.values() for s in path)
    # every node's players are its children's, or it has none
    tree = W.route_tree(paths, UNIT).collect()
    inside = defaultdict(int)
    for n in tree:
        inside[n.round_no, str(n.parent)] += n.players
    for n in tree:
        assert n.stays or n.leaf or inside[n.round_no, str(n.node)] == n.players
    assert all(inside[r, "[]"] == 5 for r in range(6))
    for n in (x for x in tree if x.stays):
        assert n.seconds == min(want[n.round_no, p][1] for p in "abcde" if len(want[n.round_no, p][0]) == n.depth - 1 and [s[:5] for s in want[n.round_no, p][0]] == [tuple(x)[:5] for x in n.node])


def test_no_rows(spark):
    seen, deaths, _ = made(1)
    paths = W.junction_paths(spark.createDataFrame([], seen[1]), spark.createDataFrame([], deaths[1]), UNIT)
    assert paths.count() == 0 and W.route_tree(paths, UNIT).count() == 0
    rounds = spark.createDataFrame([("d", 1, "x")], "map_demo_id string, round_no int, side string")
    assert W.route_patterns(paths, rounds, ["side"], UNIT, "map_demo_id", [], None).count() == 0
    demos = spark.createDataFrame([], "map_demo_id string, rank int")
    assert [(r.rank, r.steps) for r in W.routes(rounds, W.route_tree(paths, UNIT), demos).collect()] == [(1, [])]


def test_patterns_moved_and_stayed(spark):
    step = lambda label, fate="seen", kept=True: (fate, label, None, None, None, 1.0, kept)
    a, b, s = step("a"), step("b"), step("spawn")
    plan = {"p1": [s, a, b], "p2": [a, b], "p3": [a, step("c", "died")], "p4": [step("x", kept=False)]}
    rows = [("d", r, p, path, 1.0) for r in (1, 2) for p, path in plan.items()]
    paths = spark.createDataFrame(rows, f"map_demo_id string, round_no int, player_id string, path array<{W.STEP}>, last_seen double")
    rounds = spark.createDataFrame([("d", r, "m") for r in (1, 2)], "map_demo_id string, round_no int, match_id string")
    got = W.route_patterns(paths, rounds, [], UNIT, "match_id", ["spawn"], "m").collect()
    # three begin with a, none is last seen alive there; two go on to b and stay
    assert {("".join(x.label for x in r.path), r.stayed, r.rounds, r.matches, r.players, r.newest) for r in got} == {("a", False, 2, 1, 3, True), ("ab", True, 2, 1, 2, True)}


def test_standing_teams(spark):
    one = lambda ps: [(p, p.upper()) for p in ps]
    rows = [("m1", "f1", "Owls", True, 1, one("abcde")), ("m2", "f2", "owls", True, 5, one("abcxy")), ("m3", "f3", None, False, 6, one("xqrst")), ("m4", "f2", "owls", None, 7, [("a", "zed"), ("a", "zed"), ("e", None)]), ("m5", "f9", None, None, None, [])]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, match_id string, faction_id string, name string, played boolean, observed_at int, members array<struct<player_id: string, nickname: string>>")
    got = {r.team_key: r for r in K.standing_teams(df, ["g"], 3).collect()}
    assert set(got) == {"f1", "f3", "f9"}
    f1, f3 = got["f1"], got["f3"]
    assert (f1.faction_ids, f1.match_ids, f1.played_match_ids, f1.name, f1.other_names) == (["f1", "f2"], ["m1", "m2", "m4"], ["m1", "m2"], "owls", ["Owls"])
    assert [(m.player_id, m.nickname) for m in f1.roster] == one("abcdey")  # a tie of A and zed goes to A
    assert [m.player_id for m in f1.released] == ["x"] and f1.shared_players == [] and [m.player_id for m in f3.roster] == list("qrstx")
    assert got["f9"].roster is None or got["f9"].roster == []
