import random


from pyspark.sql import functions as F

from tellmark.operators import paths as P
from tellmark.operators import teams as T


def test_clusters_in_order(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for league in range(12):
        heads = []
        for k in range(12):
            m = sorted(rng.sample(range(14), 5))
            key = f"{league}-{k}"
            rows.append((league, key, m, k))
            best = max(((len(set(h) & set(m)), -i, hk) for i, (hk, h) in enumerate(heads)), default=(0, 0, None))
            if best[0] >= 3:
                want[key] = best[2]
            else:
                heads.append((key, m))
                want[key] = key
    df = spark.createDataFrame(rows, "league int, key string, members array<int>, seen int")
    got = {r.key: r.cluster for r in T.cluster_in_order(df, ["league"], "key", "members", "seen", 3).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_roster_selection_and_factions(spark):
    rows = [("a", True, ["1", "2", "3", "4", "5"], None), ("b", False, ["1", "2", "3", "4", "5"], None), ("c", False, None, ["1", "2", "3", "4", "9"]), ("d", True, ["1", "2", "8", "9"], None), ("e", True, None, None)]
    df = spark.createDataFrame(rows, "unit string, certainly_played boolean, match_roster array<string>, observed_players array<string>")
    got = {r.unit: (r.roster_class, r.reason) for r in T.select_by_roster(df, ["1", "2", "3", "4", "5"], 5, 4).collect()}
    assert got == {"a": ("full", None), "b": (None, "not certainly played"), "c": ("partial", None), "d": (None, "too few regulars"), "e": (None, "no players known")}
    seen = spark.createDataFrame([("f", "m1", 5, ["1", "2"]), ("f", "m2", None, ["2", "3"]), ("g", "m1", 4, ["7"])], "key string, match_id string, observed_at int, roster array<string>")
    got = {r.key: (r.members, r.matches, r.last_seen) for r in T.factions(seen, "key").collect()}
    assert got == {"f": (["1", "2", "3"], 2, None), "g": (["7"], 1, 4)}
    lineups = spark.createDataFrame([("x", p) for p in "abcde"] + [("y", p) for p in "abc"] + [("z", p) for p in "ab"], "k string, p string")
    assert {r.k for r in T.lineups_like(lineups, "x", "k", "p", 3).collect()} == {"x", "y"}
    names = spark.createDataFrame([("k1", "Night Owls"), ("k2", "Owls"), ("k3", "owls")], "key string, name string")
    assert {r.key for r in T.find_by_name(names, " OWLS", "key", "name").collect()} == {"k2", "k3"}
    assert {r.key for r in T.find_by_name(names, "night", "key", "name").collect()} == {"k1"}


def collapse(path):
    out, i = [], 0
    while i < len(path):
        n = 1
        while i + n < len(path) and n >= 1 and (n < 2 or path[i + n] == path[i + n - 2]) and path[i + n] != path[i + n - 1]:
            n += 1
        if n >= 3:
            out.append(f"{path[i]}<>{path[i + 1]}")
            i += n
        else:
            out.append(path[i])
            i += 1
    return out


def test_paths(spark):
    rng = random.Random(9)
    paths = []
    for _ in range(400):
        p = []
        for _ in range(rng.randint(0, 9)):
            p.append(rng.choice([c for c in "ABC" if not p or c != p[-1]]))
        paths.append(p)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path array<string>")
    got = {r.i: r.p for r in df.select("i", P.collapse_returns(F.col("path")).alias("p")).collect()}
    assert got == {i: collapse(p) for i, p in enumerate(paths)}
    cut = {r.i: r.p for r in df.select("i", P.from_first(F.col("path"), F.array(F.lit("B"), F.lit("C"))).alias("p")).collect()}
    assert cut == {i: next((p[k:] for k in range(len(p)) if p[k] in "BC"), []) for i, p in enumerate(paths)}

    walks = spark.createDataFrame([(1, "a", ["X", "Y"]), (1, "b", ["X", "Y", "Z"]), (1, "c", ["X"]), (2, "a", ["X", "Y"]), (2, "b", ["X", "Y"])], "round int, who string, path array<string>")
    tree = {(r["round"], tuple(r.prefix)): (r.walkers, r.stayers, list(r.parent)) for r in P.prefix_tree(walks, ["round"], "who").collect()}
    assert tree[(1, ("X",))] == (["a", "b", "c"], ["c"], []) and tree[(1, ("X", "Y"))] == (["a", "b"], ["a"], ["X"])
    for (no, prefix), (walkers, stayers, _) in tree.items():
        below = [w for (n, p), (ws, _, parent) in tree.items() if n == no and tuple(parent) == prefix for w in ws]
        assert sorted(below + stayers) == walkers
    found = {tuple(r.prefix): (r.units, r.most) for r in P.prefix_patterns(walks, [], "round", "who", 2, 2).collect()}
    assert found == {("X",): (2, 3), ("X", "Y"): (2, 2)}
    sets = spark.createDataFrame([("t", ["X"], [1, 2]), ("t", ["X", "Y"], [1, 2, 3]), ("t", ["Q"], [1]), ("u", ["X"], [1])], "team string, prefix array<string>, units array<int>")
    left = {(r.team, tuple(r.prefix)) for r in P.without_subsumed(sets, ["team"], "prefix", "units").collect()}
    assert left == {("t", ("X", "Y")), ("t", ("Q",)), ("u", ("X",))}


def test_clusters_of_random_orders_match_the_fold_in_both_ways(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for league in ("x", "y", None):
        for k in range(60):
            rows.append((league, f"k{k:02}", rng.sample(range(14), rng.randint(2, 6)), rng.randint(0, 25) if k % 9 else None))
    rows.append(("z", "alone", [1, 2, 3], 1))
    df = spark.createDataFrame(rows, "league string, key string, members array<int>, seen int")
    for common, bound in ((2, 0), (3, 0), (3, 512)):
        monkeypatch.setattr(T, "FOLD", bound)
        want = {}
        for league in ("x", "y", None, "z"):
            heads = []
            own = sorted((r for r in rows if r[0] == league), key=lambda r: (r[3] is not None, r[3] or 0, r[1]))  # nulls first
            for _, key, members, _ in own:
                shared = [(len(set(m) & set(members)), -i, h) for i, (h, m) in enumerate(heads)]
                best = max(shared, default=(0, 0, None))
                if best[0] >= common:
                    want[league, key] = best[2]
                else:
                    heads.append((key, members))
                    want[league, key] = key
        got = {(r.league, r.key): r.cluster for r in T.cluster_in_order(df, ["league"], "key", "members", "seen", common).collect()}
        assert got == want


def test_a_large_league_is_clustered(spark):
    groups = spark.range(30_000).select(
        F.lit("one").alias("league"), F.col("id").alias("key"), F.xxhash64("id").alias("seen"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(F.col("id") / 3) * 5 + F.when(i == 4, F.pmod(F.xxhash64("id"), F.lit(1000)) + 10**7).otherwise(i)).alias("members"),
    )
    found = T.cluster_in_order(groups, ["league"], "key", "members", "seen", 4)
    assert found.count() == 30_000 and found.select("cluster").distinct().count() == 10_000


def test_groups_of_a_crowded_league_are_not_paired_with_each_other(spark, monkeypatch):
    from tellmark.operators import overlaps as O

    paired = []
    real = O.pairs
    monkeypatch.setattr(O, "pairs", lambda a, b, *rest: paired.append(a.select("later").distinct().count()) or real(a, b, *rest))
    monkeypatch.setattr(T, "FOLD", 32)
    groups = spark.range(300).select(F.lit("one").alias("league"), F.col("id").alias("key"), F.col("id").alias("seen"), F.array(F.lit(1), F.lit(2), F.col("id") % 3 + 10).alias("members"))
    found = T.cluster_in_order(groups, ["league"], "key", "members", "seen", 3)
    assert {(r.cluster, r["count"]) for r in found.groupBy("cluster").count().collect()} == {(0, 100), (1, 100), (2, 100)}
    # 32 of the first batch; all others are near a first group and meet no other group
    assert sum(paired) == 32
