"""General problem operators against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import coverage, hierarchy, orphans, skew

EDGES = "id long, left double, right double, parent long, child long, metadata binary, batch long, recorded_at timestamp"
NODES = "id long, flags long, time double, population long, individual long, metadata binary, batch long, recorded_at timestamp, retired_at timestamp"
T0 = datetime(2024, 1, 1)


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, p, c, None, 1, T0) for i, a, b, p, c in rows], EDGES)


def node(i, pop=None, ind=None, time=None, at=0, gone=None, batch=1):
    return (i, 0, time, pop, ind, None, batch, T0 + timedelta(days=at), None if gone is None else T0 + timedelta(days=gone))


def test_parent_results_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(i, float(a := rnd.randrange(100)), float(a + rnd.randrange(-2, 9)), 7 if i % 3 else rnd.choice([1, 2, 3, -1, None]), rnd.randrange(50)) for i in range(900)]
    rows += rows[:40]
    nodes = spark.createDataFrame([node(7, time=2.5), node(7, time=2.5), node(1, time=float("nan")), node(2)], NODES)
    got = {r["parent"]: r for r in skew.parent_results(edges(spark, rows).withColumn("_task", F.lit("x")), nodes, least_tasks=6).collect()}
    for p in (7, 1, 2, 3):
        own = [r for r in rows if r[3] == p]
        once = {r[0]: r for r in own}
        assert got[p]["n_rows"] == len(own) and got[p]["n_ids"] == len(once)
        assert got[p]["n_children"] == len({r[4] for r in own})
        assert got[p]["total_span"] == sum(r[2] - r[1] for r in once.values() if r[2] > r[1])
    assert set(got) == {7, 1, 2, 3} and got[7]["parent_time"] == 2.5 and got[1]["parent_time"] is None


def test_heavy_parents_and_empty(spark):
    rows = [(i, 0.0, 1.0, 5 if i < 2 else 100 + i, i) for i in range(200)]
    nodes = spark.createDataFrame([], NODES)
    assert [r[0] for r in skew.heavy_parents(edges(spark, rows), nodes).collect()] == [5]
    assert skew.heavy_parents(edges(spark, []), nodes).collect() == []


def test_skew_join_paths_agree(spark):
    left = spark.range(500).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = skew.skew_join(left, right, "k", how)
        large = skew.skew_join(left, right, "k", how, limit=0).select(*small.columns)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_bin_packing_is_balanced():
    where, loads = skew.pack([(n, n) for n in range(1, 100)], 7)
    assert len(where) == 99 and sum(loads) == 4950 and max(loads) - min(loads) <= 99


def test_orphans(spark):
    tables = {
        "nodes": spark.createDataFrame([node(0, pop=0, ind=4), node(0, pop=0, ind=4, at=9), node(1, pop=-1, ind=None), node(2, pop=9, ind=-2, batch=3), node(3, pop=1, at=5), node(4, pop=2, at=1, gone=2)], NODES),
        "edges": edges(spark, [(0, 0.0, 1.0, 3, 0), (1, 0.0, 1.0, None, 0), (2, 1.0, 0.0, 77, 0), (2, 1.0, 0.0, 77, 0)]),
        "individuals": spark.createDataFrame([(4, T0, None)], "id long, recorded_at timestamp, retired_at timestamp"),
        "migrations": spark.createDataFrame([(0, 4, 2, T0 + timedelta(days=2)), (1, 4, 2, T0 + timedelta(days=1))], "id long, node long, batch long, recorded_at timestamp"),
        "populations": spark.createDataFrame([(0, T0, None), (1, T0, T0 + timedelta(days=5)), (2, T0 + timedelta(days=3), None)], "id long, recorded_at timestamp, retired_at timestamp"),
    }
    got = {tuple(r) for r in orphans.orphans(tables).collect()}
    assert got == {
        ("nodes", "population", 2, 3, "missing"), ("nodes", "individual", 2, 3, "missing"), ("nodes", "population", 3, 1, "retired"), ("nodes", "population", 4, 1, "late"),
        ("edges", "parent", 0, 1, "late"), ("edges", "parent", 2, 1, "missing"), ("migrations", "node", 0, 2, "retired"),
    }
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert orphans.orphans(empty).count() == 0
    report = {(r["table_name"], r["field_name"], r["batch"], r["reason"]): r["n_orphans"] for r in orphans.orphan_report(tables).collect()}
    assert report[("edges", "parent", 1, "missing")] == 1


def reach(links):
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    out = {}
    for s in up:
        seen, todo = set(), [s]
        while todo:
            for w in up.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        out[s] = seen
    return out


def brute_cycles(links):
    r = reach(links)
    return {(min(y for y in r if y in r[x] and x in r[y]), x) for x in r if x in r[x]}


@pytest.mark.parametrize("seed,base", [(1, 10**6), (2, 0), (3, 0), (4, 5)])
def test_cycles(spark, seed, base):
    rnd = random.Random(seed)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [(2000 + i, 2001 + i) for i in range(150)]
    links += [(500, 500), (501, 502), (502, 501), (502, 503), (1005, 2000), (600, 1003)] + [(3000 + i, 3001 + i) for i in range(40)] + [(3040, 3000), (3041, 3005), (3010, 3041)]
    df = spark.createDataFrame([("node", a, b) for a, b in links + links[:9]] + [("individual", 501, 502), ("individual", None, 1), ("individual", 1, None)], "kind string, child long, parent long")
    got = {(r["kind"], r["cycle_id"], r["member_id"]) for r in hierarchy.cycles(df, base_links=base).collect()}
    assert got == {("node", c, m) for c, m in brute_cycles(links)}


def test_cycles_empty_and_local():
    member, cycle = hierarchy.strong_members(np.array([1, 2, 3, 9]), np.array([2, 1, 1, 9]))
    assert sorted(zip(member.tolist(), cycle.tolist())) == [(1, 1), (2, 1), (9, 9)]


def test_climb():
    node, up = np.array([5, 9, 1, 2, 3, 7, 8, 20]), np.array([9, 50, 2, 3, 2, 1, 8, 21])
    exit_, far = hierarchy.climb(node, up, np.ones(8, int))
    assert exit_.tolist() == [50, 50, 2, 2, 2, 2, 8, 21] and far.tolist() == [2, 1, 1, 0, 1, 2, 0, 1]


@pytest.mark.parametrize("base", [10**6, 30, 1])
def test_exits(spark, base):
    """Chains over fragments, a bare chain that only doubling settles, loops within and across fragments."""
    up = {i * 64: (i + 1) * 64 for i in range(200)} | {100_000 + i * 64: 100_000 + (i + 1) % 40 * 64 for i in range(40)} | {7: 0, 8: 7, 200_001: 200_002, 200_002: 200_001, 300_000: 100_064}
    want = {}
    for u in up:
        seen, v, k = {}, u, 0
        while v in up and v not in seen:
            seen[v] = k
            v, k = up[v], k + 1
        want[u] = (v, k) if v not in up else None
    from kinweave.plans.staging import stage

    forest = stage(spark.createDataFrame([(a, b, 1) for a, b in up.items()], "node long, up long, len long"))
    found, levels = hierarchy.exits(forest, base)
    got = {r["node"]: r for r in found.collect()}
    assert set(got) == set(up)
    for u, w in want.items():
        if w:
            assert (got[u]["exit"], got[u]["len"]) == w
        else:
            e = got[u]["exit"]
            assert want[e] is None and got[e]["exit"] == e
    marks = spark.createDataFrame([(7, 0), (192, 0), (300_000, 1)], "node long, cycle long")
    assert {r["member"] for r in hierarchy.along(levels, marks).collect()} >= {7, 0, 192, 300_000} | {i * 64 for i in range(200)}


@pytest.mark.parametrize("base", [10**6, 40, 3])
def test_paths(spark, base):
    rnd = random.Random(base)
    links = [(i, rnd.randrange(max(0, i - 9), i)) for i in range(1, 150)] + [(i, rnd.randrange(i)) for i in range(1, 90)] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (301, 300), (20, 149)]
    links += [(400 + i, 401 + i) for i in range(60)]
    df = spark.createDataFrame([("node", a, b) for a, b in links + links[:5]] + [("individual", 5, 6), ("individual", None, 6), ("x", 5, 6)], "kind string, child long, parent long").withColumn("node", F.lit("clash"))
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    tops = {b for _, b in links if b not in up}
    way, front = {t: [t] for t in tops}, tops
    near = dict.fromkeys(tops, 0)
    while front:
        front = {a for a, b in links if b in front and a not in near}
        for x in front:
            near[x] = min(near[p] for p in up[x] if p in near and p not in front) + 1
        for x in front:
            way[x] = way[min(p for p in up[x] if near.get(p, -9) == near[x] - 1)] + [x]
    want = {(t, None): ([t], False) for t in tops}
    for a, ps in up.items():
        for b in ps:
            shut = a == b or a in way.get(b, ())
            want[a, b] = (None if shut or b not in way else way[b] + [a], shut)
    got = hierarchy.paths(df, base_links=base).where("kind = 'node'").collect()
    assert {(r["id"], r["parent"]): (r["path"], r["closes"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert (r["root"], r["depth"]) == ((r["path"][0], len(r["path"]) - 1) if r["path"] else (None, None))


def test_empty_hierarchy(spark):
    none = spark.createDataFrame([], "kind string, child long, parent long")
    assert hierarchy.cycles(none).count() == 0 and hierarchy.paths(none).count() == 0


@pytest.mark.parametrize("per_shard,longest", [(10**9, 9), (1, 9), (10, 9), (2, 120), (20, 250)])
def test_coverage(spark, per_shard, longest):
    rnd = random.Random(5)
    rows = []
    for e in (1, 2, None):
        for _ in range(60 if e == 1 else 4):
            a = rnd.randrange(400)
            rows.append((e, float(a), float(a + rnd.choice([rnd.randrange(1, 9), rnd.randrange(1, longest)]))))
    rows += rows[:7] + [(1, None, 3.0), (2, 5.0, 5.0), (2, 9.0, 1.0), (1, float("nan"), 2.0), (9, 1.0, 2.0), (9, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "e long, left double, right double").withColumn("_shard", F.lit("clash")).withColumn("_island", F.lit(0))
    want_merged, want_gaps = set(), set()
    for e in (1, 2, None, 9):
        cover = sorted({x for k, a, b in rows if k == e and a is not None and a == a and b > a for x in range(int(a), int(b))})
        start = prev = cover[0]
        for x in [*cover[1:], None]:
            if x is None or x > prev + 1:
                want_merged.add((e, float(start), float(prev + 1)))
                if x is not None:
                    want_gaps.add((e, prev + 1, x))
                    start = x
            prev = x
    assert {tuple(r) for r in coverage.merged_intervals(df, ["e"], per_shard).collect()} == want_merged
    assert {tuple(r) for r in coverage.gaps(df, ["e"], per_shard).collect()} == want_gaps
    assert coverage.gaps(df.limit(0), ["e"]).count() == 0


def test_coverage_of_one_huge_entity(spark):
    """One entity with a million intervals in 50 shards: ties, intervals over all of the axis' middle, and a gap after every tenth."""
    n = 1_000_000
    df = spark.range(n).selectExpr("1L as e", "cast(id as double) as left", "cast(id + if(id % 10 = 9, 0.5, 1.0) as double) as right")
    df = df.unionByName(spark.range(1000).selectExpr("1L as e", "400000.0 as left", "cast(500000 + id as double) as right"))
    twice = df.selectExpr("e", "left * 2 as left", "right * 2 as right")
    g = coverage.gaps(twice, ["e"], 20_000).selectExpr("count(*) n", "sum(gap_right - gap_left) w", "min(gap_left) a", "max(gap_right) b").first()
    free = [k for k in range(n - 1) if k % 10 == 9 and not 400_000 <= k < 500_999]
    assert (g["n"], g["w"], g["a"], g["b"]) == (len(free), len(free), 2 * free[0] + 1, 2 * free[-1] + 2)
    m = coverage.merged_intervals(twice, ["e"], 20_000).selectExpr("count(*) n", "sum(right - left) w").first()
    assert m["n"] == len(free) + 1 and m["w"] == 2.0 * n - 1 - len(free)
