"""Roots, depths and descendants over all parents against plain Python."""

import random

import numpy as np
import pytest

from kinweave.operators import lineage
from tests.test_problems import reach

SCHEMA = "kind string, child long, parent long"


@pytest.mark.parametrize("seed,base", [(1, 10**6), (2, 60)])
def test_lineage(spark, seed, base):
    rnd = random.Random(seed)
    links = [(i, rnd.randrange(max(0, i - 30), i)) for i in range(20, 160) for _ in range(rnd.choice([1, 2, 3]))] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300)]
    links += [(400, 10), (401, 400), (402, 401), (401, 402), (403, 402), (500, 200), (500, 600)]  # 500: smallest parent on a loop, root over the other
    df = spark.createDataFrame([("node", a, b) for a, b in links + links[:5]] + [("individual", 5, 6), ("individual", 5, 7), ("individual", None, 1)], SCHEMA)
    everyone, r = {y for link in links for y in link}, reach(links)
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    tops = {x for x in everyone if x not in up}
    on = {x for x in everyone if x in r.get(x, ())}
    near, front = dict.fromkeys(tops, 0), tops
    while front:
        front = {a for a, b in links if b in front and a not in near}
        near |= dict.fromkeys(front, 1 + max(near.values()))
    way = {x: [x] for x in tops}
    for x in sorted(near, key=near.get):
        if x not in way:
            way[x] = way[min(p for p in up[x] if near.get(p) == near[x] - 1)] + [x]
    got = {x["id"]: x for x in lineage.lineage(df, base, tasks=3).where("kind = 'node'").collect()}
    assert set(got) == everyone
    far = {}

    def longest(x):
        if x not in far:
            over = [longest(p) for p in up.get(x, ())]
            far[x] = 0 if x in tops else max((d + 1 for d in over if d is not None), default=None)
        return far[x]

    for x in everyone:
        above = r.get(x, set())
        assert got[x]["loops"] == bool(on & (above | {x})), x
        assert got[x]["n_roots"] == len(tops & (above | {x})), x
        assert got[x]["n_descendants"] == sum(x in r.get(y, ()) for y in everyone if y != x), x
        assert got[x]["depth_min"] == near.get(x) and got[x]["path"] == way.get(x), x
        if not got[x]["loops"]:
            assert got[x]["depth_max"] == longest(x), x
    assert [got[x]["depth_max"] for x in (10, 400, 401, 402, 403, 200, 500)] == [0, 1, 2, 2, 3, None, 1]
    pairs = [tuple(x) for x in lineage.roots(df, base, tasks=2).where("kind = 'node'").select("id", "root").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, t) for x in everyone for t in tops & (r.get(x, set()) | {x})}
    assert got[500]["path"] == [600, 500] and got[500]["n_roots"] == 1


def test_blocks_of_seeds():
    rnd = random.Random(5)
    level = np.sort([rnd.randrange(6) for _ in range(400)])
    links = {(c, p) for c in range(400) for p in (rnd.randrange(400), rnd.randrange(400)) if level[p] < level[c]}
    child, parent = map(np.array, zip(*links))
    r = reach(links)
    got = np.zeros(400, int)
    for part in range(2):
        for nodes, block, bits in lineage.sweep(child, parent, level, np.arange(400), 2, part, 2):
            assert len(block) <= 128
            got[nodes] += np.bitwise_count(bits).sum(axis=1).astype(int)
    assert got.tolist() == [1 + sum(x in r.get(y, ()) for y in range(400)) for x in range(400)]


def test_empty_lineage(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lineage.lineage(none).count() == 0 and lineage.roots(none).count() == 0


def test_descendants_and_all_paths(spark):
    rnd = random.Random(3)
    links = [(i, rnd.randrange(max(0, i - 6), i)) for i in range(4, 24) for _ in range(2)] + [(2, 1), (1, 0), (30, 31), (31, 30), (32, 31), (33, 33), (34, 34), (34, 5)]
    links += [(40, 6), (41, 40), (42, 41), (40, 42), (41, 7), (43, 42), (43, 41), (42, 40)]  # a loop entered at two members, with links both ways
    links = sorted(set(links))
    df = spark.createDataFrame([("node", a, b) for a, b in links + links[:3]] + [("individual", 5, 6), ("individual", None, 1)], SCHEMA)
    ids = spark.createDataFrame([("node", 5), ("node", 90), ("node", 90), ("node", None), ("individual", 90), ("individual", 6)], "kind string, id long")
    up, r, everyone = {}, reach(links), {y for link in links for y in link}
    for a, b in links:
        up.setdefault(a, []).append(b)

    def ways(x, below):
        if x not in up:
            return [(x, *below)]
        return [w for p in up[x] if p != x and p not in below for w in ways(p, (x, *below))]

    below = [tuple(x) for x in lineage.descendants(df, 10**6, tasks=2).collect()]
    want = {("node", y, x) for x in everyone for y in r.get(x, ()) if x != y} | {("individual", 6, 5)}
    assert len(below) == len(set(below)) and set(below) == want
    rows = lineage.all_paths(df, 10**6, tasks=3, ids=ids).collect()
    got = [(x["kind"], *x["path"]) for x in rows]
    want = {("node", *w) for x in everyone for w in ways(x, ())} | {("individual", 6), ("individual", 6, 5), ("node", 90), ("individual", 90)}
    assert len(got) == len(set(got)) and set(got) == want
    assert all((x["root"], x["id"], x["depth"]) == (x["path"][0], x["path"][-1], len(x["path"]) - 1) for x in rows)
    some = lineage.all_paths(df, 10**6, ids=ids, wanted=ids).select("kind", "path").collect()
    assert {(k, *w) for k, w in some} == {w for w in want if (w[0], w[-1]) in {("node", 5), ("node", 90), ("individual", 90), ("individual", 6)}}
    rows = {(x["kind"], x["id"]): tuple(x)[2:] for x in lineage.lineage(df, 10**6, tasks=1, ids=ids).collect()}
    assert set(rows) == {("node", x) for x in everyone | {90}} | {("individual", x) for x in (5, 6, 90)}
    assert rows["node", 90] == rows["individual", 90] == (False, 1, 0, 0, [90], 0)


def test_walks_in_small_chunks(monkeypatch):
    monkeypatch.setattr(lineage, "WALKS", 3)
    monkeypatch.setattr(lineage, "CELLS", 5)
    up = [[], [0], [0, 1], [1, 2], [0, 2, 3], [], [4, 5, 3]]
    at = np.cumsum([0] + [len(x) for x in up])
    top = np.array([not x for x in up])

    def ways(x):
        return [[x]] if not up[x] else [[*w, x] for p in up[x] for w in ways(p)]

    got = [w for way in lineage.walks(np.concatenate(up).astype(int), at, top, np.arange(7), np.arange(7)) for w in way.tolist()]
    assert sorted(got) == sorted(w for x in range(7) for w in ways(x))
    assert [(s.start, s.stop) for s in lineage._spans(np.array([2, 2, 9, 1, 0, 3]), 5)] == [(0, 2), (2, 3), (3, 6)]
