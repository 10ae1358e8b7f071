"""Parsimony, the copying model, topologies and relatedness against plain definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import topologies as tp
from kinweave.operators import kernels as ke
from kinweave.operators import localtrees as lt
from kinweave.operators import relatedness as re_
from kinweave.operators import tables as tb
from tests.brute import Plain


def test_counts_of_trees():
    assert [tp.num_shapes(n) for n in range(1, 8)] == [1, 1, 2, 5, 12, 33, 90]
    assert [tp.num_trees(n) for n in range(1, 6)] == [1, 1, 4, 26, 236]
    for n in (3, 4):
        every = [tp.canonical(t) for t in tp.all_trees(n)]
        assert len(set(every)) == len(every) == tp.num_trees(n)
        for t in every:
            assert tp.canonical(tp.unrank(n, *tp.rank(t))) == t


def test_generated(spark):
    s = tp.star(spark, 5)
    assert s.edges.count() == 5 and lt.shape_indexes(s).first()["sackin"] == 5
    c = tp.comb_tree(spark, 5)
    assert lt.shape_indexes(c).first()["sackin"] == 4 + 4 + 3 + 2 + 1 and lt.shape_indexes(c).first()["colless"] == 3 + 2 + 1
    b = tp.balanced(spark, 8)
    assert lt.shape_indexes(b).first()["colless"] == 0
    assert tp.random_binary(spark, 9, seed=3).nodes.count() == 17
    t = tp.split_polytomies((0, 1, 2, (3, 4, 5)), random.Random(1))
    assert sorted(x for x in repr(t) if x.isdigit()) == list("012345") and all(len(x) == 2 for x in [t, *[y for y in t if isinstance(y, tuple)]])


def test_topologies(lone):
    sets = lone.spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2)], "sample long, set int")
    got = {(r["sets"], r["topology"]): r["n"] for r in tp.count_topologies(lone, sets).collect()}
    assert got["0,1,2", "(2,(0,1))"] == 1 and got["0,1,2", "(0,(1,2))"] == 1 and got["0,1", "(0,1)"] == 1 and got["0,2", "(0,2)"] == 2 and got["2", "2"] == 2
    assert ("0,1,2", "(1,(0,2))") not in got


def test_parsimony(weave):
    g = weave
    p = Plain(g)
    rows = [(s, i, int(a != p.sites[s][1])) for s, row in p.genotypes().items() for i, a in zip(p.samples, row)]
    got = {r["site"]: (r["ancestral_state"], r["node"], r["state"]) for r in ke.map_mutations(g, g.spark.createDataFrame(rows, "site long, sample long, state int")).collect()}
    assert got[0] == (0, 5, 1) and got[1] == (0, 3, 1)
    kids, tops, time = {6: [4, 5], 4: [0, 1], 5: [2, 3]}, [6], dict.fromkeys(range(7), 0.0)
    for states in itertools.product((0, 1, 2), repeat=4):
        least = min(
            sum(a != b for a, b in ((r, x), (r, y), (x, states[0]), (x, states[1]), (y, states[2]), (y, states[3]))) for r in range(3) for x in range(3) for y in range(3)
        )
        assert len(ke.parsimony(kids, tops, time, dict(enumerate(states)))[1]) == least


def test_copying_model(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2, (6, 3))
    q = np.array([*h[:3, 0], *h[3:, 2]])
    q[1] = -1
    m = ke.CopyingModel(h, np.full(6, 0.1), np.full(6, 0.02))
    f, c = m.forward(q)

    def path_probability(path):
        p = 1.0
        for l, j in enumerate(path):
            t = 1 / 3 if l == 0 else (1 - 0.1) * (path[l - 1] == j) + 0.1 / 3
            p *= t * m._emit(l, q[l])[j]
        return p

    every = {p: path_probability(p) for p in itertools.product(range(3), repeat=6)}
    assert np.exp(np.log(c).sum()) == pytest.approx(sum(every.values()))
    post = f * m.backward(q, c)
    want = np.array([[sum(v for p, v in every.items() if p[l] == j) for j in range(3)] for l in range(6)]) / sum(every.values())
    assert post / post.sum(1, keepdims=True) == pytest.approx(want)
    assert path_probability(tuple(m.viterbi(q))) == pytest.approx(max(every.values()))
    got = ke.viterbi_paths(m, spark.createDataFrame([(7, [int(x) for x in q])], "query long, states array<int>")).first()
    assert got["path"] == m.viterbi(q).tolist()


def test_relatedness(weave):
    g, p = weave, Plain(weave)
    n = len(p.samples)
    share = np.zeros((n, n))
    for l, r, parent in p.trees:
        for c, q in parent.items():
            below = p.below(parent, c)
            for i, j in itertools.product(below, repeat=2):
                share[i, j] += (r - l) * (p.time[q] - p.time[c]) / p.L
    centre = np.eye(n) - 1 / n
    k = centre @ share @ centre
    w = np.array([1.0, -2.0, 0.5, 3.0, -0.25])
    rows = g.spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "sample long, w double")
    got = {r["sample"]: r["w"] for r in re_.relatedness_vector(g, rows, ["w"], "t").collect()}
    assert [got[i] for i in range(n)] == pytest.approx((k @ w).tolist())
    values, vectors, _ = re_.principal_components(g, 2, iterations=3)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(k))[::-1][:2] * p.L)
    # a window, and pairs of samples as individuals
    part = np.zeros((n, n))
    l, r, parent = p.trees[1]
    for c, q in parent.items():
        below = p.below(parent, c)
        for i, j in itertools.product(below, repeat=2):
            part[i, j] += (r - l) * (p.time[q] - p.time[c])
    owner = [0, 0, 1, 1, 2]
    own = g.with_tables(nodes=g.nodes.withColumn("individual", F.when(F.col("id") < 5, F.floor(F.col("id") / 2)).otherwise(-1).cast("long")))
    mean = np.array([[1 / owner.count(i) if o == i else 0.0 for o in owner] for i in range(3)])
    c3 = np.eye(3) - 1 / 3
    values, vectors, ids = re_.principal_components(own, 2, iterations=3, window=(l, r), individuals=True)
    assert ids == [0, 1, 2] and values == pytest.approx(np.sort(np.linalg.eigvalsh(c3 @ mean @ part @ mean.T @ c3))[::-1][:2])


def test_tables(weave):
    p = Plain(weave)
    d = tb.edge_diffs(weave).where("position = 9").orderBy("direction", "place").collect()
    into = sorted((e for e in p.edges if e[0] == 9), key=lambda e: (p.time[e[2]], e[2], e[3]))
    out = sorted((e for e in p.edges if e[1] == 9), key=lambda e: (-p.time[e[2]], -e[2], -e[3]))
    assert [(r["direction"], r["edge"]) for r in d] == [("in", e[4]) for e in into] + [("out", e[4]) for e in out]
    assert tb.coiterate(weave, weave).count() == 3 and tb.tree_at(weave, 7.0).count() == len(p.parent_at(7))
    k, _ = tb.keep_rows(weave, "edges", F.col("left") > 0)
    assert [r[0] for r in k.edges.select("id").orderBy("id").collect()] == list(range(k.edges.count()))
    more = tb.append_rows(weave, "sites", weave.spark.createDataFrame([(9.5, "G", None)], "position double, ancestral_state string, metadata binary"))
    assert more.sites.agg(F.max("id")).first()[0] == 4 and tb.truncate(more, "sites", 1).sites.count() == 1 and tb.clear(weave).nodes.count() == 0
    assert tb.update_rows(weave, "nodes", F.col("id") == 0, {"time": F.lit(-1.0)}).nodes.where("time = -1").count() == 1
    assert lt.kc_neighbours(weave).count() == 2
