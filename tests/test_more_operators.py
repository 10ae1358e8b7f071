"""Variants over stretches, branch two-locus statistics, relatedness matrix, distances of any two trees, options of simplify and union, against plain definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import genotypes as ge
from kinweave.operators import linkage as ld
from kinweave.operators import localtrees as lt
from kinweave.operators import relatedness as re_
from kinweave.operators import statistics as st
from kinweave.operators import transforms as tr
from kinweave.sources import formats, store
from tests.brute import Plain, build


def test_variants(ragged, weave):
    p = Plain(ragged)
    want = p.genotypes(missing=True)
    for r in ge.variants(ragged).collect():
        assert r["states"] == want[r["site"]], r["site"]
        assert r["alleles"][0] == p.sites[r["site"]][1] and r["num_missing"] == want[r["site"]].count(None)
        assert r["counts"] == [want[r["site"]].count(a) for a in r["alleles"]]
        n = len(p.samples) - r["num_missing"]
        assert r["frequencies"] == [k / n if n else None for k in r["counts"]]
    w = Plain(weave)
    some = ge.variants(weave, 3, 8, samples=[4, 1, 0], user_alleles=["G", "C", "T", "A"]).orderBy("site").collect()
    assert [r["site"] for r in some] == [1, 2]
    for r in some:
        assert r["states"] == [w.genotypes()[r["site"]][i] for i in (4, 1, 0)] and r["alleles"] == ["G", "C", "T", "A"]
    hap = {r["sample"]: r["haplotype"] for r in ge.haplotypes(weave, left=3, right=8).collect()}
    assert hap == {s: "".join(w.genotypes()[k][i] for k in (1, 2)) for i, s in enumerate(w.samples)}
    whole = weave.with_tables(sites=weave.sites.withColumn("position", F.floor("position").cast("double")))
    full = {r["sample"]: r["alignment"] for r in ge.alignments(whole, "N" * 12).collect()}
    part = {r["sample"]: r["alignment"] for r in ge.alignments(whole, "N" * 12, left=2, right=9).collect()}
    assert part == {k: v[2:9] for k, v in full.items()}
    with pytest.raises(ValueError):
        ge.variants(weave, 5, 3)
    assert ge.remapped(["A", "G"], ["G", "T"]) == ([2, 0], ["G", "T", "A"]) and set(ge.random_nucleotides(50, 1)) <= set("ACGT")


@pytest.mark.parametrize("name", ["weave", "bushy"])
def test_branch_two_locus(name, request):
    g = request.getfixturevalue(name)
    p = Plain(g)
    n = len(p.samples)
    at = [a for a, _, _ in p.trees]
    pairs = list(itertools.product(at, at))

    def branches(x):
        t = p.parent_at(x)
        return [(p.time[t[u]] - p.time[u], set(p.below(t, u))) for u in p.live(t) if u in t]

    got = {(r["position_a"], r["position_b"]): r for r in ld.branch_two_locus(g, g.spark.createDataFrame(pairs, "position_a double, position_b double"), ("D2", "pi2", "Dz", "D", "D2_unbiased")).collect()}
    for x, y in pairs:
        d2 = pi2 = dz = d1 = un = 0.0
        for (la, a), (lb, b) in itertools.product(branches(x), branches(y)):
            pa, pb, pab = len(a) / n, len(b) / n, len(a & b) / n
            d = pab - pa * pb
            w = la * lb
            d2 += w * d * d
            d1 += w * d
            dz += w * d * (1 - 2 * pa) * (1 - 2 * pb)
            pi2 += w * pa * (1 - pa) * pb * (1 - pb)
            k = [len(a & b), len(a - b), len(b - a), n - len(a | b)]
            un += w * (k[0] * (k[0] - 1) * k[3] * (k[3] - 1) + k[1] * (k[1] - 1) * k[2] * (k[2] - 1) - 2 * k[0] * k[1] * k[2] * k[3]) / (n * (n - 1) * (n - 2) * (n - 3))
        r = got[x, y]
        assert [r["D2"], r["pi2"], r["Dz"], r["D"], r["D2_unbiased"]] == pytest.approx([d2, pi2, dz, d1, un], abs=1e-9)


def test_relatedness_matrix(weave):
    p = Plain(weave)
    sets = [[0, 1], [2, 4], [3]]
    share = np.zeros((5, 5))
    for l, r, t in p.trees:
        for c, q in t.items():
            b = p.below(t, c)
            for i, j in itertools.product(b, b):
                share[i, j] += (r - l) * (p.time[q] - p.time[c]) / p.L
    k = np.array([[np.mean([share[i, j] for i in a for j in b]) for b in sets] for a in sets])
    centred = k - k.mean(0)[None, :] - k.mean(1)[:, None] + k.mean()
    got = np.zeros((3, 3))
    for r in re_.relatedness_matrix(weave, st.Sets.of(weave, sets), None, "branch").collect():
        got[r["i"], r["j"]] = r["value"]
    assert got == pytest.approx(centred)


def test_distances_of_any_trees(weave, bushy):
    p = Plain(weave)
    spark = weave.spark
    pairs = spark.createDataFrame(list(itertools.product(range(3), range(3))), "tree long, other_tree long")
    clades = [{frozenset(p.below(t, u)) for u in p.live(t)} for _, _, t in p.trees]
    assert {(r["tree"], r["other_tree"]): r["rf"] for r in lt.rf_distance(weave, weave, pairs).collect()} == {(i, j): len(clades[i] ^ clades[j]) for i in range(3) for j in range(3)}

    def vector(t, mix):
        out = []
        root = p.roots(t)[0]
        for a, b in itertools.combinations(p.samples, 2):
            m = p.mrca(t, a, b)
            out.append((1 - mix) * (len(p.up(t, m)) - 1) + mix * (p.time[root] - p.time[m]))
        return np.array(out + [(1 - mix) + mix * (p.time[t[s]] - p.time[s]) for s in p.samples])

    for mix in (0.0, 0.4):
        got = {(r["tree"], r["other_tree"]): r["kc"] for r in lt.kc_distance(weave, weave, pairs, mix).collect()}
        for i, j in itertools.product(range(3), range(3)):
            assert got[i, j] == pytest.approx(np.linalg.norm(vector(p.trees[i][2], mix) - vector(p.trees[j][2], mix)))
    cut = tr.keep_intervals(weave, [(0, 12)])
    assert lt.kc_distance_along(weave, cut) == pytest.approx(0.0)
    assert {(r["tree"], r["other_tree"]): r["same"] for r in lt.same_trees(weave, cut, pairs).collect()} == {(i, j): i == j for i in range(3) for j in range(3)}
    b = Plain(bushy)
    assert {(r["tree"], r["root"]) for r in lt.roots(bushy, 9).collect()} == set() and lt.roots(bushy, 8).count() == len(b.trees)
    tracked = {(r["tree"], r["node"]): r["num_tracked"] for r in lt.tracked(bushy, bushy.nodes.where("id in (0, 1, 3)").select("id")).collect()}
    assert tracked == {(i, u): k for i, (_, _, t) in enumerate(b.trees) for u in b.live(t) if (k := len(b.below(t, u, [0, 1, 3])))}
    assert {(r["site"], r["tree"], r["num_mutations"]) for r in lt.sites_of_trees(bushy).collect()} == {(0, 0, 1), (1, 1, 2), (2, 1, 1)}
    assert lt.newick(bushy, labels={5: "x", 2: "y"}, lengths=False, root=8).first()["newick"] == "(,y,x,);"


def test_simplify_options(weave):
    p = Plain(weave)
    keep = weave.spark.createDataFrame([(0, 0), (2, 1), (3, 2)], "id long, order long")
    owned = weave.with_tables(nodes=weave.nodes.withColumn("individual", F.when(F.col("id") == 7, 0).otherwise(-1).cast("long")), individuals=weave.spark.createDataFrame([(0, 0, [], [], None)], weave.individuals.schema))
    s, to = tr.simplify(owned, keep, keep_unary_in_individuals=True)
    m = {r["old"]: r["new"] for r in to.collect()}
    q = Plain(s)
    for l, r, t in p.trees:
        stay = {0, 2, 3, 7, *(p.mrca(t, a, b) for a, b in itertools.combinations((0, 2, 3), 2))} & {u for x in (0, 2, 3) for u in p.up(t, x)}
        top = {p.mrca(t, *x) for x in itertools.combinations((0, 2, 3), 2)}
        want = {}
        for u in stay:
            above = [x for x in p.up(t, u)[1:] if x in stay]
            if above:
                want[m[u]] = m[above[0]]
        assert q.parent_at(l) == want, (l, top)
    flags, _ = tr.simplify(weave, keep, update_sample_flags=False)
    assert flags.nodes.where("flags = 1").count() == 3
    # trees at sites only: ends move to sites
    g = build(weave.spark, 10, [0, 0, 0, 1, 2, 3], [0, 1, 2], [(0, 4, 3, 0), (0, 4, 3, 1), (4, 10, 4, 0), (4, 10, 4, 1), (0, 7, 5, 2), (0, 4, 5, 3), (4, 7, 5, 4)], [(2, "0"), (5, "0")], [(0, 3, -1, None, "1"), (1, 4, -1, None, "1")])
    r, to = tr.simplify(g, reduce_to_site_topology=True)
    m = {x["old"]: x["new"] for x in to.collect()}
    assert sorted(tuple(x) for x in r.edges.select("left", "right", "parent", "child").collect()) == sorted(
        [(0.0, 5.0, m[3], 0), (0.0, 5.0, m[3], 1), (5.0, 10.0, m[4], 0), (5.0, 10.0, m[4], 1), (0.0, 10.0, m[5], 2), (0.0, 5.0, m[5], m[3]), (5.0, 10.0, m[5], m[4])])
    assert Plain(r).genotypes() == Plain(g).genotypes()


def test_union_options_and_dicts(weave, lone):
    same = weave.nodes.select(F.col("id").alias("other"), F.col("id").alias("own"))
    assert tr.shared_part_differs(weave, weave, same) == {}
    other = weave.with_tables(edges=weave.edges.where("id > 0"))
    with pytest.raises(ValueError):
        tr.union(weave, other, same, check_shared_equality=True)
    three = tr.concatenate(lone, lone, lone)
    assert three.sequence_length == 9 and [r for _, r in sorted(Plain(three).genotypes().items())] == 3 * [r for _, r in sorted(Plain(lone).genotypes().items())]
    back = store.from_dict(weave.spark, store.as_dict(weave))
    assert tr.difference(weave, back) == {} and back.sequence_length == 12
    lines = list(formats.macs_lines(lone))
    assert lines[0] == "COMMAND:\tnot_macs 4 3.0" and [x.split("\t")[-1] for x in lines[2:]] == ["".join(r) for _, r in sorted(Plain(lone).genotypes().items())]
    assert math.isclose(float(lines[3].split("\t")[2]), 0.5)


def test_relatedness_of_sites_and_nodes(weave):
    p = Plain(weave)
    w = {s: x for s, x in zip(p.samples, (1.0, -0.5, 2.0, 0.25, 3.0))}
    rows = weave.spark.createDataFrame(list(w.items()), "sample long, w double")
    geno = p.genotypes()
    share = np.array([[sum(row[i] == row[j] != p.sites[s][1] for s, row in geno.items()) for j in range(5)] for i in range(5)], float)
    plain = {r["sample"]: r["w"] for r in re_.relatedness_vector(weave, rows, ["w"], "s", centre=False, span_normalise=False, mode="site").collect()}
    assert [plain.get(s, 0.0) for s in p.samples] == pytest.approx(share @ np.array(list(w.values())))
    c = np.eye(5) - 0.2
    centred = {r["sample"]: r["w"] for r in re_.relatedness_vector(weave, rows, ["w"], "s", mode="site").collect()}
    assert [centred[s] for s in p.samples] == pytest.approx(c @ share @ c @ np.array(list(w.values())) / p.L)
    got = {r["sample"]: r["w"] for r in re_.relatedness_vector(weave, rows, ["w"], "n", centre=False, nodes=weave.nodes.where("id in (5, 2)").select("id")).collect()}
    for u in (5, 2):
        want = 0.0
        for l, r, t in p.trees:
            for x in p.up(t, u):
                if x in t:
                    want += (r - l) / p.L * (p.time[t[x]] - p.time[x]) * sum(w[s] for s in p.below(t, x))
        assert got[u] == pytest.approx(want)


def test_parsimony_with_a_given_state_and_strict_summaries(lone):
    from kinweave.operators import kernels as ke

    rows = lone.spark.createDataFrame([(0, s, 1) for s in range(4)], "site long, sample long, state int")
    r = ke.map_mutations(lone, rows, ["A", "G"], "A").collect()
    assert [(x["ancestral_state"], x["node"], x["state"]) for x in r] == [("A", 6, "G")]
    assert ke.map_mutations(lone, rows, ["A", "G"]).first()["place"] == -1
    with pytest.raises(ValueError):
        ke.map_mutations(lone, rows, ["A", "G"], 2)
    s = st.Sets.all(lone)
    st.stat(lone, s, {"x": lambda x: x[0] * (4 - x[0])}, strict=True)
    with pytest.raises(ValueError):
        st.stat(lone, s, {"x": lambda x: x[0]}, strict=True)


@pytest.mark.parametrize("name", ["weave", "ragged", "bushy"])
def test_sweeps_and_paths_count_alike(name, request, monkeypatch):
    from kinweave.plans import ancestry as an
    from kinweave.plans import counting

    g = request.getfixturevalue(name)
    p = Plain(g)
    sets = g.spark.createDataFrame([(p.samples[0], 0), (p.samples[1], 1), (p.samples[2], 1), (p.samples[0], 1)], "sample long, set int")
    rows = []
    for nodes, edges in ((10**9, 10**9), (10**9, 2), (0, 1)):  # one shard, many shards, paths
        monkeypatch.setattr(an, "SWEEP_NODES", nodes)
        monkeypatch.setattr(counting, "SHARD_EDGES", edges)
        fresh = g.with_tables()
        rows.append(sorted(tuple(r) for r in an.sample_counts(fresh, sets, 2, "t").select("node", "left", "right", "x_0", "x_1", "x_all").collect()))
    assert rows[0] == rows[1] == rows[2]
    for u, l, r, a, b, every in rows[0]:
        for x, y, t in p.trees:
            if l < y and x < r:
                assert (a, b, every) == (len(p.below(t, u, [p.samples[0]])), len(p.below(t, u, p.samples[:3])), len(p.below(t, u)))


def test_sweep_over_random_trees():
    from kinweave.plans.counting import sweep

    rng = np.random.default_rng(4)
    n, cuts = 40, np.arange(0.0, 30.0)
    trees = []
    up = np.array([rng.integers(i + 1, n) if i < n - 1 else -1 for i in range(n)])
    for _ in cuts:
        for c in rng.integers(0, n - 1, rng.choice([1, 2, 20])):
            up[c] = rng.integers(c + 1, n) if rng.random() < 0.9 else -1
        trees.append(up.copy())
    rows = [(a, a + 1, t[c], c) for a, t in zip(cuts, trees) for c in range(n) if t[c] >= 0]
    left, right, parent, child = map(np.array, zip(*rows))
    own = rng.integers(0, 3, (n, 2)).astype(float)
    nodes, places, by = sweep(0.0, 30.0, left, right, parent, child, own)
    for a, t in zip(cuts, trees):
        want = own.copy()
        for c in range(n):  # children have smaller numbers than parents
            if t[c] >= 0:
                want[t[c]] += want[c]
        got = np.zeros((n, 2))
        np.add.at(got, nodes[places <= a], by[places <= a])
        assert np.array_equal(got, want)
    total = np.zeros((n, 2))
    np.add.at(total, nodes, by)
    assert not total.any()


def test_order_of_populations_and_edges(ragged):
    pops = ragged.with_tables(nodes=ragged.nodes.withColumn("population", F.when(F.col("id") == 3, 0).when(F.col("id") == 1, 1).otherwise(-1).cast("long")), migrations=ragged.migrations.limit(0), mutations=ragged.mutations.limit(0), sites=ragged.sites.limit(0))
    chosen = pops.nodes.where("id in (1, 3)").select("id", F.col("id").alias("order"))
    s = tr.subset(pops, chosen)
    assert [r["population"] for r in s.nodes.orderBy("id").collect()] == [0, 1] and [bytes(r["metadata"]) for r in s.populations.orderBy("id").collect()] == [b"y", b"x"]
    kept = tr.subset(pops, chosen, reorder_populations=False)
    assert [r["population"] for r in kept.nodes.orderBy("id").collect()] == [1, 0] and kept.populations.count() == 2
    back = tr.sort(pops, [F.col("left").desc(), "child", "parent"]).edges.orderBy("id").collect()
    assert [(r["left"], r["child"]) for r in back] == sorted(((r["left"], r["child"]) for r in back), key=lambda x: (-x[0], x[1]))
