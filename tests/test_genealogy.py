"""Genealogies of our own against plain definitions (tests/brute.py)."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from kinweave.model import violations
from kinweave.operators import coalescence as co
from kinweave.operators import genotypes as ge
from kinweave.operators import linkage as ld
from kinweave.operators import localtrees as lt
from kinweave.operators import statistics as st
from kinweave.operators import tables as tb
from kinweave.plans import ancestry as an
from tests import brute

NAMES = ("weave", "lone", "ragged", "bushy")


@pytest.fixture(scope="module")
def made(spark):
    return {n: (g := getattr(brute, n)(spark), brute.Plain(g)) for n in NAMES}


def one(df):
    return df.first()["value"]


@pytest.mark.parametrize("name", NAMES)
def test_trees_and_branches(made, name):
    g, p = made[name]
    assert [(r["tree"], r["left"], r["right"]) for r in an.trees(g).orderBy("tree").collect()] == [(i, a, b) for i, (a, b, _) in enumerate(p.trees)]
    got = [r["total_branch_length"] for r in lt.total_branch_length(g).orderBy("tree").collect()]
    assert got == pytest.approx([p.branch_length(t) for _, _, t in p.trees])
    roots = {}
    for r in lt.roots(g).collect():
        roots.setdefault(r["tree"], []).append(r["root"])
    assert {k: sorted(v) for k, v in roots.items()} == {i: p.roots(t) for i, (_, _, t) in enumerate(p.trees)}
    assert violations(g).where("rule <> 'times of a site are partly unknown'").count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_statistics(made, name):
    g, p = made[name]
    s = st.Sets.all(g)
    for mode in ("branch", "site"):
        assert one(st.one_way(g, "diversity", s, None, mode)) == pytest.approx(p.diversity(mode))
    seg = sum(len(set(row)) - 1 for row in p.genotypes().values())
    assert one(st.one_way(g, "segregating_sites", s, span_normalise=False)) == pytest.approx(seg)
    few = p.samples[:3]
    assert one(st.one_way(g, "diversity", st.Sets.of(g, [few]), None, "branch")) == pytest.approx(p.diversity("branch", few))


@pytest.mark.parametrize("name", NAMES)
def test_spectrum(made, name):
    g, p = made[name]
    for mode in ("site", "branch"):
        want = p.spectrum(mode)
        got = {r["bins"][0]: r["value"] for r in st.frequency_spectrum(g, st.Sets.all(g), None, mode, polarised=True, span_normalise=False).collect()}
        assert [got.get(i, 0) for i in range(len(want))] == pytest.approx(want)
        folded = st.frequency_spectrum(g, st.Sets.all(g), None, mode, span_normalise=False)
        assert all(2 * r["bins"][0] <= len(p.samples) for r in folded.collect())


@pytest.mark.parametrize("name", NAMES)
def test_genotypes(made, name):
    g, p = made[name]
    want = p.genotypes()
    got = {(r["site"], r["sample"]): r["allele"] for r in ge.carriers(g).collect()}
    state = {s: sorted({m[3] for m in p.mutations if m[1] == s}) for s in p.sites}
    for s, row in want.items():
        for i, a in zip(p.samples, row):
            if a != p.sites[s][1]:
                assert got[s, i] is not None, (s, i, state)
    for r in ge.variant_summary(g, False).collect() if name != "ragged" else ():
        assert dict(zip(r["alleles"], r["counts"])) == {a: want[r["site"]].count(a) for a in r["alleles"]} and r["alleles"][0] == p.sites[r["site"]][1]
    if name != "ragged":
        hap = {r["sample"]: r["haplotype"] for r in ge.haplotypes(g).collect()}
        assert hap == {i: "".join(want[s][k] for s in sorted(want)) for k, i in enumerate(p.samples)}


def test_linkage(made, spark):
    for name in ("weave", "lone", "bushy"):
        g, p = made[name]
        geno = p.genotypes()
        pairs = list(itertools.combinations_with_replacement([s for s in geno if len(set(geno[s])) <= 2 and len({m[3] for m in p.mutations if m[1] == s}) == 1], 2))
        got = {(r["site_a"], r["site_b"]): r["r2"] for r in ld.two_locus(g, spark.createDataFrame(pairs, "site_a long, site_b long"), ("r2",)).collect()}
        for a, b in pairs:
            x, y = ([v != p.sites[s][1] for v in geno[s]] for s in (a, b))
            n = len(x)
            pa, pb, pab = sum(x) / n, sum(y) / n, sum(i and j for i, j in zip(x, y)) / n
            d = pa * (1 - pa) * pb * (1 - pb)
            assert math.isnan(got[a, b]) if d == 0 else got[a, b] == pytest.approx((pab - pa * pb) ** 2 / d)
    assert [r["site_b"] for r in ld.r2_array(made["weave"][0], 0, max_sites=1).collect()] == [1]


@pytest.mark.parametrize("name", NAMES)
def test_coalescence(made, name):
    g, p = made[name]
    got = {r["node"]: r["value"] for r in co.coalescence_counts(g, st.Sets.all(g), [(0, 0)]).collect() if r["value"]}
    want = p.coalescences()
    assert got == pytest.approx(want)
    if name == "lone":
        order, acc, cum = sorted(want, key=p.time.get), 0.0, []
        for u in order:
            acc += want[u]
            cum.append((acc / sum(want.values()), p.time[u]))
        q = co.coalescence_quantiles(g, st.Sets.all(g), [(0, 0)], [0.1, 0.3, 0.9])
        assert {r["q"]: r["time"] for r in q.collect()} == {x: next(t for c, t in cum if c >= x) for x in (0.1, 0.3, 0.9)}


@pytest.mark.parametrize("name", NAMES)
def test_ibd(made, name):
    g, p = made[name]
    got = {tuple(r) for r in co.ibd_segments(g, g.samples()).collect()}
    assert got == {(a, b, *s) for a, b in itertools.combinations(p.samples, 2) for s in p.descent(a, b)}


@pytest.mark.parametrize("name", NAMES)
def test_descendants(made, name):
    g, p = made[name]
    got = {r["node"]: r["value"] for r in st.mean_descendants(g, st.Sets.all(g)).collect()}
    assert {u: got.get(u, 0.0) for u in p.time} == pytest.approx(p.mean_descendants())


@pytest.mark.parametrize("name", NAMES)
def test_shapes(made, name):
    g, p = made[name]
    for r in lt.shape_indexes(g).collect():
        sackin, colless, b1, b2 = p.shape(p.trees[r["tree"]][2])
        assert (r["sackin"], r["b1"]) == pytest.approx((sackin, b1)) and r["colless"] == colless
        assert (r["b2"] is None) == (b2 is None) and (b2 is None or r["b2"] == pytest.approx(b2))


@pytest.mark.parametrize("name", NAMES)
def test_pairs(made, name, spark):
    g, p = made[name]
    pairs = list(itertools.combinations(p.samples, 2))
    got = {}
    for r in lt.common_ancestors(g, spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault((r["a"], r["b"]), []).append((r["left"], r["right"], r["mrca"], r["tmrca"]))
    for a, b in pairs:
        for l, r, parent in p.trees:
            m = p.mrca(parent, a, b)
            assert [(x[2], x[3]) for x in got.get((a, b), ()) if x[0] <= l and r <= x[1]] == ([] if m is None else [(m, p.time[m])])


def test_text_and_order(made):
    g, p = made["lone"]
    assert lt.newick(g, precision=1).first()["newick"] == "(n3:2.6,(n0:1.1,(n1:0.7,n2:0.7):0.4):1.5);"
    assert lt.traversal(g, "postorder").first()["nodes"] == [3, 0, 1, 2, 4, 5, 6]
    g, p = made["weave"]
    clades = [{frozenset(p.below(t, u)) for u in p.live(t)} for _, _, t in p.trees]
    assert [r["rf"] for r in lt.rf_neighbours(g).orderBy("tree").collect()] == [len(a ^ b) for a, b in zip(clades, clades[1:])]


def test_links(made):
    g, p = made["weave"]
    got = co.link_ancestors(g, g.samples(), g.nodes.where("id = 6").select("id")).collect()
    want = {(l, c) for l, r, t in p.trees for c in p.samples if 6 in p.up(t, c)}
    assert {(l, r["child"]) for r in got for l, b, _ in p.trees if r["left"] <= l and b <= r["right"]} == want and {r["parent"] for r in got} == {6}


def test_extremes(made):
    r = tb.extremes(made["ragged"][0]).first()
    assert (r["min_time"], r["max_time"], r["discrete_genome"], r["discrete_time"]) == (0.0, 5.5, True, False)
    g = made["lone"][0]
    old = g.with_tables(mutations=g.mutations.withColumn("time", F.when(F.col("id") == 0, 7.5)), nodes=g.nodes.withColumn("time", F.floor("time").cast("double")))
    r = tb.extremes(old).first()
    assert (r["max_time"], r["discrete_genome"], r["discrete_time"]) == (7.5, False, False)
    sizes = {x["table_name"]: (x["n_rows"], x["n_bytes"]) for x in tb.nbytes(g).collect()}
    assert sizes["sites"] == (3, 3 * 8 + 3 + 8 * 4 + 8 * 4) and sizes["migrations"] == (0, 8)


def test_tree_numbers_and_reverse_differences(made):
    g, p = made["weave"]
    for i in (0, 1, -1):
        assert {(r["parent"], r["child"]) for r in tb.tree_at_index(g, i).collect()} == {(b, a) for a, b in p.trees[i][2].items()}
    with pytest.raises(IndexError):
        tb.tree_at_index(g, 3)
    got = {(r["position"], r["direction"], r["edge"]) for r in tb.edge_diffs(g, reverse=True).collect()}
    want = {(r, "in", i) for l, r, _, _, i in p.edges} | {(l, "out", i) for l, r, _, _, i in p.edges if l > 0}
    assert got == want
