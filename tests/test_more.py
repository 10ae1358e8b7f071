"""Two-locus estimators, the linear trait model, time windows, provenance and the command line."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.__main__ import lines, parser
from kinweave.functions import provenance
from kinweave.operators import coalescence as co
from kinweave.operators import linkage as ld
from kinweave.operators import statistics as st
from tests.brute import Plain


def ones(g):
    """Carriers of anything but the ancestral state, per site."""
    p = Plain(g)
    return {s: [int(a != p.sites[s][1]) for a in row] for s, row in p.genotypes().items()}


def test_unbiased_estimators(bushy):
    hap = ones(bushy)
    pairs = bushy.spark.createDataFrame([(0, 2), (1, 2), (0, 1)], "site_a long, site_b long")
    got = {(r["site_a"], r["site_b"]): r for r in ld.two_locus(bushy, pairs, ("D2_unbiased", "Dz_unbiased", "pi2_unbiased", "Dz", "pi2", "D_prime", "r")).collect()}
    for (a, b), r in got.items():
        x, y = hap[a], hap[b]
        d2 = dz = p2 = 0.0
        every = list(itertools.permutations(range(8), 4))
        for i, j, k, m in every:
            first = x[i] * y[i] * (1 - x[j]) * (1 - y[j]) - x[i] * (1 - y[i]) * (1 - x[j]) * y[j]
            second = x[k] * y[k] * (1 - x[m]) * (1 - y[m]) - x[k] * (1 - y[k]) * (1 - x[m]) * y[m]
            d2 += first * second
            dz += first * (1 - 2 * x[k]) * (1 - 2 * y[m])
            p2 += x[i] * (1 - x[j]) * y[k] * (1 - y[m])
        n = len(every)
        assert (r["D2_unbiased"], r["Dz_unbiased"], r["pi2_unbiased"]) == pytest.approx((d2 / n, dz / n, p2 / n), abs=1e-12)


def test_two_way(bushy):
    s = bushy.spark
    pairs = s.createDataFrame([(0, 1)], "site_a long, site_b long")
    x, y = ones(bushy)[0], ones(bushy)[1]
    i, j = [0, 1, 2, 4], [0, 3, 4, 6]
    r = ld.two_way(bushy, pairs, s.createDataFrame([(k,) for k in i], "sample long"), s.createDataFrame([(k,) for k in j], "sample long"), ("D2_ij", "r2_ij")).first()

    def d(k):
        a, b = np.array(x)[k], np.array(y)[k]
        return (a * b).mean() - a.mean() * b.mean(), np.sqrt(a.mean() * (1 - a.mean()) * b.mean() * (1 - b.mean()))

    (di, ui), (dj, uj) = d(i), d(j)
    assert r["D2_ij"] == pytest.approx(di * dj) and r["r2_ij"] == pytest.approx(di * dj / (ui * uj))


def test_linear_model(lone):
    w = [(0, 1.0, 0.5), (1, 2.0, -1.0), (2, 0.5, 0.25), (3, 4.0, 2.0)]
    df = lone.spark.createDataFrame(w, "sample long, y double, z double")
    got = st.trait_linear_model(lone, df, ["y"], ["z"], "t", span_normalise=False).first()["value"]
    want = 0.0
    y, z = np.array([r[1] for r in w]), np.array([[1, r[2]] for r in w])
    for g in ones(lone).values():
        for flip in (0, 1):
            x = np.array([c ^ flip for c in g], float)
            if 0 < x.sum() < 4:
                b = np.linalg.lstsq(np.column_stack([x, z]), y, rcond=None)[0][0]
                want += b * b / 2
    assert got == pytest.approx(want)


def test_time_windows(lone, weave):
    p, cuts = Plain(lone), [0, 0.5, 2.5, 10]
    s = st.Sets.all(lone)
    whole = st.frequency_spectrum(lone, s, None, "branch", True)
    cut = st.frequency_spectrum(lone, s, None, "branch", True, time_windows=cuts)
    a = {r["bins"][0]: r["value"] for r in whole.collect()}
    b = {r["bins"][0]: r["value"] for r in cut.groupBy("bins").agg(F.sum("value").alias("value")).collect()}
    tips = [0.0, 0.0, 0.0]
    for c, q in p.trees[0][2].items():
        if len(p.below(p.trees[0][2], c)) == 1:
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                tips[k] += max(0, min(y, p.time[q]) - max(x, p.time[c]))
    assert a == pytest.approx(b) and {r["time_window"]: r["value"] for r in cut.where("bins[0] = 1").collect()} == pytest.approx({k: v for k, v in enumerate(tips) if v})
    w = Plain(weave)
    t = {r["time_window"]: r["value"] for r in co.coalescence_by_time(weave, st.Sets.all(weave), [(0, 0)], [0, 2, 5]).collect()}
    assert t == pytest.approx({k: sum(v for u, v in w.coalescences().items() if (w.time[u] >= 2) == k) for k in (0, 1)})
    met = p.coalescences()  # nodes at 0.7 and 1.1, and the root
    rates = co.coalescence_rates(lone, st.Sets.all(lone), [(0, 0)], [0, 1.5, float("inf")]).orderBy("time_window").collect()
    early = sum(v for u, v in met.items() if p.time[u] < 1.5) / sum(met.values())
    assert rates[0]["rate"] == pytest.approx(np.log(1 - early) / (0 - 1.5)) and rates[1]["rate"] == pytest.approx(1 / (2.6 - 1.5))


def test_provenance_and_command_line(weave):
    g = provenance.with_record(provenance.with_record(weave, "made"), "changed", {"x": 1})
    assert [r["parameters"]["command"] for r in provenance.records(g)] == ["made", "changed"] and provenance.problems(provenance.records(g)[0]) == []
    assert provenance.problems({"software": {}}) != []
    run = lambda *a: list(lines(weave, parser().parse_args(a)))
    assert "trees\t3" in run("info", "x") and len(run("edges", "x")) == 1 + 13 and len(run("trees", "x")) == 3


def test_command_line_genotypes(bushy):
    out = list(lines(bushy, parser().parse_args(["vcf", "x", "-P", "2"])))
    hap = ones(bushy)
    assert [x.split("\t")[9:] for x in out if not x.startswith("#")] == [[f"{r[i]}|{r[i + 1]}" for i in range(0, 8, 2)] for r in hap.values()]
