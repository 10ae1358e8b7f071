"""Table transformations keep what they should."""

import pytest
from pyspark.sql import functions as F

from kinweave.model import violations
from kinweave.operators import statistics as st
from kinweave.operators import transforms as tr
from tests.brute import Plain, build


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def reduced(p, parent, keep):
    """Parents among the kept samples and the nodes where their ways first meet."""
    stay = {*keep, *(m for a in keep for b in keep if a < b and (m := p.mrca(parent, a, b)) is not None)}
    return {u: next(x for x in p.up(parent, u)[1:] if x in stay) for u in stay if any(x in stay for x in p.up(parent, u)[1:])}


@pytest.mark.parametrize("name,keep", [("weave", [0, 2, 3]), ("bushy", [7, 1, 4, 6, 0]), ("ragged", [0, 3, 4]), ("ragged", [1, 2])])
def test_simplify(name, keep, request):
    g = request.getfixturevalue(name)
    g = g.with_tables(migrations=g.migrations.limit(0))
    p = Plain(g)
    s, to = tr.simplify(g, g.spark.createDataFrame(list(zip(keep, range(9))), "id long, order long"))
    m = {r["old"]: r["new"] for r in to.collect()}
    assert [m[k] for k in keep] == list(range(len(keep))) and violations(s).where("rule <> 'times of a site are partly unknown'").count() == 0
    q = Plain(s)
    for l, r, parent in p.trees:
        assert {(m[a], m[b]) for a, b in reduced(p, parent, keep).items()} == set(q.parent_at(l).items())
    assert q.time == {m[k]: t for k, t in p.time.items() if k in m}
    at = {x: i for i, (x, _) in q.sites.items()}
    before, after = p.genotypes(), q.genotypes()
    for i, (x, anc) in p.sites.items():
        want = [before[i][p.samples.index(k)] for k in keep]
        assert (after[at[x]] if x in at else [anc] * len(keep)) == want
    if name != "ragged":
        d0 = st.one_way(g, "diversity", st.Sets.of(g, [keep]), None, "branch").first()["value"]
        assert st.one_way(s, "diversity", st.Sets.all(s), None, "branch").first()["value"] == pytest.approx(d0)


def test_simplify_keeps_input_roots(spark):
    """A node that is the root over a part of the sequence, with a branch above it elsewhere, stays as root there."""
    g = build(spark, 10, [0, 0, 1, 2, 3], [0, 1], [(0, 10, 2, 0), (0, 10, 2, 1), (0, 10, 3, 2), (0, 5, 4, 3)], [(1, "0"), (7, "0")], [(0, 3, -1, None, "1"), (1, 3, -1, None, "1")])
    s, to = tr.simplify(g, g.samples().withColumn("order", F.col("id")), keep_input_roots=True)
    m = {r["old"]: r["new"] for r in to.collect()}
    assert table(s.edges, "left", "right", "parent", "child") == sorted([(0.0, 10.0, m[2], 0), (0.0, 10.0, m[2], 1), (0.0, 5.0, m[4], m[2]), (5.0, 10.0, m[3], m[2])])
    assert table(s.mutations, "site", "node") == [(0, m[2]), (1, m[3])] and violations(s).count() == 0
    plain, _ = tr.simplify(g)
    assert plain.edges.count() == 2


def test_intervals(weave):
    iv = [(1, 4.5), (8, 10)]
    p, k = Plain(weave), tr.keep_intervals(weave, iv)
    q = Plain(k)
    for x in (0.5, 1, 3, 4.5, 7, 8, 9, 9.5, 11):
        assert q.parent_at(x) == (p.parent_at(x) if any(a <= x < b for a, b in iv) else {})
    assert table(k.sites, "id", "position") == [(0, 1.0), (1, 4.0)] and table(k.mutations, "site", "node") == [(0, 5), (1, 3)]
    d = tr.delete_intervals(weave, [(0, 1), (4.5, 8), (10, 12)])
    assert tr.difference(k, d) == {}
    t = tr.trim(tr.keep_intervals(weave, [(1, 3)]))
    assert t.sequence_length == 2 and table(t.sites, "position") == [(0.0,)]
    back = tr.keep_intervals(tr.keep_intervals(weave, [(0, 5)]), [(0, 10)])
    assert back.edges.agg(F.max("right")).first()[0] == 5


def test_split_and_decapitate(lone):
    p = Plain(lone)
    crossing = [e for e in p.edges if p.time[e[3]] < 1.0 < p.time[e[2]]]
    s = tr.split_edges(lone, 1.0)
    assert s.nodes.count() == len(p.time) + len(crossing) and s.edges.count() == len(p.edges) + len(crossing) and violations(s).count() == 0
    assert Plain(s).genotypes() == p.genotypes()
    d = Plain(tr.decapitate(lone, 1.0))
    assert len(d.edges) == len([e for e in p.edges if p.time[e[2]] <= 1.0]) + len(crossing) and all(d.time[e[2]] <= 1.0 for e in d.edges)


def test_squash_sort_subset(weave):
    pieces = weave.edges.withColumn("x", F.explode(F.sequence(F.col("left").cast("int"), F.col("right").cast("int") - 1))).withColumn("left", F.col("x").cast("double")).withColumn("right", F.col("x") + 1.0)
    assert table(tr.squash(pieces), "left", "right", "parent", "child") == table(tr.squash(weave.edges), "left", "right", "parent", "child")
    assert tr.squash_errors(weave.edges).count() == 0
    s = tr.sort(weave.with_tables(edges=weave.edges.orderBy(F.rand(1)).withColumn("id", F.col("id") + 50)))
    assert [tuple(r) for r in s.edges.orderBy("id").select("parent", "child", "left").collect()] == sorted((r["parent"], r["child"], r["left"]) for r in weave.edges.collect())
    all_nodes = weave.nodes.select("id", F.col("id").alias("order"))
    assert tr.difference(tr.subset(weave, all_nodes, False), tr.sort(weave)) == {}
    chosen = [1, 5, 6, 2]
    few = tr.subset(weave, weave.nodes.where(F.col("id").isin(chosen)).select("id", F.col("id").alias("order")))
    new = {u: i for i, u in enumerate(sorted(chosen))}
    p = Plain(weave)
    assert table(few.edges, "left", "right", "parent", "child") == sorted((l, r, new[a], new[b]) for l, r, a, b, _ in p.edges if a in new and b in new)
    assert few.mutations.count() == len([m for m in p.mutations if m[2] in new])


def test_union_and_concatenate(weave):
    young = weave.nodes.where("id <> 1")
    a = tr.subset(weave, young.select("id", F.col("id").alias("order")), False)
    back = weave.nodes.select(F.col("id").alias("other"), F.when(F.col("id") == 1, -1).when(F.col("id") > 1, F.col("id") - 1).otherwise(F.col("id")).alias("own"))
    u = tr.union(a, weave, back)
    p = Plain(weave)
    assert u.nodes.count() == len(p.time) and u.edges.count() == len(p.edges)
    c = tr.concatenate(weave, weave)
    q = Plain(c)
    assert c.sequence_length == 24 and len(q.time) == len(p.time) + len(p.time) - len(p.samples) and len(q.edges) == 2 * len(p.edges) and violations(c).count() == 0
    once = [row for _, row in sorted(p.genotypes().items())]
    assert [row for _, row in sorted(q.genotypes().items())] == once + once


def test_sites_and_mutations(lone, weave):
    twice = lone.with_tables(sites=lone.sites.withColumn("position", F.when(F.col("id") == 1, 0.25).otherwise(F.col("position"))))
    assert violations(twice).where("rule = 'position is not unique'").count() == 1
    d = tr.deduplicate_sites(twice)
    assert d.sites.count() == 2 and table(d.mutations, "site")[:3] == [(0,), (0,), (0,)]
    p = tr.with_mutation_parents(lone.with_tables(mutations=lone.mutations.withColumn("parent", F.lit(-1).cast("long"))))
    assert table(p.mutations, "id", "parent") == table(lone.mutations, "id", "parent")
    t = {r["id"]: r["time"] for r in tr.with_mutation_times(weave).mutations.collect()}
    w = Plain(weave)
    for i, s, u, _ in w.mutations[:2]:  # a lone mutation lies in the middle of its branch
        assert t[i] == pytest.approx((w.time[u] + w.time[w.parent_at(w.sites[s][0])[u]]) / 2)
    gone = tr.delete_sites(lone, lone.spark.createDataFrame([(1,)], "id long"))
    assert table(gone.mutations, "site", "node") == [(0, 2), (0, 5), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_sorted_individuals(weave):
    rows = [(0, 0, [], [2, -1], None), (1, 0, [], [0], None), (2, 0, [], [], None)]
    schema = "id long, flags long, location array<double>, parents array<long>, metadata binary"
    g = weave.with_tables(individuals=weave.spark.createDataFrame(rows, schema))
    assert table(tr.sort_individuals(g).individuals, "id", "parents") == [(0, []), (1, [0, -1]), (2, [1])]
    loop = weave.with_tables(individuals=weave.spark.createDataFrame([(0, 0, [], [1], None), (1, 0, [], [0], None)], schema))
    with pytest.raises(ValueError):
        tr.sort_individuals(loop)
