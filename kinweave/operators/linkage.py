"""Two-locus statistics of pairs of sites.

The samples with a derived allele are those below the mutations to it without those below the mutations away from it. Two such sets of one tree share the samples of the lower node,
if one node is above the other, or none: haplotypes of two sites of a tree are counted without listing a sample. Only for pairs whose sites lie in different trees the carriers are listed.
Counts with an ancestral allele follow by subtraction from the counts of each site. Pairs of sites are an input: there is no implicit all-pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.operators.genotypes import alleles, carriers
from kinweave.plans.ancestry import allele_counts, ancestry, bin_width, binned, inherited_states, sample_counts, trees
from kinweave.plans.staging import measured as stage


def _p(ab: Column, a: Column, b: Column, n: Column):
    return ab / n, a / n, b / n


def _d(ab, a, b, n):
    pab, pa, pb = _p(ab, a, b, n)
    return pab - pa * pb


def _r_under(a, b, n):
    return (a / n) * (b / n) * (1 - a / n) * (1 - b / n)


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(float("nan"))).otherwise(x / y)


def _d_prime(ab, a, b, n):
    d = _d(ab, a, b, n)
    pa, pb = a / n, b / n
    up = F.least(pa * (1 - pb), (1 - pa) * pb)
    down = F.least(pa * pb, (1 - pa) * (1 - pb))
    return F.when(d >= 0, _ratio(d, up)).otherwise(_ratio(d, down))


_GAMETES = ("AB", "Ab", "aB", "ab")
_A, _a, _B, _b = {"AB": 1, "Ab": 1}, {"aB": 1, "ab": 1}, {"AB": 1, "aB": 1}, {"Ab": 1, "ab": 1}


def _minus(p: dict, q: dict) -> dict:
    return {k: p.get(k, 0) - q.get(k, 0) for k in p | q}


def _times(*factors: dict) -> dict[tuple[str, ...], int]:
    """The product of linear forms in gamete frequencies as coefficients of sorted monomials."""
    out: dict[tuple[str, ...], int] = {(): 1}
    for f in factors:
        nxt: dict[tuple[str, ...], int] = {}
        for m, c in out.items():
            for g, d in f.items():
                key = tuple(sorted((*m, g)))
                nxt[key] = nxt.get(key, 0) + c * d
        out = nxt
    return out


def _plus(*terms: tuple[int, dict]) -> dict:
    out: dict = {}
    for k, p in terms:
        for m, c in p.items():
            out[m] = out.get(m, 0) + k * c
    return out


_DD = _plus((1, _times({"AB": 1}, {"ab": 1})), (-1, _times({"Ab": 1}, {"aB": 1})))


def _square(p: dict) -> dict:
    out: dict = {}
    for m, c in p.items():
        for k, d in p.items():
            key = tuple(sorted(m + k))
            out[key] = out.get(key, 0) + c * d
    return out


def _mul(p: dict, q: dict) -> dict:
    out: dict = {}
    for m, c in p.items():
        for k, d in q.items():
            key = tuple(sorted(m + k))
            out[key] = out.get(key, 0) + c * d
    return out


def _unbiased(polynomial: dict):
    """The estimator of a polynomial in gamete frequencies that is unbiased over samples without repetition: powers become falling factorials."""
    degree = len(next(iter(polynomial)))

    def f(ab, a, b, n):
        count = {"AB": ab, "Ab": a - ab, "aB": b - ab, "ab": n - a - b + ab}
        total = F.lit(0.0)
        for m, c in polynomial.items():
            if c:
                term = F.lit(float(c))
                for g in _GAMETES:
                    for k in range(m.count(g)):
                        term = term * (count[g] - k)
                total = total + term
        under = n
        for k in range(1, degree):
            under = under * (n - k)
        return _ratio(total, under)

    return f


#: name -> (summary of nAB, nA, nB, n; whether only derived alleles count; weighted by haplotypes or evenly)
STATISTICS = {
    "D": (_d, True, False),
    "D2": (lambda ab, a, b, n: _d(ab, a, b, n) ** 2, False, False),
    "r2": (lambda ab, a, b, n: _ratio(_d(ab, a, b, n) ** 2, _r_under(a, b, n)), False, True),
    "r": (lambda ab, a, b, n: _ratio(_d(ab, a, b, n), F.sqrt(_r_under(a, b, n))), True, False),
    "D_prime": (_d_prime, True, False),
    "Dz": (lambda ab, a, b, n: _d(ab, a, b, n) * (1 - 2 * a / n) * (1 - 2 * b / n), False, False),
    "pi2": (lambda ab, a, b, n: _r_under(a, b, n), False, False),
    "D2_unbiased": (_unbiased(_square(_DD)), False, False),
    "Dz_unbiased": (_unbiased(_mul(_DD, _times(_minus(_a, _A), _minus(_b, _B)))), False, False),
    "pi2_unbiased": (_unbiased(_times(_A, _a, _B, _b)), False, False),
}
#: two-way statistics: name -> (summary of the counts of one set, whether weighted by haplotypes); the result is the product over the two sets
TWO_WAY = {
    "D2_ij": (_d, False),
    "r2_ij": (lambda ab, a, b, n: _ratio(_d(ab, a, b, n), F.sqrt(_r_under(a, b, n))), True),
    "D2_ij_unbiased": (_unbiased(_DD), False),
}


def _of_one_tree(g: Genealogy, pairs: DataFrame, al: DataFrame, counts: DataFrame, x: str) -> DataFrame:
    """Samples with two derived alleles, for pairs of sites of one tree: ``site_a``, ``site_b``, ``ia``, ``ib``, ``n_ab``."""
    m = inherited_states(g).select("site", "position", "node", "derived_state", "inherited_state")
    signed = m.select("site", "position", "node", F.col("derived_state").alias("allele"), F.lit(1).alias("sign")).unionByName(m.select("site", "position", "node", F.col("inherited_state").alias("allele"), F.lit(-1).alias("sign")))
    t = signed.join(al.where("index > 0"), ["site", "allele"]).groupBy("site", "position", "node", "index").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    here = (F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))
    t = stage(t.join(counts.select("node", "left", "right", F.col(x).alias("x")), "node").where(here & (F.col("x") > 0)).select("site", "position", "node", "index", "sign", "x"), "signed")
    a = ancestry(g, g.mutations.select(F.col("node").alias("id")), "mutated").select(F.col("start").alias("node"), F.col("node").alias("above"), "left", "right", "depth")
    up = stage(t.join(a, "node").where(here).select("site", "index", (F.col("sign") * F.col("x")).alias("v"), F.col("above").alias("node"), "depth"), "above")
    t = t.select("site", "index", "node", "sign")
    low_a = pairs.join(up.toDF("site_a", "ia", "v", "node", "depth"), "site_a").join(t.toDF("site_b", "ib", "node", "sign"), ["site_b", "node"])
    low_b = pairs.join(up.where("depth > 0").toDF("site_b", "ib", "v", "node", "depth"), "site_b").join(t.toDF("site_a", "ia", "node", "sign"), ["site_a", "node"])
    keys = ["site_a", "site_b", "ia", "ib"]
    met = low_a.select(*keys, (F.col("v") * F.col("sign")).alias("v")).unionByName(low_b.select(*keys, (F.col("v") * F.col("sign")).alias("v")))
    return met.groupBy(*keys).agg(F.sum("v").alias("n_ab"))


def _of_two_trees(g: Genealogy, pairs: DataFrame, al: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for pairs whose sites lie in different trees, from the carriers of their alleles."""
    wanted = pairs.select(F.col("site_a").alias("site")).unionByName(pairs.select(F.col("site_b").alias("site"))).distinct()
    part = g.with_tables(mutations=g.mutations.join(wanted, "site", "left_semi").select(*g.mutations.columns))
    c = carriers(part).select("site", "sample", "allele").join(al.where("index > 0"), ["site", "allele"]).join(sets.select("sample"), "sample", "left_semi")
    c = stage(c.select("site", "sample", "index"), "carriers")  # read twice
    one = pairs.join(c.toDF("site_a", "sample", "ia"), "site_a")
    return one.join(c.toDF("site_b", "sample", "ib"), ["site_b", "sample"]).groupBy("site_a", "site_b", "ia", "ib").agg(F.count(F.lit(1)).alias("n_ab"))


def haplotype_counts(g: Genealogy, pairs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """For each pair of sites and of their alleles: ``site_a``, ``site_b``, ``ia``, ``ib`` (allele indexes), ``n_ab``, ``n_a``, ``n_b``, ``n``.

    Alleles that no sample has count as alleles, with zeros. ``samples`` (``sample``) restricts the counts to a sample set.
    """
    pairs = pairs.select("site_a", "site_b").distinct()
    al = alleles(g).select("site", "index", "allele")
    sets, key, x = g.samples().select(F.col("id").alias("sample"), F.lit(0).alias("set")), "all", "x_all"
    if samples is not None:
        sets, key, x = samples.select("sample", F.lit(0).alias("set")).distinct(), f"pairs:{uuid.uuid4().hex}", "x_0"
    n = sets.count()
    single = al.join(allele_counts(g, sets, 1, key).select("site", "allele", F.col(x).alias("k")), ["site", "allele"]).select("site", "index", "k")
    at = g.sites.select(F.col("id").alias("site"), "position")
    width = bin_width(g)
    tree = at.withColumn("_bin", F.floor(F.col("position") / width)).join(binned(trees(g), width), "_bin").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).select("site", "tree")
    placed = stage(pairs.join(tree.toDF("site_a", "_ta"), "site_a").join(tree.toDF("site_b", "_tb"), "site_b"), "pairs")
    near, far = (placed.where(F.col("_ta") == F.col("_tb") if same else F.col("_ta") != F.col("_tb")).select("site_a", "site_b") for same in (True, False))
    both = _of_one_tree(g, near, al, sample_counts(g, sets, 1, key), x)
    if not far.isEmpty():
        both = both.unionByName(_of_two_trees(g, far, al, sets))
    grid = pairs.join(single.toDF("site_a", "ia", "n_a"), "site_a").join(single.toDF("site_b", "ib", "n_b"), "site_b")
    full = grid.join(both, ["site_a", "site_b", "ia", "ib"], "left").withColumn("n_ab", F.coalesce("n_ab", F.lit(0)))
    from pyspark.sql import Window

    derived = F.when((F.col("ia") > 0) & (F.col("ib") > 0), F.col("n_ab")).otherwise(0)
    row = F.sum(derived).over(Window.partitionBy("site_a", "site_b", "ia"))
    col = F.sum(derived).over(Window.partitionBy("site_a", "site_b", "ib"))
    every = F.sum(derived).over(Window.partitionBy("site_a", "site_b"))
    d_a = F.lit(n) - F.max(F.when(F.col("ia") == 0, F.col("n_a"))).over(Window.partitionBy("site_a", "site_b"))
    # ancestral with derived: the derived allele's samples that have no derived allele at the other site
    n_ab = F.when((F.col("ia") > 0) & (F.col("ib") > 0), F.col("n_ab")).when(F.col("ia") > 0, F.col("n_a") - row).when(F.col("ib") > 0, F.col("n_b") - col).otherwise(F.col("n_b") - (d_a - every))
    return full.select("site_a", "site_b", "ia", "ib", n_ab.alias("n_ab"), "n_a", "n_b", F.lit(n).alias("n"))


def two_locus(g: Genealogy, pairs: DataFrame, names=("r2",), samples: DataFrame | None = None) -> DataFrame:
    """The statistics ``names`` for given pairs of sites (``site_a``, ``site_b``): one column each, over all samples or a set (``sample``).

    Multi-allelic sites are summed over pairs of alleles: r2 weighted by haplotype frequency, others evenly; D, r and D_prime over derived alleles only.
    """
    h = haplotype_counts(g, pairs, samples)
    num = [F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    aggs = []
    for name in names:
        f, polarised, by_haplotype = STATISTICS[name]
        use = (F.col("ia") > 0) & (F.col("ib") > 0) if polarised else F.lit(True)
        if by_haplotype:
            aggs.append(F.sum(F.when(use & F.lit(True), f(*num) * num[0] / num[3])).alias(name))
        else:
            aggs.append((F.sum(F.when(use, f(*num))) / F.sum(F.when(use, 1.0))).alias(name))
    return h.groupBy("site_a", "site_b").agg(*aggs)


def two_way(g: Genealogy, pairs: DataFrame, first: DataFrame, second: DataFrame, names=("r2_ij",)) -> DataFrame:
    """Statistics between two sample sets (``sample``) for given pairs of sites: one column each. The unbiased one needs disjoint sets."""
    keys = ["site_a", "site_b", "ia", "ib"]
    x = haplotype_counts(g, pairs, first)
    y = haplotype_counts(g, pairs, second).withColumnsRenamed({c: f"{c}_j" for c in ("n_ab", "n_a", "n_b", "n")})
    h = x.join(y, keys)
    i = [F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    j = [F.col(f"{c}_j").cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    aggs = []
    for name in names:
        f, by_haplotype = TWO_WAY[name]
        v = f(*i) * f(*j)
        aggs.append(F.sum(v * (i[0] + j[0]) / (i[3] + j[3])).alias(name) if by_haplotype else F.avg(v).alias(name))
    return h.groupBy("site_a", "site_b").agg(*aggs)


def branch_two_locus(g: Genealogy, pairs: DataFrame, names=("D2",), samples: DataFrame | None = None) -> DataFrame:
    """The statistics ``names`` expected at given pairs of positions (``position_a``, ``position_b``) from the branches of their trees: one column each.

    The statistic of two branches, each taken as one mutation carried by the samples below, is summed over all pairs of branches, weighted by the product of their lengths.
    Pairs of branches without a sample in common depend on the numbers of samples alone, so branches are added up by that number; only branches that share samples are met
    one by one. Branches without samples below are left out. ``samples`` (``sample``) restricts the counts.
    """
    who = g.samples().select(F.col("id").alias("sample")) if samples is None else samples.select("sample").distinct()
    n = who.count()
    pairs = stage(pairs.select(F.col("position_a").cast("double"), F.col("position_b").cast("double")).distinct(), "pairs")
    at = pairs.select(F.col("position_a").alias("pos")).unionByName(pairs.select(F.col("position_b").alias("pos"))).distinct()
    width = bin_width(g)
    bins = at.withColumn("_bin", F.floor(F.col("pos") / width))
    t = g.nodes.select("id", "time")
    e = binned(g.edges.select("left", "right", "parent", "child"), width).join(bins, "_bin").where((F.col("left") <= F.col("pos")) & (F.col("pos") < F.col("right")))
    e = e.join(t.toDF("parent", "pt"), "parent").join(t.toDF("child", "ct"), "child").select("pos", F.col("child").alias("node"), (F.col("pt") - F.col("ct")).alias("len"))
    a = ancestry(g).join(who.select(F.col("sample").alias("start")), "start", "left_semi").select(F.col("start").alias("sample"), "node", "left", "right")
    m = stage(e.join(a, "node").where((F.col("left") <= F.col("pos")) & (F.col("pos") < F.col("right"))).select("pos", "node", "len", "sample"), "below")
    size = stage(m.groupBy("pos", "node", "len").agg(F.count(F.lit(1)).alias("k")), "sizes")
    by_size = size.groupBy("pos", "k").agg(F.sum("len").alias("len"))
    stat = lambda name, ab, x, y: STATISTICS[name][0](ab, x, y, F.lit(float(n)))
    real = lambda c: F.col(c).cast("double")
    grid = pairs.join(by_size.toDF("position_a", "a", "len_a"), "position_a").join(by_size.toDF("position_b", "b", "len_b"), "position_b")
    apart = grid.groupBy("position_a", "position_b").agg(*[F.sum(F.col("len_a") * F.col("len_b") * stat(x, F.lit(0.0), real("a"), real("b"))).alias(x) for x in names])
    x = m.select(F.col("pos").alias("position_a"), F.col("node").alias("node_a"), "sample")
    y = m.select(F.col("pos").alias("position_b"), F.col("node").alias("node_b"), "sample")
    met = pairs.join(x, "position_a").join(y, ["position_b", "sample"]).groupBy("position_a", "position_b", "node_a", "node_b").agg(F.count(F.lit(1)).alias("ab"))
    met = met.join(size.toDF("position_a", "node_a", "len_a", "a"), ["position_a", "node_a"]).join(size.toDF("position_b", "node_b", "len_b", "b"), ["position_b", "node_b"])
    more = met.groupBy("position_a", "position_b").agg(*[
        F.sum(F.col("len_a") * F.col("len_b") * (stat(x, real("ab"), real("a"), real("b")) - stat(x, F.lit(0.0), real("a"), real("b")))).alias(f"_{x}") for x in names
    ])
    return apart.join(more, ["position_a", "position_b"], "left").select("position_a", "position_b", *[(F.col(x) + F.coalesce(f"_{x}", F.lit(0.0))).alias(x) for x in names])


def neighbours(g: Genealogy) -> DataFrame:
    """Each site with the next one along the sequence: ``site_a``, ``site_b``. Sites are ordered within genome bins, and bins are linked by their ends."""
    from pyspark.sql import Window

    from kinweave.plans.ancestry import bin_width

    s = g.sites.select("id", "position", F.floor(F.col("position") / bin_width(g)).alias("b"))
    w = Window.partitionBy("b").orderBy("position")
    inner = s.select(F.col("id").alias("site_a"), F.lead("id").over(w).alias("site_b")).where("site_b is not null")
    ends = s.groupBy("b").agg(F.min_by("id", "position").alias("first"), F.max_by("id", "position").alias("last"))
    v = Window.orderBy("b")  # one row a bin
    across = ends.select(F.col("last").alias("site_a"), F.lead("first").over(v).alias("site_b")).where("site_b is not null")
    return inner.unionByName(across)


def r2_array(g: Genealogy, focal: int, max_sites: int | None = None, max_distance: float | None = None, forward: bool = True) -> DataFrame:
    """r2 of one site with the following (or preceding) ones, nearest first: ``site_b``, ``distance``, ``r2``; limits are features of the call."""
    at = g.sites.where(F.col("id") == focal).select(F.col("position").alias("p0"))
    p0 = at.first()[0]
    d = (F.col("position") - p0) if forward else (p0 - F.col("position"))
    near = g.sites.select(F.col("id").alias("site_b"), d.alias("distance")).where("distance > 0")
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    if max_sites is not None:
        near = near.orderBy("distance").limit(max_sites)
    return two_locus(g, near.select(F.lit(focal).cast("long").alias("site_a"), "site_b")).join(near, "site_b").select("site_b", "distance", "r2")
