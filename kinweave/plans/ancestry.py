"""Local trees, ancestry and sample counts, each as one relation over intervals of the sequence.

``ancestry`` holds one row per path of edge rows: from ``start`` up to ``node`` over ``[left, right)``, with the number of edges
(``depth``), the node just below (``via``) and the edge into ``node``. It is built level by level; each level is an equi-join of the frontier on the child
with an interval overlap, and is written out so that lineage does not grow with the height of the trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.plans.counting import SWEEP_NODES, changes
from kinweave.plans.staging import dense_ids
from kinweave.plans.staging import measured as stage


def memo(g: Genealogy, key: str, make) -> DataFrame:
    if key not in g.memo:
        g.memo[key] = make()
    return g.memo[key]


def breakpoints(g: Genealogy) -> DataFrame:
    """Sorted distinct ends of edges with 0 and the sequence length: ``position``."""
    ends = g.edges.select(F.explode(F.array("left", "right")).alias("position"))
    rim = g.spark.createDataFrame([(0.0,), (float(g.sequence_length),)], "position double")
    return ends.unionByName(rim).distinct()


def trees(g: Genealogy) -> DataFrame:
    """``tree``, ``left``, ``right``: the stretches between neighbouring breakpoints, also those without any edge.

    Breakpoints are numbered by range partitions, and each is joined with the next number.
    """

    def build() -> DataFrame:
        at = stage(dense_ids(breakpoints(g), ["position"], "tree"), "breakpoints")
        nxt = at.select((F.col("tree") - 1).alias("tree"), F.col("position").alias("right"))
        return stage(at.join(nxt, "tree").select("tree", F.col("position").alias("left"), "right"), "trees")

    return memo(g, "trees", build)


def binned(df: DataFrame, width: float, left: str = "left", right: str = "right", bin: str = "_bin") -> DataFrame:
    """One row for each bin of the sequence that an interval touches."""
    return df.withColumn(bin, F.explode(F.sequence(F.floor(F.col(left) / width), F.greatest(F.floor(F.col(left) / width), F.ceil(F.col(right) / width) - 1))))


def overlap_join(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Pairs of rows with overlapping ``[left, right)``, by equality of bins; ``b``'s ends come as ``b_left``, ``b_right``.

    A pair that shares several bins is kept only in the bin where the overlap starts.
    """
    b = b.withColumnsRenamed({"left": "b_left", "right": "b_right"})
    hit = binned(a, width).join(binned(b, width, "b_left", "b_right"), "_bin").where((F.col("left") < F.col("b_right")) & (F.col("b_left") < F.col("right")))
    return hit.where(F.col("_bin") == F.floor(F.greatest("left", "b_left") / width)).drop("_bin")


#: Breakpoints a bin holds on average: a bin join compares the rows of one bin.
BREAKS_PER_BIN = 16


def bin_width(g: Genealogy) -> float:
    """Width of the bins of interval joins, so that their number follows that of the trees."""
    if "bin_width" not in g.memo:
        g.memo["bin_width"] = g.sequence_length / max(64, trees(g).count() // BREAKS_PER_BIN)
    return g.memo["bin_width"]


def local_edges(g: Genealogy) -> DataFrame:
    """Edges of every local tree: ``tree``, ``left``, ``right`` (of the tree), ``parent``, ``child``, ``edge``."""
    e = g.edges.select(F.col("id").alias("edge"), "left", "right", "parent", "child")
    return overlap_join(trees(g), e, bin_width(g)).drop("b_left", "b_right")


def ancestry(g: Genealogy, starts: DataFrame | None = None, key: str = "all") -> DataFrame:
    """All root paths of ``starts`` (column ``id``; all nodes by default): ``start``, ``node``, ``left``, ``right``, ``depth``, ``via``, ``edge``."""

    def build() -> DataFrame:
        first = (starts if starts is not None else g.nodes).select("id").distinct()
        L = float(g.sequence_length)
        front = stage(first.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("left"), F.lit(L).alias("right"), F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("via"), F.lit(-1).cast("long").alias("edge")), "anc")
        levels = [front]
        e = g.edges.select(F.col("id").alias("e"), F.col("left").alias("el"), F.col("right").alias("er"), "parent", F.col("child").alias("node"))
        while True:
            up = front.join(e, "node").where((F.col("el") < F.col("right")) & (F.col("left") < F.col("er"))).select(
                "start", F.col("parent").alias("node"), F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right"),
                (F.col("depth") + 1).alias("depth"), F.col("node").alias("via"), F.col("e").alias("edge"),
            )
            front = stage(up, "anc")
            if front.isEmpty():
                break
            levels.append(front)
        return reduce(DataFrame.unionByName, levels)

    return memo(g, f"ancestry:{key}", build)


def sample_ancestry(g: Genealogy) -> DataFrame:
    s = g.samples().select(F.col("id").alias("start"))
    return ancestry(g).join(s, "start", "left_semi")


def sample_counts(g: Genealogy, sets: DataFrame, k: int, key: str) -> DataFrame:
    """How many samples of each set lie at or below a node, over stretches with the same counts: ``node``, ``left``, ``right``, ``x_0`` .. ``x_{k-1}``, ``x_all``.

    Changes of the counts come from sweeps of genome shards; beyond SWEEP_NODES nodes, which no task should hold, from the starts and ends of all paths. They are
    pre-aggregated per node and position, and a running sum over the positions of a node gives the counts. Each node is covered from 0 to the sequence length.
    ``sets`` has ``sample`` and ``set`` (0 .. k-1); a sample may be in several sets. ``x_all`` counts all samples.
    """

    def build() -> DataFrame:
        member = sets.groupBy(F.col("sample").alias("start")).agg(*[F.max((F.col("set") == j).cast("long")).alias(f"m_{j}") for j in range(k)])
        d = [f"d_{j}" for j in range(k)] + ["d_all"]
        of = [F.coalesce(f"m_{j}", F.lit(0).cast("long")) for j in range(k)] + [F.lit(1).cast("long")]
        if g.nodes.count() <= SWEEP_NODES:
            w = g.samples().select(F.col("id").alias("start")).join(member, "start", "left").select(F.col("start").alias("sample"), *[v.alias(c) for v, c in zip(of, d)])
            moved = changes(g, w, d).select("node", "pos", *[F.col(c).cast("long").alias(c) for c in d])
        else:
            a = sample_ancestry(g).select("start", "node", "left", "right").join(member, "start", "left")
            up = a.select("node", F.col("left").alias("pos"), *[v.alias(c) for v, c in zip(of, d)])
            moved = up.unionByName(a.select("node", F.col("right").alias("pos"), *[(-v).alias(c) for v, c in zip(of, d)]))
        zero = F.lit(0).cast("long")
        rim = g.nodes.select(F.col("id").alias("node"), F.explode(F.array(F.lit(0.0), F.lit(float(g.sequence_length)))).alias("pos"), *[zero.alias(c) for c in d])
        events = moved.unionByName(rim).groupBy("node", "pos").agg(*[F.sum(c).alias(c) for c in d])
        still = reduce(lambda p, q: p & q, [F.col(c) == 0 for c in d])
        events = events.where(~still | F.col("pos").isin(0.0, float(g.sequence_length)))
        w = Window.partitionBy("node").orderBy("pos")
        out = events.select("node", F.col("pos").alias("left"), F.lead("pos").over(w).alias("right"), *[F.sum(c).over(w).alias("x" + c[1:]) for c in d])
        return stage(out.where(F.col("right").isNotNull()), "counts")

    return memo(g, f"counts:{key}:{k}", build)


def over_windows(df: DataFrame, windows: Sequence[float], left: str = "left", right: str = "right") -> DataFrame:
    """Clip intervals to genomic windows without a join: adds ``window``, and clips ``left`` and ``right``."""
    bps = F.array(*[F.lit(float(b)) for b in windows])
    at = lambda c, strict: F.size(F.filter(bps, lambda b: (b < c) if strict else (b <= c)))
    lo, hi = F.greatest(at(F.col(left), False) - 1, F.lit(0)), F.least(at(F.col(right), True) - 1, F.lit(len(windows) - 2))
    out = df.withColumn("window", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    start, end = F.element_at(bps, F.col("window") + 1), F.element_at(bps, F.col("window") + 2)
    return out.withColumn(left, F.greatest(F.col(left), start)).withColumn(right, F.least(F.col(right), end)).where(F.col(left) < F.col(right))


def window_of(position: Column, windows: Sequence[float]) -> Column:
    """Number of the window that holds a position, NULL outside all."""
    bps = F.array(*[F.lit(float(b)) for b in windows])
    n = F.size(F.filter(bps, lambda b: b <= position)) - 1
    return F.when((n >= 0) & (n < len(windows) - 1), n)


def mutation_parents(g: Genealogy) -> DataFrame:
    """``id``, ``parent`` of every mutation: the nearest earlier mutation on the way up at its site, or -1."""

    def build() -> DataFrame:
        sited = g.mutations.join(g.sites.select(F.col("id").alias("site"), "position"), "site")
        a = ancestry(g, g.mutations.select(F.col("node").alias("id")), "mutated")
        up = sited.select("id", "site", "position", F.col("node").alias("start")).join(a.select("start", "node", "left", "right", "depth"), "start")
        up = up.where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right")))
        others = g.mutations.select(F.col("id").alias("other"), "site", "node")
        cand = up.join(others, ["site", "node"]).where((F.col("depth") > 0) | (F.col("other") < F.col("id")))
        best = cand.groupBy("id").agg(F.max_by("other", F.struct((-F.col("depth")).alias("d"), "other")).alias("parent"))
        return stage(g.mutations.select("id").join(best, "id", "left").select("id", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent")), "mutparents")

    return memo(g, "mutation_parents", build)


def inherited_states(g: Genealogy) -> DataFrame:
    """Mutations with ``position`` and the state each replaces: ``id``, ``site``, ``node``, ``position``, ``derived_state``, ``inherited_state``, ``ancestral_state``."""
    m = g.mutations.drop("parent").join(mutation_parents(g), "id").join(g.sites.select(F.col("id").alias("site"), "position", "ancestral_state"), "site")
    p = g.mutations.select(F.col("id").alias("parent"), F.col("derived_state").alias("_above"))
    return m.join(p, "parent", "left").select("id", "site", "node", "position", "parent", "derived_state", F.coalesce("_above", "ancestral_state").alias("inherited_state"), "ancestral_state")


def allele_counts(g: Genealogy, sets: DataFrame, k: int, key: str) -> DataFrame:
    """Samples of each set with each allele: ``site``, ``position``, ``allele``, ``ancestral``, ``x_0`` .., ``x_all``; alleles that no sample has stay, with zeros.

    A mutation adds the samples below its node to its state and takes them from the state it replaces, so no sample is ever listed.
    """

    def build() -> DataFrame:
        xs = [f"x_{j}" for j in range(k)] + ["x_all"]
        c = sample_counts(g, sets, k, key)
        m = inherited_states(g).join(c, "node").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right")))
        gain = m.select("site", F.col("derived_state").alias("allele"), *xs)
        loss = m.select("site", F.col("inherited_state").alias("allele"), *[(-F.col(x)).alias(x) for x in xs])
        total = {f"x_{j}": n for j, n in enumerate(set_sizes(sets, k))} | {"x_all": g.samples().count()}
        base = g.sites.select(F.col("id").alias("site"), F.col("ancestral_state").alias("allele"), *[F.lit(total[x]).cast("long").alias(x) for x in xs])
        ac = gain.unionByName(loss).unionByName(base).groupBy("site", "allele").agg(*[F.sum(x).alias(x) for x in xs])
        site = g.sites.select(F.col("id").alias("site"), "position", "ancestral_state")
        return stage(ac.join(site, "site").withColumn("ancestral", F.col("allele") == F.col("ancestral_state")).drop("ancestral_state"), "alleles")

    return memo(g, f"alleles:{key}:{k}", build)


def set_sizes(sets: DataFrame, k: int) -> list[int]:
    got = {r["set"]: r["n"] for r in sets.where(F.col("set").between(0, k - 1)).groupBy("set").agg(F.countDistinct("sample").alias("n")).collect()}  # k rows
    return [got.get(j, 0) for j in range(k)]
