"""Where pairs of samples meet: coalescence counts, quantiles and rates, identity by descent, and links to chosen ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.operators.statistics import Sets, branches, check_windows
from kinweave.plans.ancestry import ancestry, over_windows, sample_counts


def coalescence_counts(g: Genealogy, sets: Sets, indexes: Sequence[tuple[int, int]], windows=None, span_normalise: bool = True, pair_normalise: bool = False) -> DataFrame:
    """Pairs of samples whose most recent common ancestor is a node, weighted by span: ``window``, ``node``, ``index``, ``value`` (zeros give no row).

    The pairs below a node less those below each of its children coalesce in it. Both terms are sums over stretches of the counts, so no pair is listed.
    """
    w = check_windows(g, windows)
    c = sample_counts(g, sets.table, sets.k, sets.key)
    span = F.col("right") - F.col("left")
    own = sets.table.groupBy(F.col("sample").alias("node")).agg(*[F.max((F.col("set") == j).cast("long")).alias(f"o_{j}") for j in range(sets.k)])
    pair = [(F.col(f"x_{j}") * F.col(f"x_{k}")).cast("double") for j, k in indexes]
    total = over_windows(c.where("x_all > 0"), w).select("window", "node", *[(span * p).alias(f"v_{i}") for i, p in enumerate(pair)])
    below = over_windows(branches(g, c).where("x_all > 0"), w).select("window", F.col("parent").alias("node"), *[(-span * p).alias(f"v_{i}") for i, p in enumerate(pair)])
    bps = F.array(*[F.lit(b) for b in w])
    wide = F.element_at(bps, F.col("window") + 2) - F.element_at(bps, F.col("window") + 1)
    self_ = own.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(len(w) - 2)))).select("window", "node", *[(-wide * F.col(f"o_{j}") * F.col(f"o_{k}")).alias(f"v_{i}") for i, (j, k) in enumerate(indexes)])
    both = total.unionByName(below).unionByName(self_).groupBy("window", "node").agg(*[F.sum(f"v_{i}").alias(f"v_{i}") for i in range(len(indexes))])
    cells = []
    for i, (j, k) in enumerate(indexes):
        v = F.col(f"v_{i}") / (2 if j == k else 1)
        if span_normalise:
            v = v / wide
        if pair_normalise:
            pairs = sets.n[j] * (sets.n[j] - 1) / 2 if j == k else sets.n[j] * sets.n[k]
            v = v / float(pairs) if pairs else F.lit(float("nan"))
        cells.append(F.struct(F.lit(f"{j},{k}").alias("index"), v.alias("value")))
    return both.select(F.col("window").cast("long").alias("window"), "node", F.explode(F.array(*cells)).alias("_")).select("window", "node", "_.*").where("abs(value) > 1e-12")


def coalescence_by_time(g: Genealogy, sets: Sets, indexes, time_windows: Sequence[float], windows=None, span_normalise: bool = True, pair_normalise: bool = False) -> DataFrame:
    """Coalescing pairs by time window (half-open) of their ancestor: ``window``, ``index``, ``time_window``, ``value``."""
    cuts = F.array(*[F.lit(float(x)) for x in time_windows])
    c = coalescence_counts(g, sets, indexes, windows, span_normalise, pair_normalise).join(g.nodes.select(F.col("id").alias("node"), "time"), "node")
    k = F.size(F.filter(cuts, lambda t: t <= F.col("time"))) - 1
    return c.withColumn("time_window", k.cast("long")).where((k >= 0) & (k < len(time_windows) - 1)).groupBy("window", "index", "time_window").agg(F.sum("value").alias("value"))


def _by_time(g: Genealogy, counts: DataFrame) -> DataFrame:
    return counts.join(g.nodes.select(F.col("id").alias("node"), "time"), "node").groupBy("window", "index", "time").agg(F.sum("value").alias("value"))


def coalescence_quantiles(g: Genealogy, sets: Sets, indexes, quantiles: Sequence[float], windows=None) -> DataFrame:
    """The earliest time by which a share ``q`` of coalescing pairs has coalesced: ``window``, ``index``, ``q``, ``time``."""
    t = _by_time(g, coalescence_counts(g, sets, indexes, windows))
    w = Window.partitionBy("window", "index")
    cum = F.sum("value").over(w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(w)
    t = t.withColumn("cum", cum).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    return t.where(F.col("cum") >= F.col("q") - 1e-12).groupBy("window", "index", "q").agg(F.min("time").alias("time"))


def coalescence_rates(g: Genealogy, sets: Sets, indexes, time_windows: Sequence[float], windows=None) -> DataFrame:
    """Rates of coalescence of the pairs still apart, by time window: ``window``, ``index``, ``time_window``, ``rate``.

    In the last window that has any coalescence the rate is one over the mean remaining time; windows after it have none (NaN).
    """
    inf = float("inf")
    tw = [float(x) for x in time_windows]
    if tw[0] != 0 or tw[-1] != inf:
        raise ValueError("time windows must go from 0 to infinity")
    c = coalescence_counts(g, sets, indexes, windows, True, True).join(g.nodes.select(F.col("id").alias("node"), "time"), "node")
    starts = F.array(*[F.lit(x) for x in tw[:-1]])
    k = F.size(F.filter(starts, lambda s: s <= F.col("time"))) - 1
    b = c.withColumn("time_window", k).groupBy("window", "index", "time_window").agg(F.sum("value").alias("p"), F.sum(F.col("value") * F.col("time")).alias("pt"))
    grid = b.select("window", "index").distinct().withColumn("time_window", F.explode(F.sequence(F.lit(0), F.lit(len(tw) - 2))))
    b = grid.join(b, ["window", "index", "time_window"], "left").fillna({"p": 0.0, "pt": 0.0})
    w = Window.partitionBy("window", "index")
    upto = w.orderBy("time_window").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("p").over(w)
    before = F.coalesce(F.sum("p").over(upto), F.lit(0.0)) / total
    last = F.max(F.when(F.col("p") > 0, F.col("time_window"))).over(w)
    a = F.element_at(starts, F.col("time_window") + 1)
    z = F.element_at(F.array(*[F.lit(x) for x in tw[1:]]), F.col("time_window") + 1)
    share = F.col("p") / total
    rate = F.when(F.col("time_window") < last, F.log(1 - share / (1 - before)) / (a - z)).when(F.col("time_window") == last, 1 / (F.col("pt") / F.col("p") - a)).otherwise(F.lit(float("nan")))
    return b.select("window", "index", F.col("time_window").cast("long").alias("time_window"), rate.alias("rate"))


def ibd_segments(g: Genealogy, within: DataFrame, between: DataFrame | None = None, min_span: float = 0.0, max_time: float | None = None) -> DataFrame:
    """Segments that pairs of given samples inherit from a common ancestor along one pair of paths: ``a``, ``b``, ``left``, ``right``, ``node``.

    ``within`` has ``id``; with ``between`` (``id``, ``group``) only pairs of different groups are given. Paths are rows of edges: abutting rows
    split a segment. Kept are spans above ``min_span`` and ancestors not older than ``max_time``. The result has a row for each pair by its nature;
    give sample lists of the size wanted.
    """
    ids = (between if between is not None else within).select(F.col("id").alias("start")).distinct()
    p = ancestry(g).join(ids, "start", "left_semi")
    if max_time is not None:
        p = p.join(g.nodes.where(F.col("time") <= max_time).select(F.col("id").alias("node")), "node", "left_semi")
    x = p.select("node", F.col("start").alias("a"), F.col("left").alias("al"), F.col("right").alias("ar"), F.col("via").alias("av"))
    y = p.select("node", F.col("start").alias("b"), F.col("left").alias("bl"), F.col("right").alias("br"), F.col("via").alias("bv"))
    m = x.join(y, "node").where((F.col("a") < F.col("b")) & (F.col("al") < F.col("br")) & (F.col("bl") < F.col("ar")) & (F.col("av") != F.col("bv")))
    if between is not None:
        grp = between.select(F.col("id"), "group")
        m = m.join(grp.toDF("a", "ga"), "a").join(grp.toDF("b", "gb"), "b").where("ga <> gb")
    out = m.select("a", "b", F.greatest("al", "bl").alias("left"), F.least("ar", "br").alias("right"), "node")
    return out.where(F.col("right") - F.col("left") > min_span)


def ibd_totals(segments: DataFrame) -> DataFrame:
    """Per pair: ``n_segments``, ``total_span``."""
    return segments.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("right") - F.col("left")).alias("total_span"))


def link_ancestors(g: Genealogy, samples: DataFrame, ancestors: DataFrame) -> DataFrame:
    """For each sample or ancestor of interest the nearest ancestor of interest above it: ``left``, ``right``, ``parent``, ``child``, abutting stretches merged.

    A path of a child counts as long as no other node of interest lies below its end.
    """
    from kinweave.operators.coverage import merged_intervals

    goal = ancestors.select(F.col("id").alias("node")).distinct()
    seeds = samples.select("id").unionByName(ancestors.select("id")).distinct()
    front = seeds.select(F.col("id").alias("child"), F.col("id").alias("node"), F.lit(0.0).alias("left"), F.lit(float(g.sequence_length)).alias("right"))
    e = g.edges.select(F.col("left").alias("el"), F.col("right").alias("er"), "parent", F.col("child").alias("node"))
    from kinweave.plans.staging import measured as stage

    found = None
    while True:
        up = front.join(e, "node").where((F.col("el") < F.col("right")) & (F.col("left") < F.col("er"))).select("child", F.col("parent").alias("node"), F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right"))
        up = stage(up, "link")
        if up.isEmpty():
            break
        hit = up.join(goal, "node", "left_semi")
        found = hit if found is None else found.unionByName(hit)
        front = up.join(goal, "node", "left_anti")
    if found is None:
        return g.spark.createDataFrame([], "left double, right double, parent long, child long")
    # only what lies above a sample is inherited
    reach = ancestry(g).join(samples.select(F.col("id").alias("start")), "start", "left_semi").select(F.col("node").alias("child"), F.col("left").alias("sl"), F.col("right").alias("sr"))
    found = found.join(reach, "child").where((F.col("sl") < F.col("right")) & (F.col("left") < F.col("sr")))
    found = found.select(F.col("node").alias("parent"), "child", F.greatest("left", "sl").alias("left"), F.least("right", "sr").alias("right"))
    return merged_intervals(found, ["parent", "child"]).select("left", "right", "parent", "child")
