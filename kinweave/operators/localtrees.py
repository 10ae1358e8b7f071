"""Per-tree relations: roots, common ancestors, depths, traversals, shape indexes, distances and Newick text."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.plans.ancestry import ancestry, bin_width, binned, local_edges, memo, overlap_join, sample_ancestry, sample_counts, trees
from kinweave.plans.staging import measured as stage


def paths_by_tree(g: Genealogy) -> DataFrame:
    """Every node with each of its ancestors in each tree (itself at depth 0): ``tree``, ``start``, ``node``, ``depth``, ``via``."""
    return memo(g, "paths_by_tree", lambda: stage(overlap_join(ancestry(g).select("start", "node", "left", "right", "depth", "via"), trees(g), bin_width(g)).select("tree", "start", "node", "depth", "via"), "paths"))


def live(g: Genealogy) -> DataFrame:
    """Nodes with a sample at or below them, by tree: ``tree``, ``node``, ``num_samples``."""
    s = g.samples().select(F.col("id").alias("start"))
    return memo(g, "live", lambda: stage(paths_by_tree(g).join(s, "start", "left_semi").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("num_samples")), "live"))


def roots(g: Genealogy, root_threshold: int = 1) -> DataFrame:
    """Topmost nodes with at least ``root_threshold`` samples at or below: ``tree``, ``root``."""
    up = local_edges(g).select("tree", F.col("child").alias("node"))
    return live(g).where(F.col("num_samples") >= root_threshold).join(up, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("root"))


def tracked(g: Genealogy, samples: DataFrame) -> DataFrame:
    """How many of the samples ``samples`` (``id``) lie at or below each node, by tree: ``tree``, ``node``, ``num_tracked``; nodes without any give no row."""
    s = samples.select(F.col("id").alias("start")).distinct()
    return paths_by_tree(g).join(s, "start", "left_semi").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("num_tracked"))


def sites_of_trees(g: Genealogy) -> DataFrame:
    """The tree of each site and how many mutations the site has: ``tree``, ``site``, ``position``, ``num_mutations``."""
    width = bin_width(g)
    s = g.sites.select(F.col("id").alias("site"), "position", F.floor(F.col("position") / width).alias("_bin"))
    at = s.join(binned(trees(g), width), "_bin").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right")))
    n = g.mutations.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return at.join(n, "site", "left").select("tree", "site", "position", F.coalesce("n", F.lit(0)).alias("num_mutations"))


def same_trees(g: Genealogy, other: Genealogy, pairs: DataFrame) -> DataFrame:
    """Whether trees of two genealogies with the same node ids have the same links: ``tree``, ``other_tree``, ``same``, for given pairs of numbers."""
    mark = lambda x, name: local_edges(x).groupBy(F.col("tree").alias(name)).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("parent", "child")).alias("x"), F.sum(F.shiftright(F.xxhash64("parent", "child"), 20)).alias("t")).select(name, F.struct("n", "x", "t").alias(f"_{name}"))
    j = pairs.select("tree", "other_tree").join(mark(g, "tree"), "tree", "left").join(mark(other, "other_tree"), "other_tree", "left")
    return j.select("tree", "other_tree", F.col("_tree").eqNullSafe(F.col("_other_tree")).alias("same"))


def rf_distance(g: Genealogy, other: Genealogy, pairs: DataFrame) -> DataFrame:
    """Robinson-Foulds distance of given pairs of trees (``tree`` of ``g``, ``other_tree``): the clades of samples that only one of the two has: ``rf``."""
    pairs = pairs.select("tree", "other_tree").distinct()
    a = pairs.join(clades(g), "tree").select("tree", "other_tree", "clade")
    b = pairs.join(clades(other).withColumnRenamed("tree", "other_tree"), "other_tree").select("tree", "other_tree", "clade")
    rf = a.unionByName(b).groupBy("tree", "other_tree", "clade").agg(F.count(F.lit(1)).alias("k")).groupBy("tree", "other_tree").agg(F.sum((F.col("k") == 1).cast("long")).alias("rf"))
    return pairs.join(rf, ["tree", "other_tree"], "left").select("tree", "other_tree", F.coalesce("rf", F.lit(0).cast("long")).alias("rf"))


def kc_distance(g: Genealogy, other: Genealogy, pairs: DataFrame, mix: float = 0.0) -> DataFrame:
    """Kendall-Colijn distance of given pairs of trees, as in :func:`kc_neighbours`: ``tree``, ``other_tree``, ``kc``. Both genealogies need the same samples."""
    pairs = pairs.select("tree", "other_tree").distinct()
    a = pairs.join(_kc_vectors(g, mix), "tree")
    b = pairs.join(_kc_vectors(other, mix).toDF("other_tree", "a", "b", "w"), "other_tree")
    return a.join(b, ["tree", "other_tree", "a", "b"]).groupBy("tree", "other_tree").agg(F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2)).alias("kc"))


def kc_distance_along(g: Genealogy, other: Genealogy, mix: float = 0.0) -> float:
    """The distance of two genealogies: that of their trees, averaged over the sequence."""
    from kinweave.operators.tables import coiterate

    both = stage(coiterate(g, other), "both")
    d = kc_distance(g, other, both, mix)
    return both.join(d, ["tree", "other_tree"]).agg(F.sum((F.col("right") - F.col("left")) * F.col("kc"))).first()[0] / g.sequence_length


def members(g: Genealogy) -> DataFrame:
    """Nodes of each tree, i.e. those at or below a root: ``tree``, ``node``, ``depth``, ``root``."""
    r = roots(g).withColumnRenamed("root", "node")
    return memo(g, "members", lambda: stage(paths_by_tree(g).join(r, ["tree", "node"]).select("tree", F.col("start").alias("node"), "depth", F.col("node").alias("root")), "members"))


def parents(g: Genealogy) -> DataFrame:
    """``tree``, ``node``, ``parent``, ``edge``, ``branch_length``, ``num_siblings`` for every node with a parent."""
    e = local_edges(g)
    t = g.nodes.select("id", "time")
    n = e.groupBy("tree", "parent").agg((F.count(F.lit(1)) - 1).alias("num_siblings"))
    e = e.join(n, ["tree", "parent"]).join(t.toDF("parent", "pt"), "parent").join(t.toDF("child", "ct"), "child")
    return e.select("tree", F.col("child").alias("node"), "parent", "edge", (F.col("pt") - F.col("ct")).alias("branch_length"), "num_siblings")


def children(g: Genealogy) -> DataFrame:
    """``tree``, ``node``, ``children`` in order of insertion (parent time, parent, child, left) and their number."""
    return local_edges(g).groupBy("tree", F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("child")).alias("children"), F.count(F.lit(1)).alias("num_children"))


def leaves(g: Genealogy) -> DataFrame:
    """Nodes of a tree without children: ``tree``, ``node``."""
    return members(g).join(local_edges(g).select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", "node", "depth")


def total_branch_length(g: Genealogy) -> DataFrame:
    """``tree``, ``total_branch_length`` over the branches below roots, i.e. of nodes with a sample below; trees without any give 0.

    No path is listed: an edge counts where its child has a sample at or below it, and adds its length at the first and takes it off behind the last tree of the stretch.
    """
    t = g.nodes.select("id", "time")
    e = g.edges.select("left", "right", "parent", F.col("child").alias("node")).join(t.toDF("parent", "pt"), "parent").join(t.toDF("node", "ct"), "node")
    some = g.samples().select(F.col("id").alias("sample"), F.lit(0).alias("set"))
    c = sample_counts(g, some, 1, "samples").where("x_all > 0").select("node", F.col("left").alias("cl"), F.col("right").alias("cr"))
    b = e.join(c, "node").where((F.col("left") < F.col("cr")) & (F.col("cl") < F.col("right"))).select(F.greatest("left", "cl").alias("left"), F.least("right", "cr").alias("right"), (F.col("pt") - F.col("ct")).alias("v"))
    m = overlap_join(b.groupBy("left", "right").agg(F.sum("v").alias("v")), trees(g), bin_width(g)).groupBy("tree").agg(F.sum("v").alias("v"))
    return trees(g).select("tree").join(m, "tree", "left").select("tree", F.coalesce("v", F.lit(0.0)).alias("total_branch_length"))


def num_lineages(g: Genealogy, time: float) -> DataFrame:
    """Branches below roots that exist at ``time`` (from the child's time up to, not with, the parent's): ``tree``, ``num_lineages``."""
    t = g.nodes.select("id", "time")
    b = members(g).where("depth > 0").select("tree", "node").join(parents(g), ["tree", "node"]).join(t.toDF("node", "ct"), "node").where((F.col("ct") <= time) & (F.col("ct") + F.col("branch_length") > time))
    return trees(g).select("tree").join(b.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree", "left").select("tree", F.coalesce("n", F.lit(0)).alias("num_lineages"))


def common_ancestors(g: Genealogy, pairs: DataFrame) -> DataFrame:
    """Most recent common ancestors of given pairs (``a``, ``b``) of nodes over the stretches they share: ``a``, ``b``, ``left``, ``right``, ``mrca``, ``tmrca``.

    Two paths first meet where the nodes just below differ, so each meeting is found by an equi-join on the ancestor. Stretches without a common
    ancestor give no row.
    """
    x = ancestry(g).select(F.col("start").alias("a"), "node", F.col("left").alias("al"), F.col("right").alias("ar"), F.col("via").alias("av"))
    y = ancestry(g).select(F.col("start").alias("b"), "node", F.col("left").alias("bl"), F.col("right").alias("br"), F.col("via").alias("bv"))
    meet = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "node"]).where((F.col("al") < F.col("br")) & (F.col("bl") < F.col("ar")) & ((F.col("av") != F.col("bv")) | (F.col("av") == -1)))
    meet = meet.select("a", "b", F.greatest("al", "bl").alias("left"), F.least("ar", "br").alias("right"), F.col("node").alias("mrca"))
    return meet.join(g.nodes.select(F.col("id").alias("mrca"), F.col("time").alias("tmrca")), "mrca").select("a", "b", "left", "right", "mrca", "tmrca")


def distances(g: Genealogy, pairs: DataFrame) -> DataFrame:
    """Edges (``path_length``) and time (``distance``) between nodes of given pairs by tree; pairs without a common ancestor give no row: ``tree``, ``a``, ``b``."""
    p = paths_by_tree(g).select("tree", "start", "node", "depth")
    t = g.nodes.select("id", "time")
    j = pairs.select("a", "b").distinct().join(p.toDF("tree", "a", "node", "da"), "a").join(p.toDF("tree", "b", "node", "db"), ["tree", "b", "node"])
    low = j.groupBy("tree", "a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("path_length"), "node")).alias("m")).select("tree", "a", "b", "m.*")
    low = low.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").join(t.toDF("node", "tm"), "node")
    return low.select("tree", "a", "b", "path_length", (2 * F.col("tm") - F.col("ta") - F.col("tb")).alias("distance"))


def shape_indexes(g: Genealogy, base: float = 10) -> DataFrame:
    """Sackin, Colless, B1 and B2 index of each tree: ``tree``, ``sackin``, ``colless``, ``b1``, ``b2``.

    Colless is NULL unless the tree has one root and only binary nodes; B2 is NULL unless it has one root.
    """
    leaf = leaves(g)
    p = paths_by_tree(g)
    reach = stage(leaf.select("tree", F.col("node").alias("start")).join(p, ["tree", "start"]).select("tree", "start", "node", "depth"), "below")  # depth 0: the leaf itself
    below = reach.where("depth > 0")
    sackin = below.groupBy("tree").agg(F.count(F.lit(1)).alias("sackin"))
    root = roots(g)
    inner = below.groupBy("tree", "node").agg(F.max("depth").alias("h"), F.count(F.lit(1)).alias("n"))
    b1 = inner.join(root.select("tree", F.col("root").alias("node")), ["tree", "node"], "left_anti").groupBy("tree").agg(F.sum(1 / F.col("h")).alias("b1"))
    kids = local_edges(g).groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    inside = members(g).select("tree", "node").join(kids, ["tree", "node"])
    chance = below.join(kids, ["tree", "node"]).groupBy("tree", "start").agg(F.sum(F.log("k")).alias("s"))
    b2 = chance.groupBy("tree").agg(F.sum(F.exp(-F.col("s")) * F.col("s") / math.log(base)).alias("b2"))
    sizes = reach.groupBy("tree", F.col("node").alias("child")).agg(F.count(F.lit(1)).alias("n"))
    halves = local_edges(g).select("tree", F.col("parent").alias("node"), F.col("child")).join(sizes, ["tree", "child"])
    uneven = inside.join(halves.groupBy("tree", "node").agg((F.max("n") - F.min("n")).alias("d")), ["tree", "node"]).groupBy("tree").agg(F.sum("d").alias("colless"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    r = root.groupBy("tree").agg(F.count(F.lit(1)).alias("r"))
    out = trees(g).select("tree").join(r, "tree", "left").join(sackin, "tree", "left").join(b1, "tree", "left").join(b2, "tree", "left").join(uneven, "tree", "left")
    one = F.col("r") == 1
    return out.select(
        "tree", F.coalesce("sackin", F.lit(0)).alias("sackin"), F.when(one & (F.col("k0") == 2) & (F.col("k1") == 2), F.col("colless")).alias("colless"),
        F.coalesce("b1", F.lit(0.0)).alias("b1"), F.when(one, F.coalesce("b2", F.lit(0.0))).alias("b2"),
    )


def clades(g: Genealogy) -> DataFrame:
    """An order-free signature of the samples below every node of a tree: ``tree``, ``clade`` (their number, sum and xor of hashes)."""
    s = g.samples().select(F.col("id").alias("start"))
    p = paths_by_tree(g).join(s, "start", "left_semi")
    h = F.xxhash64("start")
    sig = p.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("t"))
    return sig.select("tree", F.struct("n", "x", "t").alias("clade")).distinct()


def rf_neighbours(g: Genealogy) -> DataFrame:
    """Robinson-Foulds distance of each tree to the next: ``tree``, ``rf``, the clades that only one of the two has."""
    c = clades(g)
    n = trees(g).select("tree")
    both = c.unionByName(c.select((F.col("tree") - 1).alias("tree"), "clade")).groupBy("tree", "clade").agg(F.count(F.lit(1)).alias("k"))
    rf = both.groupBy("tree").agg(F.sum((F.col("k") == 1).cast("long")).alias("rf"))
    last = n.agg(F.max("tree")).first()[0]
    return n.join(rf, "tree", "left").where((F.col("tree") >= 0) & (F.col("tree") < last)).select("tree", F.coalesce("rf", F.lit(0).cast("long")).alias("rf"))


def _kernel_rows(g: Genealogy) -> DataFrame:
    """Everything a per-tree kernel needs of a tree, one row a member: ``tree``, ``node``, ``parent`` (-1 for a root), ``time``, ``sample``."""
    n = g.nodes.select(F.col("id").alias("node"), "time", (F.col("flags").bitwiseAND(1) == 1).alias("sample"))
    up = local_edges(g).select("tree", F.col("child").alias("node"), "parent")
    return members(g).select("tree", "node").join(up, ["tree", "node"], "left").join(n, "node").select("tree", "node", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "time", "sample")


def _tree(pdf: pd.DataFrame) -> tuple[dict[int, list[int]], list[int], dict[int, float]]:
    kids: dict[int, list[int]] = {}
    tops = []
    for u, p in sorted(zip(pdf["node"].tolist(), pdf["parent"].tolist())):
        (tops if p == -1 else kids.setdefault(p, [])).append(u)
    return kids, tops, dict(zip(pdf["node"].tolist(), pdf["time"].tolist()))


def traverse(kids: dict[int, list[int]], tops: list[int], time: dict[int, float], order: str) -> list[int]:
    """Node ids in ``preorder``, ``postorder``, ``inorder``, ``levelorder``, ``timeasc``, ``timedesc`` or ``minlex_postorder``."""
    pre: list[int] = []
    stack = list(reversed(tops))
    while stack:
        u = stack.pop()
        pre.append(u)
        stack.extend(reversed(kids.get(u, ())))
    if order == "preorder":
        return pre
    if order in ("timeasc", "timedesc"):
        return sorted(pre, key=lambda u: (time[u], u), reverse=order == "timedesc")
    if order == "levelorder":
        out, level = [], list(tops)
        while level:
            out += level
            level = [c for u in level for c in kids.get(u, ())]
        return out
    if order == "minlex_postorder":
        least: dict[int, int] = {}
        for u in reversed(pre):
            least[u] = min((least[c] for c in kids.get(u, ())), default=u)
        kids = {u: sorted(cs, key=least.get) for u, cs in kids.items()}
        tops = sorted(tops, key=least.get)
    out, work = [], [(u, 0) for u in reversed(tops)]
    while work:
        u, k = work.pop()
        cs = kids.get(u, ())
        if order == "inorder":
            half = len(cs) // 2
            if k < len(cs):
                if k == half:
                    out.append(u)
                work.append((u, k + 1))
                work.append((cs[k], 0))
            elif not cs:
                out.append(u)
        elif k < len(cs):
            work.append((u, k + 1))
            work.append((cs[k], 0))
        else:
            out.append(u)
    return out


def traversal(g: Genealogy, order: str = "preorder") -> DataFrame:
    """``tree``, ``nodes`` (ids in the order asked for; children by id, roots by id)."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [key[0]], "nodes": [traverse(*_tree(pdf), order)]})

    return _kernel_rows(g).groupBy("tree").applyInPandas(walk, "tree long, nodes array<long>")


def newick_of(kids, root: int, time, samples: set[int], precision: int = 14, labels: dict[int, str] | None = None, lengths: bool = True) -> str:
    name = (lambda u: labels.get(u, "")) if labels is not None else (lambda u: f"n{u}" if u in samples else "")
    text: dict[int, str] = {}
    for u in traverse(kids, [root], time, "postorder"):
        inside = ",".join(text.pop(c) + (f":{time[u] - time[c]:.{precision}f}" if lengths else "") for c in kids.get(u, ()))
        text[u] = (f"({inside})" if inside else "") + name(u)
    return text[root] + ";"


def newick(g: Genealogy, precision: int = 14, lengths: bool = True, labels: dict[int, str] | None = None, root: int | None = None) -> DataFrame:
    """Newick text per root of each tree, samples labelled n<id> unless ``labels`` are given: ``tree``, ``root``, ``newick``. With ``root`` the part below that node, where it stands in a tree."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kids, tops, time = _tree(pdf)
        samples = set(pdf.loc[pdf["sample"], "node"].tolist())
        if root is not None:
            tops = [root] if root in time else []
        return pd.DataFrame({"tree": [key[0]] * len(tops), "root": tops, "newick": [newick_of(kids, r, time, samples, precision, labels, lengths) for r in tops]})

    return _kernel_rows(g).groupBy("tree").applyInPandas(write, "tree long, root long, newick string")


def _kc_vectors(g: Genealogy, mix: float) -> DataFrame:
    s = g.samples().select(F.col("id").alias("start"))
    t = g.nodes.select("id", "time")
    m = members(g).join(t.toDF("root", "tr"), "root").join(t.toDF("node", "tn"), "node").select("tree", "node", F.col("depth").alias("d"), (F.col("tr") - F.col("tn")).alias("h"))
    p = paths_by_tree(g).join(s, "start", "left_semi").select("tree", "start", "node", "depth", "via")
    x = p.select("tree", F.col("start").alias("a"), "node", F.col("via").alias("va"))
    y = p.select("tree", F.col("start").alias("b"), "node", F.col("via").alias("vb"))
    meet = x.join(y, ["tree", "node"]).where((F.col("a") < F.col("b")) & (F.col("va") != F.col("vb"))).join(m, ["tree", "node"]).select("tree", "a", "b", (F.lit(1 - mix) * F.col("d") + F.lit(mix) * F.col("h")).alias("v"))
    tip = p.where("depth = 0").join(parents(g).select("tree", "node", "branch_length"), ["tree", "node"], "left").select("tree", F.col("start").alias("a"), F.lit(-1).cast("long").alias("b"), (F.lit(1 - mix) + F.lit(mix) * F.coalesce("branch_length", F.lit(0.0))).alias("v"))
    return meet.unionByName(tip)


def kc_neighbours(g: Genealogy, mix: float = 0.0) -> DataFrame:
    """Kendall-Colijn distance of each tree to the next: ``tree``, ``kc``; ``mix`` weighs times (1) against numbers of edges (0).

    Vectors hold one entry for each pair of samples, so this suits small sample sets; the pairs are aggregated, not returned.
    """
    v = _kc_vectors(g, mix)
    nxt = v.select((F.col("tree") - 1).alias("tree"), "a", "b", F.col("v").alias("w"))
    d = v.join(nxt, ["tree", "a", "b"]).groupBy("tree").agg(F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2)).alias("kc"))
    return d


def sample_paths(g: Genealogy) -> DataFrame:
    return sample_ancestry(g)
