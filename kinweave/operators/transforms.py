"""Table transformations: each takes a genealogy and gives another one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.model import Genealogy, Later, names, now
from kinweave.operators.coverage import merged_intervals
from kinweave.operators.hierarchy import cycles
from kinweave.plans.ancestry import bin_width, mutation_parents, sample_counts
from kinweave.plans.staging import dense_ids
from kinweave.plans.staging import measured as stage


def _remap(df: DataFrame, column: str, ids: DataFrame, drop: bool = False) -> DataFrame:
    """Replace ids by a table ``old``, ``new``; what is not in it becomes -1, or its rows go."""
    j = df.join(ids.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "inner" if drop else "left")
    return j.withColumn(column, F.coalesce("_new", F.lit(-1).cast("long"))).drop("_new")


def _cols(df: DataFrame, table: str) -> DataFrame:
    return df.select(*names(table))


def sort(g: Genealogy, edge_order: Sequence[Column | str] | None = None) -> Genealogy:
    """Edges by (parent time, parent, child, left), or by columns given (of edges and ``_t``, the time of the parent), sites by position, mutations by site, time (oldest first, unknown last) and id, migrations by time; ids follow.

    Mutations of a site that is not there go, and a parent that is not there becomes -1.
    """
    return _sorted(g, Later(lambda: g.nodes), edge_order)


def _sorted(g: Genealogy, nodes: DataFrame | Later, edge_order: Sequence[Column | str] | None = None) -> Genealogy:
    """:func:`sort`, with the times from ``nodes``; each table is numbered when it is read."""

    def edges() -> DataFrame:
        t = now(nodes).select(F.col("id").alias("parent"), F.col("time").alias("_t"))
        return _cols(dense_ids(g.edges.drop("id").join(t, "parent"), edge_order or ["_t", "parent", "child", "left"]), "edges")

    sites = Later(lambda: dense_ids(g.sites.withColumnRenamed("id", "old"), ["position", "old"]))

    def mutations() -> DataFrame:
        m = _remap(g.mutations, "site", sites().select("old", F.col("id").alias("new")), drop=True).withColumnRenamed("id", "old")
        m = dense_ids(m, [F.col("site"), F.col("time").desc_nulls_last(), F.col("old")])
        return _cols(_remap(m, "parent", m.select("old", F.col("id").alias("new"))), "mutations")

    mig = Later(lambda: _cols(dense_ids(g.migrations.drop("id"), ["time", "source", "dest", "left", "node"]), "migrations"))
    return g.with_tables(edges=Later(edges), sites=Later(lambda: _cols(sites(), "sites")), mutations=Later(mutations), migrations=mig)


def squash(edges: DataFrame) -> DataFrame:
    """Merge abutting edges of one parent and child: ``left``, ``right``, ``parent``, ``child``. Overlapping rows or metadata are errors of the caller, found by :func:`squash_errors`."""
    return merged_intervals(edges, ["parent", "child"]).select("left", "right", "parent", "child")


def squash_errors(edges: DataFrame) -> DataFrame:
    """Edges that may not be squashed: with metadata, or overlapping another of the same parent and child."""
    b = F.lag("right").over(Window.partitionBy("parent", "child").orderBy("left", "right"))
    return edges.withColumn("_b", b).where((F.col("_b") > F.col("left")) | (F.length("metadata") > 0)).drop("_b")


def delete_sites(g: Genealogy, ids: DataFrame) -> Genealogy:
    """Without the sites in ``ids`` (``id``) and their mutations; ids are renumbered."""
    return keep_sites(g, g.sites.join(ids.select("id"), "id", "left_anti"))


def keep_sites(g: Genealogy, kept: DataFrame | Later) -> Genealogy:
    sites = Later(lambda: dense_ids(now(kept).withColumnRenamed("id", "old"), ["position", "old"]))
    m = Later(lambda: _remap(g.mutations, "site", sites().select("old", F.col("id").alias("new")), drop=True))
    return keep_mutations(g.with_tables(sites=Later(lambda: _cols(sites(), "sites"))), m)


def keep_mutations(g: Genealogy, kept: DataFrame | Later) -> Genealogy:
    """Only these mutations, renumbered; a parent that is gone becomes -1."""

    def mutations() -> DataFrame:
        m = dense_ids(now(kept).withColumnRenamed("id", "old"), ["site", "old"])
        return _cols(_remap(m, "parent", m.select("old", F.col("id").alias("new"))), "mutations")

    return g.with_tables(mutations=Later(mutations))


def _check_intervals(intervals: Sequence[tuple[float, float]], L: float) -> list[tuple[float, float]]:
    out = [(float(a), float(b)) for a, b in intervals]
    if any(a >= b or a < 0 or b > L for a, b in out) or any(x[1] > y[0] for x, y in zip(out, out[1:])):
        raise ValueError("intervals must be sorted, disjoint and inside the sequence")
    return out


def negate(intervals: Sequence[tuple[float, float]], start: float, end: float) -> list[tuple[float, float]]:
    """The stretches of [start, end) outside sorted disjoint intervals."""
    cuts = [start, *[x for i in intervals for x in i], end]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]


def keep_intervals(g: Genealogy, intervals: Sequence[tuple[float, float]]) -> Genealogy:
    """Topology, sites and migrations inside the intervals only; coordinates and nodes stay."""
    iv = _check_intervals(intervals, g.sequence_length)
    lit = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in iv]) if iv else F.array().cast("array<struct<a:double,b:double>>")

    def clip(df: DataFrame) -> DataFrame:
        x = df.withColumn("_i", F.explode(F.filter(lit, lambda i: (i["a"] < F.col("right")) & (i["b"] > F.col("left")))))
        return x.withColumn("left", F.greatest("left", "_i.a")).withColumn("right", F.least("right", "_i.b")).drop("_i")

    inside = F.exists(lit, lambda i: (i["a"] <= F.col("position")) & (F.col("position") < i["b"])) if iv else F.lit(False)
    return sort(g.with_tables(edges=_cols(clip(g.edges), "edges"), migrations=_cols(clip(g.migrations), "migrations"), sites=g.sites.where(inside)))  # which numbers all tables once


def delete_intervals(g: Genealogy, intervals: Sequence[tuple[float, float]]) -> Genealogy:
    """Without topology, sites and migrations inside the intervals."""
    return keep_intervals(g, negate(_check_intervals(intervals, g.sequence_length), 0.0, g.sequence_length))


def shift(g: Genealogy, value: float, sequence_length: float | None = None) -> Genealogy:
    """All coordinates moved by ``value``; the sequence length too unless given."""
    L = g.sequence_length + value if sequence_length is None else sequence_length
    move = lambda df, *cs: df.withColumns({c: F.col(c) + float(value) for c in cs})
    ends = g.edges.agg(F.min("left"), F.max("right")).first()
    if ends[0] is not None and (ends[0] + value < 0 or ends[1] + value > L):
        raise ValueError("edges would leave the sequence")
    out = g.with_tables(edges=move(g.edges, "left", "right"), migrations=Later(lambda: move(g.migrations, "left", "right")), sites=Later(lambda: move(g.sites, "position")))
    return out.with_tables(sequence_length=float(L))


def trim(g: Genealogy, left: bool = True, right: bool = True) -> Genealogy:
    """Without the empty flanks before the first and after the last edge; sites in the flanks go."""
    a, b = g.edges.agg(F.min("left"), F.max("right")).first()
    if a is None:
        raise ValueError("there are no edges")
    a, b = (a if left else 0.0), (b if right else g.sequence_length)
    kept = keep_sites(g, g.sites.where((F.col("position") >= a) & (F.col("position") < b)))
    return shift(kept, -a, b - a)


def split_edges(g: Genealogy, time: float, flags: int = 0, population: int = -1) -> Genealogy:
    """A new node at ``time`` on every edge that crosses it; mutations on the upper part move to it."""
    _no_migrations(g)
    t = g.nodes.select("id", "time")
    e = g.edges.join(t.toDF("parent", "_pt"), "parent").join(t.toDF("child", "_ct"), "child")
    cross = (F.col("_ct") < time) & (F.col("_pt") > time)
    n = (g.nodes.agg(F.max("id")).first()[0] or 0) + 1
    new = dense_ids(e.where(cross), ["id"], "_k").withColumn("_u", F.col("_k") + n)
    lower = new.select(F.col("id"), "left", "right", F.col("_u").alias("parent"), "child", "metadata")
    upper = new.select(F.col("id"), "left", "right", "parent", F.col("_u").alias("child"), "metadata")
    edges = dense_ids(e.where(~cross).select(*names("edges")).unionByName(lower).unionByName(upper).withColumnRenamed("id", "_old"), ["_old", "child"])
    nodes = g.nodes.unionByName(new.select(F.col("_u").alias("id"), F.lit(flags).cast("long").alias("flags"), F.lit(float(time)).alias("time"), F.lit(population).cast("long").alias("population"), F.lit(-1).cast("long").alias("individual"), F.lit(None).cast("binary").alias("metadata")))
    m = g.mutations.join(g.sites.select(F.col("id").alias("site"), "position"), "site").join(t.toDF("node", "_nt"), "node")
    on = new.select(F.col("child").alias("node"), F.col("left").alias("_l"), F.col("right").alias("_r"), "_u")
    hit = m.where(F.coalesce("time", "_nt") >= time).join(on, "node").where((F.col("_l") <= F.col("position")) & (F.col("position") < F.col("_r"))).select("id", "_u")
    muts = g.mutations.join(hit, "id", "left").withColumn("node", F.coalesce("_u", "node"))
    return sort(g.with_tables(nodes=nodes, edges=_cols(edges, "edges"), mutations=_cols(muts, "mutations")))


def delete_older(g: Genealogy, time: float) -> Genealogy:
    """Without edges whose parent is older than ``time``, mutations at least as old, and migrations at least as old; nodes stay."""
    t = g.nodes.select("id", "time")
    edges = g.edges.join(t.toDF("parent", "_pt"), "parent").where(F.col("_pt") <= time)
    m = g.mutations.join(t.toDF("node", "_nt"), "node").where(F.coalesce("time", "_nt") < time)
    mig = g.migrations.where(F.col("time") < time)
    out = g.with_tables(edges=_cols(dense_ids(edges.drop("id"), ["_pt", "parent", "child", "left"]), "edges"), migrations=mig)
    return keep_mutations(out, m.select(*names("mutations")))


def decapitate(g: Genealogy, time: float, flags: int = 0, population: int = -1) -> Genealogy:
    """Topology and mutations at least as old as ``time`` removed; crossing edges end in new nodes at ``time``."""
    return delete_older(split_edges(g, time, flags, population), time)


def deduplicate_sites(g: Genealogy) -> Genealogy:
    """One site per position, the first; mutations move to it."""
    first = g.sites.groupBy("position").agg(F.min("id").alias("new"))
    to = g.sites.join(first, "position").select(F.col("id").alias("old"), "new")
    m = _remap(g.mutations, "site", to, drop=True)
    return keep_sites(g.with_tables(mutations=_cols(m, "mutations")), g.sites.join(first.select(F.col("new").alias("id")), "id", "left_semi"))


def with_mutation_parents(g: Genealogy) -> Genealogy:
    return g.with_tables(mutations=Later(lambda: _cols(g.mutations.drop("parent").join(mutation_parents(g), "id"), "mutations")))


def with_mutation_times(g: Genealogy) -> Genealogy:
    from kinweave.operators.genotypes import mutation_times

    m = g.mutations.drop("time").join(mutation_times(g), "id")
    return g.with_tables(mutations=_cols(m, "mutations"))


def _no_migrations(g: Genealogy) -> None:
    if not g.migrations.isEmpty():
        raise ValueError("migrations are not supported here")


def subset(g: Genealogy, nodes: DataFrame, remove_unreferenced: bool = True, reorder_populations: bool = True) -> Genealogy:
    """Only the nodes of ``nodes`` (``id``, ``order``), numbered by ``order``, with what refers to them.

    Populations come in the order of their first node, then those of migrations only; without ``reorder_populations`` all stay as they are.
    """
    to = dense_ids(nodes.select(F.col("id").alias("old"), "order"), ["order"], "new").select("old", "new")
    n = _remap(g.nodes, "id", to, drop=True)
    e = _remap(_remap(g.edges, "parent", to, drop=True), "child", to, drop=True)
    m = _remap(g.mutations, "node", to, drop=True)
    mig = _remap(g.migrations, "node", to, drop=True)
    out = g.with_tables(nodes=_cols(n, "nodes"), edges=_cols(e, "edges"), migrations=_cols(mig, "migrations"))
    if reorder_populations:
        out = _in_order_of_use(out, remove_unreferenced)
    if not remove_unreferenced:
        return sort(keep_mutations(out, m.select(*names("mutations"))))
    out = keep_mutations(out, m.select(*names("mutations")))
    return sort(_drop_unreferenced(out, sites=True, individuals=True, populations=False))


def _in_order_of_use(g: Genealogy, drop: bool) -> Genealogy:
    """Populations numbered by their first node; those that only migrations, or nothing, refer to follow by id, the latter unless dropped."""
    by_node = g.nodes.where("population <> -1").groupBy(F.col("population").alias("old")).agg(F.min("id").alias("first"))
    moved = g.migrations.select(F.explode(F.array("source", "dest")).alias("old")).distinct().withColumn("moved", F.lit(True))
    p = g.populations.withColumnRenamed("id", "old").join(by_node, "old", "left").join(moved, "old", "left")
    if drop:
        p = p.where("first is not null or moved")
    p = dense_ids(p, [F.col("first").asc_nulls_last(), F.col("moved").asc_nulls_last(), F.col("old")])
    to = p.select("old", F.col("id").alias("new"))
    mig = _remap(_remap(g.migrations, "source", to), "dest", to)
    return g.with_tables(populations=_cols(p, "populations"), nodes=_cols(_remap(g.nodes, "population", to), "nodes"), migrations=_cols(mig, "migrations"))


def _drop_unreferenced(g: Genealogy, sites: bool, individuals: bool, populations: bool) -> Genealogy:
    given = g  # the populations of nodes do not depend on what follows
    if sites:
        g = keep_sites(g, Later(lambda: given.sites.join(given.mutations.select(F.col("site").alias("id")), "id", "left_semi")))
    if individuals:
        used = Later(lambda: dense_ids(given.individuals.join(given.nodes.select(F.col("individual").alias("id")), "id", "left_semi").withColumnRenamed("id", "old"), ["old"]))
        to_ind = lambda: used().select("old", F.col("id").alias("new"))

        def kept() -> DataFrame:
            ind = used()
            par = ind.select("id", F.posexplode("parents").alias("_k", "_p")).join(to_ind().select(F.col("old").alias("_p"), F.col("new").alias("_q")), "_p", "left")
            par = par.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_q", F.lit(-1).cast("long")).alias("_q")))), lambda x: x["_q"]).alias("parents"))
            return _cols(ind.drop("parents").join(par, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<long>"))), "individuals")

        g = g.with_tables(individuals=Later(kept), nodes=Later(lambda: _cols(_remap(given.nodes, "individual", to_ind()), "nodes")))
    if populations:
        before = g

        def seen() -> DataFrame:
            ids = given.nodes.select(F.col("population").alias("id")).unionByName(given.migrations.select(F.col("source").alias("id"))).unionByName(given.migrations.select(F.col("dest").alias("id")))
            return dense_ids(given.populations.join(ids.distinct(), "id", "left_semi").withColumnRenamed("id", "old"), ["old"])

        pop = Later(seen)
        to_pop = lambda: pop().select("old", F.col("id").alias("new"))
        g = g.with_tables(
            populations=Later(lambda: _cols(pop(), "populations")), nodes=Later(lambda: _cols(_remap(before.nodes, "population", to_pop()), "nodes")),
            migrations=Later(lambda: _cols(_remap(_remap(given.migrations, "source", to_pop()), "dest", to_pop()), "migrations")),
        )
    return g


def simplify(
    g: Genealogy, samples: DataFrame | None = None, keep_unary: bool = False, keep_input_roots: bool = False, filter_nodes: bool = True, filter_sites: bool = True,
    filter_individuals: bool = True, filter_populations: bool = True, keep_unary_in_individuals: bool = False, reduce_to_site_topology: bool = False, update_sample_flags: bool = True,
) -> tuple[Genealogy, DataFrame]:
    """The part of the genealogy that relates the samples (``id``, ``order``), and the map of node ids (``old``, ``new``).

    A node stays over the stretches where it is a sample or at least two of its branches lead to samples (one, with ``keep_unary``). From each such stretch the
    walk upwards passes nodes that do not stay until it meets one that does; that gives an edge, and the mutations passed move to its child.
    Samples are numbered first in their order, then the other nodes by time and id. ``keep_unary_in_individuals`` keeps nodes of individuals as ``keep_unary`` does all;
    ``reduce_to_site_topology`` keeps only what trees at sites show, edges end at sites; without ``update_sample_flags`` flags stay as they are.
    """
    _no_migrations(g)
    if keep_unary and keep_unary_in_individuals:
        raise ValueError("keep unary nodes everywhere or in individuals")
    if samples is None:
        samples = g.samples().withColumn("order", F.col("id"))
    chosen = samples.select(F.col("id").alias("sample"), F.lit(0).alias("set")).distinct()
    flagged = g.with_tables(nodes=g.nodes.drop("flags").join(samples.select("id", F.lit(1).cast("long").alias("flags")).distinct(), "id", "left").fillna({"flags": 0}).select(*names("nodes")))
    L = float(g.sequence_length)
    c = sample_counts(flagged, chosen, 1, "simplify").where("x_all > 0").select(F.col("node").alias("child"), "left", "right")
    e = g.edges.select(F.col("left").alias("el"), F.col("right").alias("er"), "parent", "child")
    alive = c.join(e, "child").where((F.col("left") < F.col("er")) & (F.col("el") < F.col("right"))).select("parent", "child", F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right"))
    alive = stage(merged_intervals(alive, ["parent", "child"]), "alive")
    ev = alive.select(F.col("parent").alias("node"), F.col("left").alias("pos"), F.lit(1).alias("d")).unionByName(alive.select(F.col("parent").alias("node"), F.col("right").alias("pos"), F.lit(-1).alias("d")))
    rim = g.nodes.select(F.col("id").alias("node"), F.explode(F.array(F.lit(0.0), F.lit(L))).alias("pos"), F.lit(0).alias("d"))
    ev = ev.unionByName(rim).groupBy("node", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("node").orderBy("pos")
    kept = ev.select("node", F.col("pos").alias("left"), F.lead("pos").over(w).alias("right"), F.sum("d").over(w).alias("k")).where("right is not null")
    is_sample = samples.select(F.col("id").alias("node"), F.lit(True).alias("_s")).distinct()
    enough = F.lit(1 if keep_unary else 2)
    if keep_unary_in_individuals:
        kept = kept.join(g.nodes.select(F.col("id").alias("node"), (F.col("individual") != -1).alias("_i")), "node", "left")
        enough = F.when(F.col("_i"), 1).otherwise(2)
    status = kept.join(is_sample, "node", "left").select("node", F.col("left").alias("sl"), F.col("right").alias("sr"), (F.coalesce("_s", F.lit(False)) | (F.col("k") >= enough)).alias("stays"))
    status = stage(status, "status")
    up = alive.select(F.col("child").alias("node"), "parent", F.col("left").alias("el"), F.col("right").alias("er"))
    front = status.where("stays").select(F.col("node").alias("child"), "node", F.col("sl").alias("left"), F.col("sr").alias("right"))
    edges, passed = [], []
    while True:
        step = front.join(up, "node").where((F.col("el") < F.col("right")) & (F.col("left") < F.col("er"))).select("child", F.col("parent").alias("node"), F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right"))
        step = step.join(status, "node").where((F.col("sl") < F.col("right")) & (F.col("left") < F.col("sr"))).select("child", "node", F.greatest("left", "sl").alias("left"), F.least("right", "sr").alias("right"), "stays")
        step = stage(step, "step")
        if step.isEmpty():
            break
        edges.append(step.where("stays"))
        front = step.where("not stays").drop("stays")
        passed.append(front)
    none = g.spark.createDataFrame([], "child long, node long, left double, right double")
    raw = reduce(DataFrame.unionByName, [x.drop("stays") for x in edges], none)
    through = reduce(DataFrame.unionByName, passed, none)
    spots = through
    if keep_input_roots:
        # where a passed node has no alive branch above it, it is the root there and stays
        cover = stage(merged_intervals(alive.select(F.col("child").alias("node"), "left", "right"), ["node"]), "cover")
        rims = cover.unionByName(through.select("node", F.lit(0.0).alias("left"), F.lit(0.0).alias("right")).distinct())
        free = rims.select("node", F.col("right").alias("el"), F.lead("left", 1, L).over(Window.partitionBy("node").orderBy("left", "right")).alias("er")).where("el < er")
        ends, spots = (
            through.join(x, "node").where((F.col("el") < F.col("right")) & (F.col("left") < F.col("er"))).select("child", "node", F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right"))
            for x in (free, cover.select("node", F.col("left").alias("el"), F.col("right").alias("er")))
        )
        ends = stage(ends, "ends")
        spots = spots.unionByName(ends.withColumn("child", F.col("node")))
        raw = raw.unionByName(ends)
    if reduce_to_site_topology:
        raw = at_sites(g, raw)
    out = stage(merged_intervals(raw.select(F.col("node").alias("parent"), "child", "left", "right"), ["parent", "child"]), "edges")
    used = out.select(F.col("parent").alias("id")).unionByName(out.select(F.col("child").alias("id"))).distinct()
    if not filter_nodes:
        used = g.nodes.select("id")
    ids = used.unionByName(samples.select("id")).distinct().join(samples.select("id", "order"), "id", "left").join(g.nodes.select("id", "time"), "id")
    if filter_nodes:
        ids = dense_ids(ids, [F.col("order").asc_nulls_last(), F.col("time"), F.col("id")], "new")
    else:
        ids = ids.withColumn("new", F.col("id"))
    to = stage(ids.select(F.col("id").alias("old"), "new"), "ids")
    n = _remap(flagged.nodes if update_sample_flags else g.nodes, "id", to, drop=True)
    ed = _remap(_remap(out, "parent", to, drop=True), "child", to, drop=True)
    ed = ed.withColumn("id", F.lit(0).cast("long")).withColumn("metadata", F.lit(None).cast("binary"))
    # a mutation stays with its node where that is kept (or an input root), moves to the kept node below where it was passed, and goes elsewhere
    here = status.where("stays").select("node", F.col("sl").alias("left"), F.col("sr").alias("right"), F.col("node").alias("child"))
    spots = here.unionByName(spots.select("node", "left", "right", "child"))

    def mutations() -> DataFrame:
        sited = g.mutations.join(g.sites.select(F.col("id").alias("site"), "position"), "site")
        moved = sited.join(spots, "node").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).withColumn("node", F.col("child"))
        return _remap(moved.select(*names("mutations")), "node", to, drop=True)

    res = keep_mutations(g.with_tables(nodes=_cols(n, "nodes"), edges=_cols(ed, "edges")), Later(mutations))
    return _sorted(_drop_unreferenced(res, filter_sites, filter_individuals, filter_populations), n), to


def at_sites(g: Genealogy, stretches: DataFrame) -> DataFrame:
    """Stretches (``left``, ``right`` and other columns) with their ends moved up to the next site; the first site stands for 0, and behind the last one is the sequence's end.

    Stretches without a site go.
    """
    L = float(g.sequence_length)
    s = dense_ids(g.sites.select("position").distinct(), ["position"], "k")
    nxt = s.select((F.col("k") + 1).alias("k"), F.col("position").alias("before"))
    gap = s.join(nxt, "k", "left").select(F.coalesce("before", F.lit(-1.0)).alias("left"), F.col("position").alias("right"), F.when(F.col("k") == 0, 0.0).otherwise(F.col("position")).alias("site"))
    width = bin_width(g)
    ends = stretches.select(F.explode(F.array("left", "right")).alias("x")).distinct().withColumn("_bin", F.floor(F.col("x") / width))
    gap = gap.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("left") / width), F.floor(F.col("right") / width))))  # closed at the right
    gap = stage(gap, "gaps").join(ends, "_bin").where((F.col("left") < F.col("x")) & (F.col("x") <= F.col("right"))).groupBy("x").agg(F.min("site").alias("site"))
    out = stretches.join(gap.toDF("left", "_l"), "left").join(gap.toDF("right", "_r"), "right", "left")
    return out.withColumn("left", F.col("_l")).withColumn("right", F.coalesce("_r", F.lit(L))).where("left < right").select(*stretches.columns)


def shared_part_differs(g: Genealogy, other: Genealogy, mapping: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows of nodes, edges, sites and mutations among the shared nodes of ``mapping`` (``other``, ``own``) that only one of two genealogies has."""
    both = mapping.where("own <> -1")
    a = subset(g, both.select(F.col("own").alias("id"), F.col("own").alias("order")))
    b = subset(other, both.select(F.col("other").alias("id"), F.col("own").alias("order")))
    drop = lambda x: x.with_tables(nodes=x.nodes.withColumn("population", F.lit(-1).cast("long")).withColumn("individual", F.lit(-1).cast("long")))
    return difference(drop(a), drop(b), ("nodes", "edges", "sites", "mutations"))


def union(g: Genealogy, other: Genealogy, mapping: DataFrame, add_populations: bool = True, check_shared_equality: bool = False, all_edges: bool = False) -> Genealogy:
    """``g`` with the nodes of ``other`` that ``mapping`` (``other``, ``own``; -1 for new) does not share, and the edges, sites and mutations that touch a new node.

    Sites are matched by position. New nodes get new populations, one for each of theirs, or keep their numbers without ``add_populations``. ``check_shared_equality``
    refuses genealogies whose shared parts differ. ``all_edges`` takes the edges and mutations between shared nodes too.
    """
    if check_shared_equality and shared_part_differs(g, other, mapping):
        raise ValueError("the shared parts differ")
    if all_edges:
        return _union_all(g, other, mapping)
    base = (g.nodes.agg(F.max("id")).first()[0] or -1) + 1
    new = dense_ids(mapping.where("own = -1").select(F.col("other").alias("old")), ["old"], "k").select("old", (F.col("k") + base).alias("new"))
    to = stage(mapping.where("own <> -1").select(F.col("other").alias("old"), F.col("own").alias("new")).unionByName(new), "map")
    on = other.nodes.join(new, F.col("id") == F.col("old")).drop("old")
    pops, populations = None, Later(lambda: g.populations)
    if add_populations:
        pops = Later(lambda: dense_ids(on.where("population <> -1").select(F.col("population").alias("old")).distinct(), ["old"], "k").select("old", (F.col("k") + _last(g.populations) + 1).alias("new")))
        populations = Later(lambda: g.populations.unionByName(_cols(_remap(other.populations, "id", pops(), drop=True), "populations")))

    def fresh_individuals() -> DataFrame:
        return dense_ids(on.where("individual <> -1").select(F.col("individual").alias("old")).distinct(), ["old"], "k").select("old", (F.col("k") + _last(g.individuals) + 1).alias("new"))

    inds = Later(fresh_individuals)
    individuals = Later(lambda: g.individuals.unionByName(_cols(_remap(other.individuals, "id", inds(), drop=True), "individuals")))

    def nodes() -> DataFrame:
        added = _remap(on.withColumn("id", F.col("new")).drop("new"), "individual", inds())
        return g.nodes.unionByName(_cols(added if pops is None else _remap(added, "population", pops()), "nodes"))

    times = g.nodes.select("id", "time").unionByName(on.select(F.col("new").alias("id"), "time"))
    fresh = new.select("new")
    oe = _remap(_remap(other.edges, "parent", to, drop=True), "child", to, drop=True)
    oe = oe.join(fresh.select(F.col("new").alias("parent"), F.lit(True).alias("_p")), "parent", "left").join(fresh.select(F.col("new").alias("child"), F.lit(True).alias("_c")), "child", "left").where("_p or _c")
    edges = g.edges.unionByName(_cols(oe, "edges"))
    theirs = Later(lambda: _remap(other.mutations, "node", new, drop=True).join(other.sites.select(F.col("id").alias("site"), "position"), "site"))
    sites = Later(lambda: _with_sites(g, other, theirs()))
    muts = Later(lambda: _with_mutations(g, sites(), theirs()))
    out = _sorted(g.with_tables(nodes=Later(nodes), edges=edges, sites=sites, mutations=muts, individuals=individuals, populations=populations), times)
    return with_mutation_parents(out)


def _last(table: DataFrame) -> int:
    """The largest id, or -1."""
    found = table.agg(F.max("id")).first()[0]
    return -1 if found is None else found


def _with_sites(g: Genealogy, other: Genealogy, moved: DataFrame) -> DataFrame:
    """Sites of ``g``, and those of ``other`` at positions of ``moved`` mutations where ``g`` has none."""
    wanted = moved.select("position").distinct().join(g.sites.select("position"), "position", "left_anti")
    fresh = dense_ids(other.sites.drop("id").join(wanted, "position", "left_semi"), ["position"], "k").withColumn("id", F.col("k") + _last(g.sites) + 1)
    return stage(g.sites.unionByName(_cols(fresh, "sites")), "sites")


def _with_mutations(g: Genealogy, sites: DataFrame, moved: DataFrame) -> DataFrame:
    """Mutations of ``g``, and those ``moved`` from another genealogy, at the sites of their positions."""
    m = moved.drop("site", "parent").join(sites.select(F.col("id").alias("site"), "position"), "position").withColumn("id", F.col("id") + _last(g.mutations) + 1)
    return g.mutations.unionByName(_cols(m.withColumn("parent", F.lit(-1).cast("long")), "mutations"))


def concatenate(g: Genealogy, *others: Genealogy, mappings: Sequence[DataFrame | None] | None = None) -> Genealogy:
    """``others`` laid behind ``g`` along the sequence, one after the other.

    Samples are matched in order of id, other nodes are new, unless a mapping (``other``, ``own`` node of what stands before, -1 for new) is given for one of them.
    """
    for k, other in enumerate(others):
        g = _behind(g, other, mappings[k] if mappings else None)
    return g


def _behind(g: Genealogy, other: Genealogy, mapping: DataFrame | None) -> Genealogy:
    L = g.sequence_length + other.sequence_length
    moved = shift(other, g.sequence_length, L)
    if mapping is not None:
        return _union_all(g.with_tables(sequence_length=L), moved, stage(mapping, "mapping"))
    a = dense_ids(g.samples().withColumnRenamed("id", "own"), ["own"], "k")
    b = dense_ids(other.samples().withColumnRenamed("id", "other"), ["other"], "k")
    if a.count() != b.count():
        raise ValueError("both need equally many samples")
    pairs = a.join(b, "k").select("other", "own")
    mapping = other.nodes.select(F.col("id").alias("other")).join(pairs, "other", "left").select("other", F.coalesce("own", F.lit(-1).cast("long")).alias("own"))
    return _union_all(g.with_tables(sequence_length=L), moved, stage(mapping, "mapping"))


def _union_all(g: Genealogy, other: Genealogy, mapping: DataFrame) -> Genealogy:
    """As :func:`union`, with all edges and mutations of ``other``, also those between shared nodes."""
    out = union(g, other, mapping)
    shared = mapping.where("own <> -1").select(F.col("other").alias("old"), F.col("own").alias("new"))
    between = _remap(_remap(other.edges, "parent", shared, drop=True), "child", shared, drop=True)
    own = Later(lambda: _remap(other.mutations, "node", shared, drop=True).join(other.sites.select(F.col("id").alias("site"), "position"), "site"))
    sites = Later(lambda: _with_sites(out, other, own()))
    full = out.with_tables(edges=out.edges.unionByName(_cols(between, "edges")), sites=sites, mutations=Later(lambda: _with_mutations(out, sites(), own())))
    return with_mutation_parents(sort(full))


def canonicalise(g: Genealogy, remove_unreferenced: bool = True) -> Genealogy:
    """Unreferenced sites, individuals and populations dropped, all tables in their sorted order."""
    return sort(_drop_unreferenced(g, True, True, True)) if remove_unreferenced else sort(g)


def sort_individuals(g: Genealogy) -> Genealogy:
    """Parents before children: individuals by their greatest distance from an individual without known parents, then by id."""
    link = g.individuals.select("id", F.explode("parents").alias("p")).where("p <> -1").distinct()
    if not cycles(link.select(F.lit("individual").alias("kind"), F.col("id").alias("child"), F.col("p").alias("parent"))).isEmpty():
        raise ValueError("an individual is its own ancestor")
    depth = stage(g.individuals.select("id", F.lit(0).alias("depth")), "depth")
    while True:  # ends, as there are no loops
        up = link.join(depth.select(F.col("id").alias("p"), F.col("depth").alias("d")), "p").groupBy("id").agg((F.max("d") + 1).alias("d"))
        nxt = stage(depth.join(up, "id", "left").select("id", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")), "depth")
        depth = nxt.select("id", "depth")
        if nxt.where("moved").isEmpty():
            break
    ind = dense_ids(g.individuals.withColumnRenamed("id", "old").join(depth.withColumnRenamed("id", "old"), "old"), ["depth", "old"])
    to = stage(ind.select("old", F.col("id").alias("new")), "ids")
    par = ind.select("id", F.posexplode("parents").alias("_k", "_p")).join(to.select(F.col("old").alias("_p"), F.col("new").alias("_q")), "_p", "left")
    par = par.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_q", F.lit(-1).cast("long")).alias("_q")))), lambda x: x["_q"]).alias("parents"))
    ind = ind.drop("parents").join(par, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<long>")))
    return g.with_tables(individuals=_cols(ind, "individuals"), nodes=_cols(_remap(g.nodes, "individual", to), "nodes"))


def difference(a: Genealogy, b: Genealogy, tables: Sequence[str] | None = None) -> dict[str, tuple[int, int]]:
    """Rows of each table that only one of two genealogies has; empty where they are equal."""
    from kinweave.model import SCHEMAS

    out = {}
    for t in tables or SCHEMAS:
        x, y = _cols(getattr(a, t), t), _cols(getattr(b, t), t)
        d = x.exceptAll(y).count(), y.exceptAll(x).count()
        if any(d):
            out[t] = d
    return out

