"""Queries over the irregular genealogy of the nodes and edges tables, with SQL by definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import coalescence as co
from kinweave.operators import genotypes as ge
from kinweave.operators import statistics as st
from kinweave.operators import tables as tb
from kinweave.operators import transforms as tr
from kinweave.plans import ancestry as an
from kinweave.sources.irregular import DUCK, irregular

QUERIES: dict = {}
SQL: dict[str, str] = {}
WINDOWS = [0.0, 1e6, 5e6, 8e6]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: f(irregular(spark, d))
        SQL[f.__name__] = "WITH RECURSIVE " + DUCK + sql
        return f

    return add


@query(' SELECT (SELECT count(*) FROM ir_nodes) AS nodes, (SELECT count(*) FROM ir_edges) AS edges, (SELECT count(*) FROM ir_sites) AS sites, (SELECT count(*) FROM ir_mutations) AS mutations, (SELECT count(DISTINCT p) - 1 FROM (SELECT "left" AS p FROM ir_edges UNION ALL SELECT "right" FROM ir_edges UNION ALL SELECT 0e0 UNION ALL SELECT 8e6) q) AS trees')
def irregular_sizes(g):
    return g.spark.createDataFrame([(g.nodes.count(), g.edges.count(), g.sites.count(), g.mutations.count(), an.trees(g).count())], "nodes long, edges long, sites long, mutations long, trees long")


@query(' SELECT start, node, l AS "left", r AS "right", CAST(depth AS BIGINT) AS depth FROM anc')
def irregular_ancestry(g):
    return an.sample_ancestry(g).select("start", "node", "left", "right", "depth")


@query(' SELECT node, l AS "left", r AS "right", CAST(x AS BIGINT) AS x FROM cnt')
def irregular_counts(g):
    s = st.Sets.all(g)
    return an.sample_counts(g, s.table, 1, s.key).where("x_all > 0").select("node", "left", "right", F.col("x_all").alias("x"))


@query(' SELECT (SELECT min("time") FROM ir_nodes) AS min_time, (SELECT max("time") FROM ir_nodes) AS max_time')
def irregular_extremes(g):
    return tb.extremes(g).select("min_time", "max_time")


_ALONE = """, tied AS (SELECT child AS s, "left" AS l, "right" AS r FROM ir_edges UNION ALL SELECT parent, "left", "right" FROM ir_edges),
reach AS (SELECT s, l, max(r) OVER (PARTITION BY s ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT t.* FROM tied t JOIN samp ON samp.id = s UNION ALL SELECT id, 0e0, 0e0 FROM samp UNION ALL SELECT id, 8e6, 8e6 FROM samp) q),
alone AS (SELECT s AS sample, e AS l, l AS r FROM reach WHERE l > e)"""


@query(_ALONE + ' SELECT sample, l AS "left", r AS "right" FROM alone')
def irregular_isolated(g):
    return ge.isolated(g)


_HIT = """, hit AS (SELECT m.site, a.start AS sample, arg_max(m.derived_state, (-a.depth, m.id)) AS allele FROM ir_mutations m JOIN anc a ON a.node = m.node AND a.l <= m.site AND m.site < a.r GROUP BY ALL)"""


@query(_HIT + " SELECT site, sample, allele FROM hit")
def irregular_carriers(g):
    return ge.carriers(g).select("site", "sample", "allele")


@query(_ALONE + ", own AS (SELECT DISTINCT site, node FROM ir_mutations) SELECT s.id AS site, count(*) AS num_missing FROM ir_sites s JOIN alone a ON a.l <= s.\"position\" AND s.\"position\" < a.r WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.site = s.id AND o.node = a.sample) GROUP BY s.id")
def irregular_missing(g):
    return ge.missing(g).groupBy("site").agg(F.count(F.lit(1)).alias("num_missing"))


@query(""", up AS (SELECT m.id, m.site, m.node, a.node AS above, a.depth FROM ir_mutations m JOIN (
  WITH RECURSIVE w(id, site, start, node, depth) AS (SELECT id, site, node, node, 0 FROM ir_mutations UNION ALL SELECT w.id, w.site, w.start, e.parent, w.depth + 1 FROM w JOIN ir_edges e ON e.child = w.node AND e."left" <= w.site AND w.site < e."right") SELECT * FROM w) a ON a.id = m.id),
best AS (SELECT u.id, arg_max(o.id, (-u.depth, o.id)) AS parent FROM up u JOIN ir_mutations o ON o.site = u.site AND o.node = u.above WHERE u.depth > 0 OR o.id < u.id GROUP BY u.id)
SELECT m.id, coalesce(b.parent, -1) AS parent FROM ir_mutations m LEFT JOIN best b ON b.id = m.id""")
def irregular_mutation_parents(g):
    return an.mutation_parents(g)


_WIN = """, win(w, a, b) AS (VALUES (0, 0e0, 1e6), (1, 1e6, 5e6), (2, 5e6, 8e6)), n AS (SELECT count(*)::DOUBLE AS n FROM samp),
bw AS (SELECT w, b - a AS wide, x, len, least(r, b) - greatest(l, a) AS span FROM br, win WHERE l < b AND a < r)"""


@query(_WIN + ' SELECT CAST(w AS BIGINT) AS "window", round(sum(len * span * 2 * x * (n - x) / (n * (n - 1))) / any_value(wide), 6) AS diversity, round(sum(CASE WHEN x < n THEN len * span ELSE 0 END) / any_value(wide), 4) AS segregating FROM bw, n GROUP BY w')
def irregular_branch_statistics(g):
    s = st.Sets.all(g)
    d = st.one_way(g, "diversity", s, WINDOWS, "branch").select("window", F.round("value", 6).alias("diversity"))
    return d.join(st.one_way(g, "segregating_sites", s, WINDOWS, "branch").select("window", F.round("value", 4).alias("segregating")), "window")


@query(" SELECT node, round(sum((r - l) * x) / sum(r - l), 8) AS value FROM cnt GROUP BY node")
def irregular_mean_descendants(g):
    return st.mean_descendants(g, st.Sets.all(g)).where("value > 0").select("node", F.round("value", 8).alias("value"))


@query(""", t AS (SELECT node, sum((r - l) * x * x) AS v FROM cnt GROUP BY node), u AS (SELECT parent AS node, sum((r - l) * x * x) AS v FROM br GROUP BY parent)
SELECT * FROM (SELECT t.node, round((t.v - coalesce(u.v, 0) - CASE WHEN t.node IN (SELECT id FROM samp) THEN 8e6 ELSE 0 END) / 2 / 8e6, 3) AS value FROM t LEFT JOIN u ON u.node = t.node) q WHERE value > 0""")
def irregular_coalescence_counts(g):
    return co.coalescence_counts(g, st.Sets.all(g), [(0, 0)]).select("node", F.round("value", 3).alias("value")).where("value > 0")


@query(' SELECT id AS edge, parent, child FROM ir_edges WHERE "left" <= 4e6 AND "right" > 4e6')
def irregular_tree_at(g):
    return tb.tree_at(g, 4e6).select(F.col("id").alias("edge"), "parent", "child")


@query(""" SELECT parent, child, min("left") AS "left", max("right") AS "right" FROM (SELECT *, sum(CASE WHEN prev >= "left" THEN 0 ELSE 1 END) OVER (PARTITION BY parent, child ORDER BY "left") AS k FROM
  (SELECT *, lag("right") OVER (PARTITION BY parent, child ORDER BY "left") AS prev FROM ir_edges) q) q GROUP BY parent, child, k""")
def irregular_squashed(g):
    return tr.squash(g.edges)


@query(' SELECT e.parent, e.child, greatest("left", 2e6) AS "left", least("right", 3e6) AS "right" FROM ir_edges e WHERE "left" < 3e6 AND "right" > 2e6')
def irregular_kept_stretch(g):
    return tr.keep_intervals(g, [(2e6, 3e6)]).edges.select("parent", "child", "left", "right")


@query(""", q AS (SELECT quantile_disc("time", 0.5) AS t FROM ir_nodes), m AS (SELECT m.*, n."time" AS t FROM ir_mutations m JOIN ir_nodes n ON n.id = m.node)
SELECT 'edges' AS table_name, count(*) AS n FROM ir_edges e JOIN ir_nodes p ON p.id = e.parent, q WHERE p."time" <= q.t UNION ALL SELECT 'mutations', count(*) FROM m, q WHERE m.t < q.t""")
def irregular_deleted_older(g):
    n = g.nodes.count()
    at = g.nodes.selectExpr("percentile_disc(0.5) within group (order by time) t").first()[0] if n else 0.0
    d = tr.delete_older(g, at)
    return g.spark.createDataFrame([("edges", d.edges.count()), ("mutations", d.mutations.count())], "table_name string, n long")
