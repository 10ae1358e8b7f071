"""More queries over the bridged tables: stores, table edits, trees, two-locus statistics, descent and transformations, with SQL by definition."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import metadata as md
from kinweave.functions.ratemap import RateMap
from kinweave.genealogy_queries import _CNT, _GENO, _TREES, QUERIES, SQL, _trait, query, r9
from kinweave.model import Genealogy, violations
from kinweave.operators import coalescence as co
from kinweave.operators import genotypes as ge
from kinweave.operators import linkage as ld
from kinweave.operators import localtrees as lt
from kinweave.operators import statistics as st
from kinweave.operators import tables as tb
from kinweave.operators import transforms as tr
from kinweave.operators.skew import skew_join
from kinweave.plans import ancestry as an
from kinweave.plans.staging import load, shared_dir
from kinweave.sources import formats, store
from kinweave.sources.bridge import NATION, REGION, ROOT


def _folder(g: Genealogy) -> str:
    return f"{shared_dir(g.spark)}/query-{uuid.uuid4().hex}"


# --- stores and formats ----------------------------------------------------------------------------------------------------
def _stored(g: Genealogy, skip: tuple[str, ...] = ()) -> Genealogy:
    at = _folder(g)
    store.save(g, at)
    return store.load(g.spark, at, skip)


@query('SELECT id, "left", "right", parent, child FROM g_edges')
def stored_edges(g):
    return _stored(g, ("sites", "mutations")).edges.drop("metadata")


@query("SELECT id, site, node, derived_state FROM g_mutations")
def stored_mutations(g):
    return _stored(g, ("edges",)).mutations.select("id", "site", "node", "derived_state")


@query("""SELECT id, printf('%.4f', "left") || chr(9) || printf('%.4f', "right") || chr(9) || parent || chr(9) || child || chr(9) AS line FROM g_edges""")
def edge_lines(g):
    return store.text_rows(g, "edges", precision=4)


@query('SELECT "left", "right", parent, child FROM g_edges')
def parsed_edges(g):
    at = _folder(g)
    head = g.spark.createDataFrame([(-(10**9), store.text_header("edges"))], "id long, line string")
    head.unionByName(store.text_rows(g, "edges", precision=4)).orderBy("id").coalesce(1).select("line").write.text(at)  # the format is one file
    return store.parse_table(g.spark, "edges", at).select("left", "right", "parent", "child")


@query("""SELECT id, "time", population, individual, CAST(flags & 1 AS BIGINT) AS is_sample FROM g_nodes""")
def parsed_nodes(g):
    at = _folder(g)
    rows = store.text_rows(g, "nodes", precision=6).withColumn("line", F.col("line"))
    g.spark.createDataFrame([(-(10**9), store.text_header("nodes"))], "id long, line string").unionByName(rows).orderBy("id").coalesce(1).select("line").write.text(at)
    back = store.parse_table(g.spark, "nodes", at).withColumnRenamed("id", "n")
    ids = tr.dense_ids(g.nodes.select(F.col("id")), ["id"], "n")  # a text table numbers its lines
    return back.join(ids, "n").select("id", "time", "population", "individual", F.col("flags").alias("is_sample"))


@query(_GENO + """,
al AS (SELECT site, count(DISTINCT derived_state) + 1 AS k, string_agg(DISTINCT derived_state, '' ORDER BY derived_state) AS alt FROM g_mutations JOIN g_sites s ON s.id = site WHERE derived_state <> ancestral_state GROUP BY site),
car AS (SELECT h.site, count(*) AS n FROM hit h JOIN g_sites s ON s.id = h.site WHERE h.allele <> s.ancestral_state GROUP BY h.site)
SELECT s.id AS site, CAST(round_even(s."position", 0) AS BIGINT) AS pos, s.ancestral_state AS ref, coalesce(al.alt, '.') AS alt, coalesce(car.n, 0) AS carriers FROM g_sites s LEFT JOIN al ON al.site = s.id LEFT JOIN car ON car.site = s.id""")
def vcf_records(g):
    _, rows = formats.vcf_lines(g, allow_position_zero=True)
    cell = F.split("line", "\t")
    alt = F.array_join(F.array_sort(F.split(cell[4], ",")), "")
    gt = F.split(F.array_join(F.slice(cell, 10, 1 << 30), "|"), r"\|")
    return rows.select("site", F.col("position").alias("pos"), cell[3].alias("ref"), alt.alias("alt"), F.size(F.filter(gt, lambda x: (x != "0") & (x != "."))).cast("long").alias("carriers"))


@query("SELECT id, time2, population FROM (SELECT id, \"time\" * 2 AS time2, population FROM g_nodes) q")
def metadata_round_trip(g):
    schema = {"codec": "json", "type": "object"}
    rows = g.nodes.select("id", md.encoded(F.struct((F.col("time") * 2).alias("time2"), "population"), schema).alias("m"))
    back = md.decoded(F.col("m"), schema, "time2 double, population long")
    return rows.select("id", back.alias("v")).select("id", "v.time2", "v.population")


@query("""SELECT id, CASE WHEN "position" < 2 THEN 0.25e0 WHEN "position" < 5 THEN NULL ELSE 1.5e0 END AS rate FROM g_sites WHERE "position" < 10""")
def site_rates(g):
    m = RateMap([0, 2, 5, 10], [0.25, math.nan, 1.5])
    return g.sites.where("position < 10").select("id", m.rate_at(F.col("position")).alias("rate"))


# --- rows of tables --------------------------------------------------------------------------------------------------------
@query('SELECT id, "position", ancestral_state FROM g_sites WHERE "position" = 5')
def sites_at(g):
    return tb.site_at(g, 5.0).select("id", "position", "ancestral_state")


@query('SELECT id FROM g_nodes WHERE flags = 1 AND population = 3 AND "time" >= 0 AND "time" < 1')
def samples_of_population(g):
    return g.samples(population=3, time=(0.0, 1.0))


@query('SELECT id, CASE WHEN population = 1 THEN "time" + 1 ELSE "time" END AS "time" FROM g_nodes')
def updated_nodes(g):
    return tb.update_rows(g, "nodes", F.col("population") == 1, {"time": F.col("time") + 1}).nodes.select("id", "time")


@query("""SELECT id, "position" FROM g_sites UNION ALL SELECT (SELECT max(id) FROM g_sites) + row_number() OVER (ORDER BY "position"), "position" + 0.0001e0 FROM g_sites WHERE ancestral_state = 'C'""")
def appended_sites(g):
    new = g.sites.where("ancestral_state = 'C'").select((F.col("position") + 0.0001).alias("position"), "ancestral_state", "metadata")
    return tb.append_rows(g, "sites", new).sites.select("id", "position")


@query('SELECT id, "position" FROM g_sites WHERE id < 100')
def truncated_sites(g):
    return tb.truncate(g, "sites", 100).sites.select("id", "position")


@query("""SELECT t AS table_name, CAST(0 AS BIGINT) AS n FROM (SELECT unnest(['nodes', 'edges', 'sites', 'mutations']) AS t) q""")
def cleared_tables(g):
    c = tb.clear(g)
    out = [getattr(c, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")).select("table_name", "n") for t in ("nodes", "edges", "sites", "mutations")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT id, CAST(0 AS BIGINT) AS n FROM g_nodes")
def dropped_metadata(g):
    marked = g.with_tables(nodes=g.nodes.withColumn("metadata", F.lit(b"x")))
    return tb.drop_metadata(marked).nodes.select("id", F.octet_length("metadata").cast("long").alias("n"))


@query("""SELECT 'edges' AS table_name, count(*) AS n_rows, count(*) * 40 + 8 AS n_bytes FROM g_edges UNION ALL SELECT 'sites', count(*), count(*) * 25 + 16 FROM g_sites""")
def table_sizes(g):
    return tb.nbytes(g).where("table_name in ('edges', 'sites')").withColumn("n_bytes", F.col("n_bytes"))


@query("""SELECT row_number() OVER (ORDER BY s.n, m.id) - 1 AS id, s.n AS site, m.node, m.derived_state FROM g_mutations m JOIN (SELECT id, row_number() OVER (ORDER BY "position", id) - 1 AS n FROM g_sites) s ON s.id = m.site""")
def sorted_mutations(g):
    return tr.sort(g).mutations.select("id", "site", "node", "derived_state")


@query("""SELECT position, direction, edge FROM (SELECT e."right" AS position, 'in' AS direction, e.id AS edge FROM g_edges e UNION ALL SELECT e."left", 'out', e.id FROM g_edges e WHERE e."left" > 0) q""")
def reverse_edge_diffs(g):
    return tb.edge_diffs(g, reverse=True).select("position", "direction", "edge")


@query("""SELECT id AS edge, parent, child FROM g_edges JOIN (SELECT * FROM tr ORDER BY tree DESC LIMIT 1) t ON "left" <= t.l AND "right" > t.l""")
def last_tree(g):
    return tb.tree_at_index(g, -1).select(F.col("id").alias("edge"), "parent", "child")


@query("""SELECT greatest(t.l, o.l) AS "left", least(t.r, o.r) AS "right", t.tree, CAST(o.tree AS BIGINT) AS other_tree FROM tr t, (VALUES (0, 0e0, 0.5e0), (1, 0.5e0, 1e0), (2, 1e0, 2e0), (3, 2e0, 3e0), (4, 3e0, 10e0)) o(tree, l, r) WHERE t.l < o.r AND o.l < t.r""")
def coiterated(g):
    return tb.coiterate(g, tr.keep_intervals(g, [(0.5, 3.0)]))


# --- trees -----------------------------------------------------------------------------------------------------------------
@query(f"SELECT start, node, l AS \"left\", r AS \"right\" FROM anc WHERE depth > 0 AND node = {REGION + 3}")
def descendants_of_region(g):
    return an.ancestry(g).where((F.col("depth") > 0) & (F.col("node") == REGION + 3)).select("start", "node", "left", "right")


def _traversed(order: str):
    def f(g):
        return lt.traversal(g, order).select("tree", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))

    return f


_ORDERED = _TREES + "SELECT tree, string_agg(CAST(m.node AS VARCHAR), ',' ORDER BY {}) AS nodes FROM mem m JOIN g_nodes n ON n.id = m.node GROUP BY tree"
query(_ORDERED.format('n."time", m.node'), "nodes_timeasc")(_traversed("timeasc"))
query(_ORDERED.format('n."time" DESC, m.node DESC'), "nodes_timedesc")(_traversed("timedesc"))
#: positions of a node and its ancestors from the root down, by which any node comes right after its parent and its parent's earlier subtrees
_WAYS = _TREES + """,
way AS (SELECT pt.tree, pt.start AS node, string_agg(printf('%012d', pt.node), '/' ORDER BY pt.depth DESC) AS w FROM pt JOIN mem m ON m.tree = pt.tree AND m.node = pt.start GROUP BY ALL)
SELECT tree, string_agg(CAST(node AS VARCHAR), ',' ORDER BY {}) AS nodes FROM way GROUP BY tree"""
query(_WAYS.format("w"), "nodes_preorder")(_traversed("preorder"))
query(_WAYS.format("w || '~'"), "nodes_postorder")(_traversed("postorder"))
query(_WAYS.format("length(w), w"), "nodes_levelorder")(_traversed("levelorder"))


@query(_TREES + "SELECT le.tree, le.parent AS node, count(*) AS num_children, CAST(sum(coalesce(x, 0)) AS BIGINT) AS num_samples FROM le LEFT JOIN xs ON xs.tree = le.tree AND xs.node = le.child GROUP BY ALL")
def children_and_samples(g):
    kids = lt.children(g).select("tree", "node", "num_children")
    return kids.join(lt.live(g), ["tree", "node"])


# --- two-locus statistics --------------------------------------------------------------------------------------------------
_PAIRS = QUERIES and SQL["neighbour_r2"][len("WITH RECURSIVE ") :]
_PAIRS = _PAIRS[_PAIRS.index(_GENO) : _PAIRS.index("SELECT sa AS site_a")].rstrip()
_TWO = _PAIRS + """,
f AS (SELECT r.*, pa_ <> ancestral_a AND pb_ <> ancestral_b AS derived FROM (
  SELECT nx.sa, nx.sb, pa.allele AS pa_, pb.allele AS pb_, xa.ancestral_state AS ancestral_a, xb.ancestral_state AS ancestral_b, pa.k AS na, pb.k AS nb, coalesce(t.k, 0) AS nab, n
  FROM nx JOIN one pa ON pa.site = nx.sa JOIN one pb ON pb.site = nx.sb JOIN g_sites xa ON xa.id = nx.sa JOIN g_sites xb ON xb.id = nx.sb LEFT JOIN two t ON t.sa = nx.sa AND t.sb = nx.sb AND t.a = pa.allele AND t.b = pb.allele, tot) r),
v AS (SELECT *, nab / n - na / n * nb / n AS d, na / n AS p, nb / n AS q, nab AS x1, na - nab AS x2, nb - nab AS x3, n - na - nb + nab AS x4 FROM f)
SELECT sa AS site_a, sb AS site_b, 0e0 + round(avg(d * d), 8) AS "D2", 0e0 + round(avg(d * (1 - 2 * p) * (1 - 2 * q)), 8) AS "Dz", 0e0 + round(avg(p * (1 - p) * q * (1 - q)), 8) AS pi2, 0e0 + round(avg(CASE WHEN derived THEN d END), 8) AS "D",
  0e0 + round(avg((x1 * (x1 - 1) * x4 * (x4 - 1) + x2 * (x2 - 1) * x3 * (x3 - 1) - 2 * x1 * x2 * x3 * x4) / (n * (n - 1) * (n - 2) * (n - 3))), 8) AS "D2_unbiased"
FROM v GROUP BY ALL"""


@query(_TWO)
def neighbour_two_locus(g):
    return r9(ld.two_locus(g, ld.neighbours(g), ("D2", "Dz", "pi2", "D", "D2_unbiased")), "D2", "Dz", "pi2", "D", "D2_unbiased")


_SETS = """,
sx AS (SELECT id FROM samp WHERE population IN (0, 1)), sy AS (SELECT id FROM samp WHERE population IN (2, 3)),
{}
SELECT i.sa AS site_a, i.sb AS site_b, 0e0 + round(avg(i.d * j.d), 8) AS "D2_ij" FROM i JOIN j ON j.sa = i.sa AND j.sb = i.sb AND j.a = i.a AND j.b = i.b GROUP BY ALL"""


def _one_set(name: str, members: str) -> str:
    return f"""{name}_n AS (SELECT count(*)::DOUBLE AS n FROM {members}),
{name}one AS (SELECT al.site, al.allele, count(m.id)::DOUBLE AS k FROM al LEFT JOIN dense ON dense.site = al.site AND dense.allele = al.allele LEFT JOIN {members} m ON m.id = dense.sample GROUP BY ALL),
{name}two AS (SELECT sa, sb, x.allele AS a, y.allele AS b, count(*)::DOUBLE AS k FROM nx JOIN dense x ON x.site = sa JOIN {members} m ON m.id = x.sample JOIN dense y ON y.site = sb AND y.sample = x.sample GROUP BY ALL),
{name} AS (SELECT nx.sa, nx.sb, p.allele AS a, q.allele AS b, coalesce(t.k, 0) / n - p.k / n * q.k / n AS d FROM nx JOIN {name}one p ON p.site = nx.sa JOIN {name}one q ON q.site = nx.sb LEFT JOIN {name}two t ON t.sa = nx.sa AND t.sb = nx.sb AND t.a = p.allele AND t.b = q.allele, {name}_n)"""


@query(_PAIRS + _SETS.format(_one_set("i", "sx") + ",\n" + _one_set("j", "sy")))
def neighbour_two_way(g):
    of = lambda *p: g.nodes.where((F.col("flags") == 1) & F.col("population").isin(*p)).select(F.col("id").alias("sample"))
    return r9(ld.two_way(g, ld.neighbours(g), of(0, 1), of(2, 3), ("D2_ij",)), "D2_ij")


# --- descent ---------------------------------------------------------------------------------------------------------------
@query(f"""SELECT x.start AS a, y.start AS b, greatest(x.l, y.l) AS "left", least(x.r, y.r) AS "right", x.node FROM anc x JOIN anc y ON y.node = x.node AND x.l < y.r AND y.l < x.r AND x.start < y.start
WHERE x.start BETWEEN {NATION} AND {NATION + 99} AND y.start BETWEEN {NATION} AND {NATION + 99} AND NOT EXISTS (
  SELECT 1 FROM anc u JOIN anc v ON v.node = u.node WHERE u.start = x.start AND v.start = y.start AND u.depth < x.depth AND u.l < least(x.r, y.r) AND greatest(x.l, y.l) < u.r AND v.l < least(x.r, y.r) AND greatest(x.l, y.l) < v.r)""")
def nation_descent(g):
    return co.ibd_segments(g, g.nodes.where(F.col("id").between(NATION, NATION + 99)).select("id"))


@query(f"""SELECT a, b, count(*) AS n_segments, sum(r - l) AS total_span FROM (
  SELECT x.start AS a, y.start AS b, greatest(x.l, y.l) AS l, least(x.r, y.r) AS r FROM anc x JOIN anc y ON y.node = x.node AND x.l < y.r AND y.l < x.r AND x.start < y.start
  WHERE x.start BETWEEN {REGION} AND {REGION + 99} AND y.start BETWEEN {REGION} AND {REGION + 99} AND x.depth = 1 AND y.depth = 1) q GROUP BY ALL""")
def region_descent_totals(g):
    return co.ibd_totals(co.ibd_segments(g, g.nodes.where(F.col("id").between(REGION, REGION + 99)).select("id")))


@query(f""",
up AS (SELECT node AS parent, start AS child, l, r FROM anc WHERE node BETWEEN {REGION} AND {REGION + 99} AND start IN (SELECT id FROM samp)),
k AS (SELECT *, sum(CASE WHEN l <= prev THEN 0 ELSE 1 END) OVER (PARTITION BY parent, child ORDER BY l) AS k FROM (SELECT *, lag(r) OVER (PARTITION BY parent, child ORDER BY l) AS prev FROM up) q)
SELECT min(l) AS "left", max(r) AS "right", parent, child FROM k GROUP BY parent, child, k""")
def links_to_regions(g):
    return co.link_ancestors(g, g.samples(), g.nodes.where(F.col("id").between(REGION, REGION + 99)).select("id"))


@query(SQL["coalescence_quantiles"][len("WITH RECURSIVE ") : SQL["coalescence_quantiles"].index("cum AS (SELECT t")].split("samp AS (SELECT id, population FROM g_nodes WHERE flags = 1)", 1)[1] + """tw AS (SELECT *, CASE WHEN t < 1.1 THEN 0 WHEN t < 2.15 THEN 1 ELSE 2 END AS k FROM byt),
z AS (SELECT k, sum(p) AS p, sum(p * t) AS pt FROM tw GROUP BY k), c AS (SELECT *, sum(p) OVER () AS total, coalesce(sum(p) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM z)
SELECT CAST(k AS BIGINT) AS time_window, round(CASE k WHEN 2 THEN 1 / (pt / p - 2.15) ELSE ln(1 - (p / total) / (1 - bef / total)) / (CASE k WHEN 0 THEN -1.1 ELSE 1.1 - 2.15 END) END, 8) AS rate FROM c""")
def coalescence_rates(g):
    return r9(co.coalescence_rates(g, st.Sets.all(g), [(0, 0)], [0.0, 1.1, 2.15, math.inf]).select("time_window", "rate"), "rate")


@query(SQL["coalescence_quantiles"][len("WITH RECURSIVE ") : SQL["coalescence_quantiles"].index("cum AS (SELECT t")].split("samp AS (SELECT id, population FROM g_nodes WHERE flags = 1)", 1)[1] + """w AS (SELECT CASE WHEN t < 1.1 THEN 0 ELSE 1 END AS k, p FROM byt)
SELECT CAST(k AS BIGINT) AS time_window, round(sum(p) / 10, 6) AS value FROM w GROUP BY k""")
def coalescence_windows(g):
    return co.coalescence_by_time(g, st.Sets.all(g), [(0, 0)], [0.0, 1.1, 100.0]).select("time_window", F.round("value", 6).alias("value"))


# --- traits ----------------------------------------------------------------------------------------------------------------
_SITE_TRAIT = """,
tw AS (SELECT id, (id % 7)::DOUBLE AS w FROM samp), mo AS (SELECT count(*)::DOUBLE AS n, avg(w) AS m, stddev_samp(w) AS sd FROM tw),
al AS (SELECT DISTINCT site, derived_state AS allele FROM g_mutations UNION SELECT id, ancestral_state FROM g_sites),
ds AS (SELECT s.id AS site, t.id AS sample, coalesce(h.allele, s.ancestral_state) AS allele, t.w FROM g_sites s CROSS JOIN tw t LEFT JOIN hit h ON h.site = s.id AND h.sample = t.id),
by_ AS (SELECT site, allele, sum(w) AS s, count(*)::DOUBLE AS x FROM ds GROUP BY ALL)"""


@query(_GENO + _SITE_TRAIT + " SELECT round(sum((s - m * x) * (s - m * x) / (2 * (n - 1) * (n - 1))) / 10, 8) AS value FROM by_, mo")
def site_trait_covariance(g):
    return r9(st.trait_covariance(g, _trait(g), ["w"], "mod7", None, "site").select("value"), "value")


@query(_GENO + _SITE_TRAIT + " SELECT round(sum(CASE WHEN x < n THEN power((s - m * x) / sd, 2) / (2 * x * (1 - x / n) * (n - 1)) ELSE 0 END) / 10, 8) AS value FROM by_, mo")
def site_trait_correlation(g):
    return r9(st.trait_correlation(g, _trait(g), ["w"], "mod7", None, "site").select("value"), "value")


@query(_GENO + _SITE_TRAIT + """, g1 AS (SELECT sum((w - m) * (w - m)) AS sww FROM tw, mo)
SELECT round(sum(CASE WHEN x < n THEN power((s - m * x) / (x - x * x / n), 2) / 2 ELSE 0 END) / 10, 8) AS value FROM by_, mo, g1""")
def site_trait_linear_model(g):
    return r9(st.trait_linear_model(g, _trait(g), ["w"], [], "mod7", None, "site").select("value"), "value")


# --- transformations -------------------------------------------------------------------------------------------------------
@query("""SELECT row_number() OVER (ORDER BY "position", id) - 1 AS id, "position", (SELECT count(*) FROM g_mutations m WHERE m.site = s.id) AS n FROM g_sites s WHERE ancestral_state <> 'A'""")
def deleted_sites(g):
    d = tr.delete_sites(g, g.sites.where("ancestral_state = 'A'").select("id"))
    n = d.mutations.groupBy(F.col("site").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return d.sites.select("id", "position").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT parent, child, greatest("left", 2e0) - 2 AS "left", least("right", 7e0) - 2 AS "right" FROM g_edges WHERE "left" < 7 AND "right" > 2""")
def trimmed_edges(g):
    return tr.trim(tr.keep_intervals(g, [(2.0, 7.0)])).edges.select("parent", "child", "left", "right")


@query("""SELECT id, "left" + 5 AS "left", "right" + 5 AS "right" FROM g_edges""")
def shifted_edges(g):
    return tr.shift(g, 5.0).edges.select("id", "left", "right")


_SPLIT = """,
ends AS (SELECT e.*, p."time" AS pt, c."time" AS ct FROM g_edges e JOIN g_nodes p ON p.id = e.parent JOIN g_nodes c ON c.id = e.child),
cut AS (SELECT "left", "right", CASE WHEN pt > 1.5 AND ct < 1.5 THEN NULL ELSE parent END AS parent, child, CASE WHEN pt > 1.5 AND ct < 1.5 THEN 1.5e0 ELSE pt END AS "time" FROM ends
  UNION ALL SELECT "left", "right", parent, NULL, pt FROM ends WHERE pt > 1.5 AND ct < 1.5)
SELECT * FROM cut"""


def _named(g: Genealogy, old: Genealogy) -> DataFrame:
    """Edges with the ids of nodes that are new as NULL, and the time of the parent."""
    ids = old.nodes.select("id")
    p = ids.select(F.col("id").alias("parent"), F.col("id").alias("_p"))
    c = ids.select(F.col("id").alias("child"), F.col("id").alias("_c"))
    e = g.edges.join(g.nodes.select(F.col("id").alias("parent"), "time"), "parent").join(p, "parent", "left").join(c, "child", "left")
    return e.select("left", "right", F.col("_p").alias("parent"), F.col("_c").alias("child"), "time")


@query(_SPLIT)
def split_edges(g):
    return _named(tr.split_edges(g, 1.5), g)


@query(_SPLIT + ' WHERE "time" <= 1.5')
def decapitated(g):
    return _named(tr.decapitate(g, 1.5), g)


@query("""SELECT p.n AS parent, c.n AS child, e."left", e."right" FROM g_edges e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM g_nodes WHERE flags = 0 OR population = 2) p ON p.id = e.parent
JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM g_nodes WHERE flags = 0 OR population = 2) c ON c.id = e.child""")
def subset_edges(g):
    s = tr.subset(g, g.nodes.where("flags = 0 or population = 2").select("id", F.col("id").alias("order")))
    return s.edges.select("parent", "child", "left", "right")


_POP0 = SQL["simplified_to_population"]
_POP0 = _POP0[_POP0.index(",\nwin(w") : _POP0.index("SELECT parent, child, sum(r - l)")].rstrip()


@query(_POP0 + """
, used AS (SELECT parent AS id FROM up UNION SELECT child FROM up UNION SELECT id FROM s0)
SELECT u.id AS old, row_number() OVER (ORDER BY s0.id NULLS LAST, n."time", u.id) - 1 AS new FROM used u JOIN g_nodes n ON n.id = u.id LEFT JOIN s0 ON s0.id = u.id""")
def simplify_map(g):
    _, to = tr.simplify(g, g.samples(population=0).withColumn("order", F.col("id")))
    return to.select("old", "new")


@query(_POP0 + """
, cuts AS (SELECT parent, child, t.l, t.r, sum(CASE WHEN t.l = prev THEN 0 ELSE 1 END) OVER (PARTITION BY parent, child ORDER BY t.l) AS k FROM (SELECT up.parent, up.child, t.l, t.r, lag(t.r) OVER (PARTITION BY up.parent, up.child ORDER BY t.l) AS prev FROM up JOIN tr t ON t.tree = up.tree) t)
SELECT parent, child, min(l) AS "left", max(r) AS "right" FROM cuts GROUP BY parent, child, k""")
def simplified_edges(g):
    s, to = tr.simplify(g, g.samples(population=0).withColumn("order", F.col("id")))
    m = to.select("new", "old")
    e = s.edges.join(m.toDF("parent", "_p"), "parent").join(m.toDF("child", "_c"), "child")
    return e.select(F.col("_p").alias("parent"), F.col("_c").alias("child"), "left", "right")


@query("""SELECT "left", "right", parent, child, p."time" AS "time" FROM g_edges e JOIN g_nodes p ON p.id = e.parent
UNION ALL SELECT "left" + 10, "right" + 10, NULL, CASE WHEN child IN (SELECT id FROM samp) THEN child END, p."time" FROM g_edges e JOIN g_nodes p ON p.id = e.parent""")
def concatenated_edges(g):
    return _named(tr.concatenate(g, g), g)


@query("""SELECT e."left", e."right", e.parent, CASE WHEN c.population <> 3 OR c.flags = 0 THEN e.child END AS child, p."time" AS "time" FROM g_edges e JOIN g_nodes p ON p.id = e.parent JOIN g_nodes c ON c.id = e.child""")
def united_edges(g):
    away = (F.col("flags") == 1) & (F.col("population") == 3)
    part = g.with_tables(nodes=g.nodes.where(~away), edges=g.edges.join(g.nodes.where(~away).select(F.col("id").alias("child")), "child", "left_semi").select(g.edges.columns), mutations=g.mutations.join(g.nodes.where(~away).select(F.col("id").alias("node")), "node", "left_semi").select(g.mutations.columns))
    mapping = g.nodes.select(F.col("id").alias("other"), F.when(away, F.lit(-1)).otherwise(F.col("id")).alias("own"))
    return _named(tr.union(part, g, mapping, add_populations=False), part)


@query("""SELECT row_number() OVER (ORDER BY id) - 1 AS id, name FROM (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region JOIN g_nodes n ON n.population = r_regionkey) q""")
def canonical_populations(g):
    spare = g.with_tables(populations=g.populations.unionByName(g.spark.createDataFrame([(77, bytearray(b"unused"))], "id long, metadata binary")))
    return tr.canonicalise(spare).populations.select("id", F.decode("metadata", "UTF-8").alias("name"))


@query("""SELECT m.id, CASE WHEN m.id % 2 = 0 THEN 9e0 ELSE n."time" END AS "time" FROM g_mutations m JOIN g_nodes n ON n.id = m.node""")
def imputed_mutation_times(g):
    some = g.with_tables(mutations=g.mutations.withColumn("time", F.when(F.col("id") % 2 == 0, 9.0)))
    return ge.imputed_mutation_times(some)


@query("""SELECT row_number() OVER (ORDER BY p) - 1 AS id, p AS "position", n FROM (SELECT floor("position") AS p, CAST(sum((SELECT count(*) FROM g_mutations m WHERE m.site = s.id)) AS BIGINT) AS n FROM g_sites s GROUP BY 1) q""")
def deduplicated_sites(g):
    d = tr.deduplicate_sites(g.with_tables(sites=g.sites.withColumn("position", F.floor("position").cast("double"))))
    n = d.mutations.groupBy(F.col("site").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return d.sites.select("id", "position").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- variants, branches and distances --------------------------------------------------------------------------------------
_DENSE = _GENO + """,
dense AS (SELECT s.id AS site, s."position" AS pos, sa.id AS sample, coalesce(h.allele, s.ancestral_state) AS allele, s.ancestral_state AS anc FROM g_sites s CROSS JOIN samp sa LEFT JOIN hit h ON h.site = s.id AND h.sample = sa.id)"""


@query(_DENSE + """
SELECT site, pos AS "position", string_agg(allele, '' ORDER BY sample) AS states, count(*) FILTER (allele = anc) AS n_ancestral FROM dense WHERE pos >= 2.5 AND pos < 4 GROUP BY site, pos""")
def variant_states(g):
    v = ge.variants(g, 2.5, 4.0)
    return v.select("site", "position", F.array_join("states", "").alias("states"), F.element_at("counts", 1).alias("n_ancestral"))


@query(_DENSE + " SELECT sample, string_agg(allele, '' ORDER BY pos) AS haplotype FROM dense WHERE pos >= 2.5 AND pos < 4 GROUP BY sample")
def haplotypes_of_stretch(g):
    return ge.haplotypes(g, left=2.5, right=4.0)


@query(_DENSE + """, f AS (SELECT site, allele, count(*)::DOUBLE / (SELECT count(*) FROM samp) AS f FROM dense GROUP BY site, allele)
SELECT site, round(max(f), 8) AS most, round(sum(f * f), 8) AS homozygosity FROM f GROUP BY site""")
def allele_frequencies(g):
    v = ge.variants(g).select("site", "frequencies")
    return r9(v.select("site", F.array_max("frequencies").alias("most"), F.aggregate("frequencies", F.lit(0.0), lambda s, x: s + x * x).alias("homozygosity")), "most", "homozygosity")


@query(_TREES + """, two AS (SELECT tree FROM tr WHERE l IN (0, 4)),
br AS (SELECT le.tree, le.child AS node, len, x::DOUBLE AS x FROM le JOIN two ON two.tree = le.tree JOIN xs ON xs.tree = le.tree AND xs.node = le.child),
n AS (SELECT count(*)::DOUBLE AS n FROM samp),
me AS (SELECT pt.tree, pt.node, pt.start FROM pt JOIN two ON two.tree = pt.tree JOIN samp ON samp.id = pt.start JOIN br ON br.tree = pt.tree AND br.node = pt.node),
ab AS (SELECT a.tree AS ta, b.tree AS tb, a.node AS na, b.node AS nb, count(*)::DOUBLE AS k FROM me a JOIN me b ON b.start = a.start GROUP BY ALL),
v AS (SELECT a.tree AS ta, b.tree AS tb, a.len * b.len AS w, coalesce(ab.k, 0) / n - a.x / n * b.x / n AS d, a.x / n AS p, b.x / n AS q FROM br a CROSS JOIN br b LEFT JOIN ab ON ab.ta = a.tree AND ab.tb = b.tree AND ab.na = a.node AND ab.nb = b.node, n)
SELECT i.l AS position_a, j.l AS position_b, round(sum(w * d * d), 6) AS "D2", round(sum(w * p * (1 - p) * q * (1 - q)), 6) AS pi2 FROM v JOIN tr i ON i.tree = ta JOIN tr j ON j.tree = tb GROUP BY ALL""")
def branch_two_locus(g):
    pairs = g.spark.createDataFrame([(a, b) for a in (0.0, 4.0) for b in (0.0, 4.0)], "position_a double, position_b double")
    return ld.branch_two_locus(g, pairs, ("D2", "pi2")).select("position_a", "position_b", F.round("D2", 6).alias("D2"), F.round("pi2", 6).alias("pi2"))


def _matrix_sql() -> str:
    div = SQL["branch_divergence_matrix"][len("WITH RECURSIVE ") :]
    head, _, body = div.partition("samp AS (SELECT id, population FROM g_nodes WHERE flags = 1)")
    cut = body.index("SELECT '0,0' AS")
    return body[:cut].rstrip() + f""",
dm AS ({body[cut:]}),
nz AS (SELECT pop AS p, n FROM nn),
bm AS (SELECT CAST(split_part("index", ',', 1) AS INT) AS i, CAST(split_part("index", ',', 2) AS INT) AS j, CASE WHEN split_part("index", ',', 1) = split_part("index", ',', 2) THEN value * (n - 1) / n ELSE value END AS v FROM dm JOIN nz ON p = CAST(split_part("index", ',', 1) AS INT))
SELECT i, j, round((v + avg(v) OVER () - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j)) / -2, 6) AS value FROM bm"""


@query(_matrix_sql())
def branch_relatedness_matrix(g):
    from kinweave.genealogy_queries import pops
    from kinweave.operators.relatedness import relatedness_matrix

    return relatedness_matrix(g, pops(g), None, "branch").select("i", "j", F.round("value", 6).alias("value"))


@query(_TREES + """, cl AS (SELECT pt.tree, pt.node, count(*) AS n, sum(hash(pt.start)::HUGEINT) AS h FROM pt JOIN samp ON samp.id = pt.start GROUP BY ALL),
d AS (SELECT DISTINCT tree, n, h FROM cl), p AS (SELECT a.tree, b.tree AS other_tree FROM tr a, tr b),
u AS (SELECT p.tree, p.other_tree, n, h, count(*) AS k FROM p JOIN d ON d.tree = p.tree OR d.tree = p.other_tree GROUP BY ALL)
SELECT p.tree, p.other_tree, CASE WHEN p.tree = p.other_tree THEN 0 ELSE (SELECT count(*) FROM u WHERE u.tree = p.tree AND u.other_tree = p.other_tree AND k = 1) END AS rf FROM p""")
def tree_distances(g):
    t = an.trees(g).select("tree")
    n = t.count()  # ten trees
    pairs = t.withColumn("other_tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return lt.rf_distance(g, g, pairs)


@query(_TREES + "SELECT xs.tree, xs.node AS root FROM xs JOIN rt ON rt.tree = xs.tree AND rt.node = xs.node WHERE x >= 1000")
def roots_by_threshold(g):
    return lt.roots(g, 1000)


@query(_TREES + "SELECT pt.tree, pt.node, count(*) AS num_tracked FROM pt JOIN samp ON samp.id = pt.start AND samp.population = 2 GROUP BY ALL")
def tracked_samples(g):
    return lt.tracked(g, g.samples(population=2))


@query("""SELECT t.tree, s.id AS site, s."position", (SELECT count(*) FROM g_mutations m WHERE m.site = s.id) AS num_mutations FROM g_sites s JOIN tr t ON t.l <= s."position" AND s."position" < t.r""")
def sites_of_trees(g):
    return lt.sites_of_trees(g)


@query("""SELECT t.tree, u.tree AS other_tree, t.tree = u.tree AS same FROM tr t JOIN tr u ON u.tree - t.tree BETWEEN 0 AND 1""")
def same_trees(g):
    t = an.trees(g).select("tree", F.explode(F.array(F.col("tree"), F.col("tree") + 1)).alias("other_tree"))
    return lt.same_trees(g, g, t.join(an.trees(g).select(F.col("tree").alias("other_tree")), "other_tree", "left_semi"))


@query("""SELECT 'SITE:' || chr(9) || (row_number() OVER (ORDER BY s."position") - 1) AS line, s.n AS n_ancestral FROM (
  SELECT s.id, s."position", (SELECT count(*) FROM samp) - (SELECT count(DISTINCT a.start) FROM g_mutations m JOIN anc a ON a.node = m.node AND a.l <= s."position" AND s."position" < a.r JOIN samp ON samp.id = a.start WHERE m.site = s.id) AS n FROM g_sites s) s""")
def macs_sites(g):
    marked = g.with_tables(sites=g.sites.withColumn("ancestral_state", F.lit("Z")))  # every carrier then shows a derived state
    lines = [x for x in formats.macs_lines(marked) if x.startswith("SITE:")]  # the format is one stream
    return g.spark.createDataFrame([("\t".join(x.split("\t")[:2]), x.split("\t")[-1].count("Z")) for x in lines], "line string, n_ancestral long")


@query("""SELECT lo, count(*) AS n, round(sum(w), 6) AS span FROM (SELECT CASE WHEN child IN (SELECT id FROM samp) THEN 'sample' ELSE 'inner' END AS lo, "right" - "left" AS w FROM g_edges) q GROUP BY lo""")
def dict_round_trip(g):
    back = store.from_dict(g.spark, {k: v for k, v in store.as_dict(g.with_tables(sites=g.sites.limit(0), mutations=g.mutations.limit(0))).items()})
    kind = F.when(F.col("s").isNotNull(), "sample").otherwise("inner")
    e = back.edges.join(back.samples().select(F.col("id").alias("child"), F.lit(1).alias("s")), "child", "left")
    return e.groupBy(kind.alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("right") - F.col("left")), 6).alias("span"))


@query(_POP0 + """
SELECT parent, child, sum(r - l) AS span FROM up JOIN tr t ON t.tree = up.tree GROUP BY ALL""")
def simplified_at_sites(g):
    """Sites laid on the breakpoints and between them, so that reducing to sites changes nothing."""
    every = g.with_tables(sites=an.breakpoints(g).where("position < 10").select(F.col("position").cast("long").alias("id"), "position", F.lit("A").alias("ancestral_state"), F.lit(None).cast("binary").alias("metadata")), mutations=g.mutations.limit(0))
    s, to = tr.simplify(every, g.samples(population=0).withColumn("order", F.col("id")), reduce_to_site_topology=True, filter_sites=False)
    m = to.select("new", "old")
    e = s.edges.join(m.toDF("parent", "_p"), "parent").join(m.toDF("child", "_c"), "child")
    return e.groupBy(F.col("_p").alias("parent"), F.col("_c").alias("child")).agg(F.sum(F.col("right") - F.col("left")).alias("span"))


@query(_GENO + """, tw AS (SELECT id, (id % 7)::DOUBLE AS w FROM samp), dv AS (SELECT h.site, h.sample, h.allele FROM hit h JOIN g_sites s ON s.id = h.site WHERE h.allele <> s.ancestral_state),
sm AS (SELECT site, allele, sum(w) AS w FROM dv JOIN tw ON tw.id = dv.sample GROUP BY ALL)
SELECT sample, round(sum(sm.w) / 10, 6) AS w FROM dv JOIN sm ON sm.site = dv.site AND sm.allele = dv.allele GROUP BY sample""")
def site_relatedness_vector(g):
    from kinweave.operators.relatedness import relatedness_vector

    return relatedness_vector(g, _trait(g), ["w"], "mod7", centre=False, mode="site").select("sample", F.round("w", 6).alias("w"))


@query(_TREES + """, tw AS (SELECT id, (id % 7)::DOUBLE AS w FROM samp), bw AS (SELECT pt.tree, pt.node, sum(w) AS w FROM pt JOIN tw ON tw.id = pt.start GROUP BY ALL)
SELECT pt.start AS sample, round(sum((le.r - le.l) * len * bw.w) / 10, 4) AS w FROM pt JOIN samp ON samp.id = pt.start JOIN le ON le.tree = pt.tree AND le.child = pt.node JOIN bw ON bw.tree = pt.tree AND bw.node = pt.node GROUP BY pt.start""")
def branch_relatedness_vector(g):
    from kinweave.operators.relatedness import relatedness_vector

    return relatedness_vector(g, _trait(g), ["w"], "mod7b", centre=False).select("sample", F.round("w", 4).alias("w"))


# --- raw tables ------------------------------------------------------------------------------------------------------------
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the data model that rows of the raw tables break, counted."""
    empty = spark.createDataFrame([], "id long, position double, ancestral_state string, metadata binary")
    muts = spark.createDataFrame([], "id long, site long, node long, parent long, time double, derived_state string, metadata binary")
    prov = spark.createDataFrame([], "id long, timestamp string, record string")
    g = Genealogy(**{t: load(spark, d, t) for t in ("nodes", "edges", "individuals", "populations", "migrations")}, sites=empty, mutations=muts, provenances=prov, sequence_length=8e6)
    return violations(g).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("n"))


def skewed_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the time of their parent by fragment and replicate, whatever the size of nodes."""
    n = load(spark, d, "nodes").groupBy(F.col("id").alias("parent")).agg(F.min_by("time", "recorded_at").alias("parent_time"))
    e = load(spark, d, "edges").select("id", "parent", "child", "recorded_at")
    return skew_join(e, n, "parent", "left", ["id"], limit=0).select("id", "parent", "child", F.when(~F.isnan("parent_time"), F.round("parent_time", 6)).alias("parent_time"))


QUERIES["rule_violations"] = rule_violations
QUERIES["skewed_join"] = skewed_join
SQL["skewed_join"] = """SELECT e.id, e.parent, e.child, CASE WHEN NOT isnan(n.t) THEN round(n.t, 6) END AS parent_time FROM edges e LEFT JOIN (
  SELECT id, any_value("time") AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at) AS k FROM nodes) q WHERE k = 1 GROUP BY id) n ON n.id = e.parent"""
SQL["rule_violations"] = """
WITH n AS (SELECT id, "time" AS t FROM nodes), e AS (SELECT e.*, p.t AS pt, p.id AS pid, c.t AS ct, c.id AS cid FROM edges e LEFT JOIN n p ON p.id = e.parent LEFT JOIN n c ON c.id = e.child)
SELECT * FROM (
SELECT 'nodes' AS table_name, 'time is not finite' AS rule, count(*) AS n FROM nodes WHERE "time" IS NULL OR isnan("time")
UNION ALL SELECT 'nodes', 'population does not exist', count(*) FROM nodes WHERE population <> -1 AND population NOT IN (SELECT id FROM populations)
UNION ALL SELECT 'nodes', 'individual does not exist', count(*) FROM nodes WHERE individual <> -1 AND individual NOT IN (SELECT id FROM individuals)
UNION ALL SELECT 'edges', 'interval is empty or outside the sequence', count(*) FROM edges WHERE "left" < 0 OR "right" > 8e6 OR NOT "left" < "right"
UNION ALL SELECT 'edges', 'parent does not exist', count(*) FROM e WHERE pt IS NULL
UNION ALL SELECT 'edges', 'child does not exist', count(*) FROM e WHERE ct IS NULL
UNION ALL SELECT 'edges', 'parent is not older than child', count(*) FROM e WHERE pt <= ct
UNION ALL SELECT 'edges', 'intervals of a child overlap', count(*) FROM (SELECT "left", lag("right") OVER (PARTITION BY child ORDER BY "left" NULLS FIRST, "right" NULLS FIRST) AS b FROM edges) q WHERE b > "left"
UNION ALL SELECT 'individuals', 'is its own parent', count(*) FROM (SELECT id, unnest(parents) AS p FROM individuals) q WHERE p = id AND p <> -1
UNION ALL SELECT 'individuals', 'parent does not exist', count(*) FROM (SELECT id, unnest(parents) AS p FROM individuals) q WHERE p <> -1 AND p NOT IN (SELECT id FROM individuals)
UNION ALL SELECT 'migrations', 'interval is empty', count(*) FROM migrations WHERE NOT "left" < "right"
) q WHERE n > 0"""

__all__ = ["QUERIES", "ROOT", "SQL", "_CNT"]
