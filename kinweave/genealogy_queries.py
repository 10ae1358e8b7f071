"""Queries of the genealogy operators over the bridged tables, with SQL by definition (per local tree or per sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import statistics as st
from kinweave.plans import ancestry as an
from kinweave.sources.bridge import DUCK, L, bridge

WINDOWS = [0.0, 2.5, 5.0, 10.0]
POPULATIONS = [0, 1, 2, 3, 4]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d, f=f: f(bridge(spark, d))
        if sql:
            SQL[key] = "WITH RECURSIVE " + DUCK + sql
        return f

    return add


def r9(df: DataFrame, *cols: str) -> DataFrame:
    """Values rounded for comparison; NaN becomes NULL."""
    for c in cols:
        df = df.withColumn(c, F.when(~F.isnan(c), F.round(F.col(c), 8) + 0.0))
    return df


_W = ",\nwin(w, wl, wr) AS (VALUES (0, 0e0, 2.5e0), (1, 2.5e0, 5e0), (2, 5e0, 10e0))"
#: counts per tree, node and population (set) and over all samples, from the root paths of samples
_CNT = _W + """,
sa AS (SELECT a.*, s.population AS pop FROM anc a JOIN samp s ON s.id = a.start),
nn AS (SELECT population AS pop, count(*)::DOUBLE AS n FROM samp GROUP BY population),
cnt AS (SELECT tree, t.l, t.r, node, pop, count(*)::DOUBLE AS x FROM sa a JOIN tr t ON a.l < t.r AND t.l < a.r GROUP BY ALL),
br AS (SELECT t.tree, t.l, t.r, e.child AS node, p."time" - c."time" AS len FROM tr t JOIN g_edges e ON e."left" < t.r AND t.l < e."right" JOIN g_nodes p ON p.id = e.parent JOIN g_nodes c ON c.id = e.child)"""
#: genotypes of every sample at every site that has a mutation above it
_GENO = _W + """,
hit AS (SELECT m.site, a.start AS sample, arg_max(m.derived_state, (-a.depth, m.id)) AS allele FROM g_mutations m JOIN g_sites s ON s.id = m.site JOIN anc a ON a.node = m.node AND a.l <= s."position" AND s."position" < a.r JOIN samp ON samp.id = a.start GROUP BY ALL),
nn AS (SELECT population AS pop, count(*)::DOUBLE AS n FROM samp GROUP BY population),
hc AS (SELECT site, allele, population AS pop, count(*)::DOUBLE AS x FROM hit JOIN samp ON samp.id = hit.sample GROUP BY ALL),
full_ AS (SELECT s.id AS site, s."position" AS pos, s.ancestral_state AS allele, n.pop, n.n - coalesce((SELECT sum(x) FROM hc WHERE hc.site = s.id AND hc.pop = n.pop), 0) AS x0 FROM g_sites s, nn n),
ac AS (SELECT site, pos, allele, anc_, pop, sum(x) AS x FROM (
  SELECT site, pos, allele, true AS anc_, pop, x0 AS x FROM full_
  UNION ALL SELECT h.site, s."position", h.allele, h.allele = s.ancestral_state, h.pop, h.x FROM hc h JOIN g_sites s ON s.id = h.site) q GROUP BY ALL)"""


def pops(g) -> st.Sets:
    return st.Sets.by_population(g, POPULATIONS)


@query("SELECT tree, l AS \"left\", r AS \"right\" FROM tr")
def trees(g):
    return an.trees(g)


@query("SELECT p AS \"position\" FROM bp")
def breakpoints(g):
    return an.breakpoints(g)


@query("SELECT tree, l AS \"left\", r AS \"right\", parent, child, e.id AS edge FROM tr JOIN g_edges e ON e.\"left\" < r AND l < e.\"right\"")
def local_edges(g):
    return an.local_edges(g)


@query("SELECT start, node, l AS \"left\", r AS \"right\", CAST(depth AS BIGINT) depth FROM anc")
def ancestry(g):
    return an.ancestry(g).select("start", "node", "left", "right", "depth")


@query(_CNT + "SELECT tree, node, CAST(sum(x) AS BIGINT) AS num_samples FROM cnt GROUP BY tree, node")
def num_samples_per_tree(g):
    s = st.Sets.all(g)
    c = an.sample_counts(g, s.table, 1, s.key).where("x_all > 0")
    t = an.overlap_join(c, an.trees(g), an.bin_width(g))
    return t.select("tree", "node", F.col("x_all").alias("num_samples"))


@query(_GENO + """
SELECT site, allele, pop AS population, CAST(x AS BIGINT) AS n FROM ac WHERE x > 0""")
def allele_counts(g):
    s = pops(g)
    a = an.allele_counts(g, s.table, s.k, s.key)
    cells = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("population"), F.col(f"x_{j}").alias("n")) for j, p in enumerate(POPULATIONS)]))
    return a.select("site", "allele", cells.alias("_")).select("site", "allele", "_.*").where("n > 0")


@query(_GENO + """
, per AS (SELECT site, w.w, wr - wl AS span, a.pop, sum(x * (n - x)) / any_value(n * (n - 1)) AS d, sum(CASE WHEN x > 0 THEN 1 - x / n ELSE 0 END) AS s, sum(x * (n - x) * (n - x - 1)) / any_value(n * (n - 1) * (n - 2)) AS y
  FROM ac a JOIN nn ON nn.pop = a.pop JOIN win w ON wl <= pos AND pos < wr GROUP BY ALL)
SELECT CAST(w AS BIGINT) AS "window", CAST(pop AS BIGINT) AS population, round(sum(d) / any_value(span), 8) AS diversity, round(sum(s) / any_value(span), 8) AS segregating_sites, round(sum(y) / any_value(span), 8) AS y1 FROM per GROUP BY w, pop""")
def site_one_way(g):
    s = pops(g)
    fs = {f"{name}|{i}": st._ONE[name](s.n, i) for name in st._ONE for i in range(s.k)}
    d = st.stat(g, s, fs, WINDOWS, "site")
    d = d.withColumn("population", F.split("index", r"\|")[1].cast("long")).withColumn("name", F.split("index", r"\|")[0])
    d = d.groupBy("window", "population").pivot("name", list(st._ONE)).agg(F.first("value"))
    return r9(d.withColumnRenamed("Y1", "y1"), "diversity", "segregating_sites", "y1")


@query(_CNT + """
, grid AS (SELECT b.*, nn.pop, nn.n, coalesce(c.x, 0) AS x FROM br b CROSS JOIN nn LEFT JOIN cnt c ON c.tree = b.tree AND c.node = b.node AND c.pop = nn.pop)
SELECT CAST(w AS BIGINT) AS "window", CAST(pop AS BIGINT) AS population, round(sum((least(r, wr) - greatest(l, wl)) * len * 2 * x * (n - x) / (n * (n - 1))) / any_value(wr - wl), 8) AS diversity,
  round(sum((least(r, wr) - greatest(l, wl)) * len * ((CASE WHEN x > 0 THEN 1 - x / n ELSE 0 END) + (CASE WHEN x < n THEN x / n ELSE 0 END))) / any_value(wr - wl), 8) AS segregating_sites
FROM grid JOIN win ON l < wr AND wl < r GROUP BY w, pop""")
def branch_one_way(g):
    s = pops(g)
    names = ("diversity", "segregating_sites")
    d = st.stat(g, s, {f"{name}|{i}": st._ONE[name](s.n, i) for name in names for i in range(s.k)}, WINDOWS, "branch")
    d = d.withColumn("population", F.split("index", r"\|")[1].cast("long")).withColumn("name", F.split("index", r"\|")[0])
    return r9(d.groupBy("window", "population").pivot("name", list(names)).agg(F.first("value")), *names)


@query(_CNT + """
, tot AS (SELECT count(*)::DOUBLE AS n FROM samp), all_ AS (SELECT tree, l, r, node, sum(x) AS x FROM cnt GROUP BY ALL)
SELECT node, round(sum((r - l) * 2 * x * (n - x) / (n * (n - 1))) / 10e0, 8) AS diversity FROM all_, tot GROUP BY node HAVING sum((r - l) * x * (n - x)) > 0""")
def node_diversity(g):
    d = st.one_way(g, "diversity", st.Sets.all(g), None, "node")
    return r9(d.where("value > 0").select("node", F.col("value").alias("diversity")), "diversity")


_MANY_INDEX = {"divergence": [(0, 1), (2, 2), (3, 4)], "Y2": [(0, 1), (4, 2)], "Y3": [(0, 1, 2)], "f2": [(0, 1), (2, 3)], "f3": [(0, 1, 2)], "f4": [(0, 1, 2, 3)]}
_F = {
    "divergence": "x{0} * (n{1} - x{1}) / (n{0} * (n{1} - {same}))", "Y2": "x{0} * (n{1} - x{1}) * (n{1} - x{1} - 1) / (n{0} * n{1} * (n{1} - 1))",
    "Y3": "x{0} * (n{1} - x{1}) * (n{2} - x{2}) / (n{0} * n{1} * n{2})",
    "f2": "(x{0} * (x{0} - 1) * (n{1} - x{1}) * (n{1} - x{1} - 1) - x{0} * (n{0} - x{0}) * (n{1} - x{1}) * x{1}) / (n{0} * (n{0} - 1) * n{1} * (n{1} - 1))",
    "f3": "(x{0} * (x{0} - 1) * (n{1} - x{1}) * (n{2} - x{2}) - x{0} * (n{0} - x{0}) * (n{1} - x{1}) * x{2}) / (n{0} * (n{0} - 1) * n{1} * n{2})",
    "f4": "(x{0} * x{2} * (n{1} - x{1}) * (n{3} - x{3}) - x{0} * x{3} * (n{1} - x{1}) * (n{2} - x{2})) / (n{0} * n{1} * n{2} * n{3})",
}
_WIDE = ", ".join(f"max(CASE WHEN a.pop = {p} THEN x ELSE 0 END) AS x{p}" for p in POPULATIONS)
_WN = "wn AS (SELECT " + ", ".join(f"max(CASE WHEN pop = {p} THEN n END) AS n{p}" for p in POPULATIONS) + " FROM nn)"


def _many_sql(mode: str) -> str:
    parts = []
    for name, tuples in _MANY_INDEX.items():
        for t in tuples:
            f = _F[name].format(*t, same=int(len(t) == 2 and t[0] == t[1]))
            label = f"'{name}' AS stat, '{','.join(map(str, t))}' AS \"index\""
            if mode == "site":
                parts.append(f"SELECT CAST(w AS BIGINT) AS \"window\", {label}, round(sum({f}) / any_value(wr - wl), 8) AS value FROM wide, wn, win WHERE wl <= pos AND pos < wr GROUP BY w")
            else:
                back = f
                for p in set(t):
                    back = back.replace(f"x{p}", f"(n{p} - y{p})")
                for p in set(t):
                    back = back.replace(f"y{p}", f"x{p}")
                parts.append(f"SELECT CAST(w AS BIGINT) AS \"window\", {label}, round(sum((least(r, wr) - greatest(l, wl)) * len * ({f} + {back})) / any_value(wr - wl), 8) AS value FROM wide, wn, win WHERE l < wr AND wl < r GROUP BY w")
    if mode == "site":
        return _GENO + f", wide AS (SELECT site, pos, allele, {_WIDE} FROM ac a GROUP BY ALL), {_WN}\n" + "\nUNION ALL ".join(parts)
    return _CNT + f", wide AS (SELECT b.tree, b.l, b.r, b.node, len, {_WIDE} FROM br b LEFT JOIN cnt a ON a.tree = b.tree AND a.node = b.node GROUP BY ALL), {_WN}\n" + "\nUNION ALL ".join(parts)


def _many(g, mode):
    s = pops(g)
    fs = {f"{name}|{','.join(map(str, t))}": st._MANY[name][0](s.n, *t) for name, ts in _MANY_INDEX.items() for t in ts}
    d = st.stat(g, s, fs, WINDOWS, mode)
    return r9(d.select("window", F.split("index", r"\|")[0].alias("stat"), F.split("index", r"\|")[1].alias("index"), "value"), "value")


query(_many_sql("site"), "site_many_way")(lambda g: _many(g, "site"))
query(_many_sql("branch"), "branch_many_way")(lambda g: _many(g, "branch"))


# --- trees -----------------------------------------------------------------------------------------------------------------
from kinweave.operators import coalescence as co  # noqa: E402
from kinweave.operators import genotypes as ge  # noqa: E402
from kinweave.operators import linkage as ld  # noqa: E402
from kinweave.operators import localtrees as lt  # noqa: E402
from kinweave.operators import transforms as tr  # noqa: E402

#: paths of every node by tree, numbers of samples, members of trees and their leaves
_TREES = """,
pt AS (SELECT t.tree, t.l, t.r, a.start, a.node, a.depth FROM anc a JOIN tr t ON a.l < t.r AND t.l < a.r),
le AS (SELECT t.tree, t.l, t.r, e.parent, e.child, e.id AS edge, p."time" - c."time" AS len, c."time" AS ct FROM tr t JOIN g_edges e ON e."left" < t.r AND t.l < e."right" JOIN g_nodes p ON p.id = e.parent JOIN g_nodes c ON c.id = e.child),
xs AS (SELECT tree, node, count(*) AS x FROM pt JOIN samp ON samp.id = pt.start GROUP BY ALL),
rt AS (SELECT x.tree, x.node FROM xs x LEFT JOIN le ON le.tree = x.tree AND le.child = x.node WHERE le.child IS NULL),
mem AS (SELECT pt.tree, pt.start AS node, pt.depth FROM pt JOIN rt ON rt.tree = pt.tree AND rt.node = pt.node),
lf AS (SELECT m.* FROM mem m LEFT JOIN (SELECT DISTINCT tree, parent FROM le) p ON p.tree = m.tree AND p.parent = m.node WHERE p.parent IS NULL)
"""


@query(_TREES + 'SELECT tree, node AS root FROM rt')
def roots(g):
    return lt.roots(g)


@query(_TREES + "SELECT m.tree, round(sum(len), 8) AS total_branch_length FROM mem m JOIN le ON le.tree = m.tree AND le.child = m.node GROUP BY m.tree")
def total_branch_length(g):
    return r9(lt.total_branch_length(g), "total_branch_length")


@query(_TREES + "SELECT m.tree, count(*) AS num_lineages FROM mem m JOIN le ON le.tree = m.tree AND le.child = m.node WHERE ct <= 1.1e0 AND ct + len > 1.1e0 GROUP BY m.tree")
def num_lineages(g):
    return lt.num_lineages(g, 1.1)


@query(_TREES + "SELECT tree, child AS node, parent, edge, round(len, 8) AS branch_length, count(*) OVER (PARTITION BY tree, parent) - 1 AS num_siblings FROM le")
def tree_parents(g):
    return r9(lt.parents(g), "branch_length")


@query(_TREES + "SELECT tree, parent AS node, array_to_string(list(child ORDER BY child), ',') AS children, count(*) AS num_children FROM le GROUP BY tree, parent")
def tree_children(g):
    return lt.children(g).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query(_TREES + "SELECT tree, node, CAST(depth AS BIGINT) AS depth FROM lf")
def tree_leaves(g):
    return lt.leaves(g)


@query(_TREES + """,
nk AS (SELECT tree, parent, count(*) AS k FROM le GROUP BY ALL),
up AS (SELECT pt.tree, pt.start, pt.node, pt.depth FROM pt JOIN lf ON lf.tree = pt.tree AND lf.node = pt.start WHERE pt.depth > 0),
h AS (SELECT tree, node, max(depth) AS h FROM up GROUP BY ALL)
SELECT t.tree, (SELECT count(*) FROM up WHERE up.tree = t.tree) AS sackin,
  round((SELECT sum(1e0 / h) FROM h ANTI JOIN rt ON rt.tree = h.tree AND rt.node = h.node WHERE h.tree = t.tree), 8) AS b1,
  round((SELECT sum(-p * log10(p)) FROM (SELECT up.tree, up.start, product(1e0 / k) AS p FROM up JOIN nk ON nk.tree = up.tree AND nk.parent = up.node GROUP BY ALL) q WHERE q.tree = t.tree), 8) AS b2 FROM tr t""")
def shape_indexes(g):
    return r9(lt.shape_indexes(g).drop("colless"), "b1", "b2")


@query(_TREES + """,
cl AS (SELECT DISTINCT tree, c FROM (SELECT tree, node, string_agg(start, ',' ORDER BY start) AS c FROM pt JOIN samp ON samp.id = pt.start GROUP BY ALL) q),
nx AS (SELECT tree - 1 AS tree, c FROM cl)
SELECT t.tree, CAST((SELECT count(*) FROM (SELECT c FROM cl WHERE cl.tree = t.tree EXCEPT SELECT c FROM nx WHERE nx.tree = t.tree) a) + (SELECT count(*) FROM (SELECT c FROM nx WHERE nx.tree = t.tree EXCEPT SELECT c FROM cl WHERE cl.tree = t.tree) b) AS BIGINT) AS rf
FROM tr t WHERE t.tree < (SELECT max(tree) FROM tr)""")
def rf_neighbours(g):
    return lt.rf_neighbours(g)


def _neighbours_of(g) -> DataFrame:
    """Each sample with the next one by id (ids of samples are whole numbers from 0)."""
    return g.samples().select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(g.samples().select(F.col("id").alias("b")), "b")


@query(_TREES + """,
m AS (SELECT x.tree, x.start AS a, y.start AS b, arg_min(x.node, x.depth) AS mrca, min(x.depth + y.depth) AS path_length FROM pt x JOIN pt y ON y.tree = x.tree AND y.node = x.node AND y.start = x.start + 1
  JOIN samp sx ON sx.id = x.start JOIN samp sy ON sy.id = y.start GROUP BY ALL)
SELECT m.tree, a, b, CAST(path_length AS BIGINT) AS path_length, round(2 * n."time", 8) AS distance FROM m JOIN g_nodes n ON n.id = m.mrca""")
def neighbour_distances(g):
    return r9(lt.distances(g, _neighbours_of(g)), "distance")


@query("""
SELECT x.start AS a, y.start AS b, greatest(x.l, y.l) AS "left", least(x.r, y.r) AS "right", x.node AS mrca, round(n."time", 8) AS tmrca
FROM anc x JOIN anc y ON y.node = x.node AND y.start = x.start + 1 AND x.l < y.r AND y.l < x.r JOIN samp sx ON sx.id = x.start JOIN samp sy ON sy.id = y.start JOIN g_nodes n ON n.id = x.node
WHERE NOT EXISTS (SELECT 1 FROM anc p JOIN anc q ON q.node = p.node AND p.l < q.r AND q.l < p.r WHERE p.start = x.start AND q.start = y.start AND p.depth < x.depth AND q.depth < y.depth
  AND greatest(p.l, q.l) <= greatest(x.l, y.l) AND least(p.r, q.r) >= least(x.r, y.r))""")
def neighbour_ancestors(g):
    return r9(lt.common_ancestors(g, _neighbours_of(g)), "tmrca")


# --- genotypes -------------------------------------------------------------------------------------------------------------
@query(_GENO + """,
m AS (SELECT site, derived_state AS allele, min(id) AS fst FROM g_mutations GROUP BY ALL),
al AS (SELECT s.id AS site, s.ancestral_state AS allele, -1 AS fst FROM g_sites s UNION ALL SELECT m.site, m.allele, m.fst FROM m JOIN g_sites s ON s.id = m.site WHERE m.allele <> s.ancestral_state),
n AS (SELECT site, allele, sum(x) AS x FROM ac GROUP BY ALL)
SELECT al.site, string_agg(al.allele, ',' ORDER BY fst) AS alleles, string_agg(CAST(coalesce(x, 0) AS BIGINT), ',' ORDER BY fst) AS counts, CAST(0 AS BIGINT) AS num_missing FROM al LEFT JOIN n ON n.site = al.site AND n.allele = al.allele GROUP BY al.site""")
def variant_summary(g):
    v = ge.variant_summary(g)
    return v.select("site", F.array_join("alleles", ",").alias("alleles"), F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), "num_missing")


@query(_GENO + """
SELECT sa.id AS sample, string_agg(coalesce(h.allele, s.ancestral_state), '' ORDER BY s."position") AS haplotype FROM samp sa CROSS JOIN g_sites s LEFT JOIN hit h ON h.site = s.id AND h.sample = sa.id GROUP BY sa.id""")
def haplotypes(g):
    return ge.haplotypes(g)


@query("""SELECT m.id, coalesce(e.id, -1) AS edge FROM g_mutations m JOIN g_sites s ON s.id = m.site LEFT JOIN g_edges e ON e.child = m.node AND e."left" <= s."position" AND s."position" < e."right" """)
def mutation_edges(g):
    return ge.mutation_edges(g)


_MPARENT = """,
mp AS (SELECT m.id, arg_max(o.id, (-a.depth, o.id)) AS parent FROM g_mutations m JOIN g_sites s ON s.id = m.site JOIN anc a ON a.start = m.node AND a.l <= s."position" AND s."position" < a.r JOIN g_mutations o ON o.site = m.site AND o.node = a.node AND (a.depth > 0 OR o.id < m.id) GROUP BY m.id)
"""


@query(_MPARENT + "SELECT m.id, coalesce(mp.parent, -1) AS parent FROM g_mutations m LEFT JOIN mp ON mp.id = m.id")
def mutation_parents(g):
    return an.mutation_parents(g)


@query(_MPARENT + "SELECT m.id, coalesce(p.derived_state, s.ancestral_state) AS inherited_state FROM g_mutations m JOIN g_sites s ON s.id = m.site LEFT JOIN mp ON mp.id = m.id LEFT JOIN g_mutations p ON p.id = mp.parent")
def mutation_inherited_states(g):
    return an.inherited_states(g).select("id", "inherited_state")


@query("""SELECT m.id, round(CASE WHEN e.id IS NULL THEN c."time" ELSE p."time" - (p."time" - c."time") * row_number() OVER (PARTITION BY m.site, m.node ORDER BY m.id) / (count(*) OVER (PARTITION BY m.site, m.node) + 1) END, 8) AS "time"
FROM g_mutations m JOIN g_sites s ON s.id = m.site JOIN g_nodes c ON c.id = m.node LEFT JOIN g_edges e ON e.child = m.node AND e."left" <= s."position" AND s."position" < e."right" LEFT JOIN g_nodes p ON p.id = e.parent""")
def mutation_times(g):
    return r9(ge.mutation_times(g), "time")


# --- statistics derived from counts ----------------------------------------------------------------------------------------
@query(_GENO + """,
a AS (SELECT w.w, ac.pop, sum(x * (n - x)) / any_value(n * (n - 1)) AS t, sum(CASE WHEN x > 0 THEN 1 - x / n ELSE 0 END) AS s, any_value(n) AS n FROM ac JOIN nn ON nn.pop = ac.pop JOIN win w ON wl <= pos AND pos < wr GROUP BY ALL),
h AS (SELECT pop, n, (SELECT sum(1e0 / i) FROM range(1, CAST(n AS BIGINT)) r(i)) AS h, (SELECT sum(1e0 / (i * i)) FROM range(1, CAST(n AS BIGINT)) r(i)) AS q FROM nn),
c AS (SELECT pop, h, q, (n + 1) / (3 * (n - 1) * h) - 1 / (h * h) AS a1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (h * n) + q / (h * h) AS b1 FROM h)
SELECT CAST(w AS BIGINT) AS "window", CAST(a.pop AS BIGINT) AS population, round((t - s / h) / sqrt(a1 * s + b1 / (h * h + q) * s * (s - 1)), 6) AS d FROM a JOIN c ON c.pop = a.pop""")
def tajimas_d(g):
    d = st.tajimas_d(g, pops(g), WINDOWS)
    return d.select("window", F.col("index").cast("long").alias("population"), F.round("value", 6).alias("d"))


def _fst_sql() -> str:
    d = {(i, j): f"sum({_F['divergence'].format(i, j, same=int(i == j))})" for i, j in ((0, 0), (1, 1), (0, 1), (2, 2), (2, 3), (3, 3))}
    parts = [f"""SELECT CAST(w AS BIGINT) AS "window", '{i},{j}' AS "index", round(1 - 2 * ({d[i, i]} + {d[j, j]}) / ({d[i, i]} + 2 * {d[i, j]} + {d[j, j]}), 8) AS value FROM wide, wn, win WHERE wl <= pos AND pos < wr GROUP BY w""" for i, j in ((0, 1), (2, 3))]
    return _GENO + f", wide AS (SELECT site, pos, allele, {_WIDE} FROM ac a GROUP BY ALL), {_WN}\n" + "\nUNION ALL ".join(parts)


@query(_fst_sql())
def fst(g):
    return r9(st.fst(g, pops(g), [(0, 1), (2, 3)], WINDOWS).select("window", "index", "value"), "value")


@query(_GENO + """,
al AS (SELECT site, pos, allele, anc_, sum(x) AS x FROM ac GROUP BY ALL), tot AS (SELECT sum(n) AS n FROM nn)
SELECT CAST(w AS BIGINT) AS "window", CAST(least(x, n - x) AS BIGINT) AS bin, round(sum(0.5e0) / any_value(wr - wl), 8) AS value FROM al, tot, win WHERE x > 0 AND x < n AND wl <= pos AND pos < wr GROUP BY ALL""")
def frequency_spectrum(g):
    s = st.frequency_spectrum(g, st.Sets.all(g), WINDOWS)
    return r9(s.select("window", F.element_at("bins", 1).alias("bin"), "value"), "value")


@query(_CNT + """,
al AS (SELECT b.tree, b.l, b.r, b.node, len, sum(x) AS x FROM br b JOIN cnt c ON c.tree = b.tree AND c.node = b.node GROUP BY ALL), tot AS (SELECT sum(n) AS n FROM nn)
SELECT CAST(w AS BIGINT) AS "window", CAST(x AS BIGINT) AS bin, round(sum((least(r, wr) - greatest(l, wl)) * len) / any_value(wr - wl), 8) AS value FROM al, tot, win WHERE x > 0 AND x < n AND l < wr AND wl < r GROUP BY w, x""")
def branch_spectrum_polarised(g):
    s = st.frequency_spectrum(g, st.Sets.all(g), WINDOWS, "branch", polarised=True)
    return r9(s.select("window", F.element_at("bins", 1).alias("bin"), "value"), "value")


@query(_CNT + """, sp AS (SELECT tree, node, any_value(r - l) AS span FROM cnt GROUP BY ALL),
tot AS (SELECT node, sum(span) AS s FROM sp GROUP BY node)
SELECT g.id AS node, CAST(nn.pop AS BIGINT) AS "set", round(coalesce((SELECT sum((r - l) * x) FROM cnt WHERE cnt.node = g.id AND cnt.pop = nn.pop) / t.s, 0), 8) AS value FROM g_nodes g CROSS JOIN nn LEFT JOIN tot t ON t.node = g.id""")
def mean_descendants(g):
    return r9(st.mean_descendants(g, pops(g)), "value")


@query(_CNT + """,
n1 AS (SELECT a.start AS focal, t.tree, t.l, t.r, a.depth, a.node, s.population AS own FROM anc a JOIN samp s ON s.id = a.start JOIN tr t ON a.l < t.r AND t.l < a.r WHERE a.depth > 0),
wide AS (SELECT tree, node, """ + ", ".join(f"sum(CASE WHEN pop = {p} THEN x ELSE 0 END) AS x{p}" for p in POPULATIONS) + """ FROM cnt GROUP BY ALL),
low AS (SELECT focal, tree, any_value(l) AS l, any_value(r) AS r, arg_min(w, depth) AS w, any_value(own) AS own FROM (SELECT n1.*, wide AS w FROM n1 JOIN wide ON wide.tree = n1.tree AND wide.node = n1.node
  WHERE x0 + x1 + x2 + x3 + x4 > 1) q GROUP BY ALL)
""" + "\nUNION ALL ".join(f"""SELECT focal, CAST({p} AS BIGINT) AS "set", round(sum((r - l) * (w.x{p} - CASE WHEN own = {p} THEN 1 ELSE 0 END) / (w.x0 + w.x1 + w.x2 + w.x3 + w.x4 - 1)) / sum(r - l), 8) AS value FROM low GROUP BY focal""" for p in POPULATIONS))
def nearest_neighbours(g):
    return r9(st.nearest_neighbours(g, g.samples(), pops(g)), "value")


@query(_CNT + """,
xx AS (SELECT tree, l, r, node, sum(x) AS x FROM cnt GROUP BY ALL),
co AS (SELECT xx.tree, xx.l, xx.r, xx.node, (x * x - coalesce((SELECT sum(c.x * c.x) FROM br b JOIN xx c ON c.tree = b.tree AND c.node = b.node JOIN g_edges e ON e.child = b.node AND e.parent = xx.node AND e."left" < xx.r AND xx.l < e."right" WHERE b.tree = xx.tree), 0)
   - CASE WHEN xx.node IN (SELECT id FROM samp) THEN 1 ELSE 0 END) / 2 AS p FROM xx)
SELECT CAST(w AS BIGINT) AS "window", node, '0,0' AS "index", round(sum((least(r, wr) - greatest(l, wl)) * p) / any_value(wr - wl), 6) AS value FROM co, win WHERE l < wr AND wl < r GROUP BY w, node HAVING sum((least(r, wr) - greatest(l, wl)) * p) > 1e-9""")
def coalescence_counts(g):
    return co.coalescence_counts(g, st.Sets.all(g), [(0, 0)], WINDOWS).withColumn("value", F.round("value", 6))


@query(_GENO + """,
nx AS (SELECT id AS sa, lead(id) OVER (ORDER BY "position") AS sb FROM g_sites QUALIFY lead(id) OVER (ORDER BY "position") IS NOT NULL),
dense AS (SELECT s.id AS site, sa.id AS sample, coalesce(h.allele, s.ancestral_state) AS allele FROM g_sites s CROSS JOIN samp sa LEFT JOIN hit h ON h.site = s.id AND h.sample = sa.id),
al AS (SELECT DISTINCT site, derived_state AS allele FROM g_mutations UNION SELECT id, ancestral_state FROM g_sites),
seen AS (SELECT site, allele, count(*)::DOUBLE AS k FROM dense GROUP BY ALL),
one AS (SELECT al.site, al.allele, coalesce(k, 0) AS k FROM al LEFT JOIN seen ON seen.site = al.site AND seen.allele = al.allele),
two AS (SELECT sa, sb, x.allele AS a, y.allele AS b, count(*)::DOUBLE AS k FROM nx JOIN dense x ON x.site = sa JOIN dense y ON y.site = sb AND y.sample = x.sample GROUP BY ALL),
tot AS (SELECT count(*)::DOUBLE AS n FROM samp),
r AS (SELECT nx.sa, nx.sb, pa.k AS na, pb.k AS nb, coalesce(t.k, 0) AS nab, n, nab / n - pa.k / n * pb.k / n AS d, pa.k / n * (1 - pa.k / n) * pb.k / n * (1 - pb.k / n) AS u
  FROM nx JOIN one pa ON pa.site = nx.sa JOIN one pb ON pb.site = nx.sb LEFT JOIN two t ON t.sa = nx.sa AND t.sb = nx.sb AND t.a = pa.allele AND t.b = pb.allele, tot)
SELECT sa AS site_a, sb AS site_b, CASE WHEN NOT bool_or(u = 0) THEN round(sum(d * d / CASE WHEN u = 0 THEN 1 ELSE u END * nab / n), 8) END AS r2 FROM r GROUP BY ALL""")
def neighbour_r2(g):
    return r9(ld.two_locus(g, ld.neighbours(g)), "r2")


# --- transformations -------------------------------------------------------------------------------------------------------
@query("""SELECT parent, child, greatest("left", a) AS "left", least("right", b) AS "right" FROM g_edges, (VALUES (1e0, 2.5e0), (6e0, 9e0)) v(a, b) WHERE "left" < b AND a < "right" """)
def keep_intervals_edges(g):
    return tr.keep_intervals(g, [(1.0, 2.5), (6.0, 9.0)]).edges.select("parent", "child", "left", "right")


@query("""SELECT e.parent, e.child, e."left", e."right" FROM g_edges e JOIN g_nodes p ON p.id = e.parent WHERE p."time" <= 1.5e0""")
def delete_older_edges(g):
    return tr.delete_older(g, 1.5).edges.select("parent", "child", "left", "right")


@query("""SELECT row_number() OVER (ORDER BY p."time", e.parent, e.child, e."left") - 1 AS id, e.parent, e.child, e."left", e."right" FROM g_edges e JOIN g_nodes p ON p.id = e.parent""")
def sorted_edges(g):
    return tr.sort(g).edges.select("id", "parent", "child", "left", "right")


@query("""SELECT parent, child, min("left") AS "left", max("right") AS "right" FROM (SELECT *, sum(CASE WHEN prev = "left" THEN 0 ELSE 1 END) OVER (PARTITION BY parent, child ORDER BY "left") AS k FROM
  (SELECT *, lag("right") OVER (PARTITION BY parent, child ORDER BY "left") AS prev FROM g_edges) q) q GROUP BY parent, child, k""")
def squashed_edges(g):
    return tr.squash(g.edges).select("parent", "child", "left", "right")


@query(_W + """,
s0 AS (SELECT id FROM samp WHERE population = 0),
sc AS (SELECT t.tree, t.l, t.r, a.node, count(*) AS x FROM anc a JOIN s0 ON s0.id = a.start JOIN tr t ON a.l < t.r AND t.l < a.r GROUP BY ALL),
kids AS (SELECT c.tree, c.l, c.r, e.parent, e.child, c.x FROM sc c JOIN g_edges e ON e.child = c.node AND e."left" < c.r AND c.l < e."right"),
keep AS (SELECT tree, parent AS node FROM kids GROUP BY ALL HAVING count(*) >= 2 UNION SELECT DISTINCT tree, node FROM sc WHERE node IN (SELECT id FROM s0)),
up AS (SELECT k.tree, k.node AS child, arg_min(a.node, a.depth) AS parent FROM keep k JOIN tr t ON t.tree = k.tree JOIN anc a ON a.start = k.node AND a.depth > 0 AND a.l < t.r AND t.l < a.r JOIN keep p ON p.tree = k.tree AND p.node = a.node GROUP BY ALL)
SELECT parent, child, sum(r - l) AS span FROM up JOIN tr t ON t.tree = up.tree GROUP BY ALL""")
def simplified_to_population(g):
    keep = g.samples(population=0).withColumn("order", F.col("id"))
    s, to = tr.simplify(g, keep)
    m = to.select(F.col("new"), F.col("old"))
    e = s.edges.join(m.toDF("parent", "_p"), "parent").join(m.toDF("child", "_c"), "child")
    return e.groupBy(F.col("_p").alias("parent"), F.col("_c").alias("child")).agg(F.sum(F.col("right") - F.col("left")).alias("span"))


@query("""SELECT 'edges' AS table_name, count(*) AS n FROM g_edges UNION ALL SELECT 'nodes', count(*) FROM g_nodes UNION ALL SELECT 'sites', count(*) FROM g_sites UNION ALL SELECT 'mutations', count(*) FROM g_mutations UNION ALL SELECT 'trees', count(*) FROM tr""")
def table_counts(g):
    t = [("edges", g.edges), ("nodes", g.nodes), ("sites", g.sites), ("mutations", g.mutations), ("trees", an.trees(g))]
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in t]
    from functools import reduce

    return reduce(DataFrame.unionByName, out)


# --- tables ----------------------------------------------------------------------------------------------------------------
from kinweave.operators import tables as tb  # noqa: E402


@query("""SELECT position, direction, edge, row_number() OVER (PARTITION BY position, direction ORDER BY a, b, c, edge) - 1 AS place FROM (
  SELECT e."right" AS position, 'out' AS direction, e.id AS edge, -p."time" AS a, -e.parent AS b, -e.child AS c FROM g_edges e JOIN g_nodes p ON p.id = e.parent WHERE e."right" < 10
  UNION ALL SELECT e."left", 'in', e.id, p."time", e.parent, e.child FROM g_edges e JOIN g_nodes p ON p.id = e.parent) q""")
def edge_diffs(g):
    return tb.edge_diffs(g)


@query("""SELECT id AS edge, parent, child FROM g_edges WHERE "left" <= 4.5 AND "right" > 4.5""")
def tree_at_position(g):
    return tb.tree_at(g, 4.5).select(F.col("id").alias("edge"), "parent", "child")


@query("""SELECT individual, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS nodes, min("time") AS "time" FROM g_nodes WHERE individual <> -1 GROUP BY individual""")
def individual_nodes(g):
    n = tb.individual_nodes(g.with_tables(nodes=g.nodes.withColumn("population", F.lit(-1))))  # individuals of the bridge span populations, which the operator refuses
    return n.select("individual", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "time")


@query("""SELECT "left", "right", parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM g_edges GROUP BY ALL""")
def edgesets(g):
    return tb.edgesets(g).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("""SELECT min("time") AS min_time, max("time") AS max_time FROM g_nodes""")
def extreme_times(g):
    return tb.extremes(g).select("min_time", "max_time")


@query("""SELECT row_number() OVER (ORDER BY id) - 1 AS id, "time", population FROM g_nodes WHERE population = 2""")
def kept_nodes(g):
    k, _ = tb.keep_rows(g, "nodes", F.col("population") == 2)
    return k.nodes.select("id", "time", "population")


# --- weighted statistics ---------------------------------------------------------------------------------------------------
_TRAIT = """,
tw AS (SELECT id, (id % 7)::DOUBLE AS w FROM samp), mo AS (SELECT count(*)::DOUBLE AS n, avg(w) AS m, stddev_samp(w) AS sd FROM tw),
b AS (SELECT t.l, t.r, e.child AS node, p."time" - c."time" AS len, sum(tw.w) AS s, count(*)::DOUBLE AS x FROM tr t JOIN g_edges e ON e."left" < t.r AND t.l < e."right" JOIN g_nodes p ON p.id = e.parent JOIN g_nodes c ON c.id = e.child
  JOIN anc a ON a.node = e.child AND a.l < t.r AND t.l < a.r JOIN tw ON tw.id = a.start GROUP BY ALL)"""


def _trait(g) -> DataFrame:
    return g.samples().select(F.col("id").alias("sample"), (F.col("id") % 7).cast("double").alias("w"))


@query(_TRAIT + "SELECT round(sum((r - l) * len * 2 * (s - m * x) * (s - m * x) / (2 * (n - 1) * (n - 1))) / 10, 8) AS value FROM b, mo")
def branch_trait_covariance(g):
    return r9(st.trait_covariance(g, _trait(g), ["w"], "mod7", None, "branch").select("value"), "value")


@query(_TRAIT + "SELECT round(sum((r - l) * len * 2 * CASE WHEN x < n THEN power((s - m * x) / sd, 2) / (2 * x * (1 - x / n) * (n - 1)) ELSE 0 END) / 10, 8) AS value FROM b, mo")
def branch_trait_correlation(g):
    return r9(st.trait_correlation(g, _trait(g), ["w"], "mod7", None, "branch").select("value"), "value")


@query(_TRAIT + "SELECT round(sum((r - l) * len * 2 * power(s - m * n * x / n, 2)) / 10, 6) AS value FROM b, mo")
def branch_relatedness_weighted(g):
    return st.relatedness_weighted(g, _trait(g), ["w"], [(0, 0)], "mod7", None, "branch").select(F.round("value", 6).alias("value"))


def _related_sql() -> str:
    m = "(" + " + ".join(f"x{p} / n{p}" for p in POPULATIONS) + ") / 5"
    parts = [f"""SELECT '{i},{j}' AS "index", round(sum(CASE WHEN NOT anc_ THEN (x{i} / n{i} - {m}) * (x{j} / n{j} - {m}) ELSE 0 END) / 10, 8) AS value FROM wide, wn""" for i, j in ((0, 0), (0, 1), (3, 4))]
    return _GENO + f", wide AS (SELECT site, pos, allele, anc_, {_WIDE} FROM ac a GROUP BY ALL), {_WN}\n" + "\nUNION ALL ".join(parts)


@query(_related_sql())
def site_relatedness(g):
    return r9(st.genetic_relatedness(g, pops(g), [(0, 0), (0, 1), (3, 4)], None, "site", True, True, False).select("index", "value"), "value")


def _divmat_sql() -> str:
    parts = []
    for i in POPULATIONS:
        for j in POPULATIONS:
            f = _F["divergence"].format(i, j, same=int(i == j))
            back = f"(n{i} - x{i}) * x{j} / (n{i} * (n{j} - {int(i == j)}))"
            parts.append(f"""SELECT '{i},{j}' AS "index", round(sum((r - l) * len * ({f} + {back})) / 10, 8) AS value FROM wide, wn""")
    return _CNT + f", wide AS (SELECT b.tree, b.l, b.r, b.node, len, {_WIDE} FROM br b LEFT JOIN cnt a ON a.tree = b.tree AND a.node = b.node GROUP BY ALL), {_WN}\n" + "\nUNION ALL ".join(parts)


@query(_divmat_sql())
def branch_divergence_matrix(g):
    return r9(st.divergence_matrix(g, pops(g), None, "branch").select("index", "value"), "value")


@query(_CNT + """,
xx AS (SELECT tree, l, r, node, sum(x) AS x FROM cnt GROUP BY ALL),
co AS (SELECT xx.node, sum((xx.r - xx.l) * (x * x - coalesce((SELECT sum(c.x * c.x) FROM g_edges e JOIN xx c ON c.tree = xx.tree AND c.node = e.child WHERE e.parent = xx.node AND e."left" < xx.r AND xx.l < e."right"), 0)
   - CASE WHEN xx.node IN (SELECT id FROM samp) THEN 1 ELSE 0 END) / 2) AS p FROM xx GROUP BY xx.node),
byt AS (SELECT n."time" AS t, sum(p) AS p FROM co JOIN g_nodes n ON n.id = co.node GROUP BY n."time"),
cum AS (SELECT t, sum(p) OVER (ORDER BY t) / sum(p) OVER () AS c FROM byt)
SELECT q, (SELECT min(t) FROM cum WHERE c >= q - 1e-12) AS "time" FROM (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS q) u""")
def coalescence_quantiles(g):
    return co.coalescence_quantiles(g, st.Sets.all(g), [(0, 0)], [0.1, 0.5, 0.9]).select("q", "time")
