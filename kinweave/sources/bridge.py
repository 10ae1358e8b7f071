"""A genealogy laid over the star-schema tables, whole: customers are samples below nations, regions and a grand root; parts are sites; line items are mutations.

Interior breakpoints lie at 1 .. 9 of a sequence of length 10: every customer changes nation at ``1 + c_custkey % 9`` and every nation changes
region at 5. Ids of nations, regions and the root follow those of customers at a fixed distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.model import SCHEMAS, Genealogy, Later
from kinweave.plans.staging import load, unsent
from kinweave.plans.staging import measured as stage

L = 10.0
NATION, REGION, ROOT = 1_000_000_000, 1_000_000_100, 1_000_000_200

#: SQL that both engines read; {q} is the quote of an identifier.
_NODES = f"""
SELECT CAST(c_custkey AS BIGINT) id, CAST(1 AS BIGINT) flags, 0e0 AS {{q}}time{{q}}, CAST(n_regionkey AS BIGINT) population, CAST(floor(c_custkey / 2) AS BIGINT) individual
  FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT CAST({NATION} + n_nationkey AS BIGINT), CAST(0 AS BIGINT), 1 + n_nationkey / 100e0, CAST(n_regionkey AS BIGINT), CAST(-1 AS BIGINT) FROM nation
UNION ALL SELECT CAST({REGION} + r_regionkey AS BIGINT), CAST(0 AS BIGINT), 2 + r_regionkey / 10e0, CAST(r_regionkey AS BIGINT), CAST(-1 AS BIGINT) FROM region
UNION ALL SELECT CAST({ROOT} AS BIGINT), CAST(0 AS BIGINT), 3e0, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)"""
_EDGES = f"""
SELECT CAST(4 * c_custkey AS BIGINT) id, 0e0 AS {{q}}left{{q}}, 1e0 + c_custkey % 9 AS {{q}}right{{q}}, CAST({NATION} + c_nationkey AS BIGINT) parent, CAST(c_custkey AS BIGINT) child FROM customer
UNION ALL SELECT CAST(4 * c_custkey + 1 AS BIGINT), 1e0 + c_custkey % 9, {L:g}e0, CAST({NATION} + (c_nationkey + 1 + c_custkey % 7) % 25 AS BIGINT), CAST(c_custkey AS BIGINT) FROM customer
UNION ALL SELECT CAST(4 * n_nationkey + 2 AS BIGINT), 0e0, 5e0, CAST({REGION} + n_regionkey AS BIGINT), CAST({NATION} + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT CAST(4 * n_nationkey + 3 AS BIGINT), 5e0, {L:g}e0, CAST({REGION} + (n_regionkey + 1) % 5 AS BIGINT), CAST({NATION} + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT CAST(-1 - r_regionkey AS BIGINT), 0e0, {L:g}e0, CAST({ROOT} AS BIGINT), CAST({REGION} + r_regionkey AS BIGINT) FROM region"""
_SITES = f"""
SELECT CAST(p_partkey AS BIGINT) id, p_partkey * {L:g}e0 / (SELECT count(*) FROM part) AS {{q}}position{{q}}, substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) ancestral_state FROM part"""
_MUTATIONS = f"""
SELECT CAST(site * 1048576 + row_number() OVER (PARTITION BY site ORDER BY older DESC, node) AS BIGINT) id, site, node, derived_state FROM (
  SELECT site, node, older, min(state) derived_state FROM (
    SELECT CAST(l_partkey AS BIGINT) site,
      CAST(CASE l_linenumber % 3 WHEN 0 THEN o_custkey WHEN 1 THEN {NATION} + s_nationkey ELSE {REGION} + s_suppkey % 5 END AS BIGINT) node,
      CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END older,
      substr('ACGT', CAST((p_size + 1 + l_linenumber % 3) % 4 + 1 AS INT), 1) state
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey) q
  GROUP BY site, node, older) m"""

#: The same four tables and their ancestry as DuckDB expressions, for the SQL that checks queries.
DUCK = (
    f"g_nodes AS ({_NODES.format(q=chr(34))}),\ng_edges AS ({_EDGES.format(q=chr(34))}),\ng_sites AS ({_SITES.format(q=chr(34))}),\ng_mutations AS ({_MUTATIONS.format(q=chr(34))}),\n"
    f"""anc(start, node, l, r, depth) AS (
  SELECT id, id, 0e0, {L:g}e0, 0 FROM g_nodes
  UNION ALL SELECT a.start, e.parent, greatest(a.l, e."left"), least(a.r, e."right"), a.depth + 1 FROM anc a JOIN g_edges e ON e.child = a.node AND e."left" < a.r AND a.l < e."right"),
bp AS (SELECT DISTINCT p FROM (SELECT "left" p FROM g_edges UNION ALL SELECT "right" FROM g_edges UNION ALL SELECT 0e0 UNION ALL SELECT {L:g}e0) q),
tr AS (SELECT row_number() OVER (ORDER BY p) - 1 AS tree, p AS l, lead(p) OVER (ORDER BY p) AS r FROM bp QUALIFY lead(p) OVER (ORDER BY p) IS NOT NULL),
samp AS (SELECT id, population FROM g_nodes WHERE flags = 1)"""
)

_memo: dict[tuple, Genealogy] = {}
_TABLES = ("customer", "nation", "region", "part", "lineitem", "orders", "supplier")


def _state(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables were last changed, and their bytes."""
    conf, out = spark._jsparkSession.sessionState().newHadoopConf(), []
    for t in _TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(conf)
        out += [fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()]
    return tuple(out)


def bridge(spark: SparkSession, sf_dir: str) -> Genealogy:
    """The genealogy of a data directory, built once a session for each state of its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key in _memo:
        return _memo[key]
    tables = {t: load(spark, sf_dir, t) for t in _TABLES}
    tables |= {t: unsent(d, d.count()) for t, d in tables.items()}  # counts over Parquet footers

    def sql(text: str) -> DataFrame:
        names = {t: f"{{{t}}}" for t in tables}
        for t in names:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(text, **{t: d for t, d in tables.items() if f"{{{t}}}" in text})

    empty = {t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}
    blank = "CAST(NULL AS BINARY) metadata"
    nodes = Later(lambda: stage(sql(f"SELECT *, {blank} FROM ({_NODES.format(q='`')}) n"), "nodes"))
    edges = Later(lambda: stage(sql(f"SELECT *, {blank} FROM ({_EDGES.format(q='`')}) e"), "edges"))
    sites = Later(lambda: stage(sql(f"SELECT *, {blank} FROM ({_SITES.format(q='`')}) s"), "sites"))
    muts = Later(lambda: stage(sql(f"SELECT id, site, node, CAST(-1 AS BIGINT) parent, CAST(NULL AS DOUBLE) time, derived_state, {blank} FROM ({_MUTATIONS.format(q='`')}) m"), "mutations"))
    individuals = Later(lambda: nodes().where("individual <> -1").selectExpr("individual id", "CAST(0 AS BIGINT) flags", "CAST(array() AS ARRAY<DOUBLE>) location", "CAST(array() AS ARRAY<BIGINT>) parents", blank).distinct())
    populations = tables["region"].selectExpr("CAST(r_regionkey AS BIGINT) id", "encode(r_name, 'UTF-8') metadata")
    g = Genealogy(nodes=nodes, edges=edges, sites=sites, mutations=muts, individuals=individuals, populations=populations, migrations=empty["migrations"], provenances=empty["provenances"], sequence_length=L)
    _memo[key] = g
    return g
