"""A genealogy from the nodes, edges and migrations tables, whole: many roots, isolated samples, unary nodes, dead branches, stretches without edges, stacked mutations, missing genotypes.

Nodes are those of known time, each once; edges the usable ones, each once, between such nodes with the parent the older, cut where the next edge of their child begins. Every left end of
a migration is a site, every migration of a node a mutation of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.model import SCHEMAS, Genealogy
from kinweave.plans.staging import load
from kinweave.plans.staging import measured as stage

L = 8e6

#: SQL that both engines read; {q} is the quote of an identifier.
_NODES = """SELECT id, max(flags) AS flags, max({q}time{q}) AS {q}time{q}, coalesce(max(population), -1) AS population FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at) AS k FROM nodes) q WHERE k = 1 AND {q}time{q} IS NOT NULL AND NOT isnan({q}time{q}) GROUP BY id"""
_EDGES = """SELECT id, l AS {q}left{q}, r AS {q}right{q}, parent, child FROM (
  SELECT u.id, u.parent, u.child, u.l, least(u.r, coalesce(lead(u.l) OVER (PARTITION BY u.child ORDER BY u.l, u.id), u.r)) AS r FROM (
    SELECT DISTINCT id, {q}left{q} AS l, {q}right{q} AS r, parent, child FROM edges
    WHERE {q}left{q} IS NOT NULL AND {q}right{q} IS NOT NULL AND parent IS NOT NULL AND parent <> -1 AND {q}right{q} > {q}left{q}) u
  JOIN ir_nodes p ON p.id = u.parent JOIN ir_nodes c ON c.id = u.child WHERE p.{q}time{q} > c.{q}time{q}) q WHERE r > l"""
_MOVES = """SELECT DISTINCT m.id, m.{q}left{q} AS l, m.node, n.{q}time{q} AS t FROM migrations m JOIN ir_nodes n ON n.id = m.node WHERE m.{q}left{q} IS NOT NULL AND m.{q}left{q} >= 0 AND m.{q}left{q} < 8000000"""
_SITES = """SELECT CAST(l AS BIGINT) AS id, l AS {q}position{q}, 'A' AS ancestral_state FROM (SELECT DISTINCT l FROM ir_moves) q"""
_MUTATIONS = """SELECT CAST(l AS BIGINT) * 1024 + row_number() OVER (PARTITION BY l ORDER BY t DESC, id) AS id, CAST(l AS BIGINT) AS site, node, substr('ACGT', CAST(id % 4 + 1 AS INT), 1) AS derived_state FROM ir_moves"""

#: The same tables, and the ways of samples to their ancestors, as DuckDB expressions.
DUCK = (
    f"ir_nodes AS MATERIALIZED ({_NODES.format(q=chr(34))}),\nir_edges AS MATERIALIZED ({_EDGES.format(q=chr(34))}),\nir_moves AS MATERIALIZED ({_MOVES.format(q=chr(34))}),\n"
    f"ir_sites AS ({_SITES.format(q=chr(34))}),\nir_mutations AS ({_MUTATIONS.format(q=chr(34))}),\n"
    f"""samp AS (SELECT id FROM ir_nodes WHERE flags & 1 = 1),
anc(start, node, l, r, depth) AS (SELECT id, id, 0e0, 8e6, 0 FROM samp
  UNION ALL SELECT a.start, e.parent, greatest(a.l, e."left"), least(a.r, e."right"), a.depth + 1 FROM anc a JOIN ir_edges e ON e.child = a.node AND e."left" < a.r AND a.l < e."right"),
ev AS (SELECT node, p, sum(d) AS d FROM (SELECT node, l AS p, 1 AS d FROM anc UNION ALL SELECT node, r, -1 FROM anc) q GROUP BY node, p HAVING sum(d) <> 0),
cnt AS (SELECT * FROM (SELECT node, p AS l, lead(p) OVER (PARTITION BY node ORDER BY p) AS r, CAST(sum(d) OVER (PARTITION BY node ORDER BY p) AS DOUBLE) AS x FROM ev) q WHERE x > 0),
br AS (SELECT e.parent, e.child AS node, greatest(c.l, e."left") AS l, least(c.r, e."right") AS r, x, p."time" - n."time" AS len FROM ir_edges e JOIN cnt c ON c.node = e.child AND c.l < e."right" AND e."left" < c.r
  JOIN ir_nodes p ON p.id = e.parent JOIN ir_nodes n ON n.id = e.child)"""
)

_memo: dict[tuple, Genealogy] = {}


def irregular(spark: SparkSession, sf_dir: str) -> Genealogy:
    """The genealogy of a data directory, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _memo:
        return _memo[key]
    known: dict[str, DataFrame] = {t: load(spark, sf_dir, t) for t in ("nodes", "edges", "migrations")}

    def sql(text: str) -> DataFrame:
        text = text.format(q="`")
        for t in known:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(text, **{t: d for t, d in known.items() if f"{{{t}}}" in text})

    blank = "CAST(NULL AS BINARY) metadata"
    known["ir_nodes"] = stage(sql(_NODES), "nodes")
    known["ir_moves"] = stage(sql(_MOVES), "moves")
    empty = {t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}
    g = Genealogy(
        nodes=known["ir_nodes"].selectExpr("id", "flags", "time", "population", "-1L individual", blank), edges=stage(sql(_EDGES).selectExpr("*", blank), "edges"), sites=stage(sql(_SITES).selectExpr("*", blank), "sites"),
        mutations=stage(sql(_MUTATIONS).selectExpr("id", "site", "node", "-1L parent", "CAST(NULL AS DOUBLE) time", "derived_state", blank), "mutations"),
        individuals=empty["individuals"], populations=empty["populations"], migrations=empty["migrations"], provenances=empty["provenances"], sequence_length=L,
    )
    _memo[key] = g
    return g
