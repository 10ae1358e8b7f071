"""Queries of the general problems, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import coverage, hierarchy, lineage, orphans, skew
from kinweave.plans.staging import load, usable_edges


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_parents(load(spark, d, "edges"), load(spark, d, "nodes"))


def p1_parent_results(spark: SparkSession, d: str) -> DataFrame:
    return skew.parent_results(load(spark, d, "edges"), load(spark, d, "nodes"))


def _referring(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: load(spark, d, t) for t in ("nodes", "edges", "individuals", "migrations", "populations")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_referring(spark, d)).drop("reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_referring(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(hierarchy.all_links(load(spark, d, "edges"), load(spark, d, "individuals")))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.paths(hierarchy.all_links(load(spark, d, "edges"), load(spark, d, "individuals")))
    return out.withColumn("path", F.array_join("path", "/"))


def p5_lineage(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.lineage(hierarchy.all_links(load(spark, d, "edges"), load(spark, d, "individuals")))
    return out.withColumn("path", F.array_join("path", "/"))


def p5_everyone(spark: SparkSession, d: str) -> DataFrame:
    edges, people = load(spark, d, "edges"), load(spark, d, "individuals")
    out = lineage.lineage(hierarchy.all_links(edges, people), ids=lineage.all_ids(load(spark, d, "nodes"), edges, people))
    return out.withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return lineage.descendants(hierarchy.all_links(load(spark, d, "edges"), load(spark, d, "individuals")))


def p5_roots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.roots(hierarchy.all_links(load(spark, d, "edges"), load(spark, d, "individuals")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return coverage.gaps(usable_edges(load(spark, d, "edges")), ["parent", "child"])


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    return coverage.merged_intervals(usable_edges(load(spark, d, "edges")), ["parent", "child"])


QUERIES = {f.__name__: f for f in (p1_found, p1_parent_results, p3_found, p3_report, p5_found, p5_paths, p5_lineage, p5_everyone, p5_descendants, p5_roots, p6_found, p6_merged)}

_USABLE = """usable AS (SELECT * FROM edges WHERE "left" IS NOT NULL AND "right" IS NOT NULL AND parent IS NOT NULL AND parent <> -1 AND "right" > "left")"""

_ORPHANS = """
WITH refs AS (
  SELECT 'nodes' table_name, 'population' field_name, 'populations' tgt, id row_id, population k, batch, recorded_at FROM nodes
  UNION ALL SELECT 'nodes', 'individual', 'individuals', id, individual, batch, recorded_at FROM nodes
  UNION ALL SELECT 'edges', 'parent', 'nodes', id, parent, batch, recorded_at FROM edges
  UNION ALL SELECT 'migrations', 'node', 'nodes', id, node, batch, recorded_at FROM migrations),
once AS (SELECT * FROM refs WHERE k IS NOT NULL AND k <> -1
  QUALIFY row_number() OVER (PARTITION BY table_name, field_name, row_id ORDER BY recorded_at, batch) = 1),
targets AS (SELECT tgt, id, min(recorded_at) since, min(retired_at) retired FROM (
  SELECT 'populations' tgt, id, recorded_at, retired_at FROM populations
  UNION ALL SELECT 'individuals', id, recorded_at, retired_at FROM individuals
  UNION ALL SELECT 'nodes', id, recorded_at, retired_at FROM nodes) q GROUP BY tgt, id),
bad AS (SELECT table_name, field_name, row_id, batch,
  CASE WHEN t.id IS NULL THEN 'missing' WHEN since > recorded_at THEN 'late' WHEN retired <= recorded_at THEN 'retired' END reason
  FROM once o LEFT JOIN targets t ON t.tgt = o.tgt AND t.id = o.k)
"""

_REACH = """
WITH RECURSIVE links AS (
  SELECT 'node' kind, child, parent FROM edges WHERE parent IS NOT NULL AND parent <> -1
  UNION SELECT 'individual', id, p FROM (SELECT id, unnest(parents) p FROM individuals) q WHERE p IS NOT NULL AND p <> -1),
ids AS (SELECT kind, child id FROM links UNION SELECT kind, parent FROM links),
tops AS (SELECT kind, id FROM ids ANTI JOIN links l ON l.kind = ids.kind AND l.child = ids.id),
reach(kind, a, b) AS (SELECT kind, child, parent FROM links UNION SELECT r.kind, r.a, l.parent FROM reach r JOIN links l ON l.kind = r.kind AND l.child = r.b),
"""

_IDS = "ids AS (SELECT kind, child id FROM links UNION SELECT kind, parent FROM links"

_MORE_IDS = """
  UNION SELECT 'node', id FROM nodes WHERE id <> -1 UNION SELECT 'node', child FROM edges WHERE child <> -1 UNION SELECT 'individual', id FROM individuals WHERE id <> -1"""

_LINEAGE = """
looped AS (SELECT x.kind, x.a id, min(y.a) c FROM reach x JOIN reach s ON s.kind = x.kind AND s.a = x.a AND s.b = x.a
  JOIN reach y ON y.kind = x.kind AND y.b = x.a AND y.a = x.b GROUP BY x.kind, x.a),
named AS (SELECT i.kind, i.id, coalesce(c, i.id) c FROM ids i LEFT JOIN looped l ON l.kind = i.kind AND l.id = i.id),
dag AS (SELECT DISTINCT l.kind, x.c child, y.c parent FROM links l JOIN named x ON x.kind = l.kind AND x.id = l.child JOIN named y ON y.kind = l.kind AND y.id = l.parent WHERE x.c <> y.c),
far(kind, c, d) AS (SELECT kind, id, CAST(0 AS BIGINT) FROM tops UNION SELECT f.kind, g.child, f.d + 1 FROM far f JOIN dag g ON g.kind = f.kind AND g.parent = f.c),
most AS (SELECT kind, c, max(d) d FROM far GROUP BY kind, c),
near(kind, id, d) USING KEY (kind, id) AS (SELECT kind, id, CAST(0 AS BIGINT) FROM tops
  UNION SELECT l.kind, l.child, min(w.d) + 1 FROM near w JOIN links l ON l.kind = w.kind AND l.parent = w.id
    LEFT JOIN recurring.near o ON o.kind = l.kind AND o.id = l.child WHERE o.id IS NULL GROUP BY l.kind, l.child),
via AS (SELECT l.kind, l.child, min(l.parent) parent FROM links l JOIN near x ON x.kind = l.kind AND x.id = l.child JOIN near y ON y.kind = l.kind AND y.id = l.parent WHERE y.d = x.d - 1 GROUP BY l.kind, l.child),
walk(kind, id, path) AS (SELECT kind, id, CAST(id AS VARCHAR) FROM tops UNION ALL SELECT v.kind, v.child, w.path || '/' || v.child FROM walk w JOIN via v ON v.kind = w.kind AND v.parent = w.id),
above AS (SELECT r.kind, r.a id, count(t.id) roots, count(l.id) loops FROM reach r LEFT JOIN tops t ON t.kind = r.kind AND t.id = r.b LEFT JOIN looped l ON l.kind = r.kind AND l.id = r.b GROUP BY r.kind, r.a),
below AS (SELECT kind, b id, count(*) n FROM reach WHERE a <> b GROUP BY kind, b)
SELECT i.kind, i.id, coalesce(a.loops, 0) > 0 loops, CASE WHEN a.id IS NULL THEN 1 ELSE a.roots END n_roots, n.d depth_min, CASE WHEN n.id IS NOT NULL THEN m.d END depth_max, w.path, coalesce(b.n, 0) n_descendants
FROM named i LEFT JOIN above a ON a.kind = i.kind AND a.id = i.id LEFT JOIN near n ON n.kind = i.kind AND n.id = i.id LEFT JOIN most m ON m.kind = i.kind AND m.c = i.c
LEFT JOIN walk w ON w.kind = i.kind AND w.id = i.id LEFT JOIN below b ON b.kind = i.kind AND b.id = i.id"""

SQL = {
    "p1_found": """SELECT parent FROM edges WHERE parent IS NOT NULL AND parent <> -1 GROUP BY parent HAVING count(*) >= 0.01e0 * (SELECT count(*) FROM edges)""",
    "p1_parent_results": """
WITH once AS (SELECT id, any_value(parent) parent, any_value(child) child, max(CASE WHEN "right" > "left" THEN "right" - "left" END) span FROM edges GROUP BY id),
n AS (SELECT id, min("time") parent_time FROM nodes WHERE "time" IS NOT NULL AND NOT isnan("time") GROUP BY id),
rows_ AS (SELECT parent, count(*) n_rows FROM edges GROUP BY parent),
ids AS (SELECT parent, count(*) n_ids, count(DISTINCT child) n_children, coalesce(sum(span), 0e0) total_span FROM once GROUP BY parent)
SELECT r.parent, n_rows, CAST(n_ids AS BIGINT) n_ids, n_children, total_span, parent_time
FROM rows_ r JOIN ids i ON i.parent = r.parent LEFT JOIN n ON n.id = r.parent WHERE r.parent <> -1""",
    "p3_found": _ORPHANS + "SELECT table_name, field_name, row_id, batch FROM bad WHERE reason IS NOT NULL",
    "p3_report": _ORPHANS + "SELECT table_name, field_name, batch, reason, count(*) n_orphans FROM bad WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": """
WITH RECURSIVE links AS (
  SELECT 'node' kind, child, parent FROM edges WHERE parent IS NOT NULL AND parent <> -1
  UNION SELECT 'individual', id, p FROM (SELECT id, unnest(parents) p FROM individuals) q WHERE p IS NOT NULL AND p <> -1),
middle AS (SELECT l.* FROM links l WHERE EXISTS (SELECT 1 FROM links u WHERE u.kind = l.kind AND u.child = l.parent) AND EXISTS (SELECT 1 FROM links d WHERE d.kind = l.kind AND d.parent = l.child)),
reach(kind, a, b) AS (SELECT kind, child, parent FROM middle UNION SELECT r.kind, r.a, l.parent FROM reach r JOIN middle l ON l.kind = r.kind AND l.child = r.b)
SELECT x.kind, min(y.a) AS cycle_id, x.a AS member_id FROM reach x JOIN reach s ON s.kind = x.kind AND s.a = x.a AND s.b = x.a
JOIN reach y ON y.kind = x.kind AND y.b = x.a AND y.a = x.b GROUP BY x.kind, x.a""",
    "p5_paths": """
WITH RECURSIVE links AS (
  SELECT 'node' kind, child, parent FROM edges WHERE parent IS NOT NULL AND parent <> -1
  UNION SELECT 'individual', id, p FROM (SELECT id, unnest(parents) p FROM individuals) q WHERE p IS NOT NULL AND p <> -1),
ids AS (SELECT kind, child id FROM links UNION SELECT kind, parent FROM links),
tops AS (SELECT kind, id FROM ids ANTI JOIN links l ON l.kind = ids.kind AND l.child = ids.id),
near(kind, id, d) USING KEY (kind, id) AS (SELECT kind, id, CAST(0 AS BIGINT) FROM tops
  UNION SELECT l.kind, l.child, min(w.d) + 1 FROM near w JOIN links l ON l.kind = w.kind AND l.parent = w.id
    LEFT JOIN recurring.near o ON o.kind = l.kind AND o.id = l.child WHERE o.id IS NULL GROUP BY l.kind, l.child),
via AS (SELECT l.kind, l.child, min(l.parent) parent FROM links l JOIN near x ON x.kind = l.kind AND x.id = l.child JOIN near y ON y.kind = l.kind AND y.id = l.parent WHERE y.d = x.d - 1 GROUP BY l.kind, l.child),
walk(kind, id, way) AS (SELECT kind, id, [id] FROM tops UNION ALL SELECT v.kind, v.child, list_append(w.way, v.child) FROM walk w JOIN via v ON v.kind = w.kind AND v.parent = w.id),
rows_ AS (SELECT l.kind, l.child id, l.parent, l.child = l.parent OR coalesce(list_contains(w.way, l.child), false) closes, list_append(w.way, l.child) way, w.way IS NULL lost
  FROM links l LEFT JOIN walk w ON w.kind = l.kind AND w.id = l.parent
  UNION ALL SELECT kind, id, NULL, false, [id], false FROM tops)
SELECT kind, id, parent, closes, CASE WHEN NOT closes AND NOT lost THEN way[1] END root, CASE WHEN NOT closes AND NOT lost THEN CAST(len(way) - 1 AS BIGINT) END AS depth,
  CASE WHEN NOT closes AND NOT lost THEN array_to_string(way, '/') END AS path FROM rows_""",
    "p5_lineage": _REACH + _LINEAGE,
    "p5_everyone": _REACH.replace(_IDS, _IDS + _MORE_IDS) + _LINEAGE,
    "p5_descendants": _REACH + """x AS (SELECT 1) SELECT kind, b id, a descendant FROM reach WHERE a <> b""",
    "p5_roots": _REACH + """x AS (SELECT 1) SELECT kind, a id, b root FROM reach SEMI JOIN tops t ON t.kind = reach.kind AND t.id = reach.b UNION ALL SELECT kind, id, id FROM tops""",
    "p6_found": f"""
WITH {_USABLE},
flow AS (SELECT parent, child, "left", max("right") OVER (PARTITION BY parent, child ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM usable)
SELECT parent, child, CAST(reached AS BIGINT) gap_left, CAST("left" AS BIGINT) gap_right FROM flow WHERE "left" > reached""",
    "p6_merged": f"""
WITH {_USABLE},
flow AS (SELECT parent, child, "left", "right", max("right") OVER (PARTITION BY parent, child ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM usable),
grp AS (SELECT *, sum(CASE WHEN reached IS NULL OR "left" > reached THEN 1 ELSE 0 END) OVER (PARTITION BY parent, child ORDER BY "left", "right" ROWS UNBOUNDED PRECEDING) g FROM flow)
SELECT parent, child, min("left") AS "left", max("right") AS "right" FROM grp GROUP BY parent, child, g""",
}
