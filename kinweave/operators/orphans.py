"""References to rows that are missing, retired or recorded only later.

Parent and child keys are tagged and brought into one long form, pre-aggregated per parent table and key on the map side; a
group without a parent's flag, or whose parent came later than one of its references or was retired by then, is kept. Only
for the kept keys the referring rows are looked up again, so that no hot key is ever gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import skew_join

#: (referring table, field, table referred to)
REFERENCES = (("nodes", "population", "populations"), ("nodes", "individual", "individuals"), ("edges", "parent", "nodes"), ("migrations", "node", "nodes"))


def _target(references, to: str, key: str):
    """Table and id of a target as one long: the id times the number of tables, plus the place of the table."""
    order = list(dict.fromkeys(t for _, _, t in references))
    return (F.col(key) * len(order) + order.index(to)).cast("long").alias("target")


def _references(tables: dict[str, DataFrame], references) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        tables[t].where(F.col(f).isNotNull() & (F.col(f) != -1)).select(
            _target(references, to, f), F.lit(t).alias("table_name"), F.lit(f).alias("field_name"),
            F.col("id").alias("row_id"), "batch", "recorded_at",
        ) for t, f, to in references
    ])


def orphans(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """One row per referring id and field whose target is missing, late or retired.

    Columns: ``table_name``, ``field_name``, ``row_id``, ``batch``, ``reason`` (``missing``, ``late`` or ``retired``; the first that holds in
    this order). NULL and -1 refer to nothing; other negative ids are references. An id counts once, with its earliest ``recorded_at``
    and, among equals, its smallest batch; a row without ``recorded_at`` can only be an orphan by ``missing``. Where two rows of a target differ in
    ``retired_at``, that of the earliest counts. Empty tables give no rows, or make every reference to them missing.
    Ids must lie within 2**63 divided by the number of tables referred to.
    """
    refs = _references(tables, references)
    parents = reduce(DataFrame.unionByName, [
        tables[to].where(F.col("id").isNotNull()).select(
            _target(references, to, "id"), F.col("recorded_at").alias("known_from"),
            F.col("retired_at") if "retired_at" in tables[to].columns else F.lit(None).cast("timestamp").alias("retired_at"),
        ) for to in dict.fromkeys(to for _, _, to in references)
    ])
    long_form = refs.select("target", F.lit(False).alias("is_parent"), F.col("recorded_at").alias("at"), F.lit(None).cast("timestamp").alias("known_from"), F.lit(None).cast("timestamp").alias("retired_at")).unionByName(
        parents.select("target", F.lit(True).alias("is_parent"), F.lit(None).cast("timestamp").alias("at"), "known_from", "retired_at")
    )
    groups = long_form.groupBy("target").agg(
        F.max("is_parent").alias("has_parent"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min("known_from").alias("known_from"), F.min("retired_at").alias("retired_at"), F.max(~F.col("is_parent")).alias("referred"),
    )
    suspect = groups.where(
        F.col("referred") & (~F.col("has_parent") | F.coalesce(F.col("first_at") < F.col("known_from"), F.lit(False)) | F.coalesce(F.col("last_at") >= F.col("retired_at"), F.lit(False)))
    ).select("target", "has_parent", "known_from", "retired_at")
    rows = skew_join(refs, suspect, "target")
    once = rows.groupBy("table_name", "field_name", "row_id", "target").agg(
        F.min("recorded_at").alias("recorded_at"), F.min_by("batch", F.struct("recorded_at", "batch")).alias("batch"),
        F.first("has_parent").alias("has_parent"), F.first("known_from").alias("known_from"), F.first("retired_at").alias("retired_at"),
    )
    reason = F.when(~F.col("has_parent"), "missing").when(F.col("known_from") > F.col("recorded_at"), "late").when(F.col("retired_at") <= F.col("recorded_at"), "retired")
    return once.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("table_name", "field_name", "row_id", "batch", "reason")


def orphan_report(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """Orphan references per table, field, batch and reason: ``n_orphans``."""
    return orphans(tables, references).groupBy("table_name", "field_name", "batch", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
