"""Rows of the tables: selection, editing, derived columns, and the differences between neighbouring trees."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.model import SCHEMAS, Genealogy, names
from kinweave.plans.staging import dense_ids
from kinweave.plans.ancestry import bin_width, overlap_join, trees


def keep_rows(g: Genealogy, table: str, condition: Column) -> tuple[Genealogy, DataFrame]:
    """Only the rows that meet a condition, renumbered in order of id, and the map ``old``, ``new``.

    References of a table to itself (mutation parents, individual parents) follow; a reference to a row that is gone is an error for mutations and -1 for
    individuals. References from other tables are left alone, as in the plain tables.
    """
    df = dense_ids(getattr(g, table).where(condition).withColumnRenamed("id", "old"), ["old"])
    to = df.select("old", F.col("id").alias("new"))
    if table == "mutations":
        df = df.join(to.select(F.col("old").alias("parent"), F.col("new").alias("_p")), "parent", "left")
        gone = F.raise_error(F.lit("the parent of a kept mutation is dropped"))
        df = df.withColumn("parent", F.when(F.col("parent") == -1, F.lit(-1).cast("long")).when(F.col("_p").isNull(), gone.cast("long")).otherwise(F.col("_p")))
    if table == "individuals":
        p = df.select("id", F.posexplode("parents").alias("_k", "_p")).join(to.select(F.col("old").alias("_p"), F.col("new").alias("_q")), "_p", "left")
        p = p.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_q", F.lit(-1).cast("long")).alias("_q")))), lambda x: x["_q"]).alias("parents"))
        df = df.drop("parents").join(p, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<long>")))
    return g.with_tables(**{table: df.select(*names(table))}), to


def append_rows(g: Genealogy, table: str, rows: DataFrame) -> Genealogy:
    """Rows (without ids) added behind the last id, in an order of their own columns."""
    top = getattr(g, table).agg(F.max("id")).first()[0]
    cols = [c for c in names(table) if c != "id"]
    order = [c for c in cols if c != "metadata"]
    new = dense_ids(rows.select(*cols), order, "_k").withColumn("id", F.col("_k") + (0 if top is None else top + 1))
    return g.with_tables(**{table: getattr(g, table).unionByName(new.select(*names(table)))})


def update_rows(g: Genealogy, table: str, condition: Column, values: Mapping[str, Column]) -> Genealogy:
    """Columns of the rows that meet a condition set to new values; others stay."""
    df = getattr(g, table)
    return g.with_tables(**{table: df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})})


def truncate(g: Genealogy, table: str, n: int) -> Genealogy:
    """The rows with ids below ``n``."""
    return g.with_tables(**{table: getattr(g, table).where(F.col("id") < n)})


def clear(g: Genealogy) -> Genealogy:
    """All tables empty."""
    return g.with_tables(**{t: g.spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS})


def drop_metadata(g: Genealogy) -> Genealogy:
    return g.with_tables(**{t: getattr(g, t).withColumn("metadata", F.lit(b"")) for t in SCHEMAS if "metadata" in names(t)})


def site_at(g: Genealogy, position: float) -> DataFrame:
    return g.sites.where(F.col("position") == position)


def tree_at_index(g: Genealogy, index: int) -> DataFrame:
    """Edges of the tree with a number, counted from the end if negative (0 is the first tree, -1 the last); a number beyond is an error."""
    t = trees(g)
    wanted = index if index >= 0 else t.count() + index
    r = t.where(F.col("tree") == wanted).first()
    if r is None:
        raise IndexError("there is no such tree")
    return tree_at(g, r["left"])


def tree_at(g: Genealogy, position: float) -> DataFrame:
    """Edges of the tree that covers a position; a filter that reaches the scan."""
    if not 0 <= position < g.sequence_length:
        raise ValueError("the position is outside the sequence")
    return g.edges.where((F.col("left") <= position) & (F.col("right") > position))


def edge_diffs(g: Genealogy, include_terminal: bool = False, reverse: bool = False) -> DataFrame:
    """Edges that end and that begin at each breakpoint: ``position``, ``direction`` (out or in), ``edge``, ``place`` (order of removal or insertion).

    ``reverse`` goes from the last tree to the first: edges come in at their right end and go out at their left one.
    """
    t = g.nodes.select(F.col("id").alias("parent"), F.col("time").alias("_t"))
    e = g.edges.join(t, "parent")
    ends, begins = ("left", "right") if reverse else ("right", "left")
    out = e.select(F.col(ends).alias("position"), F.lit("out").alias("direction"), F.col("id").alias("edge"), (-F.col("_t")).alias("a"), (-F.col("parent")).alias("b"), (-F.col("child")).alias("c"))
    into = e.select(F.col(begins).alias("position"), F.lit("in").alias("direction"), F.col("id").alias("edge"), F.col("_t").alias("a"), F.col("parent").alias("b"), F.col("child").alias("c"))
    if not include_terminal:
        out = out.where((F.col("position") > 0) if reverse else (F.col("position") < g.sequence_length))
    w = Window.partitionBy("position", "direction").orderBy("a", "b", "c", "edge")
    return out.unionByName(into).withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("a", "b", "c")


def coiterate(g: Genealogy, other: Genealogy) -> DataFrame:
    """Stretches over which the trees of two genealogies both stay: ``left``, ``right``, ``tree``, ``other_tree``."""
    if g.sequence_length != other.sequence_length:
        raise ValueError("the sequence lengths differ")
    j = overlap_join(trees(g), trees(other).withColumnRenamed("tree", "other_tree"), bin_width(g))
    return j.select(F.greatest("left", "b_left").alias("left"), F.least("right", "b_right").alias("right"), "tree", "other_tree")


def individual_nodes(g: Genealogy) -> DataFrame:
    """Per individual its nodes in order, their time and population (an error if they differ) and its location: ``individual``, ``nodes``, ``time``, ``population``."""
    n = g.nodes.where("individual <> -1").groupBy("individual").agg(
        F.sort_array(F.collect_list("id")).alias("nodes"), F.min("time").alias("time"), F.max("time").alias("_t"), F.min("population").alias("population"), F.max("population").alias("_p")
    )
    bad = F.raise_error(F.lit("nodes of an individual differ in time or population"))
    return n.select("individual", "nodes", F.when(F.col("time") != F.col("_t"), bad.cast("double")).otherwise(F.col("time")).alias("time"), F.when(F.col("population") != F.col("_p"), bad.cast("long")).otherwise(F.col("population")).alias("population"))


def edgesets(g: Genealogy) -> DataFrame:
    """Edges of one parent over one interval together: ``left``, ``right``, ``parent``, ``children``."""
    return g.edges.groupBy("left", "right", "parent").agg(F.sort_array(F.collect_list("child")).alias("children"))


def extremes(g: Genealogy) -> DataFrame:
    """One row over all nodes and mutations of known time: ``min_time``, ``max_time``, ``discrete_genome`` (every coordinate of edges, sites and migrations, and the
    sequence length, is a whole number), ``discrete_time`` (every known time of nodes, mutations and migrations is)."""
    known = lambda df, own: df.where(F.col("time").isNotNull() & ~F.isnan("time")).select("time", F.lit(own).alias("own"))
    own = F.when(F.col("own"), F.col("time"))
    t = known(g.nodes, True).unionByName(known(g.mutations, True)).unionByName(known(g.migrations, False))
    t = t.agg(F.min(own).alias("min_time"), F.max(own).alias("max_time"), F.coalesce(F.bool_and(F.col("time") == F.floor("time")), F.lit(True)).alias("discrete_time"))
    ends = F.explode(F.array("left", "right")).alias("position")
    x = g.edges.select(ends).unionByName(g.migrations.select(ends)).unionByName(g.sites.select("position"))
    whole = F.coalesce(F.bool_and(F.col("position") == F.floor("position")), F.lit(True)) & F.lit(float(g.sequence_length).is_integer())
    genome = x.agg(whole.alias("discrete_genome")).first()[0]
    return t.select("min_time", "max_time", F.lit(genome).alias("discrete_genome"), "discrete_time")


def nbytes(g: Genealogy) -> DataFrame:
    """Rows and bytes of the columns of each table: ``table_name``, ``n_rows``, ``n_bytes``. A ragged column counts its content and 8 bytes an offset, one more than rows."""
    from functools import reduce

    size = {"bigint": F.lit(8), "double": F.lit(8)}
    rows = []
    for t in SCHEMAS:
        df = getattr(g, t).select(*names(t)[1:])
        of = [size[k] if k in size else F.coalesce(F.octet_length(c), F.lit(0)) + 8 if k in ("binary", "string") else F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 8 for c, k in df.dtypes]
        ragged = 8 * sum(k not in size for _, k in df.dtypes)
        rows.append(df.select(reduce(lambda a, b: a + b, of).alias("b")).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), (F.coalesce(F.sum("b"), F.lit(0)) + ragged).cast("long").alias("n_bytes")))
    return reduce(DataFrame.unionByName, rows)
