"""The genealogy as eight tables and a few scalars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nodes": "id long, flags long, time double, population long, individual long, metadata binary",
    "edges": "id long, left double, right double, parent long, child long, metadata binary",
    "sites": "id long, position double, ancestral_state string, metadata binary",
    "mutations": "id long, site long, node long, parent long, time double, derived_state string, metadata binary",
    "individuals": "id long, flags long, location array<double>, parents array<long>, metadata binary",
    "populations": "id long, metadata binary",
    "migrations": "id long, left double, right double, node long, source long, dest long, time double, metadata binary",
    "provenances": "id long, timestamp string, record string",
}


def names(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


class Later:
    """A table that is made when it is first read, and once for all that share it."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.made = make, None

    def __call__(self) -> DataFrame:
        if self.made is None:
            self.made = self.make()
        return self.made


def now(table: DataFrame | Later) -> DataFrame:
    return table() if isinstance(table, Later) else table


@dataclass(frozen=True)
class Genealogy:
    """Eight DataFrames; ids are explicit, -1 is the null id, an unknown time is NULL, intervals are half-open.

    A table may be given as :class:`Later`, so that what numbers or writes it runs only for those who read it.
    """

    nodes: DataFrame
    edges: DataFrame
    sites: DataFrame
    mutations: DataFrame
    individuals: DataFrame
    populations: DataFrame
    migrations: DataFrame
    provenances: DataFrame
    sequence_length: float
    time_units: str = "unknown"
    metadata: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict, compare=False, repr=False)

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return value() if isinstance(value, Later) else value

    def with_tables(self, **changed) -> Genealogy:
        """Other tables, or scalars; tables that are not yet made stay so."""
        return Genealogy(**(self.__dict__ | {"memo": {}} | changed))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def samples(self, population: int | None = None, time: float | tuple[float, float] | None = None) -> DataFrame:
        """Ids of sample nodes, of one population, or with a time equal to ``time`` or inside a half-open pair."""
        s = self.nodes.where(F.col("flags").bitwiseAND(1) == 1)
        if population is not None:
            s = s.where(F.col("population") == population)
        if isinstance(time, tuple):
            s = s.where((F.col("time") >= time[0]) & (F.col("time") < time[1]))
        elif time is not None:
            s = s.where(F.col("time") == time)
        return s.select("id")


def from_rows(spark: SparkSession, sequence_length: float, **rows) -> Genealogy:
    """A small genealogy from row tuples; missing trailing columns become NULL, missing ids are numbered, missing tables are empty."""
    frames = {}
    for t, schema in SCHEMAS.items():
        cols = names(t)
        full = []
        for i, r in enumerate(rows.get(t, ())):
            r = (i, *r)
            r = r + (None,) * (len(cols) - len(r))
            full.append(r)
        df = spark.createDataFrame(full, schema)
        fill = {c: -1 for c in ("population", "individual", "parent") if c in cols and t in ("nodes", "mutations")}
        frames[t] = df.fillna(fill) if fill else df
    return Genealogy(**frames, sequence_length=sequence_length)


def violations(g: Genealogy) -> DataFrame:
    """Broken rules of the data model, one row each: ``table_name``, ``row_id``, ``rule``."""
    n, e, s, m = g.nodes, g.edges, g.sites, g.mutations
    L = g.sequence_length
    found = []

    def rule(df: DataFrame, table: str, text: str, id: str = "id") -> None:
        found.append(df.select(F.lit(table).alias("table_name"), F.col(id).alias("row_id"), F.lit(text).alias("rule")))

    from pyspark.sql import Window

    unknown = lambda c: F.col(c).isNull() | F.isnan(c)
    rule(n.where(unknown("time")), "nodes", "time is not finite")
    for c, other in (("population", g.populations), ("individual", g.individuals)):
        ids = other.select(F.col("id").alias(c))
        rule(n.where(F.col(c) != -1).join(ids, c, "left_anti"), "nodes", f"{c} does not exist")
    rule(e.where((F.col("left") < 0) | (F.col("right") > L) | ~(F.col("left") < F.col("right"))), "edges", "interval is empty or outside the sequence")
    t = n.select("id", "time")
    ends = e.join(t.toDF("parent", "pt"), "parent", "left").join(t.toDF("child", "ct"), "child", "left")
    rule(ends.where(F.col("pt").isNull()), "edges", "parent does not exist")
    rule(ends.where(F.col("ct").isNull()), "edges", "child does not exist")
    rule(ends.where(F.col("pt") <= F.col("ct")), "edges", "parent is not older than child")
    before = F.lag("right").over(Window.partitionBy("child").orderBy("left", "right"))
    rule(e.withColumn("_b", before).where(F.col("_b") > F.col("left")), "edges", "intervals of a child overlap")
    rule(s.where((F.col("position") < 0) | (F.col("position") >= L) | unknown("position")), "sites", "position is outside the sequence")
    rule(s.join(s.groupBy("position").agg(F.min("id").alias("_first")), "position").where(F.col("id") != F.col("_first")), "sites", "position is not unique")
    rule(m.join(s.select(F.col("id").alias("site")), "site", "left_anti"), "mutations", "site does not exist")
    rule(m.join(n.select(F.col("id").alias("node")), "node", "left_anti"), "mutations", "node does not exist")
    p = m.select(F.col("id").alias("parent"), F.col("site").alias("_ps"))
    rule(m.where(F.col("parent") != -1).join(p, "parent", "left").where(F.col("_ps").isNull() | (F.col("_ps") != F.col("site")) | (F.col("parent") >= F.col("id"))), "mutations", "parent is not an earlier mutation of the site")
    timed = m.join(t.toDF("node", "nt"), "node")
    rule(timed.where(F.col("time") < F.col("nt")), "mutations", "time is younger than its node")
    known = m.groupBy("site").agg(F.count("time").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 0 and k < n")
    rule(known, "mutations", "times of a site are partly unknown", "site")
    i = g.individuals.select("id", F.explode("parents").alias("p")).where(F.col("p") != -1)
    rule(i.where(F.col("p") == F.col("id")), "individuals", "is its own parent")
    rule(i.join(g.individuals.select(F.col("id").alias("p")), "p", "left_anti"), "individuals", "parent does not exist")
    rule(g.migrations.where(~(F.col("left") < F.col("right"))), "migrations", "interval is empty")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
