"""Merged stretches and gaps of intervals per entity, in two levels.

The axis is cut into shards at quantiles of ``left``: entities are hashed to a fixed number of buckets, a bucket gets about a shard for each ``rows_per_shard`` of its
rows, two at least, so an entity with very many rows is cut where its own rows lie. Intervals are clipped to the shards; an interval over three shards or more
leaves a piece in its first and last one, and what lies between is kept as a range of covered shards, of which only the longest from each shard matters. Pieces
are merged within entity and shard; coverage that touches shard ends is stitched over at most two pieces a shard, and coalesced. No window spans
more than one shard of an entity, or the shard ends of one entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.staging import stage

BUCKETS = 4096
#: Rows of a bucket for which it gets another shard.
ROWS_PER_SHARD = 500_000


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")


@dataclass
class Cuts:
    """``table``: inner shard ends of each bucket (``_bucket``, ``_cuts``); ``most``: the largest number of shards of a bucket."""

    table: DataFrame
    most: int

    def on(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Add ``_cuts``. The table has BUCKETS rows and a number for each ``rows_per_shard`` input rows, hence the broadcast."""
        return df.withColumn("_bucket", _bucket(keys)).join(F.broadcast(self.table), "_bucket").drop("_bucket")

    def below(self, x: Column, strict: bool) -> Column:
        """How many ends lie below ``x``, or at it if not ``strict``."""
        cuts = F.col("_cuts")
        under = (lambda c: c < x) if strict else (lambda c: c <= x)
        if self.most <= 16:
            return F.size(F.filter(cuts, under))
        first = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

        def halve(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            up = under(F.get(cuts, mid))
            return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.most.bit_length() + 1)), first, halve, lambda a: a["lo"])


def plan_cuts(df: DataFrame, keys: list[str], rows_per_shard: int = ROWS_PER_SHARD) -> Cuts:
    """Shard ends by load, from map-side-combined passes over keys and ``left``: one over all rows, one more over the buckets of each larger number of shards."""
    by = df.groupBy(_bucket(keys).alias("_bucket"))
    half = by.agg(F.count(F.lit(1)).alias("n"), F.array(F.percentile_approx("left", 0.5)).alias("_cuts")).collect()  # at most BUCKETS rows
    # powers of two, so that buckets of any sizes need few passes
    shards = {r["_bucket"]: 1 << max(1, (-(-r["n"] // rows_per_shard) - 1).bit_length()) for r in half}
    ends = {r["_bucket"]: r["_cuts"] for r in half}
    for m in sorted({s for s in shards.values() if s > 2}):
        at = [b for b, s in shards.items() if s == m]
        own = df.withColumn("_bucket", _bucket(keys)).where(F.col("_bucket").isin(at)).groupBy("_bucket")
        for r in own.agg(F.percentile_approx("left", [k / m for k in range(1, m)], max(10_000, 4 * m)).alias("_cuts")).collect():  # in all a number for each rows_per_shard rows
            ends[r["_bucket"]] = sorted(set(r["_cuts"]))
    table = df.sparkSession.createDataFrame(sorted(ends.items()), "_bucket int, _cuts array<double>")
    return Cuts(table, max((len(c) for c in ends.values()), default=0) + 1)


def _clipped(intervals: DataFrame, keys: list[str], rows_per_shard: int) -> DataFrame:
    """Pieces within shards that cover the same positions: keys, ``_shard``, ``left``, ``right``."""
    df = intervals.select(*keys, F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))
    df = df.where(F.col("left").isNotNull() & F.col("right").isNotNull() & ~F.isnan("left") & ~F.isnan("right") & (F.col("right") > F.col("left")))
    cuts = plan_cuts(df, keys, rows_per_shard)
    none = F.lit(None).cast("int")
    lo, hi = F.col("_lo"), F.col("_hi")
    end_of = lambda s: F.get("_cuts", s)
    piece = lambda s, a, b, until: F.struct(s.alias("_shard"), a.alias("left"), b.alias("right"), until.alias("_until"))
    parts = [
        piece(lo, F.col("left"), F.when(hi > lo, end_of(lo)).otherwise(F.col("right")), none),
        F.when(hi > lo, piece(hi, end_of(hi - 1), F.col("right"), none)),
        F.when(hi > lo + 1, piece(lo + 1, F.col("left"), F.col("right"), hi - 1)),
    ]
    cut = cuts.on(df, keys).withColumn("_lo", cuts.below(F.col("left"), False)).withColumn("_hi", cuts.below(F.col("right"), True))
    cut = cut.withColumn("_p", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    shard = cut.select(*keys, "_cuts", "_p.*")
    if cuts.most <= 2:
        return shard.select(*keys, "_shard", "left", "right")
    ends = shard.where("_until is null")
    many = F.size("_cuts") > 1  # of pieces with the same start only the longest matters: no window of a crowded bucket is left with ties
    ends = ends.where(~many).select(*keys, "_shard", "left", "right").unionByName(ends.where(many).groupBy(*keys, "_shard", "left").agg(F.max("right").alias("right")))
    ranges = shard.where("_until is not null").groupBy(*keys, "_shard").agg(F.max("_until").alias("_until"))
    by = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_from", F.greatest(F.col("_shard"), F.coalesce(F.max("_until").over(by) + 1, F.col("_shard")))).where("_from <= _until")
    full = cuts.on(ranges.select(*keys, "_from", "_until"), keys).withColumn("_shard", F.explode(F.sequence("_from", "_until")))
    return ends.unionByName(full.select(*keys, "_shard", end_of(F.col("_shard") - 1).alias("left"), end_of(F.col("_shard")).alias("right")))


def merged_intervals(intervals: DataFrame, keys: list[str], rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The longest covered stretches per entity (keys, ``left``, ``right``); intervals that only touch are one stretch.

    Rows with a NULL or NaN end, or without positive length, are left out; a NULL key is a key like any other. An empty table gives
    no rows, repeated rows change nothing, and other columns are ignored.
    """
    df = _clipped(intervals, keys, rows_per_shard)
    by = Window.partitionBy(*keys, "_shard").orderBy("left", "right")
    before = F.max("right").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn("_new", (before.isNull() | (F.col("left") > before)).cast("long"))
    merged = starts.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = merged.groupBy(*keys, "_shard", "_island").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    last = F.lead("left").over(Window.partitionBy(*keys, "_shard").orderBy("_island")).isNull()
    pieces = stage(pieces.select(*keys, "left", "right", ((F.col("_island") == 1) | last).alias("_rim")), "pieces")
    by = Window.partitionBy(*keys).orderBy("left", "right")
    before = F.max("right").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rim = pieces.where("_rim").withColumn("_new", (before.isNull() | (F.col("left") > before)).cast("long"))
    rim = rim.withColumn("_stretch", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = rim.groupBy(*keys, "_stretch").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("_stretch")
    return pieces.where("not _rim").select(*keys, "left", "right").unionByName(stitched)


def gaps(intervals: DataFrame, keys: list[str], rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The longest uncovered stretches between the first and the last covered position of an entity.

    Columns: the keys, ``gap_left`` and ``gap_right`` as BIGINT. Intervals that only touch leave no gap; an entity with one
    stretch has none. Unusable rows are treated as in :func:`merged_intervals`.
    """
    df = _clipped(intervals, keys, rows_per_shard)
    by = Window.partitionBy(*keys, "_shard").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    within = df.select(*keys, F.max("right").over(by).alias("gap_left"), F.col("left").alias("gap_right")).where("gap_right > gap_left")
    ends = df.groupBy(*keys, "_shard").agg(F.min("left").alias("gap_right"), F.max("right").alias("_to"))
    stitched = ends.withColumn("gap_left", F.lag("_to").over(Window.partitionBy(*keys).orderBy("_shard"))).where("gap_right > gap_left")
    every = within.unionByName(stitched.select(*keys, "gap_left", "gap_right"))
    return every.select(*keys, F.col("gap_left").cast("long").alias("gap_left"), F.col("gap_right").cast("long").alias("gap_right"))
