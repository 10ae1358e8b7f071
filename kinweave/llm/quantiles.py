"""Percentiles per group by radix selection over order-preserving integers.

A double becomes a 64-bit integer that sorts as the double does. The integers of a group are counted by their leading 16-bit
digit; within the digit that holds a wanted rank they are counted by the next digit, and so on. Counts add up, so histograms of
batches or partitions combine into exactly that of the whole. All four digits give the exact percentile; the first two leave an error below
2**-20 of the value (for normal doubles).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.skew import skew_join
from kinweave.plans.staging import stage

BITS, DIGITS = 16, 4
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def to_key(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles; -0.0 counts as 0.0."""
    bits = (np.asarray(x, dtype="float64") + 0.0).view("int64")
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_key(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, dtype="int64")
    return np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view("float64")


@F.pandas_udf(T.LongType())
def _key(x: pd.Series) -> pd.Series:
    return pd.Series(to_key(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def _value(k: pd.Series) -> pd.Series:
    lowest, highest = to_key(np.array([-np.inf, np.inf]))  # bounds beyond the infinities are no numbers
    return pd.Series(from_key(np.clip(k.to_numpy(), lowest, highest)))


def keyed(values: DataFrame, group: str, value: str, *also: str) -> DataFrame:
    """``grp``, ``key`` and the columns ``also``; rows whose value is NULL or NaN (unknown) are left out."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    return known.select(F.col(group).alias("grp"), _key(F.col(value).cast("double")).alias("key"), *also)


def _ranks(sizes: DataFrame, quantiles) -> DataFrame:
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))
    return sizes.select("grp", "n", q.alias("q")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long"))


def _follow(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The digit of each target that holds its rank, and the rank within it."""
    by = Window.partitionBy("at").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    up_to = counts.withColumn("cum", F.sum("c").over(by))  # at most 2**16 digits in a window
    hit = targets.join(up_to.select("at", "digit", "c", "cum"), "at").where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("c") < F.col("rank")))
    return hit.select("grp", "n", "q", (F.col("rank") - F.col("cum") + F.col("c")).alias("rank"), (F.coalesce("prefix", F.lit(0)) * (1 << BITS) + F.col("digit")).alias("prefix"))


def percentiles(values: DataFrame, group: str, value: str, quantiles=QUANTILES, digits: int = DIGITS) -> DataFrame:
    """``grp``, ``q``, ``n`` (known values of the group), ``value``: the smallest value with at least ``q`` of the group at or below it.

    ``digits`` below 4 stops early and gives the lower bound of the last digit followed. NULL and NaN values are unknown and left
    out; a NULL group is a group; groups without a known value, and empty tables, give no rows. Ties and repeated rows count as often as they
    stand. Infinite values are ordered like any others. Other columns are ignored.
    """
    rows = stage(keyed(values, group, value), "keys")
    targets, prefix = None, None
    for d in range(digits):
        shift = 64 - BITS * (d + 1)
        digit = F.shiftright("key", shift)
        if d == 0:
            counts = stage(rows.groupBy("grp", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c")), "digits").withColumn("at", F.struct("grp"))
            sizes = counts.groupBy("grp").agg(F.sum("c").alias("n"))
            targets = _ranks(sizes, quantiles).withColumn("prefix", F.lit(None).cast("long")).withColumn("at", F.struct("grp"))
        else:
            wanted = targets.select("at").distinct()
            inside = rows.withColumn("at", F.struct("grp", F.shiftright("key", shift + BITS).alias("prefix")))
            inside = skew_join(inside, wanted, "at", "left_semi", ["key"])
            if d < digits - 1:  # later digits read no other rows
                rows = stage(inside.select("grp", "key"), "keys")
                inside = rows.withColumn("at", F.struct("grp", F.shiftright("key", shift + BITS).alias("prefix")))
            counts = inside.groupBy("at", F.pmod(digit, F.lit(1 << BITS)).alias("digit")).agg(F.count(F.lit(1)).alias("c"))
        targets = stage(_follow(counts, targets), "targets").withColumn("at", F.struct("grp", "prefix"))
    rest = 64 - BITS * digits
    return targets.select("grp", "q", "n", _value(F.shiftleft("prefix", rest)).alias("value"))


def histograms(values: DataFrame, group: str, value: str, batch: str, digits: int = 2) -> DataFrame:
    """Mergeable counts per group and batch over the first ``digits`` digits: ``grp``, ``batch``, ``prefix``, ``c``."""
    k = keyed(values, group, value, F.col(batch).alias("batch"))
    return k.groupBy("grp", "batch", F.shiftright("key", 64 - BITS * digits).alias("prefix")).agg(F.count(F.lit(1)).alias("c"))


def combined(hists: DataFrame, quantiles=QUANTILES, digits: int = 2) -> DataFrame:
    """Percentiles of all batches together from their histograms: ``grp``, ``q``, ``n``, ``low``, ``high`` (the exact value lies between).

    Digits are followed as in :func:`percentiles`, over the counts alone.
    """
    total = stage(hists.groupBy("grp", "prefix").agg(F.sum("c").alias("c")), "histogram")
    sizes = total.groupBy("grp").agg(F.sum("c").alias("n"))
    targets = _ranks(sizes, quantiles).withColumn("prefix", F.lit(None).cast("long")).withColumn("at", F.struct(F.col("grp"), F.lit(0).cast("long").alias("prefix")))
    for d in range(digits):
        down = BITS * (digits - 1 - d)
        above = F.lit(0).cast("long") if d == 0 else F.shiftright("prefix", down + BITS)
        digit = F.shiftright("prefix", down) if d == 0 else F.pmod(F.shiftright("prefix", down), F.lit(1 << BITS))
        counts = total.groupBy(F.struct("grp", above.alias("prefix")).alias("at"), digit.alias("digit")).agg(F.sum("c").alias("c"))
        if d:
            counts = counts.join(targets.select("at").distinct(), "at", "left_semi")
        targets = stage(_follow(counts, targets), "targets").withColumn("at", F.struct("grp", "prefix"))
    rest = 64 - BITS * digits
    low = F.shiftleft("prefix", rest)
    return targets.select("grp", "q", "n", _value(low).alias("low"), _value(low + F.lit((1 << rest) - 1)).alias("high"))
