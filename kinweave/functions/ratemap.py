"""Piecewise-constant rates along the sequence, as a small driver object and as a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RateMap:
    """Rates between positions; NaN is missing. Positions rise from 0."""

    def __init__(self, position: Sequence[float], rate: Sequence[float]):
        p, r = np.asarray(position, dtype="float64"), np.asarray(rate, dtype="float64")
        if len(p) != len(r) + 1 or len(r) == 0:
            raise ValueError("one position more than rates is needed")
        if p[0] != 0 or (np.diff(p) <= 0).any() or (r < 0).any():
            raise ValueError("positions must rise from 0, rates must not be negative")
        self.position, self.rate = p, r
        mass = np.where(np.isnan(r), 0, r * np.diff(p))
        self._cumulative = np.concatenate([[0], np.cumsum(mass)])

    @staticmethod
    def uniform(sequence_length: float, rate: float) -> RateMap:
        return RateMap([0, sequence_length], [rate])

    left = property(lambda s: s.position[:-1])
    right = property(lambda s: s.position[1:])
    mid = property(lambda s: (s.left + s.right) / 2)
    span = property(lambda s: s.right - s.left)
    mass = property(lambda s: s.span * s.rate)
    missing = property(lambda s: np.isnan(s.rate))
    non_missing = property(lambda s: ~np.isnan(s.rate))
    num_intervals = property(lambda s: len(s.rate))
    num_missing_intervals = property(lambda s: int(s.missing.sum()))
    num_non_missing_intervals = property(lambda s: int(s.non_missing.sum()))
    sequence_length = property(lambda s: float(s.position[-1]))
    total_mass = property(lambda s: float(s._cumulative[-1]))

    @property
    def mean_rate(self) -> float:
        """Average over what is not missing."""
        return self.total_mass / float(self.span[self.non_missing].sum())

    def find_index(self, x) -> np.ndarray:
        x = np.asarray(x, dtype="float64")
        if ((x < 0) | (x >= self.sequence_length)).any():
            raise KeyError("a position is outside the map")
        return np.searchsorted(self.position, x, side="right") - 1

    def get_rate(self, x) -> np.ndarray:
        return self.rate[self.find_index(x)]

    def get_cumulative_mass(self, x) -> np.ndarray:
        x = np.asarray(x, dtype="float64")
        if ((x < 0) | (x > self.sequence_length)).any():
            raise ValueError("a position is outside the map")
        return np.interp(x, self.position, self._cumulative)

    def slice(self, left: float | None = None, right: float | None = None, trim: bool = False) -> RateMap:
        """Missing outside [left, right); with ``trim`` cut and moved to 0."""
        a, b = left or 0.0, self.sequence_length if right is None else right
        if not 0 <= a < b <= self.sequence_length:
            raise KeyError("the slice is outside the map")
        i, j = int(self.find_index(a)), int(np.searchsorted(self.position, b, side="left"))
        pos = np.concatenate([[a], self.position[i + 1 : j], [b]])
        rate = self.rate[i:j]
        if trim:
            return RateMap(pos - a, rate)
        if a > 0:
            pos, rate = np.concatenate([[0], pos]), np.concatenate([[np.nan], rate])
        if b < self.sequence_length:
            pos, rate = np.concatenate([pos, [self.sequence_length]]), np.concatenate([rate, [np.nan]])
        return RateMap(pos, rate)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(float(a), float(b), None if np.isnan(r) else float(r)) for a, b, r in zip(self.left, self.right, self.rate)], "left double, right double, rate double")

    def _at(self, f, column: Column) -> Column:
        """A function of positions on a column, by binary search in Arrow batches; outside the map NULL."""
        L = self.sequence_length

        @F.pandas_udf(T.DoubleType())
        def look(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype="float64", na_value=np.nan)
            ok = (v >= 0) & (v < L)
            out = np.full(len(v), np.nan)
            out[ok] = f(v[ok])
            return pd.Series(out).where(~np.isnan(out), None)

        return look(column)

    def rate_at(self, column: Column) -> Column:
        return self._at(self.get_rate, column)

    def cumulative_mass_at(self, column: Column) -> Column:
        return self._at(self.get_cumulative_mass, column)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.position, other.position) and np.array_equal(self.rate, other.rate, equal_nan=True)

    def __len__(self) -> int:
        return self.num_intervals


def read_hapmap(spark: SparkSession, source: str, sequence_length: float | None = None, position_col: int = 1, rate_col: int | None = 2, map_col: int | None = None) -> RateMap:
    """A whitespace-separated map with a header: positions with the rate (cM/Mb) from there to the next, or with cumulative cM. Before the first row, and after the last, the rate is missing."""
    raw = spark.read.text(source).withColumn("n", F.monotonically_increasing_id())
    c = F.split(F.trim("value"), r"\s+")
    pick = map_col if map_col is not None else rate_col
    rows = raw.where(F.col("n") > raw.agg(F.min("n")).first()[0]).where(F.trim("value") != "").select(c[position_col].cast("double").alias("p"), c[pick].cast("double").alias("v")).orderBy("p").collect()
    p = np.array([r["p"] for r in rows])
    v = np.array([r["v"] for r in rows])
    rate = np.diff(v) / np.diff(p) / 100 if map_col is not None else v[:-1] * 1e-8
    if p[0] > 0:
        start = v[0] / p[0] / 100 if map_col is not None and v[0] > 0 else np.nan
        p, rate = np.concatenate([[0], p]), np.concatenate([[start], rate])
    if sequence_length is not None and sequence_length > p[-1]:
        p, rate = np.concatenate([p, [sequence_length]]), np.concatenate([rate, [np.nan]])
    return RateMap(p, rate)
