"""Runs of repeated consecutive events, encoded by chunk and merged across chunk boundaries.

Events are range-sorted once; each sorted chunk encodes its runs locally and hands out complete runs, the runs of its first and
last stretch, and one summary. A parallel prefix merge over the summaries (one row a chunk) tells each chunk the stretch that was open
before it; then the runs at the chunk ends join what they continue. A stretch is a longest succession of rows with one entity
and one value.

The merge is associative because the open run of a stretch always holds the largest end of the stretch so far: a new run of the
stretch starts beyond that end, and ends beyond it too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.staging import stage

_PIECE = "chunk long, piece long, last_piece long, whole boolean, tail boolean, entity long, value long, from double, to double, n_rows long, first_id long, last_id long"


def _bounds(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new)) - 1


def encode_chunk(chunk: int, entity: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, slack: float) -> dict[str, np.ndarray]:
    """The runs of one sorted chunk. Complete runs of one row are left out; those of the first and last stretch are kept whole."""
    n = len(ids)
    if n:
        again = np.zeros(n, bool)  # the same row delivered twice stands next to itself
        again[1:] = (entity[1:] == entity[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (ids[1:] == ids[:-1]) & (value[1:] == value[:-1])
        keep = ~again
        entity, value, left, right, ids = entity[keep], value[keep], left[keep], right[keep], ids[keep]
        n = len(ids)
    if not n:
        return {k: np.array([], dtype=t) for k, t in (("chunk", "int64"), ("piece", "int64"), ("last_piece", "int64"), ("whole", bool), ("tail", bool), ("entity", "int64"), ("value", "int64"), ("from", float), ("to", float), ("n_rows", "int64"), ("first_id", "int64"), ("last_id", "int64"))}
    turn = np.ones(n, bool)
    turn[1:] = (entity[1:] != entity[:-1]) | (value[1:] != value[:-1])
    stretch = np.cumsum(turn) - 1
    # running maximum of right within a stretch: ranks make one increasing sequence of all stretches
    order = np.unique(right, return_inverse=True)
    rank = order[1] + stretch.astype("int64") * len(order[0])
    reached = order[0][np.maximum.accumulate(rank) - stretch.astype("int64") * len(order[0])]
    new = turn.copy()
    new[1:] |= left[1:] > reached[:-1] + slack
    first, last = _bounds(new)
    s = stretch[first]
    rim = (s == 0) | (s == s[-1])
    size = last - first + 1
    out = rim | (size > 1)
    piece = np.arange(len(first))
    return {k: v[out] for k, v in {
        "chunk": np.full(len(first), chunk, "int64"), "piece": piece, "last_piece": np.full(len(first), len(first) - 1, "int64"), "whole": np.full(len(first), s[-1] == 0),
        "tail": s == s[-1], "entity": entity[first], "value": value[first], "from": left[first], "to": reached[last], "n_rows": size, "first_id": ids[first], "last_id": ids[last],
        "_head": s == 0,
    }.items()}


def _encode(slack: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]  # one sorted chunk: its size is set by the number of range partitions
        if not held:
            return
        t = pa.Table.from_batches(held)
        col = lambda c: t.column(c).to_numpy()
        got = encode_chunk(TaskContext.get().partitionId(), col("entity"), col("value"), col("left"), col("right"), col("id"), slack)
        yield pa.RecordBatch.from_pydict({**{k: got[k] for k in got if k != "_head"}, "head": got["_head"]})

    return encode


def collapse_runs(events: DataFrame, entity: str, value: str, left: str = "left", right: str = "right", id: str = "id", slack: float = 3.0, least: int = 2, rows_per_chunk: int = 1_000_000, block: int | None = None) -> DataFrame:
    """Each run of consecutive events of an entity with one value as one row.

    Events are ordered by (``left``, ``right``, ``id``) within the entity; an event goes on with the run before it if its value is the same and it
    starts at most ``slack`` beyond the largest ``right`` of that run's rows. Columns: ``entity``, ``value``, ``n_rows``, ``from``, ``to``,
    ``span``, ``first_id``, ``last_id``; runs of fewer than ``least`` rows are left out (``least`` must be 2 or more).

    Rows with NULL in any of the five columns, or NaN ends, are left out. A row repeated with the same id and content counts once. Ties are
    ordered by id. Other columns are ignored and may have any name. An empty table gives no rows.
    """
    e = events.select(F.col(entity).cast("long").alias("entity"), F.col(left).cast("double").alias("left"), F.col(right).cast("double").alias("right"), F.col(id).cast("long").alias("id"), F.col(value).cast("long").alias("value"))
    e = e.where(F.expr("entity is not null and value is not null and id is not null and `left` is not null and `right` is not null and not isnan(`left`) and not isnan(`right`)"))
    spark = events.sparkSession
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // rows_per_chunk), 1)
    sorted_ = e.repartitionByRange(chunks, "entity", "left", "right", "id", "value").sortWithinPartitions("entity", "left", "right", "id", "value")
    pieces = stage(sorted_.mapInArrow(_encode(slack), _PIECE + ", head boolean"), "pieces")
    # the prefix merge: a chunk that is one stretch hands on the larger end; any other chunk starts afresh with its last stretch
    ends = pieces.where("tail").groupBy("chunk").agg(
        F.max_by(F.struct("entity", "value", F.col("from").alias("start"), "piece", "whole"), "piece").alias("at"), F.max("to").alias("to"),
    ).select("chunk", "at.entity", "at.value", "to", "at.start", "at.whole", F.col("chunk").alias("run_chunk"), F.col("at.piece").alias("run_piece"))  # one row a chunk
    open_ = prefixes(stage(ends, "ends"), slack, block).select("chunk", F.col("entity").alias("_e"), F.col("value").alias("_v"), F.col("to").alias("reach"), "run_chunk", "run_piece")
    rim = pieces.where("head or tail").join(open_, "chunk", "left")  # chunks are of equal size, so this key is even
    goes_on = F.coalesce(F.col("head") & (F.col("_e") == F.col("entity")) & (F.col("_v") == F.col("value")) & (F.col("from") <= F.col("reach") + slack), F.lit(False))
    rim = rim.withColumn("rc", F.when(goes_on, F.col("run_chunk")).otherwise(F.col("chunk"))).withColumn("rp", F.when(goes_on, F.col("run_piece")).otherwise(F.col("piece")))
    joined = rim.groupBy("rc", "rp", "entity", "value").agg(
        F.sum("n_rows").alias("n_rows"), F.min("from").alias("from"), F.max("to").alias("to"),
        F.min_by("first_id", F.struct("chunk", "piece")).alias("first_id"), F.max_by("last_id", F.struct("chunk", "piece")).alias("last_id"),
    ).drop("rc", "rp")
    inner = pieces.where("not head and not tail").select(*joined.columns)
    runs = inner.unionByName(joined).where(F.col("n_rows") >= least)
    return runs.select("entity", "value", "n_rows", "from", "to", (F.col("to") - F.col("from")).alias("span"), "first_id", "last_id")


_SUMMARY = ["entity", "value", "to", "start", "whole", "run_chunk", "run_piece"]
_TYPES = "entity long, value long, to double, start double, whole boolean, run_chunk long, run_piece long"


def combine(a: tuple | None, b: tuple, slack: float) -> tuple:
    """The summary of two neighbouring pieces of the order; associative.

    A summary is the last stretch (entity, value), how far it reaches, where its open run starts, whether the piece is one stretch, and the chunk and piece
    in which the open run began.
    """
    if a is None:
        return b
    if not (b[4] and a[:2] == b[:2]):
        return (*b[:4], False, *b[5:])
    run = (a[3], a[5], a[6]) if b[3] <= a[2] + slack else (b[3], b[5], b[6])
    return (b[0], b[1], max(a[2], b[2]), run[0], a[4], run[1], run[2])


def prefixes(ends: DataFrame, slack: float, block: int | None = None) -> DataFrame:
    """The combined summary of all chunks before each chunk (none for the first): ``chunk`` and the summary.

    Blocks of ``block`` summaries (by default the root of their number, 4 at least) are folded in parallel, the blocks' summaries get their prefixes in the same way, and each block is then scanned from its prefix.
    """
    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state = None
        if "c_entity" in pdf and pdf["c_entity"].notna().any():
            r = pdf.iloc[0]
            state = tuple(r[f"c_{c}"] for c in _SUMMARY)
            state = (int(state[0]), int(state[1]), float(state[2]), float(state[3]), bool(state[4]), int(state[5]), int(state[6]))
        rows = []
        for c, *own in pdf[["chunk", *_SUMMARY]].itertuples(index=False):
            if state is not None:
                rows.append((c, *state))
            state = combine(state, tuple(own), slack)
        return pd.DataFrame(rows, columns=["chunk", *_SUMMARY])

    n = ends.count()
    block = block or max(4, math.isqrt(n))
    if n <= block:
        return ends.groupBy(F.lit(0).alias("all")).applyInPandas(scan, "chunk long, " + _TYPES)
    numbered = ends.withColumn("b", F.floor(F.col("chunk") / block))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = None
        for own in pdf.sort_values("chunk")[_SUMMARY].itertuples(index=False):
            state = combine(state, tuple(own), slack)
        return pd.DataFrame([(key[0], *state)], columns=["chunk", *_SUMMARY])

    folded = stage(numbered.groupBy("b").applyInPandas(fold, "chunk long, " + _TYPES), "blocks")
    before = prefixes(folded, slack, block).select(F.col("chunk").alias("b"), *[F.col(c).alias(f"c_{c}") for c in _SUMMARY])
    return numbered.join(before, "b", "left").groupBy("b").applyInPandas(scan, "chunk long, " + _TYPES)
