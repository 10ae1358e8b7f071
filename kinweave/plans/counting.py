"""Sums over the samples below every node, by sweeping genome shards.

A shard starts from the whole sums of its first tree and then follows the edges that end and begin at each breakpoint, changing the sums on the way to the root; it hands out
changes only. A node whose sum stays the same over a shard adds nothing but its first and last value, and these cancel where shards meet. No path is listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.plans.staging import measured as stage

#: Nodes up to which the trees of a shard are held by one task (some hundred bytes a node and set).
SWEEP_NODES = 2_000_000
#: Edges that begin in a shard, at most on average, if there are more shards than the cluster has use for.
SHARD_EDGES = 200_000


def first_sums(parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` over each node and all below it, level by level from the deepest."""
    n = len(parent)
    depth, up = (parent >= 0).astype("int64"), np.where(parent >= 0, parent, np.arange(n))
    while True:
        more = depth + depth[up]
        if (more == depth).all():
            break
        depth, up = more, up[up]
    out = own.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        if len(level):
            np.add.at(out, parent[level], out[level])
    return out


def sweep(start: float, end: float, left: np.ndarray, right: np.ndarray, parent: np.ndarray, child: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of the sums within [start, end): nodes, positions, differences. Edges are clipped to the shard, nodes numbered from 0; ``own`` has a row a node."""
    n = len(own)
    up = np.full(n, -1)
    first = left <= start
    up[child[first]] = parent[first]
    sums = first_sums(up, own)
    nodes, places, changes = [], [], []

    def emit(which: np.ndarray, at: float, by: np.ndarray) -> None:
        some = (by != 0).any(axis=1)
        nodes.append(which[some])
        places.append(np.full(some.sum(), at))
        changes.append(by[some])

    every = np.arange(n)
    emit(every, start, sums)
    ends, begins = np.argsort(right, kind="stable"), np.argsort(left, kind="stable")
    begins = begins[left[begins] > start]
    gone, come = right[ends], left[begins]  # in order
    for at in np.unique(np.concatenate([right[right < end], left[left > start]])):
        out = ends[np.searchsorted(gone, at) : np.searchsorted(gone, at, side="right")]
        into = begins[np.searchsorted(come, at) : np.searchsorted(come, at, side="right")]
        if 8 * (len(out) + len(into)) > n:  # much changes: add up anew
            up[child[out]] = -1
            up[child[into]] = parent[into]
            new = first_sums(up, own)
            emit(every, at, new - sums)
            sums = new
            continue
        before: dict[int, np.ndarray] = {}

        def carry(c: int, p: int, sign: int) -> None:
            v = sign * sums[c]
            while p >= 0:
                if p not in before:
                    before[p] = sums[p].copy()
                sums[p] += v
                p = up[p]

        for e in out:
            carry(child[e], parent[e], -1)
            up[child[e]] = -1
        for e in into:
            carry(child[e], parent[e], 1)
            up[child[e]] = parent[e]
        if before:
            which = np.fromiter(before, dtype="int64", count=len(before))
            emit(which, at, sums[which] - np.stack(list(before.values())))
    emit(every, end, -sums)
    return np.concatenate(nodes), np.concatenate(places), np.concatenate(changes)


def changes(g: Genealogy, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Where the sums of ``weights`` (``sample`` and ``columns``) below nodes change, and by how much: ``node``, ``pos``, ``columns`` (doubles); repeated places are to be added up."""
    L = float(g.sequence_length)
    edges, tree = g.edges.agg(F.count(F.lit(1)), F.sum(F.col("right") - F.col("left")) / L).first()  # all edges, and those of a tree, which each shard reads
    wanted = max(-(-edges // SHARD_EDGES), 4 * g.spark.sparkContext.defaultParallelism)
    n = max(1, min(wanted, int(2 * edges / max(1.0, tree or 1.0))))
    cuts = sorted({0.0, L, *(g.edges.approxQuantile("left", [k / n for k in range(1, n)], 0.01) if n > 1 else ())})
    bounds = F.array(*[F.lit(c) for c in cuts])
    inside = lambda lo, hi: F.filter(F.sequence(F.lit(0), F.lit(len(cuts) - 2)), lambda s: (F.get(bounds, s) < hi) & (F.get(bounds, s + 1) > lo))
    none = [F.lit(None).cast("double").alias(c) for c in columns]
    e = g.edges.select(F.explode(inside(F.col("left"), F.col("right"))).alias("shard"), "left", "right", "parent", "child", *none)
    every = F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 2))).alias("shard")
    blank = F.lit(None).cast("double")
    w = weights.select(every, blank.alias("left"), blank.alias("right"), F.lit(-1).cast("long").alias("parent"), F.col("sample").alias("child"), *[F.col(c).cast("double").alias(c) for c in columns])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = cuts[key[0]], cuts[key[0] + 1]
        tip = pdf["left"].isna().to_numpy()
        ids = np.unique(np.concatenate([pdf["child"].to_numpy(), pdf["parent"].to_numpy()[~tip]]))
        at = lambda c, m: np.searchsorted(ids, pdf[c].to_numpy()[m])
        own = np.zeros((len(ids), len(columns)))
        own[at("child", tip)] = np.nan_to_num(pdf.loc[tip, columns].to_numpy())
        lo, hi = np.maximum(pdf["left"].to_numpy()[~tip], start), np.minimum(pdf["right"].to_numpy()[~tip], end)
        nodes, places, by = sweep(start, end, lo, hi, at("parent", ~tip), at("child", ~tip), own)
        return pd.DataFrame({"node": ids[nodes], "pos": places, **{c: by[:, i] for i, c in enumerate(columns)}})

    out = e.unionByName(w).groupBy("shard").applyInPandas(run, "node long, pos double, " + ", ".join(f"{c} double" for c in columns))
    return stage(out, "changes")
