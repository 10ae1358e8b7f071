"""The hierarchy over all parents: roots, depths, loop flags and descendants of every id.

Loops come from :func:`kinweave.operators.hierarchy.cycles`. One task a kind contracts them, numbers the contracted graph by level and finds the depths; blocks of ids
then pass through that graph as sets of bits, spread over tasks that each read the numbered graph from the shared folder. Counting distinct descendants
over several parents has no shorter way than visiting the ancestors of each id; a word of 64 ids is visited at once, and only where one of them leads.

What :func:`lineage` counts is listed by :func:`roots` and :func:`descendants`, and every way down to an id, not only a shortest one, by :func:`all_paths`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.hierarchy import BASE_LINKS, _paths, coded, cycles, decoded, kind_of
from kinweave.plans.staging import stage

#: Bytes of the bit sets a task holds, and links gathered at once.
BIT_BYTES, GATHER = 1 << 28, 1 << 17
#: Ways walked on at once, and ids of ways, or pairs, given out at once.
WALKS, CELLS = 1 << 14, 1 << 20
_INDEX = "kind string, link boolean, a long, b long, level int, depth_min long, depth_max long, loops boolean, via long"


def _rows(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of the ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _levels(child: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """The longest way down to each node of a graph without loops."""
    order = np.argsort(parent, kind="stable")
    down, at = child[order], np.searchsorted(parent[order], np.arange(n + 1))
    left, level = np.bincount(child, minlength=n), np.zeros(n, "int32")
    front, k = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = k
        below, times = np.unique(down[_rows(at[front], at[front + 1])], return_counts=True)
        left[below] -= times
        front, k = below[left[below] == 0], k + 1
    return level


def index(kind: str, ids: np.ndarray, comp: np.ndarray, looped: np.ndarray, child: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    """The loop-contracted graph, numbered so that parents come first (rows ``link``: numbers ``a`` of the child and ``b`` of the parent), and the ids with the
    number of their loop or themselves (``b``), its level, their depths, loop flag and the parent on a shortest way to a root."""
    n = len(ids)
    order = np.argsort(ids)
    ids, comp, looped = ids[order], np.searchsorted(ids[order], comp[order]), looped[order]
    c, p = np.searchsorted(ids, child), np.searchsorted(ids, parent)
    root = np.ones(n, bool)
    root[c] = False
    # shortest ways over the links as they are
    order = np.argsort(p, kind="stable")
    down, at = c[order], np.searchsorted(p[order], np.arange(n + 1))
    near = np.where(root, 0, -1)
    front, k = np.flatnonzero(root), 0
    while len(front):
        k += 1
        front = np.unique(down[_rows(at[front], at[front + 1])])
        front = front[near[front] < 0]
        near[front] = k
    short = (near[c] > 0) & (near[p] == near[c] - 1)
    via = np.full(n, n)
    np.minimum.at(via, c[short], p[short])
    # the contracted graph by levels
    names, cc = np.unique(comp, return_inverse=True)
    m = len(names)
    pair = np.unique(cc[c] * m + cc[p])
    a, b = pair // m, pair % m
    a, b = a[a != b], b[a != b]
    level = _levels(a, b, m)
    order = np.argsort(level, kind="stable")
    number = np.empty(m, "int64")
    number[order] = np.arange(m)
    a, b, level, cc = number[a], number[b], level[order], number[cc]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    far, ring = np.full(m, -1), np.zeros(m, bool)
    far[cc[root]] = 0
    ring[cc[looped]] = True
    cuts = np.searchsorted(level[a], np.arange(level.max(initial=0) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo < hi:
            first = _firsts(a[lo:hi])
            to, up = a[lo:hi][first], far[b[lo:hi]]
            far[to] = np.maximum.reduceat(np.where(up >= 0, up + 1, -1), first)
            ring[to] |= np.logical_or.reduceat(ring[b[lo:hi]], first)
    links = pd.DataFrame({"kind": kind, "link": True, "a": a, "b": b})
    rows = pd.DataFrame({
        "kind": kind, "link": False, "a": ids, "b": cc, "level": pd.array(level[cc], "Int32"), "loops": ring[cc],
        "depth_min": pd.array(near, "Int64"), "depth_max": pd.array(far[cc], "Int64"), "via": pd.array(ids[np.minimum(via, n - 1)], "Int64"),
    })
    rows.loc[near < 0, ["depth_min", "depth_max"]] = pd.NA
    rows.loc[via == n, "via"] = pd.NA
    return pd.concat([links, rows], ignore_index=True)[[x.split()[0] for x in _INDEX.split(", ")]]


def sweep(src: np.ndarray, dst: np.ndarray, level: np.ndarray, seeds: np.ndarray, words: int, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of ``seeds`` (numbers, repeats are seeds of their own): the numbers they lead to over links from ``src`` to ``dst``, themselves included,
    the block, and which of its seeds lead to each number, as bits. ``level`` is nondecreasing and grows, or falls, along every link."""
    n = len(level)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    starts = np.searchsorted(level, np.arange(level.max(initial=0) + 2))
    steps = range(len(starts) - 1)
    if len(src) and src[0] > dst[0]:
        steps = steps[::-1]
    cuts = np.searchsorted(dst, starts)
    for i in range(part * 64 * words, len(seeds), parts * 64 * words):
        block = seeds[i : i + 64 * words]
        live = np.zeros(n, bool)
        live[block] = True
        for s in steps:
            lo, hi = cuts[s], cuts[s + 1]
            if lo < hi:
                live[dst[lo:hi][live[src[lo:hi]]]] = True
        nodes = np.flatnonzero(live)
        where = np.zeros(n, "int32")
        where[nodes] = np.arange(len(nodes))
        used = np.flatnonzero(live[src])
        s2, d2 = where[src[used]], where[dst[used]]
        mine = np.searchsorted(used, cuts)
        bits = np.zeros((len(nodes), words), "uint64")
        k = np.arange(len(block))
        np.bitwise_or.at(bits, (where[block], k // 64), np.uint64(1) << (k % 64).astype("uint64"))
        for s in steps:
            for lo in range(mine[s], mine[s + 1], GATHER):
                hi = min(lo + GATHER, mine[s + 1])
                first = _firsts(d2[lo:hi])
                bits[d2[lo:hi][first]] |= np.bitwise_or.reduceat(bits[s2[lo:hi]], first, axis=0)
        yield nodes, block, bits


def walks(up: np.ndarray, at: np.ndarray, top: np.ndarray, loop: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """Every way from a root to each of ``seeds`` on which no node comes twice: arrays of a row a way, from the root to the seed.

    The parents of ``x`` are ``up[at[x]:at[x + 1]]``, ``top`` tells the roots, and nodes of the same ``loop`` are each other's ancestors, so that only they can come again.
    Ways are walked up in chunks, the last one first; a chunk holds the highest node of each way and its place in the chunk below.
    """
    todo = [(seeds, seeds, None, 1)]
    while todo:
        last, back, below, width = todo.pop()
        n = at[last + 1] - at[last]
        cut = max(1, int(np.searchsorted(np.cumsum(n), WALKS, "right")))
        if cut < len(last):
            todo.append((last[cut:], back[cut:], below, width))
            last, back, n = last[:cut], back[:cut], n[:cut]
        chunk = last, back, below, width
        ends = np.flatnonzero(top[last])
        for lo in range(0, len(ends), max(1, CELLS // width)):
            place, here, way = ends[lo : lo + max(1, CELLS // width)], chunk, []
            while here is not None:
                way.append(here[0][place])
                place, here = here[1][place], here[2]
            yield np.stack(way, axis=1)
        place = np.repeat(np.arange(len(last)), n)
        nxt = up[_rows(at[last], at[last + 1])]
        again = np.zeros(len(nxt), bool)
        check, here, on = np.arange(len(nxt)), chunk, place
        while here is not None and len(check):
            seen, new = here[0][on], nxt[check]
            again[check[seen == new]] = True
            go = (seen != new) & (loop[seen] == loop[new])
            check, on, here = check[go], here[1][on[go]], here[2]
        if not again.all():
            todo.append((nxt[~again], place[~again], chunk, width + 1))


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return ds.dataset(inner, filesystem=where, format="parquet")


def _read(path: str, kind: str) -> tuple[np.ndarray, ...]:
    """From a written index: children, parents; ids in the order of their numbers, their numbers; levels of the numbers; numbers of the roots."""
    import pyarrow.dataset as ds

    data = _dataset(path)
    mine = ds.field("kind") == kind
    links = data.to_table(columns=["a", "b"], filter=mine & ds.field("link"))
    rows = data.to_table(columns=["a", "b", "level", "depth_min"], filter=mine & ~ds.field("link"))
    ids, at, level = (rows[c].to_numpy() for c in ("a", "b", "level"))
    order = np.argsort(at, kind="stable")
    roots = np.sort(at[rows["depth_min"].fill_null(-1).to_numpy() == 0])
    child, parent = (links[c].to_numpy().astype("int32") for c in ("a", "b"))
    at = at[order]
    return child, parent, ids[order], at, level[order][_firsts(at)] if len(at) else level, roots


def _words(n: int) -> int:
    return int(max(1, min(32, BIT_BYTES // (8 * max(1, n)))))


def _tasks(indexed: DataFrame, tasks: int | None) -> list[tuple[str, int, int]]:
    spark = indexed.sparkSession
    sizes = indexed.where("not link").groupBy("kind").count().collect()
    return [(k, i, p) for k, n in sizes for p in [tasks or max(spark.sparkContext.defaultParallelism, n // 100_000)] for i in range(p)]


def _spread(indexed: DataFrame, todo: list[tuple[str, int, int]], work, schema: str) -> DataFrame:
    """``work`` on each of the tasks, which are given by kind, part and number of parts."""
    if not todo:
        return indexed.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"].tolist():
                yield from work(*todo[i])

    return indexed.sparkSession.range(0, len(todo), 1, len(todo)).mapInPandas(run, schema)


def indexed_links(links: DataFrame, base_links: int = BASE_LINKS) -> DataFrame:
    """The written index of all kinds (see :func:`index`)."""
    links = stage(links.select("kind", "child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct(), "all_links")
    kinds = tuple(sorted(r[0] for r in links.select("kind").distinct().collect()))
    ids = links.select("kind", F.col("child").alias("id")).unionByName(links.select("kind", F.col("parent").alias("id"))).distinct()
    if kinds:
        found = cycles(links, base_links, kinds=kinds).select("kind", F.col("member_id").alias("id"), "cycle_id")
        ids = ids.join(found, ["kind", "id"], "left")
    else:
        ids = ids.withColumn("cycle_id", F.lit(None).cast("long"))
    ids = ids.select("kind", F.col("id").alias("child"), F.coalesce("cycle_id", "id").alias("parent"), F.when(F.col("cycle_id").isNull(), 1).otherwise(2).alias("role"))

    def number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        role, a, b = (pdf[c].to_numpy() for c in ("role", "child", "parent"))
        own = role > 0
        return index(key[0], a[own], b[own], role[own] == 2, a[~own], b[~own])

    return stage(links.withColumn("role", F.lit(0)).unionByName(ids).groupBy("kind").applyInPandas(number, _INDEX), "index")


def all_ids(nodes: DataFrame, edges: DataFrame, individuals: DataFrame) -> DataFrame:
    """Every node (also children of edges that nodes does not hold) and individual, with or without links: ``kind``, ``id``; NULL and -1 are no ids."""
    nodes = nodes.select("id").unionByName(edges.select(F.col("child").alias("id"))).select(F.lit("node").alias("kind"), "id")
    return nodes.unionByName(individuals.select(F.lit("individual").alias("kind"), "id")).where("id <> -1")


def _alone(ids: DataFrame, indexed: DataFrame) -> DataFrame:
    """The ids that no link of the index holds."""
    held = indexed.where("not link").select("kind", F.col("a").alias("id"))
    return ids.where("kind is not null and id is not null").select("kind", "id").distinct().join(held, ["kind", "id"], "left_anti")


def lineage(links: DataFrame, base_links: int = BASE_LINKS, tasks: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The hierarchy over all parents, for every id that is a child or a parent, and every one of ``ids`` (``kind``, ``id``): without links it is a root alone.

    Columns: ``kind``, ``id``; ``loops`` (some way up never ends: the id or an ancestor is on a loop); ``n_roots`` (roots reached, a root reaches itself);
    ``depth_min`` (fewest links to a root) and ``depth_max`` (most links to a root between different loops, links within a loop count none; the longest
    way where ``loops`` is false); ``path`` (ids of a shortest way from a root, the smallest parent where several are equally near), NULL as the depths
    where no root is reached; ``n_descendants`` (other ids that reach the id). NULL ends are left out, repeated rows count once.
    """
    indexed = indexed_links(links, base_links)
    path = indexed._staged_path

    def count(kind: str, part: int, parts: int) -> Iterator[pd.DataFrame]:
        child, parent, _, at, level, roots = _read(path, kind)
        for src, dst, seeds, name in ((child, parent, at, "below"), (parent, child, roots, "above")):
            got = np.zeros(len(level), "int64")
            for nodes, _, bits in sweep(src, dst, level, seeds, _words(len(level)), part, parts):
                got[nodes] += np.bitwise_count(bits).sum(axis=1, dtype="int64")
            some = np.flatnonzero(got)
            yield pd.DataFrame({"kind": kind, "b": some, "below": 0, "above": 0} | {name: got[some]})

    counts = _spread(indexed, _tasks(indexed, tasks), count, "kind string, b long, below long, above long")
    counts = stage(counts, "counts").groupBy("kind", "b").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    rows = indexed.where("not link").withColumnRenamed("a", "id")
    kinds = tuple(sorted({k for k, _, _ in _tasks(indexed, 1)})) or ("node",)
    forest = coded(rows.where("via is not null").select("kind", F.col("id").alias("child"), F.col("via").alias("parent")), kinds)
    forest = stage(forest.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.array("child").alias("steps")), "forest")
    ways = _paths(forest, base_links).select(
        kind_of(F.col("node"), kinds).alias("kind"), decoded(F.col("node"), kinds).alias("id"), F.transform(F.reverse(F.concat("steps", F.array("up"))), lambda x: decoded(x, kinds)).alias("path")
    )
    out = rows.join(counts, ["kind", "b"], "left").join(ways, ["kind", "id"], "left").select(
        "kind", "id", "loops", F.coalesce("above", F.lit(0)).alias("n_roots"), "depth_min", "depth_max",
        F.when(F.col("depth_min") == 0, F.array("id")).otherwise(F.col("path")).alias("path"), (F.col("below") - 1).alias("n_descendants"),
    )
    if ids is None:
        return out
    none = F.lit(0).cast("long")
    return out.unionByName(_alone(ids, indexed).select(
        "kind", "id", F.lit(False).alias("loops"), F.lit(1).cast("long").alias("n_roots"), none.alias("depth_min"), none.alias("depth_max"), F.array("id").alias("path"), none.alias("n_descendants"),
    ))


def roots(links: DataFrame, base_links: int = BASE_LINKS, tasks: int | None = None) -> DataFrame:
    """Every root that an id reaches over all parents, a root also itself: ``kind``, ``id``, ``root``."""
    indexed = indexed_links(links, base_links)
    path = indexed._staged_path

    def pairs(kind: str, part: int, parts: int) -> Iterator[pd.DataFrame]:
        child, parent, ids, at, level, tops = _read(path, kind)
        starts = np.searchsorted(at, np.arange(len(level) + 1))
        for nodes, block, bits in sweep(parent, child, level, tops, min(4, _words(len(level))), part, parts):
            for lo in range(0, len(nodes), 1 << 14):
                some, which = np.nonzero(np.unpackbits(bits[lo : lo + (1 << 14)].view("uint8"), axis=1, bitorder="little"))
                some = nodes[lo : lo + (1 << 14)][some]
                mine = _rows(starts[some], starts[some + 1])
                yield pd.DataFrame({"kind": kind, "id": ids[mine], "root": np.repeat(ids[starts[block[which]]], starts[some + 1] - starts[some])})

    return _spread(indexed, _tasks(indexed, tasks), pairs, "kind string, id long, root long")


def _spans(weight: np.ndarray, most: int = CELLS) -> Iterator[slice]:
    """Stretches of at most ``most`` in all, or of one."""
    ends, lo = np.cumsum(weight), 0
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield slice(lo, hi)
        lo = hi


def descendants(links: DataFrame, base_links: int = BASE_LINKS, tasks: int | None = None) -> DataFrame:
    """Every other id that reaches an id over all parents: ``kind``, ``id``, ``descendant``; as many rows an id as ``n_descendants`` of :func:`lineage`."""
    indexed = indexed_links(links, base_links)
    path = indexed._staged_path

    def pairs(kind: str, part: int, parts: int) -> Iterator[pd.DataFrame]:
        child, parent, ids, at, level, _ = _read(path, kind)
        starts = np.searchsorted(at, np.arange(len(level) + 1))
        size = np.diff(starts)
        for nodes, block, bits in sweep(child, parent, level, np.arange(len(level)), min(4, _words(len(level))), part, parts):
            for lo in range(0, len(nodes), 1 << 14):
                some, which = np.nonzero(np.unpackbits(bits[lo : lo + (1 << 14)].view("uint8"), axis=1, bitorder="little"))
                over, under = nodes[lo : lo + (1 << 14)][some], block[which]
                for x in _spans(size[under]):  # all members of a loop below, then all of a loop above
                    low = _rows(starts[under[x]], starts[under[x] + 1])
                    high = np.repeat(over[x], size[under[x]])
                    for y in _spans(size[high]):
                        a, b = ids[_rows(starts[high[y]], starts[high[y] + 1])], np.repeat(ids[low[y]], size[high[y]])
                        yield pd.DataFrame({"kind": kind, "id": a[a != b], "descendant": b[a != b]})

    return _spread(indexed, _tasks(indexed, tasks), pairs, "kind string, id long, descendant long")


def all_paths(links: DataFrame, base_links: int = BASE_LINKS, tasks: int | None = None, ids: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Every path, not only a shortest: ``kind``, ``id``, ``root``, ``depth`` (links of the path), ``path`` (ids from the root to the id, none of them twice, over any parents).

    ``ids`` are as in :func:`lineage`; ``wanted`` (``kind``, ``id``) leaves the paths to other ids out. An id that reaches no root has no path. The number of paths grows
    much faster than that of links, so they are given out as they are walked, and none is held. Each task reads the links of a kind.
    """
    import pyarrow as pa

    links = stage(links.select("kind", "child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct(), "links")
    indexed = indexed_links(links, base_links)
    seeds = indexed.where("not link and depth_min is not null").select("kind", F.col("a").alias("id"))
    if wanted is not None:
        seeds = seeds.join(wanted.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    seeds = stage(seeds, "seeds")
    spark, schema = links.sparkSession, "kind string, id long, root long, depth long, path array<long>"
    few = 8 * spark.sparkContext.defaultParallelism  # ids differ widely in their paths
    todo = [(k, i, p) for k, n in seeds.groupBy("kind").count().collect() for p in [min(n, tasks or max(few, n // 10_000))] for i in range(p)]
    link_path, index_path, seed_path = links._staged_path, indexed._staged_path, seeds._staged_path

    def ways(kind: str, part: int, parts: int) -> Iterator[np.ndarray]:
        import pyarrow.dataset as ds

        mine = ds.field("kind") == kind
        rows = _dataset(index_path).to_table(columns=["a", "b", "depth_min"], filter=mine & ~ds.field("link"))
        names, loop, near = rows["a"].to_numpy(), rows["b"].to_numpy(), rows["depth_min"].fill_null(-1).to_numpy()
        order = np.argsort(names)
        names, loop, near = names[order], loop[order], near[order]
        table = _dataset(link_path).to_table(columns=["child", "parent"], filter=mine)
        child, parent = (np.searchsorted(names, table[c].to_numpy()) for c in ("child", "parent"))
        child, parent = child[near[parent] >= 0], parent[near[parent] >= 0]
        order = np.lexsort((parent, child))
        at = np.searchsorted(child[order], np.arange(len(names) + 1))
        to = np.searchsorted(names, _dataset(seed_path).to_table(columns=["id"], filter=mine)["id"].to_numpy())
        to = to[np.lexsort((to, loop[to]))][part::parts]  # numbers follow the levels, so each task gets ids of all levels
        for way in walks(parent[order].astype("int32"), at, near == 0, loop, to.astype("int32")):
            yield names[way]

    def batch(kind: str, some: list[np.ndarray]) -> pa.RecordBatch:
        width = np.repeat([w.shape[1] for w in some], [len(w) for w in some])
        flat, ends = np.concatenate([w.ravel() for w in some]), np.concatenate([[0], np.cumsum(width)])
        cells = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat))
        columns = [pa.repeat(kind, len(width)), pa.array(flat[ends[1:] - 1]), pa.array(flat[ends[:-1]]), pa.array(width - 1), cells]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "root", "depth", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in given.column(0).to_pylist():
                some, held = [], 0
                for way in ways(*todo[i]):
                    some.append(way)
                    held += way.size
                    if held >= CELLS:
                        yield batch(todo[i][0], some)
                        some, held = [], 0
                if some:
                    yield batch(todo[i][0], some)

    out = spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, schema) if todo else spark.createDataFrame([], schema)
    if ids is None:
        return out
    lone = _alone(ids, indexed)
    if wanted is not None:
        lone = lone.join(wanted.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    return out.unionByName(lone.select("kind", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.array("id").alias("path")))
