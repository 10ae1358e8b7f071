"""Tree shapes: numbers of them, canonical forms, generated trees and the counting of topologies among sample sets."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import comb, factorial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import Genealogy, from_rows


def partitions(n: int, least: int = 1) -> Iterator[tuple[int, ...]]:
    """Ways to write ``n`` as a sum of rising parts."""
    if n == 0:
        yield ()
    for first in range(least, n + 1):
        for rest in partitions(n - first, first):
            yield (first, *rest)


@cache
def num_shapes(n: int) -> int:
    """Unlabelled rooted trees with ``n`` leaves and no unary nodes."""
    if n <= 1:
        return n
    total = 0
    for p in partitions(n):
        if len(p) == 1:
            continue
        ways = 1
        for size, k in Counter(p).items():
            ways *= comb(num_shapes(size) + k - 1, k)
        total += ways
    return total


Shape = tuple


def all_shapes(n: int) -> Iterator[Shape]:
    """Unlabelled trees as nested tuples in a fixed order; a leaf is ()."""
    if n == 1:
        yield ()
        return
    for p in partitions(n):
        if len(p) == 1:
            continue
        groups = [(size, len(list(g))) for size, g in itertools.groupby(p)]
        choices = [list(itertools.combinations_with_replacement(list(all_shapes(size)), k)) for size, k in groups]
        for pick in itertools.product(*choices):
            yield tuple(x for part in pick for x in part)


def leaves_of(shape: Shape) -> int:
    return 1 if not shape else sum(map(leaves_of, shape))


def symmetries(shape: Shape) -> int:
    """Orderings of equal subtrees that give the same labelled tree."""
    out = 1
    for sub, k in Counter(shape).items():
        out *= factorial(k) * symmetries(sub) ** k
    return out


def num_labellings(shape: Shape) -> int:
    return factorial(leaves_of(shape)) // symmetries(shape)


def num_trees(n: int) -> int:
    """Labelled rooted trees with ``n`` leaves and no unary nodes."""
    return sum(num_labellings(s) for s in all_shapes(n))


def all_labellings(shape: Shape, labels: tuple = ()) -> Iterator[tuple]:
    """Labelled trees of a shape as nested tuples, each once; leaves are labels 0 .. n-1 by default."""
    labels = labels or tuple(range(leaves_of(shape)))
    if not shape:
        yield labels[0]
        return

    def place(subs: tuple, left: tuple, last: tuple | None) -> Iterator[tuple]:
        if not subs:
            yield ()
            return
        size = leaves_of(subs[0])
        for chosen in itertools.combinations(left, size):
            if last is not None and last[0] == subs[0] and chosen < last[1]:
                continue
            rest = tuple(x for x in left if x not in chosen)
            for own in all_labellings(subs[0], chosen):
                for others in place(subs[1:], rest, (subs[0], chosen)):
                    yield (own, *others)

    yield from place(shape, labels, None)


def all_trees(n: int) -> Iterator[tuple]:
    for s in all_shapes(n):
        yield from all_labellings(s)


def rank(tree) -> tuple[int, int]:
    """Place of a labelled tree's shape among the shapes of its size, and of its labelling among those of the shape, in the orders used here."""
    c = canonical(tree)
    s = shape_of(c)
    n = leaves_of(s)
    shape_rank = next(i for i, x in enumerate(all_shapes(n)) if _same(x, s))
    return shape_rank, next(i for i, x in enumerate(all_labellings(list(all_shapes(n))[shape_rank])) if canonical(x) == c)


def unrank(n: int, shape_rank: int, label_rank: int):
    s = next(itertools.islice(all_shapes(n), shape_rank, None))
    return next(itertools.islice(all_labellings(s), label_rank, None))


def shape_of(tree) -> Shape:
    return () if not isinstance(tree, tuple) else tuple(shape_of(x) for x in tree)


def _norm(s: Shape):
    return tuple(sorted((_norm(x) for x in s), key=lambda x: (leaves_of(x), repr(x))))


def _same(a: Shape, b: Shape) -> bool:
    return _norm(a) == _norm(b)


def canonical(tree):
    """Nested tuples with subtrees sorted, so that equal trees are equal values."""
    if not isinstance(tree, tuple):
        return tree
    return tuple(sorted((canonical(x) for x in tree), key=lambda x: (leaves_of(shape_of(x)), repr(x))))


def _genealogy(spark: SparkSession, tree, span: float, branch: float) -> Genealogy:
    n = leaves_of(shape_of(tree))
    times: dict[int, float] = {}
    edges = []
    fresh = itertools.count(n)

    def build(t) -> tuple[int, float]:
        if not isinstance(t, tuple):
            times[t] = 0.0
            return t, 0.0
        kids = [build(x) for x in t]
        u = next(fresh)
        h = max(k[1] for k in kids) + branch
        times[u] = h
        edges.extend((0.0, span, u, k[0]) for k in kids)
        return u, h

    build(tree)
    return from_rows(spark, span, nodes=[(int(u < n), times[u]) for u in sorted(times)], edges=edges)


def star(spark: SparkSession, n: int, span: float = 1.0, branch: float = 1.0) -> Genealogy:
    return _genealogy(spark, tuple(range(n)), span, branch)


def comb_tree(spark: SparkSession, n: int, span: float = 1.0, branch: float = 1.0) -> Genealogy:
    t = n - 1
    for i in range(n - 2, -1, -1):
        t = (i, t)
    return _genealogy(spark, t, span, branch)


def balanced(spark: SparkSession, n: int, arity: int = 2, span: float = 1.0, branch: float = 1.0) -> Genealogy:
    def split(a: int, b: int):
        if b - a == 1:
            return a
        k = min(arity, b - a)
        cuts = [a + (b - a) * i // k for i in range(k + 1)]
        return tuple(split(x, y) for x, y in zip(cuts, cuts[1:]))

    return _genealogy(spark, split(0, n), span, branch)


def random_binary(spark: SparkSession, n: int, seed: int = 0, span: float = 1.0, branch: float = 1.0) -> Genealogy:
    """Uniform over labelled binary trees: leaves are hung one by one on a random edge or above the root."""
    rng = random.Random(seed)
    t = 0
    for leaf in range(1, n):
        spots = 2 * leaf - 1
        k = rng.randrange(spots)

        def hang(x, k: int):
            if k == 0:
                return (x, leaf), -1
            k -= 1
            if isinstance(x, tuple):
                a, k = hang(x[0], k)
                if k < 0:
                    return (a, x[1]), -1
                b, k = hang(x[1], k)
                return (a, b), k
            return x, k

        t, _ = hang(t, k)
    return _genealogy(spark, t, span, branch)


def split_polytomies(tree, rng: random.Random):
    """A labelled tree with every polytomy resolved into random binary nodes."""
    if not isinstance(tree, tuple):
        return tree
    parts = [split_polytomies(x, rng) for x in tree]
    while len(parts) > 2:
        a = parts.pop(rng.randrange(len(parts)))
        b = parts.pop(rng.randrange(len(parts)))
        parts.append((a, b))
    return tuple(parts)


def embedded(kids: dict[int, list[int]], tops: list[int], label: dict[int, int], order: list[int]) -> Counter:
    """Topologies that one sample of each set of any combination of sets spans in a tree: Counter of (sets, canonical topology).

    For each node the partial topologies below it are counted; a node joins choices of disjoint sets from two or more children.
    """
    below: dict[int, Counter] = {}

    def join(parts: list[Counter]) -> Counter:
        state: Counter = Counter({((), ()): 1})
        for p in parts:
            nxt = Counter(state)
            for (used, trees_), n in state.items():
                for (sets, t), m in p.items():
                    if not set(used) & set(sets):
                        nxt[tuple(sorted(used + sets)), (*trees_, t)] += n * m
            state = nxt
        out: Counter = Counter()
        for (used, trees_), n in state.items():
            if len(trees_) == 1:
                out[used, trees_[0]] += n
            elif len(trees_) > 1:
                out[used, canonical(trees_)] += n
        return out

    total: Counter = Counter()
    for u in order:
        parts = [below.pop(c) for c in kids.get(u, ())]
        if u in label:
            parts.append(Counter({((label[u],), label[u]): 1}))
        below[u] = join(parts)
    for r in tops:
        total.update(below[r])
    return total


def count_topologies(g: Genealogy, sets: DataFrame) -> DataFrame:
    """Per tree, combination of sample sets and topology, the number of ways to pick one sample of each set that have it: ``tree``, ``sets``, ``topology``, ``n``.

    ``sets`` has ``sample`` and ``set``. The number of topologies grows fast with the number of sets; use few.
    """
    from kinweave.operators.localtrees import _kernel_rows, _tree, traverse

    rows = _kernel_rows(g).join(sets.select(F.col("sample").alias("node"), F.col("set").cast("double").alias("set")), "node", "left")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kids, tops, time = _tree(pdf)
        label = {int(u): int(s) for u, s in zip(pdf["node"], pdf["set"]) if s == s}
        got = embedded(kids, tops, label, traverse(kids, tops, time, "postorder"))
        return pd.DataFrame([(key[0], ",".join(map(str, s)), repr(t).replace(" ", ""), n) for (s, t), n in got.items()], columns=["tree", "sets", "topology", "n"])

    return rows.groupBy("tree").applyInPandas(count, "tree long, sets string, topology string, n long")
