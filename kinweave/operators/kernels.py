"""Kernels that are sequential within one tree or one haplotype: parsimony and the copying model.

Each runs inside one group of ``applyInPandas``, keyed by site or by query haplotype, so groups spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.operators.localtrees import _kernel_rows, _tree, traverse
from kinweave.plans.ancestry import bin_width, trees


def parsimony(kids: dict[int, list[int]], tops: list[int], time: dict[int, float], states: dict[int, int], ancestral: int | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """The fewest changes of state that explain the states of samples (-1: missing): the ancestral state, and changes as (node, place of the change above or -1, state).

    Bottom-up, the best states of a node are those that most of its children share; ties keep all. Top-down, a node changes only if its
    parent's state is not among its best, to the smallest that is.
    """
    known = [s for s in states.values() if s >= 0]
    if not known:
        raise ValueError("all states are missing")
    every = set(range(max(known) + 1 if ancestral is None else max(max(known), ancestral) + 1))
    best: dict[int, set[int]] = {}

    def vote(children: list[int]) -> set[int]:
        count = dict.fromkeys(every, 0)
        for c in children:
            for s in best[c]:
                count[s] += 1
        top = max(count.values())
        return {s for s, n in count.items() if n == top}

    for u in traverse(kids, tops, time, "postorder"):
        if u in states:
            best[u] = every if states[u] < 0 else {states[u]}
        else:
            best[u] = vote(kids.get(u, []))
    root_state = min(vote(tops)) if ancestral is None else ancestral
    changes: list[tuple[int, int, int]] = []
    stack = [(u, root_state, -1) for u in tops]
    while stack:
        u, s, above = stack.pop()
        if s not in best[u]:
            s = min(best[u])
            changes.append((u, above, s))
            above = len(changes) - 1
        stack.extend((c, s, above) for c in kids.get(u, ()))
    return root_state, changes


def map_mutations(g: Genealogy, states: DataFrame, alleles: list[str] | None = None, ancestral_state: int | str | None = None) -> DataFrame:
    """Parsimonious mutations for states of samples at sites: ``site``, ``ancestral_state``, ``place``, ``node``, ``parent`` (place of the mutation above, or -1), ``state``.

    ``states`` has ``site`` (of the genealogy), ``sample``, ``state`` (number, -1 for missing); samples without a row are missing. Sites without any change give one row with
    ``place`` -1. With ``alleles`` the states come as those strings. A given ``ancestral_state`` (number or allele) may put mutations above roots.
    """
    if isinstance(ancestral_state, str):
        ancestral_state = (alleles or []).index(ancestral_state)
    if ancestral_state is not None and (ancestral_state < 0 or alleles is not None and ancestral_state >= len(alleles)):
        raise ValueError("the ancestral state is not among the alleles")
    width = bin_width(g)
    from kinweave.plans.ancestry import binned

    t = binned(trees(g), width)
    s = g.sites.select(F.col("id").alias("site"), "position", F.floor(F.col("position") / width).alias("_bin"))
    where = s.join(t, "_bin").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).select("site", "tree")
    wanted = where.join(states.select("site").distinct(), "site", "left_semi")
    rows = wanted.join(_kernel_rows(g), "tree").join(states.select("site", F.col("sample").alias("node"), "state"), ["site", "node"], "left")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kids, tops, time = _tree(pdf)
        mine = pdf[pdf["sample"]]
        own = {int(u): -1 if x != x else int(x) for u, x in zip(mine["node"], mine["state"].astype("float64"))}
        a, changes = parsimony(kids, tops, time, own, ancestral_state)
        got = [(key[0], a, k, u, p, x) for k, (u, p, x) in enumerate(changes)] or [(key[0], a, -1, -1, -1, a)]
        return pd.DataFrame(got, columns=["site", "ancestral_state", "place", "node", "parent", "state"])

    out = rows.groupBy("site").applyInPandas(fit, "site long, ancestral_state long, place long, node long, parent long, state long")
    if alleles is None:
        return out
    listed = F.array(*[F.lit(a) for a in alleles])
    return out.withColumns({c: F.element_at(listed, F.col(c).cast("int") + 1) for c in ("ancestral_state", "state")})


class CopyingModel:
    """The haplotype copying model over a reference panel (sites x haplotypes): switch rates and mismatch rates by site, -1 is missing.

    Probabilities are normalised site by site; the factors give the likelihood.
    """

    def __init__(self, panel: np.ndarray, switch: np.ndarray, mismatch: np.ndarray, num_alleles: np.ndarray | None = None):
        self.h = np.asarray(panel)
        self.m, self.n = self.h.shape
        self.rho, self.mu = np.asarray(switch, float), np.asarray(mismatch, float)
        self.alleles = np.array([max(2, len(set(r[r >= 0].tolist()))) for r in self.h]) if num_alleles is None else np.asarray(num_alleles)

    def _emit(self, l: int, state: int) -> np.ndarray:
        if state == -1:
            return np.full(self.n, 1 - (self.alleles[l] - 1) * self.mu[l])
        return np.where(self.h[l] == state, 1 - (self.alleles[l] - 1) * self.mu[l], self.mu[l])

    def forward(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, c = np.zeros((self.m, self.n)), np.zeros(self.m)
        last = np.full(self.n, 1 / self.n)
        for l in range(self.m):
            v = (last * (1 - self.rho[l]) + self.rho[l] / self.n) * self._emit(l, query[l])
            c[l] = v.sum()
            f[l] = last = v / c[l]
        return f, c

    def backward(self, query: np.ndarray, factors: np.ndarray) -> np.ndarray:
        b = np.ones((self.m, self.n))
        for l in range(self.m - 2, -1, -1):
            v = b[l + 1] * self._emit(l + 1, query[l + 1])
            b[l] = ((1 - self.rho[l + 1]) * v + self.rho[l + 1] * v.sum() / self.n) / factors[l + 1]
        return b

    def viterbi(self, query: np.ndarray) -> np.ndarray:
        """The most likely sequence of copied haplotypes."""
        switch = np.zeros((self.m, self.n), bool)
        best = np.zeros(self.m, int)
        v = np.full(self.n, 1 / self.n)
        for l in range(self.m):
            stay, jump = v * (1 - self.rho[l] + self.rho[l] / self.n), self.rho[l] / self.n * v.max()
            switch[l] = jump > stay
            v = np.maximum(stay, jump) * self._emit(l, query[l])
            v /= v.max()
            best[l] = int(v.argmax())
        path = np.zeros(self.m, int)
        j = best[-1]
        for l in range(self.m - 1, -1, -1):
            path[l] = j
            if switch[l, j] and l > 0:
                j = best[l - 1]
        return path


def viterbi_paths(model: CopyingModel, queries: DataFrame) -> DataFrame:
    """The copying path of each query haplotype (``query`` id, ``states`` array by site): ``query``, ``path``, ``log_likelihood``."""

    sent = queries.sparkSession.sparkContext.broadcast(model)  # one panel of haplotypes, which a task must hold anyway

    def run(batches):
        model = sent.value
        for pdf in batches:
            out = []
            for q, s in zip(pdf["query"], pdf["states"]):
                a = np.asarray(s)
                out.append((q, model.viterbi(a).tolist(), float(np.log(model.forward(a)[1]).sum())))
            yield pd.DataFrame(out, columns=["query", "path", "log_likelihood"])

    return queries.mapInPandas(run, "query long, path array<int>, log_likelihood double")
