"""Genealogies of our own and plain-Python definitions of what the operators compute: local trees as parent maps, everything else by walking them."""

import itertools
import math

from kinweave.model import from_rows


def build(spark, length, times, samples, edges, sites=(), mutations=(), migrations=(), **more):
    flags = [1 if i in samples else 0 for i in range(len(times))]
    return from_rows(
        spark, float(length), nodes=[(f, float(t)) for f, t in zip(flags, times)], edges=[(float(a), float(b), p, c) for a, b, p, c in edges],
        sites=[(float(x), s) for x, s in sites], mutations=mutations, migrations=migrations, **more,
    )


def weave(spark):
    """Three binary trees of five samples, one of them old."""
    e = [(0, 9, 5, 0), (9, 12, 6, 0), (0, 12, 5, 1), (0, 5, 6, 2), (9, 12, 5, 2), (0, 9, 6, 5), (5, 12, 6, 3), (0, 5, 7, 3), (0, 12, 7, 4), (5, 9, 7, 2), (9, 12, 7, 5), (0, 12, 8, 6), (0, 12, 8, 7)]
    return build(
        spark, 12, [0, 0, 0, 0, 0.5, 1.25, 1.75, 2.5, 4], range(5), e, [(1, "A"), (4, "C"), (6.5, "G"), (11, "T")],
        [(0, 5, -1, None, "C"), (1, 3, -1, None, "T"), (2, 6, -1, None, "A"), (2, 0, 2, None, "C"), (3, 7, -1, None, "A"), (3, 2, 4, None, "G")],
    )


def lone(spark):
    """One tree, with a mutation back, one that arose four times, and one above the root's child."""
    return build(
        spark, 3, [0, 0, 0, 0, 0.7, 1.1, 2.6], range(4), [(0, 3, 4, 1), (0, 3, 4, 2), (0, 3, 5, 0), (0, 3, 5, 4), (0, 3, 6, 3), (0, 3, 6, 5)], [(0.25, "0"), (1.5, "0"), (2, "0")],
        [(0, 5, -1, None, "1"), (0, 2, 0, None, "0"), (1, 3, -1, None, "1"), (2, 0, -1, None, "1"), (2, 1, -1, None, "1"), (2, 2, -1, None, "1"), (2, 3, -1, None, "1")],
    )


def ragged(spark):
    """Two roots, a node with one child, a sample inside, a sample without edges on a stretch, a stretch without any edge, a dead branch, stacked mutations, migrations."""
    e = [(0, 12, 6, 0), (0, 16, 6, 1), (0, 8, 7, 6), (8, 16, 9, 6), (0, 16, 8, 2), (0, 12, 8, 3), (0, 8, 9, 7), (0, 16, 4, 8), (4, 12, 9, 4), (0, 16, 8, 5), (12, 16, 7, 0)]
    return build(
        spark, 20, [0, 0, 0, 0, 3, 0.5, 1, 1.5, 2, 5.5], (0, 1, 2, 3, 4), e, [(2, "A"), (6, "A"), (10, "G"), (13, "C"), (18, "T")],
        [(0, 6, -1, 2.0, "C"), (0, 6, 0, 1.25, "G"), (0, 3, -1, 0.5, "T"), (1, 4, -1, None, "T"), (1, 2, 3, None, "A"), (2, 9, -1, None, "A"), (3, 0, -1, None, "T"), (4, 1, -1, None, "G")],
        [(0.0, 10.0, 0, 0, 1, 0.25), (3.0, 20.0, 2, 1, 0, 7.5)], populations=[(b"x",), (b"y",)],
    )


def bushy(spark):
    """Eight samples below nodes of two to four children, two trees."""
    e = [(0, 60, 8, c) for c in (0, 2, 5, 7)] + [(0, 60, 9, 1), (0, 25, 9, 3), (25, 60, 10, 3), (0, 60, 9, 6), (0, 60, 10, 4), (0, 60, 10, 9), (0, 60, 11, 8), (0, 60, 11, 10)]
    return build(spark, 60, [0] * 8 + [0.3, 0.4, 0.9, 1.6], range(8), e, [(5, "0"), (30, "0"), (40, "0")], [(0, 9, -1, None, "1"), (1, 10, -1, None, "1"), (1, 4, 1, None, "0"), (2, 8, -1, None, "1")])


class Plain:
    """A genealogy as plain lists."""

    def __init__(self, g):
        self.L = g.sequence_length
        self.time = {r["id"]: r["time"] for r in g.nodes.collect()}
        self.samples = sorted(r["id"] for r in g.samples().collect())
        self.edges = [(r["left"], r["right"], r["parent"], r["child"], r["id"]) for r in g.edges.collect()]
        self.sites = {r["id"]: (r["position"], r["ancestral_state"]) for r in g.sites.collect()}
        self.mutations = sorted((r["id"], r["site"], r["node"], r["derived_state"]) for r in g.mutations.collect())
        cuts = sorted({0.0, self.L, *[x for e in self.edges for x in e[:2]]})
        self.trees = [(a, b, {c: p for x, y, p, c, _ in self.edges if x <= a < y}) for a, b in zip(cuts, cuts[1:])]

    def up(self, parent, u):
        out = [u]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    def below(self, parent, u, among=None):
        return [s for s in (self.samples if among is None else among) if u in self.up(parent, s)]

    def parent_at(self, x):
        return next(p for a, b, p in self.trees if a <= x < b)

    def live(self, parent):
        return {u for s in self.samples for u in self.up(parent, s)}

    def roots(self, parent):
        return sorted(u for u in self.live(parent) if u not in parent)

    def branch_length(self, parent):
        return sum(self.time[parent[u]] - self.time[u] for u in self.live(parent) if u in parent)

    def mrca(self, parent, a, b):
        other = self.up(parent, b)
        return next((u for u in self.up(parent, a) if u in other), None)

    def genotypes(self, missing=False):
        """Site -> allele of each sample; with ``missing``, None for samples that stand alone."""
        out = {}
        for s, (x, anc) in self.sites.items():
            parent = self.parent_at(x)
            row = []
            for i in self.samples:
                hit = [m for u in self.up(parent, i) for m in sorted((m for m in self.mutations if m[1] == s and m[2] == u), reverse=True)]
                alone = i not in parent and i not in parent.values() and not any(m[2] == i for m in hit)
                row.append(None if missing and alone else hit[0][3] if hit else anc)
            out[s] = row
        return out

    def diversity(self, mode, which=None):
        which = which or self.samples
        pairs = list(itertools.combinations(which, 2))
        if mode == "site":
            geno, at = self.genotypes(), {s: i for i, s in enumerate(self.samples)}
            return sum(row[at[a]] != row[at[b]] for row in geno.values() for a, b in pairs) / len(pairs) / self.L
        total = 0.0
        for l, r, parent in self.trees:
            for u in self.live(parent):
                if u in parent:
                    k = len(self.below(parent, u, which))
                    total += (r - l) * (self.time[parent[u]] - self.time[u]) * k * (len(which) - k)
        return total / len(pairs) / self.L

    def spectrum(self, mode):
        """Polarised, not normalised; what all samples have is left out."""
        n = len(self.samples)
        out = [0.0] * (n + 1)
        if mode == "site":
            for s, row in self.genotypes().items():
                for a in {m[3] for m in self.mutations if m[1] == s} - {self.sites[s][1]}:
                    if 0 < (k := row.count(a)) < n:
                        out[k] += 1
            return out
        for l, r, parent in self.trees:
            for u in self.live(parent):
                if u in parent and len(self.below(parent, u)) < n:
                    out[len(self.below(parent, u))] += (r - l) * (self.time[parent[u]] - self.time[u])
        return out

    def coalescences(self):
        out = {}
        for l, r, parent in self.trees:
            for a, b in itertools.combinations(self.samples, 2):
                if (m := self.mrca(parent, a, b)) is not None:
                    out[m] = out.get(m, 0.0) + (r - l) / self.L
        return out

    def descent(self, a, b):
        """Stretches over which the common ancestor and both paths to it stay the same: left, right, ancestor."""
        out = []
        for l, r, parent in self.trees:
            m = self.mrca(parent, a, b)
            if m is None:
                continue
            way = tuple(tuple(x[: x.index(m) + 1]) for x in (self.up(parent, a), self.up(parent, b)))
            if out and out[-1][1] == l and out[-1][3] == way:
                out[-1][1] = r
            else:
                out.append([l, r, m, way])
        return [tuple(x[:3]) for x in out]

    def mean_descendants(self):
        out = {}
        for u in self.time:
            k = [(r - l, len(self.below(p, u))) for l, r, p in self.trees]
            span = sum(w for w, n in k if n)
            out[u] = sum(w * n for w, n in k) / span if span else 0.0
        return out

    def leaves(self, parent):
        live = [u for u in {*parent, *parent.values(), *self.samples} if self.up(parent, u)[-1] in self.roots(parent)]
        return [u for u in live if u not in parent.values()]

    def shape(self, parent):
        """Sackin, Colless, B1 and B2 (base 10)."""
        leaves = self.leaves(parent)
        roots = self.roots(parent)
        inner = {u for x in leaves for u in self.up(parent, x)[1:]}
        kids = {u: [c for c in parent if parent[c] == u] for u in inner}
        size = lambda u: sum(u in self.up(parent, x) for x in leaves)
        height = lambda u: max(self.up(parent, x).index(u) for x in leaves if u in self.up(parent, x))
        colless = sum(abs(size(k[0]) - size(k[1])) for k in kids.values()) if len(roots) == 1 and all(len(k) == 2 for k in kids.values()) else None
        chance = [math.prod(1 / len(kids[u]) for u in self.up(parent, x)[1:]) for x in leaves]
        return sum(len(self.up(parent, x)) - 1 for x in leaves), colless, sum(1 / height(u) for u in inner if u not in roots), -sum(p * math.log10(p) for p in chance) if len(roots) == 1 else None
