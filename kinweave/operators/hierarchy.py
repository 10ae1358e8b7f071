"""Parent-child links to full hierarchies: loops, paths, depths and roots.

Everything rests on :func:`exits`: the chains of nodes with a single parent are contracted within fragments of the nodes to their exits, the smaller
quotient forest of the exits is solved in the same way, and the answers are expanded back.

* :func:`cycles` (any number of parents) drops dead ends, contracts chains, and goes on with the quotient graph, in turn up and down the links, until one
  small task can name the members of loops; contracted chains get theirs by expansion. What nothing shrinks is solved by colouring, distributed.
* :func:`paths` (any number of parents) contracts chains, finds the distances of the quotient to its roots, expands them, and prefixes the paths of the
  forest of nearest parents within fragments, over the quotient of their exits, and back. Each link to a parent has its own path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import skew_join
from kinweave.plans.staging import discard, scope, stage, viewed

#: Links a single task may solve (16 bytes each as longs), and nodes of a fragment.
BASE_LINKS = 250_000


def strong_members(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of loops and the smallest member of the loop each belongs to."""
    own = np.unique(child[child == parent])
    keep = np.ones(len(child), bool)
    while True:  # links at either end of a dead end go first; what is left is small
        live = np.intersect1d(child[keep], parent[keep])
        now = keep & np.isin(child, live) & np.isin(parent, live)
        if now.sum() == keep.sum():
            break
        keep = now
    ids, inverse = np.unique(np.concatenate([child[keep], parent[keep]]), return_inverse=True)
    n, m = len(ids), int(keep.sum())
    src, dst = inverse[:m], inverse[m:]
    order = np.argsort(src, kind="stable")
    dst = dst[order].tolist()
    at = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, on, done = [-1] * n, [0] * n, [False] * n, at[:n]
    stack: list[int] = []
    found: list[tuple[int, int]] = []
    clock = 0
    for s in range(n):
        if index[s] >= 0:
            continue
        index[s] = low[s] = clock
        clock += 1
        stack.append(s)
        on[s] = True
        walk = [s]
        while walk:
            v = walk[-1]
            if done[v] < at[v + 1]:
                w = dst[done[v]]
                done[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on[w] = True
                    walk.append(w)
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
            if low[v] == index[v]:
                group = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    group.append(w)
                    if w == v:
                        break
                if len(group) > 1:
                    least = int(ids[min(group)])
                    found += [(int(ids[w]), least) for w in group]
    known = {a for a, _ in found}
    found += [(int(x), int(x)) for x in own if int(x) not in known]
    return np.array([a for a, _ in found], dtype="int64"), np.array([b for _, b in found], dtype="int64")


def _solve(links: DataFrame, group: list[str]) -> DataFrame:
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        member, cycle = strong_members(pdf["child"].to_numpy(), pdf["parent"].to_numpy())
        return pd.DataFrame({"cycle": cycle, "member": member})

    return links.withColumn("_one", F.lit(0)).groupBy(*(group or ["_one"])).applyInPandas(solve, "cycle long, member long")


def climb(node: np.ndarray, up: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow parents inside a fragment: each node's exit, the first node outside, and the length of the way there.

    A loop is cut at its smallest member, which is then its own exit, at length 0. Pointers are doubled, so long chains take few rounds.
    """
    n = len(node)
    order = np.argsort(node)
    ids, above, step = node[order], up[order], length[order].astype("int64")
    at = np.minimum(np.searchsorted(ids, above), max(0, n - 1))
    inside = ids[at] == above if n else np.zeros(0, bool)
    rounds = max(1, n.bit_length() + 1)

    def follow(jump: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            far, jump = far + far[jump], jump[jump]
        return jump, far

    own = np.arange(n)
    jump, far = follow(np.where(inside, at, own), np.where(inside, step, 0))
    stuck = inside[jump]
    root = np.zeros(n, bool)
    if stuck.any():  # pointers of stuck nodes end on loops and reach all their members
        ring = np.unique(jump[stuck])
        least, hop = own.copy(), at.copy()
        for _ in range(rounds):
            least, hop = np.minimum(least, least[hop]), hop[hop]
        root[ring[least[ring] == ring]] = True
        inside = inside & ~root
        jump, far = follow(np.where(inside, at, own), np.where(inside, step, 0))
    exit_ = np.where(root[jump], ids[jump], above[jump])
    back = np.empty(n, "int64")
    back[order] = own
    return exit_[back], (far + np.where(root[jump], 0, step[jump]))[back]


def _fragment(c: str, fragments: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.floor(F.col(c) / 64), F.lit(seed)), F.lit(fragments)) if fragments > 1 else F.lit(0).cast("long")


def _local(forest: DataFrame, fragments: int, seed: int) -> DataFrame:
    def contract(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        exit_, far = climb(pdf["node"].to_numpy(), pdf["up"].to_numpy(), pdf["len"].to_numpy())
        return pd.DataFrame({"f": key[0], "node": pdf["node"], "up": pdf["up"], "exit": exit_, "len": far})

    return forest.withColumn("_f", _fragment("node", fragments, seed)).groupBy("_f").applyInPandas(contract, "f long, node long, up long, exit long, len long")


def exits(forest: DataFrame, base: int = BASE_LINKS, depth: int = 0) -> tuple[DataFrame, list[tuple[str, list[DataFrame]]]]:
    """Where the chain of each node of a forest ends: ``node``, ``up``, ``exit``, ``len`` (the way there), and the levels it was found by.

    ``forest`` is staged and has ``node`` (once), ``up`` and ``len``. The exit is the first node that has no row; a loop ends at one of its members, whose exit is
    itself. At least two fragments are contracted before the quotient of their exits is solved; a quotient that does not shrink, i.e. a bare chain across the
    fragments, is solved by doubling pointers over joins.
    """
    n = forest.count()
    parts = max(2 if depth == 0 else 1, -(-2 * n // max(1, base)) if n > base else 1)
    local = stage(_local(forest, parts, depth), "local")
    levels = [("local", [local])]
    if parts == 1:
        return local, levels
    inner = local.where("exit <> node")
    quotient = stage(skew_join(inner.select("node", F.col("exit").alias("up"), "len"), inner.select(F.col("exit").alias("node")).distinct(), "node", "left_semi", ["up"]), "quotient")
    q = quotient.count()
    if not q:
        return local, levels
    if q > base and q > 0.7 * n:
        return _doubled(forest, n)
    upper, more = exits(quotient, base, depth + 1)
    known = upper.select(F.col("node").alias("exit"), F.col("exit").alias("top"), F.col("len").alias("rest"))
    out = skew_join(local, known, "exit", "left", ["node"])
    return stage(out.select("node", "up", F.coalesce("top", "exit").alias("exit"), (F.col("len") + F.coalesce("rest", F.lit(0))).alias("len")), "exits"), levels + more


def _doubled(forest: DataFrame, n: int) -> tuple[DataFrame, list[tuple[str, list[DataFrame]]]]:
    """:func:`exits` by pointers of 1, 2, 4, ... steps; rows whose pointer has left the forest are done."""
    first = forest.select("node", "up", F.col("up").alias("to"), "len", "node", F.lit(False).alias("done")).toDF("node", "up", "to", "len", "least", "done")
    jumps = [stage(first, "jump")]
    for _ in range(n.bit_length() + 1):
        at = jumps[-1]
        on = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("len").alias("len2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        nxt = skew_join(at.where("not done"), on, "to", "left", ["node"]).select(
            "node", "up", F.coalesce("to2", "to").alias("to"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"), F.least("least", "least2").alias("least"), F.coalesce("done2", F.lit(True)).alias("done"),
        )
        jumps.append(stage(at.where("done").unionByName(nxt), "jump"))
        if jumps[-1].where("not done").isEmpty():
            break
    last = jumps[-1]
    ring = stage(last.where("not done").select("to").distinct(), "ring")  # what still moves ends on loops
    loop = stage(skew_join(last.select(F.col("node").alias("to"), F.col("least").alias("cut")), ring, "to", "left_semi"), "loop")
    out = skew_join(last, loop, "to", "left", ["node"])
    return stage(out.select("node", "up", F.coalesce("cut", "to").alias("exit"), "len"), "exits"), [("jump", jumps)]


def along(levels: list, marks: DataFrame) -> DataFrame:
    """The nodes of the forest on the way from each marked one to its exit, with its mark: ``cycle``, ``member``. ``marks`` has ``node`` and ``cycle``."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(pdf["node"].tolist(), pdf["up"].tolist()))
        out: dict[int, int] = {}
        for u, c in pdf.loc[pdf["cycle"].notna(), ["node", "cycle"]].itertuples(index=False):
            while u in up and u not in out:
                out[u] = int(c)
                u = up[u]
        return pd.DataFrame({"cycle": list(out.values()), "member": list(out)})

    how, tables = levels[0]
    if how == "jump":
        for jump in reversed(tables):
            marks = stage(marks.unionByName(jump.where("not done").join(marks, "node").select(F.col("to").alias("node"), "cycle")).distinct(), "marks")
        return tables[0].join(marks, "node").select("cycle", F.col("node").alias("member"))
    local = tables[0]
    if len(levels) > 1:
        seeds = stage(local.where("exit <> node").join(marks, "node").select(F.col("exit").alias("node"), "cycle").distinct(), "seeds")
        if not seeds.isEmpty():
            marks = stage(marks.unionByName(along(levels[1:], seeds).select(F.col("member").alias("node"), "cycle")).distinct(), "marks")
    return local.select("f", "node", "up").join(marks.groupBy("node").agg(F.min("cycle").alias("cycle")), "node", "left").groupBy("f").applyInPandas(walk, "cycle long, member long")


def _prune(links: DataFrame) -> DataFrame:
    """The distinct links whose two ends both have a link on either side, with ``single``: the child has no other parent."""
    none = F.lit(None).cast("long")
    ends = links.select(F.col("child").alias("node"), F.lit(1).alias("side"), F.col("parent").alias("up")).unionByName(links.select(F.col("parent").alias("node"), F.lit(2).alias("side"), none.alias("up")))
    live = ends.groupBy("node").agg(F.bit_or("side").alias("sides"), (F.min("up") == F.max("up")).alias("single")).where("sides = 3").select("node", "single")
    with scope() as held:
        live = stage(live, "live")
        once = skew_join(links, viewed(live, F.col("node").alias("parent")), "parent", "left_semi", ["child"])
        both = skew_join(once, viewed(live, F.col("node").alias("child"), "single"), "child", "inner", ["parent"])
        out = stage(both.select("child", "parent", "single").distinct(), "links")
        held.remove(out)
    return out


def cycles(links: DataFrame, base_links: int = BASE_LINKS, kinds: tuple[str, ...] = ("node", "individual")) -> DataFrame:
    """Members of loops: ``kind``, ``cycle_id`` (smallest id of the members that are each other's ancestors), ``member_id``.

    ``links`` has ``kind`` (one of ``kinds``), ``child`` and ``parent``; rows with a NULL end or another kind are left out, repeated rows count
    once, a node that is its own parent is a loop of one. Other columns are ignored; an empty table gives no rows. Ids must lie within
    2**63 divided by the number of kinds, as a node of any kind is one long while solving.

    Each round prunes dead ends and contracts chains, and turns the links over, so that the next one contracts chains of single children; at least one round runs at any
    size. At most ``base_links`` links are solved by one task.
    """
    links = coded(links, kinds)
    own = stage(links.where("child = parent").select(F.col("child").alias("cycle"), F.col("child").alias("member")).distinct(), "own")
    rest, n, rounds = links.where("child <> parent"), None, []
    while True:
        before, live = n, _prune(rest)
        discard(rest)
        forest = stage(live.where("single").select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("len")), "forest")
        found, levels = exits(forest, base_links)
        moved = stage(found.where("node <> exit").select(F.col("node").alias("parent"), "exit"), "moved")
        kept = live.where("not single").select("child", "parent").unionByName(found.where("node = exit").select(F.col("node").alias("child"), F.col("up").alias("parent")))
        with scope() as held:
            hop = skew_join(kept, moved, "parent", "left", ["child"])
            hop = stage(hop.select("child", F.col("parent").alias("via"), F.coalesce("exit", "parent").alias("parent")), "hops")
            held.remove(hop)
        rounds.append((hop, levels))
        rest = stage(hop.where("child <> parent").select(F.col("parent").alias("child"), F.col("child").alias("parent")).distinct(), "links")
        discard(live, moved)
        n = rest.count()
        if n <= base_links or (before is not None and n > 0.95 * before):
            break
    members = stage(_solve(rest, []) if n <= base_links else _colour(_prune(rest).select("child", "parent"), base_links), "members")
    for hop, levels in reversed(rounds):
        members = _expand(members, hop, levels)
    every = members.unionByName(own.join(members.select("member"), "member", "left_anti").select("cycle", "member"))
    return every.select(kind_of(F.col("member"), kinds).alias("kind"), decoded(F.col("cycle"), kinds).alias("cycle_id"), decoded(F.col("member"), kinds).alias("member_id"))


def _colour(rest: DataFrame, base_links: int) -> DataFrame:
    """Loops of a graph that no pruning or contraction shrinks and no task holds: ``cycle``, ``member``.

    Each node takes the smallest id that reaches it. A node that keeps its own id gathers, against the links, those with its id that reach it: they are
    its loop. Links between different ids and links of gathered nodes go; the rest is pruned and coloured again, until one task can solve it.
    """
    found = []
    n = rest.count()
    while n > base_links and n:
        colour = stage(rest.select(F.col("child").alias("node")).unionByName(rest.select(F.col("parent").alias("node"))).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            near = skew_join(rest, colour.select(F.col("node").alias("child"), F.col("colour").alias("c")), "child", "inner", ["parent"]).groupBy(F.col("parent").alias("node")).agg(F.min("c").alias("least"))
            nxt = stage(colour.join(near, "node", "left").select("node", F.least("colour", F.coalesce("least", "colour")).alias("colour"), F.coalesce(F.col("least") < F.col("colour"), F.lit(False)).alias("moved")), "colour")
            discard(colour)
            colour = nxt.drop("moved")
            colour._staged_path = nxt._staged_path
            if nxt.where("moved").isEmpty():
                break
        ends = skew_join(rest, colour.select(F.col("node").alias("child"), F.col("colour").alias("c")), "child", "inner", ["parent"])
        ends = skew_join(ends, colour.select(F.col("node").alias("parent"), F.col("colour").alias("d")), "parent", "inner", ["child"])
        inside = stage(ends.where("c = d").select("child", "parent", "c"), "inside")
        front = stage(colour.where("node = colour").select("node", F.col("colour").alias("c")), "front")
        members = front
        while True:
            back = skew_join(inside.select("child", "parent"), front.select(F.col("node").alias("parent"), "c"), "parent", "inner", ["child"]).select(F.col("child").alias("node"), "c").distinct()
            front = stage(back.join(members.select("node"), "node", "left_anti").select("node", "c"), "front")
            if front.isEmpty():
                break
            members = stage(members.unionByName(front), "members")
        loops = members.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c")
        found.append(members.join(loops, "c", "left_semi").select(F.col("c").alias("cycle"), F.col("node").alias("member")))
        left = skew_join(inside.select("child", "parent"), members.select(F.col("node").alias("child")), "child", "left_anti", ["parent"])
        left = skew_join(left, members.select(F.col("node").alias("parent")), "parent", "left_anti", ["child"]).select("child", "parent")
        rest = _prune(left).select("child", "parent")
        n = rest.count()
    found.append(_solve(rest, []))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _expand(members: DataFrame, hop: DataFrame, levels: list) -> DataFrame:
    """Give a round's chains back: a chain node is a member if a member, or a chain it closes with, leads into it or below it and its exit is in the same loop."""
    closed = hop.where("child = parent").select(F.col("child").alias("cycle"), F.col("child").alias("member")).distinct()
    members = stage(members.unionByName(closed.join(members.select("member"), "member", "left_anti").select("cycle", "member")), "members")
    a = viewed(members, F.col("member").alias("child"), F.col("cycle").alias("c"))
    b = viewed(members, F.col("member").alias("parent"), F.col("cycle").alias("d"))
    looped = skew_join(skew_join(hop.where("via <> parent"), b, "parent", "inner", ["child"]), a, "child", "inner", ["parent"]).where("c = d")
    entries = stage(looped.select(F.col("via").alias("node"), F.col("c").alias("cycle")).distinct(), "entries")
    full = members if entries.isEmpty() else members.unionByName(along(levels, entries)).distinct()
    least = full.groupBy("cycle").agg(F.min("member").alias("least"))
    return stage(full.join(least, "cycle").select(F.col("least").alias("cycle"), "member"), "members")


def all_links(edges: DataFrame, individuals: DataFrame) -> DataFrame:
    """The links of nodes (all rows of edges) and of individuals (entries of ``parents``): ``kind``, ``child``, ``parent``; NULL and -1 are no parents."""
    nodes = edges.select(F.lit("node").alias("kind"), F.col("child"), F.col("parent"))
    people = individuals.select(F.lit("individual").alias("kind"), F.col("id").alias("child"), F.explode("parents").alias("parent"))
    return nodes.unionByName(people).where(F.col("child").isNotNull() & F.col("parent").isNotNull() & (F.col("parent") != -1))


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow parents inside a fragment of a forest without loops; ``steps`` holds what lies between a node (with it) and its parent (without it)."""
    at = dict(zip(pdf["node"].tolist(), range(len(pdf))))
    up, steps = pdf["up"].tolist(), [list(x) for x in pdf["steps"]]
    exit_: list = [None] * len(up)
    for i in range(len(up)):
        walk, j = [], i
        while j is not None and exit_[j] is None:
            walk.append(j)
            j = at.get(up[j])
        for k in reversed(walk):
            above = at.get(up[k])
            if above is None:
                exit_[k] = up[k]
            else:
                steps[k] += steps[above]
                exit_[k] = exit_[above]
    return pd.DataFrame({"node": pdf["node"], "up": exit_, "steps": steps})


_STEPS = "node long, up long, steps array<long>"


def _paths(forest: DataFrame, base: int, depth: int = 0) -> DataFrame:
    """Full paths of all nodes of a staged forest without loops (``node``, ``up``, ``steps``): ``up`` is then the root."""
    n = forest.count()
    parts = max(2 if depth == 0 else 1, -(-2 * n // max(1, base)) if n > base else 1)
    local = stage(forest.withColumn("_f", _fragment("node", parts, depth)).groupBy("_f").applyInPandas(lambda key, pdf: _steps(pdf), _STEPS), "local")
    if parts == 1:
        return local
    quotient = stage(skew_join(local, local.select(F.col("up").alias("node")).distinct(), "node", "left_semi", ["up"]), "quotient")
    q = quotient.count()
    if not q:
        return local
    if q > base and q > 0.7 * n:  # a bare chain across the fragments: pointers of 1, 2, 4, ... steps
        t = forest.withColumn("done", F.lit(False))
        while True:
            on = t.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
            nxt = skew_join(t.where("not done"), on, "up", "left", ["node"]).select(
                "node", F.coalesce("up2", "up").alias("up"), F.concat("steps", F.coalesce("steps2", F.array().cast("array<long>"))).alias("steps"), F.coalesce("done2", F.lit(True)).alias("done"),
            )
            t = stage(t.where("done").unionByName(nxt), "jump")
            if t.where("not done").isEmpty():
                return t.select("node", "up", "steps")
    upper = _paths(quotient, base, depth + 1)
    known = upper.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("steps").alias("rest"))
    lower = skew_join(local, known, "up", "left", ["node"])
    return stage(lower.select("node", F.coalesce("top", "up").alias("up"), F.concat("steps", F.coalesce("rest", F.array().cast("array<long>"))).alias("steps")), "paths")


def coded(links: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Links of all kinds as longs, ``child`` and ``parent``: an id times the number of kinds, plus the place of its kind. Rows with a NULL end or another kind are left out."""
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1
    known = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull() & (code >= 0))
    return known.select((F.col("child") * len(kinds) + code).alias("child"), (F.col("parent") * len(kinds) + code).alias("parent"))


def decoded(c: Column, kinds: tuple[str, ...]) -> Column:
    """The id of a coded long."""
    return F.call_function("div", c - F.pmod(c, F.lit(len(kinds))), F.lit(len(kinds)))


def kind_of(c: Column, kinds: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(c, F.lit(len(kinds))) + 1).cast("int"))


def _distances(links: DataFrame, base: int) -> DataFrame:
    """Fewest links to a root for every parent that reaches one: ``node``, ``d``. ``links`` is staged, distinct, and may hold self-links, which lead nowhere."""
    other = F.when(F.col("child") != F.col("parent"), F.col("parent"))
    ends = links.select(F.col("child").alias("node"), F.lit(1).alias("side"), other.alias("up")).unionByName(links.select(F.col("parent").alias("node"), F.lit(2).alias("side"), F.lit(None).cast("long").alias("up")))
    ids = ends.groupBy("node").agg(F.bit_or("side").alias("sides"), F.min("up").alias("up"), F.max("up").alias("up2"))
    ids = stage(ids.where("sides >= 2").select("node", F.when(F.col("up") == F.col("up2"), F.col("up")).alias("up"), (F.col("sides") == 2).alias("root"), (F.col("up") != F.col("up2")).alias("several")), "ids")
    with scope() as held:
        found, _ = exits(stage(ids.where("up is not null").select("node", "up", F.lit(1).cast("long").alias("len")), "forest"), base)
        mine = skew_join(links.where("child <> parent"), ids.where("several").select(F.col("node").alias("child")), "child", "left_semi", ["parent"])
        hop = skew_join(mine, found.select(F.col("node").alias("parent"), "exit", "len"), "parent", "left", ["child"])
        hop = hop.groupBy("child", F.coalesce("exit", "parent").alias("parent")).agg(F.min(F.coalesce("len", F.lit(0)) + 1).alias("len"))
        hop = stage(hop, "hops")
        dist = stage(ids.where("root").select("node", F.lit(0).cast("long").alias("d")), "dist")
        front = dist
        while True:  # only nodes that came nearer go on
            got = skew_join(hop, front.select(F.col("node").alias("parent"), "d"), "parent", "inner", ["child"]).groupBy(F.col("child").alias("node")).agg(F.min(F.col("d") + F.col("len")).alias("d"))
            got = got.join(dist.select("node", F.col("d").alias("old")), "node", "left").where("old is null or d < old")
            new = stage(got.select("node", "d"), "front")
            if new.isEmpty():
                break
            nearer = stage(dist.join(new.select("node"), "node", "left_anti").unionByName(new), "dist")
            discard(dist, front)
            dist, front = nearer, new
        single = skew_join(found.select("node", "exit", "len"), dist.select(F.col("node").alias("exit"), "d"), "exit", "inner", ["node"]).select("node", (F.col("d") + F.col("len")).alias("d"))
        out = stage(dist.unionByName(single), "distances")
        held.remove(out)
    return out


def paths(links: DataFrame, base_links: int = BASE_LINKS, kinds: tuple[str, ...] = ("node", "individual")) -> DataFrame:
    """Every link to a parent with the way through it: ``kind``, ``id``, ``parent``, ``root``, ``depth``, ``path``, ``closes``; a root has one row, with ``parent`` NULL.

    ``path`` holds the ids from a root to ``parent`` on a shortest way (the smallest parent where several are equally near a root), then ``id``; ``depth`` is its number of
    links. Every parent of every id is kept, so all ways are those that the rows of the parents lead on to. ``closes`` tells that ``id`` stands on the way
    of ``parent`` already: the link closes a loop. Then, and where ``parent`` reaches no root, ``root``, ``depth`` and ``path`` are NULL.

    Rows with a NULL end or a kind not in ``kinds`` are left out, repeated rows count once, other columns are ignored, an empty table gives no rows. Ids must lie within 2**63
    divided by the number of kinds.
    """
    every = stage(coded(links, kinds).distinct(), "all_links")
    with scope() as held:
        near = _distances(every, base_links)
        ranked = skew_join(every.where("child <> parent"), viewed(near, F.col("node").alias("parent"), "d"), "parent", "inner", ["child"])
        via = ranked.groupBy(F.col("child").alias("node")).agg(F.min(F.struct("d", "parent")).alias("m"))
        inner = via.join(near.where("d > 0").select("node"), "node", "left_semi")  # roots have no way up, and only ways of parents are asked for
        forest = stage(inner.select("node", F.col("m.parent").alias("up"), F.array("node").alias("steps")), "forest")
        ways = _paths(forest, base_links).select("node", F.reverse(F.concat("steps", F.array("up"))).alias("way"))
        ways = stage(ways.unionByName(near.where("d = 0").select("node", F.array("node").alias("way"))), "ways")
        held.remove(ways)
    tops = ways.where("size(way) = 1")
    rows = skew_join(every, viewed(ways, F.col("node").alias("parent"), "way"), "parent", "left", ["child"])
    closes = (F.col("child") == F.col("parent")) | F.coalesce(F.array_contains("way", F.col("child")), F.lit(False))
    rows = rows.select("child", "parent", closes.alias("closes"), F.when(~closes, F.concat("way", F.array("child"))).alias("way"))
    rows = rows.unionByName(tops.select(F.col("node").alias("child"), F.lit(None).cast("long").alias("parent"), F.lit(False).alias("closes"), "way"))
    return rows.select(
        kind_of(F.col("child"), kinds).alias("kind"), decoded(F.col("child"), kinds).alias("id"), decoded(F.col("parent"), kinds).alias("parent"), decoded(F.element_at("way", 1), kinds).alias("root"),
        (F.size(F.when(F.col("way").isNotNull(), F.col("way"))) - 1).cast("long").alias("depth"), F.transform("way", lambda x: decoded(x, kinds)).alias("path"), "closes",
    )
