"""Genotypes from mutations and ancestry: who carries which allele, as sparse rows, arrays or strings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.model import Genealogy
from kinweave.plans.ancestry import allele_counts, ancestry, memo, mutation_parents, sample_ancestry
from kinweave.plans.staging import measured as stage


def carriers(g: Genealogy, nodes: DataFrame | None = None, key: str = "samples") -> DataFrame:
    """Nodes (all samples by default) below any mutation of a site, with the state of the nearest one: ``site``, ``position``, ``sample``, ``allele``, ``depth``.

    Everyone else has the ancestral state or is missing, and needs no row.
    """

    def build() -> DataFrame:
        a = sample_ancestry(g) if nodes is None else ancestry(g).join(nodes.select(F.col("id").alias("start")), "start", "left_semi")
        m = g.mutations.select(F.col("id").alias("m"), "site", "node", "derived_state").join(g.sites.select(F.col("id").alias("site"), "position"), "site")
        hit = m.join(a, "node").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right")))
        best = hit.groupBy("site", F.col("start").alias("sample")).agg(
            F.max_by(F.struct("derived_state", "depth"), F.struct((-F.col("depth")).alias("d"), "m")).alias("b"), F.first("position").alias("position")
        )
        return best.select("site", "position", "sample", F.col("b.derived_state").alias("allele"), F.col("b.depth").alias("depth"))

    return memo(g, f"carriers:{key}", build)


def isolated(g: Genealogy) -> DataFrame:
    """Stretches where a sample has neither parent nor child: ``sample``, ``left``, ``right``."""
    s = g.samples().select(F.col("id").alias("sample"))
    e = g.edges
    tied = e.select(F.col("child").alias("sample"), "left", "right").unionByName(e.select(F.col("parent").alias("sample"), "left", "right")).join(s, "sample", "left_semi")
    L = float(g.sequence_length)
    rim = s.select("sample", F.explode(F.array(F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("right")), F.struct(F.lit(L).alias("left"), F.lit(L).alias("right")))).alias("_")).select("sample", "_.*")
    w = Window.partitionBy("sample").orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return tied.unionByName(rim).withColumn("_r", reach).where(F.col("left") > F.col("_r")).select("sample", F.col("_r").alias("left"), F.col("left").alias("right"))


def missing(g: Genealogy) -> DataFrame:
    """Missing genotypes: sites where a sample is isolated and has no mutation of its own: ``site``, ``sample``."""
    from kinweave.plans.ancestry import bin_width, binned

    width = bin_width(g)
    iso = binned(isolated(g), width)
    s = g.sites.select(F.col("id").alias("site"), "position", F.floor(F.col("position") / width).alias("_bin"))
    at = s.join(iso, "_bin").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).select("site", "sample")
    return at.join(g.mutations.select("site", F.col("node").alias("sample")), ["site", "sample"], "left_anti")


def alleles(g: Genealogy) -> DataFrame:
    """Alleles of a site in order: the ancestral first, then derived states as they first appear: ``site``, ``allele``, ``index``."""
    first = g.mutations.groupBy("site", F.col("derived_state").alias("allele")).agg(F.min("id").alias("at"))
    anc = g.sites.select(F.col("id").alias("site"), F.col("ancestral_state").alias("allele"), F.lit(None).cast("long").alias("at"))
    every = first.join(anc.select("site", "allele"), ["site", "allele"], "left_anti").unionByName(anc)
    w = Window.partitionBy("site").orderBy(F.col("at").asc_nulls_first())
    return every.select("site", "allele", (F.row_number().over(w) - 1).cast("long").alias("index"))


def genotypes(g: Genealogy, isolated_as_missing: bool = True, user_alleles: Sequence[str] | None = None) -> DataFrame:
    """Sparse genotypes: one row per sample with an allele other than the ancestral one, or missing (index -1): ``site``, ``sample``, ``index``, ``allele``.

    With ``user_alleles`` the index is the place in that list; an allele outside the list is an error when the row is made.
    """
    c = carriers(g).select("site", "sample", "allele")
    if user_alleles is None:
        out = c.join(alleles(g), ["site", "allele"]).where("index > 0")
    else:
        at = F.array_position(F.array(*[F.lit(a) for a in user_alleles]), F.col("allele")) - 1
        out = c.withColumn("index", F.when(at < 0, F.raise_error(F.concat(F.lit("allele not listed: "), "allele"))).otherwise(at).cast("long"))
    out = out.select("site", "sample", "index", "allele")
    if not isolated_as_missing:
        return out
    gone = missing(g).select("site", "sample", F.lit(-1).cast("long").alias("index"), F.lit(None).cast("string").alias("allele"))
    return out.unionByName(gone)


def counted(g: Genealogy) -> DataFrame:
    """Samples with each allele of a site, those missing among the ancestral: ``site``, ``allele``, ``n``. No sample is listed."""
    every = g.samples().select(F.col("id").alias("sample"), F.lit(0).alias("set"))
    return allele_counts(g, every, 1, "all").select("site", "allele", F.col("x_all").alias("n"))


def _gone(g: Genealogy, isolated_as_missing: bool) -> DataFrame:
    at = missing(g) if isolated_as_missing else g.spark.createDataFrame([], "site long, sample long")
    return at.groupBy("site").agg(F.count(F.lit(1)).alias("num_missing"))


def variant_summary(g: Genealogy, isolated_as_missing: bool = True) -> DataFrame:
    """Per site: ``alleles`` in order, ``counts`` of samples by allele, ``num_missing``."""
    every = alleles(g).join(counted(g), ["site", "allele"])
    per = every.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("index", "allele", "n"))).alias("a"))  # alleles of one site
    per = per.join(_gone(g, isolated_as_missing), "site", "left").withColumn("num_missing", F.coalesce("num_missing", F.lit(0)))
    counts = F.transform("a", lambda x: F.when(x["index"] == 0, x["n"] - F.col("num_missing")).otherwise(x["n"]))
    return per.select("site", F.transform("a", lambda x: x["allele"]).alias("alleles"), counts.alias("counts"), "num_missing")


def _within(g: Genealogy, left: float, right: float | None) -> Genealogy:
    """The genealogy with the sites of a stretch only; ids and all else stay."""
    end = g.sequence_length if right is None else right
    if not 0 <= left < end <= g.sequence_length:
        raise ValueError("the stretch is empty or outside the sequence")
    if (left, end) == (0, g.sequence_length):
        return g
    s = g.sites.where((F.col("position") >= left) & (F.col("position") < end))
    return g.with_tables(sites=s, mutations=g.mutations.join(s.select(F.col("id").alias("site")), "site", "left_semi").select(*g.mutations.columns))


def variants(g: Genealogy, left: float = 0.0, right: float | None = None, samples: Sequence[int] | None = None, isolated_as_missing: bool = True, user_alleles: Sequence[str] | None = None) -> DataFrame:
    """Per site of [left, right) the dense genotypes of ``samples`` (any nodes; all samples by default), in that order.

    Columns: ``site``, ``position``, ``alleles`` (or those given), ``genotypes`` (-1 where missing), ``states`` (NULL where missing), ``counts`` and ``frequencies`` by allele,
    ``num_missing``. A row of genotypes has one entry a sample, so give a list of the size wanted; counts and frequencies alone list no sample.
    """
    g = _within(g, left, right)
    ids = [int(x) for x in samples] if samples is not None else [r["id"] for r in g.samples().orderBy("id").collect()]  # one row holds an entry for each
    if len(set(ids)) < len(ids):
        raise ValueError("a sample is given twice")
    chosen = g.spark.createDataFrame([(x,) for x in ids], "id long")
    view = g.with_tables(nodes=g.nodes.drop("flags").join(chosen.withColumn("flags", F.lit(1).cast("long")), "id", "left").fillna({"flags": 0}).select(*g.nodes.columns))
    got = genotypes(view, isolated_as_missing, user_alleles).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("sample", "index"))).alias("own"))
    if user_alleles is None:
        al = alleles(g).groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "allele"))), lambda x: x["allele"]).alias("alleles"))
        zero = F.lit(0).cast("long")
    else:
        listed = F.array(*[F.lit(a) for a in user_alleles])
        place = F.array_position(listed, F.col("ancestral_state")) - 1
        al = g.sites.select(F.col("id").alias("site"), listed.alias("alleles"), F.when(place < 0, F.raise_error(F.concat(F.lit("allele not listed: "), "ancestral_state"))).otherwise(place).cast("long").alias("_z"))
        zero = F.col("_z")
    seen = counted(view).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("_seen"))
    rows = g.sites.select(F.col("id").alias("site"), "position", F.col("ancestral_state").alias("_anc")).join(al, "site").join(seen, "site").join(_gone(view, isolated_as_missing), "site", "left")
    rows = rows.withColumn("num_missing", F.coalesce("num_missing", F.lit(0)).cast("long"))
    of = lambda a, k: F.when(F.array_position("alleles", a) == k + 1, F.coalesce(F.element_at("_seen", a), F.lit(0)) - F.when(a == F.col("_anc"), F.col("num_missing")).otherwise(0)).otherwise(0)
    rows = rows.withColumn("counts", F.transform("alleles", lambda a, k: of(a, k).cast("long")))
    called = F.lit(len(ids)) - F.col("num_missing")
    rows = rows.withColumn("frequencies", F.transform("counts", lambda c: F.when(called > 0, c / called))).join(got, "site", "left")  # a join that goes where genotypes are not read
    order = F.from_json(F.lit(str(ids)), "array<long>")  # one literal, where an expression an id would make plans of a million nodes
    rows = rows.withColumn("genotypes", F.transform(order, lambda s: F.coalesce(F.element_at("own", s), zero)))
    rows = rows.withColumn("states", F.transform("genotypes", lambda i: F.when(i >= 0, F.get("alleles", i.cast("int")))))
    return rows.select("site", "position", "alleles", "genotypes", "states", "counts", "frequencies", "num_missing")


def genotype_matrix(g: Genealogy, samples: Sequence[int] | None = None, isolated_as_missing: bool = True, user_alleles: Sequence[str] | None = None) -> DataFrame:
    """One dense row a site: ``site``, ``genotypes``."""
    return variants(g, 0.0, None, samples, isolated_as_missing, user_alleles).select("site", "genotypes")


def remapped(alleles_from: Sequence[str], alleles_to: Sequence[str]) -> tuple[list[int], list[str]]:
    """Where each allele of one list stands in another, which grows by those it lacks: the places, and the list."""
    out = list(alleles_to)
    for a in alleles_from:
        if a not in out:
            out.append(a)
    return [out.index(a) for a in alleles_from], out


def random_nucleotides(length: int, seed: int = 0) -> str:
    """A string of random A, C, G and T."""
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), int(length)))


def haplotypes(g: Genealogy, missing_character: str = "N", chunks: int = 64, left: float = 0.0, right: float | None = None) -> DataFrame:
    """Per sample the string of its alleles over the sites of [left, right) in order of position: ``sample``, ``haplotype``.

    Sites are cut into genome chunks; per chunk the ancestral string is laid under the sample's own rows, then the chunks of a sample are joined.
    """
    g = _within(g, left, right)
    width = float(g.sequence_length) / chunks
    s = g.sites.select(F.col("id").alias("site"), "position", "ancestral_state", F.floor(F.col("position") / width).alias("chunk"))
    base = s.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("position", "ancestral_state"))).alias("base"))  # the sites of one chunk
    own = carriers(g).select("site", "position", "sample", "allele").unionByName(missing(g).join(s.select("site", "position"), "site").select("site", "position", "sample", F.lit(missing_character).alias("allele")))
    own = own.groupBy("sample", F.floor(F.col("position") / width).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("position", "allele"))).alias("own"))
    grid = g.samples().select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")).join(base, "chunk")
    text = F.array_join(F.transform("base", lambda x: F.coalesce(F.element_at(F.coalesce("own", F.create_map().cast("map<double,string>")), x["position"]), x["ancestral_state"])), "")
    parts = grid.join(own, ["sample", "chunk"], "left").select("sample", "chunk", text.alias("part"))
    return parts.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("haplotype"))


def alignments(g: Genealogy, reference: str, missing_character: str = "N", left: int = 0, right: int | None = None) -> DataFrame:
    """Sequences over [left, right): the reference, which has the length of the sequence, with a sample's alleles at whole positions: ``sample``, ``alignment``.

    Stretches where a sample is isolated are missing.
    """
    if len(reference) != int(g.sequence_length) or g.sequence_length != int(g.sequence_length):
        raise ValueError("the reference must be as long as the sequence")
    c = carriers(g).select("sample", F.struct(F.col("position").cast("int").alias("p"), "allele").alias("x")).groupBy("sample").agg(F.collect_list("x").alias("own"))
    s = {int(r["position"]): r["ancestral_state"] for r in g.sites.select("position", "ancestral_state").collect()}  # at most the length of the reference
    base = "".join(s.get(i, ch) for i, ch in enumerate(reference))
    iso = isolated(g).select("sample", F.struct(F.col("left").cast("int").alias("l"), F.col("right").cast("int").alias("r")).alias("x")).groupBy("sample").agg(F.collect_list("x").alias("gaps"))
    rows = g.samples().select(F.col("id").alias("sample")).join(c, "sample", "left").join(iso, "sample", "left")

    def lay(batches):
        for pdf in batches:
            out = []
            for own, gaps in zip(pdf["own"], pdf["gaps"]):
                a = np.array(list(base))
                for x in gaps if gaps is not None else ():
                    a[x["l"] : x["r"]] = missing_character
                for x in own if own is not None else ():
                    a[x["p"]] = x["allele"]
                out.append("".join(a[left:right]))
            yield pdf[["sample"]].assign(alignment=out)

    return rows.mapInPandas(lay, "sample long, alignment string")


def mutation_edges(g: Genealogy) -> DataFrame:
    """The edge above each mutation at its site, or -1: ``id``, ``edge``."""
    m = g.mutations.select("id", "site", F.col("node").alias("child")).join(g.sites.select(F.col("id").alias("site"), "position"), "site")
    e = g.edges.select(F.col("id").alias("edge"), "child", "left", "right")
    hit = m.join(e, "child").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).select("id", "edge")
    return g.mutations.select("id").join(hit, "id", "left").select("id", F.coalesce("edge", F.lit(-1).cast("long")).alias("edge"))


def mutation_times(g: Genealogy) -> DataFrame:
    """Times spread evenly along the edge of the mutations that share it at a site; above a root the node's time: ``id``, ``time``."""
    t = g.nodes.select("id", "time")
    m = g.mutations.select("id", "site", "node").join(mutation_edges(g), "id").join(g.edges.select(F.col("id").alias("edge"), "parent"), "edge", "left")
    m = m.join(t.toDF("node", "tc"), "node").join(t.toDF("parent", "tp"), "parent", "left")
    w = Window.partitionBy("site", "node")
    k = F.row_number().over(w.orderBy("id"))
    n = F.count(F.lit(1)).over(w)
    return m.select("id", F.when(F.col("tp").isNull(), F.col("tc")).otherwise(F.col("tp") - (F.col("tp") - F.col("tc")) * k / (n + 1)).alias("time"))


def imputed_mutation_times(g: Genealogy) -> DataFrame:
    """Known times, and the node's time where unknown: ``id``, ``time``."""
    return g.mutations.select("id", "node", "time").join(g.nodes.select(F.col("id").alias("node"), F.col("time").alias("_t")), "node").select("id", F.coalesce("time", "_t").alias("time"))


__all__ = ["alignments", "alleles", "carriers", "genotypes", "haplotypes", "imputed_mutation_times", "isolated", "missing", "mutation_edges", "mutation_parents", "mutation_times", "stage", "variant_summary"]
