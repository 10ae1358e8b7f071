"""What joins send to all executors, and what operators leave unwritten or unlisted."""

from pyspark.sql import functions as F

from kinweave.operators import genotypes as ge
from kinweave.operators import linkage as ld
from kinweave.operators import transforms as tr
from kinweave.plans.staging import measured, unsent


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        wide = spark.range(60_000).select("id", F.lit(None).cast("binary").alias("metadata"))
        large, small = measured(wide), measured(wide.limit(40))
        other = spark.range(1_000_000).select("id", (F.col("id") * 2).alias("x"))
        assert "BroadcastHashJoin" not in _plan(other.join(large.select("id"), "id"))
        assert "BroadcastHashJoin" in _plan(other.join(small.select("id"), "id"))
        assert "BroadcastHashJoin" in _plan(large.join(small.select("id"), "id"))  # the other side is free
        assert other.join(large.select("id"), "id").count() == 60_000
        assert unsent(small, 40) is small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tables_are_numbered_when_read(weave, monkeypatch):
    calls = []
    number = tr.dense_ids
    monkeypatch.setattr(tr, "dense_ids", lambda *a: (calls.append(1), number(*a))[1])
    c = tr.canonicalise(weave)
    assert not calls
    assert c.populations.count() <= weave.populations.count() and len(calls) == 1
    assert c.mutations.count() == weave.mutations.count() and len(calls) > 1


def _refuse(*_, **__):
    raise AssertionError("carriers are listed")


def test_counts_of_alleles_list_no_sample(weave, monkeypatch):
    plan = ge.variants(weave).select("site", "frequencies")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(sample" not in plan
    monkeypatch.setattr(ge, "carriers", _refuse)
    n = weave.samples().count()
    rows = ge.variant_summary(weave).collect()
    assert len(rows) == weave.sites.count() and all(sum(r["counts"]) + r["num_missing"] == n for r in rows)


def test_haplotypes_within_a_tree_list_no_sample(weave, monkeypatch):
    monkeypatch.setattr(ld, "carriers", _refuse)
    same = weave.sites.select(F.col("id").alias("site_a"), F.col("id").alias("site_b"))
    rows = ld.haplotype_counts(weave, same).collect()
    assert rows and all(r["n_ab"] == (r["n_a"] if r["ia"] == r["ib"] else 0) for r in rows)
