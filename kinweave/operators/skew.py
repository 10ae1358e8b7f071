"""Per-key work when a few keys hold most rows: fragment and replicate by load.

The load of every key is estimated in two map-side-combined passes over the key column alone. Keys are hashed to buckets,
32 for each task; a bucket that is lighter than the target load of a task is taken whole, and within heavier buckets the
rows of each key are counted. Keys heavier than half the target are split into shards in proportion to their load. Shards
and buckets are then bin-packed onto tasks, largest first. Rows go to their task by its number, and of a matching side only the rows
of split keys are replicated, only to the tasks that hold a shard of theirs.

What reaches the driver is bounded by the number of buckets plus twice the number of tasks, whatever the number of keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.plans.staging import BROADCAST_BYTES, fits_broadcast, stage

#: Hash buckets a task: the keys of a bucket that none of them is heavy stay together, so a bucket must be light against a task.
BUCKETS_PER_TASK = 32


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class LoadPlan:
    """Where the rows of each key go: ``heavy`` (key, tasks of its shards) and ``light`` (task of each bucket)."""

    key_type: T.DataType
    buckets: int
    n_tasks: int
    heavy: list[tuple[object, list[int]]]
    light: list[int]
    loads: list[int]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        heavy = T.StructType([T.StructField("_key", self.key_type), T.StructField("_tasks", T.ArrayType(T.IntegerType()))])
        light = T.StructType([T.StructField("_bucket", T.IntegerType(), False), T.StructField("_light", T.IntegerType(), False)])
        return spark.createDataFrame(self.heavy, heavy), spark.createDataFrame(list(enumerate(self.light)), light)


def pack(sizes: list[tuple[int, object]], bins: int) -> tuple[dict[object, int], list[int]]:
    """Largest first onto the least loaded bin: item -> bin, and the load of each bin."""
    heap = [(0, b) for b in range(bins)]
    where: dict[object, int] = {}
    loads = [0] * bins
    for n, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, b = heapq.heappop(heap)
        where[item] = b
        loads[b] = load + n
        heapq.heappush(heap, (load + n, b))
    return where, loads


def plan_loads(df: DataFrame, key: str, rows_per_task: int = 2_000_000, buckets: int | None = None, least_tasks: int | None = None) -> LoadPlan:
    """Count loads and bin-pack them; ``least_tasks`` defaults to twice the cluster's cores."""
    spark = df.sparkSession
    cores = max(2, spark.sparkContext.defaultParallelism)
    keys = df.select(F.col(key).alias("_key"))
    if buckets is None:  # a row count first, so that the number of buckets follows the number of tasks
        likely = max(-(-keys.count() // rows_per_task), least_tasks or 2 * cores)
        buckets = BUCKETS_PER_TASK * likely
    by_bucket = {r["b"]: r["n"] for r in keys.groupBy(_bucket(F.col("_key"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `buckets` rows
    total = sum(by_bucket.values())
    n_tasks = max(1, -(-total // rows_per_task), min(least_tasks or 2 * cores, total or 1))
    target = max(1, -(-total // n_tasks))
    crowded = [b for b, n in by_bucket.items() if n > target / 2]
    heavy: list[tuple[object, int]] = []
    if crowded:
        counted = (
            keys.where(_bucket(F.col("_key"), buckets).isin(crowded)).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > target / 2)
        )
        heavy = [(r["_key"], r["n"]) for r in counted.collect()]  # fewer than 2 * n_tasks keys can be this heavy
    hashed = {}
    if heavy:
        schema = T.StructType([T.StructField("_key", df.schema[key].dataType)])
        rows = spark.createDataFrame([(k,) for k, _ in heavy], schema).select("_key", _bucket(F.col("_key"), buckets).alias("b")).collect()
        hashed = {r["_key"]: r["b"] for r in rows}
    items: list[tuple[int, object]] = []
    shards: dict[object, int] = {}
    for k, n in heavy:
        by_bucket[hashed[k]] -= n
        shards[k] = max(1, -(-n // max(1, target // 2)))
        items += [(-(-n // shards[k]), ("key", k, s)) for s in range(shards[k])]
    items += [(n, ("bucket", b, 0)) for b, n in by_bucket.items() if n > 0]
    where, loads = pack(items, n_tasks)
    return LoadPlan(
        df.schema[key].dataType, buckets, n_tasks,
        [(k, [where[("key", k, s)] for s in range(m)]) for k, m in shards.items()],
        [where.get(("bucket", b, 0), b % n_tasks) for b in range(buckets)], loads,
    )


def fragment(df: DataFrame, key: str, plan: LoadPlan, shard_by: list[str]) -> DataFrame:
    """Send each row to its task, adding ``_task`` and ``_shard``; rows of a split key part by the hash of ``shard_by``.

    Both lookup tables have a proven bound (``buckets`` rows and fewer than twice ``n_tasks`` rows), hence the broadcast.
    """
    heavy, light = plan.tables(df.sparkSession)
    out = df.withColumn("_bucket", _bucket(F.col(key), plan.buckets)).join(F.broadcast(light), "_bucket", "left")
    out = out.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key")), "left")
    out = out.withColumn("_shard", F.when(F.col("_tasks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in shard_by]), F.size("_tasks"))).cast("int"))
    out = out.withColumn("_task", F.coalesce(F.element_at("_tasks", F.col("_shard") + 1), F.col("_light")))
    return out.drop("_bucket", "_light", "_key", "_tasks").repartitionById(plan.n_tasks, F.col("_task"))


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: a row of a split key goes to each shard's task, any other row to one task."""
    heavy, light = plan.tables(df.sparkSession)
    out = df.withColumn("_bucket", _bucket(F.col(key), plan.buckets)).join(F.broadcast(light), "_bucket", "left")
    out = out.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key")), "left")
    out = out.select("*", F.posexplode(F.coalesce(F.col("_tasks"), F.array("_light"))).alias("_shard", "_task"))
    return out.drop("_bucket", "_light", "_key", "_tasks").repartitionById(plan.n_tasks, F.col("_task"))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", shard_by: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join on one key column, safe against hot keys on the left: ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    The right side is staged unless it is already; up to ``limit`` bytes of files it is broadcast, beyond that the left side, staged too, is fragmented
    by load and the right side replicated to the fragments. Both give the same rows. The columns of the two sides other than ``key`` must differ.
    """
    if not getattr(right, "_staged_path", None):
        right = stage(right, "right")
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), key, how)
    if not getattr(left, "_staged_path", None):  # counted and read several times
        left = stage(left, "left")
    plan = plan_loads(left, key)
    if how in ("inner", "left_semi"):  # rows of a split key without a partner need not travel
        left = left.where(F.col(key).isNotNull())
        split = [k for k, _ in plan.heavy if k is not None]
        if split and not isinstance(plan.key_type, T.StructType):
            met = {r[0] for r in right.where(F.col(key).isin(split)).select(key).distinct().collect()}
            alone = [k for k in split if k not in met]
            left = left.where(~F.col(key).isin(alone)) if alone else left
    a = fragment(left, key, plan, shard_by or [c for c in left.columns if c != key] or [key])
    b = replicate(right, key, plan)
    return a.join(b, ["_task", "_shard", key], how).drop("_task", "_shard")


def parent_results(edges: DataFrame, nodes: DataFrame, rows_per_task: int = 2_000_000, least_tasks: int | None = None) -> DataFrame:
    """Per parent, however many rows it holds: rows as delivered, ids, children and the total span of its usable edges.

    Columns: ``parent``, ``n_rows``, ``n_ids``, ``n_children``, ``total_span``, ``parent_time`` (NULL where the parent has no node or no
    known time). An id counts once for ``n_ids`` and ``total_span``. NULL and -1 are no parents and give no row; an empty table
    gives none. Rows without a usable interval add nothing to the span. Other columns of the tables are ignored.
    """
    plan = plan_loads(edges, "parent", rows_per_task, least_tasks=least_tasks)
    e = fragment(edges.select("id", "parent", "child", "left", "right"), "parent", plan, ["child"])
    span = F.when(F.col("right") > F.col("left"), F.col("right") - F.col("left"))
    by_id = e.groupBy("_task", "_shard", "parent", "child", "id").agg(F.count(F.lit(1)).alias("n"), F.min(span).alias("span"))
    by_child = by_id.groupBy("_task", "_shard", "parent", "child").agg(F.sum("n").alias("n"), F.count("id").alias("ids"), F.sum("span").alias("span"))
    by_shard = by_child.groupBy("_task", "_shard", "parent").agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.count("child").alias("children"), F.sum("span").alias("span")
    )
    known = nodes.where(F.col("time").isNotNull() & ~F.isnan("time")).groupBy(F.col("id").alias("parent")).agg(F.min("time").alias("parent_time"))
    joined = by_shard.join(replicate(known, "parent", plan), ["_task", "_shard", "parent"], "left")
    return (
        joined.where(F.col("parent").isNotNull() & (F.col("parent") != -1))
        .groupBy("parent")
        .agg(
            F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), F.sum("children").alias("n_children"),
            F.coalesce(F.sum("span"), F.lit(0.0)).alias("total_span"), F.max("parent_time").alias("parent_time"),
        )
    )


def heavy_parents(edges: DataFrame, nodes: DataFrame, share: float = 0.01) -> DataFrame:
    """The parents that hold at least ``share`` of all rows of ``edges`` as delivered (``parent``)."""
    total = edges.count()
    return parent_results(edges, nodes).where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select("parent")
