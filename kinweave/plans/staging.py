"""Written tables that cut lineage, and joins whose small side is checked before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of compressed Parquet, and rows, up to which a staged side may be broadcast (some tens of MB in memory).
BROADCAST_BYTES, BROADCAST_ROWS = 4 << 20, 500_000

_own: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; on a cluster this is an error, as a
    machine-local folder would be lost with its machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    return _own[app]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    for held in _scopes:
        held.append(back)
    return back


#: Bytes that a row takes at least where a join sends a table to all executors.
ROW_BYTES = 24


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which joins do not broadcast if its ``rows`` in memory are beyond ``spark.sql.autoBroadcastJoinThreshold``.

    Spark judges by the bytes of files and the widths of columns. Compressed ids take a byte or less a row, and a column of NULLs counts as wide, so tables a hundred times the threshold
    pass, through the driver's memory. Unlike ``hint("merge")`` this leaves the other side of a join free to be broadcast.
    """
    session = df.sparkSession._jsparkSession
    if rows * ROW_BYTES <= session.sessionState().conf().autoBroadcastJoinThreshold():
        return df
    jvm = df.sparkSession._jvm
    never = getattr(getattr(jvm.org.apache.spark.sql.catalyst.plans.logical, "NO_BROADCAST_HASH$"), "MODULE$")
    hint = jvm.org.apache.spark.sql.catalyst.plans.logical.HintInfo(jvm.scala.Option.apply(never))
    plan = jvm.org.apache.spark.sql.catalyst.plans.logical.ResolvedHint(df._jdf.queryExecution().analyzed(), hint)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def measured(df: DataFrame, name: str = "stage") -> DataFrame:
    """As :func:`stage`, with the rows counted as they are written: joins broadcast the table only if it is small in memory (:func:`unsent`)."""
    seen = Observation()
    back = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    out = unsent(back, seen.get["rows"])
    out._staged_path = back._staged_path
    return out


def viewed(staged: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of a staged table; the result still counts as staged."""
    out = staged.select(*columns)
    out._staged_path = staged._staged_path
    return out


def _file(df: DataFrame):
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    return p, p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stage`; nothing happens for other tables."""
    for df in tables:
        if getattr(df, "_staged_path", None):
            p, fs = _file(df)
            fs.delete(p, True)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete all tables that :func:`stage` writes within the block at its end; results must be consumed inside, or be taken off the list that the block gets."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.remove(held)
        discard(*held)


def staged_bytes(staged: DataFrame) -> int:
    """Size of a staged table's files; no job runs."""
    p, fs = _file(staged)
    return fs.getContentSummary(p).getLength()


def fits_broadcast(staged: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the files of a staged table have at most ``limit`` bytes, and it at most BROADCAST_ROWS rows (a count over Parquet footers)."""
    return staged_bytes(staged) <= limit and staged.count() <= BROADCAST_ROWS


def dense_ids(df: DataFrame, order: Sequence[Column | str], id: str = "id") -> DataFrame:
    """Number rows 0, 1, .. in an order, without gathering them: range partitions are sorted and numbered, and shifted by the sizes of those before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    s = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    s = stage(s, "ordered")
    p = F.shiftright("_m", 33)
    sizes = s.groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_shift"))  # one row a partition
    out = s.withColumn("_p", p).join(F.broadcast(shift), "_p")
    return out.withColumn(id, F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_shift")).drop("_m", "_p", "_shift")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends, a parent that is not the null id, and a positive length."""
    return edges.where(
        F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("parent").isNotNull()
        & (F.col("parent") != -1) & (F.col("right") > F.col("left"))
    )
