"""Physical-plan helpers shared by the operators.

* ``broadcast_if_small``: broadcast a join side only after measuring that its rows
  are below a bound in bytes; beyond it the join stays a shuffle join (and AQE may
  still convert it at run time from the measured shuffle size).
* ``with_position``: 1-based position in a total order without a global
  window (which would put every row in one task).
* ``widened``: deal out a scan of fewer tasks than cores.
* ``materialize``: write an intermediate to the shared scratch folder and
  read it back, cutting lineage so a lost executor or a second action does not
  re-run Python stages.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Bound in bytes (of the rows as JSON text) under which a dimension-like side is broadcast.
BROADCAST_MAX_BYTES = 32 << 20


def bytes_at_most(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when the rows of ``df`` take at most ``max_bytes``: one partially aggregated sum."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))) + 16
    return (df.agg(F.sum(row).alias("n")).first()["n"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if bytes_at_most(df, max_bytes) else df


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add ``name`` = 1-based rank of each row in ``order`` (which must be total).

    The sort is range-partitioned; each row gets its partition id and its index
    inside the partition, partition sizes are counted (one row per partition)
    and turned into offsets.  Only the per-partition counts are broadcast, and
    their number is bounded by the partition count.
    """
    tagged = (df.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = (tagged.join(F.broadcast(offsets), "_pid")
           .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0))
                              + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
                              + F.lit(1)).cast("bigint"))
           .drop("_pid", "_mid", "_off"))
    return out


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and return a reader of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def widened(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` if it is a plain scan of fewer tasks than there are cores (one small file, say).

    A large table's scan has tasks enough and is left as it is: no shuffle.
    """
    query = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in query.executedPlan().toString() or query.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, key)


def spread(df: DataFrame, key: str | Column | list, min_partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` (one or more columns) before a Python stage.

    A plain ``repartition``: no job runs while the plan is built.  Chunk rows are
    spread by (document, chunk), so the paid calls for one long document do not
    queue in one task.
    """
    keys = key if isinstance(key, list) else [key]
    sc = df.sparkSession.sparkContext
    want = min_partitions or max(sc.defaultParallelism,
                                 int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(want, *keys)
