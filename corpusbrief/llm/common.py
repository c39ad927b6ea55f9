"""What the operators of this folder share: session settings, keys, Arrow access."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.strategies import materialize
from ..session import DEFAULT_CONF, ensure_checkpoint_dir, scratch_path  # noqa: F401

# Python stages get small Arrow batches: texts may be long
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024)}
JOIN_CONF = {k: DEFAULT_CONF[k] for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
# a join side is broadcast only by its measured size, at most this much
JOIN_CONF["spark.sql.adaptive.autoBroadcastJoinThreshold"] = "8m"


def prep(spark: SparkSession) -> None:
    for k, v in {**JOIN_CONF, **ARROW_CONF}.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prep(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: whatever their names were, they clash with nothing."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def shuffle_partitions(spark: SparkSession, rows: int = 0, rows_each: int = 1_000_000) -> int:
    """Partitions for a keyed Python stage: the session's number, or more where ``rows`` asks for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def keyed(docs: DataFrame, id_col: str, order: list[str], name: str = "_key") -> DataFrame:
    """``docs`` with a unique bigint ``name`` that follows (id, ``order``), NULL ids first.

    Unique integer ids are the key themselves.  Otherwise the rows are range-sorted, numbered and
    written once, so that equal rows still have different, stable keys.
    """
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        c = F.col(id_col)
        if docs.select(id_col).groupBy(id_col).count().where(c.isNull() | (F.col("count") > 1)).isEmpty():
            return docs.withColumn(name, c.cast("bigint"))
    n = shuffle_partitions(docs.sparkSession)
    by = [F.col(id_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    return materialize(docs.repartitionByRange(n, *by).sortWithinPartitions(*by)
                       .withColumn(name, F.monotonically_increasing_id()), "keyed")


def later_copies(rows: DataFrame, partitions: int) -> DataFrame:
    """The (key, pos) of rows whose digest (d1, d2) also has a row with a smaller (key, pos).

    Callers combine copies per batch first, so a digest has at most one row a batch here.
    """
    def run(batches):
        parts = [np.stack([b.column(i).to_numpy() for i in range(4)]) for b in batches]
        if parts:
            x = np.concatenate(parts, axis=1)
            x = x[:, np.lexsort((x[1], x[0], x[3], x[2]))]
            x = x[:2, 1:][:, (x[2:, 1:] == x[2:, :-1]).all(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["key", "pos"])

    return (rows.select("key", "pos", "d1", "d2").repartition(partitions, "d1", "d2")
            .mapInArrow(run, "key long, pos long"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow column (None for NULL)."""
    big = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if big else pa.binary()).to_pylist()


def blocks(texts: list, limit: int):
    """Ranges [i, j) of consecutive texts of at most ``limit`` bytes together, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def give_back() -> None:
    """Hand freed memory back to the system: reused Python workers otherwise keep the most they ever held."""
    import ctypes
    import gc

    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links a[i]-b[i]."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, m)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
