"""The catalog store: Parquet rows plus append-only tombstones.

Layout under ``root``::

    data/run=<id>/   catalog rows of one run or stream batch (STORE_SCHEMA; older
                     generations may lack columns)
    tombstones/      ids deleted, with the delete time
    failures/run=<id>/  failure rows of a run
    pending/run=<id>/   there while a run is written: readers pass over its rows and failures
    sketch/run=<id>/    Bloom sketch of the run's content hashes (operators/sketch.py)

Parquet files are immutable and a job must never overwrite the folder it
reads, so a delete appends tombstones and every read applies them
(left-anti join).  ``compact`` writes the live rows to a *new* root.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import apply_tombstones, conform, delete_ids, migrate_rows, restrict, without_ids
from ..operators.sketch import merged, sketch_of
from ..plans.strategies import materialize
from ..schemas import FAILURE_SCHEMA, STORE_COLUMNS, STORE_SCHEMA, TOMBSTONE_SCHEMA
from .files import folder_names, make_folder, path_exists, remove_folder


def _data(root: str) -> str:
    return root.rstrip("/") + "/data"


def _tomb(root: str) -> str:
    return root.rstrip("/") + "/tombstones"


def _settled(spark: SparkSession, root: str, rows: DataFrame, without_run: str | None = None) -> DataFrame:
    """``rows`` of the store without those of runs that are being written (or were stopped) and of ``without_run``."""
    out = folder_names(spark, root.rstrip("/") + "/pending") | ({f"run={without_run}"} if without_run is not None else set())
    for run in sorted(out):
        rows = rows.where(~F.col("_metadata.file_path").contains(f"/{run}/"))
    return rows


def read_catalog(spark: SparkSession, root: str, without_run: str | None = None) -> DataFrame:
    """Live catalog rows; a store that does not exist yet reads as empty.

    ``without_run`` leaves out one run's folder: a replayed batch must not see its own earlier rows.
    """
    if not path_exists(spark, _data(root)):
        return spark.createDataFrame([], STORE_SCHEMA)
    # explicit schema: files written before the usage columns existed read them as NULL
    rows = _settled(spark, root, spark.read.schema(STORE_SCHEMA).parquet(_data(root)), without_run)
    rows = conform(rows).select(*STORE_COLUMNS)
    if path_exists(spark, _tomb(root)):
        rows = apply_tombstones(rows, spark.read.schema(TOMBSTONE_SCHEMA).parquet(_tomb(root)))
    return rows


def run_dir(root: str, run_id: str, kind: str = "data") -> str:
    return f"{root.rstrip('/')}/{kind}/run={run_id}"


def append(root: str, rows: DataFrame, run_id: str | None = None,
           failures: DataFrame | None = None) -> str:
    """O5 sink: write one run's rows (and failures) as a new ``run=`` folder; returns the run id.

    Re-writing the same ``run_id`` replaces that run only, so a replayed
    stream batch is idempotent.  Rows and failures become visible together: until both are written the run is
    pending, and a run that was stopped stays so until it is written again.
    """
    import uuid

    run_id = run_id or uuid.uuid4().hex
    spark = rows.sparkSession
    pending = run_dir(root, run_id, "pending")
    make_folder(spark, pending)
    # a sketch must never miss a row: none while the rows are replaced (a run without one is read itself)
    remove_folder(spark, run_dir(root, run_id, "sketch"))
    conform(rows).select(*STORE_COLUMNS).write.mode("overwrite").parquet(run_dir(root, run_id))
    written = spark.read.schema(STORE_SCHEMA).parquet(run_dir(root, run_id))
    sketch_of(written, "pdf_hash").coalesce(1).write.mode("overwrite").parquet(run_dir(root, run_id, "sketch"))
    if failures is not None:
        failures.write.mode("overwrite").parquet(run_dir(root, run_id, "failures"))
    remove_folder(spark, pending)
    return run_id


def read_sketch(spark: SparkSession, root: str) -> DataFrame:
    """The merged sketch of the content hashes of every run (deleted ones too: the catalog decides).

    Runs without a sketch (older stores, a run stopped before it) have theirs made from their rows.
    """
    runs, with_sketch = folder_names(spark, _data(root)), folder_names(spark, root.rstrip("/") + "/sketch")
    parts = [spark.createDataFrame([], "word long, bits long")]
    if with_sketch:
        parts.append(spark.read.schema("word long, bits long").parquet(root.rstrip("/") + "/sketch").select("word", "bits"))
    if bare := sorted(runs - with_sketch):
        rows = spark.read.schema(STORE_SCHEMA).parquet(*[f"{_data(root)}/{r}" for r in bare])
        parts.append(sketch_of(rows, "pdf_hash"))
    return merged(reduce(DataFrame.unionByName, parts))


def migrate(spark: SparkSession, old_data: str, root: str) -> str:
    """Take one generation of an older store (a Parquet folder, read by its own schema) into ``root``.

    Text times are parsed, missing columns come as NULL, and rows without a readable time go to the
    failures of the run.  The run is named by the old folder, so a repeated migration replaces itself.
    """
    import hashlib

    rows, failures = migrate_rows(spark.read.parquet(old_data))
    return append(root, rows, "migrated-" + hashlib.sha1(old_data.rstrip("/").encode()).hexdigest()[:10], failures)


def read_failures(spark: SparkSession, root: str, without_run: str | None = None) -> DataFrame:
    """Failure rows of every run of the store (but one, if named); empty where there are none."""
    path = root.rstrip("/") + "/failures"
    if not path_exists(spark, path):
        return spark.createDataFrame([], FAILURE_SCHEMA)
    rows = _settled(spark, root, spark.read.schema(FAILURE_SCHEMA).parquet(path), without_run)
    return rows.select(*FAILURE_SCHEMA.fieldNames())


def delete(spark: SparkSession, root: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Delete a batch of ids; returns the outcome per id (``deleted``).

    The outcome is written before the tombstones, so it reflects the catalog
    as it was; deleting an id twice is a no-op the second time.
    """
    catalog = read_catalog(spark, root)
    _, outcome = delete_ids(catalog, ids, id_col)
    outcome = materialize(outcome, "delete-outcome")
    gone = outcome.where("deleted").select("id")
    # hashes of which no live row is left: such content is new again for a stream that skips what it has seen
    hashed = catalog.select("id", "pdf_hash")
    removed = materialize(restrict(hashed, "id", gone).join(gone, "id", "left_semi"), "removed-hashes")
    left = (without_ids(restrict(hashed, "pdf_hash", removed.select("pdf_hash")), gone).select("pdf_hash").distinct()
            .withColumn("_left", F.lit(True)))
    freed = removed.join(left, "pdf_hash", "left").select(
        "id", F.when(F.col("_left").isNull(), F.col("pdf_hash")).alias("pdf_hash"))
    (gone.join(freed, "id", "left").select("id", F.current_timestamp().alias("deleted_at"), "pdf_hash")
     .write.mode("append").parquet(_tomb(root)))
    return outcome


def compact(spark: SparkSession, root: str, new_root: str, files: int | None = None) -> None:
    """Write the live rows of ``root`` to ``new_root`` (never in place), clustered by id.

    Each file then holds a range of ids, so that lookups by id or prefix skip the others by their statistics.
    ``files`` sets their number; by default it follows from the size of the rows.
    """
    if new_root.rstrip("/") == root.rstrip("/"):
        raise ValueError("compact must write to a new root")
    rows = read_catalog(spark, root)
    rows = rows.repartitionByRange(files, "id").sortWithinPartitions("id") if files else rows.orderBy("id")
    rows.write.mode("errorifexists").parquet(run_dir(new_root, "compacted"))
