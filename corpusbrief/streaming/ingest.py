"""Incremental ingest with Structured Streaming.

New files arriving in a folder are taken as a stream of their names, each
micro-batch reads its files, runs the whole summarisation (O22) and is written to the store as
its own ``run=stream-<stream tag>-<batch id>`` folder with overwrite, so a batch replayed
after a failure replaces its earlier partial output instead of duplicating it.
The tasks list the folder (:mod:`..sources.listing`) and append the names that are new to a log of Parquet files
in the checkpoint (:func:`note_names`); the stream's source is this log, and the tasks read the files.
Spark's binary file source would list the folder on the driver, three times a start, and plan a task for every few files. It is used
where the tasks cannot read the files, and for checkpoints begun with it.
Files are to be moved in whole: a path is taken once, so a file that was empty then is not read when it grows.
Files without bytes are no rows of a batch.  The first batch after each start reports those
of the folder that no other run reported yet.
Without ``skip_seen`` the stream is stateless (no watermark): a file is one self-contained unit.

With ``skip_seen`` the stream keeps the content hashes it has seen as the keyed state of an aggregation (:func:`admitted`),
so that no batch reads the catalog and no group is passed to Python.  Rows that others store and hashes that a delete frees come in as streams of the store's own
folders.  The state grows with the distinct contents, as the catalog does; it lies in the checkpoint, partitioned by hash.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.corpus_run import run_corpus
from ..plans.strategies import materialize
from ..schemas import FILE_SCHEMA, STORE_SCHEMA, TOMBSTONE_SCHEMA
from ..sources.files import asked_paths, empty_files, file_identity, ingest_files, make_folder, path_exists, read_sized
from ..sources.listing import MAGIC, list_files, reachable, read_files
from ..sources.store import append, read_catalog, read_failures

NAMES = "path string, modificationTime timestamp, length long"
POLL_SECONDS = 30


def file_stream(spark: SparkSession, input_dir: str, glob: str | None = "*.pdf",
                max_files_per_trigger: int | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(input_dir)


def note_names(spark: SparkSession, input_dir: str, log: str, glob: str | None = "*.pdf", recursive: bool = False,
               at_most: int | None = None) -> DataFrame:
    """Append the files of the folder that the ``log`` does not name yet to it; returns all files listed (:data:`NAMES`).

    A file of the log becomes visible whole, and what a stopped call did not write is new to the next one.  ``at_most``
    bounds the names in a file of the log, cut in the order of their times.
    """
    listed, missing = list_files(asked_paths(spark, input_dir), glob, recursive)
    if not MAGIC.search(input_dir) and not missing.isEmpty():
        raise FileNotFoundError(f"no such folder: {input_dir}")
    new = materialize(listed.join(spark.read.schema(NAMES).parquet(log).select("path"), "path", "left_anti"), "new-names")
    if not new.isEmpty():  # else an empty file would be written, and be a batch
        ordered = new.orderBy("modificationTime", "path") if at_most else new
        ordered.write.mode("append").option("maxRecordsPerFile", at_most or 0).parquet(log)
    return listed


def name_stream(spark: SparkSession, log: str, one_file: bool = False) -> DataFrame:
    """The names of the log as a stream; with ``one_file`` those of one file of the log at a time."""
    reader = spark.readStream.schema(NAMES)
    return (reader.option("maxFilesPerTrigger", "1") if one_file else reader).parquet(log)


def _keep_noting(query: StreamingQuery, note: Callable[[], DataFrame], seconds: int) -> None:
    """Call ``note`` every so many seconds while the stream runs; the stream is stopped where that fails."""
    import threading

    def run() -> None:
        try:
            while not query.awaitTermination(seconds):
                note()
        except Exception:  # noqa: BLE001 - of a stream that ended meanwhile, whose own error its caller sees
            if query.isActive:
                query.stop()
                raise

    threading.Thread(target=run, daemon=True, name="corpusbrief-names").start()


def admitted(files: DataFrame, store_root: str) -> DataFrame:
    """(path, modificationTime, length) of the files of a stream whose content is new, one a content: the first by path.

    Content that the store holds is not new, unless its last row was deleted after it was stored.  What was stored or freed
    up to a batch counts before its files, in its order.  Files are hashed where they are read; names and hashes alone are
    shuffled.  The state is that of a streaming aggregation (of its output mode ``update``): for each hash its
    last event, the first file of its last batch, and the times of the batches that had files of it.
    """
    spark, root = files.sparkSession, store_root.rstrip("/")
    for kind in ("data", "tombstones"):
        make_folder(spark, f"{root}/{kind}")  # a stream's folder has to be there

    def told(folder: str, schema, kind: str, at: str) -> DataFrame:
        rows = spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{root}/{folder}")
        return rows.where("pdf_hash is not null").select(
            "pdf_hash", F.lit(kind).alias("kind"), F.col(at).alias("at"), F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("bigint").alias("length"))

    new = file_identity(files).select("pdf_hash", F.lit("file").alias("kind"), F.col("modificationTime").alias("at"),
                                      "path", "modificationTime", "length")
    rows = new.unionByName(told("data", STORE_SCHEMA, "stored", "created_at")).unionByName(
        told("tombstones", TOMBSTONE_SCHEMA, "freed", "deleted_at"))
    now = F.unix_micros(F.current_timestamp()).alias("now")  # in a stream the time of the batch, also where it is replayed
    is_file = F.col("kind") == "file"
    known = rows.select("*", now).groupBy("pdf_hash").agg(
        F.min(F.when(is_file, F.struct((-F.col("now")).alias("before"), "path", "modificationTime", "length"))).alias("file"),
        F.max(F.when(~is_file, F.struct(F.col("now").alias("told"), "at", "kind"))).alias("event"),
        F.collect_set(F.when(is_file, F.col("now"))).alias("batches")).select("*", now)
    # taken: a file of an earlier batch, and not freed since
    taken = F.exists("batches", lambda t: (t < F.col("now")) & (t >= F.coalesce(F.col("event.told"), F.lit(0))))
    stored = F.coalesce(F.col("event.kind") == "stored", F.lit(False))
    new = known.where((F.col("file.before") == -F.col("now")) & ~stored & ~taken)
    return new.select("file.path", "file.modificationTime", "file.length")


def start_ingest(spark: SparkSession, input_dir: str, store_root: str, checkpoint: str,
                 glob: str | None = "*.pdf", skip_seen: bool = False, available_now: bool = True,
                 max_files_per_trigger: int | None = None, recursive: bool = False,
                 report_empty: bool = True, **run_kwargs) -> StreamingQuery:
    """Start the ingest stream; ``run_kwargs`` go to :func:`run_corpus` (length, summarizer, ...).

    ``skip_seen`` skips files whose content hash is already in the live
    catalog (the documented cache), by state; such a stream has a checkpoint of its own inside ``checkpoint``.
    Where the tasks cannot read the files (:mod:`..sources.listing`), each batch is compared with the catalog instead.
    With ``available_now`` the stream processes what is there and stops; otherwise it keeps polling.
    """
    import hashlib

    by_tasks = reachable(spark, input_dir)
    by_state = skip_seen and by_tasks
    if by_state:
        checkpoint = checkpoint.rstrip("/") + "/admission"

    # one stream (one checkpoint) owns its run folders: a replayed batch replaces its own output,
    # and two streams into one store never share a folder
    tag = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:10]

    names = checkpoint.rstrip("/") + "/names"
    # a checkpoint begun with Spark's file source goes on with it
    noted = path_exists(spark, names) or by_tasks and not path_exists(spark, checkpoint.rstrip("/") + "/offsets")
    if noted and not by_tasks:
        raise RuntimeError(f"the tasks cannot read {input_dir}, which the stream of {checkpoint} was begun with")

    def note() -> DataFrame:
        return note_names(spark, input_dir, names, glob, recursive, max_files_per_trigger)

    if noted:
        make_folder(spark, names)
        listed = note()
    to_report = [report_empty]

    def batch(df: DataFrame, batch_id: int) -> None:
        run_id = f"stream-{tag}-{batch_id}"
        # a replay sees the same catalog as the first try: everything but its own rows
        catalog = read_catalog(spark, store_root, without_run=run_id) if skip_seen and not by_state else None
        # names, written: the state is asked and the source planned once a batch, the tasks read
        if by_tasks:
            df = read_sized(materialize(df.select("path", "modificationTime", "length").where("length > 0"), f"admitted-{batch_id}"))
        rows, failures = run_corpus(df, catalog=catalog, **run_kwargs)
        # both are written before either folder of the run is replaced
        rows = materialize(rows, f"stream-rows-{batch_id}")
        if to_report and to_report.pop():
            empty = empty_files(listed) if noted else ingest_files(df.sparkSession, input_dir, glob, recursive)[1]
            known = read_failures(spark, store_root, without_run=run_id).select("pdf_path")
            failures = failures.unionByName(empty.join(known, "pdf_path", "left_anti"))
        failures = materialize(failures, f"stream-failures-{batch_id}")
        append(store_root, rows, run_id=run_id, failures=failures)

    if noted:
        files = name_stream(spark, names, one_file=max_files_per_trigger is not None)
        files = read_files(files.where("length > 0")) if by_state else files
    else:
        files = file_stream(spark, input_dir, glob, max_files_per_trigger, recursive)
    w = ((admitted(files, store_root) if by_state else files).writeStream.outputMode("update" if by_state else "append")
         .foreachBatch(batch).option("checkpointLocation", checkpoint))
    if available_now:
        return w.trigger(availableNow=True).start()
    query = w.trigger(processingTime=f"{POLL_SECONDS} seconds").start()
    if noted:
        _keep_noting(query, note, POLL_SECONDS)
    return query
