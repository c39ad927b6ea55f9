"""File sources: ingest (O1, O2), identity (O3) and the catalog row builder."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import FAILURE_SCHEMA, FILE_SCHEMA, STORE_COLUMNS
from .listing import list_files, reachable, read_files


# What a file without bytes becomes in the failures, beside its path.
EMPTY_FILE = ("'extract' as stage", "'ExtractionError' as error_class", "'empty file' as message")


def _fs_path(spark: SparkSession, p: str):
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(p)
    return hp, hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, p: str) -> bool:
    hp, fs = _fs_path(spark, p)
    return bool(fs.exists(hp))


def folder_names(spark: SparkSession, p: str) -> set[str]:
    """Names of the folders in a folder of the store (one a run); none where it does not exist."""
    hp, fs = _fs_path(spark, p)
    return {str(x.getPath().getName()) for x in fs.listStatus(hp) if x.isDirectory()} if fs.exists(hp) else set()


def remove_folder(spark: SparkSession, p: str) -> None:
    hp, fs = _fs_path(spark, p)
    fs.delete(hp, True)


def make_folder(spark: SparkSession, p: str) -> None:
    hp, fs = _fs_path(spark, p)
    fs.mkdirs(hp)


def _qualified(spark: SparkSession, p: str) -> tuple[str, bool]:
    """(fully qualified path without a ``file:`` scheme, is a directory)."""
    hp, fs = _fs_path(spark, p)
    q = str(fs.makeQualified(hp).toString())
    if q.startswith("file:"):
        q = q[len("file:"):]
        while q.startswith("//"):
            q = q[1:]
    return q.rstrip("/") or "/", bool(fs.getFileStatus(hp).isDirectory())


def _requested(spark: SparkSession, paths) -> list[str]:
    import os

    # one path or many; str or path objects.  On a local default file system a relative path
    # resolves against the process's working folder (as the reference does); otherwise Hadoop
    # resolves it against the file system's working folder.
    if isinstance(paths, (str, os.PathLike)):
        paths = [paths]
    paths = [os.fspath(p) for p in paths]
    default_fs = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if default_fs.startswith("file:"):
        paths = [p if (":" in p.split("/", 1)[0]) else os.path.abspath(p) for p in paths]
    return paths


def asked_paths(spark: SparkSession, paths) -> DataFrame:
    """One path or many as rows (``path``), for :func:`.listing.list_files`."""
    return spark.createDataFrame([(p,) for p in _requested(spark, paths)], "path string")


def ingest_files(spark: SparkSession, paths, glob: str | None = "*.pdf",
                 recursive: bool = False, max_bytes: int | None = None, report_empty: bool = True,
                 manifest: DataFrame | None = None, limit: int | None = None,
                 listing: str = "auto") -> tuple[DataFrame, DataFrame]:
    """O1/O2: read files (single paths, directories or globs; a list or a DataFrame with column ``path``).

    Returns ``(files, failures)``, files with the columns of the binary file source.  A requested path that does not
    exist is not an error for the job: it becomes a failure row with ``stage='source'`` (the reference silently yields
    nothing).  A 0-byte file is an extraction failure.  Files above ``max_bytes`` are failures too, and their content
    is never read.  ``limit`` takes the first files by path (O33), before any content is read.

    Listing and reading are done by the tasks (:mod:`.listing`): no file name passes the driver.  Where pyarrow
    cannot reach the store, or with ``listing="spark"`` or a ``manifest``, Spark's binary file source is used, which
    lists on the driver; empty files then come from the ``manifest`` (``path``, ``length``) or from that listing.
    """
    if isinstance(paths, DataFrame):
        asked = paths.select("path")
    else:
        paths = _requested(spark, paths)
        asked = asked_paths(spark, paths)
    if listing == "auto":
        one = asked.first()
        listing = "tasks" if manifest is None and (one is None or reachable(spark, one["path"])) else "spark"
    if listing == "spark":
        if isinstance(paths, DataFrame):
            paths = [r["path"] for r in paths.collect()]  # Spark's reader takes a list
        files, failures = _ingest_by_reader(spark, paths, glob, recursive, max_bytes, report_empty, manifest)
        if limit is not None:
            from ..operators.stages import limit_items

            files = limit_items(files, limit)
        return files, failures

    listed, missing = list_files(asked, glob, recursive)
    failures = missing.select(F.col("path").alias("pdf_path"), F.lit("source").alias("stage"), F.lit("FileNotFoundError").alias("error_class"),
                              F.concat(F.lit("no such file: "), "path").alias("message"))
    if report_empty:
        failures = failures.unionByName(empty_files(listed))
    if max_bytes is not None:
        failures = failures.unionByName(_too_large(listed, max_bytes))
        listed = listed.where(F.col("length") <= max_bytes)
    listed = listed.where("length > 0")
    if limit is not None:
        listed = listed.orderBy("path").limit(limit)  # names only
    return read_sized(listed), failures


def empty_files(listed: DataFrame) -> DataFrame:
    """The failures of the listed files without bytes."""
    return listed.where("length = 0").select(S.strip_scheme("path").alias("pdf_path"), *[F.expr(e) for e in EMPTY_FILE])


def read_sized(listed: DataFrame) -> DataFrame:
    """The listed files with their content; the largest length, known from the listing, is noted in the schema."""
    largest = listed.agg(F.max("length")).first()[0] or 0
    # known from the listing, so that nobody has to read the files for it
    length = F.col("length").alias("length", metadata={"max": largest})
    return read_files(listed).select("path", "modificationTime", length, "content")


def _too_large(files: DataFrame, max_bytes: int) -> DataFrame:
    return files.where(F.col("length") > max_bytes).select(
        S.strip_scheme("path").alias("pdf_path"), F.lit("source").alias("stage"), F.lit("FileTooLarge").alias("error_class"),
        F.concat(F.lit("file larger than "), F.lit(str(max_bytes)), F.lit(" bytes")).alias("message"))


def _ingest_by_reader(spark: SparkSession, paths: list[str], glob: str | None, recursive: bool, max_bytes: int | None,
                      report_empty: bool, manifest: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    has_glob = [p for p in paths if any(ch in p for ch in "*?[")]
    existing = [p for p in paths if p in has_glob or path_exists(spark, p)]
    missing = [p for p in paths if p not in existing]
    fail_rows = [(p, "source", "FileNotFoundError", f"no such file: {p}") for p in missing]
    failures = spark.createDataFrame(fail_rows, FAILURE_SCHEMA)
    if not existing:
        return spark.createDataFrame([], FILE_SCHEMA), failures
    # Spark lists folders recursively in any case and would infer partitions
    # from ``k=v`` folder names; recursiveFileLookup turns the inference off.
    # Non-recursive reads keep files whose parent is a requested folder.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(existing)
    keep = None
    if not recursive and not has_glob:  # a glob already names the files it wants
        plain = [_qualified(spark, p) for p in existing]
        dirs = [q for q, is_dir in plain if is_dir]
        singles = [q for q, is_dir in plain if not is_dir]

        def keep(c):
            return F.regexp_replace(c, "/[^/]*$", "").isin(*dirs) | c.isin(*singles)
        files = files.where(keep(S.strip_scheme("path")))
    if report_empty and manifest is not None:
        empty = (manifest.where("length = 0").withColumn("pdf_path", S.strip_scheme("path"))
                 .selectExpr("pdf_path", *EMPTY_FILE))
        failures = failures.unionByName(empty if keep is None else empty.where(keep(F.col("pdf_path"))))
    elif report_empty:
        # inputFiles() gives encoded URIs, the source's path column plain ones
        listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string") \
            .select(S.strip_scheme("path").alias("pdf_path"))
        if keep is not None:
            listed = listed.where(keep(F.col("pdf_path")))
        read = files.select(S.strip_scheme("path").alias("pdf_path"))
        empty = listed.join(read, "pdf_path", "left_anti").selectExpr("pdf_path", *EMPTY_FILE)
        failures = failures.unionByName(empty)
    if max_bytes is not None:
        failures = failures.unionByName(_too_large(files, max_bytes))
        files = files.where(F.col("length") <= max_bytes)
    return files, failures


def file_identity(files: DataFrame) -> DataFrame:
    """O3: absolute path without scheme, SHA-256 of the raw bytes, file name.

    Hash, text and page count all come from the one ``content`` scan.
    """
    return (files.withColumn("pdf_path", S.strip_scheme("path"))
            .withColumn("pdf_hash", S.sha256_hex("content"))
            .withColumn("file_name", S.base_name("pdf_path")))


def build_rows(digests: DataFrame, length: str | Column = "length",
               run_ts: str | Column | None = None, with_id: bool = True) -> DataFrame:
    """Digests (+ identity and page count) → catalog rows in ``STORE_SCHEMA`` order.

    ``id`` is a random v4 UUID, so the result must be written once and read back
    before the ids are used.  ``run_ts`` is one timestamp for the whole run.
    """
    ln = F.col(length) if isinstance(length, str) and length in digests.columns else (
        length if isinstance(length, Column) else F.lit(length))
    ts = (F.current_timestamp() if run_ts is None
          else (run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp")))
    cols = {
        "id": F.expr("uuid()"),
        "pdf_path": F.col("pdf_path"),
        "pdf_hash": F.col("pdf_hash"),
        "page_count": F.coalesce(F.col("page_count").cast("bigint"), F.lit(0).cast("bigint")),
        "summary": F.col("summary"),
        "length": ln,
        "model": F.col("model"),
        "created_at": ts,
        "tokens_in": F.col("tokens_in").cast("bigint"),
        "tokens_out": F.col("tokens_out").cast("bigint"),
        "latency_ms": F.col("latency_ms").cast("bigint"),
    }
    names = STORE_COLUMNS if with_id else STORE_COLUMNS[1:]
    return digests.select(*[cols[n].alias(n) for n in names])
