"""Spark session defaults and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for every job in the package.  On a cluster these are
# normally set by the submitter; ``get_session`` only fills what is unset.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no broadcast from plan-time size estimates (they can be far off for
    # exploded or filtered inputs); AQE broadcasts a join side only after its
    # shuffle stage has run and measured below this size
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a listing of many folders or files takes so many tasks at most (Spark: 10,000, for each look at a folder of as many files)
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Python stages receive file contents: bound each Arrow batch by bytes as well as rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # checkpoints written by with_position are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "corpusbrief",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is only applied when given, so ``spark-submit`` settings win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's executors, for Python stages where it is not installed there.

    Needed once per session that was not started from the repository folder (and not submitted with
    ``--py-files``); the archive goes through Spark's own file distribution.
    """
    import io
    import zipfile

    top = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    folder = tempfile.mkdtemp(prefix="corpusbrief-ship-")  # read by the driver's file server only
    path = os.path.join(folder, "corpusbrief.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)


# settings the registered queries apply to whatever session runs them
JOIN_CONF = {k: DEFAULT_CONF[k] for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled",
                                          "spark.sql.adaptive.skewJoin.enabled",
                                          "spark.sql.sources.parallelPartitionDiscovery.parallelism",
                                          "spark.sql.execution.arrow.maxBytesPerBatch")}


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared scratch folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the submitter (a shared file
    system); it is never invented here.  Only a local session without the
    setting (tests, the bench) gets a fresh folder under the system temp dir.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        d = str(d)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="corpusbrief-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared scratch folder for written intermediates."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
