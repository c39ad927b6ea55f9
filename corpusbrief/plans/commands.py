"""The reference's four user commands as batch functions over a store folder.

    summarize  → summarize_paths   (ingest, run, append; result view of the new rows)
    list       → list_catalog      (list view, newest first)
    show       → show_requests     (id dispatch, detail view)
    delete     → delete_requests   (id dispatch, tombstones)

Each takes a whole batch (many paths or many ids) and returns DataFrames; all
work is the operators' Spark jobs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import views as V
from ..sources import store
from ..sources.files import ingest_files
from .corpus_run import run_corpus
from .strategies import materialize


def summarize_paths(spark: SparkSession, root: str, paths: str | list[str], length: str | None = None,
                    default_length: str = "standard", skip_seen: bool = False, glob: str | None = "*.pdf",
                    recursive: bool = False, limit: int | None = None, **run_kwargs) -> tuple[DataFrame, DataFrame]:
    """Summarise files and append them to the store; returns (result view of the new rows, failures).

    Missing paths and empty files are failures (``stage='source'`` / ``'extract'``);
    the rest of the batch still runs.  With ``skip_seen`` files whose content
    is already in the catalog are not summarised again.
    """
    files, missing = ingest_files(spark, paths, glob=glob, recursive=recursive, limit=limit)
    catalog = store.read_catalog(spark, root) if skip_seen else None
    sketch = store.read_sketch(spark, root) if skip_seen else None
    rows, failures = run_corpus(files, length=length or default_length, catalog=catalog, sketch=sketch, **run_kwargs)
    rows = materialize(rows, "summarize-rows")  # ids are random: fix them before reuse
    failures = materialize(missing.unionByName(failures), "summarize-failures")
    store.append(root, rows, failures=failures)
    return V.result_view(rows), failures


def list_catalog(spark: SparkSession, root: str, full_id: bool = False) -> DataFrame:
    """The list view of the whole catalog, newest first."""
    return V.list_view(store.read_catalog(spark, root), full_id=full_id).orderBy(*C.newest_first())


def show_requests(spark: SparkSession, root: str, requests: DataFrame, id_col: str = "id_text") -> DataFrame:
    """Detail view per request: full id → exact row, 8-hex prefix → the one matching row.

    ``status`` is ok / not_found / ambiguous / invalid; the view columns are
    NULL unless ok.
    """
    looked = C.lookup(store.read_catalog(spark, root), requests, id_col)
    detail = V.detail_view(looked.where(F.col("status") == "ok").select(
        "resolved_id", "pdf_path", "pdf_hash", "file_name", "page_count", "summary_text", "summary_length",
        "model_name", "created_at", "tokens_in", "tokens_out", "latency_ms").withColumnRenamed("resolved_id", "id"))
    return (looked.select(*requests.columns, "id_kind", "status", "resolved_id")
            .join(detail.withColumnRenamed("id", "resolved_id"), "resolved_id", "left"))


def delete_requests(spark: SparkSession, root: str, requests: DataFrame, id_col: str = "id_text") -> DataFrame:
    """Delete the rows the requests name (full id, or a prefix naming exactly one row).

    Returns the outcome per request (``status``, ``deleted_id``); a second
    delete of the same id finds nothing.
    """
    _, outcome = C.delete_requests(store.read_catalog(spark, root), requests, id_col)
    outcome = materialize(outcome, "delete-requests")
    ids = outcome.where(F.col("deleted_id").isNotNull()).select(F.col("deleted_id").alias("id"))
    store.delete(spark, root, ids)
    return outcome
