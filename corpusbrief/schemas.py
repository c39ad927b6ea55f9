"""Explicit schemas of the stored catalog and the pipeline's intermediate rows."""
from __future__ import annotations

from pyspark.sql import types as T

# Length domain and default, as in the reference.
LENGTHS = ("short", "standard", "detailed")
DEFAULT_LENGTH = "standard"

# The catalog row (column order of the reference's table).  ``created_at`` is a
# timestamp in our store; legacy input may carry ISO text, converted on read.
STORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("pdf_hash", T.StringType()),
    T.StructField("page_count", T.LongType()),
    T.StructField("summary", T.StringType()),
    T.StructField("length", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("latency_ms", T.LongType()),
])
STORE_COLUMNS = [f.name for f in STORE_SCHEMA.fields]

# Columns added by the one schema migration, in the order they are added.
ADDED_COLUMNS = {"tokens_in": T.LongType(), "tokens_out": T.LongType(), "latency_ms": T.LongType()}

# Read model: stored row with renames and the derived file name.
SUMMARY_COLUMNS = ["id", "pdf_path", "pdf_hash", "file_name", "page_count", "summary_text",
                   "summary_length", "model_name", "created_at", "tokens_in", "tokens_out",
                   "latency_ms"]

# Output of a summariser call.
DIGEST_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("model", T.StringType()),
])

# Columns of Spark's binary file source.
FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# One row per input that did not make it to the catalog.
FAILURE_SCHEMA = T.StructType([
    T.StructField("pdf_path", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("message", T.StringType()),
])

# Appended on delete; applied on every read of the store.  ``pdf_hash``: set where no other live row has this content.
TOMBSTONE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("deleted_at", T.TimestampType()),
    T.StructField("pdf_hash", T.StringType()),
])
