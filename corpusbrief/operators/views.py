"""Display views of catalog rows (the reference's list / show / result screens as columns)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .catalog import normalise


def _read_model(df: DataFrame) -> DataFrame:
    return df if "file_name" in df.columns else normalise(df)


def list_view(catalog: DataFrame, full_id: bool = False) -> DataFrame:
    """Id (8 chars or full), cut file name, pages, length, 'yyyy-MM-dd HH:mm'."""
    s = _read_model(catalog)
    return s.select(
        (F.col("id") if full_id else S.short_id("id")).alias("display_id"),
        S.truncate_name("file_name").alias("display_name"),
        "page_count", "summary_length",
        S.list_time("created_at").alias("created"),
        "id", "created_at")


def detail_view(catalog: DataFrame) -> DataFrame:
    """Every field; usage and latency lines only when there is a value."""
    s = _read_model(catalog)
    usage = S.usage_label("tokens_in", "tokens_out")
    return s.select(
        "id", "file_name", "pdf_path", "page_count", "summary_length", "model_name",
        F.nullif(usage, F.lit("")).alias("usage_line"),
        S.latency_label("latency_ms").alias("latency_line"),
        S.detail_time("created_at").alias("created"),
        "summary_text")


def result_view(catalog: DataFrame) -> DataFrame:
    """Header, summary text and footer (model, id, usage if any)."""
    s = _read_model(catalog)
    h_pre, rest = S.RESULT_HEADER.split("{file_name}")
    h_mid, h_post = rest.split("{page_count}")
    f_pre, rest = S.RESULT_FOOTER.split("{model}")
    f_mid, f_post = rest.split("{id}")
    usage = F.nullif(S.usage_label("tokens_in", "tokens_out"), F.lit(""))
    return s.select(
        "id",
        F.concat(F.lit(h_pre), F.col("file_name"), F.lit(h_mid),
                 F.col("page_count").cast("string"), F.lit(h_post)).alias("header"),
        "summary_text",
        F.concat_ws(" | ", F.concat(F.lit(f_pre), F.col("model_name"), F.lit(f_mid),
                                    F.col("id"), F.lit(f_post)), usage).alias("footer"))
