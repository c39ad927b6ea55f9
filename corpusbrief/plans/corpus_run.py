"""The whole summarisation run as one DataFrame chain.

    files → identity (O3) → [item limit O33] → [skip seen O34] → extract (O23)
          → prompts (O30, O31) → summarise single (O24) / chunked (O25) / extractive (O28)
          → catalog rows (O5) ; failures on the side (O35)

The result is ``(rows, failures)``; ``append`` (O5 sink) writes the rows.
Python stages are written to the shared scratch folder once, so the split
into rows and failures does not call the summariser twice.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stages as ST
from ..operators.call_log import logged
from ..operators.extractive import SPREAD_BYTES, extractive_summary
from ..sources.files import build_rows, file_identity
from .chunked import summarize_chunked
from .strategies import materialize

EXTRACTIVE_MODEL = "extractive"


def run_corpus(files: DataFrame, length: str | None = None, length_col: str | None = None,
               extractor: Callable | None = None, summarizer: str | Callable = "extractive",
               chunked: bool = True, models: DataFrame | None = None, model: str | None = None,
               budget_tokens: int | None = None, chars_per_token: int = 4,
               templates: DataFrame | None = None, extra_instructions: str = "",
               use_prompts: bool = False, catalog: DataFrame | None = None,
               sketch: DataFrame | None = None, limit: int | None = None, run_ts: str | None = None, id_col: str = "doc_id",
               with_id: bool = True, write_stages: bool = True, call_log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Summarise every file; return (catalog rows, failures).

    ``summarizer`` is ``"extractive"`` (O28, Spark SQL, no Python) or a
    zero-argument factory of a callable ``(text, length) -> Digest``.
    ``length`` applies to every file, or ``length_col`` names a per-file column.
    ``catalog`` turns on the content-hash skip (O34); with its ``sketch`` (``store.read_sketch``) only files
    that it may hold are compared with it.  ``call_log`` names a shared folder of the calls already made for
    ``model`` (:mod:`..operators.call_log`); a run that is started again makes the others only.
    """
    from ..schemas import DEFAULT_LENGTH

    if call_log is not None and summarizer != "extractive":
        summarizer = logged(summarizer, call_log, model or "model")
    if limit is not None:  # before any content is read for its hash
        files = ST.limit_items(files, limit, ["path"] + [id_col] * (id_col in files.columns))
    f = file_identity(files)
    if id_col not in f.columns:
        # a file source names every file once: the path is a stable document key
        id_col = "pdf_path"
    if catalog is not None:
        f = ST.skip_seen(f, catalog, list(dict.fromkeys(["pdf_path", id_col])), sketch=sketch)
    # the file's length is known before its content is read: O28 takes the sizes of texts from it
    sized = "length" in files.columns
    # no file of the listing is long: no branch for long texts, which would read the files a second time
    largest = files.schema["length"].metadata.get("max") if sized else None
    f = f.withColumn("_bytes", F.col("length").cast("bigint") if sized else F.lit(None).cast("bigint"))
    ln = F.col(length_col) if length_col else F.lit(length or DEFAULT_LENGTH)
    f = f.withColumn("length", ln)
    docs = ST.extract(f, extractor, key=id_col)
    if write_stages and extractor is not None:
        docs = materialize(docs, "extracted")
    keep = list(dict.fromkeys([id_col, "pdf_path", "pdf_hash", "page_count", "length"]))

    if summarizer == "extractive":
        ok, bad = ST.split_failures(docs)
        known = (ok.where(F.col("length").isin("short", "standard", "detailed"))
                 .withColumn("_chars", F.length("text")))
        dig = extractive_summary(known, None, id_col=id_col, length_col="length",
                                 size_col="_bytes" if sized else None,
                                 spread_bytes=None if largest is not None and largest <= SPREAD_BYTES else SPREAD_BYTES,
                                 carry=[c for c in ("pdf_path", "pdf_hash", "page_count", "_chars")
                                        if c != id_col])
        dig = dig.select(*keep, "summary",
                         F.ceil(F.length(F.col("summary")) / chars_per_token).cast("bigint").alias("tokens_out"),
                         # the whole text is read: the same chars/token estimate as the chunk budget
                         F.ceil(F.col("_chars") / chars_per_token).cast("bigint").alias("tokens_in"),
                         F.lit(None).cast("bigint").alias("latency_ms"),
                         F.lit(model or EXTRACTIVE_MODEL).alias("model"))
        wrong = ok.where(~F.col("length").isin("short", "standard", "detailed")).select(
            "pdf_path", F.lit("summarize").alias("stage"), F.lit("SummarizationError").alias("error_class"),
            F.concat(F.lit("unknown length "), F.coalesce(F.col("length"), F.lit("NULL"))).alias("message"))
        failures = bad.select("pdf_path", *ST.ERROR_COLS).unionByName(wrong)
        return build_rows(dig, "length", run_ts, with_id=with_id), failures

    text_col = "text"
    templates = ST.resolve_templates(templates) if use_prompts else None
    if use_prompts and not chunked:
        docs = ST.render_prompts(docs, templates, extra_instructions)
        text_col = "prompt"
    if chunked:
        if models is not None:
            docs = ST.chunk_budget(docs.withColumn("model", F.lit(model)), models)
        else:
            docs = docs.withColumn("budget_tokens", F.lit(budget_tokens or ST.DEFAULT_BUDGET_TOKENS))
        key_cols = [c for c in ("pdf_path", "pdf_hash", "page_count") if c != id_col]
        src = docs.where(F.col("stage").isNull()).select(
            id_col, *key_cols, F.col(text_col).alias("text"), "length", "budget_tokens")
        dig = summarize_chunked(src, summarizer, "budget_tokens", chars_per_token,
                                id_col=id_col, key_cols=key_cols, templates=templates, extra=extra_instructions)
        early = docs.where(F.col("stage").isNotNull()).select("pdf_path", *ST.ERROR_COLS)
    else:
        dig = ST.summarize(docs.select(*keep, F.col(text_col).alias("text"), *ST.ERROR_COLS),
                           summarizer, "text", "length", key=id_col)
        if write_stages:
            dig = materialize(dig, "digests")
        early = None
    ok, bad = ST.split_failures(dig)
    failures = bad.select("pdf_path", *ST.ERROR_COLS)
    if early is not None:
        failures = early.unionByName(failures)
    return build_rows(ok, "length", run_ts, with_id=with_id), failures
