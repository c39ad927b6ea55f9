"""

Every query reads the driver's ``documents`` table (through the fixtures of
FIXTURES.md part B) so its work grows with the data.  Timestamps leave as
``yyyy-MM-dd HH:mm:ss`` text so they compare across engines; integers are
bigint.  The DuckDB twins are in :mod:`corpusbrief.oracle`.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .operators import catalog as C
from .operators import views as V
from .plans.strategies import with_position
from .session import JOIN_CONF, ensure_checkpoint_dir

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _prep(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, v in JOIN_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    _prep(spark)
    return X.documents(spark, sf)


def _catalog(docs: DataFrame) -> DataFrame:
    """The fixture store as read: rows conformed, tombstoned ids removed (doc_id kept)."""
    return C.apply_tombstones(C.conform(X.summaries_raw(docs)), X.tombstones(docs))


def _ts(c: str = "created_at") -> F.Column:
    return F.date_format(c, TS_TEXT).alias(c)


# ------------------------------------------------------------------ catalog reads

def q_catalog_scan(spark, sf):
    cat = _catalog(_docs(spark, sf))
    return cat.select("id", "pdf_path", "pdf_hash", "page_count", "summary", "length", "model",
                      _ts(), "tokens_in", "tokens_out", "latency_ms")


def _migrated(spark, sf):
    """A store of the first generation (text times, eight columns), written and migrated into a new one."""
    from .session import scratch_path
    from .sources.store import migrate
    old, root = scratch_path(spark, "old-store"), scratch_path(spark, "migrated-store")
    X.summaries_legacy(_docs(spark, sf)).write.parquet(old)
    migrate(spark, old, root)
    return root


def q_migrate_schema(spark, sf):
    from .sources.store import read_catalog
    out = read_catalog(spark, _migrated(spark, sf))
    return out.select(*[c for c in out.columns if c != "created_at"], _ts())


def q_migrate_failures(spark, sf):
    from .sources.store import read_failures
    return read_failures(spark, _migrated(spark, sf))


def q_normalise_rows(spark, sf):
    s = C.normalise(_catalog(_docs(spark, sf)))
    return s.select(*[c for c in s.columns if c != "created_at"], _ts())


def q_list_summaries(spark, sf):
    s = C.normalise(_catalog(_docs(spark, sf))).select("id", "file_name", "page_count", "summary_length", "created_at")
    return with_position(s, C.newest_first()).select("position", "id", "file_name", "page_count", "summary_length", _ts())


def q_list_page(spark, sf):
    """The second page of 50: what follows the last row of the first."""
    cat = _catalog(_docs(spark, sf))
    last = C.list_summaries(cat, 50).select("created_at", "id").tail(1)
    page = C.list_summaries(cat, 50, after=tuple(last[0]) if last else None)
    return page.select("id", "file_name", "page_count", "summary_length", _ts())


def _list_view(spark, sf, full_id):
    cat = _catalog(_docs(spark, sf))
    v = with_position(V.list_view(cat, full_id=full_id), C.newest_first())
    return v.select("position", "display_id", "display_name", "page_count", "summary_length", "created")


def q_list_view(spark, sf):
    return _list_view(spark, sf, False)


def q_list_view_full_id(spark, sf):
    return _list_view(spark, sf, True)


def q_detail_view(spark, sf):
    return V.detail_view(_catalog(_docs(spark, sf)))


def q_result_view(spark, sf):
    return V.result_view(_catalog(_docs(spark, sf)))


def q_usage_label(spark, sf):
    cat = _catalog(_docs(spark, sf))
    from .functions.scalars import usage_label
    return cat.select("id", "tokens_in", "tokens_out", usage_label("tokens_in", "tokens_out").alias("usage"))


def q_usage_rollup(spark, sf):
    return C.usage_rollup(_catalog(_docs(spark, sf)))


# ------------------------------------------------------------------ lookups and deletes

def q_id_kind(spark, sf):
    from .functions.scalars import id_kind
    req = X.requests(_docs(spark, sf))
    return req.select("request_id", "id_text", id_kind("id_text").alias("id_kind"))


def q_validate_requests(spark, sf):
    req = X.requests(_docs(spark, sf))
    return C.validate_requests(req).select("request_id", "id_kind", "resolved_length", "valid", "reason")


def q_default_length(spark, sf):
    from .functions.scalars import resolve_length
    req = X.requests(_docs(spark, sf))
    return req.select("request_id", "length", resolve_length("length").alias("resolved_length"))


def q_get_by_id(spark, sf):
    docs = _docs(spark, sf)
    got = C.get_many(_catalog(docs), X.requests(docs))
    return got.select("request_id", "id_text", "found", "file_name", "summary_length", "page_count")


def q_resolve_prefixes(spark, sf):
    docs = _docs(spark, sf)
    return C.resolve_prefixes(_catalog(docs), X.prefixes(docs)).select(
        "prefix", "match_count", "status", "matched_id")


def q_lookup_requests(spark, sf):
    docs = _docs(spark, sf)
    out = C.lookup(_catalog(docs), X.requests(docs))
    return out.select("request_id", "id_text", "id_kind", "status", "resolved_id", "file_name",
                      "summary_length")


def _full_ids(docs):
    """Every request that names a full id (found or not)."""
    from .functions.scalars import id_kind
    req = X.requests(docs)
    return req.where(id_kind("id_text") == "full").select(F.col("id_text").alias("id"))


def q_delete_ids(spark, sf):
    docs = _docs(spark, sf)
    remaining, _ = C.delete_ids(_catalog(docs), _full_ids(docs))
    return remaining.select("id", "pdf_path")


def q_delete_outcome(spark, sf):
    docs = _docs(spark, sf)
    _, outcome = C.delete_ids(_catalog(docs), _full_ids(docs))
    return outcome


def q_resolve_and_delete(spark, sf):
    """Every catalog row with ``deleted``: whether a prefix resolved to exactly it."""
    docs = _docs(spark, sf)
    cat = _catalog(docs)
    remaining, _ = C.resolve_and_delete(cat, X.prefixes(docs))
    kept = remaining.select("id", F.lit(False).alias("deleted"))
    return (cat.select("id", "pdf_path").join(kept, "id", "left")
            .select("id", "pdf_path", F.coalesce(F.col("deleted"), F.lit(True)).alias("deleted")))


def q_delete_requests(spark, sf):
    docs = _docs(spark, sf)
    _, outcome = C.delete_requests(_catalog(docs), X.requests(docs))
    return outcome.select("request_id", "id_kind", "status", "deleted_id", "gone")


def q_latest_per_path(spark, sf):
    s = C.latest_per_path(_catalog(_docs(spark, sf)))
    return s.select("pdf_path", "id", "summary_length", "page_count", _ts())


def q_latest_for_paths(spark, sf):
    docs = _docs(spark, sf)
    f = X.files(docs)
    # every file path, and a missing variant of every path
    paths = (f.select(F.col("path").alias("req_path"))
             .unionByName(f.select(F.concat(F.col("path"), F.lit(".missing")).alias("req_path")))
             .distinct())
    s = C.latest_per_path(_catalog(docs), paths, "req_path")
    return s.select("req_path", "found", "id", "summary_length", _ts())


# ------------------------------------------------------------------ extractive summariser (flagship)

def _extractive(length):
    def q(spark, sf):
        from .operators.extractive import extractive_summary
        return extractive_summary(_docs(spark, sf), length)
    q.__name__ = f"q_extractive_{length}"
    return q


# ------------------------------------------------------------------ sources and pipeline stages

def _length_by_doc() -> F.Column:
    return (F.when(F.col("doc_id") % 3 == 0, "short").when(F.col("doc_id") % 3 == 1, "standard")
            .otherwise("detailed"))


def _identified(docs):
    from .sources.files import file_identity
    return file_identity(X.files(docs))


def q_file_identity(spark, sf):
    f = _identified(_docs(spark, sf))
    return f.select("doc_id", "pdf_path", "pdf_hash", "file_name", "length")


def q_build_rows(spark, sf):
    from .sources.files import build_rows
    dig = X.summaries_raw(_docs(spark, sf))
    rows = build_rows(dig, "length", X.RUN_TS, with_id=False)
    return rows.select(*[c for c in rows.columns if c != "created_at"], _ts())


def q_extract_text(spark, sf):
    from .operators.stages import extract
    out = extract(_identified(_docs(spark, sf)))
    return out.select("doc_id", "pdf_path", "text", "page_count", "stage")


def q_prefix_summary(spark, sf):
    from .operators.stages import prefix_summary
    docs = _docs(spark, sf)
    d = docs.select("doc_id", prefix_summary("text", _length_by_doc(), "prefix-model").alias("d"))
    return d.select("doc_id", "d.*")


def q_summarize_single(spark, sf):
    from .operators.stages import HashSummarizer, extract, summarize
    docs = extract(_identified(_docs(spark, sf))).withColumn("length", _length_by_doc())
    out = summarize(docs.select("doc_id", "text", "length", "stage", "error_class", "message"),
                    HashSummarizer, key="doc_id")
    return out.select("doc_id", "summary", "tokens_in", "tokens_out", "latency_ms", "model", "stage")


def q_split_chunks(spark, sf):
    from .operators.stages import split_chunks
    docs = _docs(spark, sf)
    c = split_chunks(docs.select("doc_id", "text"), X.FIXTURE_BUDGET_TOKENS * X.CHARS_PER_TOKEN)
    return c.select("doc_id", "chunk_no", "chunk")


def q_chunk_budget(spark, sf):
    from .operators.stages import chunk_budget
    docs = X.summaries_raw(_docs(spark, sf)).select("doc_id", "model")
    return chunk_budget(docs, X.models(spark)).select("doc_id", "model", "budget_tokens")


def q_render_prompts(spark, sf):
    from .operators.stages import render_prompts, resolve_templates
    docs = _docs(spark, sf).select("doc_id", "text", _length_by_doc().alias("length"))
    t = resolve_templates(X.template_overrides(spark))
    return render_prompts(docs, t, X.EXTRA_INSTRUCTIONS).select("doc_id", "length", "prompt")


def q_resolve_templates(spark, sf):
    """O30 per document: the template its length resolves to (override if non-empty, else built-in)."""
    from .operators.stages import resolve_templates
    from .plans.strategies import broadcast_if_small
    docs = _docs(spark, sf).select("doc_id", _length_by_doc().alias("length"))
    t = broadcast_if_small(resolve_templates(X.template_overrides(spark)))
    return docs.join(t, "length", "left").select("doc_id", "length", "template")


def q_limit_items(spark, sf):
    from .operators.stages import limit_items
    return limit_items(X.files(_docs(spark, sf)), 1, ["path", "doc_id"]).select("doc_id", "path")


def q_skip_seen(spark, sf):
    from .operators.stages import skip_seen
    docs = _docs(spark, sf)
    out = skip_seen(_identified(docs), _catalog(docs), ["pdf_path", "doc_id"])
    return out.select("doc_id", "pdf_path", "pdf_hash")


def q_skip_seen_sketch(spark, sf):
    """The same over a written store: files that its sketch does not hold are not compared with the catalog."""
    from .operators.stages import skip_seen
    from .session import scratch_path
    from .sources import store
    docs = _docs(spark, sf)
    root = scratch_path(spark, "sketched-store")
    store.append(root, _catalog(docs))
    out = skip_seen(_identified(docs), store.read_catalog(spark, root), ["pdf_path", "doc_id"], sketch=store.read_sketch(spark, root))
    return out.select("doc_id", "pdf_path", "pdf_hash")


def _failing_run(spark, sf):
    from .operators.stages import FailingExtractor, FailingSummarizer, extract, summarize
    from .plans.strategies import materialize
    docs = _docs(spark, sf)
    ex = extract(_identified(docs), FailingExtractor(), key="doc_id").withColumn("length", _length_by_doc())
    out = summarize(ex.select("doc_id", "pdf_path", "text", "length", "stage", "error_class", "message"),
                    FailingSummarizer)
    return materialize(out, "failing-run")


def q_split_failures(spark, sf):
    from .operators.stages import split_failures
    _, bad = split_failures(_failing_run(spark, sf))
    return bad.select("doc_id", "pdf_path", "stage", "error_class", "message")


def q_classify_failures(spark, sf):
    from .operators.stages import classify_failures, split_failures
    _, bad = split_failures(_failing_run(spark, sf))
    return classify_failures(bad).select("doc_id", "stage", "error_class", "category", "severity", "advice")


def q_run_report(spark, sf):
    from .operators.stages import classify_failures, run_report, split_failures
    _, bad = split_failures(_failing_run(spark, sf))
    return run_report(classify_failures(bad))


def _documents_as_files(spark, sf):
    """The tasks write every document as one text file (``doc_id=<n>/part-*.txt``) in the scratch folder."""
    from .session import scratch_path
    from .sources.listing import reachable, write_files
    docs = _docs(spark, sf).select("doc_id", "text")
    root = scratch_path(spark, "documents-as-files")
    if reachable(spark, root):
        write_files(docs, root, "doc_id", "text")
    else:
        docs.write.partitionBy("doc_id").text(root)
    return root


def _doc_id_from_path(c: str = "pdf_path") -> F.Column:
    return F.regexp_extract(F.col(c), r"/doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id")


def q_ingest_files(spark, sf):
    from .sources.files import file_identity, ingest_files
    files, failures = ingest_files(spark, _documents_as_files(spark, sf), glob="*.txt", recursive=True)
    return file_identity(files).select(_doc_id_from_path(), "pdf_hash", "length")


def q_stream_skip_seen(spark, sf):
    """The stream over files of which some contents are in the store, one of them deleted since: content by content."""
    from .session import scratch_path
    from .sources import store
    from .streaming.ingest import start_ingest
    docs = _docs(spark, sf)
    src, root = _documents_as_files(spark, sf), scratch_path(spark, "stream-seen-store")
    # the files of every fifth document were stored by an earlier run; those of every tenth are deleted again
    body = F.concat("text", F.lit("\n"))
    old = docs.where("doc_id % 5 = 0").select(
        F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("/old/"), F.col("doc_id").cast("string")).alias("pdf_path"),
        F.sha2(body, 256).alias("pdf_hash"), F.lit(1).cast("bigint").alias("page_count"), F.lit("old").alias("summary"),
        F.lit("short").alias("length"), F.lit("old").alias("model"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("tokens_in", "tokens_out", "latency_ms")])
    store.append(root, old, run_id="old")
    store.delete(spark, root, docs.where("doc_id % 10 = 0").select(F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("id")))
    q = start_ingest(spark, src, root, scratch_path(spark, "stream-seen-checkpoint"), glob="*.txt", recursive=True, skip_seen=True,
                     length="short", summarizer="extractive")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"ingest stream failed: {q.exception()}")
    return store.read_catalog(spark, root).groupBy("pdf_hash").agg(
        F.count_if(F.col("model") == "old").alias("n_old"), F.count_if(F.col("model") != "old").alias("n_new"))


def q_stream_ingest(spark, sf):
    from .session import scratch_path
    from .sources.store import read_catalog
    from .streaming.ingest import start_ingest
    src = _documents_as_files(spark, sf)
    root, ck = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-checkpoint")
    q = start_ingest(spark, src, root, ck, glob="*.txt", recursive=True, length="standard",
                     summarizer="extractive", max_files_per_trigger=None)
    q.awaitTermination()  # availableNow: ends after the files present at start; a failure raises here
    if q.exception() is not None:
        raise RuntimeError(f"ingest stream failed: {q.exception()}")
    return read_catalog(spark, root).select(_doc_id_from_path(), "length", "summary", "tokens_out", "model")


def q_summarize_corpus(spark, sf):
    from .operators.stages import HashSummarizer
    from .plans.corpus_run import run_corpus
    docs = _docs(spark, sf)
    files = X.files(docs).withColumn("req_length", _length_by_doc())
    rows, _ = run_corpus(files, length_col="req_length", summarizer=HashSummarizer, chunked=False,
                         run_ts=X.RUN_TS, with_id=False)
    return rows.select(*[c for c in rows.columns if c != "created_at"], _ts())


def q_summarize_corpus_extractive(spark, sf):
    from .plans.corpus_run import run_corpus
    docs = _docs(spark, sf)
    files = X.files(docs).withColumn("req_length", _length_by_doc())
    rows, _ = run_corpus(files, length_col="req_length", summarizer="extractive", run_ts=X.RUN_TS,
                         with_id=False)
    return rows.select(*[c for c in rows.columns if c != "created_at"], _ts())


def q_summarize_chunk_level(spark, sf):
    """One level: digests of the texts that fit, and the next level's chunks of those that do not."""
    from .operators.stages import HashSummarizer
    from .plans.chunked import call_level, combine_level, first_chunks
    docs = _docs(spark, sf)
    rows = docs.select(F.col("doc_id").alias("key"), "text", _length_by_doc().alias("length"),
                       F.lit(X.FIXTURE_BUDGET_TOKENS * X.CHARS_PER_TOKEN).cast("bigint").alias("room"))
    final, nxt, _ = combine_level(call_level(first_chunks(rows), HashSummarizer))
    doc = F.col("key").alias("doc_id")
    out = final.select(doc, F.lit(0).cast("bigint").alias("next_level"), "chunk_no", F.col("summary").alias("text"))
    return out if nxt is None else out.unionByName(
        nxt.select(doc, F.lit(1).cast("bigint").alias("next_level"), "chunk_no", "text"))


def q_summarize_chunked(spark, sf):
    from .operators.stages import HashSummarizer
    from .plans.chunked import summarize_chunked
    docs = _docs(spark, sf).select("doc_id", "text", _length_by_doc().alias("length"))
    out = summarize_chunked(docs, HashSummarizer, X.FIXTURE_BUDGET_TOKENS, X.CHARS_PER_TOKEN)
    return out.select("doc_id", "summary", "tokens_in", "tokens_out", "latency_ms", "levels", "stage")


def q_chunked_accounting(spark, sf):
    """Every row ends once, as a digest or as a failure: some have no text, an unknown length, no id or another's id."""
    from .operators.stages import HashSummarizer, resolve_templates
    from .plans.chunked import summarize_chunked
    docs = _docs(spark, sf).select(
        F.when(F.col("doc_id") % 41 == 0, None).when(F.col("doc_id") % 43 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("id"),
        F.when(F.col("doc_id") % 31 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 37 == 0, "long").otherwise(_length_by_doc()).alias("length"))
    out = summarize_chunked(docs, HashSummarizer, X.FIXTURE_BUDGET_TOKENS, X.CHARS_PER_TOKEN, id_col="id",
                            templates=resolve_templates(X.template_overrides(spark)), extra=X.EXTRA_INSTRUCTIONS)
    return out.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("summary").alias("n_digests"), F.countDistinct("summary").alias("n_different"),
        F.max("stage").alias("stage"), F.max("message").alias("message"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "catalog_scan": q_catalog_scan,
    "migrate_schema": q_migrate_schema,
    "migrate_failures": q_migrate_failures,
    "normalise_rows": q_normalise_rows,
    "list_summaries": q_list_summaries,
    "list_page": q_list_page,
    "list_view": q_list_view,
    "list_view_full_id": q_list_view_full_id,
    "detail_view": q_detail_view,
    "result_view": q_result_view,
    "usage_label": q_usage_label,
    "usage_rollup": q_usage_rollup,
    "id_kind": q_id_kind,
    "validate_requests": q_validate_requests,
    "default_length": q_default_length,
    "get_by_id": q_get_by_id,
    "resolve_prefixes": q_resolve_prefixes,
    "lookup_requests": q_lookup_requests,
    "delete_ids": q_delete_ids,
    "delete_outcome": q_delete_outcome,
    "resolve_and_delete": q_resolve_and_delete,
    "delete_requests": q_delete_requests,
    "latest_per_path": q_latest_per_path,
    "latest_for_paths": q_latest_for_paths,
    "extractive_short": _extractive("short"),
    "extractive_standard": _extractive("standard"),
    "extractive_detailed": _extractive("detailed"),
    "file_identity": q_file_identity,
    "build_rows": q_build_rows,
    "extract_text": q_extract_text,
    "prefix_summary": q_prefix_summary,
    "summarize_single": q_summarize_single,
    "split_chunks": q_split_chunks,
    "chunk_budget": q_chunk_budget,
    "resolve_templates": q_resolve_templates,
    "render_prompts": q_render_prompts,
    "limit_items": q_limit_items,
    "skip_seen": q_skip_seen,
    "skip_seen_sketch": q_skip_seen_sketch,
    "split_failures": q_split_failures,
    "classify_failures": q_classify_failures,
    "run_report": q_run_report,
    "summarize_corpus": q_summarize_corpus,
    "summarize_corpus_extractive": q_summarize_corpus_extractive,
    "summarize_chunk_level": q_summarize_chunk_level,
    "summarize_chunked": q_summarize_chunked,
    "chunked_accounting": q_chunked_accounting,
    "ingest_files": q_ingest_files,
    "stream_ingest": q_stream_ingest,
    "stream_skip_seen": q_stream_skip_seen,
}
