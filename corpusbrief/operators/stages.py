"""Per-document stages of the summarisation run.

JVM-side wherever the semantics allow.  The two user plug points, the
extractor and the summariser, are arbitrary Python callables and run in
``mapInPandas`` (Arrow batches, one summariser instance per partition), with
every call wrapped so one bad document becomes a failure row instead of
failing the job.
"""
from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.strategies import broadcast_if_small, materialize, spread
from ..schemas import DEFAULT_LENGTH
from .sketch import might_contain

ERROR_COLS = ("stage", "error_class", "message")
# The reference's chunk budget is 80 % of the model's max input tokens,
# and 32,000 tokens when the limit is unknown or not positive.
BUDGET_SHARE = (8, 10)
DEFAULT_BUDGET_TOKENS = 32000


@dataclass
class Digest:
    """What a summariser returns (the reference's digest record)."""
    summary: str
    tokens_in: int | None = None
    tokens_out: int | None = None
    latency_ms: int | None = None
    model: str | None = None


def _with_error_cols(df: DataFrame) -> DataFrame:
    for c in ERROR_COLS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


# ------------------------------------------------------------------ O23 extract

def extract_utf8(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Built-in extractor, JVM-side: UTF-8 text; pages are form-feed separated.

    Content that is not valid UTF-8, or that is a PDF, is an extraction failure.
    """
    raw = F.col(content_col).cast("string")
    # a PDF needs an extractor; its bytes are not text even where they are valid UTF-8
    pdf = F.substring(F.col(content_col), 1, 5) == F.lit(b"%PDF-")
    ok = F.is_valid_utf8(raw) & ~pdf
    out = (_with_error_cols(files)
           .withColumn("text", F.when(ok, raw))
           # pages = form feeds + 1, counted without splitting the text into an array
           .withColumn("page_count", F.when(ok, F.regexp_count(raw, F.lit("\f")) + 1).cast("bigint")))
    failed = F.col("stage").isNull() & ~ok
    return (out.withColumn("error_class", F.when(failed, F.lit("ExtractionError")).otherwise(F.col("error_class")))
            .withColumn("message", F.when(failed & pdf, F.lit("PDF content needs an extractor"))
                        .when(failed, F.lit("content is not valid UTF-8")).otherwise(F.col("message")))
            .withColumn("stage", F.when(failed, F.lit("extract")).otherwise(F.col("stage")))
            .drop(content_col))


def extract(files: DataFrame, extractor: Callable[[bytes, str], tuple[str, int | None]] | None = None,
            content_col: str = "content", path_col: str = "pdf_path", key: str | None = None) -> DataFrame:
    """File bytes → ``text``, ``page_count``; failures tagged ``stage='extract'``.

    ``extractor(content, path) -> (text, page_count)`` is user code, called once
    per file on the executors.  Without one, the JVM UTF-8 extractor runs.
    """
    if extractor is None:
        return extract_utf8(files, content_col)
    files = _with_error_cols(files)
    if key:
        files = spread(files, key)
    out_schema = T.StructType(
        [f for f in files.schema.fields if f.name != content_col and f.name not in ERROR_COLS]
        + [T.StructField("text", T.StringType()), T.StructField("page_count", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ERROR_COLS])
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator):
        for pdf in batches:
            texts, pages, stages, classes, msgs = [], [], [], [], []
            paths = pdf[path_col] if path_col in pdf else [None] * len(pdf)
            for content, path, prev in zip(pdf[content_col], paths, pdf["stage"]):
                t = p = st = ec = msg = None
                if prev is None:
                    try:
                        t, p = extractor(bytes(content), path)
                    except Exception as e:  # noqa: BLE001 - any failure of user code
                        st, ec, msg = "extract", type(e).__name__, str(e)
                texts.append(t)
                pages.append(p)
                stages.append(st)
                classes.append(ec)
                msgs.append(msg)
            out = pdf.drop(columns=[content_col])
            out["text"], out["page_count"] = texts, pages
            keep = out["stage"].notna()
            out["stage"] = out["stage"].where(keep, stages)
            out["error_class"] = out["error_class"].where(keep, classes)
            out["message"] = out["message"].where(keep, msgs)
            out["page_count"] = out["page_count"].astype("Int64")
            yield out[names]

    return files.mapInPandas(run, out_schema)


# ------------------------------------------------------------------ O24 summarise

def summarize(docs: DataFrame, factory: Callable[[], Callable[..., Digest]],
              text_col: str = "text", length_col: str | None = "length",
              default_length: str = DEFAULT_LENGTH, key: str | list | None = None) -> DataFrame:
    """One summariser call per row → digest columns; failures ``stage='summarize'``.

    ``factory()`` builds the summariser once per partition (clients need not
    pickle); the summariser is called as ``summarizer(text, length)``.  Rows
    that already failed pass through without a call.
    """
    docs = _with_error_cols(docs)
    if key:
        docs = spread(docs, key)
    digest_fields = [T.StructField("summary", T.StringType()), T.StructField("tokens_in", T.LongType()),
                     T.StructField("tokens_out", T.LongType()), T.StructField("latency_ms", T.LongType()),
                     T.StructField("model", T.StringType())]
    digest_names = {f.name for f in digest_fields}
    base = [f for f in docs.schema.fields if f.name not in ERROR_COLS and f.name not in digest_names]
    out_schema = T.StructType(base + digest_fields + [T.StructField(c, T.StringType()) for c in ERROR_COLS])
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator):
        summarizer = factory()
        for pdf in batches:
            cols = {k: [] for k in ("summary", "tokens_in", "tokens_out", "latency_ms", "model",
                                    "stage", "error_class", "message")}
            lengths = pdf[length_col] if length_col and length_col in pdf else [None] * len(pdf)
            for text, ln, st0, ec0, m0 in zip(pdf[text_col], lengths, pdf["stage"], pdf["error_class"],
                                             pdf["message"]):
                d, err = None, (st0, ec0, m0)
                if st0 is None:
                    try:
                        t0 = time.monotonic()
                        d = summarizer(text, ln or default_length)
                        if d.latency_ms is None:
                            d.latency_ms = int((time.monotonic() - t0) * 1000)
                    except Exception as e:  # noqa: BLE001 - any failure of user code
                        d, err = None, ("summarize", type(e).__name__, str(e))
                for k in ("summary", "tokens_in", "tokens_out", "latency_ms", "model"):
                    cols[k].append(getattr(d, k) if d is not None else None)
                for k, v in zip(("stage", "error_class", "message"), err):
                    cols[k].append(v)
            out = pdf.drop(columns=[c for c in pdf.columns if c in digest_names or c in ERROR_COLS])
            for k, v in cols.items():
                out[k] = v
            for k in ("tokens_in", "tokens_out", "latency_ms"):
                out[k] = out[k].astype("Int64")
            yield out[names]

    return docs.mapInPandas(run, out_schema)


# ------------------------------------------------------------------ O27 prefix summariser (test double)

# The reference's test summariser keeps the first 30 characters and reports
# usage of 100 tokens in, 50 tokens out, 1 ms.
PREFIX_CHARS = 30
PREFIX_USAGE = (100, 50, 1)


class PrefixSummarizer:
    """Test double: label with the requested length, first 30 characters, '...'; fixed usage."""

    def __init__(self, model: str = "prefix-model"):
        self.model = model

    def __call__(self, text: str, length: str | None = None) -> Digest:
        used = length or DEFAULT_LENGTH
        tin, tout, lat = PREFIX_USAGE
        return Digest(f"[digest length={used}] {text[:PREFIX_CHARS]}...", tin, tout, lat, self.model)


def prefix_summary(text: str | Column, length: str | Column, model: str | Column) -> Column:
    """The same test double as a Column expression (JVM-side)."""
    ln = S.resolve_length(length)
    m = model if isinstance(model, Column) else F.lit(model)
    return F.struct(
        F.concat(F.lit("[digest length="), ln, F.lit("] "), F.substring(S.col_(text), 1, PREFIX_CHARS),
                 F.lit("...")).alias("summary"),
        F.lit(PREFIX_USAGE[0]).cast("bigint").alias("tokens_in"),
        F.lit(PREFIX_USAGE[1]).cast("bigint").alias("tokens_out"),
        F.lit(PREFIX_USAGE[2]).cast("bigint").alias("latency_ms"),
        m.alias("model"))


class HashSummarizer:
    """Test double that reads the whole text: its length and SHA-256, tokens in = characters."""

    def __init__(self, model: str = "hash-model"):
        self.model = model

    def __call__(self, text: str, length: str | None = None) -> Digest:
        digest = hashlib.sha256(text.encode()).hexdigest()
        return Digest(f"[digest length={length or DEFAULT_LENGTH}] {len(text)} characters, sha256 {digest}",
                      len(text), 50, 1, self.model)


def pdf_extractor() -> Callable[[bytes, str], tuple[str, int]]:
    """A PDF extractor when a PDF library is importable on the executors (pypdf or pypdfium2).

    PDF parsing is a per-file library call behind the extractor hook; none is
    bundled.  Page count is 0 when it cannot be read, as in the reference.
    """
    try:
        import pypdf  # noqa: F401

        def run(content: bytes, path: str | None = None):
            import io

            import pypdf as _p
            reader = _p.PdfReader(io.BytesIO(content))
            return "\n".join(pg.extract_text() or "" for pg in reader.pages), len(reader.pages)
        return run
    except ImportError:
        pass
    try:
        import pypdfium2  # noqa: F401

        def run2(content: bytes, path: str | None = None):
            import pypdfium2 as _pd
            doc = _pd.PdfDocument(content)
            try:
                return "\n".join(doc[i].get_textpage().get_text_range() for i in range(len(doc))), len(doc)
            finally:
                doc.close()
        return run2
    except ImportError:
        raise ImportError("no PDF library (pypdf or pypdfium2) is installed; pass your own extractor") from None


class FailingExtractor:
    """Failure double (FIXTURES B.7 re-keyed on content): rejects files whose byte length is a multiple of 13."""

    def __call__(self, content: bytes, path: str | None = None):
        if len(content) % 13 == 0:
            raise ValueError(f"cannot extract {len(content)} bytes")
        return content.decode("utf-8"), 1


class FailingSummarizer(PrefixSummarizer):
    """Failure double: rejects texts whose length in characters is a multiple of 19."""

    def __call__(self, text: str, length: str | None = None) -> Digest:
        if len(text) % 19 == 0:
            raise RuntimeError(f"model refused a text of {len(text)} characters")
        return super().__call__(text, length)


# ------------------------------------------------------------------ O26 chunk split, O29 budget

def split_chunks(docs: DataFrame, chunk_chars: int | str | Column, text_col: str = "text") -> DataFrame:
    """Consecutive chunks of at most ``chunk_chars`` characters (``chunk_no`` from 0).

    Narrow (no shuffle), lossless and linear: one pass of a pattern cuts the text,
    and the chunks concatenate to it.  An empty text has no chunks.
    """
    c = chunk_chars if isinstance(chunk_chars, Column) else (
        F.col(chunk_chars) if isinstance(chunk_chars, str) else F.lit(int(chunk_chars)))
    t = F.col(text_col)
    arr = F.regexp_extract_all(t, F.concat(F.lit("(?s).{1,"), c.cast("string"), F.lit("}")), F.lit(0))
    return (docs.select("*", F.posexplode(arr).alias("chunk_no", "chunk"))
            .withColumn("chunk_no", F.col("chunk_no").cast("bigint")))


def chunk_budget(docs: DataFrame, models: DataFrame, fallback: int = DEFAULT_BUDGET_TOKENS,
                 on: list[str] | None = None) -> DataFrame:
    """``budget_tokens`` = 80 % of the model's max input, else 32,000.

    ``models`` is a dimension (one row per model): it is broadcast after a
    check of its bytes, otherwise the join shuffles.
    """
    on = on or [c for c in ("provider", "model") if c in docs.columns and c in models.columns]
    m = broadcast_if_small(models.select(*on, "max_input_tokens"))
    return (docs.join(m, on, "left")
            .withColumn("budget_tokens", S.budget_from_limit(F.col("max_input_tokens"), fallback, BUDGET_SHARE))
            .drop("max_input_tokens"))


# ------------------------------------------------------------------ O30, O31 templates and prompts

# Our own default prompts; the character ranges are fixed values.
DEFAULT_TEMPLATES = {
    "short": "What would a busy reader have to know? Answer in 300 to 500 characters.\n\nDocument:\n{text}",
    "standard": ("Write an abstract of 1,000 to 2,000 characters for a colleague who will not open the document: "
                 "what it is for, what it finds, and the figures that matter.\n\nDocument:\n{text}"),
    "detailed": ("Prepare a briefing of 3,000 to 5,000 characters that could stand in for the document. Follow its "
                 "order and name people, dates and amounts as they appear.\n\nDocument:\n{text}"),
}
PLACEHOLDER = "{text}"
EXTRA_LABEL = "Additional instructions: "


def resolve_templates(overrides: DataFrame | None) -> DataFrame:
    """Per length, the override when non-empty, else the built-in template."""
    from pyspark.sql import SparkSession

    spark = overrides.sparkSession if overrides is not None else SparkSession.getActiveSession()
    defaults = spark.createDataFrame(list(DEFAULT_TEMPLATES.items()), "length string, default_template string")
    if overrides is None:
        return defaults.withColumnRenamed("default_template", "template")
    # one override per length: a small side, broadcast after a check of its bytes
    return (defaults.join(broadcast_if_small(overrides.select("length", "override")), "length", "left")
            .select("length", F.coalesce(F.nullif(F.col("override"), F.lit("")),
                                         F.col("default_template")).alias("template")))


def render_prompts(docs: DataFrame, templates: DataFrame, extra: str = "", text_col: str = "text",
                   length_col: str = "length") -> DataFrame:
    """prompt = template (+ blank line + labelled extra instructions), text at ``{text}``.

    The extra text follows the whole template, so with a template that ends in
    ``{text}`` it follows the document, as in the reference.  A template
    without a placeholder gets a blank line and the text appended.
    """
    t = F.col("template")
    if extra:
        t = F.concat(t, F.lit("\n\n" + EXTRA_LABEL + extra))
    tmpl = broadcast_if_small(templates.select(F.col("length").alias("_len"), "template"))
    joined = docs.join(tmpl, docs[length_col] == tmpl["_len"], "left").drop("_len")
    prompt = F.when(F.instr(t, PLACEHOLDER) > 0, F.replace(t, F.lit(PLACEHOLDER), F.col(text_col))) \
        .otherwise(F.concat(t, F.lit("\n\n"), F.col(text_col)))
    return joined.withColumn("prompt", prompt).drop("template")


# ------------------------------------------------------------------ O33, O34 item limit and dedup

def limit_items(files: DataFrame, n: int = 1, order: list[str] | None = None) -> DataFrame:
    """At most ``n`` items per run, the first by path (deterministic)."""
    order = order or ["path"]
    # the names are chosen on their own: no file content is sorted or sent to one task
    first = files.select(*order).orderBy(*order).limit(n)
    same = [files[c].eqNullSafe(first[c]) for c in order]
    return files.join(broadcast_if_small(first), same, "left_semi")  # n rows of names, n is the caller's


def skip_seen(files: DataFrame, catalog: DataFrame, order: list[str] | None = None,
              key_col: str = "pdf_hash", sketch: DataFrame | None = None) -> DataFrame:
    """Keep one file per ``key_col`` (first by ``order``) whose key is not in the catalog.

    The seen set is the live catalog, so a deleted summary is produced again on
    the next run.  Keys and names alone are compared with the seen keys and reduced
    (``min`` of a struct of names, partially on the map side: many copies of one file cost
    one row per map task); the files kept are then picked by name.  NULL keys are
    never seen and are one group.

    With a ``sketch`` of the catalog's keys (:mod:`.sketch`), names whose key it does not hold are new and are not
    compared with the catalog; the others are, exactly.
    """
    order = order or ["pdf_path"]
    names = files.select(key_col, *order)
    seen = catalog.select(key_col).where(F.col(key_col).isNotNull()).distinct()
    if sketch is None:
        new = names.join(seen, key_col, "left_anti")
    else:
        # written once: its two parts would each read and hash every file
        asked = materialize(might_contain(names, key_col, sketch, "_maybe"), "asked-names")
        new = asked.where("not _maybe").drop("_maybe").unionByName(
            asked.where("_maybe").drop("_maybe").join(seen, key_col, "left_anti"))
    first = (new.groupBy(key_col)
             .agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])).alias("_f"))
             .select("_f.*"))
    same = [files[c].eqNullSafe(first[f"_o{i}"]) for i, c in enumerate(order)]
    return files.join(broadcast_if_small(first), same, "left_semi")


# ------------------------------------------------------------------ O35, O36 failures

def split_failures(df: DataFrame, path_col: str = "pdf_path") -> tuple[DataFrame, DataFrame]:
    """(rows without error, failure rows ``pdf_path, stage, error_class, message``)."""
    df = _with_error_cols(df)
    ok = df.where(F.col("stage").isNull()).drop(*ERROR_COLS)
    bad = df.where(F.col("stage").isNotNull())
    return ok, bad


# Order of the reference's error classification and its exit codes.
CATEGORY_RULES = [
    (("ConfigError", "ConfigurationError"), "config", 2),
    (("SummarizationError",), "summarize", 1),
    (("ExtractionError",), "extract", 1),
    (("SinkError",), "sink", 1),
]
# what a user can do about a failure, in our own words
ADVICE = {"config": "Check the settings of the run.", "extract": "The file could not be turned into text.",
          "summarize": "The summariser did not return a summary.", "sink": "The summary could not be stored.",
          "source": "The file could not be read.", "other": "The run failed for another reason."}


def classify_failures(failures: DataFrame) -> DataFrame:
    """``category``, ``severity`` (exit code 2 for configuration errors, else 1) and ``advice`` with the message.

    A failure inside the pipeline belongs to the stage it failed in, whatever
    class user code raised; elsewhere the class decides.
    """
    ec, st = F.col("error_class"), F.col("stage")
    piped = st.isin("extract", "summarize")
    cat, sev = F.when(piped, st), F.when(piped, F.lit(1))
    for classes, name, code in CATEGORY_RULES:
        cond = ec.isin(*classes)
        cat, sev = cat.when(cond, F.lit(name)), sev.when(cond, F.lit(code))
    cat = cat.when(st == "source", "source").otherwise("other")
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    out = failures.withColumn("category", cat).withColumn("severity", sev.otherwise(1).cast("bigint"))
    said = F.col("message") if "message" in failures.columns else F.lit(None).cast("string")
    return out.withColumn("advice", F.concat_ws(" ", advice[F.col("category")], F.concat(F.lit("("), said, F.lit(")"))))


def run_report(classified: DataFrame) -> DataFrame:
    """Failure counts per stage and category."""
    return (classified.groupBy("stage", "category")
            .agg(F.count(F.lit(1)).alias("n_failures"), F.max("severity").alias("max_severity")))

