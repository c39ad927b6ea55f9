"""Recursive map-and-combine summarisation of documents over the model's input budget.

Every row gets a key of its own at the start (ids may be NULL or repeated).  A document is held as rows
(key, chunk_no, text) of at most ``budget_tokens * chars_per_token`` characters (O26).  Level loop on the driver (the
number of levels depends on the data):

1. Every chunk is summarised (one call each).  A document of one chunk is done.
2. The summaries of the others are joined in order with a blank line.  The joined text is never built: each summary's place in
   it is a sum of lengths (over blocks of chunks first, then within a block), and the next level's chunks are cut
   out of the summaries that lie in them.  A task so gathers one chunk of text, whatever the document's size.
3. Repeat until no rows are left.  A document whose text did not shrink becomes a failure, so every round shortens what
   is left and the loop ends.

Every document ends as a digest or as a failure: one without text, budget or (with
templates) a known length fails at the start; of failing calls the first chunk's error is kept.  With templates, every
chunk call and every combining call gets its own rendered prompt.

Every level's calls are written to the shared scratch folder before they are used: the summariser is a paid Python
call, and without the write a second action or a lost executor would call it again for the whole lineage.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stages import ERROR_COLS, _with_error_cols, render_prompts, split_chunks, summarize
from .strategies import broadcast_if_small, materialize

USAGE = ("tokens_in", "tokens_out", "latency_ms")
JOINER = "\n\n"
# chunks whose lengths one task sums up
BLOCK = 10_000


def first_chunks(docs: DataFrame) -> DataFrame:
    """(key, chunk_no, text, length, room, chars) of documents with ``key``, ``text``, ``length`` and ``room`` characters a call.

    An empty text is one empty chunk.
    """
    rows = docs.select("key", "text", "length", "room", F.length("text").cast("bigint").alias("chars"))
    cut = split_chunks(rows.where("chars > 0"), "room", "text").drop("text").withColumnRenamed("chunk", "text")
    none = rows.where("chars = 0").withColumn("chunk_no", F.lit(0).cast("bigint"))
    return cut.unionByName(none).select("key", "chunk_no", "text", "length", "room", "chars")


def call_level(chunks: DataFrame, factory: Callable, templates: DataFrame | None = None, extra: str = "") -> DataFrame:
    """One call a chunk, written: the digest and error columns beside key, chunk_no, length, room and chars."""
    key = ["key", "chunk_no"]  # the chunks of one long document lie in many tasks
    if templates is None:
        out = summarize(chunks, factory, text_col="text", length_col="length", key=key)
    else:
        out = summarize(render_prompts(chunks, templates, extra), factory, text_col="prompt", length_col="length", key=key).drop("prompt")
    return materialize(out.drop("text"), "chunk-calls")


def _places(digests: DataFrame) -> DataFrame:
    """``digests`` with ``at``: the characters before its summary in the joined text."""
    rows = digests.withColumn("block", F.floor(F.col("chunk_no") / BLOCK)).withColumn("n", F.length("summary") + len(JOINER))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    block = rows.groupBy("key", "block").agg(F.sum("n").alias("size")).select(
        F.col("key").alias("_key"), F.col("block").alias("_block"),
        F.coalesce(F.sum("size").over(before.partitionBy("key").orderBy("block")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("key", "block").orderBy("chunk_no")), F.lit(0))
    return (rows.withColumn("inner", inner).join(block, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")))
            .withColumn("at", F.col("start") + F.col("inner")).drop("_key", "_block", "start", "inner", "block", "n"))


def next_chunks(digests: DataFrame, totals: DataFrame) -> DataFrame:
    """The next level's chunks of the documents of ``totals`` (key, joined: characters of the joined summaries)."""
    rows = (_places(digests.select("key", "chunk_no", "summary", "length", "room"))
            .join(totals.select(F.col("key").alias("_key"), "joined"), F.col("key") == F.col("_key")).drop("_key"))
    text = F.concat("summary", F.lit(JOINER))
    end = F.least(F.col("at") + F.length(text), F.col("joined"))  # nothing follows the last summary
    rows = rows.withColumn("end", end).where("end > at")
    part = rows.withColumn("no", F.explode(F.sequence(F.floor(F.col("at") / F.col("room")), F.floor((F.col("end") - 1) / F.col("room")))))
    low = F.greatest(F.col("no") * F.col("room"), F.col("at"))
    high = F.least((F.col("no") + 1) * F.col("room"), F.col("end"))
    part = part.select("key", F.col("no").cast("bigint").alias("chunk_no"), "length", "room", F.col("joined").alias("chars"), "at",
                       F.substring(text, (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    return (part.groupBy("key", "chunk_no", "length", "room", "chars")  # at most ``room`` characters
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("text"))
            .select("key", "chunk_no", "text", "length", "room", "chars"))


def combine_level(digests: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(final digests, next level's chunks or None, failures: key and error columns) of one level's calls."""
    final = digests.where("chars <= room")
    more = digests.where("chars > room").withColumn("summary", F.coalesce("summary", F.lit("")))
    sums = materialize(more.groupBy("key").agg(
        F.sum(F.length("summary")).alias("_n"), F.count(F.lit(1)).alias("_k"), F.max("chars").alias("chars"),
        F.min_by(F.struct(*ERROR_COLS), F.when(F.col("stage").isNotNull(), F.col("chunk_no"))).alias("_err"),
        F.count("stage").alias("_bad")).withColumn("joined", F.col("_n") + len(JOINER) * (F.col("_k") - 1)), "chunk-sums")
    wrong = sums.where("_bad > 0").select("key", "_err.*")
    grown = sums.where("_bad = 0 and joined >= chars").select(
        "key", F.lit("summarize").alias("stage"), F.lit("SummarizationError").alias("error_class"),
        F.lit("combined summary did not shrink").alias("message"))
    on = sums.where("_bad = 0 and joined < chars").select("key", "joined")
    return final, None if on.isEmpty() else next_chunks(more, on), wrong.unionByName(grown)


def keyed_documents(docs: DataFrame, budget_tokens: int | str, chars_per_token: int, id_col: str, key_cols: list[str],
                    templates: DataFrame | None) -> DataFrame:
    """The documents, written, with ``key``, ``room`` and the error columns of those that cannot be called for."""
    budget = F.col(budget_tokens) if isinstance(budget_tokens, str) else F.lit(int(budget_tokens))
    rows = _with_error_cols(docs.select(id_col, *key_cols, "text", "length", (budget.cast("bigint") * chars_per_token).alias("room")))
    why = F.when(F.col("text").isNull(), "no text").when(F.coalesce(F.col("room") < 1, F.lit(True)), "no budget")
    if templates is not None:
        known = broadcast_if_small(templates.select(F.col("length").alias("_known")))
        rows = rows.join(known, F.col("length") == F.col("_known"), "left")
        why = why.when(F.col("_known").isNull(), F.concat(F.lit("unknown length "), F.coalesce("length", F.lit("NULL"))))
    bad = F.col("_why").isNotNull()
    rows = (rows.withColumn("_why", F.when(F.col("stage").isNull(), why))
            .withColumn("stage", F.when(bad, "summarize").otherwise(F.col("stage")))
            .withColumn("error_class", F.when(bad, "SummarizationError").otherwise(F.col("error_class")))
            .withColumn("message", F.coalesce("_why", "message")).drop("_why", "_known"))
    return materialize(rows.withColumn("key", F.monotonically_increasing_id()), "chunk-documents")


def summarize_chunked(docs: DataFrame, factory: Callable, budget_tokens: int | str = "budget_tokens",
                      chars_per_token: int = 4, id_col: str = "doc_id", key_cols: list[str] | None = None,
                      templates: DataFrame | None = None, extra: str = "") -> DataFrame:
    """Digest per document (``summary``, usage summed over every call, ``levels``) or a failure row.

    ``docs`` has ``id_col`` (NULL and repeated ids are rows of their own), ``text``, ``length`` and either a
    ``budget_tokens`` column (O29) or an integer budget.  ``templates`` (O30) are rendered for each call.
    """
    key_cols = key_cols or []
    rows = keyed_documents(docs, budget_tokens, chars_per_token, id_col, key_cols, templates)
    fine = rows.where(F.col("stage").isNull())
    chunks = None if fine.isEmpty() else first_chunks(fine)
    finals, failed, calls, level = [], [rows.where(F.col("stage").isNotNull()).select("key", F.lit(0).alias("level"), *ERROR_COLS)], [], 0
    while chunks is not None:
        digests = call_level(chunks, factory, templates, extra)
        calls.append(digests.select("key", *USAGE))
        final, chunks, wrong = combine_level(digests)
        finals.append(final.select("key", "summary", "model", *ERROR_COLS, F.lit(level).alias("level")))
        level += 1
        failed.append(wrong.select("key", F.lit(level).alias("level"), *ERROR_COLS))
    heads = rows.select("key", id_col, *key_cols, "length")
    ended = reduce(DataFrame.unionByName, [f.withColumn("_called", F.lit(False)) for f in failed])
    if finals:
        done = reduce(DataFrame.unionByName, finals).withColumn("_called", F.lit(True))
        used = reduce(DataFrame.unionByName, calls).groupBy("key").agg(*[F.sum(c).alias("_" + c) for c in USAGE])
        ended = done.unionByName(ended, allowMissingColumns=True).join(used, "key", "left")
    else:
        ended = ended.select("*", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("model"),
                             *[F.lit(None).cast("bigint").alias("_" + c) for c in USAGE])
    usage = [F.when(F.col("_called"), F.coalesce("_" + c, F.lit(0))).cast("bigint").alias(c) for c in USAGE]
    return (heads.join(ended, "key")
            .select(id_col, *key_cols, "length", "summary", *usage, "model", F.col("level").cast("bigint").alias("levels"), *ERROR_COLS))
