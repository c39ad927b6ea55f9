"""Extractive summariser in Spark SQL (the offline stand-in for the hosted model call).

Method after Luhn (1958) and SumBasic (Nenkova & Vanderwende, 2005): score each
sentence by the mean in-document frequency of its words, then keep the
highest-scoring sentences that fit the length's character budget and emit
them in document order.

A document's words are counted where its text is:

* **In its row** (:func:`_in_row`), texts of up to ``spread_bytes``: projections over the scan, without any
  exchange.  Sentences are cut by SQL, the words of the rows of an Arrow batch are cut, counted and summed by sentence
  as numbers in arrays (:func:`_scores`), and the sentences of the best scores are joined by SQL.
* **Spread** (:func:`_spread`), longer texts, whose words are too many for a row's arrays: word rows (id, word,
  position) are hash-partitioned by (id, word) and counted by a window, so the words of one document lie in all
  tasks; sums per (id, sentence) are partially aggregated; the running-sum cut is preceded by a top-K by rank
  (a partial limit before the shuffle; K is the most sentences a budget can hold, so nothing is lost); the chosen positions
  meet their document by id.  Neither text nor carried columns are copied to sentences or words.

Both give the same rows.  The sizes are those of the texts, or of a column that names them (a file's length is
known before its content is read).
"""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategies import widened

# Character budgets are the upper ends of the ranges the
# reference's prompts ask for (300-500 / 1000-2000 / 3000-5000 characters).
BUDGETS = {"short": 500, "standard": 2000, "detailed": 5000}
# Short output is a bullet list: "- " before each sentence plus the newline.
BULLET = "- "
# A sentence ends at . ! ? before white space, or at the full-width marks by themselves.
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
FULL_WIDTH_END = r"([。！？]+)[ \t\n\r\f]*"
WORD_SPLIT = r"[^\p{L}\p{N}]+"
# Scripts written without blanks: every character counts as a word.
SINGLE_CHAR_WORDS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])"
# Texts without these characters have none of the scripts above; looking for a range is cheaper.
WIDE_CHARS = r"[\x{2E80}-\x{10FFFF}]"
# The bytes of words in lower-case ASCII text, and in other text with blanks between its words.
WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(0x80, 0x100))
# Rows of an Arrow batch that are counted together.
ROWS_COUNTED = 128
# Order of pieces within a sentence: pos = sentence * PIECE_STEP + piece (a sentence has fewer pieces than that).
PIECE_STEP = 1 << 24
# Texts above this many bytes are spread: a row's arrays take some 60 bytes a byte of text.
SPREAD_BYTES = 1 << 20


def _params(length: str | None, length_col: str | None) -> tuple[Column, Column, Column, Column]:
    """(length, budget, overhead, bullet) as columns: literals for a fixed length, else per row."""
    if length_col is None:
        if length not in BUDGETS:
            raise ValueError(f"unknown length {length!r}")
        short = length == "short"
        return (F.lit(length), F.lit(BUDGETS[length]), F.lit(len(BULLET) + 1 if short else 1),
                F.lit(BULLET if short else ""))
    ln = F.col(length_col)
    budget = F.when(ln == "short", BUDGETS["short"]).when(ln == "standard", BUDGETS["standard"]) \
        .when(ln == "detailed", BUDGETS["detailed"])
    short = ln == "short"
    return (ln, budget, F.when(short, len(BULLET) + 1).otherwise(1),
            F.when(short, BULLET).otherwise(""))


def _marked(text: str) -> Column:
    """The sentences (some empty) of a text, as an array."""
    wide = F.contains(F.col(text), F.lit("。")) | F.contains(F.col(text), F.lit("！")) | F.contains(F.col(text), F.lit("？"))
    ends = F.regexp_replace(F.col(text), SENTENCE_END, "$1\n")
    return F.split(F.when(wide, F.regexp_replace(ends, FULL_WIDTH_END, "$1\n")).otherwise(ends), "\n")


def _word_rows(docs: DataFrame, length: str | None, length_col: str | None, id_col: str, text_col: str) -> DataFrame:
    """(id, length, pos, word, n): one row per word, and one for a sentence without words (word NULL).

    A sentence longer than the budget is cut into pieces (:func:`_pieces`), which compete like sentences, so
    no part of a text is left out.  ``n`` is the length of the sentence, on its first row only.  Gaps in ``pos``
    do not change the order.
    """
    ln, budget, ov, _ = _params(length, length_col)
    whole = (docs.select(F.col(id_col).alias("_id"), ln.alias("_length"), budget.alias("_budget"), ov.alias("_ov"),
                         F.col(text_col).alias("_text"))
             .select("_id", "_length", "_budget", "_ov", F.posexplode(_marked("_text")).alias("spos", "raw"))
             .where(F.col("raw") != ""))
    sents = whole.select("_id", "_length", "spos", F.posexplode(_pieces(F.col("raw"))).alias("piece", "sent"))
    spaced = F.regexp_replace(F.lower(F.col("sent")), SINGLE_CHAR_WORDS, " $1 ")
    pos = F.col("spos").cast("bigint") * F.lit(PIECE_STEP) + F.col("piece")
    return (sents.select("_id", "_length", pos.alias("pos"), F.length("sent").alias("n"),
                         F.posexplode(F.split(spaced, WORD_SPLIT)).alias("wpos", "word"))
            .where((F.col("word") != "") | (F.col("wpos") == 0))
            .select("_id", "_length", "pos", F.nullif(F.col("word"), F.lit("")).alias("word"),
                    F.when(F.col("wpos") == 0, F.col("n")).alias("n")))


def _pieces(raw: Column) -> Column:
    """The sentence, or its pieces of at most budget - overhead + 1 characters if it is longer.

    A piece ends after the last blank that fits, or without one where the budget ends.
    """
    cap = F.col("_budget") - F.col("_ov") + 1
    n, n1 = cap.cast("string"), (cap - 1).cast("string")
    pattern = F.concat(F.lit("(?s).{1,"), n, F.lit(r"}\z|.{0,"), n1, F.lit("} |.{1,"), n, F.lit("}"))
    return (F.when(F.length(raw) > cap, F.regexp_extract_all(raw, pattern, F.lit(0)))
            .otherwise(F.array(raw)))


def sentence_scores(docs: DataFrame, length: str | None = "short", id_col: str = "doc_id",
                    text_col: str = "text", partitions: int | None = None,
                    length_col: str | None = None) -> DataFrame:
    """(_id, _length, pos, n: characters, score) per sentence.

    A sentence too long for the budget comes as pieces that each fit it.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _word_rows(docs, length, length_col, id_col, text_col).repartition(parts, "_id", "word")
    tf = words.withColumn("tf", F.count("word").over(Window.partitionBy("_id", "word")))
    return (tf.groupBy("_id", "_length", "pos")
            .agg(F.sum("tf").alias("_sum"), F.count("word").alias("_nw"), F.max("n").alias("n"))
            .select("_id", "_length", "pos", "n",
                    F.when(F.col("_nw") > 0, F.expr("_sum div _nw")).otherwise(F.lit(0)).cast("bigint").alias("score")))


def _chosen(s: DataFrame, k: int) -> DataFrame:
    """(_of, _pos): per document, the positions of the longest prefix of its ranking that fits the budget."""
    _, budget, ov, _ = _params(None, "_length")
    top = (s.withColumn("_rn", F.row_number().over(Window.partitionBy("_id").orderBy(F.col("score").desc(), "pos")))
           .where(F.col("_rn") <= k))
    run = Window.partitionBy("_id").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (top.withColumn("_in", F.sum(F.col("n") + ov).over(run) <= budget + 1).where("_in")
            .groupBy(F.col("_id").alias("_of")).agg(F.array_sort(F.collect_list("pos")).alias("_pos")))


def _max_kept(length: str | None, length_col: str | None) -> int:
    lengths = [length] if length_col is None else list(BUDGETS)
    return max((BUDGETS[ln] + 1) // (_overhead(ln) + 1) for ln in lengths) + 1


def _overhead(length: str) -> int:
    return len(BULLET) + 1 if length == "short" else 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once a row (an alias could be put back into a lambda and computed for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(sentence: Column) -> Column:
    """The sentence in lower case with a blank behind it; of one that is not ASCII alone, the words with blanks between."""
    plain = F.bit_length(sentence) == F.length(sentence) * 8  # what is no word character is found by its byte
    spaced = F.when(sentence.rlike(WIDE_CHARS), F.regexp_replace(F.lower(sentence), SINGLE_CHAR_WORDS, " $1 ")).otherwise(F.lower(sentence))
    return F.concat(F.when(plain, F.lower(sentence)).otherwise(F.regexp_replace(spaced, WORD_SPLIT, " ")), F.lit(" "))


def _scores(sentences: Column) -> Column:
    """The scores of the sentences of a row, given as :func:`_words`; 0 for a sentence without words.

    Words are cut as runs of bytes of the Arrow buffer and counted as numbers in arrays, so many rows at a time that
    the tables of their words stay in a core's cache.
    """
    def scored(sentences: pa.Array) -> pa.Array:
        import pyarrow as pa

        return pa.concat_arrays([counted(sentences[i:i + ROWS_COUNTED]) for i in range(0, max(len(sentences), 1), ROWS_COUNTED)])

    def counted(sentences: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts, n_sentences = sentences.flatten().cast(pa.large_string()), pc.list_value_length(sentences).to_numpy()
        if not len(texts):
            return pa.array([[]] * len(sentences), pa.list_(pa.int64()))
        ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset:][:len(texts) + 1]
        is_word = np.zeros(256, bool)
        is_word[list(WORD_BYTES)] = True
        # places where words begin and end, by turns: the blank behind each sentence ends its last word
        edges = np.flatnonzero(np.diff(is_word[np.frombuffer(texts.buffers()[2], "uint8")[ends[0]:ends[-1]]], prepend=False)) + ends[0]
        runs = pa.Array.from_buffers(pa.large_binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges), texts.buffers()[2]])
        coded = runs.take(pa.array(np.arange(0, len(runs), 2))).dictionary_encode()
        last = np.searchsorted(edges[::2], ends[1:])
        n_words = np.diff(last, prepend=0)
        # a row's word as a number: the same word of another row is another one
        row = np.repeat(np.repeat(np.arange(len(sentences)), n_sentences), n_words)
        mine = pa.array(row * len(coded.dictionary) + coded.indices.to_numpy()).dictionary_encode().indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(np.bincount(mine)[mine])]).astype("int64")
        score = (total[last] - total[last - n_words]) // np.maximum(n_words, 1)
        starts = np.concatenate([[0], np.cumsum(n_sentences)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(score))

    return F.arrow_udf(scored, "array<bigint>")(sentences)


def _best(max_kept: int) -> Column:
    """(summary, number of sentences) of the sentences of a row (_sents) by their scores (_scores)."""
    def chosen(ranked: Column) -> Column:
        start = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("k"))
        add = lambda a, x: _let(a["cost"] + x["n"] + F.col("_ov"), lambda c: F.struct(
            c.alias("cost"), (a["k"] + F.coalesce(c <= F.col("_budget") + 1, F.lit(False)).cast("int")).alias("k")))
        return F.sort_array(F.transform(F.slice(ranked, 1, F.aggregate(ranked, start, add, lambda a: a["k"])), lambda x: x["i"]))

    # sentences without a word rank last, by their place
    ranked = F.slice(F.sort_array(F.transform("_scores", lambda s, i: F.struct(
        (-s).alias("s"), i.alias("i"), F.length(F.get(F.col("_sents"), i)).alias("n")))), 1, max_kept)
    return _let(_let(ranked, chosen), lambda at: F.struct(
        F.array_join(F.transform(at, lambda i: F.concat(F.col("_bullet"), F.get(F.col("_sents"), i))), "\n").alias("summary"),
        F.size(at).alias("n")))


def _in_row(rows: DataFrame, max_kept: int) -> DataFrame:
    """``rows`` (_text, _budget, _ov, _bullet) with ``_got`` (summary, n): projections, the counts as Arrow arrays between them."""
    cut = lambda all_: F.flatten(F.transform(F.filter(all_, lambda raw: raw != ""), _pieces))
    text = rows.withColumn("_text", F.coalesce("_text", F.lit("")))
    sents = text.withColumn("_sents", _let(_marked("_text"), cut)).drop("_text")
    return sents.withColumn("_scores", _scores(F.transform("_sents", _words))).withColumn("_got", _best(max_kept))


def _spread(base: DataFrame, length: str | None, length_col: str | None, max_kept: int, parts: int) -> DataFrame:
    """``base`` (_id, _text, _budget, _ov, _bullet, ...) with ``_got``, the words of a document spread over tasks."""
    # a struct is never NULL, so a NULL id joins like any other; both uses of this exchange share one scan
    base = base.withColumn("_k", F.struct(F.col("_id").alias("id"))).repartition(parts, "_k")
    chosen = _chosen(sentence_scores(base.withColumn("_doc", F.col("_k.id")), length, "_doc", "_text", parts, length_col), max_kept)
    # the sentences are bound once as an element of an array of one, or each chosen position would cut the text again
    sent = lambda all_, p: F.get(_pieces(F.get(all_, F.shiftright(p, 24).cast("int"))),
                                 p.bitwiseAND(F.lit(PIECE_STEP - 1)).cast("int"))
    lines = F.transform(F.array(_marked("_text")),
                        lambda all_: F.transform("_pos", lambda p: F.concat(F.col("_bullet"), sent(all_, p))))
    return (base.join(chosen, F.col("_k") == F.struct(F.col("_of").alias("id")), "left")
            .withColumn("_got", F.struct(
                F.when(F.col("_pos").isNull(), "").otherwise(F.array_join(F.get(lines, F.lit(0)), "\n")).alias("summary"),
                F.coalesce(F.size("_pos"), F.lit(0)).alias("n"))).drop("_k", "_pos", "_of"))


def extractive_summary(docs: DataFrame, length: str | None = "short", id_col: str = "doc_id",
                       text_col: str = "text", partitions: int | None = None,
                       length_col: str | None = None, carry: list[str] | None = None,
                       spread_bytes: int | None = SPREAD_BYTES, size_col: str | None = None) -> DataFrame:
    """One row per document: (id, length, summary, n_sentences, summary_chars, *carry).

    ``length`` applies to every document, or ``length_col`` names a per-row
    length (short / standard / detailed).  Sentences are ranked by (score
    desc, position); the kept set is the longest prefix of that ranking whose
    cost (characters plus bullet and newline) stays within budget + 1, so the
    text is at most ``budget`` characters; the top sentence (or piece of one) always fits.
    Documents without sentences get an empty summary.  ``carry`` names
    document columns to return alongside.  Ids are unique.

    Texts above ``spread_bytes`` have their words spread over tasks (same rows, other plan); their size is
    ``size_col`` (a known number of bytes, so that the filter needs no text) or that of the text.  With None no
    text is spread.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(F.col(size_col).cast("bigint") if size_col else F.octet_length(text_col), F.lit(0)).alias("_size"),
                       *([F.col(length_col).alias("_ln")] if length_col else []),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])])
    rows = widened(rows, "_id")
    ln, budget, ov, bullet = _params(length, length_col and "_ln")
    settled = [ln.alias("_length"), budget.alias("_budget"), ov.alias("_ov"), bullet.alias("_bullet")]
    kept = _max_kept(length, length_col)
    names = ["_id", "_length", "_got", *[f"_c{i}" for i in range(len(carry or []))]]
    small = rows if spread_bytes is None else rows.where(F.col("_size") <= spread_bytes)
    out = _in_row(small.select("*", *settled), kept).select(*names)
    if spread_bytes is not None:
        large = rows.where(F.col("_size") > spread_bytes).select("*", *settled)
        out = out.unionByName(_spread(large, length, length_col and "_ln", kept, parts).select(*names))
    return out.select(
        F.col("_id").alias(id_col), F.col("_length").alias("length"), F.col("_got.summary").alias("summary"),
        F.col("_got.n").cast("bigint").alias("n_sentences"), F.length("_got.summary").cast("bigint").alias("summary_chars"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry or [])])
