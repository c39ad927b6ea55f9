"""Operator 11, quality rules that clean lines first and judge the document by what is left.

Everything is one projection of Spark functions over the scan: no shuffle, no Python, and a document is
judged wholly in its row.  Per line that has a word, three rules, the first that fits is named:

* ``navigation``: three or more separators (``|`` and the like), at most five words for each;
* ``punctuation``: more than one in ten of its characters is a symbol, or it has three or more ``!`` and ``?``,
  more than one for two words;
* ``boilerplate``: at most ``BOILER_WORDS`` words, with a phrase of page furniture.

Such lines are removed; a document that loses more than ``max_lost`` percent of its words is rejected, as is one
that fails the base rules (too few words, too many words in 5-word windows that repeat).  Windows are compared by a
64-bit hash within their document; they are sorted, not paired, so that a document of repeats costs n log n.

Rows: a NULL or empty text has no words and fails the base (its cleaned text stays NULL or empty); texts of any
length are read whole; every row is judged alone, so repeated rows and ids get equal results; an empty table gives
an empty table; all columns of the table are carried, whatever their names, and only the text is read.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
BASE_SYMBOLS = "#*$%&|<>"
WINDOW = 5
# rules of a line
SYMBOLS = "#*$%&|<>~^=+{}[]@_"
SEPARATORS = "|»›•·"
BOILER_WORDS = 20
BOILER = (r"(?i)(?:^|[^A-Za-z])(?:all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|terms of (?:use|service)|privacy (?:policy|notice)|"
          r"(?:accept|use of|uses) cookies|cookie (?:policy|settings)|sign (?:in|up)|log ?in to|subscribe to|newsletter|"
          r"enable javascript|click here|read more|share (?:this|on)|skip to (?:main )?content|back to top|"
          r"follow us|add to cart|lorem ipsum)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row (a plain alias may be put back into a lambda by the optimizer)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit("[" + re.escape(characters) + "]"))


def line_rule(line: Column, words: Column, chars: Column) -> Column:
    """The name of the rule that a line of so many words and characters in words fails, else NULL."""
    def rule(m: Column) -> Column:
        return (F.when((m["seps"] >= 3) & (words <= 5 * m["seps"]), "navigation")
                .when((10 * m["symbols"] > chars) | ((m["marks"] >= 3) & (2 * m["marks"] > words)), "punctuation")
                .when((words <= BOILER_WORDS) & line.rlike(BOILER), "boilerplate"))

    return F.when(words > 0, let(F.struct(count_of(line, SEPARATORS).alias("seps"), count_of(line, SYMBOLS).alias("symbols"),
                                          count_of(line, "!?").alias("marks")), rule))


def repeated_words(words: Column) -> Column:
    """Number of words inside windows that the array holds twice or more."""
    def covered(at: Column) -> Column:  # first words of the repeated windows, ascending
        steps = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def firsts(order: Column) -> Column:  # (hash, first word) sorted: equal windows are neighbours
        twice = F.filter(order, lambda x, k: (F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0)
                .otherwise(let(let(order, firsts), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                          lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows, count))


def measure(text: Column) -> Column:
    """A struct of the document's counts, its lines with their rules, and the words of the removed ones."""
    def of_lines(lines: Column) -> Column:
        spoken = F.filter(lines, lambda x: x["words"] > 0)
        lost = F.filter(lines, lambda x: x["rule"].isNotNull())
        total = lambda rows, name: F.aggregate(rows, F.lit(0), lambda a, x: a + x[name])
        return F.struct(
            F.size(spoken).alias("lines"), total(spoken, "words").alias("words"), total(spoken, "chars").alias("chars"),
            (F.size(spoken) - F.size(F.array_distinct(F.transform(spoken, lambda x: x["line"])))).alias("dup"),
            total(lost, "words").alias("lost"),
            F.transform(lost, lambda x: F.struct(x["no"].alias("line"), x["rule"].alias("rule"))).alias("removed"),
            F.array_join(F.transform(F.filter(lines, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean"))

    def of_line(line: Column, no: Column, words: Column) -> Column:
        sizes = F.struct(F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"))
        return let(sizes, lambda s: F.struct(line.alias("line"), no.alias("no"), s["n"].alias("words"), s["chars"].alias("chars"),
                                             line_rule(line, s["n"], s["chars"]).alias("rule")))

    def of_cut(cut: Column) -> Column:  # (line, its words): no word crosses a line's end
        return F.struct(let(F.transform(cut, lambda x, i: of_line(x["line"], i, x["words"])), of_lines).alias("lines"),
                        let(F.flatten(F.transform(cut, lambda x: x["words"])), repeated_words).alias("repeat"))

    cut = F.transform(F.split(text, "\n"), lambda x: F.struct(
        x.alias("line"), F.regexp_extract_all(x, F.lit(WORD), F.lit(0)).alias("words")))
    return F.struct(let(cut, of_cut).alias("of"), count_of(text, BASE_SYMBOLS).alias("symbols"))


def clean_lines(docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat: int = 20,
                max_lost: int = 40) -> DataFrame:
    """``docs`` by place (c0, c1, ...) with its counts, ``base_failed``, ``kept``, ``clean`` (the text of the lines
    that stay; NULL for NULL) and ``removed`` (line number from 0, rule).  ``max_repeat`` and ``max_lost`` are percentages."""
    placed = by_place(docs)
    text = F.col(placed.columns[docs.columns.index(text_col)])
    m = placed.withColumn("_m", measure(F.coalesce(text, F.lit(""))))
    n, repeat, lost = F.col("_m.of.lines.words"), F.col("_m.of.repeat"), F.col("_m.of.lines.lost")
    m = m.withColumn("base_failed", (n < min_words) | (100 * repeat.cast("bigint") > max_repeat * n.cast("bigint")))
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    return m.select(*placed.columns, long("_m.of.lines.words", "n_words"), long("_m.of.lines.chars", "word_chars"),
                    long("_m.symbols", "n_symbols"), long("_m.of.lines.dup", "n_dup_lines"),
                    long("_m.of.repeat", "n_repeat_words"), "base_failed",
                    (~F.col("base_failed") & (100 * lost.cast("bigint") <= max_lost * n.cast("bigint"))).alias("kept"),
                    long("_m.of.lines.lines", "n_lines"), long("_m.of.lines.lost", "n_lost_words"),
                    F.when(text.isNotNull(), F.col("_m.of.lines.clean")).alias("clean"), F.col("_m.of.lines.removed").alias("removed"))


def op11_line_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select(
        F.col("c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_lines", "n_lost_words", F.size("removed").cast("bigint").alias("n_removed_lines"),
        F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["line"], x["rule"])), ",").alias("removed_lines"),
        F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))


def _number(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS s
        FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT k, i, least(5, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 5)) AS n
        FROM win JOIN (SELECT k, s FROM win GROUP BY k, s HAVING count(*) > 1) USING (k, s)),
reps AS (SELECT k, sum(n) AS n FROM rep GROUP BY k),
l AS (SELECT k, no, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw,
        {_number('line', SEPARATORS)} AS seps, {_number('line', SYMBOLS)} AS syms, {_number('line', '!?')} AS marks,
        length(translate(line, {_BLANKS}, '')) AS chars
      FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM d)),
r AS (SELECT *, CASE WHEN nw = 0 THEN NULL WHEN seps >= 3 AND nw <= 5 * seps THEN 'navigation'
        WHEN 10 * syms > chars OR (marks >= 3 AND 2 * marks > nw) THEN 'punctuation'
        WHEN nw <= {BOILER_WORDS} AND regexp_matches(line, '{BOILER}') THEN 'boilerplate' END AS rule FROM l),
g AS (SELECT k, count(*) FILTER (nw > 0) AS n_lines, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup,
        coalesce(sum(nw) FILTER (rule IS NOT NULL), 0) AS lost, count(rule) AS removed,
        coalesce(string_agg(no || ':' || rule, ',' ORDER BY no) FILTER (rule IS NOT NULL), '') AS removed_lines,
        coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (rule IS NULL), '') AS clean FROM r GROUP BY k),
b AS (SELECT *, n < 10 OR 100 * n_repeat > 20 * n AS base_failed FROM (
        SELECT d.k, doc_id, text, len(words) AS n, coalesce(reps.n, 0) AS n_repeat FROM d JOIN w USING (k) LEFT JOIN reps USING (k)))
SELECT doc_id, n::BIGINT AS n_words, length(translate(text, {_BLANKS}, ''))::BIGINT AS word_chars,
  {_number('text', BASE_SYMBOLS)}::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND 100 * lost <= 40 * n AS kept, n_lines::BIGINT AS n_lines, lost::BIGINT AS n_lost_words,
  removed::BIGINT AS n_removed_lines, removed_lines, sha256(clean) AS clean_sha256
FROM b JOIN g USING (k)
"""
