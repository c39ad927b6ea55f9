"""Operator 10, substring dedup by hashing units of text: lines, paragraphs or clauses.

A text is cut into units at line ends and, by default, after marks (``. , ; : ! ?`` before a blank, full-width marks
by themselves); units are normalised (A-Z lower-cased, runs of ASCII white space one blank, trimmed), blank ones belong
to the unit before.  A passage is the shortest run of consecutive units, from each unit on, of ``min_chars`` characters
(a long line is a passage by itself; characters, not words, so that scripts without blanks count alike).  Passages are
digested to 128 bits.  A task drops later copies among its own rows at once, so that of a passage, however frequent, one
row per task batch is shuffled; the first occurrences meet by digest, where all but the earliest (smallest id, then
position) are marked.  The units of marked passages are removed; all offsets are those of the original text, in code
points.

A line of a page is often as long as a paragraph, and a copied passage starts anywhere in it, so whole lines alone
miss it; single short lines recur by chance.  Hence runs of small units with a least length.

Rows: a NULL text has no unit and stays NULL, an empty or blank one has none and stays; a text of fewer than
``min_chars`` characters, and the last units that do not make up a passage of their own, are no passage (the latter
are covered by those before); rows with the same id are ordered by text, equal rows one after the other (the later one
loses its passages); NULL ids come first; texts are cut whole, however long; an empty table gives an empty table.
Only id and text are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategies import materialize
from .common import keyed, later_copies, shuffle_partitions, table

CUTS = {"clause": re.compile("[.!?,;:]+[ \t\r\f\v]+|[。！？，；：、]+|\n"), "line": re.compile("\n"),
        "paragraph": re.compile("\n[ \t\r\f\v]*\n")}
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BATCH = 500_000  # passages a task holds for its own combining


def units(text: str, cut: re.Pattern) -> tuple[list[int], list[str]]:
    """Start of each unit in the text (and the text's end), and the units normalised."""
    starts, out, last = [], [], 0
    for end in [*(m.end() for m in cut.finditer(text)), len(text)]:
        if u := b" ".join(text[last:end].encode().translate(LOWER).split()).decode():
            starts.append(last)
            out.append(u)
        last = end
    return [*starts, len(text)], out


def passages(found: list[str], min_chars: int) -> list[int]:
    """For each unit that starts a passage, the unit after its end."""
    ends, j, size = [], 0, -1
    for u in found:
        while j < len(found) and size < min_chars:
            size += len(found[j]) + 1
            j += 1
        if size < min_chars:
            break
        ends.append(j)
        size -= len(u) + 1
    return ends


def passage_table(docs: DataFrame, cut: re.Pattern, min_chars: int) -> DataFrame:
    """(key, pos, d1, d2, later) of the passages; later: the task has seen an earlier copy (its digest is not needed)."""
    def flush(rows: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        key, pos, d1, d2 = (np.array(c, np.int64) for c in zip(*rows))
        order = np.lexsort((pos, key, d2, d1))
        d = np.stack([d1, d2])[:, order]
        later = np.zeros(len(rows), bool)
        later[order[1:]] = (d[:, 1:] == d[:, :-1]).all(0)
        d1[later], d2[later] = 0, 0
        for i in range(0, len(rows), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(c[j]) for c in (key, pos, d1, d2, later)],
                                             names=["key", "pos", "d1", "d2", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, found = units(t or "", cut)
                for i, j in enumerate(passages(found, min_chars)):
                    h = xxhash.xxh3_128_digest(" ".join(found[i:j]).encode())
                    rows.append((key, i, int.from_bytes(h[:8], signed=True), int.from_bytes(h[8:], signed=True)))
                    if len(rows) >= BATCH:
                        yield from flush(rows)
                        rows = []
        if rows:
            yield from flush(rows)

    return docs.select("_key", "text").mapInArrow(run, "key long, pos long, d1 long, d2 long, later boolean")


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "clause",
                min_chars: int = 100) -> DataFrame:
    """(id, n_units, n_removed, removed: spans in the original text, kept: the remaining text)."""
    cut = CUTS[unit]
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", ["text"])
    found = materialize(passage_table(rows, cut, min_chars), "passages")
    parts = shuffle_partitions(docs.sparkSession, found.count())
    gone = found.where("later").select("key", "pos").unionByName(later_copies(found.where("not later"), parts))
    gone = gone.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("gone"))  # of one document
    both = rows.join(gone, rows._key == gone.key, "left").select("id", "text", "gone")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_units", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)),
                           T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_units, n_removed, spans, kept = [], [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                starts, found = units(t or "", cut)
                ends, last, lost, of = passages(found, min_chars) if g else [], 0, 0, []
                for i in g or ():  # ascending, and so are their ends
                    lost += ends[i] - max(i, last)
                    if of and i <= last:
                        of[-1]["end"] = starts[ends[i]]
                    else:
                        of.append({"start": starts[i], "end": starts[ends[i]]})
                    last = ends[i]
                n_units.append(len(found))
                n_removed.append(lost)
                spans.append(of)
                at = 0
                out = []
                for s in of:
                    out.append(t[at:s["start"]])
                    at = s["end"]
                kept.append("".join([*out, t[at:]]) if of else t)
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(spans, pa.list_(kind)), pa.array(kept, pa.string())],
                                             names=schema.fieldNames())

    return both.mapInArrow(run, schema)


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    out = dedup_units(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select(F.col("id").alias("doc_id"), "n_units", "n_removed", spans.alias("removed_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '[^\n]*?(?:[.!?,;:]+[ \t\r\f\x0B]+|[。！？，；：、]+)|[^\n]*\n|[^\n]+')) AS piece,
    generate_subscripts(regexp_extract_all(text, '[^\n]*?(?:[.!?,;:]+[ \t\r\f\x0B]+|[。！？，；：、]+)|[^\n]*\n|[^\n]+'), 1) AS k
  FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT doc_id, k, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS u,
    length(text) AS size FROM cut),
unit AS (
  SELECT doc_id, s, u, row_number() OVER w AS n, coalesce(lead(s) OVER w, size) AS e, sum(length(u) + 1) OVER w AS upto
  FROM placed WHERE u <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
lists AS (SELECT doc_id, list(u ORDER BY n) AS us FROM unit GROUP BY doc_id),
passage AS (
  SELECT a.doc_id, a.n AS i, b.n AS j, array_to_string(us[a.n:b.n], ' ') AS p
  FROM (SELECT *, (upto - length(u) - 1 + 101)::BIGINT AS want FROM unit) a
  ASOF JOIN (SELECT doc_id, n, upto::BIGINT AS upto FROM unit) b ON a.doc_id = b.doc_id AND b.upto >= a.want
  JOIN lists ON lists.doc_id = a.doc_id),
gone AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS r FROM passage) WHERE r > 1),
lost AS (SELECT DISTINCT unit.doc_id, n, s, e FROM unit JOIN gone ON unit.doc_id = gone.doc_id AND n BETWEEN i AND j),
isle AS (SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS units FROM (
  SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lost) GROUP BY doc_id, g),
spans AS (SELECT doc_id, sum(units) AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM isle GROUP BY doc_id),
bits AS (
  SELECT d.doc_id, substr(text, f + 1, t - f) AS bit, f FROM documents d JOIN (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f, s AS t FROM (
      SELECT doc_id, s, e FROM isle UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE text IS NOT NULL)) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(bit, '' ORDER BY f, length(bit)) AS kept FROM bits GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed_spans,
  sha256(kept.kept) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM unit GROUP BY doc_id) c USING (doc_id)
LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
