"""Operator 1, benchmark decontamination with a generalised suffix automaton.

The items' normalised words build one automaton.  A document's words are streamed through it: state
and length always describe the longest suffix that occurs in some item.  A length of at least
``window`` (or of a whole shorter item) marks those words; the state, lifted to the link ancestor that
holds the window, names the items.  The walk is made only on stretches whose neighbouring words are
neighbours in some item too, found with numpy; a match cannot leave such a stretch, so nothing is lost.

The items are read in blocks of about ``block_bytes`` of text (the proven bound of what is broadcast).  An
automaton takes some 180 bytes a byte of items, so a block of 2 MB is one of some 360 MB; a worker keeps the last
one it built for its later tasks.  Each block is one ``mapInArrow`` pass.  One block needs no shuffle.  With more the
rows are written once and further passes write only the spans they find, so that no task holds two automatons and the
texts are not written again; an item longer than ``piece_words`` is cut into pieces that hold each of its windows
whole, and equal (id, words) are merged, so no block is much larger than ``block_bytes`` (but for single words that are).

A normalised word is a maximal run of [0-9a-z] and non-ASCII characters after lower-casing A-Z.  An
item of fewer than ``window`` words, but not none, is one window.

Rows: a NULL or empty text has no words and is clean; NULL or wordless items match nothing; an item
without an id marks words but is not listed; item ids given twice count once; repeated documents are
judged each; empty tables give no rows or clean rows.  Very long texts are scanned whole, as lists of words in the
task that holds the row.  Only id and text are read.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategies import materialize
from .common import by_place, prep, table, utf8

# word bytes, lower-cased; all others blank
WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RUN = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton of word sequences, ready to be walked."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        pairs, coded, self.shortest = set(), [], window
        for item, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            coded.append((item, ids))
            pairs.update(zip(ids, ids[1:]))
            self.shortest = min(self.shortest, len(ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.base = len(self.vocab) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self._name(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the strings of length up to len[p] + 1."""
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _name(self, coded: list) -> None:
        """Which items each state stands for: of its window, and of whole shorter items."""
        n, w = len(self.next), self.window
        items: list[set] = [set() for _ in range(n)]
        own: list[list] = [[] for _ in range(n)]
        for k, (item, ids) in enumerate(coded):
            v = 0
            for c in ids:
                v = self.next[v][c]
                p = v
                while p > 0 and k not in items[p]:
                    items[p].add(k)
                    p = self.link[p]
            if len(ids) < w:
                while self.len[self.link[v]] >= len(ids):
                    v = self.link[v]
                own[v].append((len(ids), item))
        self.items: list[frozenset] = [frozenset()] * n  # items with the window that ends here
        self.short: list[list] = [[]] * n
        for v in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[v]
            self.short[v] = self.short[up] + sorted(own[v], key=lambda x: x[0])
            if self.len[v] >= w:
                self.items[v] = (self.items[up] if self.len[up] >= w
                                 else frozenset(coded[k][0] for k in items[v]) - {None})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [s, e) covered by windows, and the ids of the items with an occurring window."""
        n, spans, found = len(words), [], set()
        ids = np.fromiter(map(self.vocab.get, words, _zeros()), np.int64, n)
        known = ids > 0
        if not known.any():
            return spans, found
        pair = np.zeros(n, bool)  # words i - 1 and i are neighbours in an item
        at = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(at) and len(self.pairs):
            code = ids[at - 1] * self.base + ids[at]
            pos = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            pair[at[self.pairs[pos] == code]] = True
        starts = np.flatnonzero(known & ~pair)
        ends = np.r_[starts[1:], n]
        chained = np.cumsum(pair)
        for s in starts[(chained[ends - 1] - chained[starts] + 1) >= self.shortest].tolist():
            self._walk(ids, s, pair, spans, found)
        return _merged(spans), found

    def _walk(self, ids, i: int, pair, spans: list, found: set) -> None:
        nxt, link, length, w = self.next, self.link, self.len, self.window
        v = size = 0
        first, n = i, len(ids)
        while i < n and (i == first or pair[i]):
            c = int(ids[i])
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            i += 1
            if size >= w:
                spans.append((i - w, i))
                found |= self.items[v]
            for m, item in self.short[v]:
                if m > size:
                    break
                spans.append((i - m, i))
                if item is not None:
                    found.add(item)


def _zeros():
    while True:
        yield 0


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_LAST: dict[str, Automaton] = {}  # a worker's last automaton, by the name of its block


def _automaton(name: str, items: list, window: int) -> Automaton:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Automaton(items, window)
    return _LAST[name]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD).split()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [T.StructField("_words", T.LongType()), T.StructField("_spans", SPANS),
         T.StructField("_items", T.ArrayType(T.StringType()))]


def _item_pieces(items: DataFrame, id_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """The distinct (id, text) of the items' lower-case words; long items in pieces that hold each window whole."""
    step = max(1, piece_words - window + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                w = words_of(t)
                cut = [b" ".join(w[i:i + step + window - 1]) for i in range(0, max(1, len(w) - window + 1), step) if w]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.binary())],
                                                     names=["id", "text"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return materialize(rows.mapInArrow(run, "id string, text binary").distinct(), "items")


def _item_blocks(pieces: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    total = pieces.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, bytes(r.text).split()) for r in block.collect()]


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], SPAN)


def _scan(docs: DataFrame, text_col: str, block: list, window: int, hits_only: bool = False) -> DataFrame:
    """``docs`` with what one block of items finds in them; with ``hits_only`` the rows with an occurring window."""
    schema, at = T.StructType([*docs.schema.fields, *FOUND]), docs.columns.index(text_col)
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(name, shared.value, window)
        for b in batches:
            rows = [(len(w), *auto.scan(w)) for w in map(words_of, utf8(b.column(at)))]
            if hits_only:
                b = b.filter(pa.array([bool(s) for _, s, _ in rows], pa.bool_()))
                rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([n for n, _, _ in rows], pa.int64()), _spans_array([s for _, s, _ in rows]),
                 pa.array([sorted(f) for _, _, f in rows], pa.list_(pa.string()))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", block_bytes: int = 2 << 20, piece_words: int = 20_000) -> DataFrame:
    """``docs`` with _words, _spans (word ranges that lie in some item) and _items (item ids as text).

    With more than one block of items the rows are written once, with a key; each further block reads their texts
    alone and writes the rows that it hits, which are joined to them by that key at the end.
    """
    blocks = _item_blocks(_item_pieces(items, item_id, item_text, window, piece_words), block_bytes)
    out, hits = _scan(docs, text_col, next(blocks), window), []
    for block in blocks:
        if not hits:
            out = materialize(out.withColumn("_row", F.monotonically_increasing_id()), "item-block")
        found = _scan(out.select("_row", F.col(text_col).alias("text")), "text", block, window, hits_only=True)
        hits.append(materialize(found.select("_row", "_spans", "_items"), "item-hits"))
    if not hits:
        return out
    more = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(
        F.flatten(F.collect_list("_spans")).alias("_more_spans"), F.flatten(F.collect_list("_items")).alias("_more_items"))
    schema = T.StructType([*docs.schema.fields, *FOUND])
    width = len(docs.columns)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, then, own, new = (b.column(width + k).to_pylist() for k in (1, 3, 2, 4))
            spans = [_merged([(x["start"], x["end"]) for x in [*s, *(t or [])]]) for s, t in zip(first, then)]
            ids = [sorted({*s, *(t or [])}) for s, t in zip(own, new)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width + 1], _spans_array(spans), pa.array(ids, pa.list_(pa.string()))],
                                             names=[f.name for f in schema])

    return out.join(more, "_row", "left").drop("_row").mapInArrow(merge, schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the ranges, each range from its first to its last byte."""
    data = text.encode()
    at = [m.span() for m in RUN.finditer(data.translate(WORD))]
    out, last = [], 0
    for s, e in spans:
        out.append(data[last:at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
                  text_col: str = "text") -> DataFrame:
    """``docs`` with benchmark spans cut from the text; documents covered by more than ``max_coverage`` go.

    An integer n_chars column is set anew where the text changed.  Columns may have any names.
    """
    found = find_items(by_place(docs), items, window, f"c{docs.columns.index(text_col)}")
    hit = F.aggregate("_spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    found = found.where(hit <= F.lit(max_coverage) * F.col("_words"))
    names, at = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(names)).to_pylist()
            cols = list(b.columns[: len(names)])
            if any(spans):
                texts = cols[at].to_pylist()
                changed = [bool(s) for s in spans]
                for i, s in enumerate(spans):
                    if s:
                        texts[i] = cut_words(texts[i], [(x["start"], x["end"]) for x in s])
                cols[at] = pa.array(texts, cols[at].type)
                if "n_chars" in names and pa.types.is_integer(cols[names.index("n_chars")].type):
                    c = names.index("n_chars")
                    cols[c] = pa.array([len(t) if x else n for t, x, n in zip(texts, changed, cols[c].to_pylist())],
                                       cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.select(*found.columns[:len(names)], "_spans").mapInArrow(cut, docs.schema)


def op1_decontam_automaton(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"),
                        F.size("_items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def stage(spark, docs, sf_dir) -> DataFrame:
    prep(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM items)),
places AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT d.*, s.size, unnest(range(1, len(w) - s.size + 2)) AS p FROM doc_words d JOIN (SELECT DISTINCT size FROM windows) s ON len(w) >= s.size)),
hits AS (SELECT doc_id, p, size, item_id FROM places JOIN windows USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS i FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
