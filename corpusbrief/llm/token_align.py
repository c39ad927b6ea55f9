"""Operator 13, alignment of the tokens that two tokenizers give one text.

Per Arrow batch the texts are encoded by a byte-level BPE (A, a blank before the text) and by a piece BPE (B, which
adds that blank itself); every token becomes a row (document, start, end, id) in bytes.  ``pandas.merge_asof``, keyed by
document, finds for each token start the other side's token that covers it; the union of both directions is the
set of overlapping pairs.  Pairs that end together are the links, and their ends cut the document into groups.

A document's links leave the task as distinct id pairs with their number.  Pairs are counted over the corpus by an
ordinary partially aggregated ``groupBy``; the counts return to the documents by a join, broadcast only if the pairs
take less than a checked number of bytes (a shuffle join otherwise), and are summed per document.

Texts are cut into blocks of about ``BLOCK`` bytes for the frames; one longer text is a block by itself, read whole.

Rows: a NULL or empty text, and one whose joined A or B bytes are not a blank and the text (U+2581 in it, say), has
no tokens: zeros, no groups; rows are aligned each for itself, so repeated rows and ids count as often as they
occur and NULL ids stay; an empty table gives an empty table; only id and text are read.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import broadcast_if_small, materialize
from .common import blocks, give_back, table

BLOCK = 1 << 20  # bytes of text a frame of tokens is made of
# texts of these letters alone (assigned since long, so that both libraries class them alike) take the faster library
PLAIN = re.compile("[\x00-\u024f\u0370-\u04ff\u2010-\u2027\u2030-\u205e\u20ac]*")
ALIGNED = "row long, id {id}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
PAIR = 1 << 32  # a pair's code: A id * PAIR + B id


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A: ids of texts and the bytes of each id, read from a tokenizer file with a byte-level vocabulary."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        plain = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes_of = {i: b for b, i in plain.items()} | {i: t.encode() for t, i in special.items()}
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        odd = [" " + t for t in texts if not PLAIN.fullmatch(t)]
        odd = iter(self.whole.encode_batch_fast(odd, add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if PLAIN.fullmatch(t) else next(odd).ids for t in texts]


class PieceBPE:
    """B: ids of texts and the bytes of each id, read from a SentencePiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                         for i in range(self.model.get_piece_size()) for p in [self.model.id_to_piece(i)]}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _loaded(a_path: str, b_path: str) -> tuple:
    """Tokenizers of a worker, the byte lengths of their ids and the ids as text with what may follow one in a group."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = []
    for t in (ByteBPE(a_path), PieceBPE(b_path)):
        n = np.zeros(max(t.bytes_of) + 1, np.int64)
        for i, b in t.bytes_of.items():
            n[i] = len(b)
        out.append((t, n))
    top = max(len(n) for _, n in out)
    return *out, [f"{i}{sep}" for sep in ",|;" for i in range(top)], top


def token_frame(texts: list[bytes], ids: list[list[int]], size: np.ndarray, bytes_of: dict[int, bytes]) -> pd.DataFrame:
    """(doc, start, end, id) of the tokens; ``start`` and ``end`` count bytes through the whole block.

    Documents whose joined bytes are not a blank and the text have no rows.
    """
    good = [b"".join(map(bytes_of.__getitem__, x)) == b" " + t for t, x in zip(texts, ids)]
    n = np.array([len(x) if g else 0 for x, g in zip(ids, good)], np.int64)
    doc = np.repeat(np.arange(len(ids)), n)
    flat = np.fromiter(chain.from_iterable(x for x, g in zip(ids, good) if g), np.int64, int(n.sum()))
    held = np.array([len(t) + 1 if g else 0 for t, g in zip(texts, good)], np.int64)
    place = np.cumsum([len(t) + 1 for t in texts]) - np.cumsum(held)  # what documents without rows add
    end = np.cumsum(size[flat]) + np.repeat(place, n)
    return pd.DataFrame({"doc": doc, "start": end - size[flat], "end": end, "id": flat})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (row of a, row of b) of tokens of one document that share a byte."""
    def covering(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = pd.DataFrame({"doc": left["doc"], "start": left["start"]})
        y = pd.DataFrame({"doc": right["doc"], "start": right["start"], "row": np.arange(len(right))})
        cover = pd.merge_asof(x, y, on="start", by="doc")["row"].to_numpy().astype(np.int64)
        return cover, right["start"].to_numpy()[cover] == left["start"].to_numpy()

    of_a, _ = covering(a, b)
    of_b, same = covering(b, a)  # pairs of equal starts are those that the first direction found, too
    late = np.flatnonzero(~same)
    return np.concatenate([np.arange(len(a)), of_b[late]]), np.concatenate([of_a, late])


def align(texts: list[str], a_path: str, b_path: str):
    """Per text (A tokens, B tokens, groups, groups as text, distinct pair codes, times of each)."""
    (ta, size_a), (tb, size_b), words, top = _loaded(a_path, b_path)
    raw = [t.encode() for t in texts]
    ids_a, ids_b = ta.encode(texts), tb.encode(texts)
    a, b = token_frame(raw, ids_a, size_a, ta.bytes_of), token_frame(raw, ids_b, size_b, tb.bytes_of)
    there = [np.bincount(x["doc"], minlength=len(texts)) > 0 for x in (a, b)]
    good = there[0] & there[1] & np.array([t != "" for t in texts], bool)
    a, b = (x[good[x["doc"]]].reset_index(drop=True) for x in (a, b))
    in_a, in_b = overlaps(a, b)
    ends = a["end"].to_numpy()[in_a] == b["end"].to_numpy()[in_b]
    at_a, at_b = np.sort(in_a[ends]), np.sort(in_b[ends])  # links cross nowhere: both sides ascend together

    n = len(texts)
    doc_a, doc_b, id_a, id_b = (x[c].to_numpy() for c in ("doc", "id") for x in (a, b))
    of = doc_a[at_a]
    n_a, n_b, n_groups = (np.bincount(x, minlength=n) for x in (doc_a, doc_b, of))
    # tokens in the order of their groups, A before B; a group ends with its link, a document with its last group
    tokens_a, tokens_b = np.arange(len(a)), np.arange(len(b))
    before_b, upto_a = np.concatenate([[0], at_b + 1]), at_a + 1
    place_a = tokens_a + before_b[np.searchsorted(at_a, tokens_a)]
    place_b = tokens_b + upto_a[np.searchsorted(at_b, tokens_b)]
    id_a_sep, id_b_sep = id_a.copy(), id_b.copy()
    id_a_sep[at_a] += top  # "|" after the A tokens of a group, ";" after its B tokens
    id_b_sep[at_b] += 2 * top
    index = np.empty(len(a) + len(b), np.int64)
    index[place_a], index[place_b] = id_a_sep, id_b_sep
    index, last = index.tolist(), np.cumsum(n_a + n_b)
    code, code_doc = id_a[at_a] * PAIR + id_b[at_b], of
    by = np.lexsort((code, code_doc))
    code, code_doc = code[by], code_doc[by]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (code_doc[1:] != code_doc[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(code))).astype(np.int32)
    code, cut = code[begin], np.searchsorted(code_doc[begin], np.arange(n + 1))
    groups = ["".join(map(words.__getitem__, index[e - k:e]))[:-1] for k, e in zip((n_a + n_b).tolist(), last.tolist())]
    return n_a, n_b, n_groups, groups, code, times, cut


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups: ``a1,a2|b1;a3|b2,b3``, pairs: distinct codes, times) for each row."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ALIGNED.format(id=docs.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in blocks(texts, BLOCK):
                n_a, n_b, n_groups, groups, code, times, cut = align(texts[i:j], a_path, b_path)
                at = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n_a), pa.array(n_b),
                     pa.array(n_groups), pa.array(groups, pa.string()), pa.ListArray.from_arrays(at, pa.array(code)),
                     pa.ListArray.from_arrays(at, pa.array(times))],
                    names=["row", "id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])
                if sum(map(len, texts[i:j])) > 4 * BLOCK:
                    give_back()

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count: links of the corpus that hold it, best: whether no pair of its B id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = materialize(counts.withColumn("b", F.col("pair") % PAIR), "token-pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(broadcast_if_small(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the documents with links."""
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times"))
    return (each.join(broadcast_if_small(counts), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("count")).alias("count_sum")))


def op13_token_align(spark, sf_dir, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers as P

    aligned = align_tokens(table(spark, sf_dir, "documents"), a_path or P.path("byte_bpe_50k.json"),
                           b_path or P.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = materialize(aligned.withColumn("groups", digest), "aligned")
    sums = link_sums(aligned, pair_counts(aligned)).withColumnRenamed("row", "of")
    return aligned.join(sums, F.col("row") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), F.col("groups").alias("groups_sha256"))
