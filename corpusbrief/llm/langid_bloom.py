"""Operator 5, language ID by language-bitmask n-gram filters.

Learning: per language a set of byte 5-grams of the normalised text (letters only, single blanks), the
``capacity`` most frequent by documents among those in at least ``min_share`` of its documents.  Each
set fills one Bloom filter; the filters are bit-sliced, so that one table slot holds one bit per
language and the AND of an n-gram's slots is the bitmask of all languages that contain it.

Prediction: look up every n-gram of the whole text, count each language's bits, correct the counts
for the filter's measured false-positive rate ((hits - n * fp) / (1 - fp), at least 0), take the
largest.  The score is its share of all languages' corrected counts.

Bounds (documented parameters): the ``max_langs`` languages with most documents are learned, each from about
``train_docs`` documents chosen by a hash of the id; ``capacity`` n-grams a language and 2**``log_slots`` slots
bound the model, which is broadcast.
Prediction reads every row and whole texts.

Rows: a NULL text, or one without a letter, is ``und`` with score 0; so is everything if nothing can
be learned.  A text with letters but no known n-gram gets the language with most learned documents,
score 0.  Ties go to the smaller language name.  A NULL id is neither held out nor learned from.
Repeated rows are learned from and predicted each.  Only id, text and lang are read.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, give_back, prep, table

LETTER = re.compile(r"[^\W\d_]")
N = 5
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd multipliers, one per filter probe
BLANK = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-case letters with single blanks, one before and one after; empty if there is no letter."""
    if not text or not LETTER.search(text):
        return b""
    words = text.lower().encode("utf-8", "replace").translate(BLANK).split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: bytes) -> np.ndarray:
    """The byte N-grams of ``data``, each packed into a uint64."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(x) - N + 1)
    out = x[:n].copy()
    for i in range(1, N):
        out |= x[i:n + i] << np.uint64(8 * i)
    return out


@dataclass
class Model:
    langs: list[str]  # sorted
    default: str | None
    tables: list[np.ndarray]  # one uint64 mask table per 64 languages
    fp: np.ndarray  # false-positive rate by language
    log_slots: int

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        out = []
        for t in self.tables:
            m = None
            for c in SPREAD:
                slot = t[((g * np.uint64(c)) >> np.uint64(64 - self.log_slots)).astype(np.int64)]
                m = slot if m is None else m & slot
            out.append(m)
        return out

    def counts(self, parts: list[bytes]) -> np.ndarray:
        """Corrected counts, one row per text and one column per language."""
        size = np.array([max(0, len(p) - N + 1) for p in parts])
        out = np.zeros((len(parts), len(self.langs)))
        if not self.langs:
            return out
        for k, p in enumerate(parts):
            for at in range(0, size[k], 1 << 20):  # long texts go through in pieces, each n-gram once
                for w, m in enumerate(self.masks(grams(p[at:at + (1 << 20) + N - 1]))):
                    kind, n = np.unique(m, return_counts=True) if len(m) < 64 else self._kinds(m)
                    for x in range(min(64, len(self.langs) - 64 * w)):
                        out[k, 64 * w + x] += n[(kind >> np.uint64(x)) & np.uint64(1) == 1].sum()
        return np.maximum(0, out - size[:, None] * self.fp) / (1 - self.fp)

    def _kinds(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.langs) <= 8:
            n = np.bincount(m.astype(np.int64), minlength=1 << len(self.langs))
            return np.arange(len(n), dtype=np.uint64), n
        return np.unique(m, return_counts=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts = [normalise(t) for t in texts]
        c = self.counts(parts)
        total, best = c.sum(1), c.argmax(1) if len(self.langs) else None
        langs, scores = [], []
        for k, p in enumerate(parts):
            if not p or self.default is None:
                langs.append("und")
                scores.append(0.0)
            elif total[k] <= 0:
                langs.append(self.default)
                scores.append(0.0)
            else:
                langs.append(self.langs[best[k]])
                scores.append(min(1.0, float(c[k, best[k]] / total[k])))
        return langs, scores


def _rest(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = 3000, capacity: int = 20_000, min_share: float = 0.004, log_slots: int = 19,
          max_langs: int = 256) -> Model:
    """Fit the filters on documents whose crc32(id) mod 3 is not 1, with a language and a text."""
    usable = (docs.where((_rest(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    by_size = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    n_docs = {r.lang: r.n for r in by_size.limit(max_langs).collect()}
    langs = sorted(n_docs)
    empty = [np.zeros(1 << log_slots, np.uint64) for _ in range(max(1, -(-len(langs) // 64)))]
    if not langs:
        return Model([], None, empty, np.zeros(0), log_slots)
    share = F.lit(None)
    for name in langs:
        share = F.when(F.col("lang") == name, math.ceil(min(1.0, train_docs / n_docs[name]) * (1 << 30))).otherwise(share)
    sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    code = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}

        def flush():
            for lang, parts in found.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lang, np.int32)), pa.array(g.view(np.int64)),
                                                  pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            found.clear()

        held = 0
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.unique(grams(normalise(t)))  # documents that contain it
                found.setdefault(code[lang], []).append(g)
                held += len(g)
                if held > 1_500_000:
                    yield from flush()
                    held = 0
        yield from flush()
        give_back()

    grouped = (sample.select("text", "lang").mapInArrow(count, "lang int, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    used = sample.groupBy("lang").agg(F.count("*").alias("n")).collect()
    least = F.lit(2)
    for r in used:
        least = F.when(F.col("lang") == code[r.lang], max(2, math.ceil(min_share * r.n))).otherwise(least)
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = grouped.where(F.col("n") >= least).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= capacity)
    rows = kept.select("lang", "gram").toPandas()  # at most capacity rows per language
    model = Model(langs, max(langs, key=lambda x: (n_docs[x], [-ord(c) for c in x])), empty, np.zeros(len(langs)), log_slots)
    for i in range(len(langs)):
        g = rows.gram.to_numpy()[rows.lang.to_numpy() == i].astype(np.int64).view(np.uint64)
        t, bit = model.tables[i // 64], np.uint64(1 << (i % 64))
        for c in SPREAD:
            slot = np.unique(((g * np.uint64(c)) >> np.uint64(64 - log_slots)).astype(np.int64))
            t[slot] |= bit
        model.fp[i] = (np.count_nonzero(t & bit) / len(t)) ** len(SPREAD)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row; the model travels once per executor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = F.coalesce(_rest(id_col) == 1, F.lit(False))
    return docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_langid_bloom(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).withColumnRenamed("id", "doc_id")


def accepts(lang: str, score: float, n: int, min_score: float = 0.3, z: float = 2.0) -> bool:
    """Whether a text of ``n`` n-grams may be in a language: the upper confidence bound of its score reaches ``min_score``.

    The score is a share of ``n`` observations, with a standard error of at most 1 / (2 sqrt(n)); ``z`` errors are
    granted.  One rule at every length: the fewer n-grams, the lower the score that is still no evidence against a text.
    """
    return lang != "und" and (n == 0 or score + z / (2 * math.sqrt(n)) >= min_score)


def stage(spark, docs, sf_dir, min_score: float = 0.3) -> DataFrame:
    """Documents go if they are ``und``, or if their score is below ``min_score`` beyond its error (``accepts``)."""
    prep(spark)
    shared = spark.sparkContext.broadcast(learn(docs))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = shared.value.predict(texts)
            keep = [accepts(x, s, max(0, len(normalise(t)) - N + 1), min_score) for x, s, t in zip(lang, score, texts)]
            yield b.filter(pa.array(keep, pa.bool_())).rename_columns(names)

    return by_place(docs).mapInArrow(run, docs.schema)
