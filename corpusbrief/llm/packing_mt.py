"""Operator 9, best-fit packing after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for a packing, so the driver works on the length
histogram (at most ``capacity`` numbers, whatever the corpus): reduction, then best fit decreasing, both
on counts.  The plan is a bounded table of intervals "pieces of length L with ranks [a, b) go to
sequences q, q+1, ... at offset o".  Spark ranks the pieces within their length (rank inside the writing
task plus the counts of the tasks before it; no group is ever in one task) and each piece finds its
interval by binary search.

Reduction, for the longest length x still open with room R = capacity - x, k the longest length that fits:
fix {x} if nothing fits; fix {x, k} if k fills R, or no two pieces fit together in R (k then dominates
every other partner); fix {x, k, c}, c the longest that fits beside k, if no three pieces fit and no
two pieces longer than c do.  Lengths where none holds are left to best fit.

Rows: NULL and empty texts are one piece (the end token alone); repeated rows are packed each, NULL ids
too; ties of length are ranked by task and order; an empty table gives an empty table.  Only documents
longer than ``capacity`` tokens are cut.
"""
from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategies import materialize
from .common import blocks, give_back, prep, table

END = 1
# Texts of these characters only are cut into words here; others go to the tokenizer whole.  Of these characters
# LETTER and NUMBER are all that Unicode counts as such, white space is the same for everyone, and no
# character changes with its neighbours when a text is normalised.  U+023A and U+023E are left out: their lower
# case is outside LETTER.
PLAIN = re.compile("[\t\n\r -~¡-įı-ȹȻ-Ƚȿ-ʯ‐-‧‰-⁞]*")
SPECIAL = "<|"
LETTER, NUMBER = "a-zªµºß-öø-įı-ʯ", "0-9²³¹¼-¾"
WORD = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")  # the tokenizer's own cut
CACHE = 80_000  # words in a generation of a worker's memory; forgotten words are encoded again, with the same result


class WordIds:
    """Token ids of texts, by a memory of words in two generations.

    memory[word] = (place of its ids in ``flat``) * 256 + their number.  When the young generation is full it
    becomes the old one; words still in use are taken over from there.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core; threads would each keep memory
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.tokenizer = path, None
        # the same model for words that are already normalised and cut
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for w, i in self.words.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]
        self.last = np.zeros(self.words.get_vocab_size() + 1, bool)  # ids that end a word
        self.last[ends] = True
        self.young, self.young_flat, self.used = {}, np.zeros(4 * CACHE, np.uint16), 0
        self.old, self.old_flat = {}, np.zeros(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        """The ids by the full tokenizer, which is loaded when first needed."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember words by their ids, all in one row."""
        while self.used + len(ids) > len(self.young_flat):
            self.young_flat = np.concatenate([self.young_flat, np.zeros_like(self.young_flat)])
        self.young_flat[self.used:self.used + len(ids)] = ids
        first = self.used + np.cumsum(size) - size
        self.young.update(zip(words, (first << 8 | size).tolist()))
        self.used += len(ids)

    @staticmethod
    def gather(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the remembered places, in one row, and the number of each."""
        size = at & 255
        first = np.cumsum(size) - size
        return flat[np.repeat((at >> 8) - first, size) + np.arange(int(size.sum()))], size

    def learn(self, words: list[str]) -> None:
        words = list(dict.fromkeys(words))
        at = list(map(self.old.get, words))
        known = [w for w, k in zip(words, at) if k is not None]
        if known:
            self.add(known, *self.gather(self.old_flat, np.array([k for k in at if k is not None], np.int64)))
        new = [w for w, k in zip(words, at) if k is None]
        for i in range(0, len(new), 5000):
            part = new[i:i + 5000]
            rows = [" ".join(part[k:k + 50]) for k in range(0, len(part), 50)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.words.encode_batch_fast(rows, add_special_tokens=False)])
            end = np.flatnonzero(self.last[ids])
            if len(end) != len(part):
                raise ValueError("a word does not end with one end-of-word token")
            self.add(part, ids, np.diff(np.r_[-1, end]))

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the words in one row and the number of each; None if one has too many for the memory."""
        if len(self.young) > CACHE:
            self.old, self.old_flat = self.young, self.young_flat[:self.used].copy()
            self.young, self.used = {}, 0
        at = np.fromiter(map(self.young.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = [words[i] for i in unknown]
            if len(max(new, key=len)) > 100:
                return None
            self.learn(new)
            at[unknown] = list(map(self.young.__getitem__, new))
        return self.gather(self.young_flat, at)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each whole text, as the tokenizer gives them; the texts are small together or one."""
        plain = [SPECIAL not in t and PLAIN.fullmatch(t) is not None for t in texts]
        words = [WORD.findall(t.lower()) if p else [] for t, p in zip(texts, plain)]
        flat = list(chain.from_iterable(words))
        parts = [self._known(flat[i:i + 50_000]) for i in range(0, len(flat), 50_000)]
        if any(p is None for p in parts):  # a very long run of marks somewhere: each text by itself, or whole
            if len(texts) > 1:
                return [self.ids([t])[0] for t in texts]
            plain = [False]
        out = [np.zeros(0, np.uint16)] * len(texts)
        if flat and any(plain):
            size = np.cumsum(np.concatenate([[0], *(n for _, n in parts)]))
            ends = size[np.cumsum([len(w) for w in words])]
            out = np.split(np.concatenate([x for x, _ in parts]), ends[:-1])
        return [x.astype("<u4") if p else self.whole(t) for x, p, t in zip(out, plain, texts)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, _task, _rank): _rank counts the task's pieces of that length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = WordIds(tokenizer_path), {}, TaskContext.get().partitionId()
        for b in batches:
            at, rows, texts = [], [], [t or "" for t in b.column(1).to_pylist()]
            for i, ids in enumerate(x for k, e in blocks(texts, 1 << 19) for x in words.ids(texts[k:e])):
                ids = np.append(ids, np.array(END, "<u4"))
                for p, s in enumerate(range(0, len(ids), capacity)):
                    x = ids[s:s + capacity]
                    r = seen[len(x)] = seen.get(len(x), -1) + 1
                    at.append(i)
                    rows.append((p, s, len(x), zlib.crc32(x.tobytes()), task, r))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())),
                                              *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.fieldNames())
        del words, seen
        give_back()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
                           T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Plan:
    """Sequences filled on counts: rows (length, first rank, pieces, first sequence, per sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {x: n for x, n in counts.items() if n}
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        """``n`` pieces of a length into sequences first, first + 1, ..., ``each`` in one, from ``offset``."""
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, n, first, each, offset))
        self.used[length] = rank + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, members: list[int]) -> None:
        """As many sequences of exactly these lengths as the counts allow."""
        n = min(self.left[x] // members.count(x) for x in members)
        offset = 0
        for x in members:
            self.put(x, n, self.sequences, 1, offset)
            offset += x
        self.sequences += n
        self.fixed += n

    def reduce(self) -> None:
        """Fix dominating sets, longest piece first, until none is found for any length."""
        open_from = None  # lengths at or above it are left to best fit
        while True:
            lengths = sorted(self.left)
            below = [x for x in lengths if open_from is None or x < open_from]
            if not below:
                return
            x = below[-1]
            members = self._dominating(x, lengths)
            if members:
                self.fix(members)
            else:
                open_from = x

    def _smallest(self, lengths: list[int], n: int, taken: list[int]) -> int:
        """The total of the ``n`` smallest open pieces beside ``taken``; more than any room if there are fewer."""
        total = 0
        for x in lengths:
            m = min(n, self.left[x] - taken.count(x))
            total += x * m
            n -= m
            if not n:
                return total
        return 2 * self.capacity + total

    def _longest(self, lengths: list[int], room: int, taken: list[int]) -> int | None:
        i = bisect_right(lengths, room)
        while i:
            i -= 1
            if self.left[lengths[i]] > taken.count(lengths[i]):
                return lengths[i]
        return None

    def _dominating(self, x: int, lengths: list[int]) -> list[int] | None:
        room = self.capacity - x
        k = self._longest(lengths, room, [x])
        if k is None:
            return [x]
        if k == room or self._smallest(lengths, 2, [x]) > room:
            return [x, k]
        c = self._longest(lengths, room - k, [x, k])
        if c is not None and self._smallest(lengths, 3, [x]) > room:
            longer = lengths[bisect_right(lengths, c):]
            if self._smallest(longer, 2, [x]) > room:
                return [x, k, c]
        return None

    def best_fit(self) -> None:
        """Best fit decreasing: groups of equally filled sequences, each step moves a whole group."""
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
        rooms: list[int] = []  # sorted keys of groups

        def add(room: int, first: int, n: int) -> None:
            if n:
                if room not in groups:
                    groups[room] = []
                    rooms.insert(bisect_right(rooms, room), room)
                groups[room].append((first, n))

        for x in sorted(self.left, reverse=True):
            while n := self.left.get(x, 0):
                i = bisect_right(rooms, x - 1)
                if i < len(rooms):
                    room = rooms[i]
                    first, have = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[i]
                else:
                    room, have = self.capacity, -(-n // (self.capacity // x))
                    first = self.sequences
                    self.sequences += have
                each = room // x  # after one piece the sequence is still the best fit while it has room for x
                full = min(have, n // each)
                if full:
                    self.put(x, full * each, first, each, self.capacity - room)
                    add(room - each * x, first, full)
                rest = min(self.left.get(x, 0), each - 1) if full < have else 0
                if rest:
                    self.put(x, rest, first + full, rest, self.capacity - room)
                    add(room - rest * x, first + full, 1)
                    full += 1
                add(room, first + full, have - full)


def plan_packing(counts: dict[int, int], capacity: int = 4096) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Written ``pieces`` with sequence_id and offset."""
    each = found.groupBy("_task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_task")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("_task", "length", before.alias("_before"))
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    shared = found.sparkSession.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        big = int(p[:, 1].max()) + 1 if len(p) else 1  # one sorted key of (length, first rank)
        big = max(big, int((p[:, 1] + p[:, 2]).max())) if len(p) else big
        key = p[:, 0] * big + p[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + b.column("_before").to_numpy()
            r = p[np.searchsorted(key, length * big + rank, side="right") - 1]
            i = rank - r[:, 1]
            seq, offset = r[:, 3] + i // r[:, 4], r[:, 5] + i % r[:, 4] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=schema.fieldNames())

    schema = T.StructType([*found.schema.fields[:5], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    cols = [f.name for f in found.schema.fields[:5]]
    return found.join(each, ["_task", "length"]).select(*cols, "_rank", "_before").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    found = materialize(pieces(docs, path, capacity), "pieces")
    return pack(found, capacity).withColumnRenamed("id", "doc_id")


def op9_packing_mt(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir) -> DataFrame:
    """The last stage: the pieces of every document and their places."""
    prep(spark)
    return pack_documents(docs)
