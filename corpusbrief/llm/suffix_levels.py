"""Operator 3, suffix-array dedup with a logarithmic family of indexes.

Which bytes go: every byte inside a string of ``length`` bytes that also starts earlier (smaller id, or same
document and smaller offset), judged on the input.

A full suffix array of every position would hold 20 bytes a byte of text.  These are sparse: a string of
``length`` bytes is filed under its anchor, the leftmost smallest hash among its GRAM-byte pieces.  Equal
strings have equal anchors at equal offsets, so equal strings always meet.  An entry stands for a run of
consecutive starts with one anchor and holds the hash of the anchor's gram, the hash of the run's whole
context, and the run's position; the array is sorted by these hashes, so equal suffix pieces are neighbours.

1. Scan: each task makes the array of a batch of text.  Of equal runs only the first leaves the task; the
   others are decided.  An anchor with more than BATCH_RUNS contexts inside one batch is hot: its runs are
   cut into single strings, which are combined the same way, and one row says so.  A key therefore
   costs at most BATCH_RUNS rows a batch, however frequent it is.
2. Family: entries meet by anchor, in order of position.  Each arriving batch is sorted and merge-scanned
   against the existing levels; what is found there starts earlier.  The rest becomes a new level, and
   levels of equal size merge geometrically.  Anchors that end up with several contexts are mixed.
3. The runs of mixed anchors fetch their bytes.  Those of an anchor with up to GROUP_RUNS contexts meet by
   anchor and are compared there, string by string; those of hot anchors are cut into single strings at
   once, combined per batch, and meet by string, so no anchor is too large for a task.
4. All ranges meet their document, whose bytes are cut.

Two strings count as equal if the 64-bit hash of the anchor's gram and the 64-bit hash of the string (two
different polynomials) both agree.

Rows: NULL and empty texts have no bytes; rows with the same id are ordered by text, equal rows one after
the other; NULL ids come first; an empty table gives an empty table.  Texts longer than BLOCK are scanned
in overlapping blocks.  Only id and text are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategies import materialize
from .common import give_back, keyed, shuffle_partitions, table

GRAM = 32
BLOCK = 1 << 22  # bytes of text that a task hashes and combines at once
BATCH_RUNS, GROUP_RUNS = 8, 256  # from more contexts on, an anchor's strings are spread over tasks
PART_RUNS = 4_000_000  # 40 bytes each, three times that while levels merge
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(29))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


class Rolling:
    """Polynomial hashes modulo 2^64 of any pieces of a buffer of up to ``size`` bytes."""

    def __init__(self, base: int, size: int) -> None:
        self.size = size
        self.power = np.full(size + 1, U(base))
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.letter = mix(np.arange(1, 257, dtype=U) * U(base)) | U(1)

    def load(self, data: np.ndarray) -> None:
        self.sums = None  # the ones before go first
        x = self.letter[data]
        x *= self.power[:len(data)]
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(x, out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash of each piece of ``length`` bytes, by start."""
        n = max(0, len(self.sums) - length)
        if not n:
            return np.zeros(0, U)
        x = self.sums[length:] - self.sums[:n]
        x *= self.power[self.size - n + 1:][::-1][:n]
        return mix(x)

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[self.size - start])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (width - step)], v[width - step:]) if width > step else v


class Scanner:
    """Runs and string hashes of batches of text."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.first, self.second = Rolling(0x9E3779B97F4A7C15, BLOCK + length), Rolling(0xD6E8FEB86659FD93, BLOCK + length)

    def runs(self, parts: list[tuple[int, int, bytes]]) -> tuple:
        """parts: (key, offset in the document, bytes).  Per run: anchor hash, context hash, key, start, n, buffer place."""
        length = self.length
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        size = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(size)
        self.second.sums = None
        self.first.load(data)
        h = self.first.all(GRAM)
        self.first.sums = None
        v = h >> U(24)
        v <<= U(24)
        v |= np.arange(len(h), dtype=U)
        owner = (sliding_min(v, length - GRAM + 1) & U(0xFFFFFF)).astype(np.int32)
        del v
        of = np.repeat(np.arange(len(parts)), np.maximum(0, size - length + 1))  # part of each inner start
        at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(0, size - length + 1)), np.maximum(0, size - length + 1))
        at += (ends - length + 1)[of]
        owner = owner[at]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])] if len(at) else np.zeros(0, bool)
        i = np.flatnonzero(new)
        n = np.diff(np.r_[i, len(at)])
        place, of, own = at[i], of[i], owner[i]
        del at, owner, new
        self.second.load(data)
        context = self.second.pieces(place, place + n + length - 1)
        context = mix(context ^ (h[own] * U(3)) ^ (n.astype(U) << U(32)) ^ (own - place).astype(U))
        key = np.array([k for k, _, _ in parts], np.int64)[of]
        start = np.array([o for _, o, _ in parts], np.int64)[of] + place - (ends - size)[of]
        return h[own], context, key, start, n, place

    def strings(self) -> np.ndarray:
        """The hash of each string of ``length`` bytes of the batch last scanned, by buffer place."""
        return self.second.all(self.length)


def released(run):
    """``run``, which hands the memory it freed back to the system when its task ends."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def neighbours(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sorted (a, b): whether a row equals the one before."""
    return np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])] if len(a) else np.zeros(0, bool)


def group_sizes(a: np.ndarray) -> np.ndarray:
    """For sorted ``a``: how many rows have the row's value."""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(a)])
    return np.repeat(n, n)


def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] numbers each, one after the other."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) - np.repeat(total - n, n) + np.repeat(first, n)


def combined(a, b, key, start):
    """Sorted by (a, b, key, start): the four columns and whether a row repeats the one before."""
    o = np.lexsort((start, key, b, a))
    a, b, key, start = a[o], b[o], key[o], start[o]
    return a, b, key, start, neighbours(a, b)


def batch(kind: int, a, b, key, start, n) -> Iterator[pa.RecordBatch]:
    cols = [np.asarray(c) for c in (a, b, key, start, n)]
    cols = [c.view(np.int64) if c.dtype == U else c.astype(np.int64) for c in cols]
    for i in range(0, len(cols[0]), 1 << 16):
        part = [pa.array(c[i:i + (1 << 16)]) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=NAMES)


# kind RUN: anchor, context, position and number of starts (0: the anchor is hot); STRING: anchor, hash of one
# string, position; GONE: position and number of starts that repeat earlier ones; FEW, HOT: runs of mixed anchors
RUN, STRING, GONE, FEW, HOT = range(5)
NAMES = ["kind", "a", "b", "key", "start", "n"]
ROWS = "kind int, a long, b long, key long, start long, n long"


def gone_starts(key, start) -> Iterator[pa.RecordBatch]:
    """Single repeated starts, joined to ranges."""
    o = np.lexsort((start, key))
    key, start = key[o], start[o]
    i = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]) if len(key) else o
    zero = np.zeros(len(i), np.int64)
    return batch(GONE, zero, zero, key[i], start[i], np.diff(np.r_[i, len(key)]))


def scan(docs: DataFrame, length: int) -> DataFrame:
    """The RUN, STRING and GONE rows of all batches of ``docs`` (_key, text).

    The kinds are only right together, from the same batches: RUN leaves out what GONE reports, and sends one row
    for a hot anchor whose strings STRING has.  Callers write the rows before they take them apart.
    """
    def emit(scanner: Scanner, parts: list) -> Iterator[pa.RecordBatch]:
        a, b, key, start, n, place = scanner.runs(parts)
        o = np.lexsort((start, key, b, a))
        a, b, key, start, n, place = (c[o] for c in (a, b, key, start, n, place))
        again = neighbours(a, b)
        yield from batch(GONE, a[again], b[again], key[again], start[again], n[again])
        a, b, key, start, n, place = (c[~again] for c in (a, b, key, start, n, place))
        mixed = group_sizes(a) > BATCH_RUNS
        yield from batch(RUN, *(c[~mixed] for c in (a, b, key, start, n)))
        if mixed.any():
            one = np.unique(a[mixed])
            zero = np.zeros(len(one), np.int64)
            yield from batch(RUN, one, zero, zero, zero, zero)
            n = n[mixed]
            h = scanner.strings()[expand(place[mixed], n)]
            a, b, key, start, again = combined(np.repeat(a[mixed], n), h, np.repeat(key[mixed], n), expand(start[mixed], n))
            yield from batch(STRING, *(c[~again] for c in (a, b, key, start, start)))
            yield from gone_starts(key[again], start[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, parts, held = Scanner(length), [], 0
        for rb in batches:
            for key, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                for at in range(0, max(0, len(t or b"") - length + 1), BLOCK // 2):
                    p = t[at:at + BLOCK // 2 + length - 1]
                    if held + len(p) > BLOCK:
                        yield from emit(scanner, parts)
                        parts, held = [], 0
                    parts.append((key, at, p))
                    held += len(p)
        if parts:
            yield from emit(scanner, parts)

    return docs.select("_key", F.col("text").cast("binary").alias("text")).mapInArrow(released(run), ROWS)


class Levels:
    """Logarithmic family of sorted arrays of runs: (context, anchor, key, start, n), sorted by context."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []
        self.mixed: list[np.ndarray] = []

    def add(self, a, b, key, start, n) -> np.ndarray:
        """Take a batch that follows all earlier ones; the indices of its runs that repeat earlier ones."""
        self.mixed.append(np.unique(a[n == 0]))
        i = np.flatnonzero(n)
        i = i[np.lexsort((start[i], key[i], a[i], b[i]))]
        again = neighbours(a[i], b[i])
        for level in self.levels:  # merge-scan: both sides are sorted by context
            at = np.searchsorted(level[0], b[i])
            ok = at < len(level[0])
            again[ok] |= (level[0][at[ok]] == b[i][ok]) & (level[1][at[ok]] == a[i][ok])
        new = i[~again]
        if len(new):
            top = [b[new], a[new], key[new], start[new], n[new]]
            while self.levels and len(self.levels[-1][0]) <= 2 * len(top[0]):  # sizes stay geometric
                top = [np.concatenate(c) for c in zip(self.levels.pop(), top)]
                o = np.argsort(top[0], kind="stable")  # merges two sorted runs
                top = [c[o] for c in top]
            self.levels.append(top)
        return i[again]

    def mixed_runs(self) -> tuple:
        """(anchor, key, start, n, hot) of the runs whose anchor has several contexts."""
        if not self.levels:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        _, a, key, start, n = (np.concatenate(c) for c in zip(*self.levels))
        o = np.argsort(a, kind="stable")
        a, key, start, n = a[o], key[o], start[o], n[o]
        size = group_sizes(a)
        hot = (size > GROUP_RUNS) | np.isin(a, np.concatenate(self.mixed))
        pick = hot | (size > 1)
        return a[pick], key[pick], start[pick], n[pick], hot[pick]


def family(runs: DataFrame, partitions: int) -> DataFrame:
    """GONE and MIXED rows from the RUN rows of all batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held, size = Levels(), [], 0

        def flush():
            a, b, key, start, n = (np.concatenate(c) for c in zip(*held))
            i = levels.add(a, b, key, start, n)
            held.clear()
            return batch(GONE, a[i], b[i], key[i], start[i], n[i])

        for rb in batches:
            a, b, key, packed = (rb.column(c).to_numpy() for c in range(4))
            held.append([a, b, key, packed >> 16, packed & 0xFFFF])
            size += len(rb)
            if size >= 1 << 16:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        *cols, hot = levels.mixed_runs()
        for kind, pick in ((FEW, ~hot), (HOT, hot)):
            a, key, start, n = (c[pick] for c in cols)
            yield from batch(kind, a, a, key, start, n)

    packed = F.shiftleft("start", 16).bitwiseOR(F.col("n")).alias("packed")  # a run has fewer than 2^16 starts
    return (runs.select("a", "b", "key", packed).repartition(partitions, "a").sortWithinPartitions("key", "packed")
            .mapInArrow(released(run), ROWS))


def packed_texts(rows: DataFrame) -> DataFrame:
    """(id, _key, z): the texts as zstd bytes, for the shuffles to their ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_text = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = pa.array([zip_text(t or b"") for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], names=["id", "_key", "z"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("_key", T.LongType()),
                           T.StructField("z", T.BinaryType())])
    return rows.select("id", "_key", F.col("text").cast("binary")).mapInArrow(released(run), schema)


def fetch(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """FEW rows with their bytes, and STRING and GONE rows of the HOT runs, from each document's own runs."""
    runs = mixed.groupBy("key").agg(F.collect_list(F.struct("kind", "a", "start", "n")).alias("runs"))
    both = docs.join(runs, F.col("_key") == F.col("key")).select("_key", "z", "runs")

    def emit(second: Rolling, rows: list) -> Iterator[pa.RecordBatch]:
        a, h, key, start = strings_of(second, rows, length)
        a, b, key, start, again = combined(a, h, key, start)
        for rb in (*batch(STRING, *(c[~again] for c in (a, b, key, start, start))), *gone_starts(key[again], start[again])):
            yield with_bytes(rb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, hot, held, unzip = Scanner(length).second, [], 0, zstandard.ZstdDecompressor().decompress
        for rb in batches:
            few = []
            for key, z, own in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                t = unzip(z)
                for r in own:
                    row = (r["a"], key, r["start"], t[r["start"]:r["start"] + r["n"] + length - 1])
                    if r["kind"] == FEW:
                        few.append(row)
                        continue
                    if held + len(row[3]) > BLOCK:
                        yield from emit(second, hot)
                        hot, held = [], 0
                    hot.append(row)
                    held += len(row[3])
            if few:
                a, key, start, text = zip(*few)
                zero = np.zeros(len(few), np.int64)
                at = 0
                for part in batch(FEW, np.array(a), zero, np.array(key), np.array(start), zero):
                    yield with_bytes(part, text[at:at + len(part)])
                    at += len(part)
        if hot:
            yield from emit(second, hot)

    return both.mapInArrow(released(run), ROWS + ", bytes binary")


def with_bytes(rb: pa.RecordBatch, texts: tuple | None = None) -> pa.RecordBatch:
    last = pa.nulls(len(rb), pa.binary()) if texts is None else pa.array(texts, pa.binary())
    return pa.RecordBatch.from_arrays([*rb.columns, last], names=[*NAMES, "bytes"])


def strings_of(second: Rolling, rows: list[tuple], length: int) -> tuple:
    """(a, hash, key, start) of every string of the runs (a, key, start, bytes)."""
    second.load(np.frombuffer(b"".join(r[3] for r in rows), np.uint8))
    size = np.array([len(r[3]) for r in rows])
    n = size - length + 1
    a, key, start = (np.array(c, np.int64) for c in zip(*(r[:3] for r in rows)))
    return np.repeat(a, n).view(U), second.all(length)[expand(np.cumsum(size) - size, n)], np.repeat(key, n), expand(start, n)


def compare(rows: DataFrame, length: int, partitions: int) -> DataFrame:
    """GONE rows of all strings that start earlier in another row of their anchor (FEW) or hash (STRING)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, held, size = Scanner(length).second, [], 0

        def flush():
            t = pa.Table.from_batches(held)
            kind, (a, b, key, start) = t["kind"].to_numpy(), (t[c].to_numpy() for c in NAMES[1:5])
            few = np.flatnonzero(kind == FEW)
            texts, one = t["bytes"].take(pa.array(few)).to_pylist(), kind == STRING
            found = [[a[one].view(U), b[one].view(U), key[one], start[one]]]
            at = 0
            while at < len(few):  # whole anchors, about a block at a time
                end, total = at, 0
                while end < len(few) and (total < BLOCK // 2 or a[few[end]] == a[few[end - 1]]):
                    total += len(texts[end])
                    end += 1
                i = few[at:end]
                found.append(strings_of(second, list(zip(a[i].tolist(), key[i].tolist(), start[i].tolist(), texts[at:end])), length))
                at = end
            for f in found:
                _, _, k, s, again = combined(*f)
                yield from gone_starts(k[again], s[again])
            g = kind == GONE
            yield from batch(GONE, a[g], b[g], key[g], start[g], t["n"].to_numpy()[g])

        for rb in batches:  # sorted by p: equal p stay together
            p = rb.column("p").to_numpy()
            if held and size >= 1 << 14 and p[0] != held[-1].column("p")[-1].as_py():
                yield from flush()
                held, size = [], 0
            elif size >= 1 << 14:
                cut = int(np.argmax(p != p[0])) if p[-1] != p[0] else 0
                if cut:
                    held.append(rb.slice(0, cut))
                    yield from flush()
                    held, size, rb = [], 0, rb.slice(cut)
            held.append(rb)
            size += len(rb)
        if held:
            yield from flush()

    p = F.when(F.col("kind") == FEW, F.col("a")).otherwise(F.xxhash64("kind", "a", "b", F.when(F.col("kind") == GONE, F.col("start"))))
    return rows.withColumn("p", p).repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(released(run), ROWS)


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start in the ranges (start, n)."""
    out: list[list[int]] = []
    for s, n in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + length - 1)
        else:
            out.append([s, s + n + length - 1])
    return [(s, e) for s, e in out]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id, n_bytes, removed: byte spans, kept: the remaining bytes) for each row."""
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", ["text"])
    # anchors change about every (length - GRAM + 1) / 2 bytes; a partition of the family holds some PART_RUNS runs
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark, 2 * size // (length - GRAM + 1), PART_RUNS)
    packed = packed_texts(rows)
    scanned = materialize(scan(rows, length), "suffix-scan")
    found = materialize(family(scanned.where(F.col("kind") == RUN), parts), "suffix-levels")
    cut = fetch(packed, found.where(F.col("kind").isin(FEW, HOT)), length)
    hot = scanned.where(F.col("kind") == STRING).withColumn("bytes", F.lit(None).cast("binary"))
    compared = materialize(compare(cut.unionByName(hot), length, parts), "strings")
    gone = scanned.unionByName(found).where(F.col("kind") == GONE).unionByName(compared)
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))  # of one document
    both = packed.join(gone, F.col("_key") == F.col("key"), "left").select("id", "z", "gone")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            size, spans, kept = [], [], []
            for z, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = unzip(z)
                m = merged([(x["start"], x["n"]) for x in g or ()], length)
                out, last = [], 0
                for s, e in m:
                    out.append(t[last:s])
                    last = e
                size.append(len(t))
                spans.append([{"start": s, "end": e} for s, e in m])
                kept.append(b"".join([*out, t[last:]]))
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(kind)),
                                              pa.array(kept, pa.binary())], names=schema.fieldNames())

    return both.mapInArrow(released(apply), schema)


def op3_suffix_levels(spark, sf_dir) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", n.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
