"""Operator 6, SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits).  Of at most four differing bits,
the two best segments hold at most two, so one of these holds for every pair to be linked:

* some segment is equal: its raw bits are a key;
* two segments differ in one bit each.  Each segment is decoded with the perfect binary Golay code
  [23, 12, 7].  A fingerprint's keys for a pair of segments are all pairs of codeword indices that
  are reached from within one bit of its segments (at most 6 x 6); two words one bit apart always
  share one, since each reaches the other's codeword.

Fingerprints are made distinct first, then grouped by key; every pair of a bucket is verified by its
true bit distance.  A bucket of a few rows is compared in full; a larger one by pivots: whatever lies
within the distance of a pivot is linked with it, and two pivots' clusters are compared only where
the triangle inequality lets them touch and they are not connected yet.  Each task emits a spanning
forest of its links, never all pairs, and ``connected_components`` joins the forests.

Buckets come sorted and are read as a stream.  One of more than ``bucket`` fingerprints is not held: the bits
not yet known to be equal are cut into five parts, one of which is equal for every pair to be linked, and each
fingerprint goes on to the next level under its key, part and the part's bits.  Every level fixes more bits,
so buckets shrink until they fit, with the same links as if they had been compared whole.

Rows: a NULL, empty or blank text has fingerprint zero and links like any other; repeated rows get
equal fingerprints; NULL ids get a component but are never its name (the component is NULL if it has
no other id); an empty table gives an empty table.  Only the id and the text column are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategies import materialize
from .common import by_place, give_back, keyed, local_components, prep, shuffle_partitions, table, utf8
from .components import connected_components

SEED = 42
GOLAY = 0xC75  # generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SMALL = 64  # up to here a bucket is compared in full
BUCKET = 1 << 14  # fingerprints of one key that a task holds; more are keyed further


def fingerprint(text: bytes | None, words: int = 4, chunk: int = 1 << 16) -> int:
    w = (text or b"").translate(LOWER).split()  # bytes.split() cuts at x20 and x09-x0D
    if not w:
        return 0
    norm, n = b" ".join(w), max(1, len(w) - words + 1)
    lens = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(words, len(w)) - 1
    count, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, chunk):
        j = min(n, i + chunk)
        x = np.fromiter((h(norm[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + k:j + k].tolist())),
                        np.dtype("<u8"), j - i)
        count += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp bigint: the 64 bits as a signed integer) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])
        give_back()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Golay:
    """Decoding of 23-bit words to the index of the nearest codeword; tables from the generator."""

    def __init__(self) -> None:
        self.bit = np.array([self._mod(1 << i) for i in range(23)], np.int64)  # syndrome of each bit
        self.error = np.zeros(2048, np.int64)  # the coset leader of each syndrome, weight 0 to 3
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = 0
                    for x in {i, j, k}:
                        e |= 1 << x
                    self.error[self._mod(e)] = e

    @staticmethod
    def _mod(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros_like(x)
        for i, b in enumerate(self.bit.tolist()):
            s ^= (x >> i & 1) * b
        return s

    def near(self, x: np.ndarray, bits: int) -> np.ndarray:
        """(n, 6) indices of the codewords reached from x or x with one of its ``bits`` flipped; -1: none."""
        s = self.syndrome(x)
        cols = [(x ^ self.error[s]) >> 11]
        for i in range(bits):
            cols.append((x ^ (1 << i) ^ self.error[s ^ self.bit[i]]) >> 11)
        m = np.sort(np.stack(cols, 1), axis=1)
        m[:, 1:][m[:, 1:] == m[:, :-1]] = -1
        return -np.sort(-m, axis=1)[:, :6]


def keys_of(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows of an array of fingerprints (uint64)."""
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, own = [], []
    for i, s in enumerate(seg):
        keys.append((i << 40) | s)
        own.append(fp)
    near = [code.near(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        both = (tag << 40) | (near[i][:, :, None] << 12) | near[j][:, None, :]
        ok = (near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0)
        keys.append(both[ok])
        own.append(np.repeat(fp, ok.sum((1, 2))))
    return np.concatenate(keys), np.concatenate(own)


def bucket_links(f: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the distinct fingerprints ``f`` exactly as all pairs within ``d`` bits do."""
    a, b, pivots, members = [], [], [], []
    rest = f
    while rest.size:
        p = rest[0]
        near = np.bitwise_count(rest ^ p) <= d
        pivots.append(p)
        members.append(rest[near])
        a.append(np.full(int(near.sum()), p))
        b.append(members[-1])
        rest = rest[~near]
    pv, root = np.array(pivots, np.uint64), list(range(len(pivots)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(pv)):
        # members lie within d of their pivot: clusters further than 3 d apart cannot touch
        for j in (np.flatnonzero(np.bitwise_count(pv[i + 1:] ^ pv[i]) <= 3 * d) + i + 1).tolist():
            if find(i) == find(j):
                continue
            for at in range(0, len(members[i]), 1024):
                x = members[i][at:at + 1024]
                hit = np.argwhere(np.bitwise_count(x[:, None] ^ members[j][None, :]) <= d)
                if len(hit):
                    a.append(x[hit[:1, 0]])
                    b.append(members[j][hit[:1, 1]])
                    root[find(j)] = find(i)
                    break
    return np.concatenate(a), np.concatenate(b)


def partition_links(key: np.ndarray, fp: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): a spanning forest of the links inside all buckets of one partition."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        x, y = bucket_links(np.unique(fp[s:s + n]), d)
        a.append(x)
        b.append(y)
    at = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = key[at], fp[at]
    for step in range(1, SMALL):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        hit = same[np.bitwise_count(f[same] ^ f[same + step]) <= d]
        a.append(f[hit])
        b.append(f[hit + step])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    return local_components(a[a != b], b[a != b])


def segment_mask(key: np.ndarray) -> np.ndarray:
    """The bits that all fingerprints of a first-level key have in common: a raw segment's, else none."""
    known = np.array([((1 << n) - 1) << a for a, n in SEGMENTS] + [0, 0, 0], np.uint64)
    return known[key >> 40]


def finer(key: np.ndarray, mask: np.ndarray, fp: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, mask, fp) rows of the next level: of ``d`` + 1 parts of the bits outside ``mask``, each pair shares one.

    Two keys that clash only make a bucket larger, as every link is verified by its bits.
    """
    out = []
    for m in np.unique(mask):
        at = mask == m
        k, f = key[at].view(np.uint64), fp[at]
        free = [i for i in range(64) if not int(m) >> i & 1]
        for part, bits in enumerate(np.array_split(free, d + 1)):
            pm = np.uint64(sum(1 << int(i) for i in bits))
            x = (k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part)) ^ (f & pm) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            out.append(((x ^ (x >> np.uint64(29))).view(np.int64), np.full(len(f), m | pm), f))
    return tuple(np.concatenate(c) for c in zip(*out))


def stream_links(batches, d: int, bucket: int, rows: int = 1 << 19) -> Iterator[tuple]:
    """Of batches (key, mask, fp) sorted by key: ("link", node, root) and ("finer", key, mask, fp) arrays.

    At most some ``rows`` of whole buckets and ``bucket`` of the last one are held.
    """
    done, n = [], 0
    held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    over = None  # the key of a bucket that is passed on
    for batch in batches:
        if over is not None:
            end = int(np.argmax(np.r_[batch[0] != over, True]))
            if end:
                yield "finer", *finer(*(c[:end] for c in batch), d)
            batch = tuple(c[end:] for c in batch)
            if not len(batch[0]):
                continue
            over = None
        held = tuple(np.concatenate(c) for c in zip(held, batch))
        if not len(held[0]):
            continue
        last = int(np.argmax(held[0] == held[0][-1]))
        if last:
            done.append((held[0][:last], held[2][:last]))
            n += last
            held = tuple(c[last:] for c in held)
        if n >= rows:
            yield "link", *partition_links(*(np.concatenate(c) for c in zip(*done)), d)
            done, n = [], 0
        # fewer free bits than parts: no more than 2 ** d fingerprints are left in it
        if len(held[0]) > bucket and 64 - int(held[1][0]).bit_count() > d:
            over = held[0][0]
            yield "finer", *finer(*held, d)
            held = tuple(c[:0] for c in held)
    done.append((held[0], held[2]))
    yield "link", *partition_links(*(np.concatenate(c) for c in zip(*done)), d)


def link_forest(fps: DataFrame, max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp); their components are those of all links."""
    if max_bits > 4:
        raise ValueError("the keys find every pair of up to 4 differing bits")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            k, f = keys_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), code)
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i:i + (1 << 16)]),
                                                  pa.array(f[i:i + (1 << 16)].view(np.int64))], names=["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays():
            for b in batches:
                c = [x.to_numpy(zero_copy_only=False).copy() for x in b.columns]
                yield c[0], c[2].view(np.uint64) if len(c) > 2 else segment_mask(c[0]), c[1].view(np.uint64)

        for kind, *out in stream_links(arrays(), max_bits, bucket):
            if kind == "link":
                a, b, none = out[0].view(np.int64), out[1].view(np.int64), np.ones(len(out[0]), bool)
                cols = [pa.array(a), pa.array(b), pa.array(a, mask=none), pa.array(b, mask=none)]
            else:
                key, mask, f = out[0], out[1].view(np.int64), out[2].view(np.int64)
                cols = [pa.array(f), pa.array(f, mask=np.ones(len(f), bool)), pa.array(key), pa.array(mask)]
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(i, 1 << 16) for c in cols], names=["a", "b", "key", "mask"])

    keyed_rows, count, links = fps.select("fp").mapInArrow(make, "key long, fp long"), fps.count() * 90, []
    while True:
        n = shuffle_partitions(fps.sparkSession, count)
        found = materialize(keyed_rows.repartition(n, "key").sortWithinPartitions("key")
                            .mapInArrow(link, "a long, b long, key long, mask long"), "bucket-links")
        links.append(found.where("key is null and a <> b").select("a", "b"))
        keyed_rows = found.where("key is not null").select("key", F.col("a").alias("fp"), "mask")
        count = keyed_rows.count()
        if not count:
            return reduce(DataFrame.unionByName, links)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       max_bits: int = 4) -> DataFrame:
    """(id, fp, component_id): fingerprint and smallest id reachable over links of at most ``max_bits``."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(link_forest(fps, max_bits), "a", "b")
    placed = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op6_simhash_golay(spark, sf_dir) -> DataFrame:
    c = simhash_components(table(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id")


def stage(spark, docs, sf_dir) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    prep(spark)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    key = keyed(by_place(docs), doc_id, [text])
    c = simhash_components(key, "_key", text)
    keep = c.where("id = component_id").select(F.col("id").alias("_key"))
    return key.join(keep, "_key", "left_semi").drop("_key").toDF(*docs.columns)
