"""Operator 7, URL filter over a sorted digest array.

The rules' strings (host + path) are hashed with xxhash64; the sorted keys, string offsets and strings
are one index block.  It travels as broadcast bytes (at most ``block_bytes`` of rules a block, the
proven bound; more rules make more blocks, one pass each) and every task memory-maps it from an
anonymous file in memory, so no local folder is used.  A url's candidates are its host and each parent domain, times each path
length that rules have; all candidates of a batch are probed with one vectorised binary search, and a
hit counts only if the stored string is equal, so digest collisions decide nothing.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end.  A rule fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule string wins, then the longer host, then block over allow.  Without a
rule the verdict is ``default``.

Rows: NULL urls and urls without ``://`` have an empty host and path and fit no rule (a rule has a host);
repeated rows are judged each; an empty table, or no rules, works.  Only id and url are read.
"""
from __future__ import annotations

import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# fixed values of the registered query: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def index_block(rules: list[tuple[str, str, str]]) -> bytes:
    """n, then n sorted keys, n + 1 string offsets, n host lengths, n verdicts (1: block), the strings."""
    best: dict[tuple[bytes, int], int] = {}
    for host, path, verdict in rules:
        if host:
            s = (host + path).encode()
            k = (s, len(host.encode()))
            best[k] = max(best.get(k, 0), int(verdict == "block"))
    rows = sorted((xxhash.xxh64_intdigest(s), s, h, v) for (s, h), v in best.items())
    keys = np.array([r[0] for r in rows], "<u8")
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<i8")
    hosts, verdicts = np.array([r[2] for r in rows], "<i8"), np.array([r[3] for r in rows], "<i8")
    return b"".join([np.array([len(rows)], "<i8").tobytes(), keys.tobytes(), offsets.tobytes(), hosts.tobytes(),
                     verdicts.tobytes(), *(r[1] for r in rows)])


class DigestArray:
    """A memory-mapped index block."""

    def __init__(self, data: bytes) -> None:
        with open(os.memfd_create("rules"), "wb") as f:  # goes with the map
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, "<i8", 1)[0])
        part = lambda kind, first, size: np.frombuffer(self.map, kind, size, 8 * first)
        self.keys, self.offsets = part("<u8", 1, n), part("<i8", 1 + n, n + 1)
        self.hosts, self.verdicts = part("<i8", 2 + 2 * n, n), part("<i8", 2 + 3 * n, n)
        self.first = 8 * (2 + 4 * n)
        self.path_lengths = sorted(set((np.diff(self.offsets) - self.hosts).tolist()))

    def string(self, i: int) -> bytes:
        return self.map[self.first + int(self.offsets[i]):self.first + int(self.offsets[i + 1])]

    def candidates(self, host: bytes, path: bytes) -> list[tuple[bytes, int]]:
        """(string, host length): the host and its parents, each with the path starts that rules have."""
        out, at = [], 0
        while host[at:]:
            h = host[at:]
            out += [(h + path[:n], len(h)) for n in self.path_lengths if n <= len(path)]
            dot = host.find(b".", at)
            if dot < 0:
                break
            at = dot + 1
        return out

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[int, int, int, str] | None]:
        """The best rule of each (host, path) as (length, host length, block, string)."""
        owner, strings, hosts = [], [], []
        for i, (h, p) in enumerate(urls):
            for s, n in self.candidates(h.encode(), p.encode()):
                owner.append(i)
                strings.append(s)
                hosts.append(n)
        best: list = [None] * len(urls)
        if not strings or not len(self.keys):
            return best
        probe = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        lo, hi = np.searchsorted(self.keys, probe), np.searchsorted(self.keys, probe, side="right")
        for j in np.flatnonzero(hi > lo).tolist():
            for i in range(int(lo[j]), int(hi[j])):
                if int(self.hosts[i]) == hosts[j] and self.string(i) == strings[j]:
                    s = strings[j].decode()
                    found = (len(s), hosts[j], int(self.verdicts[i]), s)
                    if best[owner[j]] is None or found > best[owner[j]]:
                        best[owner[j]] = found
        return best


def url_parts(url: str | None) -> tuple[str, str]:
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[:end if slash < 0 else slash].translate({c: c + 32 for c in range(65, 91)})
    return host, "" if slash < 0 else rest[slash:end]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", block_bytes: int = 64 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) for each row."""
    parts, size = [[]], 0
    for r in rules:
        size += len(r[0]) + len(r[1]) + 40
        if size > block_bytes:
            parts.append([])
            size = 0
        parts[-1].append(r)
    best = T.StructType([T.StructField(n, t) for n, t in (("len", T.IntegerType()), ("host_len", T.IntegerType()),
                                                          ("block", T.IntegerType()), ("rule", T.StringType()))])
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()),
                           T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
                           T.StructField("best", best)])
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    for k, part in enumerate(parts):
        shared = pages.sparkSession.sparkContext.broadcast(index_block(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            index = DigestArray(shared.value)
            for b in batches:
                urls = [url_parts(u) for u in b.column(1).to_pylist()]
                found = index.judge(urls)
                if k:  # a rule of an earlier block may be the longer one
                    old = [x and tuple(x.values()) for x in b.column(4).to_pylist()]
                    found = [max((x for x in (f, o) if x), default=None) for f, o in zip(found, old)]
                kind = pa.struct([("len", pa.int32()), ("host_len", pa.int32()), ("block", pa.int32()), ("rule", pa.string())])
                rows = [f and dict(zip(("len", "host_len", "block", "rule"), f)) for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h for h, _ in urls], pa.string()),
                                                  pa.array([p for _, p in urls], pa.string()), pa.array(rows, kind)],
                                                 names=schema.fieldNames())

        out = out.mapInArrow(run, schema)
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block") == 1, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op7_url_digest(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), list(RULES)).withColumnRenamed("id", "page_id")


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS rest
  FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)/.*$') AS path FROM parts),
rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS n
  FROM named LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
