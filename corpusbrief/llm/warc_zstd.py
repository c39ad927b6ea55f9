"""Operator 2, WARC records in seekable Zstandard bundles.

Records are grouped into independent zstd frames of about ``frame_bytes``; a bundle ends with a seek table in
a skippable frame (frame sizes, count, magic), so any frame can be read alone.  An index row per record
holds its bundle, frame and offset inside the frame.  Bundles are rows of a Parquet table in the shared
folder: written and committed by Spark, so a lost executor leaves no half archive, and readable from
any store; ``export`` copies them to files.

Of the records with equal payloads (of ``min_bytes`` or more) the one with the smallest page id is the
response, the others are revisits that name it and carry no payload.

Rows: a NULL payload is empty, a NULL url is left out; NULL ids come after all others, and a group without
any id is all responses; rows that repeat the smallest id of a group are responses each; an empty table
gives no bundle and no rows.  Only id, url and html are read.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import materialize
from .common import table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = "bundle string, archive binary, index array<struct<record: string, frame: int, offset: long, length: long>>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(record: str) -> int | None:
    page = record.removeprefix("<urn:page:").removesuffix(">")
    return int(page) if page else None


def record(page, url: str | None, payload: bytes, sha1: str, refers, date: str) -> bytes:
    """One WARC/1.1 record; ``refers``: None for a response, else (page,) of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers:
        head += [f"WARC-Refers-To: {record_id(refers[0])}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames(archive: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the seek table at the end alone."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table of this form")
    at, out = 0, []
    for c, _ in struct.iter_unpack("<II", archive[len(archive) - 9 - 8 * n:-9]):
        out.append((at, c))
        at += c
    return out


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20,
                  date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write all rows as bundles; returns the written table (bundle, archive, index)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    # equal payloads first meet as counts, one row a task; only payloads that repeat are joined back
    first = (rows.where(F.octet_length("html") >= min_bytes).groupBy(F.col("sha").alias("again"))
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = (rows.join(first, F.col("sha") == F.col("again"), "left")
            .select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_frame, task, done = zstandard.ZstdCompressor(level=level).compress, TaskContext.get().partitionId(), 0
        out, sizes, index, frame, held = [], [], [], [], 0

        def close_frame():
            nonlocal frame
            if frame:
                raw = b"".join(frame)
                out.append(zip_frame(raw))
                sizes.append((len(out[-1]), len(raw)))
                frame = []

        def close_bundle():
            nonlocal out, sizes, index, held, done
            close_frame()
            archive = b"".join([*out, seek_table(sizes)])
            done += 1
            kind = pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
            made = pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{done:06d}.warc.zst"]), pa.array([archive], pa.binary()),
                                               pa.array([index], pa.list_(kind))], names=["bundle", "archive", "index"])
            out, sizes, index, held = [], [], [], 0
            return made

        inside = 0
        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                payload = html.encode()
                r = record(page, url, payload, digest(payload), None if refers is None else (refers,), date)
                index.append({"record": record_id(page), "frame": len(sizes), "offset": inside, "length": len(r)})
                frame.append(r)
                inside += len(r)
                held += len(r)
                if inside >= frame_bytes:
                    close_frame()
                    inside = 0
                if held >= bundle_bytes:
                    yield close_bundle()
                    inside = 0
        if index:
            yield close_bundle()

    return materialize(rows.mapInArrow(run, BUNDLES), "warc")


def parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(h["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or f"sha1:{digest(payload)}" != h["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    return {"page_id": page_of(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"][5:],
            "record_type": h["WARC-Type"], "refers_to": page_of(h["WARC-Refers-To"]) if revisit else None,
            "url": h.get("WARC-Target-URI"), "payload": None if revisit else payload}


def read_records(bundles: DataFrame, wanted: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """All records of the archives, or those whose record id is in ``wanted`` (column record).

    Only the frames that hold a wanted record are decompressed; they are found by seek table and index.
    """
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
              "payload binary, bundle string, frame int, offset long")
    if not payload:
        schema = schema.replace("payload binary, ", "")
    if wanted is not None:
        hits = (bundles.select("bundle", F.explode("index").alias("i")).select("bundle", "i", F.col("i.record").alias("record"))
                .join(wanted.select("record").distinct(), "record", "left_semi")
                .groupBy("bundle").agg(F.collect_list("i").alias("index")))  # at most one bundle's records
        bundles = bundles.drop("index").join(hits, "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        names = [f.strip().split(" ")[0] for f in schema.split(", ")]
        for b in batches:
            for name, archive, index in zip(*(b.column(c).to_pylist() for c in ("bundle", "archive", "index"))):
                places, rows, raw, at = frames(archive), [], b"", -1
                for i in sorted(index, key=lambda i: (i["frame"], i["offset"])):
                    if i["frame"] != at:
                        at = i["frame"]
                        s, n = places[at]
                        raw = unzip(archive[s:s + n])
                    r = parse(raw[i["offset"]:i["offset"] + i["length"]])
                    if record_id(r["page_id"]) != i["record"]:
                        raise ValueError(f"the index of {name} does not lead to {i['record']}")
                    rows.append(r | {"bundle": name, "frame": at, "offset": i["offset"]})
                kinds = {"frame": pa.int32(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(),
                         "offset": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

    return bundles.select("bundle", "archive", "index").mapInArrow(run, schema)


def export(bundles: DataFrame, uri: str) -> None:
    """Write each bundle as a file under ``uri`` (any file system that pyarrow knows), whole or not at all."""
    def run(rows) -> None:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        for r in rows:
            store.create_dir(top)
            with store.open_output_stream(f"{top}/.{r.bundle}.{TaskContext.get().taskAttemptId()}") as f:
                f.write(r.archive)
            store.move(f"{top}/.{r.bundle}.{TaskContext.get().taskAttemptId()}", f"{top}/{r.bundle}")

    bundles.select("bundle", "archive").foreachPartition(run)


def op2_warc_zstd(spark, sf_dir) -> DataFrame:
    bundles = write_bundles(table(spark, sf_dir, "pages"))
    return read_records(bundles, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                       "refers_to")


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
named AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM payloads)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::BIGINT, 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM named
"""
