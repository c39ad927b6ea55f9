"""Store round trips, file ingest and the streaming ingest."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpusbrief.operators.stages import PrefixSummarizer
from corpusbrief.plans.corpus_run import run_corpus
from corpusbrief.sources import store
from corpusbrief.sources.files import file_identity, ingest_files


def _write(d, name, data):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_ingest_nested_folders(spark, scratch):
    os.makedirs(os.path.join(scratch, "sub", "x=1"))
    _write(scratch, "top.pdf", b"top")
    _write(os.path.join(scratch, "sub"), "mid.pdf", b"mid")
    _write(os.path.join(scratch, "sub", "x=1"), "deep.pdf", b"deep")
    names = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    flat, f1 = ingest_files(spark, scratch)
    assert names(flat) == ["top.pdf"] and f1.count() == 0
    deep, f2 = ingest_files(spark, scratch, recursive=True)
    assert names(deep) == ["deep.pdf", "mid.pdf", "top.pdf"] and f2.count() == 0
    one, _ = ingest_files(spark, os.path.join(scratch, "sub", "mid.pdf"))
    assert names(one) == ["mid.pdf"]
    globbed, _ = ingest_files(spark, os.path.join(scratch, "s*"), recursive=False)
    assert "mid.pdf" in names(globbed)


def test_ingest_files_and_identity(spark, scratch):
    _write(scratch, "a.pdf", b"hello")
    _write(scratch, "b.txt", b"not a pdf")
    _write(scratch, "empty.pdf", b"")
    _write(scratch, "copy.pdf", b"hello")
    missing = os.path.join(scratch, "missing.pdf")
    files, failures = ingest_files(spark, [scratch, missing])
    got = {r.file_name: r for r in file_identity(files).collect()}
    assert set(got) == {"a.pdf", "copy.pdf"}  # a 0-byte file has no row; it is a failure below
    assert got["a.pdf"].pdf_hash == hashlib.sha256(b"hello").hexdigest() == got["copy.pdf"].pdf_hash
    assert got["a.pdf"].pdf_path == os.path.join(scratch, "a.pdf")
    f = sorted((r.pdf_path, r.stage, r.message) for r in failures.collect())
    assert f == sorted([(missing, "source", f"no such file: {missing}"),
                        (os.path.join(scratch, "empty.pdf"), "extract", "empty file")])
    small, fails = ingest_files(spark, scratch, max_bytes=4)
    assert small.count() == 0
    assert sorted(r.message for r in fails.collect()) == ["empty file", "file larger than 4 bytes",
                                                           "file larger than 4 bytes"]


def test_ingest_names_with_blanks_and_manifest(spark, scratch):
    names = ["my report.pdf", "要約 2026.pdf", "100%20.pdf", "a+b#c.pdf"]
    for n in names:
        _write(scratch, n, b"text")
    _write(scratch, "leer und 空.pdf", b"")
    empty = [(os.path.join(scratch, "leer und 空.pdf"), "empty file")]
    files, failures = ingest_files(spark, scratch)
    assert sorted(r.file_name for r in file_identity(files).collect()) == sorted(names)
    assert [(r.pdf_path, r.message) for r in failures.collect()] == empty
    listing = spark.createDataFrame([("file:" + os.path.join(scratch, n), os.path.getsize(os.path.join(scratch, n)))
                                     for n in os.listdir(scratch)] + [("file:/elsewhere/x.pdf", 0)], "path string, length long")
    files, failures = ingest_files(spark, scratch, manifest=listing)
    assert files.count() == 4 and [(r.pdf_path, r.message) for r in failures.collect()] == empty


def test_stream_reports_empty_files(spark, scratch):
    from corpusbrief.streaming.ingest import start_ingest

    src, root, ck = (os.path.join(scratch, x) for x in ("in", "store", "ck"))
    os.makedirs(src)
    _write(src, "a.pdf", b"First doc. It has two sentences.")
    _write(src, "b.pdf", b"")
    start_ingest(spark, src, root, ck, length="short", summarizer="extractive").awaitTermination(120)
    assert store.read_catalog(spark, root).count() == 1
    assert [(r.pdf_path, r.message) for r in store.read_failures(spark, root).collect()] == \
        [(os.path.join(src, "b.pdf"), "empty file")]
    _write(src, "c.pdf", b"")
    _write(src, "d.pdf", b"Third doc.")
    start_ingest(spark, src, root, ck, length="short", summarizer="extractive").awaitTermination(120)
    assert sorted(r.pdf_path for r in store.read_failures(spark, root).collect()) == \
        [os.path.join(src, "b.pdf"), os.path.join(src, "c.pdf")]  # each once
    assert store.read_catalog(spark, root).count() == 2


def test_store_append_delete_compact(spark, scratch):
    root = os.path.join(scratch, "store")
    assert store.read_catalog(spark, root).count() == 0  # a store that does not exist reads as empty
    for i, t in enumerate([b"alpha. beta.", b"gamma. delta.", b"alpha. beta."]):
        _write(scratch, f"d{i}.pdf", t)
    files, _ = ingest_files(spark, scratch)
    rows, failures = run_corpus(files, length="short", summarizer="extractive")
    store.append(root, rows, failures=failures)
    cat = store.read_catalog(spark, root)
    assert cat.count() == 3 and cat.select("id").distinct().count() == 3
    victim = cat.orderBy("pdf_path").first().id
    out = store.delete(spark, root, spark.createDataFrame([(victim,), ("nope",)], "id string"))
    assert {(r.id, r.deleted) for r in out.collect()} == {(victim, True), ("nope", False)}
    assert store.read_catalog(spark, root).count() == 2
    again = store.delete(spark, root, spark.createDataFrame([(victim,)], "id string"))
    assert [r.deleted for r in again.collect()] == [False]
    new_root = os.path.join(scratch, "store2")
    store.compact(spark, root, new_root)
    assert sorted(r.id for r in store.read_catalog(spark, new_root).collect()) == \
        sorted(r.id for r in store.read_catalog(spark, root).collect())


def test_delete_in_batches_of_any_size_frees_the_same_hashes(spark, scratch, monkeypatch):
    from corpusbrief.operators import catalog
    from corpusbrief.schemas import STORE_SCHEMA

    rows = spark.createDataFrame([(f"i{k}", f"/{k}", h, 1, "s", "short", "m", None, 1, 1, 1) for k, h in
                                  enumerate(["h0", "h0", "h1", "h2", "h2", None])], STORE_SCHEMA)
    ids = spark.createDataFrame([("i0",), ("i2",), ("i3",), ("i4",), ("i5",), (None,), ("nope",)], "id string")
    for name, bound in (("small", None), ("large", lambda *a: False)):
        if bound:
            monkeypatch.setattr(catalog, "bytes_at_most", bound)
        root = os.path.join(scratch, name)
        store.append(root, rows)
        assert sum(r.deleted for r in store.delete(spark, root, ids).collect()) == 5
        freed = spark.read.parquet(os.path.join(root, "tombstones"))
        assert {(r.id, r.pdf_hash) for r in freed.collect()} == {
            ("i0", None), ("i2", "h1"), ("i3", "h2"), ("i4", "h2"), ("i5", None)}  # h0 still has a row
        assert [r.id for r in store.read_catalog(spark, root).collect()] == ["i1"]


def test_skip_seen_rerun_and_delete_regression(spark, scratch):
    root = os.path.join(scratch, "store")
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    _write(src, "a.pdf", b"one. two.")
    _write(src, "b.pdf", b"three. four.")
    files, _ = ingest_files(spark, src)
    rows, _ = run_corpus(files, length="standard", summarizer=PrefixSummarizer, chunked=False)
    store.append(root, rows)
    rows2, _ = run_corpus(files, length="standard", summarizer=PrefixSummarizer, chunked=False,
                          catalog=store.read_catalog(spark, root))
    assert rows2.count() == 0  # a second run with skip_seen appends nothing
    a_id = store.read_catalog(spark, root).where(F.col("pdf_path").endswith("a.pdf")).first().id
    store.delete(spark, root, spark.createDataFrame([(a_id,)], "id string"))
    rows3, _ = run_corpus(files, length="standard", summarizer=PrefixSummarizer, chunked=False,
                          catalog=store.read_catalog(spark, root))
    assert [r.pdf_path.endswith("a.pdf") for r in rows3.collect()] == [True]  # deleted → processed again


def test_chunked_run_with_model_budget(spark, scratch):
    from corpusbrief import fixtures as X

    _write(scratch, "long.pdf", ("word " * 3000).encode())
    files, _ = ingest_files(spark, scratch)
    rows, failures = run_corpus(files, length="short", summarizer=PrefixSummarizer, chunked=True,
                                models=X.models(spark), model="m13", chars_per_token=4)
    r = rows.collect()
    assert len(r) == 1 and failures.count() == 0 and r[0].tokens_in == 100  # 15,000 chars < 32,000 tokens


def test_stream_ingest_idempotent(spark, scratch):
    from corpusbrief.streaming.ingest import start_ingest

    src, root, ck = (os.path.join(scratch, x) for x in ("in", "store", "ck"))
    os.makedirs(src)
    _write(src, "a.pdf", b"First doc. It has two sentences.")
    q = start_ingest(spark, src, root, ck, length="short", summarizer="extractive")
    q.awaitTermination(120)
    assert store.read_catalog(spark, root).count() == 1
    _write(src, "b.pdf", b"Second doc. Also two.")
    _write(src, "c.pdf", b"First doc. It has two sentences.")
    q = start_ingest(spark, src, root, ck, length="short", summarizer="extractive", skip_seen=True)
    q.awaitTermination(120)
    cat = store.read_catalog(spark, root)
    # restart from the checkpoint: a.pdf is not read again; c.pdf has a known hash and is skipped
    assert sorted(os.path.basename(r.pdf_path) for r in cat.collect()) == ["a.pdf", "b.pdf"]


def test_build_rows_ids_time_and_pages(spark):
    import datetime as dt
    import re

    from corpusbrief.sources.files import build_rows

    dig = spark.createDataFrame(
        [("/a.pdf", "h1", None, "s1", "short", "m", 10, 20, 500), ("/b.pdf", "h2", 3, "s2", "short", "m", None,
                                                                     None, None)],
        "pdf_path string, pdf_hash string, page_count long, summary string, length string, model string, "
        "tokens_in long, tokens_out long, latency_ms long")
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=5)
    rows = {r.pdf_path: r for r in build_rows(dig).collect()}
    v4 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    assert all(v4.match(r.id) for r in rows.values()) and rows["/a.pdf"].id != rows["/b.pdf"].id
    assert rows["/a.pdf"].page_count == 0 and rows["/b.pdf"].page_count == 3
    assert rows["/a.pdf"].tokens_in == 10 and rows["/b.pdf"].tokens_in is None
    assert before <= rows["/a.pdf"].created_at <= before + dt.timedelta(minutes=5)  # session is UTC


def test_migrate_old_store_with_text_times(spark, scratch):
    old, root = os.path.join(scratch, "old"), os.path.join(scratch, "store")
    ddl = ("id string, pdf_path string, pdf_hash string, page_count long, summary string, length string, "
           "model string, created_at string")
    spark.createDataFrame(
        [("i1", "/a.pdf", "h", 2, "s", "short", "m", "2025-01-01T09:00:00+09:00"),
         ("i2", "/b.pdf", "h", 2, "s", "short", "m", "yesterday"),
         ("i3", "/c.pdf", "h", 2, "s", "short", "m", None)], ddl).write.parquet(old)
    for _ in range(2):  # a repeated migration replaces itself
        store.migrate(spark, old, root)
    got = store.read_catalog(spark, root).selectExpr("id", "string(created_at) as t", "tokens_in").collect()
    assert [(r.id, r.t, r.tokens_in) for r in got] == [("i1", "2025-01-01 00:00:00", None)]
    assert sorted((r.pdf_path, r.message) for r in store.read_failures(spark, root).collect()) == [
        ("/b.pdf", "bad created_at: yesterday"), ("/c.pdf", "bad created_at: NULL")]
    assert store.read_failures(spark, os.path.join(scratch, "none")).count() == 0


def test_legacy_run_folder_reads_with_null_usage(spark, scratch):
    from corpusbrief.schemas import STORE_COLUMNS

    root = os.path.join(scratch, "store")
    legacy = spark.createDataFrame(
        [("0123abcd-1111-4222-a333-444455556666", "/old.pdf", "h", 2, "old", "standard", "m",
          "2025-01-01T00:00:00")],
        "id string, pdf_path string, pdf_hash string, page_count long, summary string, length string, "
        "model string, created_at string")
    # an old generation: 8 columns, timestamp stored as ISO text
    legacy.selectExpr(*STORE_COLUMNS[:7], "cast(created_at as timestamp) as created_at") \
        .write.parquet(store.run_dir(root, "legacy"))
    _write(scratch, "n.pdf", b"New one. Two.")
    # the store's run=... folders under the input folder are neither read nor a partition conflict
    files, _ = ingest_files(spark, scratch)
    rows, _ = run_corpus(files, length="short", summarizer=PrefixSummarizer, chunked=False)
    store.append(root, rows)
    cat = {r.pdf_path.rsplit("/", 1)[-1]: r for r in store.read_catalog(spark, root).collect()}
    assert set(cat) == {"old.pdf", "n.pdf"}
    assert cat["old.pdf"].tokens_in is None and cat["old.pdf"].latency_ms is None
    assert cat["n.pdf"].tokens_in == 100


def test_two_streams_into_one_store(spark, scratch):
    from corpusbrief.streaming.ingest import start_ingest

    a, b, root = (os.path.join(scratch, x) for x in ("a", "b", "store"))
    os.makedirs(a)
    os.makedirs(b)
    _write(a, "one.pdf", b"Stream one. First file.")
    _write(b, "two.pdf", b"Stream two. Second file.")
    for src in (a, b):  # both streams have a batch 0
        q = start_ingest(spark, src, root, os.path.join(scratch, "ck-" + os.path.basename(src)),
                         length="short", summarizer="extractive")
        q.awaitTermination(120)
    assert sorted(os.path.basename(r.pdf_path) for r in store.read_catalog(spark, root).collect()) == \
        ["one.pdf", "two.pdf"]


def test_ingest_accepts_path_objects_and_relative_paths(spark, scratch, monkeypatch):
    import pathlib

    _write(scratch, "p.pdf", b"path object")
    one, _ = ingest_files(spark, pathlib.Path(scratch) / "p.pdf")
    assert [os.path.basename(r.path) for r in one.collect()] == ["p.pdf"]
    monkeypatch.chdir(scratch)
    rel, fails = ingest_files(spark, "p.pdf")
    got = file_identity(rel).collect()
    assert [r.pdf_path for r in got] == [os.path.join(scratch, "p.pdf")] and fails.count() == 0


def test_listing_finds_empty_files_in_nested_folders_on_the_tasks(spark, scratch, monkeypatch):
    from pyspark.sql import DataFrame

    from corpusbrief.sources import files as files_module

    def refuse(*_):
        raise AssertionError("file names on the driver")

    for folder in ("a", "a/b c", "a/b c/k=1", "a/_hidden", "a/.dot"):
        os.makedirs(os.path.join(scratch, folder))
        _write(os.path.join(scratch, folder), "empty.pdf", b"")
        _write(os.path.join(scratch, folder), "full%20.pdf", folder.encode())
        _write(os.path.join(scratch, folder), "other.txt", b"x")
    monkeypatch.setattr(DataFrame, "inputFiles", refuse)
    monkeypatch.setattr(files_module, "_ingest_by_reader", refuse)
    asked = spark.createDataFrame([(os.path.join(scratch, "a"),), (os.path.join(scratch, "a"),), (os.path.join(scratch, "a", "b c", "full%20.pdf"),),
                                   (os.path.join(scratch, "nothing"),)], "path string")
    files, failures = ingest_files(spark, asked, recursive=True)
    got = sorted((r.path, bytes(r.content), r.length) for r in files.collect())
    seen = ("a", "a/b c", "a/b c/k=1")
    assert got == sorted(("file:" + os.path.join(scratch, f, "full%20.pdf"), f.encode(), len(f)) for f in seen)
    assert sorted((r.pdf_path, r.message) for r in failures.collect()) == sorted(
        [(os.path.join(scratch, f, "empty.pdf"), "empty file") for f in seen]
        + [(os.path.join(scratch, "nothing"), f"no such file: {scratch}/nothing")])
    assert files.schema["length"].metadata == {"max": len("a/b c/k=1")}


def test_listing_agrees_with_sparks_reader(spark, scratch):
    for folder in ("x1", "x2/deep", "y", "x1/_tmp"):
        os.makedirs(os.path.join(scratch, folder))
        for name in ("a.pdf", "b.txt", "[c].pdf", "d{1}.pdf", ".h.pdf", "_h.pdf", "_k=1.pdf"):
            _write(os.path.join(scratch, folder), name, (folder + name).encode())
    rows = lambda df: sorted((r.path, r.length, bytes(r.content), r.modificationTime) for r in df.collect())
    for path, glob, recursive in [("", "*.pdf", True), ("", "*.{txt,pdf}", True), ("x*", "[ab].*", False), ("x1", None, False), ("x2", "*", True),
                                  ("x1/a.pdf", "*.pdf", False), ("x1/b.txt", "*.pdf", False), ("x?/deep", "*.pdf", False), ("*/a.pdf", None, False)]:
        at = os.path.join(scratch, path)
        ours, theirs = (rows(ingest_files(spark, at, glob, recursive, listing=kind)[0]) for kind in ("tasks", "spark"))
        assert ours == theirs, (path, glob)
    both = ingest_files(spark, os.path.join(scratch, "{x1,y}"), "a*")[0]
    assert sorted(r.path.rsplit("/", 2)[1] for r in both.collect()) == ["x1", "y"]


def test_limit_is_taken_before_any_content_is_read(spark, scratch):
    for n in "cab":
        _write(scratch, f"{n}.pdf", n.encode())
    files, _ = ingest_files(spark, scratch, limit=2)
    assert [os.path.basename(r.path) for r in files.orderBy("path").collect()] == ["a.pdf", "b.pdf"]


def _store_rows(spark, hashes, prefix="i"):
    from corpusbrief.schemas import STORE_SCHEMA

    rows = [(f"{prefix}{k}", f"/{prefix}{k}.pdf", h, 1, "s", "short", "m", None, None, None, None) for k, h in enumerate(hashes)]
    return spark.createDataFrame(rows, STORE_SCHEMA)


def test_sketch_of_every_run_and_of_runs_without_one(spark, scratch):
    from corpusbrief.operators.sketch import might_contain

    root = os.path.join(scratch, "store")
    assert store.read_sketch(spark, root).count() == 0
    store.append(root, _store_rows(spark, ["h1", "h2", None]), run_id="one")
    store.append(root, _store_rows(spark, ["h3"], "j"), run_id="two")
    _store_rows(spark, ["h4"], "k").write.parquet(store.run_dir(root, "bare"))  # an older store's run
    keys = spark.createDataFrame([(f"h{i}",) for i in range(400)] + [(None,)], "k string")
    got = {r.k: r.m for r in might_contain(keys, "k", store.read_sketch(spark, root), "m").collect()}
    assert all(got[f"h{i}"] for i in (1, 2, 3, 4)) and not got[None] and sum(got.values()) < 10
    store.append(root, _store_rows(spark, ["h5"]), run_id="one")  # a run written again has its own hashes
    got = {r.k: r.m for r in might_contain(keys, "k", store.read_sketch(spark, root), "m").collect()}
    assert got["h5"] and not got["h1"]


def test_skip_seen_is_exact_where_the_sketch_is_wrong(spark, scratch):
    from corpusbrief.operators import sketch as sketch_module
    from corpusbrief.operators.stages import skip_seen

    full = spark.range(sketch_module.WORDS).selectExpr("id as word", "-1L as bits")  # says yes to every key
    files = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "h2"), ("/d", None)], "pdf_path string, pdf_hash string")
    catalog = _store_rows(spark, ["h1", "h9"])
    for sketch in (full, sketch_module.sketch_of(catalog, "pdf_hash"), None):
        assert {r.pdf_path for r in skip_seen(files, catalog, sketch=sketch).collect()} == {"/b", "/d"}


def test_new_files_are_not_compared_with_the_catalog(spark, scratch, monkeypatch):
    from corpusbrief.operators import sketch as sketch_module
    from corpusbrief.operators import stages

    files = spark.range(500).selectExpr("concat('/f', id) as pdf_path", "concat('h', id) as pdf_hash")
    catalog = _store_rows(spark, [f"h{i}" for i in range(5)])
    asked, write = [], stages.materialize
    monkeypatch.setattr(stages, "materialize", lambda df, name: asked.append(write(df, name)) or asked[-1])
    out = stages.skip_seen(files, catalog, sketch=sketch_module.sketch_of(catalog, "pdf_hash"))
    assert out.count() == 495
    assert 5 <= asked[0].where("_maybe").count() < 20  # these alone meet the catalog


def test_stream_skips_by_state_and_forgets_what_is_deleted(spark, scratch, monkeypatch):
    from corpusbrief.streaming import ingest

    src, root, ck = (os.path.join(scratch, x) for x in ("in", "store", "ck"))
    os.makedirs(src)

    def refuse(*_, **__):
        raise AssertionError("a batch read the catalog")

    def run():
        with monkeypatch.context() as m:
            m.setattr(ingest, "read_catalog", refuse)
            q = ingest.start_ingest(spark, src, root, ck, length="short", summarizer="extractive", skip_seen=True)
            q.awaitTermination(120)
            assert q.exception() is None
        return sorted(os.path.basename(r.pdf_path) for r in store.read_catalog(spark, root).collect())

    store.append(root, _store_rows(spark, [hashlib.sha256(b"Stored before.").hexdigest()], "old"))
    for name, text in (("a", b"One."), ("b", b"One."), ("c", b"Stored before."), ("d", b"Two.")):
        _write(src, f"{name}.pdf", text)
    assert run() == ["a.pdf", "d.pdf", "old0.pdf"]  # the first path of a content
    _write(src, "e.pdf", b"Two.")
    _write(src, "f.pdf", b"Three.")
    assert run() == ["a.pdf", "d.pdf", "f.pdf", "old0.pdf"]  # restarted: the state is the checkpoint's
    victims = store.read_catalog(spark, root).where("pdf_path like '%d.pdf' or pdf_path like '%old0.pdf'").select("id")
    assert store.delete(spark, root, victims).where("deleted").count() == 2
    _write(src, "g.pdf", b"Two.")
    _write(src, "h.pdf", b"Stored before.")
    _write(src, "i.pdf", b"One.")
    assert run() == ["a.pdf", "f.pdf", "g.pdf", "h.pdf"]
    assert run() == ["a.pdf", "f.pdf", "g.pdf", "h.pdf"]


def test_a_replayed_batch_of_the_stream_replaces_its_rows(spark, scratch, monkeypatch):
    from corpusbrief.streaming import ingest

    src, root, ck = (os.path.join(scratch, x) for x in ("in", "store", "ck"))
    os.makedirs(src)
    _write(src, "a.pdf", b"One.")
    _write(src, "b.pdf", b"One.")

    def start():
        q = ingest.start_ingest(spark, src, root, ck, length="short", summarizer="extractive", skip_seen=True)
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001 - the stopped batch
            pass
        return q

    append = ingest.append

    def stop_after(*a, **k):
        append(*a, **k)
        raise RuntimeError("stopped after its rows were written")

    monkeypatch.setattr(ingest, "append", stop_after)
    assert start().exception() is not None
    monkeypatch.setattr(ingest, "append", append)
    assert start().exception() is None
    assert [os.path.basename(r.pdf_path) for r in store.read_catalog(spark, root).collect()] == ["a.pdf"]


def test_a_run_stopped_between_its_writes_is_not_seen(spark, scratch, monkeypatch):
    from pyspark.sql import DataFrameWriter

    root = os.path.join(scratch, "store")
    fails = spark.createDataFrame([("/x", "extract", "E", "m")], store.FAILURE_SCHEMA)
    write = DataFrameWriter.parquet

    def stop(self, path, *a, **k):
        if "/failures/" in path:
            raise RuntimeError("stopped")
        return write(self, path, *a, **k)

    store.append(root, _store_rows(spark, ["h0"], "first"))
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", stop)
        try:
            store.append(root, _store_rows(spark, ["h1"]), run_id="r", failures=fails)
        except RuntimeError:
            pass
    assert [r.id for r in store.read_catalog(spark, root).collect()] == ["first0"]
    store.append(root, _store_rows(spark, ["h1"]), run_id="r", failures=fails)
    assert sorted(r.id for r in store.read_catalog(spark, root).collect()) == ["first0", "i0"]
    assert store.read_failures(spark, root).count() == 1


class Counting:
    """Writes a file per call and stops the run at a text of the folder's ``stop`` file."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, text, length=None):
        import uuid

        from corpusbrief.operators.stages import Digest

        if os.path.exists(os.path.join(self.folder, "stop")) and text.endswith("7"):
            raise SystemExit("worker lost")
        open(os.path.join(self.folder, f"call-{uuid.uuid4().hex}"), "w").close()
        return Digest("sum of " + text, 1, 2, 3, "m")


def test_a_run_started_again_repeats_no_logged_call(spark, scratch):
    from functools import partial

    from corpusbrief.operators.call_log import logged
    from corpusbrief.operators.stages import summarize

    calls, log = os.path.join(scratch, "calls"), os.path.join(scratch, "log")
    os.makedirs(calls)
    _write(calls, "stop", b"")
    made = lambda: len([x for x in os.listdir(calls) if x.startswith("call-")])
    docs = spark.createDataFrame([(i, f"text {i % 20}", "short") for i in range(40)], "doc_id long, text string, length string").coalesce(1)
    factory = logged(partial(Counting, calls), log, "m")
    try:
        summarize(docs, factory).collect()
        raise AssertionError("the worker was to be lost")
    except Exception as e:  # noqa: BLE001
        assert "worker" in str(e)
    before = made()
    assert before == 7  # texts 0 to 6
    os.rename(os.path.join(calls, "stop"), os.path.join(calls, "gone"))
    got = summarize(docs, factory).collect()
    assert {r.summary for r in got} == {f"sum of text {i}" for i in range(20)} and {r.tokens_out for r in got} == {2}
    assert made() == 20  # each text once, over both runs
    other = logged(partial(Counting, calls), log, "other model")
    assert summarize(docs.limit(1), other).count() == 1 and made() == 21


def test_files_are_written_by_the_tasks_as_the_text_writer_does(spark, scratch):
    from corpusbrief.sources.listing import write_files

    rows = [(3, "c"), (1, "two\nlines"), (None, "no id"), (3, "c again"), (2, None), (-4, ""), (5, "\u00e9\u3002")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    write_files(df, f"file://{scratch}/ours", "doc_id", "text")
    df.write.partitionBy("doc_id").text(f"{scratch}/theirs")

    def files(root):
        found = [(os.path.basename(d), n, os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if d != root and not n.endswith(".crc")]
        assert all(n.startswith("part-") and n.endswith(".txt") for _, n, _ in found)
        return sorted((folder, open(path, "rb").read()) for folder, _, path in found)

    assert len(files(f"{scratch}/ours")) == 6 and files(f"{scratch}/ours") == files(f"{scratch}/theirs")


def test_a_stream_batch_reads_its_source_once(spark, scratch):
    from corpusbrief.streaming.ingest import start_ingest

    src = os.path.join(scratch, "in")
    os.makedirs(src)
    for i in range(6):
        _write(src, f"{i}.pdf", f"Document {i}. It has two sentences.".encode())
    root = os.path.join(scratch, "store")
    q = start_ingest(spark, src, root, os.path.join(scratch, "ck"), length="short", summarizer="extractive")
    q.awaitTermination(120)
    assert q.exception() is None and store.read_catalog(spark, root).count() == 6
    assert sum(p["numInputRows"] for p in q.recentProgress) == 6  # not once for each use of the batch


def test_the_queries_bound_the_tasks_of_a_listing(spark, scratch):
    from corpusbrief import queries

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        queries._prep(spark)
        assert int(spark.conf.get(key)) <= 200
    finally:
        spark.conf.set(key, before)


def test_the_extractive_run_counts_words_as_arrays(spark):
    from corpusbrief import queries

    from .conftest import SF

    plan = queries.q_summarize_corpus_extractive(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sequence(" not in plan  # no runs of a sorted array found by lambdas


def test_the_extractive_run_cuts_words_as_runs_of_bytes(spark):
    from corpusbrief import queries

    from .conftest import SF

    q = queries.q_summarize_corpus_extractive(spark, SF)
    assert "array_remove(" not in q._jdf.queryExecution().executedPlan().toString()  # no arrays of words in a row


def test_the_state_of_a_stream_passes_no_group_to_python(spark, scratch):
    from corpusbrief.streaming import ingest

    src, root, ck = (os.path.join(scratch, x) for x in ("in", "store", "ck"))
    os.makedirs(src)
    plan = ingest.admitted(ingest.file_stream(spark, src), root)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan
    texts = (("a", b"One."), ("b", b"One."), ("c", b"Two."), ("d", b""), ("e", b"One."))
    for name, text in texts:
        _write(src, f"{name}.pdf", text)
    q = ingest.start_ingest(spark, src, root, ck, length="short", summarizer="extractive", skip_seen=True, max_files_per_trigger=2)
    q.awaitTermination(120)
    # over several batches of one start, in which no batch's rows come back from the store
    assert q.exception() is None and len(q.recentProgress) > 1
    rows = store.read_catalog(spark, root).collect()
    assert len(rows) == 2 and {r.pdf_hash for r in rows} == {hashlib.sha256(t).hexdigest() for t in (b"One.", b"Two.")}
    assert [os.path.basename(r.pdf_path) for r in store.read_failures(spark, root).collect()] == ["d.pdf"]


def test_a_stream_takes_its_names_from_a_log_that_the_tasks_write(spark, scratch, monkeypatch):
    import time

    from corpusbrief.streaming import ingest

    def refuse(*_, **__):
        raise AssertionError("the driver listed the folder")

    monkeypatch.setattr(ingest, "file_stream", refuse)
    monkeypatch.setattr(ingest, "POLL_SECONDS", 1)
    src, root, ck, log = (os.path.join(scratch, x) for x in ("in", "store", "ck", "log"))
    for folder in (src, log, os.path.join(src, "deep")):
        os.makedirs(folder)
    for i in range(5):
        _write(src, f"{i}.pdf", f"Document {i}.".encode())
    _write(src, "no.txt", b"another name")
    _write(os.path.join(src, "deep"), "9.pdf", b"in a folder below")

    def noted():
        return [sorted(os.path.basename(r.path) for r in spark.read.parquet(os.path.join(log, f)).collect()) for f in os.listdir(log) if f.endswith(".parquet")]

    ingest.note_names(spark, src, log, at_most=2)
    first = noted()
    assert sorted(sum(first, [])) == [f"{i}.pdf" for i in range(5)] and max(map(len, first)) <= 2
    ingest.note_names(spark, src, log)
    assert len(noted()) == len(first)  # nothing new: no file
    ingest.note_names(spark, src, log, recursive=True)
    assert sorted(sum(noted(), [])) == [f"{i}.pdf" for i in range(5)] + ["9.pdf"]

    run = dict(length="short", summarizer="extractive")
    ingest.start_ingest(spark, src, root, ck, **run).awaitTermination(120)
    assert store.read_catalog(spark, root).count() == 5
    q = ingest.start_ingest(spark, src, root, ck, available_now=False, **run)  # goes on with the same log
    try:
        _write(src, "later.pdf", b"Came while the stream ran.")
        until = time.time() + 120
        while q.isActive and store.read_catalog(spark, root).count() < 6 and time.time() < until:
            time.sleep(1)
    finally:
        q.stop()
    assert q.exception() is None
    assert sorted(os.path.basename(r.pdf_path) for r in store.read_catalog(spark, root).collect()) == [f"{i}.pdf" for i in range(5)] + ["later.pdf"]
    with pytest.raises(FileNotFoundError):
        ingest.start_ingest(spark, os.path.join(scratch, "nowhere"), root, os.path.join(scratch, "ck2"), **run)
