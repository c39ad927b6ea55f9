"""Catalog operators on hand-made rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusbrief.functions import scalars as S
from corpusbrief.operators import catalog as C
from corpusbrief.operators import views as V
from corpusbrief.schemas import STORE_COLUMNS, STORE_SCHEMA

FULL = "0123abcd-1111-4222-a333-444455556666"


def row(id_, path="/d/a.pdf", ts="2026-01-01 00:00:00", pages=1, tin=10, tout=20, lat=500,
        length="short", model="m01", summary="s", h="h"):
    return (id_, path, h, pages, summary, length, model,
            dt.datetime.fromisoformat(ts) if ts else None, tin, tout, lat)


@pytest.fixture
def cat(spark):
    rows = [
        row(FULL, "/d/a.pdf", "2026-01-01 10:00:00"),
        row("0123abcd-2222-4222-a333-444455556666", "/d/a.pdf", "2026-01-01 11:00:00"),
        row("ffff0000-1111-4222-a333-444455556666", "/d/b_a_rather_long_report_name.pdf",
            "2026-01-01 09:00:00", pages=None, tin=None, tout=None, lat=None),
        row("eeee0000-1111-4222-a333-444455556666", "/d/c.pdf", "2026-01-01 09:00:00",
            tin=1234567, tout=None, lat=1250),
    ]
    return spark.createDataFrame(rows, STORE_SCHEMA)


def test_id_kind(spark):
    import re

    # the reference's rule: re.match with ^...$ (where $ also matches before one final newline)
    full = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    short = re.compile(r"^[0-9a-f]{8}$")
    vals = [FULL, "0123abcd", "0123abc", "0123abcde", "zzzzzzzz", FULL.upper(), FULL + "\n", FULL + "\n\n",
            FULL + "\r", "0123abcd\n", "0123abcd\r\n", "\n0123abcd", "", "\n"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(S.id_kind("v")).collect()]
    want = ["full" if full.match(v) else "short" if short.match(v) else "invalid" for v in vals]
    assert got == want
    assert got[:7] == ["full", "short", "invalid", "invalid", "invalid", "invalid", "full"]


def test_validate_and_default_length(spark):
    df = spark.createDataFrame([(FULL, None), (FULL, ""), ("bad", "short"), (FULL, "long"), (FULL, "detailed")],
                               "id_text string, length string")
    got = [(r.resolved_length, r.valid, r.reason) for r in C.validate_requests(df).collect()]
    assert got == [("standard", True, None), ("standard", True, None), ("short", False, "invalid_id"),
                   ("long", False, "invalid_length"), ("detailed", True, None)]


def test_normalise_and_list_order(cat):
    rows = C.list_summaries(cat).collect()
    # newest first; equal times → larger id first
    assert [r.created_at.hour for r in rows] == [11, 10, 9, 9]
    assert rows[2].id > rows[3].id
    b = [r for r in rows if r.id.startswith("ffff")][0]
    assert b.page_count == 0 and b.file_name == "b_a_rather_long_report_name.pdf"
    assert b.tokens_in is None


def test_list_view_truncation(cat):
    v = {r.id: r for r in V.list_view(cat).collect()}
    r = v["ffff0000-1111-4222-a333-444455556666"]
    assert r.display_id == "ffff0000"
    assert r.display_name == "b_a_rather_long_repor..." and len(r.display_name) == 24
    assert r.created == "2026-01-01 09:00"
    full = {r.display_id for r in V.list_view(cat, full_id=True).collect()}
    assert FULL in full


def test_usage_label_and_detail(cat):
    d = {r.id: r for r in V.detail_view(cat).collect()}
    assert d[FULL].usage_line == "トークン: 入力 10 / 出力 20"
    assert d["eeee0000-1111-4222-a333-444455556666"].usage_line == "トークン: 入力 1,234,567 / 出力 -"
    assert d["ffff0000-1111-4222-a333-444455556666"].usage_line is None
    assert d[FULL].latency_line == "所要時間: 0.5秒"
    assert d["ffff0000-1111-4222-a333-444455556666"].latency_line is None
    assert d[FULL].created == "2026-01-01 10:00:00"


def test_result_view_footer(cat):
    r = {x.id: x for x in V.result_view(cat).collect()}
    assert r[FULL].footer == f"モデル: m01 | 要約ID: {FULL} | トークン: 入力 10 / 出力 20"
    assert r["ffff0000-1111-4222-a333-444455556666"].footer.endswith("ffff0000-1111-4222-a333-444455556666")
    assert r[FULL].header == "📄 a.pdf (1ページ)"


def test_resolve_prefixes(spark, cat):
    p = spark.createDataFrame([("0123abcd",), ("ffff0000",), ("zzzzzzzz",), ("",), ("e",), ("0123abcd",)],
                              "prefix string")
    got = [(r.prefix, r.match_count, r.status, r.matched_id) for r in
           C.resolve_prefixes(cat, p).orderBy("prefix").collect()]
    assert ("", 4, "many", None) in got
    assert ("0123abcd", 2, "many", None) in got
    assert ("ffff0000", 1, "one", "ffff0000-1111-4222-a333-444455556666") in got
    assert ("zzzzzzzz", 0, "none", None) in got
    assert ("e", 1, "one", "eeee0000-1111-4222-a333-444455556666") in got
    assert len(got) == 6  # one output row per input row
    # the shuffle-join fallback gives the same answer
    got2 = [(r.prefix, r.match_count, r.status, r.matched_id) for r in
            C.resolve_prefixes(cat, p, max_broadcast=1).orderBy("prefix").collect()]
    assert sorted(got2, key=str) == sorted(got, key=str)


def test_prefixes_reach_the_scan_as_cuts_that_lose_no_id(spark, cat):
    ask = lambda values: spark.createDataFrame([(v,) for v in values], "prefix string")
    near = lambda values: {r.id[:8] for r in C.near_prefixes(cat, ask(values)).collect()}
    assert near(["0123abcd-1", "ffff"]) == {"0123abcd", "ffff0000"}
    assert near([]) == near([None]) == set()
    assert near([None, "", "zz"]) == {"0123abcd", "ffff0000", "eeee0000"}
    # more prefixes than groups: cut shorter, down to none
    assert near([f"eeee{i:05d}" for i in range(1000)]) == {"eeee0000"}
    assert near([chr(0x4E00 + i) for i in range(1000)]) == {"0123abcd", "ffff0000", "eeee0000"}


def test_prefix_lookup_reads_few_rows_of_a_clustered_store(spark, tmp_path):
    import hashlib

    from corpusbrief.sources import store

    ids = [hashlib.sha256(str(i).encode()).hexdigest()[:36] for i in range(4000)]
    root, new_root = str(tmp_path / "a"), str(tmp_path / "b")
    store.append(root, spark.createDataFrame([row(i) for i in ids], STORE_SCHEMA))
    store.compact(spark, root, new_root, files=20)
    p = spark.createDataFrame([(ids[7][:6],), (ids[7][:3],), (ids[9][:5],), ("zz",)], "prefix string")
    near = C.near_prefixes(store.read_catalog(spark, new_root).select("id"), p)
    got = {r.id for r in near.collect()}
    assert got >= {i for i in ids if i.startswith((ids[7][:3], ids[9][:5]))}
    leaves = near._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 0 < read <= 3 * 4000 // 20 + 10
    want = {q: sum(i.startswith(q) for i in ids) for q in (ids[7][:6], ids[7][:3], ids[9][:5], "zz")}
    assert {r.prefix: r.match_count for r in C.resolve_prefixes(store.read_catalog(spark, new_root), p).collect()} == want


def test_many_tombstones_pass_the_rows_by_without_a_shuffle(spark, monkeypatch):
    from corpusbrief.operators import sketch

    # one column clashes with nothing; a NULL id is never deleted; a repeated id goes whole
    rows = spark.createDataFrame([(f"id{i % 900}" if i % 50 else None, i) for i in range(1000)], "id string, v long")
    gone = spark.createDataFrame([(f"id{i}",) for i in range(0, 900, 3)] * 2 + [(None,), ("other",)], "id string")
    want = {i for i in range(1000) if i % 50 == 0 or i % 900 % 3}
    for words in (sketch.WORDS, 1):  # one word of 64 bits says yes to every id: the exact comparison decides
        monkeypatch.setattr(sketch, "WORDS", words)
        out = C.apply_tombstones(rows, gone, max_broadcast=0)
        assert {r.v for r in out.collect()} == want == {r.v for r in C.apply_tombstones(rows, gone).collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines = plan.split("Union", 1)[1].splitlines()[1:]
    second = lines[0].index(":") * " " + "+-"  # where the union's second branch begins
    passed = lines[:next(i for i, x in enumerate(lines) if x.startswith(second))]
    assert passed and not any("Exchange hashpartitioning(id" in x for x in passed)
    # requests beyond the broadcast bound: whatever is asked for is there
    near = C.restrict(rows, "id", gone, max_broadcast=0)
    assert {r.v for r in near.collect()} >= {i for i in range(1000) if i not in want}


def test_deletes_beyond_the_broadcast_bound(spark, cat, monkeypatch):
    monkeypatch.setattr(C, "bytes_at_most", lambda *a: False)
    test_delete_ids_idempotent(spark, cat)
    test_delete_requests_and_resolve_and_delete(spark, cat)
    test_lookup_dispatch(spark, cat)
    test_resolve_prefixes(spark, cat)


def test_lookup_dispatch(spark, cat):
    req = spark.createDataFrame(
        [(1, FULL), (2, "0123abcd"), (3, "ffff0000"), (4, "00000000-0000-4000-a000-000000000000"),
         (5, "nothex!!"), (6, "aaaaaaaa")], "request_id long, id_text string")
    got = {r.request_id: (r.status, r.resolved_id) for r in C.lookup(cat, req).collect()}
    assert got[1] == ("ok", FULL)
    assert got[2] == ("ambiguous", None)
    assert got[3] == ("ok", "ffff0000-1111-4222-a333-444455556666")
    assert got[4] == ("not_found", None)
    assert got[5] == ("invalid", None)
    assert got[6] == ("not_found", None)


def test_delete_ids_idempotent(spark, cat):
    ids = spark.createDataFrame([(FULL,), (FULL,), ("nope",)], "id string")
    remaining, outcome = C.delete_ids(cat, ids)
    assert remaining.count() == 3
    assert {(r.id, r.deleted) for r in outcome.collect()} == {(FULL, True), ("nope", False)}
    remaining2, outcome2 = C.delete_ids(remaining, ids)
    assert remaining2.count() == 3
    assert {(r.id, r.deleted) for r in outcome2.collect()} == {(FULL, False), ("nope", False)}


def test_delete_requests_and_resolve_and_delete(spark, cat):
    req = spark.createDataFrame([(1, "ffff0000"), (2, "0123abcd")], "request_id long, id_text string")
    remaining, outcome = C.delete_requests(cat, req)
    assert remaining.count() == 3
    assert {r.request_id: r.status for r in outcome.collect()} == {1: "ok", 2: "ambiguous"}
    p = spark.createDataFrame([("e",), ("0123",)], "prefix string")
    remaining, res = C.resolve_and_delete(cat, p)
    assert remaining.where(F.col("id").startswith("e")).count() == 0 and remaining.count() == 3


def test_latest_per_path_ties(spark):
    rows = [row("a1", "/p.pdf", "2026-01-01 10:00:00"), row("a2", "/p.pdf", "2026-01-01 10:00:00"),
            row("a0", "/p.pdf", "2026-01-01 09:00:00"), row("b0", "/q.pdf", "2026-01-01 08:00:00")]
    df = spark.createDataFrame(rows, STORE_SCHEMA)
    got = {r.pdf_path: r.id for r in C.latest_per_path(df).collect()}
    assert got == {"/p.pdf": "a2", "/q.pdf": "b0"}
    paths = spark.createDataFrame([("/p.pdf",), ("/missing.pdf",)], "p string")
    found = {r.p: (r.found, r.id) for r in C.latest_per_path(df, paths, "p").collect()}
    assert found == {"/p.pdf": (True, "a2"), "/missing.pdf": (False, None)}


def test_conform_migration_idempotent(spark):
    legacy = spark.createDataFrame(
        [("x", "/a.pdf", "h", None, "s", "short", "m", "2026-01-01T00:00:00+09:00")],
        "id string, pdf_path string, pdf_hash string, page_count long, summary string, length string, "
        "model string, created_at string")
    once = C.conform(legacy)
    twice = C.conform(once)
    assert once.columns == STORE_COLUMNS and twice.columns == STORE_COLUMNS
    r = twice.collect()[0]
    assert r.tokens_in is None and r.latency_ms is None
    assert r.created_at == dt.datetime(2025, 12, 31, 15, 0)  # +09:00 normalised to UTC


def test_parse_iso_timestamp_forms(spark):
    vals = ["2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.123456+00:00", "2026-01-01T09:00:00+09:00",
            "2026-01-01 00:00:00", "not a time"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(S.parse_iso_timestamp("v")).collect()]
    assert got[0] == dt.datetime(2026, 1, 1) and got[2] == dt.datetime(2026, 1, 1)
    assert got[1].microsecond == 123456 and got[3] == dt.datetime(2026, 1, 1) and got[4] is None


def test_usage_rollup(cat):
    r = {(x.length, x.model): x for x in C.usage_rollup(cat).collect()}
    total = r[(None, None)]
    assert total.n_rows == 4 and total.n_with_usage == 3 and total.sum_tokens_in == 10 + 10 + 1234567
    assert total.max_latency_ms == 1250


def test_with_position_is_global_rank(spark):
    from corpusbrief.plans.strategies import with_position

    df = spark.range(0, 1000, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 1000)
    got = with_position(df, [F.col("k").desc()]).select("k", "position").collect()
    assert sorted((r.position, r.k) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_single_value_forms_push_down(spark, scratch, cat):
    import os
    root = os.path.join(scratch, "cat")
    cat.write.parquet(root)
    df = spark.read.parquet(root)
    one = C.get_one(df, FULL)
    assert [r.id for r in one.collect()] == [FULL]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in plan
    got = {r.prefix: (r.match_count, r.status, r.id) for p in ["0123abcd", "ffff", "zz", ""]
           for r in C.get_by_prefix(df, p).collect()}
    assert got == {"0123abcd": (2, "many", None), "ffff": (1, "one", "ffff0000-1111-4222-a333-444455556666"),
                   "zz": (0, "none", None), "": (4, "many", None)}
    assert "StringStartsWith(id,ffff)" in C.get_by_prefix(df, "ffff")._jdf.queryExecution().executedPlan().toString()


def test_seconds_rounding_matches_python(spark):
    vals = [0, 1, 49, 50, 51, 150, 250, 350, 1050, 1150, 1250, 2250, 999950, 123456789050] + list(range(0, 20000, 50))
    df = spark.createDataFrame([(v,) for v in vals], "ms long")
    got = {r.ms: r.s for r in df.select("ms", S.seconds_1dp("ms").alias("s")).collect()}
    assert got == {v: f"{v / 1000:.1f}" for v in vals}


def test_small_request_batch_filters_catalog_map_side(spark, scratch, cat):
    import os
    root = os.path.join(scratch, "cat2")
    cat.write.parquet(root)
    df = spark.read.parquet(root)
    ids = spark.createDataFrame([(1, FULL)], "request_id long, id_text string")
    plan = C.get_many(df, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan.lower()
    assert [r.found for r in C.get_many(df, ids).collect()] == [True]
    # beyond the bound a sketch of the keys filters it: it keeps every row asked for and, of these four, not all
    within, beyond = (C.restrict(df, "id", ids.select("id_text"), max_broadcast=n).select("id").collect() for n in (1 << 20, 0))
    assert [r.id for r in within] == [FULL] and FULL in [r.id for r in beyond] and len(beyond) < df.count() == 4


def test_hot_path_latest_is_partially_aggregated(spark):
    n = 3000
    df = spark.range(n).selectExpr(
        "lpad(cast(id as string), 36, '0') as id",
        "case when id % 3 = 0 then '/hot.pdf' else concat('/p', cast(id as string), '.pdf') end as pdf_path",
        "'h' as pdf_hash", "1L as page_count", "'s' as summary", "'short' as length", "'m' as model",
        "timestamp_seconds(1767225600 + id) as created_at", "1L as tokens_in", "1L as tokens_out",
        "1L as latency_ms")
    out = C.latest_per_path(df)
    got = {r.pdf_path: r.id for r in out.collect()}
    assert got["/hot.pdf"] == str(2997).zfill(36) and len(got) == 1 + n - n // 3
    assert "partial_max_by" in out._jdf.queryExecution().executedPlan().toString()


def one_row(spark, id_):
    return spark.createDataFrame([(id_,)], "id string").selectExpr(
        "id", "'/w/doc.pdf' as pdf_path", "'h' as pdf_hash", "1L as page_count", "'s' as summary", "'short' as length", "'m' as model",
        "timestamp_seconds(1767225600) as created_at", "1L as tokens_in", "1L as tokens_out", "1L as latency_ms")


def test_list_limit_zero_and_resolved_request_paths(spark):
    import os

    from corpusbrief.functions.scalars import resolved_path

    got = [r.p for r in spark.createDataFrame([("/w/x/../doc.pdf",), ("file:/w/./doc.pdf",), ("a/../b",), ("/..",)], "path string")
           .select(resolved_path("path").alias("p")).collect()]
    assert got == ["/w/doc.pdf", "/w/doc.pdf", os.getcwd() + "/b", "/"]
    cat = one_row(spark, "id1")
    assert C.list_summaries(cat, 0).count() == 0 and C.list_summaries(cat, 1).count() == 1
    req = spark.createDataFrame([("/w/x/../doc.pdf",), ("/w/none",)], "p string")
    assert {r.p: r.found for r in C.latest_per_path(cat, req, "p").collect()} == {"/w/x/../doc.pdf": True, "/w/none": False}


def test_lookup_of_null_and_invalid_ids(spark):
    cat = one_row(spark, "00000000-0000-4000-a000-000000000001")
    req = spark.createDataFrame([(1, None), (2, "zz"), (3, "00000000"), (4, "11111111"), (5, "00000000-0000-4000-a000-000000000001")], "n long, id_text string")
    got = {r.n: r.status for r in C.lookup(cat, req).collect()}
    assert got == {1: "invalid", 2: "invalid", 3: "ok", 4: "not_found", 5: "ok"}
    _, out = C.delete_requests(cat, req)
    assert {r.n: (r.status, r.gone) for r in out.collect()}[3] == ("ok", True)


def test_pages_by_cursor_are_the_list(spark):
    import datetime as dt

    from corpusbrief.schemas import STORE_SCHEMA

    rows = [(f"id{i:02d}", f"/{i}.pdf", "h", 1, "s", "short", "m", None if i % 9 == 0 else dt.datetime(2026, 1, 1 + i % 5), None, None, None)
            for i in range(40)]
    cat = spark.createDataFrame(rows, STORE_SCHEMA)
    pages, after = [], None
    while page := C.list_summaries(cat, 7, after=after).collect():
        pages += [r.id for r in page]
        after = (page[-1].created_at, page[-1].id)
    assert pages == [r.id for r in C.list_summaries(cat).collect()] and len(pages) == 40
