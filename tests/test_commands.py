"""The four user commands end to end on a temporary store (the reference's e2e flow)."""
import os

from corpusbrief.operators.stages import PrefixSummarizer
from corpusbrief.plans import commands as K


def _write(d, name, data):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)
    return os.path.join(d, name)


def test_summarize_list_show_delete(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    a = _write(src, "sample.pdf", b"This is a sample file for testing. It contains English text for extraction.")
    b = _write(src, "other_with_a_very_long_file_name.pdf", b"Second file. Different text.")
    root = os.path.join(scratch, "store")

    result, failures = K.summarize_paths(spark, root, [a, b, os.path.join(src, "missing.pdf")],
                                         length="short", summarizer=PrefixSummarizer, chunked=False)
    res = {r.header: r for r in result.collect()}
    assert "📄 sample.pdf (1ページ)" in res
    assert res["📄 sample.pdf (1ページ)"].summary_text == "[digest length=short] This is a sample file for test..."
    assert [r.stage for r in failures.collect()] == ["source"]

    listed = K.list_catalog(spark, root).collect()
    assert len(listed) == 2 and {r.display_name for r in listed} == {"sample.pdf", "other_with_a_very_lon..."}
    full = [r.id for r in K.list_catalog(spark, root, full_id=True).collect()]

    req = spark.createDataFrame([(1, full[0]), (2, full[1][:8]), (3, "nothex!!"),
                                 (4, "00000000-0000-4000-a000-000000000000")], "request_id long, id_text string")
    shown = {r.request_id: r for r in K.show_requests(spark, root, req).collect()}
    assert shown[1].status == "ok" and shown[1].id_kind == "full" and shown[1].usage_line.startswith("トークン")
    assert shown[2].status == "ok" and shown[2].resolved_id == full[1]
    assert shown[3].status == "invalid" and shown[4].status == "not_found" and shown[4].file_name is None

    out = {r.request_id: r.status for r in K.delete_requests(spark, root, req.where("request_id <= 2")).collect()}
    assert out == {1: "ok", 2: "ok"}
    assert K.list_catalog(spark, root).count() == 0
    again = {r.request_id: r.status for r in K.delete_requests(spark, root, req.where("request_id = 1")).collect()}
    assert again == {1: "not_found"}

    # summarise again: a new row for the same path (the reference appends, it does not replace)
    K.summarize_paths(spark, root, a, length="detailed", summarizer="extractive")
    K.summarize_paths(spark, root, a, length="standard", summarizer="extractive")
    assert K.list_catalog(spark, root).count() == 2
    skipped, _ = K.summarize_paths(spark, root, a, skip_seen=True)
    assert skipped.count() == 0
