"""Pipeline stages on hand-made rows."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusbrief.operators import stages as ST
from corpusbrief.plans.chunked import summarize_chunked


def test_split_chunks_edges(spark):
    texts = [(1, ""), (2, "abc"), (3, "abcdef"), (4, "a😀b😀c😀d"), (5, "日本語のテキスト" * 3), (6, "x" * 33000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = ST.split_chunks(df, 3).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))),
                                 lambda x: x["chunk"]), "").alias("joined"),
        F.count(F.lit(1)).alias("n"), F.max(F.length("chunk")).alias("mx"))
    got = {r.doc_id: r for r in out.collect()}
    assert 1 not in got  # an empty text has no chunks
    for i, t in texts[1:]:
        assert got[i].joined == t and got[i].mx <= 3 and got[i].n == -(-len(t) // 3)


@settings(max_examples=15, deadline=None)
@given(st.text(min_size=0, max_size=60), st.integers(min_value=1, max_value=9))
def test_split_chunks_lossless_property(spark, text, size):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = [r.chunk for r in ST.split_chunks(df, size).orderBy("chunk_no").collect()]
    assert "".join(chunks) == text
    assert all(0 < len(c) <= size for c in chunks)


def test_extract_utf8_and_failures(spark):
    df = spark.createDataFrame([("/a", bytearray("héllo\fpage2".encode())), ("/b", bytearray(b"\xff\xfe"))],
                               "pdf_path string, content binary")
    got = {r.pdf_path: r for r in ST.extract(df).collect()}
    assert got["/a"].text == "héllo\fpage2" and got["/a"].page_count == 2 and got["/a"].stage is None
    assert got["/b"].stage == "extract" and got["/b"].text is None


def test_python_extractor_and_summarizer_failures_per_row(spark):
    rows = [(i, f"/f{i}", bytearray(("x" * i).encode())) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, pdf_path string, content binary")
    ex = ST.extract(df, ST.FailingExtractor(), key="doc_id").withColumn("length", F.lit("short"))
    out = ST.summarize(ex, ST.FailingSummarizer).collect()
    assert len(out) == 39  # ok + failures = input
    by = {r.doc_id: r for r in out}
    assert by[13].stage == "extract" and by[26].stage == "extract"
    assert by[19].stage == "summarize" and by[19].error_class == "RuntimeError"
    assert by[1].summary == "[digest length=short] x..." and by[1].tokens_in == 100
    ok, bad = ST.split_failures(ST.summarize(ex, ST.FailingSummarizer))
    assert ok.count() + bad.count() == 39


def test_prefix_summary_expression_matches_python(spark):
    df = spark.createDataFrame([("a" * 50, "detailed"), ("short text", None), ("x", "")],
                               "text string, length string")
    expr = [tuple(r.d) for r in df.select(ST.prefix_summary("text", "length", "m").alias("d")).collect()]
    py = ST.PrefixSummarizer("m")
    want = []
    for t, ln in [("a" * 50, "detailed"), ("short text", None), ("x", "")]:
        d = py(t, ln or None)
        want.append((d.summary, d.tokens_in, d.tokens_out, d.latency_ms, d.model))
    assert expr == want


def test_chunk_budget_fallbacks(spark):
    from corpusbrief import fixtures as X

    docs = spark.createDataFrame([("m01",), ("m07",), ("m11",), ("m13",), ("m14",)], "model string")
    got = {r.model: r.budget_tokens for r in ST.chunk_budget(docs, X.models(spark)).collect()}
    assert got == {"m01": 40000, "m07": 80000, "m11": 40000, "m13": 32000, "m14": 32000}


def test_templates_and_prompts(spark):
    ov = spark.createDataFrame([("short", "Bullets only."), ("standard", "Key points:\n\n{text}"), ("detailed", "")],
                               "length string, override string")
    t = {r.length: r.template for r in ST.resolve_templates(ov).collect()}
    assert t["short"] == "Bullets only." and t["detailed"] == ST.DEFAULT_TEMPLATES["detailed"]
    docs = spark.createDataFrame([(1, "DOC", "short"), (2, "DOC", "standard"), (3, "DOC", "detailed")],
                                 "doc_id long, text string, length string")
    p = {r.doc_id: r.prompt for r in ST.render_prompts(docs, ST.resolve_templates(ov), "Be brief.").collect()}
    assert p[1] == "Bullets only.\n\nAdditional instructions: Be brief.\n\nDOC"
    assert p[2] == "Key points:\n\nDOC\n\nAdditional instructions: Be brief."
    assert p[3].endswith("DOC\n\nAdditional instructions: Be brief.")
    p0 = {r.doc_id: r.prompt for r in ST.render_prompts(docs, ST.resolve_templates(None), "").collect()}
    assert p0[1] == ST.DEFAULT_TEMPLATES["short"].replace("{text}", "DOC")


def test_skip_seen_and_limit(spark):
    files = spark.createDataFrame([(1, "/b", "h1"), (2, "/a", "h1"), (3, "/c", "h2"), (4, "/d", "h3")],
                                  "doc_id long, pdf_path string, pdf_hash string")
    catalog = spark.createDataFrame([("h3",)], "pdf_hash string")
    got = sorted((r.doc_id, r.pdf_path) for r in ST.skip_seen(files, catalog).collect())
    assert got == [(2, "/a"), (3, "/c")]
    first = ST.limit_items(files.withColumnRenamed("pdf_path", "path"), 1).collect()
    assert [r.path for r in first] == ["/a"]


def test_classify_failures(spark):
    f = spark.createDataFrame([("/a", "extract", "ValueError", "m"), ("/b", "summarize", "ConfigError", "m"),
                               ("/f", "load", "ConfigError", "m"), ("/g", "extract", "SummarizationError", "m"),
                               ("/c", "sink", "SinkError", "m"), ("/d", "summarize", "KeyError", "m"),
                               ("/e", "other", "Boom", "m")],
                              "pdf_path string, stage string, error_class string, message string")
    got = {r.pdf_path: (r.category, r.severity) for r in ST.classify_failures(f).collect()}
    assert got == {"/a": ("extract", 1), "/b": ("summarize", 1), "/f": ("config", 2), "/g": ("extract", 1), "/c": ("sink", 1), "/d": ("summarize", 1),
                   "/e": ("other", 1)}
    rep = {(r.stage, r.category): r.n_failures for r in ST.run_report(ST.classify_failures(f)).collect()}
    assert rep[("extract", "extract")] == 2 and sum(rep.values()) == 7


def test_summarize_chunked_levels_and_failures(spark):
    docs = spark.createDataFrame([(1, "a" * 50, "short"), (2, "b" * 2000, "short"), (3, "c" * 300, "short")],
                                 "doc_id long, text string, length string")
    out = {r.doc_id: r for r in summarize_chunked(docs, ST.PrefixSummarizer, 50, 4).collect()}
    assert out[1].levels == 0 and out[1].tokens_in == 100 and out[1].stage is None
    # 2000 chars → 10 chunks of 200 → 10 summaries joined (570 chars) → 3 chunks → 3 summaries → final call
    assert out[2].levels == 2 and out[2].stage is None and out[2].summary.startswith("[digest length=short]")
    assert out[2].tokens_in == 100 * (10 + 3 + 1)
    assert out[3].levels == 1 and out[3].tokens_in == 100 * (2 + 1)

    class Verbose(ST.PrefixSummarizer):
        def __call__(self, text, length=None):
            d = super().__call__(text, length)
            d.summary = text + text
            return d

    bad = {r.doc_id: r for r in summarize_chunked(docs, Verbose, 20, 4).collect()}
    assert bad[2].stage == "summarize" and bad[1].stage is None


class Echo:
    """Reports the prompts it was given and keeps the middle of the text: whole chunks are read."""

    def __call__(self, text, length=None):
        return ST.Digest(text[len(text) // 4: len(text) // 2], 1, 1, 1, "echo")


class Seen:
    def __call__(self, text, length=None):
        if not (text.startswith("T:") and text.endswith("Additional instructions: be brief")):
            raise ValueError("a call without its prompt: " + text[:40])
        return ST.Digest("s", 1, 1, 1, "seen")


def test_chunked_accounts_for_every_document(spark):
    docs = spark.createDataFrame([(1, None, "short"), (2, "", "short"), (3, "x" * 5000, "short"), (4, "y" * 90, None), (5, "z" * 5000, "long")],
                                 "doc_id long, text string, length string")
    out = {r.doc_id: r for r in summarize_chunked(docs, Echo, 25, 4).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[1].message == "no text" and out[1].stage == "summarize"
    assert out[3].stage is None and out[3].levels > 2 and out[5].stage is None
    templates = spark.createDataFrame([("short", "T:{text}")], "length string, template string")
    out = {r.doc_id: r for r in summarize_chunked(docs, Seen, 25, 4, templates=templates, extra="be brief").collect()}
    assert out[3].stage is None and out[3].summary == "s" and out[3].levels == 2
    assert out[5].message == "unknown length long" and out[4].message == "unknown length NULL" and len(out) == 5


def test_split_chunks_is_lossless_with_any_characters(spark):
    t = "aé漢\U0001F600\n\r" * 500
    rows = ST.split_chunks(spark.createDataFrame([(1, t, 7), (2, "", 3), (3, None, 3)], "i long, text string, n int"), "n").orderBy("chunk_no").collect()
    assert "".join(r.chunk for r in rows) == t and {len(r.chunk) for r in rows[:-1]} == {7} and {r.i for r in rows} == {1}


def test_pdf_bytes_are_not_text(spark):
    f = spark.createDataFrame([("/a.pdf", bytearray(b"%PDF-1.4 1 0 obj")), ("/b", bytearray(b"plain"))], "pdf_path string, content binary")
    got = {r.pdf_path: (r.stage, r.text) for r in ST.extract(f).collect()}
    assert got == {"/a.pdf": ("extract", None), "/b": (None, "plain")}


def test_skip_seen_by_another_key(spark):
    f = spark.createDataFrame([("/a", "h", "k1"), ("/b", "h", "k2"), ("/c", "h", "k2"), ("/d", None, None)], "pdf_path string, pdf_hash string, name string")
    seen = spark.createDataFrame([("k1",)], "name string")
    assert {r.pdf_path for r in ST.skip_seen(f, seen, key_col="name").collect()} == {"/b", "/d"}


def test_hot_hash_dedup_is_partially_aggregated(spark):
    # a third of all files are copies of one content
    n = 3000
    files = spark.range(n).selectExpr(
        "id as doc_id", "concat('/f/', lpad(cast(id as string), 5, '0')) as pdf_path",
        "case when id % 3 = 0 then 'hot' else concat('h', cast(id as string)) end as pdf_hash")
    catalog = spark.createDataFrame([("h1",)], "pdf_hash string")
    out = ST.skip_seen(files, catalog, ["pdf_path", "doc_id"])
    rows = {r.pdf_hash: r.pdf_path for r in out.collect()}
    assert rows["hot"] == "/f/00000" and "h1" not in rows and len(rows) == 1 + (n - n // 3) - 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in plan  # map-side combine before the shuffle


def test_pdf_extractor_is_gated_on_an_installed_library():
    import importlib.util

    have = any(importlib.util.find_spec(m) for m in ("pypdf", "pypdfium2"))
    if have:
        assert callable(ST.pdf_extractor())
    else:
        import pytest

        with pytest.raises(ImportError, match="no PDF library"):
            ST.pdf_extractor()


class Tail:
    """Keeps the first characters of each text, so that combined texts are known."""

    def __call__(self, text, length=None):
        if "!" in text:
            raise ValueError("refused " + text[:2])
        return ST.Digest(text[:3], len(text), 1, 1, "tail")


def plain_chunked(text, room, level=0):
    if len(text) <= room:
        return text[:3], level
    joined = "\n\n".join(text[i:i + room][:3] for i in range(0, len(text), room))
    return plain_chunked(joined, room, level + 1) if len(joined) < len(text) else (None, level + 1)


def test_chunks_are_combined_as_the_joined_text_would_be(spark):
    texts = ["", "a", "abcdefgh" * 2, "abcdefgh" * 33, "x" * 999, "é漢\U0001F600z" * 200]
    docs = spark.createDataFrame([(i, t, "short") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    for room in (8, 16, 40):
        out = {r.doc_id: (r.summary, r.levels) for r in summarize_chunked(docs, Tail, room // 4, 4).collect()}
        assert out == {i: plain_chunked(t, room) for i, t in enumerate(texts)}


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = [(1, "a" * 50), (2, "b" * 50), (2, "c" * 50), (None, "d" * 50), (None, "e" * 50), (None, None), (2, "f")]
    docs = spark.createDataFrame([(*r, "short") for r in rows], "doc_id long, text string, length string")
    got = sorted((str(r.doc_id), r.summary or "", r.message or "") for r in summarize_chunked(docs, Tail, 4, 4).collect())
    assert got == sorted((str(i), plain_chunked(t, 16)[0] if t else "", "" if t else "no text") for i, t in rows)


def test_the_first_chunks_error_is_kept(spark):
    docs = spark.createDataFrame([(1, "ok" * 20 + "B!" + "x" * 60 + "C!" * 9 + "y" * 30, "short")], "doc_id long, text string, length string")
    r = summarize_chunked(docs, Tail, 5, 4).first()
    assert (r.stage, r.error_class, r.message) == ("summarize", "ValueError", "refused B!")


def test_one_document_of_very_many_chunks(spark):
    # 60,000 chunks of 8 characters; sums of lengths go over blocks of 10,000 chunks
    text = "".join(f"{i:07d} " for i in range(60_000))
    r = summarize_chunked(spark.createDataFrame([(None, text, "short")], "doc_id long, text string, length string"), Tail, 2, 4).first()
    assert (r.summary, r.levels) == plain_chunked(text, 8) and r.stage is None


def test_advice_names_the_category_and_the_message(spark):
    f = spark.createDataFrame([("/a", "source", "FileNotFoundError", "no such file: /a"), ("/b", "extract", "E", None)],
                              "pdf_path string, stage string, error_class string, message string")
    got = {r.pdf_path: r.advice for r in ST.classify_failures(f).collect()}
    assert got == {"/a": "The file could not be read. (no such file: /a)", "/b": "The file could not be turned into text."}
