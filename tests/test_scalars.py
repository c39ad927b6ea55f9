"""Scalar expressions and small rules, case tables in the style of the reference's unit tests."""
import datetime as dt

from pyspark.sql import functions as F

from corpusbrief import fixtures as X
from corpusbrief.functions import scalars as S
from corpusbrief.operators import catalog as C
from corpusbrief.operators import stages as ST
from corpusbrief.schemas import STORE_SCHEMA


def _one(spark, expr, rows, ddl):
    df = spark.createDataFrame(rows, ddl)
    return [r[0] for r in df.select(expr).collect()]


USAGE_CASES = [
    (None, None, ""),
    (1234, 567, "トークン: 入力 1,234 / 出力 567"),
    (1234, None, "トークン: 入力 1,234 / 出力 -"),
    (None, 567, "トークン: 入力 - / 出力 567"),
    (0, 0, "トークン: 入力 0 / 出力 0"),
    (1234567890, 1000, "トークン: 入力 1,234,567,890 / 出力 1,000"),
]


def test_usage_label_cases(spark):
    got = _one(spark, S.usage_label("a", "b"), [(a, b) for a, b, _ in USAGE_CASES], "a long, b long")
    assert got == [w for _, _, w in USAGE_CASES]


NAME_CASES = [("a.pdf", "a.pdf"), ("x" * 24, "x" * 24), ("x" * 25, "x" * 21 + "..."),
              ("日本語のファイル名です" * 3, ("日本語のファイル名です" * 3)[:21] + "..."), ("", "")]


def test_truncate_name_cases(spark):
    got = _one(spark, S.truncate_name("n"), [(n,) for n, _ in NAME_CASES], "n string")
    assert got == [w for _, w in NAME_CASES]


PATH_CASES = [("/a/b/c.pdf", "c.pdf"), ("/a/b/", "b"), ("c.pdf", "c.pdf"), ("/", ""), ("/a//b.pdf", "b.pdf")]


def test_base_name_cases(spark):
    got = _one(spark, S.base_name("p"), [(p,) for p, _ in PATH_CASES], "p string")
    assert got == [w for _, w in PATH_CASES]


def test_strip_scheme(spark):
    got = _one(spark, S.strip_scheme("p"), [("file:/tmp/a.pdf",), ("file:///tmp/a.pdf",), ("/tmp/a.pdf",),
                                             ("s3a://b/k.pdf",)], "p string")
    assert got == ["/tmp/a.pdf", "/tmp/a.pdf", "/tmp/a.pdf", "s3a://b/k.pdf"]


def test_time_formats(spark):
    ts = [(dt.datetime(2026, 3, 4, 5, 6, 7, 890000),)]
    assert _one(spark, S.list_time("t"), ts, "t timestamp") == ["2026-03-04 05:06"]
    assert _one(spark, S.detail_time("t"), ts, "t timestamp") == ["2026-03-04 05:06:07"]


def test_latency_label(spark):
    got = _one(spark, S.latency_label("m"), [(1500,), (None,), (0,), (99949,)], "m long")
    assert got == ["所要時間: 1.5秒", None, "所要時間: 0.0秒", "所要時間: 99.9秒"]


def test_sha256_of_known_bytes(spark):
    import hashlib

    got = _one(spark, S.sha256_hex("b"), [(bytearray(b"hello"),), (bytearray(b""),)], "b binary")
    assert got == [hashlib.sha256(b"hello").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_budget_column_equals_python_rule(spark):
    limits = [i for _, _, i, _, _ in X.MODEL_ROWS] + [1, 3, 5, 7, 999999, 123456789, -5]
    got = _one(spark, S.budget_from_limit("m"), [(v,) for v in limits] + [(None,)], "m long")
    assert got == [int(v * 0.8) if v > 0 else 32000 for v in limits] + [32000]


def test_prefix_match_is_literal(spark):
    ids = ["ab%d0000-1111-4222-a333-444455556666", "ab_d0000-1111-4222-a333-444455556666",
           "abcd0000-1111-4222-a333-444455556666", "ABCD0000-1111-4222-a333-444455556666"]
    cat = spark.createDataFrame([(i, "/p", "h", 1, "s", "short", "m", dt.datetime(2026, 1, 1), 1, 1, 1)
                                 for i in ids], STORE_SCHEMA)
    p = spark.createDataFrame([("ab%",), ("ab_",), ("abc",), ("ab",), ("ABC",)], "prefix string")
    got = {r.prefix: (r.match_count, r.matched_id) for r in C.resolve_prefixes(cat, p).collect()}
    assert got == {"ab%": (1, ids[0]), "ab_": (1, ids[1]), "abc": (1, ids[2]), "ab": (3, None), "ABC": (1, ids[3])}


CLASS_CASES = [("ConfigError", "load", "config", 2), ("ConfigurationError", None, "config", 2),
               # inside the pipeline the stage decides
               ("ConfigError", "summarize", "summarize", 1), ("ConfigurationError", "extract", "extract", 1),
               ("SummarizationError", "extract", "extract", 1), ("ExtractionError", "summarize", "summarize", 1),
               ("SinkError", "sink", "sink", 1), ("PackageError", "source", "source", 1),
               ("TimeoutError", "summarize", "summarize", 1), ("UnicodeDecodeError", "extract", "extract", 1),
               ("FileNotFoundError", "source", "source", 1), ("Weird", "elsewhere", "other", 1)]


def test_failure_classification_table(spark):
    df = spark.createDataFrame([("/x", st, ec, "m") for ec, st, _, _ in CLASS_CASES],
                               "pdf_path string, stage string, error_class string, message string")
    got = [(r.category, r.severity) for r in ST.classify_failures(df).collect()]
    assert got == [(c, s) for _, _, c, s in CLASS_CASES]


def test_default_length_variants(spark):
    got = _one(spark, S.resolve_length("l"), [(None,), ("",), ("short",), ("detailed",), ("odd",)], "l string")
    assert got == ["standard", "standard", "short", "detailed", "odd"]
    got2 = _one(spark, S.resolve_length("l", "short"), [(None,), ("",)], "l string")
    assert got2 == ["short", "short"]


def test_prefix_summary_default_length(spark):
    d = ST.PrefixSummarizer("m")("x" * 40, None)
    assert d.summary == "[digest length=standard] " + "x" * 30 + "..." and (d.tokens_in, d.tokens_out) == (100, 50)
    got = _one(spark, ST.prefix_summary("t", "l", "m")["summary"], [("x" * 40, None)], "t string, l string")
    assert got == [d.summary]


def test_chunk_text_helpers_keep_whole_text(spark):
    text = "αβγ" * 1000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = ST.split_chunks(df, 7).orderBy("chunk_no").select("chunk").collect()
    assert "".join(r.chunk for r in chunks) == text
    assert ST.split_chunks(df, F.lit(3000)).count() == 1
