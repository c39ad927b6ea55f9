"""O28 against a brute-force Python version of the same specification."""
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from corpusbrief.operators.extractive import BUDGETS, extractive_summary

from .conftest import SF


def brute(text: str, length: str) -> tuple[str, int]:
    budget = BUDGETS[length]
    ov = 3 if length == "short" else 1
    cap = budget - ov + 1
    marked = re.sub(r"([.!?])[ \t\n\r\f]+", "\\1\n", text)
    marked = re.sub(r"([。！？]+)[ \t\n\r\f]*", "\\1\n", marked)
    sents = []
    for s in re.split(r"\n+", marked):
        while len(s) > cap:  # too long: cut after the last blank that fits, else at the budget
            cut = s[:cap].rfind(" ") + 1 or cap
            sents.append(s[:cut])
            s = s[cut:]
        if s:
            sents.append(s)
    spaced = [regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ", s.lower()) for s in sents]
    words = [[w for w in regex.split(r"[^\p{L}\p{N}]+", s) if w] for s in spaced]
    tf = Counter(w for ws in words for w in ws)
    scores = [sum(tf[w] for w in ws) // len(ws) if ws else 0 for ws in words]
    kept, cum = [], 0
    for i in sorted(range(len(sents)), key=lambda i: (-scores[i], i)):
        cum += len(sents[i]) + ov
        if cum > budget + 1:
            break
        kept.append(i)
    prefix = "- " if length == "short" else ""
    return "\n".join(prefix + sents[i] for i in sorted(kept)), len(kept)


EDGE = [
    (1, ""),
    (2, "One sentence only"),
    (3, "Cats sit. Cats run!  Dogs sit?\nBirds fly.\n\n\nCats cats cats."),
    (4, "x" * 33000),
    (5, "日本語の文です。もう一つの文！最後の文？"),
    (6, "Emoji 😀 here. More 😀😀 text. 𝔘𝔫𝔦𝔠𝔬𝔡𝔢 letters."),
    (7, "... !!! ???"),
    (8, " ".join(f"Word{i} common common." for i in range(400))),
    (9, "Short one. " + " ".join(["rare"] * 50 + ["common"] * 400) + ". Common common. Another short one."),
    (10, "始めの文。" + "要約は大事な文を選ぶ。" * 300 + "終わりの文"),
    (11, "".join(f"w{i % 50}{'  ' if i % 7 == 0 else ' '}" for i in range(3000)) + "y" * 1200 + " tail. End."),
    (12, "漢字" * 1500 + " 。 x！？y"),
]


@pytest.mark.parametrize("spread", [0, 100, 1 << 20])  # all texts spread, some, none
@pytest.mark.parametrize("length", ["short", "standard", "detailed"])
def test_extractive_matches_brute_force_on_edges(spark, length, spread):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    got = {r.doc_id: (r.summary, r.n_sentences, r.summary_chars) for r in extractive_summary(df, length, spread_bytes=spread).collect()}
    assert set(got) == {i for i, _ in EDGE}
    for i, t in EDGE:
        want, n = brute(t, length)
        assert got[i][0] == want, (i, length)
        assert got[i][1] == n and got[i][2] == len(want) <= BUDGETS[length]


def test_extractive_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for length in ("short", "detailed"):
        got = {r.doc_id: r.summary for r in extractive_summary(docs, length).collect()}
        assert len(got) == len(texts)
        for i, t in texts.items():
            assert got[i] == brute(t, length)[0]


def test_per_row_length_and_carry(spark):
    df = spark.createDataFrame([(1, EDGE[2][1], "short", "/a"), (2, EDGE[7][1], "detailed", "/b"),
                                (3, "", "standard", "/c")],
                               "doc_id long, text string, length string, path string")
    got = {r.doc_id: r for r in extractive_summary(df, None, length_col="length", carry=["path"]).collect()}
    assert got[1].summary == brute(EDGE[2][1], "short")[0] and got[1].path == "/a"
    assert got[2].summary == brute(EDGE[7][1], "detailed")[0] and got[2].path == "/b"
    assert got[3].summary == "" and got[3].path == "/c" and got[3].length == "standard"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_the_row_and_only_long_texts_are_spread(spark, scratch):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(8).write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    one_task = spark.read.parquet(f"{SF}/documents.parquet")  # dealt out first: a scan of fewer tasks than cores
    assert "Exchange" in plan_of(extractive_summary(one_task, "short", spread_bytes=None))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        check_plans(docs)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def check_plans(docs):
    union = plan_of(extractive_summary(docs, "short")).split("Union", 1)[1]
    in_row, spread = union.split("Scan parquet", 1)
    assert "Exchange" not in in_row and "Window" not in in_row and "Generate" not in in_row
    assert "hashpartitioning(_id" in spread and "word" in spread.split("hashpartitioning(_id", 1)[1]
    q = extractive_summary(docs, "short")._jdf.queryExecution()
    assert "WindowGroupLimit" in q.optimizedPlan().toString()  # a partial top-K runs before sentences meet by document
    # one row's words are computed once, not once for each element of a lambda
    assert in_row.count("[^\\p{L}\\p{N}]+") == 1


def test_the_long_text_is_found_by_a_known_size(spark):
    rows = [(1, "A b. C d.", 10), (2, "E f. G h.", 5_000_000), (3, "I j.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes long")
    got = extractive_summary(df, "short", size_col="bytes")
    assert {r.doc_id: r.summary for r in got.collect()} == {i: brute(t, "short")[0] for i, t, _ in rows}
    assert "octet_length" not in plan_of(got)


@pytest.mark.parametrize("length", ["short", "detailed"])
def test_one_document_of_all_texts(spark, length):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    text = " ".join(r.text for r in docs.select("text").collect())
    got = extractive_summary(spark.createDataFrame([(None, text), (1, "A b. C d."), (2, None)], "doc_id long, text string"), length, partitions=5)
    got = {r.doc_id: (r.summary, r.n_sentences) for r in got.collect()}
    assert got == {None: brute(text, length), 1: brute("A b. C d.", length), 2: ("", 0)}


def test_carry_returns_columns_of_the_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.source for r in extractive_summary(docs, "standard", carry=["source"]).collect()}
    assert got == {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}


def test_null_and_blank_texts_keep_their_row(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "\n\n")], "doc_id long, text string")
    got = {r.doc_id: (r.summary, r.n_sentences) for r in extractive_summary(df, "short").collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("-    ", 1), 4: ("", 0)}
    assert got[3][0] == brute("   ", "short")[0]


def test_pieces_of_a_long_sentence_compete(spark):
    # the repeated words stand far behind the first budget of characters
    text = " ".join(f"u{i}" for i in range(2000)) + " " + "common " * 400
    got = extractive_summary(spark.createDataFrame([(1, text)], "doc_id long, text string"), "short").first()
    assert "common common" in got.summary and got.summary == brute(text, "short")[0]


def test_words_are_counted_as_arrays_of_numbers_and_not_by_lambdas(spark):
    # letters beyond ASCII, beyond the basic plane, of the scripts without blanks, and a sentence without words
    texts = ["Caf\u00e9 caf\u00c9 na\u00efve. Plain words, plain words! ... Na\u00efve x1 x\u0661.", "\u6771\u4eac tokyo \u6771. \u30ab\u306a kana\u3002End a\u6771b. a b",
             "\U00020000\U00020000 a. \U0001d400\U0001d400 b. \U0001f600 c c.", "\u0130I i\u0307. I\u0131 i.", "A\n\n\nB.\n A b\uff01c? d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = extractive_summary(df, "detailed", spread_bytes=None)
    plan = plan_of(q)
    assert "ArrowEvalPython" in plan and "sequence(" not in plan
    in_row = {r.doc_id: (r.summary, r.n_sentences) for r in q.collect()}
    spread = {r.doc_id: (r.summary, r.n_sentences) for r in extractive_summary(df, "detailed", spread_bytes=0).collect()}
    assert in_row == spread
    short = {r.doc_id: r.summary for r in extractive_summary(df, "short", spread_bytes=None).collect()}
    assert short == {r.doc_id: r.summary for r in extractive_summary(df, "short", spread_bytes=0).collect()}


def test_an_arrow_batch_of_word_arrays_is_bounded_by_bytes(spark):
    # 40 texts of 200 kB: counted in several batches, each row with its own words
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    try:
        df = spark.range(0, 40, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("Top "), F.repeat(F.concat(
            F.lit("w"), F.col("id"), F.lit(" ")), 40000), F.lit(". Other. "), F.lit("w"), F.col("id"), F.lit(".")).alias("text"))
        got = {r.doc_id: r.n_sentences for r in extractive_summary(df, "detailed", spread_bytes=None).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    texts = {i: f"Top {f'w{i} ' * 40000}. Other. w{i}." for i in range(40)}
    assert got == {i: brute(t, "detailed")[1] for i, t in texts.items()}


def test_words_are_cut_and_counted_by_blocks_of_rows(spark):
    # more rows in a task than are counted together, a block and more without a sentence, sentences without words at both ends
    odd = [None, "", "...", "\n\n", "... a a. !", "a。b a！？", "End", "É é. É", "x1 1x. 1 x", "!? " + "Zz zz. " * 90 + "zz"]
    texts = [None if i % 2 else "\n" for i in range(300)] + [odd[i % 10] if i % 3 else f"W{i} w{i}. A w{i} b. W{i + 1}? C." for i in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(4)
    q = extractive_summary(df, "short", spread_bytes=None)
    plan = plan_of(q)
    assert "ArrowEvalPython" in plan and "array_remove(" not in plan  # words are runs of bytes, not rows' arrays of strings
    got = {r.doc_id: (r.summary, r.n_sentences) for r in q.collect()}
    assert got == {i: brute(t or "", "short") for i, t in enumerate(texts)}
