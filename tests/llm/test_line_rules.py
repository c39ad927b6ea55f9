"""Operator 11 against a plain Python version, and its rules on hand-made lines."""
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusbrief.llm import line_rules as L
from corpusbrief.llm.common import prep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def settings(spark):
    prep(spark)


def brute(text, max_lost=40):
    t = text or ""
    w = WORD.findall(t)
    seen, hit = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(5)}
    lines, dup, lost, clean, removed = set(), 0, 0, [], []
    for no, x in enumerate(t.split("\n")):
        v = WORD.findall(x)
        count = lambda s: sum(c in s for c in x)  # noqa: E731,B023
        rule = None
        if v:
            dup += x in lines
            lines.add(x)
            if count(L.SEPARATORS) >= 3 and len(v) <= 5 * count(L.SEPARATORS):
                rule = "navigation"
            elif 10 * count(L.SYMBOLS) > len("".join(v)) or (count("!?") >= 3 and 2 * count("!?") > len(v)):
                rule = "punctuation"
            elif len(v) <= L.BOILER_WORDS and re.search(L.BOILER, x):
                rule = "boilerplate"
        if rule:
            removed.append((no, rule))
            lost += len(v)
        else:
            clean.append(x)
    bad = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), len("".join(w)), sum(c in L.BASE_SYMBOLS for c in t), dup, len(hit), bad,
            not bad and 100 * lost <= max_lost * len(w), None if text is None else "\n".join(clean), removed)


def rows(spark, texts):
    schema = "doc_id long, text string, c0 string, _m string, clean string, kept string, n_words string"
    return spark.createDataFrame([(i % 5, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)], schema).repartition(3)


def outcome(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.clean,
             [tuple(x) for x in r.removed]) for r in df.collect()]


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = "alpha beta gamma é 漢字 x\U0001F600 a#b | ! ?! *** » Home, end. &&&".split()
    line = lambda: " ".join(rng.choice(vocab[:5] if rng.random() < 0.6 else vocab) for _ in range(rng.randrange(0, 14)))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    texts += [None, "", " \n\t\x0b ", "one", "a b c d e a b c d e f", "x " * 4000, "same line here\n" * 300,
              " ".join(map(str, range(60_000))), " ".join(map(str, range(30_000))) + " 1 2 3 4 5\r\n", "x" * 400_000,
              "All rights reserved.", "(Read more)", "Unread more words are no furniture of a page at all, it seems to me now.",
              "Copyright © him " + "word " * 30, "\xa0  a\x85b \x1c c"]
    texts += texts[-6:] * 2
    got = outcome(L.clean_lines(rows(spark, texts)).orderBy("c0"))
    assert sorted(map(repr, got)) == sorted(repr(brute(t)) for t in texts)


def test_rules_take_their_lines_and_leave_prose(spark):
    prose = "The council met on Monday, and after two hours it agreed to nothing at all."
    cases = {"navigation": "Home | News | Sport | About us | Contact", "punctuation": "WIN!! NOW!! HERE!!",
             "boilerplate": "Please accept cookies to go on."}
    texts = [f"{prose}\n{x}\n{prose[:-1]} again." for x in cases.values()] + [prose + " Costs rose by 5% (3 of 10), he said!"]
    got = L.clean_lines(rows(spark, texts)).select("removed", "clean", "c1").collect()
    by = {r.c1: r for r in got}
    for text, rule in zip(texts, cases):
        assert [tuple(x) for x in by[text].removed] == [(1, rule)] and by[text].clean == f"{prose}\n{prose[:-1]} again."
    assert by[texts[-1]].removed == [] and by[texts[-1]].clean == texts[-1]


def test_documents_that_lose_too_much_are_rejected(spark):
    keep, bar = "one two three four five six seven eight nine ten eleven twelve", "a | b | c | d | e"
    texts = [f"{keep}\n{bar[:9]}", f"{keep}\n{bar}\nf | g | h | i | j\n", keep]
    got = {r.c1: r.kept for r in L.clean_lines(rows(spark, texts)).collect()}
    assert [got[t] for t in texts] == [True, False, True]
    assert {r.kept for r in L.clean_lines(rows(spark, texts), max_lost=70).collect()} == {True}


def test_empty_table_and_carried_columns(spark):
    none = L.clean_lines(rows(spark, ["a"]).limit(0))
    assert none.count() == 0 and none.columns[:7] == [f"c{i}" for i in range(7)]
    r = L.clean_lines(rows(spark, ["a b"])).first()
    assert (r.c2, r.c3, r.c4, r.c5, r.c6) == ("a", "b", "c", "d", "e")


def test_main_path_is_native(spark):
    plan = L.clean_lines(rows(spark, ["a"]).select(F.col("doc_id"), F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
