"""Operator 13 against both tokenizers and a plain Python alignment."""
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusbrief.llm import token_align as T
from corpusbrief.llm.common import prep

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(autouse=True)
def settings(spark):
    prep(spark)


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(models, text):
    """[(id, bytes)] of both sides, empty where a side's bytes are not a blank and the text."""
    if not text:
        return [], []
    a, b = models
    letters = T.byte_alphabet()
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
         for i in b.encode(text) for p in [b.id_to_piece(i)]]
    same = all(b"".join(v for _, v in side) == b" " + text.encode() for side in (x, y))
    return (x, y) if same else ([], [])


def brute(models, texts):
    docs, count = [], Counter()
    for t in texts:
        sides = []
        for side in tokens(models, t):
            at, out = 0, []
            for i, v in side:
                at += len(v)
                out.append((at, i))
            sides.append(out)
        ends = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
        links = [(x, y) for e in ends for f, x in sides[0] if f == e for g, y in sides[1] if g == e]
        groups = [[[str(i) for e, i in side if lo < e <= hi] for side in sides] for lo, hi in zip([0, *ends], ends)]
        docs.append((sides, links, ";".join(",".join(a) + "|" + ",".join(b) for a, b in groups)))
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(s[0]), len(s[1]), len(k), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for s, k, g in docs]


def write(spark, scratch, texts, ids=None):
    rows = [(i, t, "x", 1, "y") for i, t in zip(ids or range(len(texts)), texts)]
    spark.createDataFrame(rows, "doc_id long, text string, id string, row long, pairs string").repartition(3).write.parquet(f"{scratch}/documents.parquet")
    return scratch


def results(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


ODD = [None, "", " ", "  two", "tail \n\n", "a▁b", "<|endoftext|> <s> </s> <0x41>", "漢字かな ไทย \U0001F600", "\x00\x01 a", "ﬁ ½ ™",
       "don't I'LL we've 12345 ----", "ȺȾ aȺb", "x" * 3000]


def test_against_brute_force(spark, scratch, models, monkeypatch):
    rng = random.Random(13)
    vocab = "the nation ation tionally über Straße éèê naïve 1234 3.14 foo_bar (x) \t \n ... ñandú Ωmega привет".split(" ")
    texts = ODD + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(50)) for _ in range(30)] + texts[20:25] * 3
    got = results(T.op13_token_align(spark, write(spark, scratch, texts)))
    assert got == brute(models, texts)


def test_blocks_and_the_shuffle_join_give_the_same(spark, scratch, models, monkeypatch):
    texts = ["alpha beta the gamma " * 40, None, "gamma the beta▁", "the gamma", "beta " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aligned = T.materialize(T.align_tokens(rows, A, B), "test-aligned")
    monkeypatch.setattr(T, "broadcast_if_small", lambda df: df)
    sums = {r.row: (r.n_best, r.count_sum) for r in T.link_sums(aligned, T.pair_counts(aligned)).collect()}
    want = {t: w for t, w in zip(texts, brute(models, texts))}
    for r in aligned.join(rows, aligned.id == rows.doc_id).collect():
        assert sums.get(r.row, (0, 0)) == want[r.text][4:6]
    parts = [T.align([t or "" for t in texts[i:i + 1]], A, B) for i in range(len(texts))]
    whole = T.align([t or "" for t in texts], A, B)
    assert [p[3][0] for p in parts] == whole[3] and [int(p[2][0]) for p in parts] == whole[2].tolist()


def test_a_very_long_text_is_read_whole(spark, models):
    text = " ".join(f"word{i % 977}" for i in range(300_000))  # over BLOCK
    r = T.align_tokens(spark.createDataFrame([(None, text), (1, "short")], "doc_id long, text string").coalesce(1), A, B).collect()
    side_a, side_b = tokens(models, text)
    assert (r[0].id, r[0].n_a, r[0].n_b) == (None, len(side_a), len(side_b)) and len(text) > T.BLOCK
    assert r[1].groups == brute_groups(models, "short") and r[0].groups.count(";") == r[0].n_groups - 1


def brute_groups(models, text):
    a, b = tokens(models, text)
    assert b"".join(v for _, v in a) == b"".join(v for _, v in b)
    ends = [set(), set()]
    for side, e in zip((a, b), ends):
        at = 0
        for _, v in side:
            at += len(v)
            e.add(at)
    out, both = [], sorted(ends[0] & ends[1])
    for lo, hi in zip([0, *both], both):
        part = []
        for side in (a, b):
            at, ids = 0, []
            for i, v in side:
                at += len(v)
                if lo < at <= hi:
                    ids.append(str(i))
            part.append(",".join(ids))
        out.append("|".join(part))
    return ";".join(out)


def test_repeated_and_null_ids_and_an_empty_table(spark, scratch, models):
    texts = ["one two", "one two", "one two", "three"]
    got = T.op13_token_align(spark, write(spark, scratch, texts, [1, 1, None, None])).collect()
    want = brute(models, texts)
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in got) == sorted((i, w[0], w[5]) for i, w in zip([1, 1, 0, 0], want))
    empty = T.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert empty.count() == 0 and T.link_sums(empty, T.pair_counts(empty)).count() == 0


def test_plain_letters_are_cut_alike_by_both_libraries():
    (a, _), *_ = T._loaded(A, B)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x500), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    rng = random.Random(5)
    texts = [f"a{c}b {c}{c} 1{c}2 {c}x\n{c} '{c} !{c}!" for c in letters]
    texts += ["".join(rng.choice(letters) for _ in range(40)) for _ in range(500)]
    texts += [rng.choice(letters) * rng.randrange(1, 60) + rng.choice(["ab", "  ", "\n\n", " the "]) for _ in range(500)]
    assert all(T.PLAIN.fullmatch(t) for t in texts)
    whole = [e.ids for e in a.whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert a.encode(texts) == whole
