"""Every operator against a brute-force version on small tables with NULLs, empty and long texts, ties,
repeated rows, no rows and extra columns."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from corpusbrief.llm import (decontam_automaton, langid_bloom, line_dedup, packing_mt, pii_weak, simhash_golay,
                             suffix_levels, url_digest, vector_range, warc_zstd)
from corpusbrief.llm.common import prep
from corpusbrief.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, n_chars long, id string, key long, n long, fp string"


@pytest.fixture(autouse=True)
def settings(spark):
    prep(spark)


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None if t is None else len(t), "x", 7, 8, "y") for i, t in zip(ids, texts)], DOCS).repartition(3)


def words(rng, n, vocab="alpha beta gamma delta epsilon zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(vocab) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "É", "ÀÉ ß 漢字 " * 3, "x" * 5000]


# ---------------------------------------------------------------- 1

def brute_hits(text, items, window=10):
    rx, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}
    w, hit, found = rx.findall((text or "").translate(low)), set(), set()
    for item, t in items:
        v = rx.findall((t or "").translate(low))
        size = min(window, len(v))
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found |= {item} - {None}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block, piece", [(16 << 20, 20_000), (300, 20_000), (300, 12), (16 << 20, 3)])
def test_decontamination_brute_force(spark, block, piece):
    rng = random.Random(1)
    items = [(str(i), words(rng, rng.choice([1, 3, 9, 10, 11, 25]), "alpha beta gamma 漢字 É9".split()) + "!") for i in range(12)]
    items += [(None, "Zeta eta THETA"), ("n", None), ("e", "..."), ("0", items[0][1])]
    texts = ODD + [words(rng, 60, "alpha beta gamma 漢字 É9 other".split()) for _ in range(30)] + ["zeta, eta; theta."] * 2
    got = decontam_automaton.find_items(docs(spark, texts), spark.createDataFrame(items, "item_id string, text string"),
                                        block_bytes=block, piece_words=piece)
    got = {r.doc_id: (r._words, sum(s.end - s.start for s in r._spans), r._items) for r in got.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_cuts_spans_and_keeps_clean_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = ["Clean text stays. " * 5, f"Before it, {passage.title()}! And a good deal more text after it than there was in the item itself.", passage, None]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam_automaton.decontaminate(docs(spark, texts), items).collect()}
    assert set(got) == {0, 1, 3} and got[0] == texts[0] and got[3] is None
    assert got[1] == "Before it, ! And a good deal more text after it than there was in the item itself."
    assert decontam_automaton.decontaminate(docs(spark, []), items).count() == 0
    assert decontam_automaton.decontaminate(docs(spark, texts), items.limit(0)).count() == 4


def test_repeated_and_long_items_do_not_widen_a_block(spark):
    rng = random.Random(11)
    long = words(rng, 400)
    items = spark.createDataFrame([("same", long)] * 50 + [("long", long + " omega")], "item_id string, text string")
    pieces = decontam_automaton._item_pieces(items, "item_id", "text", 10, 40)
    blocks = list(decontam_automaton._item_blocks(pieces, 600))
    assert len(blocks) > 5 and max(sum(len(w) + 1 for _, t in b for w in t) for b in blocks) < 4000
    held = Counter((i, tuple(t[k:k + 10])) for b in blocks for i, t in b for k in range(len(t) - 9))
    w = (long + " omega").encode().split()
    assert set(held) == {("same", tuple(w[k:k + 10])) for k in range(391)} | {("long", tuple(w[k:k + 10])) for k in range(392)}


def test_decontamination_keeps_a_workers_automaton_only_for_its_block():
    a = decontam_automaton._automaton("a", [("1", [b"x", b"y"])], 10)
    assert decontam_automaton._automaton("a", [], 10) is a
    assert decontam_automaton._automaton("b", [], 10) is not a and list(decontam_automaton._LAST) == ["b"]


# ---------------------------------------------------------------- 2

def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 700_000, "x" * 700_000, "<p>é</p>", "y"]
    ids = [5, 3, 9, 4, 10, 11, None, 9]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: 1" if i != 4 else None, h, 1, "c") for i, h in zip(ids, html)],
                                  "page_id long, url string, html string, first long, sha string").repartition(2)
    bundles = warc_zstd.write_bundles(pages, bundle_bytes=800_000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zstd.read_records(bundles).collect())
    want = Counter()
    for i, h in zip(ids, html):
        p = (h or "").encode()
        first = min([j for j, g in zip(ids, html) if (g or "") == (h or "") and j is not None])
        kind = ("response", None) if i == first else ("revisit", first)
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *kind)] += 1
    assert got == want
    one = warc_zstd.read_records(bundles, spark.createDataFrame([("<urn:page:10>",)], "record string")).collect()
    assert [(r.page_id, r.payload, r.url) for r in one] == [(10, b"x" * 700_000, "http://a/10%0D%0AX: 1")]
    assert warc_zstd.read_records(warc_zstd.write_bundles(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- 3

def brute_suffix(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup_brute_force(spark):
    rng = random.Random(3)
    base = [words(rng, 80) for _ in range(6)]
    common = words(rng, 40)  # in very many documents, with other neighbours each: a hot anchor
    texts = ODD + base + [base[0], base[1][:250] + "!" + base[1][250:], "x" * 350, base[2][40:300] * 2]
    texts += [f"{rng.random()} {common} {rng.random()}" for _ in range(400)] + [words(rng, 300, ["aé", "b漢"]) for _ in range(5)]
    got = suffix_levels.dedup_substrings(docs(spark, texts).repartition(5)).collect()
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


def test_suffix_dedup_repeated_ids_and_no_rows(spark):
    t = words(random.Random(4), 60)
    got = suffix_levels.dedup_substrings(docs(spark, [t, t, t + " z"], [1, 1, None])).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, len(t) + 2]
    assert suffix_levels.dedup_substrings(docs(spark, [])).count() == 0


def test_suffix_dedup_does_not_depend_on_how_later_passes_split_the_files(spark, scratch, monkeypatch):
    rng = random.Random(13)
    common = words(rng, 40)
    texts = [words(rng, 60)] * 3 + [f"{rng.random()} {common} {rng.random()}" for _ in range(60)]
    docs(spark, texts).repartition(8, "doc_id").write.parquet(f"{scratch}/docs")
    write = suffix_levels.materialize

    def split(tasks):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", tasks)

    def then_split(*args):
        out = write(*args)
        split("100")
        return out

    monkeypatch.setattr(suffix_levels, "materialize", then_split)
    try:
        split("1")
        got = suffix_levels.dedup_substrings(spark.read.parquet(f"{scratch}/docs")).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


# ---------------------------------------------------------------- 4

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def fine(k, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if k == "ip" else True,
                "card": 12 <= len(d) <= 19 and pii_weak.luhn(d), "phone": 9 <= len(d) <= 15}[k]
    return sorted((m.start(), list(PII).index(k), m.end(), k) for k, p in PII.items() for m in re.finditer(p, t) if fine(k, m.group()))


def test_pii_base_patterns_brute_force():
    rng = random.Random(5)
    parts = ["a.b", "@", "x-y.com", "c@d.e", "1.2.3.4", "300.1.1.1", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100",
             "+", "12", " ", ".", "é", "@@", "1.2.3.4.5.6.7.8", "+49 30 1234567", "\n", "-", "5", "(", ")"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [(s, list(PII).index(k), e, k) for s, e, k in pii_weak.base_spans(t)] == brute_pii(t), t


def test_pii_whole_tables_and_linear_time(spark):
    texts = ODD + ["mail bob@example.com or call 212-555-0100", "bob [at] example [dot] com", "a" * 300_000 + "@ ", "1" * 300_000, "+1" + " " * 300_000]
    texts += [f"phone +1 (212) 555-01{i:02d}, mail u{i}@mail.example.org, ip 10.0.0.{i}" for i in range(40)]
    table = docs(spark, texts)
    model = pii_weak.learn(table)
    got = {r.id: r for r in pii_weak.find(table, model).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_pii(t)) if t and len(t) < 10_000 else got[i].base
        assert got[i].base == base and set(base.split(",")) <= set(got[i].spans.split(",")) | {""}
    assert pii_weak.mask("x bob@a.de y", [(2, 10, "email")]) == "x [EMAIL] y"
    assert pii_weak.find(docs(spark, []), pii_weak.learn(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- 5

def test_language_id_held_out_accuracy_and_odd_rows(spark):
    from tests.conftest import SF

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid_bloom.learn(d)
    got = langid_bloom.predict(d, model).join(d, langid_bloom.F.col("id") == d.doc_id).where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    odd = {r.id: (r.lang_pred, r.score) for r in langid_bloom.predict(docs(spark, ODD), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and all(0 <= s <= 1 and x in {*model.langs, "und"} for x, s in odd.values())
    for r in langid_bloom.predict(docs(spark, ["a"] * 20), model).collect():
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1)
    many = spark.createDataFrame([(i, f"wort{i} text", f"l{i % 70:02d}") for i in range(210)], "doc_id long, text string, lang string")
    assert langid_bloom.learn(many, max_langs=66).langs == sorted(r.lang for r in many.where(langid_bloom._rest("doc_id") != 1).groupBy(
        "lang").count().orderBy(langid_bloom.F.desc("count"), "lang").limit(66).collect())
    empty = langid_bloom.learn(docs(spark, ["a"]))
    assert langid_bloom.predict(docs(spark, ["abc"], [None]), empty).collect()[0][1:] == (False, "und", 0.0)


def brute_sets(rows, least=2, share=0.004):
    """Per language the byte 5-grams of enough of its documents, as plain sets; (id, text, lang) that may be learned from."""
    used = [(t, la) for i, t, la in rows if i is not None and t is not None and la is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    size = Counter(la for _, la in used)
    n = {la: Counter() for la in size}
    for t, la in used:
        n[la].update(brute_grams(t, set))
    return {la: {g for g, k in n[la].items() if k >= max(least, -(-share * size[la] // 1))} for la in sorted(size)}


def brute_grams(t, kind=list):
    w = re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower()) if re.search(r"[^\W\d_]", t or "") else []
    b = f" {' '.join(w)} ".encode() if w else b""
    return kind(b[i:i + 5] for i in range(len(b) - 4))


def brute_score(t, sets):
    g = brute_grams(t)
    hits = {la: sum(x in s for x in g) for la, s in sets.items()}
    if not re.search(r"[^\W\d_]", t or ""):
        return "und", 0.0, 0
    return max(hits, key=lambda la: hits[la]), max(hits.values()) / max(1, sum(hits.values())), len(g)


def test_language_scores_against_plain_sets(spark):
    from tests.conftest import SF

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in d.collect()]
    sets = brute_sets(rows)
    model = langid_bloom.learn(d)
    # a filter says yes to all n-grams of its language and to few others
    g = np.unique(langid_bloom.grams(b" ".join(langid_bloom.normalise(t) for _, t, _ in rows)))
    mask = model.masks(g)[0]
    for k, la in enumerate(model.langs):
        yes = {int(x).to_bytes(8, "little")[:5] for x, m in zip(g, mask) if m >> np.uint64(k) & np.uint64(1)}
        assert len(sets[la]) <= 20_000 and sets[la] <= yes and len(yes - sets[la]) <= 0.01 * len(g), la
    got = {r.id: r for r in langid_bloom.predict(d, model).collect()}
    for i, t, _ in rows:
        la, s, _ = brute_score(t, sets)
        assert abs(got[i].score - s) < 0.03 and (got[i].lang_pred == la or s < 0.55), (i, t[:50])
    long = "\n".join(t for _, t, la in rows if la == "fr" and t) * 45
    assert len(langid_bloom.normalise(long)) > 2 << 20  # read in pieces
    assert abs(model.predict([long])[1][0] - brute_score(long, sets)[1]) < 0.03 and model.predict([long])[0] == ["fr"]


def test_language_is_rejected_by_one_rule_at_every_length():
    assert not langid_bloom.accepts("und", 1.0, 500) and langid_bloom.accepts("de", 0.0, 0) and langid_bloom.accepts("de", 0.0, 11)
    least = [min(s for s in range(101) if langid_bloom.accepts("de", s / 100, n)) for n in range(1, 5000)]
    assert least == sorted(least) and least[10] == 0 and least[198] == 23 and least[-1] == 29


# ---------------------------------------------------------------- 6

def brute_fp(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(6)
    base = [words(rng, 200) for _ in range(8)]
    texts = ODD + base + [b.replace("beta", "Beta", 3) for b in base] + [b + " tail" for b in base] + ["", "a b c"]
    ids = [*range(100, 100 + len(texts) - 2), None, 5]
    got = simhash_golay.simhash_components(docs(spark, texts, ids)).collect()
    assert Counter((r.id, r.fp % 2**64) for r in got) == Counter((i, brute_fp(t)) for i, t in zip(ids, texts))
    assert {r.component_id for r in got if r.fp == 0} == {100}
    assert simhash_golay.simhash_components(docs(spark, [])).count() == 0
    kept = simhash_golay.stage(spark, docs(spark, ["same text here now"] * 3 + ["another one"], [4, 4, None, 9]), "")
    assert sorted((r.text for r in kept.collect())) == ["another one", "same text here now"]


def test_golay_keys_find_every_pair_within_four_bits():
    rng = np.random.default_rng(7)
    code = simhash_golay.Golay()
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for c in centre for _ in range(6)]
    fp = np.unique(np.concatenate([centre, np.array(near, np.uint64)]))
    x, y = simhash_golay.partition_links(*simhash_golay.keys_of(fp, code), 4)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    a, b = simhash_golay.local_components(fp[i], fp[j])
    want = {n: r for n, r in zip(a.tolist(), b.tolist())}
    found = dict(zip(x.tolist(), y.tolist()))
    assert all(found.get(n, n) == r for n, r in want.items())
    cluster = np.unique(np.array([int(centre[0]) ^ (1 << int(p)) ^ (1 << int(q)) for p in range(20) for q in range(20)], np.uint64))
    cluster = np.concatenate([cluster, [centre[0] ^ np.uint64(0xFFFF << 40)]])
    a, b = simhash_golay.bucket_links(cluster, 4)
    assert len(set(simhash_golay.local_components(a, b)[1].tolist())) == 2


def brute_components(fp):
    pairs = [(i + a, b) for i in range(0, len(fp), 512)
             for a, b in np.argwhere(np.bitwise_count(fp[i:i + 512, None] ^ fp[None, :]) <= 4).tolist()]
    a, b = np.array(pairs).T
    return simhash_golay.local_components(fp[a], fp[b])


def test_a_hot_key_is_passed_on_in_finer_keys_with_the_same_links(monkeypatch):
    rng = np.random.default_rng(17)
    ball = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(1500)]
    far = (rng.integers(0, 2**63, 1500, dtype=np.uint64) & ~np.uint64((1 << 22) - 1)).tolist()  # one raw segment
    fp = np.unique(np.array(ball + far + [f ^ (1 << 30) ^ (1 << 50) for f in far[:400]], np.uint64))
    want = dict(zip(*(x.tolist() for x in brute_components(fp))))
    whole, most = simhash_golay.partition_links, []

    def watched(key, f, d):
        if len(key):
            most.append(int(np.unique(key, return_counts=True)[1].max()))
        return whole(key, f, d)

    monkeypatch.setattr(simhash_golay, "partition_links", watched)
    key, f = simhash_golay.keys_of(fp, simhash_golay.Golay())
    mask, a, b, levels = simhash_golay.segment_mask(key), [], [], 0
    assert np.unique(key, return_counts=True)[1].max() > 1500
    while len(key):
        order = np.argsort(key, kind="stable")
        rows, parts = (key[order], mask[order], f[order]), []
        for kind, *out in simhash_golay.stream_links((tuple(c[i:i + 50] for c in rows) for i in range(0, len(key), 50)), 4, 100, 5000):
            if kind == "link":
                a.append(out[0])
                b.append(out[1])
            else:
                parts.append(out)
        key, mask, f = (np.concatenate(c) for c in zip(*parts)) if parts else (rows[0][:0],) * 3
        levels += 1
    assert levels > 2 and max(most) <= 150  # the bucket and one batch
    got = dict(zip(*(x.tolist() for x in simhash_golay.local_components(np.concatenate(a), np.concatenate(b)))))
    assert {n: got.get(n, n) for n in want} == want
    assert [list(map(len, x[1:])) for x in simhash_golay.stream_links([], 4, 100)] == [[0, 0]]


def test_fifty_thousand_fingerprints_on_one_key(spark):
    rng = np.random.default_rng(18)
    far = (rng.integers(0, 2**63, 40_000, dtype=np.uint64) & ~np.uint64((1 << 22) - 1)).tolist()
    near = [f ^ sum(1 << int(b) for b in rng.choice(42, 4, replace=False) + 22) for f in far[:5000]]
    chain = [f ^ (1 << 62) ^ (1 << 23) for f in near]
    fp = np.unique(np.array(far + near + chain, np.uint64))
    want = dict(zip(*(x.tolist() for x in brute_components(fp))))
    prep(spark)
    rows = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    links = simhash_golay.link_forest(rows, bucket=4096).toPandas().to_numpy().view(np.uint64)
    got = dict(zip(*(x.tolist() for x in simhash_golay.local_components(links[:, 0], links[:, 1]))))
    assert {n: got.get(n, n) for n in want} == want


def test_simhash_component_ids_against_all_pairs(spark):
    rng = random.Random(19)
    base = [words(rng, 120) for _ in range(30)]
    texts = [t for b in base for t in (b, b.replace("a", "A"), b + " x", b[:-30], " ".join(b.split()[::-1]))] + ["", None, " "]
    ids = list(range(7, 7 + len(texts)))
    rng.shuffle(ids)
    fp = [brute_fp(t) for t in texts]
    root = dict(zip(ids, ids))
    for _ in ids:  # the smallest id spreads along the links until nothing changes
        new = {i: min(root[j] for j, g in zip(ids, fp) if (f ^ g).bit_count() <= 4) for i, f in zip(ids, fp)}
        if new == root:
            break
        root = new
    got = {r.id: r.component_id for r in simhash_golay.simhash_components(docs(spark, texts, ids)).collect()}
    assert got == root and 1 < len(set(root.values())) < len(ids)


# ---------------------------------------------------------------- 7

def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x", "https://example.net/fr/x", "http://example.net", "http://net/", "http://xnet/a", "ftp://b.org/fr/?q=/", "http://org/fr",
            "http://q.example.com/de/1#z", "no scheme/net/", None, "", "http://example.com?x=/de/", "://net/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    for block in (64 << 20, 1):
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_digest.filter_urls(pages, list(url_digest.RULES), block_bytes=block).collect()}
        assert [got[i][2] for i in range(len(urls))] == ["example.net/en/", "net/", None, "net/", None, "org/fr/", None, "example.com/de/", None, None, None, None, "net/"]
        assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[9] == ("", "", None, "allow")
    assert url_digest.filter_urls(pages.limit(0), []).count() == 0


# ---------------------------------------------------------------- 8

@pytest.mark.parametrize("cell, pivots", [(10, 20_000), (1, 20_000), (1, 40), (1000, 20_000)])
def test_vector_range_brute_force(spark, cell, pivots):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 8))
    x = [(c + rng.normal(scale=0.05, size=8)).tolist() for c in centre for _ in range(25)] + rng.normal(size=(60, 8)).tolist()
    rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(900, x[0], 0), (901, x[0], 0), (902, [2 * c for c in x[0]], 0), (903, x[0], None)]
    rows += [(904, None, 0), (905, [0.0] * 8, 0), (906, [float("nan")] + x[0][1:], 0), (907, [None] + x[0][1:], 0), (908, [], 0), (909, x[0][:4], 0), (910, [float("inf")] * 8, 0)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node long, n_links long").repartition(3)
    got = {r.vec_id: r for r in vector_range.near_vectors(table, cell_rows=cell, max_pivots=pivots).collect()}
    ok = [(i, np.float32(v).astype(float), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, b in ok if j != i and la == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, v, la in ok}
    for i, v, la in rows:
        assert got[i].n_links == len(links.get(i, ()))
        reach, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert got[i].component_id == min(reach) and got[i].kept == (i == min(reach))
    assert vector_range.near_vectors(table.limit(0)).count() == 0


def test_vectors_of_a_label_each_draw_no_pivot_and_do_not_mix(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 4))
    rows = [(100 * c + i, x[i].tolist(), f"{i}/a//b") for c in range(2) for i in range(40)] + [(900 + i, x[0].tolist(), f"{i}") for i in range(40)]
    got = vector_range.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), cell_rows=1).collect()
    assert all(r.n_links == (r.vec_id < 900) and r.component_id == (r.vec_id % 100 if r.vec_id < 900 else r.vec_id) for r in got) and len(got) == 120


# ---------------------------------------------------------------- 9

def test_packing_is_gapless_and_the_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = ODD + ["It's <|endoftext|> 9²½ don't!!", "İstanbul é \x1f a b ΑΣ", "!" * 400, words(rng, 9000)] + [words(rng, rng.randint(1, 900)) for _ in range(60)]
    got = packing_mt.pack_documents(docs(spark, texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096))
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s:s + 4096].tobytes()) for s in own.start]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert packing_mt.pack_documents(docs(spark, [])).count() == 0


def test_every_character_inside_a_word_gets_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing_mt.WordIds(path)
    plain = [c for c in map(chr, range(0xD800)) if packing_mt.PLAIN.fullmatch(c)]
    assert len(plain) > 600
    for c in {*plain, "\u023a", "\u023e"}:
        for t in (f"a{c}b", f"{c}b", f"a{c}", f"A{c}{c}B"):
            assert own.ids([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def best_bins(sizes, capacity):
    """The fewest bins, by search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                k = bins.index(room)
                go(i + 1, bins[:k] + [room - sizes[i]] + bins[k + 1:])
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = random.Random(10)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        plan = packing_mt.Plan(Counter(sizes), 20)
        plan.reduce()
        rest = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + (best_bins(rest, 20) if rest else 0) == best_bins(sizes, 20), sizes
        plan.best_fit()
        fill = Counter()
        for length, _, n, first, each, offset in plan.rows:
            for k in range(n):
                fill[first + k // each] += length
        assert max(fill.values()) <= 20 and len(fill) == plan.sequences and sum(fill.values()) == sum(sizes)


# ---------------------------------------------------------------- 10

def brute_passages(texts, marks=".!?,;:", full="。！？，；：、", blanks=" \t\r\f\v", least=100):
    """(units, removed units, spans, kept) per text, characters walked one by one."""
    seen, out = set(), []
    for t in texts:
        cuts, k = [], 0
        while k < len(t or ""):
            e = k
            while e < len(t) and t[e] in marks:
                e += 1
            f = e
            while e > k and f < len(t) and t[f] in blanks:
                f += 1
            if f > e:
                k = f
            elif t[k] in full:
                while k < len(t) and t[k] in full:
                    k += 1
            elif t[k] == "\n":
                k += 1
            else:
                k = max(e, k + 1)
                continue
            cuts.append(k)
        units, last = [], 0
        for e in [*cuts, len(t or "")]:
            u = " ".join(re.findall(r"[^ \t\n\x0b\f\r]+", (t or "")[last:e].translate({c: c + 32 for c in range(65, 91)})))
            if u:
                units.append((last, u))
            last = e
        starts, gone = [s for s, _ in units] + [len(t or "")], set()
        for i in range(len(units)):
            j = next((j for j in range(i + 1, len(units) + 1) if len(" ".join(u for _, u in units[i:j])) >= least), None)
            if j is None:
                break
            if (p := " ".join(u for _, u in units[i:j])) in seen:
                gone |= set(range(i, j))
            seen.add(p)
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == starts[i]:
                spans[-1] = (spans[-1][0], starts[i + 1])
            else:
                spans.append((starts[i], starts[i + 1]))
        kept = t if t is None else "".join(c for k, c in enumerate(t) if not any(s <= k < e for s, e in spans))
        out.append((len(units), len(gone), spans, kept))
    return out


def deduped(df):
    return {r.id: (r.n_units, r.n_removed, [tuple(x) for x in r.removed], r.kept) for r in df.collect()}


def test_line_dedup_brute_force(spark):
    rng = random.Random(11)
    lines = [words(rng, n) + end for n in (1, 4, 8, 12, 30) for end in (".", ", ", "?! ", "")] + ["", "  ", "ÉÉ a b c d", "漢字かな。" * 30, "x" * 120]
    texts = ODD + ["\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines) + rng.choice(["", " ", "\r"])
                             for _ in range(rng.randint(1, 12))) for _ in range(60)]
    passage = words(rng, 60, "red, blue; green. white black: grey! pink".split())
    texts += [f"{rng.random()} {words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(4)] + [texts[20]] * 2  # inside one long line
    got = deduped(line_dedup.dedup_units(docs(spark, texts)))
    assert [got[i] for i in range(len(texts))] == brute_passages(texts)
    assert all(got[i][1] > 0 for i in range(len(texts) - 5, len(texts) - 2))


def test_line_dedup_of_lines_paragraphs_and_no_rows(spark):
    assert line_dedup.dedup_units(docs(spark, [])).count() == 0
    texts = ["a b c d e\nf\n\ng", "A b  c d e f\n \nh", "F\nz\n"]
    para = deduped(line_dedup.dedup_units(docs(spark, texts), unit="paragraph", min_chars=1))
    assert {i: r[3] for i, r in para.items()} == {0: texts[0], 1: "h", 2: texts[2]}
    lines = deduped(line_dedup.dedup_units(docs(spark, texts), unit="line", min_chars=1))
    assert {i: r[3] for i, r in lines.items()} == {0: texts[0], 1: texts[1], 2: "z\n"}


def test_line_dedup_null_and_repeated_ids(spark):
    t = words(random.Random(2), 40)
    got = line_dedup.dedup_units(docs(spark, [t, t, t + " z", t], [3, 3, None, None])).collect()
    # NULL ids come first, by text: t itself keeps its passage; nothing equals the longer line
    assert sorted((r.id or 0, len(r.kept)) for r in got) == [(0, len(t)), (0, len(t) + 2), (3, 0), (3, 0)]


def test_line_dedup_cuts_a_very_long_text_whole(spark):
    long = "".join(f"w{i}, " for i in range(line_dedup.BATCH + 20_000))
    tail = "".join(f"w{i}, " for i in range(line_dedup.BATCH, line_dedup.BATCH + 200))
    got = deduped(line_dedup.dedup_units(docs(spark, [long, "new " + tail, long])))
    assert got[0][1] == 0 and got[0][3] == long
    assert got[1][3] == "new w500000, " and got[1][1] == 199  # its first unit has another word
    assert got[2][3] == "" and got[2][1] == got[0][0] == line_dedup.BATCH + 20_000


# ---------------------------------------------------------------- components

def test_connected_components(spark):
    rng = random.Random(12)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long"), "a", "b").collect()}
    root = {n: n for e in links for n in e}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e for e in links if e[0] != e[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
