"""Operator 12 against a plain dynamic programme over whole conversations."""
import hashlib
import random
import zlib
from itertools import product

import pytest

from corpusbrief.llm import chat_repair as C
from corpusbrief.llm import edit_lattice as E
from corpusbrief.llm.common import prep

SCHEMA = "conv_id long, turn long, role string, text string, audit string, row long"
BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(autouse=True)
def settings(spark):
    prep(spark)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3)


def sorted_rows(rows):
    def key(r):
        _, turn, role, text = r
        return (turn is not None, turn or 0, role.encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    return sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=key)


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation's rows."""
    rows = sorted_rows(rows)
    seen, fault = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(BLANK)
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    ini = [r[:1] for _, _, r, _ in rows]
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def spread(ways):  # insertions: two at most can be of use
        for _ in range(2):
            for q, (c, a, out) in list(ways.items()):
                for r in "ua":
                    if r in step[q]:
                        n = step[q][r]
                        w = (c + 2, a + "I", out + [({"u": "user", "a": "assistant"}[r], "")])
                        ways[n] = min(ways.get(n, w), w, key=lambda x: x[:2])
        return ways

    ways = spread({"": (0, "", [])})
    for (_, _, role, text), f in zip(rows, fault):
        nxt = {}
        for q, (c, a, out) in ways.items():
            options = [(q, (c + 3, a + "D", out))]
            if f not in ("blank", "duplicate"):
                late = int(f == "truncated")
                if role[:1] in step[q]:
                    options.append((step[q][role[:1]], (c + late, a + "K", out + [(role, text)])))
                for r in "ua":
                    if r in step[q]:
                        options.append((step[q][r], (c + 2 + late, a + "R", out + [({"u": "user", "a": "assistant"}[r], text)])))
            for n, w in options:
                nxt[n] = min(nxt.get(n, w), w, key=lambda x: x[:2])
        ways = spread(nxt)
    cost, audit, out = min((w for q, w in ways.items() if q in ("", "a")), key=lambda x: x[:2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(x + y not in ("su", "ua", "au") for x, y in zip(ini, ini[1:])), cost, audit, "\n".join(f"{r}:{t}" for r, t in out))


def random_rows(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "u", "", None, "Sys", "ann"]
    texts = ["Yes.", "No!", "maybe", "", " \n", None, "Why?\n ", "so.) ", "é漢."]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(roles if rng.random() < 0.5 else roles[:3]),
             rng.choice(texts if rng.random() < 0.5 else [f"Line {rng.random()}."])) for _ in range(n)]


def outcome(conversations, block_rows=C.BLOCK_ROWS):
    rows, found = C.repair(conversations, block_rows)
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in C.digests(found, rows).collect()}


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        *head, text = brute([r for r in rows if r[0] == conv])
        out[conv] = (*head, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_rows", [1, 3, C.BLOCK_ROWS])
def test_against_brute_force(spark, block_rows):
    rng = random.Random(12)
    rows = [r for conv in [None, *range(70)] for r in random_rows(rng, conv, rng.randrange(1, 12))]
    assert outcome(table(spark, rows), block_rows) == want(rows)


def test_lattice_against_every_audit():
    """All audits of short blocks, by enumeration."""
    rng = random.Random(1)
    for rows in ["", *("".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 4))) for _ in range(60))]:
        found = {}
        for size in range(0, len(rows) + 4):
            for audit in product("DIKR", repeat=size):
                if sum(x != "I" for x in audit) != len(rows):
                    continue
                q, i, cost = 0, 0, 0
                for x in audit:
                    if x == "I":
                        q, cost = E.TURN[q], cost + 2
                        continue
                    s, i = rows[i], i + 1
                    late = int(s.isupper())
                    if x == "D":
                        cost += 3
                    elif s == "x" or x == "K" and s.lower() not in E.AFTER[q]:
                        break
                    else:
                        q, cost = (E.TURN[q], cost + 2 + late) if x == "R" else (E.AFTER[q][s.lower()], cost + late)
                else:
                    way = (cost, "".join(audit))
                    found[q] = min(found.get(q, way), way)
        for q in E.STATES:
            if q in found:
                assert E.cheapest(rows, 0, (q,)) == found[q], (rows, q)
        assert E.cheapest(rows, 0, E.ACCEPT) == min(found[q] for q in E.ACCEPT if q in found)


def test_a_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(3)
    rows = [r[:1] + (i,) + r[2:] for i, r in enumerate(random_rows(rng, 7, 3000))] + random_rows(rng, 8, 5) + random_rows(rng, 6, 5)
    blocks = C.solve(C.faults(C.turns(table(spark, rows))), 100)
    assert blocks.where("conv = 7").select("part").distinct().count() > 1 and blocks.where("conv = 7").count() > 25
    assert outcome(table(spark, rows), 100) == want(rows)


def test_long_texts_repeats_and_an_empty_table(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long + "end."), (1, 1, "assistant", long), (2, None, "system", "a."), (2, None, "system", "a."),
            (3, 0, "user", "Hi."), (3, 0, "user", "Hi."), (3, 0, "assistant", "Ho.")] + [(4, 5, "user", "copy")] * 3000
    got = outcome(table(spark, rows))
    assert got == want(rows) and got[4][2] == 2999
    assert outcome(table(spark, rows).limit(0)) == {}


def test_repaired_rows_are_the_digested_ones(spark):
    rng = random.Random(9)
    rows = [r for conv in [None, *range(30)] for r in random_rows(rng, conv, rng.randrange(1, 9))]
    text = {}
    for r in sorted(C.repaired_rows(table(spark, rows), 4).collect(), key=lambda r: r.place):
        text.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv in {r[0] for r in rows}:
        assert "\n".join(text.get(conv, [])) == brute([r for r in rows if r[0] == conv])[-1]


def test_query_damages_and_returns_every_conversation(spark, scratch):
    rng = random.Random(5)
    rows = [r[:1] + (i,) + r[2:] for conv in [None, *range(80)] for i, r in enumerate(random_rows(rng, conv, rng.randrange(1, 5)))]
    rows += [(90, None, "user", "a."), (None, None, "user", "b.")]
    table(spark, rows).write.parquet(f"{scratch}/conversations.parquet")
    after = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        after += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = C.op12_chat_repair(spark, scratch).collect()
    found, none = want(after), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: found.get(c, none) for c in {r[0] for r in rows}} and len(got) == len({r[0] for r in rows})
