"""Operator 12, conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

1. Rows are written once with a row number, the digest of (role, text) and what their text lacks.
2. Repeats: digests that occur twice in a conversation are reduced to their first row (partially aggregated) and
   joined back, so that neither a long conversation nor a group of copies lies in one task.
3. The narrow rows (no text) are range-sorted by conversation and turn.  A task reads them as they come and solves
   blocks of ``BLOCK_ROWS`` rows with :mod:`.edit_lattice` (bidirectional Dijkstra).  A conversation of one block in
   one task is whole; of a longer one, or one that crosses a task's border, each block has the cheapest ways between
   all states, which are joined per conversation afterwards.  So a conversation with a third of all rows is
   spread over as many tasks as it has ranges.
4. Audits meet the texts sorted by conversation and are applied row by row; no task holds a conversation's texts.
   (A digest of a whole conversation is read in order by one task: this is in the nature of a digest.)

Rows: rows are taken by turn (NULL first), equal turns by role, then by a digest of role and text; identical rows
are repeats of each other.  NULL roles and texts count as one blank.  A NULL conversation is one like any other;
an empty table gives an empty table; texts of any length are read whole; only the four columns are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import materialize
from .common import shuffle_partitions, table
from .edit_lattice import AFTER, ROLE, TURN, block_paths, push, whole

BLANKS = " \t\n\x0b\x0c\r"
BLOCK_ROWS = 4096
OUT_ROWS, OUT_BYTES = 2000, 4 << 20
LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
WAYS = "array<struct<first:int,last:int,cost:bigint,audit:string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of ``conv_id:turn`` decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return (rows.where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "row")]


def turns(conversations: DataFrame) -> DataFrame:
    """The rows, written: (conv, turn, role, text, digest, row, symbol, fault)."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    rows = rows.select("*", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
                       F.monotonically_increasing_id().alias("row"), F.substring("role", 1, 1).alias("initial"),
                       F.when(said == "", "blank").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").alias("lacks"))
    return materialize(rows, "turns")


def faults(rows: DataFrame) -> DataFrame:
    """The narrow rows (conv, turn, role, digest, row, initial, fault)."""
    twice = (rows.groupBy(F.struct("conv").alias("of"), F.col("digest").alias("same"))
             .agg(F.min(F.struct("turn", "row")).alias("f"), F.count("*").alias("n")).where("n > 1")
             .select("of", "same", F.col("f.row").alias("first")))
    both = rows.drop("text").join(twice, (F.struct("conv") == F.col("of")) & (F.col("digest") == F.col("same")), "left")
    fault = F.when(F.col("lacks") == "blank", "blank").when(F.col("row") != F.col("first"), "duplicate").otherwise(F.col("lacks"))
    return both.select("conv", "turn", "role", "digest", "row", "initial", fault.alias("fault"))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def solve(narrow: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, part, block, counts, first and last initial and turn, distinct turns, ways) of each block of rows."""
    spark, kind = narrow.sparkSession, narrow.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "block", *COUNTS, "initials", "first_turn", "last_turn", "n_turns", "ways"]
    schema = (f"conv {kind}, part int, block int, blank long, duplicate long, truncated long, illegal long, "
              f"initials array<string>, first_turn long, last_turn long, n_turns long, ways {WAYS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types, out = [], []
        held: list[tuple] = []  # (turn, initial, fault) of the block
        conv, block, opened = None, 0, False  # opened: an earlier conversation of this task has ended

        def close(ends: bool) -> tuple:
            symbols = ["x" if f in ("blank", "duplicate") else s if f is None else s.upper()
                       for _, i, f in held for s in [i if i in ("s", "u", "a") else "o"]]
            first = [i for _, i, _ in held]
            given = [t for t, _, _ in held if t is not None]
            ways = block_paths("".join(symbols), opened and block == 0, ends)
            return (conv, part, block, *[sum(f == c for _, _, f in held) for c in COUNTS[:3]],
                    sum(a + b not in LEGAL for a, b in zip(first, first[1:])), [first[0], first[-1]],
                    given[0] if given else None, given[-1] if given else None, len(set(given)),
                    [{"first": p, "last": q, "cost": c, "audit": a} for (p, q), (c, a) in ways.items()])

        for b in batches:
            if not types:
                way = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
                types = [b.schema.field(0).type, pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.string()),
                         *[pa.int64()] * 3, pa.list_(way)]
            for c, turn, initial, fault in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if held and c != conv:
                    out.append(close(True))
                    held, block, opened = [], 0, True
                elif len(held) >= block_rows:
                    out.append(close(False))
                    held, block = [], block + 1
                conv = c
                held.append((turn, initial, fault))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, names, types)
                    out = []
        if held:
            out.append(close(False))  # it may go on in the next task
        if out:
            yield _batch(out, names, types)

    n = shuffle_partitions(spark)
    return (narrow.repartitionByRange(n, *_order()).sortWithinPartitions(*_order())
            .select("conv", "turn", "initial", "fault").mapInArrow(run, schema))


def audits(blocks: DataFrame) -> DataFrame:
    """(conv, gaps, counts, cost, audit) of each conversation, from its blocks in order."""
    kind = blocks.schema["conv"].dataType.simpleString()
    names = ["conv", "gaps", *COUNTS, "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out, size = [], [], 0
        conv, stack, sums, initial, turns_, seen = None, [], [0] * 4, None, [None, None, 0], False

        def close() -> tuple:
            ends = [way for (p, q), way in whole(stack).items() if p == 0 and q in (-1, 0, 3)]
            first, last, n = turns_
            cost, audit = min(ends)
            return conv, 0 if first is None else last - first + 1 - n, *sums, cost, audit

        for b in batches:
            if not types:
                types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for r in b.to_pylist():
                if seen and r["conv"] != conv:
                    out.append(close())
                    size += len(out[-1][-1])
                    stack, sums, initial, turns_ = [], [0] * 4, None, [None, None, 0]
                    if len(out) >= OUT_ROWS or size > OUT_BYTES:
                        yield _batch(out, names, types)
                        out, size = [], 0
                conv, seen = r["conv"], True
                sums = [x + r[c] for x, c in zip(sums, COUNTS)]
                if initial is not None:
                    sums[3] += initial + r["initials"][0] not in LEGAL
                initial = r["initials"][1]
                if r["n_turns"]:
                    turns_[2] += r["n_turns"] - (turns_[1] == r["first_turn"])
                    turns_[0] = r["first_turn"] if turns_[0] is None else turns_[0]
                    turns_[1] = r["last_turn"]
                push(stack, {(w["first"], w["last"]): (w["cost"], w["audit"]) for w in r["ways"]})
        if seen:
            out.append(close())
            yield _batch(out, names, types)

    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    order = [F.col("conv").asc_nulls_first(), "part", "block"]
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each conversation its head (the row with the audit) alone, then (None, role, text, edit) of its repaired rows.

    ``edit`` is the audit's letter; a deleted row is not given.
    """
    audit, at, state = "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield None, ROLE[state], "", "I"
            at, state = at + 1, TURN[state]

    for b in batches:
        for r in b.to_pylist():
            if r["audit"] is not None:
                yield from inserted()
                audit, at, state = r["audit"], 0, 0
                yield (r,)
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "K":
                yield None, r["role"], r["text"], "K"
                state = AFTER[state][r["role"][0]]
            elif edit == "R":
                yield None, ROLE[state], r["text"], "R"
                state = TURN[state]
    yield from inserted()


def _with_texts(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Heads (one a conversation, with its audit) and rows, sorted so that a head is followed by its rows."""
    heads = heads.withColumn("audit", F.coalesce("audit", F.lit("")))
    both = heads.unionByName(rows.select("conv", "turn", "role", "text", "digest", "row"), allowMissingColumns=True)
    n = shuffle_partitions(rows.sparkSession)
    return both.repartition(n, "conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("audit").isNull(), *_order()[1:]).drop("digest", "row", "turn")


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows as written, (conv, gaps, counts, cost, audit) of each conversation)."""
    rows = turns(conversations)
    return rows, materialize(audits(materialize(solve(faults(rows), block_rows), "blocks")), "audits")


def repaired_rows(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: (conv, place from 0, role, text, edit)."""
    rows, heads = repair(conversations, block_rows)
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "place", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out, size, types = None, 0, [], 0, []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field(0).type, pa.int64(), *[pa.string()] * 3]
                yield b

        for x in _apply(typed()):
            if x[0] is not None:
                conv, place = x[0]["conv"], 0
                continue
            out.append((conv, place, *x[1:]))
            place, size = place + 1, size + len(x[2])
            if len(out) >= OUT_ROWS or size > OUT_BYTES:
                yield _batch(out, names, types)
                out, size = [], 0
        if out:
            yield _batch(out, names, types)

    return _with_texts(heads.select("conv", "audit"), rows).mapInArrow(
        run, f"conv {kind}, place long, role string, text string, edit string")


def digests(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``heads`` with ``repaired_sha256`` of the repaired ``role:text`` lines."""
    fields = [f for f in heads.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        head, sha, more, out, size, types = None, None, False, [], 0, []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field(n).type for n in names] + [pa.string()]
                yield b

        for x in _apply(typed()):
            if x[0] is None:
                sha.update(("\n" * more + f"{x[1]}:{x[2]}").encode())
                more = True
                continue
            if head is not None:
                out.append((*[head[n] for n in names], sha.hexdigest()))
                size += len(head["audit"])
            if len(out) >= OUT_ROWS or size > OUT_BYTES:
                yield _batch(out, [*names, "repaired_sha256"], types)
                out, size = [], 0
            head, sha, more = x[0], hashlib.sha256(), False
        if head is not None:
            out.append((*[head[n] for n in names], sha.hexdigest()))
            yield _batch(out, [*names, "repaired_sha256"], types)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", repaired_sha256 string"
    return _with_texts(heads, rows).mapInArrow(run, schema)


def op12_chat_repair(spark, sf_dir) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows, found = repair(damage(conversations))
    every = conversations.select(F.struct("conv_id").alias("of")).distinct()
    heads = every.join(found, F.col("of") == F.struct(F.col("conv").alias("conv_id")), "left")
    number = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *COUNTS, "cost")]
    heads = heads.select(F.col("of.conv_id").alias("conv"), *number, F.coalesce("audit", F.lit("")).alias("audit"))
    return digests(heads, rows).withColumnRenamed("conv", "conv_id")


# crc32 and the shortest ways in plain SQL: one step of a recursive table per row, least (cost, audit) per state
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM range(256) r(n)),
d AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
x AS (
  SELECT id, coalesce(conv_id::VARCHAR, 'NULL') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), id, copy) AS i,
    substr(role, 1, 1) AS ini, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM x),
f AS (
  SELECT conv, turn, role, text, i, ini, CASE WHEN last = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS pair FROM o),
ins(q, r, w, a) AS (VALUES (0,0,0,''),(1,1,0,''),(2,2,0,''),(3,3,0,''),(0,2,2,'I'),(1,2,2,'I'),(2,3,2,'I'),(3,2,2,'I'),
  (0,3,4,'II'),(1,3,4,'II'),(2,2,4,'II'),(3,3,4,'II')),
nxt(q, ini, r) AS (VALUES (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)),
edit AS (
  SELECT conv, i, q, q AS r, 3 AS w, 'D' AS a FROM f, range(4) s(q)
  UNION ALL SELECT conv, i, q, CASE WHEN q = 2 THEN 3 ELSE 2 END, 2 + (fault IS NOT NULL)::INT, 'R' FROM f, range(4) s(q) WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv, i, q, r, (fault IS NOT NULL)::INT, 'K' FROM f JOIN nxt USING (ini) WHERE fault IS NULL OR fault = 'truncated'),
hop AS (SELECT conv, i, ins.q AS q, edit.r AS r, min({'w': ins.w + edit.w, 'a': ins.a || edit.a}) AS s
        FROM edit JOIN ins ON ins.r = edit.q GROUP BY ALL),
st(conv, i, q, s) AS (
  SELECT DISTINCT conv, 0::BIGINT, 0::BIGINT, {'w': 0, 'a': ''} FROM f
  UNION ALL
  SELECT st.conv, st.i + 1, hop.r::BIGINT, min({'w': st.s.w + hop.s.w, 'a': st.s.a || hop.s.a})
  FROM st JOIN hop ON hop.conv = st.conv AND hop.i = st.i + 1 AND hop.q = st.q GROUP BY st.conv, st.i, hop.r),
best AS (
  SELECT conv, min({'w': st.s.w + ins.w, 'a': st.s.a || ins.a}) AS s FROM st JOIN (SELECT conv, max(i) AS i FROM f GROUP BY conv) USING (conv, i)
  JOIN ins ON ins.q = st.q AND ins.r IN (0, 3) GROUP BY conv),
letters AS (SELECT conv, unnest(string_split(s.a, '')) AS a, generate_subscripts(string_split(s.a, ''), 1) AS k FROM best WHERE s.a <> ''),
placed AS (SELECT *, sum((a <> 'I')::INT) OVER (PARTITION BY conv ORDER BY k) AS i FROM letters),
said AS (
  SELECT p.conv, k, a, role, text, row_number() OVER (PARTITION BY p.conv ORDER BY k) AS n,
    first_value(a = 'K' AND ini = 's') OVER (PARTITION BY p.conv ORDER BY k) AS s
  FROM placed p LEFT JOIN f ON f.conv = p.conv AND f.i = p.i AND p.a <> 'I' WHERE a <> 'D'),
out AS (
  SELECT conv, string_agg(CASE WHEN a = 'K' THEN role WHEN (n - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN a = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM said GROUP BY conv),
n AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.w, 0)::BIGINT AS cost,
  coalesce(s.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'NULL') AS conv FROM conversations) c
LEFT JOIN n USING (conv) LEFT JOIN best USING (conv) LEFT JOIN out USING (conv)
"""
