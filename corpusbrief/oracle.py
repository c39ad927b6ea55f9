"""DuckDB SQL twins of the registered queries (the driver's correctness oracle).

Written independently of the Spark code, over the same parquet views, with
the fixture tables as common table expressions (:data:`fixtures.DUCK_CTES`).
"""
from __future__ import annotations

from .fixtures import duck_with as W

TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
FILE_NAME = "string_split(regexp_replace(pdf_path, '/+$', ''), '/')[-1]"


def usage(tin: str = "tokens_in", tout: str = "tokens_out") -> str:
    return (f"CASE WHEN {tin} IS NULL AND {tout} IS NULL THEN '' ELSE "
            f"'トークン: 入力 '||coalesce(format('{{:,}}', {tin}), '-')||' / 出力 '||"
            f"coalesce(format('{{:,}}', {tout}), '-') END")


NORM = f"""norm AS (
  SELECT id, pdf_path, pdf_hash, {FILE_NAME} AS file_name, coalesce(page_count, 0)::BIGINT AS page_count,
    summary AS summary_text, length AS summary_length, model AS model_name, created_at,
    tokens_in, tokens_out, latency_ms
  FROM catalog)"""

KIND = ("CASE WHEN regexp_full_match(id_text, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\n?') "
        "THEN 'full' WHEN regexp_full_match(id_text, '[0-9a-f]{8}\\n?') THEN 'short' ELSE 'invalid' END")
RLEN = "coalesce(nullif(length, ''), 'standard')"

SQL: dict[str, str] = {}

SQL["catalog_scan"] = W(["catalog"], f"""
SELECT id, pdf_path, pdf_hash, page_count, summary, length, model, {TS} AS created_at,
  tokens_in, tokens_out, latency_ms FROM catalog""")

SQL["migrate_schema"] = W(["summaries_raw"], f"""
SELECT id, pdf_path, pdf_hash, page_count, summary, length, model,
  strftime(cast(created_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at,
  NULL::BIGINT AS tokens_in, NULL::BIGINT AS tokens_out, NULL::BIGINT AS latency_ms
FROM summaries_raw WHERE doc_id % 29 <> 0""")

SQL["migrate_failures"] = W(["summaries_raw"], """
SELECT pdf_path, 'source' AS stage, 'ValueError' AS error_class,
  'bad created_at: unknown ' || cast(doc_id AS VARCHAR) AS message
FROM summaries_raw WHERE doc_id % 29 = 0""")

SQL["normalise_rows"] = W(["catalog"], f"""
SELECT id, pdf_path, pdf_hash, file_name, page_count, summary_text, summary_length, model_name,
  tokens_in, tokens_out, latency_ms, {TS} AS created_at FROM norm""", [NORM])

SQL["list_summaries"] = W(["catalog"], f"""
SELECT row_number() OVER (ORDER BY created_at DESC, id DESC)::BIGINT AS position, id, file_name,
  page_count, summary_length, {TS} AS created_at FROM norm""", [NORM])

SQL["list_page"] = W(["catalog"], f"""
SELECT id, file_name, page_count, summary_length, {TS} AS created_at FROM (
  SELECT * FROM norm ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50)""", [NORM])

_LV = """
SELECT row_number() OVER (ORDER BY created_at DESC, id DESC)::BIGINT AS position,
  {disp} AS display_id,
  CASE WHEN length(file_name) > 24 THEN substr(file_name, 1, 21)||'...' ELSE file_name END AS display_name,
  page_count, summary_length, strftime(created_at, '%Y-%m-%d %H:%M') AS created FROM norm"""
SQL["list_view"] = W(["catalog"], _LV.format(disp="substr(id, 1, 8)"), [NORM])
SQL["list_view_full_id"] = W(["catalog"], _LV.format(disp="id"), [NORM])

SQL["detail_view"] = W(["catalog"], f"""
SELECT id, file_name, pdf_path, page_count, summary_length, model_name,
  nullif({usage()}, '') AS usage_line,
  CASE WHEN latency_ms IS NOT NULL THEN '所要時間: '||printf('%.1f', latency_ms / 1000.0)||'秒' END AS latency_line,
  {TS} AS created, summary_text FROM norm""", [NORM])

SQL["result_view"] = W(["catalog"], f"""
SELECT id, '📄 '||file_name||' ('||cast(page_count AS VARCHAR)||'ページ)' AS header, summary_text,
  concat_ws(' | ', 'モデル: '||model_name||' | 要約ID: '||id, nullif({usage()}, '')) AS footer
FROM norm""", [NORM])

SQL["usage_label"] = W(["catalog"], f"SELECT id, tokens_in, tokens_out, {usage()} AS usage FROM catalog")

SQL["usage_rollup"] = W(["catalog"], """
SELECT length, model, count(*)::BIGINT AS n_rows, count(tokens_in)::BIGINT AS n_with_usage,
  sum(tokens_in)::BIGINT AS sum_tokens_in, sum(tokens_out)::BIGINT AS sum_tokens_out,
  sum(latency_ms)::BIGINT AS sum_latency_ms, max(latency_ms)::BIGINT AS max_latency_ms,
  grouping(length, model)::BIGINT AS grouping_level
FROM catalog GROUP BY ROLLUP (length, model)""")

SQL["id_kind"] = W(["requests"], f"SELECT request_id, id_text, {KIND} AS id_kind FROM requests")

SQL["validate_requests"] = W(["requests"], f"""
SELECT request_id, kind AS id_kind, rlen AS resolved_length, reason IS NULL AS valid, reason FROM (
  SELECT request_id, {KIND} AS kind, {RLEN} AS rlen,
    CASE WHEN {KIND} = 'invalid' THEN 'invalid_id'
         WHEN {RLEN} NOT IN ('short', 'standard', 'detailed') THEN 'invalid_length' END AS reason
  FROM requests)""")

SQL["default_length"] = W(["requests"], f"SELECT request_id, length, {RLEN} AS resolved_length FROM requests")

SQL["get_by_id"] = W(["requests", "catalog"], """
SELECT r.request_id, r.id_text, n.id IS NOT NULL AS found, n.file_name, n.summary_length, n.page_count
FROM requests r LEFT JOIN norm n ON r.id_text = n.id""", [NORM])

SQL["resolve_prefixes"] = W(["prefixes", "catalog"], """
SELECT p.prefix, coalesce(m.n, 0)::BIGINT AS match_count,
  CASE WHEN coalesce(m.n, 0) = 0 THEN 'none' WHEN m.n = 1 THEN 'one' ELSE 'many' END AS status,
  CASE WHEN m.n = 1 THEN m.min_id END AS matched_id
FROM prefixes p LEFT JOIN (
  SELECT q.prefix, count(*) AS n, min(c.id) AS min_id
  FROM (SELECT DISTINCT prefix FROM prefixes) q JOIN catalog c ON starts_with(c.id, q.prefix)
  GROUP BY q.prefix) m ON p.prefix = m.prefix""")

_LOOKUP = f"""looked AS (
  SELECT r.request_id, r.id_text, r.length, k.kind AS id_kind,
    CASE WHEN k.kind = 'invalid' THEN 'invalid'
         WHEN k.kind = 'full' THEN CASE WHEN f.id IS NOT NULL THEN 'ok' ELSE 'not_found' END
         WHEN s.n IS NULL THEN 'not_found' WHEN s.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
    CASE WHEN k.kind = 'full' THEN f.id WHEN k.kind = 'short' AND s.n = 1 THEN s.min_id END AS resolved_id
  FROM requests r
  JOIN (SELECT request_id, {KIND} AS kind FROM requests) k USING (request_id)
  LEFT JOIN catalog f ON k.kind = 'full' AND r.id_text = f.id
  LEFT JOIN (SELECT substr(id, 1, 8) AS p8, count(*) AS n, min(id) AS min_id FROM catalog GROUP BY 1) s
    ON k.kind = 'short' AND r.id_text = s.p8)"""

SQL["lookup_requests"] = W(["requests", "catalog"], """
SELECT l.request_id, l.id_text, l.id_kind, l.status, l.resolved_id, n.file_name, n.summary_length
FROM looked l LEFT JOIN norm n ON l.resolved_id = n.id""", [NORM, _LOOKUP])

SQL["delete_requests"] = W(["requests", "catalog"], """
SELECT request_id, id_kind, status, CASE WHEN status = 'ok' THEN resolved_id END AS deleted_id,
  CASE WHEN status = 'ok' THEN resolved_id NOT IN (
    SELECT id FROM catalog WHERE id NOT IN (SELECT resolved_id FROM looked WHERE status = 'ok')) END AS gone
FROM looked""", [_LOOKUP])

_FULL_IDS = f"""full_ids AS (
  SELECT DISTINCT id_text AS id FROM requests WHERE ({KIND}) = 'full')"""

SQL["delete_ids"] = W(["requests", "catalog"], """
SELECT id, pdf_path FROM catalog WHERE id NOT IN (SELECT id FROM full_ids)""", [_FULL_IDS])

SQL["delete_outcome"] = W(["requests", "catalog"], """
SELECT f.id, c.id IS NOT NULL AS deleted FROM full_ids f LEFT JOIN catalog c ON f.id = c.id""", [_FULL_IDS])

SQL["resolve_and_delete"] = W(["prefixes", "catalog"], """
SELECT id, pdf_path, id IN (
  SELECT min(c.id) FROM (SELECT DISTINCT prefix FROM prefixes) q JOIN catalog c ON starts_with(c.id, q.prefix)
  GROUP BY q.prefix HAVING count(*) = 1) AS deleted
FROM catalog""")

SQL["latest_per_path"] = W(["catalog"], f"""
SELECT pdf_path, id, summary_length, page_count, {TS} AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY pdf_path ORDER BY created_at DESC, id DESC) AS rn FROM norm)
WHERE rn = 1""", [NORM])


_SENT_END = r"'([.!?])[ \t\n\r\f]+'"
_WIDE_END = r"'([。！？]+)[ \t\n\r\f]*'"
_WORD_SPLIT = r"'[^\p{L}\p{N}]+'"
_ONE_CHAR = r"'([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 '"
_BACKREF = r"'\1'"

# a sentence above the budget is cut after the last blank that fits, else where the budget ends, until nothing is left
_EXTRACTIVE = """
WITH RECURSIVE s0 AS (
  SELECT doc_id, pos, raw FROM (
    SELECT doc_id, unnest(arr) AS raw, (generate_subscripts(arr, 1) - 1)::BIGINT AS pos FROM (
      SELECT doc_id, list_filter(string_split_regex(regexp_replace(
          regexp_replace(text, @SENT_END@, @BACKREF@ || chr(10), 'g'), @WIDE_END@, @BACKREF@ || chr(10), 'g'),
          chr(10) || '+'), lambda x: x <> '') AS arr
      FROM documents))),
pc(doc_id, spos, part, sent, rest) AS (
  SELECT doc_id, pos, 0::BIGINT, NULL::VARCHAR, raw FROM s0
  UNION ALL
  SELECT doc_id, spos, part + 1, substr(rest, 1, cut), substr(rest, cut + 1) FROM (
    SELECT *, CASE WHEN length(rest) > @CUT@ AND contains(substr(rest, 1, @CUT@), ' ')
                   THEN @CUT@ + 1 - strpos(reverse(substr(rest, 1, @CUT@)), ' ') ELSE @CUT@ END AS cut
    FROM pc WHERE rest <> '')),
s AS (SELECT doc_id, spos * 16777216 + part AS pos, sent FROM pc WHERE part > 0),
w AS (
  SELECT doc_id, pos, unnest(list_filter(string_split_regex(
    regexp_replace(lower(sent), @ONE_CHAR@, 'g'), @WORD_SPLIT@), lambda x: x <> '')) AS word
  FROM s),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY doc_id, word),
sc AS (SELECT w.doc_id, w.pos, sum(tf.tf) // count(*) AS score FROM w JOIN tf USING (doc_id, word)
       GROUP BY w.doc_id, w.pos),
r AS (
  SELECT s.doc_id, s.pos, s.sent,
    sum(length(s.sent) + @OV@) OVER (PARTITION BY s.doc_id ORDER BY coalesce(sc.score, 0) DESC, s.pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM s LEFT JOIN sc USING (doc_id, pos)),
k AS (SELECT * FROM r WHERE cum <= @LIMIT@),
agg AS (
  SELECT d.doc_id, coalesce(string_agg(@LINE@, chr(10) ORDER BY k.pos), '') AS summary,
    count(k.sent)::BIGINT AS n_sentences
  FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, '@LENGTH@' AS length, summary, n_sentences, length(summary)::BIGINT AS summary_chars FROM agg"""


def extractive(length: str, src: str = "documents") -> str:
    budget = {"short": 500, "standard": 2000, "detailed": 5000}[length]
    ov = 3 if length == "short" else 1
    line = "'- ' || k.sent" if length == "short" else "k.sent"
    subst = {"@CUT@": str(budget - ov + 1), "@SENT_END@": _SENT_END, "@WIDE_END@": _WIDE_END,
             "@ONE_CHAR@": _ONE_CHAR, "@BACKREF@": _BACKREF,
             "@WORD_SPLIT@": _WORD_SPLIT, "@OV@": str(ov), "@LIMIT@": str(budget + 1),
             "@LINE@": line, "@LENGTH@": length}
    sql = _EXTRACTIVE
    for k, v in subst.items():
        sql = sql.replace(k, v)
    return sql.replace("FROM documents", f"FROM {src}")


for _l in ("short", "standard", "detailed"):
    SQL[f"extractive_{_l}"] = extractive(_l)


# ------------------------------------------------------------------ sources and pipeline stages

LEN_BY_DOC = "CASE doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'standard' ELSE 'detailed' END"
PATH_NAME = "string_split(regexp_replace(path, '/+$', ''), '/')[-1]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prefix(text: str, length: str) -> str:
    return f"'[digest length=' || {length} || '] ' || substr({text}, 1, 30) || '...'"


def _hash(text: str, length: str) -> str:
    return (f"'[digest length=' || {length} || '] ' || cast(length({text}) AS VARCHAR) || ' characters, sha256 ' "
            f"|| sha256({text})")


SQL["file_identity"] = W(["files"], f"""
SELECT doc_id, path AS pdf_path, sha256(text) AS pdf_hash, {PATH_NAME} AS file_name, length FROM files""")

SQL["build_rows"] = W(["summaries_raw"], """
SELECT pdf_path, pdf_hash, coalesce(page_count, 0)::BIGINT AS page_count, summary, length, model,
  tokens_in, tokens_out, latency_ms, '2026-06-01 12:00:00' AS created_at FROM summaries_raw""")

SQL["extract_text"] = W(["files"], """
SELECT doc_id, path AS pdf_path, text, len(string_split(text, chr(12)))::BIGINT AS page_count,
  NULL::VARCHAR AS stage FROM files""")

SQL["prefix_summary"] = f"""
SELECT doc_id, {_prefix('text', LEN_BY_DOC)} AS summary, 100::BIGINT AS tokens_in, 50::BIGINT AS tokens_out,
  1::BIGINT AS latency_ms, 'prefix-model' AS model FROM documents"""

SQL["summarize_single"] = f"""
SELECT doc_id, {_hash('text', LEN_BY_DOC)} AS summary, length(text)::BIGINT AS tokens_in, 50::BIGINT AS tokens_out,
  1::BIGINT AS latency_ms, 'hash-model' AS model, NULL::VARCHAR AS stage FROM documents"""

SQL["split_chunks"] = """
SELECT doc_id, i::BIGINT AS chunk_no, substr(text, i * 800 + 1, 800) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, (length(text) + 799) // 800)) AS i FROM documents WHERE length(text) > 0)"""

SQL["chunk_budget"] = W(["summaries_raw", "models"], """
SELECT s.doc_id, s.model,
  (CASE WHEN m.max_input_tokens > 0 THEN (m.max_input_tokens * 8) // 10 ELSE 32000 END)::BIGINT AS budget_tokens
FROM summaries_raw s LEFT JOIN models m ON s.model = m.model""")


def _render_sql() -> str:
    from .fixtures import EXTRA_INSTRUCTIONS, TEMPLATE_OVERRIDES
    from .operators.stages import DEFAULT_TEMPLATES, EXTRA_LABEL

    rows = []
    for ln, override in TEMPLATE_OVERRIDES:
        t = override or DEFAULT_TEMPLATES[ln]
        t = t + "\n\n" + EXTRA_LABEL + EXTRA_INSTRUCTIONS
        rows.append(f"({_lit(ln)}, {_lit(t)})")
    return f"""
WITH t(length, template) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, text, {LEN_BY_DOC} AS length FROM documents)
SELECT d.doc_id, d.length,
  CASE WHEN contains(t.template, '{{text}}') THEN replace(t.template, '{{text}}', d.text)
       ELSE t.template || chr(10) || chr(10) || d.text END AS prompt
FROM d LEFT JOIN t ON d.length = t.length"""


SQL["render_prompts"] = _render_sql()

SQL["limit_items"] = W(["files"], "SELECT doc_id, path FROM files ORDER BY path, doc_id LIMIT 1")

SQL["skip_seen"] = W(["files", "catalog"], """
SELECT doc_id, pdf_path, pdf_hash FROM (
  SELECT doc_id, path AS pdf_path, sha256(text) AS pdf_hash,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY path, doc_id) AS rn FROM files)
WHERE rn = 1 AND pdf_hash NOT IN (SELECT pdf_hash FROM catalog)""")

SQL["skip_seen_sketch"] = SQL["skip_seen"]

_FAIL = """fails AS (
  SELECT doc_id, pdf_path,
    CASE WHEN nbytes % 13 = 0 THEN 'extract' ELSE 'summarize' END AS stage,
    CASE WHEN nbytes % 13 = 0 THEN 'ValueError' ELSE 'RuntimeError' END AS error_class,
    CASE WHEN nbytes % 13 = 0 THEN 'cannot extract ' || nbytes || ' bytes'
         ELSE 'model refused a text of ' || nchars || ' characters' END AS message
  FROM (SELECT doc_id, path AS pdf_path, strlen(text) AS nbytes, length(text) AS nchars FROM files)
  WHERE nbytes % 13 = 0 OR nchars % 19 = 0)"""

SQL["split_failures"] = W(["files"], "SELECT doc_id, pdf_path, stage, error_class, message FROM fails", [_FAIL])

_CLASS = """classified AS (
  SELECT doc_id, stage, error_class, message,
    CASE WHEN stage IN ('extract', 'summarize') THEN stage
         WHEN error_class IN ('ConfigError', 'ConfigurationError') THEN 'config'
         WHEN error_class = 'SummarizationError' THEN 'summarize'
         WHEN error_class = 'ExtractionError' THEN 'extract'
         WHEN error_class = 'SinkError' THEN 'sink'
         WHEN stage = 'source' THEN 'source' ELSE 'other' END AS category,
    (CASE WHEN coalesce(stage NOT IN ('extract', 'summarize'), true) AND error_class IN ('ConfigError', 'ConfigurationError') THEN 2 ELSE 1 END)::BIGINT AS severity
  FROM fails)"""

# both stages of these failures have one category each
_ADVICE = ("CASE category WHEN 'extract' THEN 'The file could not be turned into text.' "
           "WHEN 'summarize' THEN 'The summariser did not return a summary.' END || ' (' || message || ')'")
SQL["classify_failures"] = W(["files"], f"""
SELECT doc_id, stage, error_class, category, severity, {_ADVICE} AS advice FROM classified""", [_FAIL, _CLASS])

SQL["run_report"] = W(["files"], """
SELECT stage, category, count(*)::BIGINT AS n_failures, max(severity)::BIGINT AS max_severity
FROM classified GROUP BY stage, category""", [_FAIL, _CLASS])

SQL["summarize_corpus"] = W(["files"], f"""
SELECT path AS pdf_path, sha256(text) AS pdf_hash, len(string_split(text, chr(12)))::BIGINT AS page_count,
  {_hash('text', LEN_BY_DOC)} AS summary, {LEN_BY_DOC} AS length, 'hash-model' AS model,
  length(text)::BIGINT AS tokens_in, 50::BIGINT AS tokens_out, 1::BIGINT AS latency_ms,
  '2026-06-01 12:00:00' AS created_at FROM files""")


def _corpus_extractive() -> str:
    parts = []
    for i, ln in enumerate(("short", "standard", "detailed")):
        src = f"(SELECT * FROM documents WHERE doc_id % 3 = {i})"
        parts.append(f"SELECT * FROM ({extractive(ln, src)})")
    ex = "\nUNION ALL\n".join(parts)
    return W(["files"], """
SELECT f.path AS pdf_path, sha256(f.text) AS pdf_hash, len(string_split(f.text, chr(12)))::BIGINT AS page_count,
  e.summary, e.length, 'extractive' AS model, ceil(length(f.text) / 4)::BIGINT AS tokens_in,
  ceil(length(e.summary) / 4)::BIGINT AS tokens_out, NULL::BIGINT AS latency_ms,
  '2026-06-01 12:00:00' AS created_at
FROM files f JOIN ex e USING (doc_id)""", [f"ex AS ({ex})"])


SQL["summarize_corpus_extractive"] = _corpus_extractive()

SQL["summarize_chunk_level"] = f"""
WITH d AS (SELECT doc_id, text, {LEN_BY_DOC} AS length FROM documents)
SELECT doc_id, 0::BIGINT AS next_level, 0::BIGINT AS chunk_no, {_hash('text', 'd.length')} AS text FROM d WHERE length(text) <= 800
UNION ALL
SELECT doc_id, 1::BIGINT AS next_level, i::BIGINT AS chunk_no, substr(joined, i * 800 + 1, 800) AS text
FROM (SELECT doc_id, joined, unnest(range(0, (length(joined) + 799) // 800)) AS i FROM (
  SELECT doc_id, string_agg({_hash('chunk', 'c.length')}, chr(10) || chr(10) ORDER BY i) AS joined, any_value(chars) AS chars
  FROM (SELECT doc_id, length, i, chars, substr(text, i * 800 + 1, 800) AS chunk
        FROM (SELECT doc_id, length, text, length(text) AS chars, unnest(range(0, (length(text) + 799) // 800)) AS i
              FROM d WHERE length(text) > 800)) c
  GROUP BY doc_id) WHERE length(joined) < chars)"""


# full recursion of O25 with the hash summariser (budget 200 tokens x 4 chars), until every text fits
SQL["summarize_chunked"] = f"""
WITH RECURSIVE st(doc_id, len, text, level, calls, tin) AS (
  SELECT doc_id, {LEN_BY_DOC}, text, 0, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, len, string_agg({_hash('chunk', 'len')}, chr(10) || chr(10) ORDER BY i),
    max(level) + 1, max(calls) + count(*), (max(tin) + sum(length(chunk)))::BIGINT
  FROM (SELECT doc_id, len, level, calls, tin, i, substr(text, i * 800 + 1, 800) AS chunk
        FROM (SELECT doc_id, len, level, calls, tin, text, unnest(range(0, (length(text) + 799) // 800)) AS i
              FROM st WHERE length(text) > 800))
  GROUP BY doc_id, len)
SELECT doc_id, {_hash('text', 'len')} AS summary, (tin + length(text))::BIGINT AS tokens_in,
  (50 * (calls + 1))::BIGINT AS tokens_out, (calls + 1)::BIGINT AS latency_ms, level::BIGINT AS levels,
  NULL::VARCHAR AS stage
FROM st WHERE length(text) <= 800"""

SQL["chunked_accounting"] = """
SELECT id, count(*)::BIGINT AS n_rows, count(*) FILTER (message IS NULL)::BIGINT AS n_digests,
  count(DISTINCT CASE WHEN message IS NULL THEN length || text END)::BIGINT AS n_different,
  max(CASE WHEN message IS NOT NULL THEN 'summarize' END) AS stage, max(message) AS message
FROM (SELECT CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN doc_id - 1 ELSE doc_id END AS id, text,
        CASE doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'standard' ELSE 'detailed' END AS length,
        CASE WHEN doc_id % 31 = 0 THEN 'no text' WHEN doc_id % 37 = 0 THEN 'unknown length long' END AS message FROM documents)
GROUP BY id"""

SQL["latest_for_paths"] = W(["files", "catalog"], f"""
SELECT p.req_path, l.id IS NOT NULL AS found, l.id, l.summary_length,
  strftime(l.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT DISTINCT path AS req_path FROM files
      UNION SELECT path || '.missing' FROM files) p
LEFT JOIN (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY pdf_path ORDER BY created_at DESC, id DESC) AS rn FROM norm)
  WHERE rn = 1) l ON p.req_path = l.pdf_path""", [NORM])

# Spark writes each document as a text file: its bytes are the text plus one newline
SQL["ingest_files"] = """
SELECT doc_id, sha256(text || chr(10)) AS pdf_hash, (strlen(text) + 1)::BIGINT AS length FROM documents"""

# the stream summarises those files (extractive, standard); the trailing newline adds no sentence
SQL["stream_ingest"] = f"""
SELECT doc_id, length, summary, ceil(length(summary) / 4)::BIGINT AS tokens_out, 'extractive' AS model
FROM ({extractive("standard")})"""


# contents of every fifth document are old, those of every tenth deleted: new unless an old row of the content is left
SQL["stream_skip_seen"] = """
SELECT pdf_hash, n_old, (CASE WHEN n_old = 0 THEN 1 ELSE 0 END)::BIGINT AS n_new FROM (
  SELECT sha256(text || chr(10)) AS pdf_hash, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 10 <> 0)::BIGINT AS n_old
  FROM documents GROUP BY 1)"""


def _resolve_templates_sql() -> str:
    from .fixtures import TEMPLATE_OVERRIDES
    from .operators.stages import DEFAULT_TEMPLATES

    defaults = ", ".join(f"({_lit(k)}, {_lit(v)})" for k, v in DEFAULT_TEMPLATES.items())
    overrides = ", ".join(f"({_lit(k)}, {_lit(v)})" for k, v in TEMPLATE_OVERRIDES)
    return f"""
WITH d(length, default_template) AS (VALUES {defaults}),
o(length, override) AS (VALUES {overrides}),
t AS (SELECT d.length, coalesce(nullif(o.override, ''), d.default_template) AS template
      FROM d LEFT JOIN o USING (length))
SELECT doc_id, {LEN_BY_DOC} AS length, t.template FROM documents LEFT JOIN t ON {LEN_BY_DOC} = t.length"""


SQL["resolve_templates"] = _resolve_templates_sql()
