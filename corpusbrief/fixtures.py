"""Deterministic fixture tables derived from the driver's ``documents`` table.

Each table exists twice: as a Spark DataFrame built from ``documents`` and as a
DuckDB common table expression over the same view, so every registered query
can be checked against an independent SQL engine.  Definitions follow
FIXTURES.md part B; every table grows with ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import STORE_COLUMNS

# 2026-01-01T00:00:00Z as epoch seconds; catalog rows are one minute apart.
EPOCH_2026 = 1767225600
# Fixed run timestamp of the pipeline queries (written as ``created_at``).
RUN_TS = "2026-06-01 12:00:00"
# Small chunk budget for the chunking queries: 200 tokens of 4 chars.
FIXTURE_BUDGET_TOKENS = 200
CHARS_PER_TOKEN = 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --------------------------------------------------------------------------- Spark

def _h(col: str = "doc_id") -> str:
    return f"md5(cast({col} as string))"


def _summaries_select() -> list[str]:
    h = _h()
    return [
        "doc_id",
        f"concat(substr({h},1,8),'-',substr({h},9,4),'-4',substr({h},14,3),'-a',"
        f"substr({h},18,3),'-',substr({h},21,12)) as id",
        "concat('/corpus/', source, '/', lang, '_', "
        "case when doc_id % 7 = 0 then 'a_rather_long_report_file_name_' else 'doc_' end, "
        "cast(doc_id % 100 as string), '.pdf') as pdf_path",
        "sha2(text, 256) as pdf_hash",
        "case when doc_id % 11 = 0 then cast(null as bigint) else (n_chars + 1799) div 1800 end as page_count",
        "concat('[summary] ', text) as summary",
        "case doc_id % 3 when 0 then 'short' when 1 then 'standard' else 'detailed' end as length",
        "concat('m', lpad(cast(doc_id % 14 + 1 as string), 2, '0')) as model",
        f"concat(date_format(timestamp_seconds({EPOCH_2026} + doc_id * 60), \"yyyy-MM-dd'T'HH:mm:ss\"),"
        " '+00:00') as created_at",
        "case when doc_id % 10 = 0 then cast(null as bigint) else (n_chars + 3) div 4 end as tokens_in",
        "case when doc_id % 10 = 0 or doc_id % 17 = 0 then cast(null as bigint) "
        "else 50 + doc_id % 400 end as tokens_out",
        "case when doc_id % 10 = 0 then cast(null as bigint) else n_chars * 10 + 1 end as latency_ms",
    ]


def summaries_raw(docs: DataFrame) -> DataFrame:
    """B.2 with ``doc_id`` kept: ISO text ``created_at``, as the reference stores it."""
    return docs.selectExpr(*_summaries_select())


def summaries_legacy(docs: DataFrame) -> DataFrame:
    """B.3: the first eight columns, as written before usage was recorded; every 29th time is not a time."""
    return (summaries_raw(docs).withColumn("created_at", F.expr(
        "case when doc_id % 29 = 0 then concat('unknown ', cast(doc_id as string)) else created_at end"))
        .select(*STORE_COLUMNS[:8]))


def files(docs: DataFrame) -> DataFrame:
    """B.1: rows shaped like Spark's binary file source, plus ``doc_id`` (one narrow projection)."""
    return docs.selectExpr(
        "doc_id",
        "concat('/corpus/', source, '/', lang, '_', "
        "case when doc_id % 7 = 0 then 'a_rather_long_report_file_name_' else 'doc_' end, "
        "cast(doc_id % 100 as string), '.pdf') as path",
        f"timestamp_seconds({EPOCH_2026} + doc_id * 60) as modificationTime",
        "cast(octet_length(text) as bigint) as length",
        "encode(text, 'UTF-8') as content")


def tombstones(docs: DataFrame) -> DataFrame:
    """Deleted ids of the fixture store: every 23rd document."""
    return summaries_raw(docs).where("doc_id % 23 = 0").select("id")


# Model limits of the fixture, our own: three providers of five models each, the input limit doubling from model to
# model; the last model of "c" has no usable limit, and m14 is absent, so both fall back to the default budget.
MODEL_ROWS = [(p, f"m{5 * k + i + 1:02d}", 50_000 << i if (k, i) != (2, 2) else 0, 8_000 << k, i == 0)
              for k, p in enumerate("abc") for i in range(5) if 5 * k + i < 13]
MODELS_DDL = ("provider string, model string, max_input_tokens bigint, "
              "max_output_tokens bigint, is_default boolean")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_ROWS, MODELS_DDL)


def requests(docs: DataFrame) -> DataFrame:
    """B.5: one lookup request per document, of every id form."""
    s = summaries_raw(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return s.selectExpr(
        "doc_id as request_id",
        "case doc_id % 8 when 0 then id when 1 then id when 2 then substr(id,1,8) "
        "when 3 then substr(id,1,8) when 4 then 'zzzzzzzz' when 5 then upper(id) "
        "when 6 then concat('00000000-0000-4000-a000-', lpad(cast(doc_id as string), 12, '0')) "
        "else substr(id,1,7) end as id_text",
        "case doc_id % 8 when 0 then 'short' when 1 then 'short' when 2 then 'standard' "
        "when 3 then 'standard' when 4 then 'detailed' when 5 then '' "
        "when 6 then cast(null as string) else 'long' end as length")


def prefixes(docs: DataFrame) -> DataFrame:
    """B.6: the first 8 and the first 4 characters of every id, plus three edge prefixes."""
    spark = docs.sparkSession
    s = summaries_raw(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    data = s.selectExpr("explode(array(substr(id, 1, 8), substr(id, 1, 4))) as prefix")
    edge = spark.createDataFrame([("zzzzzzzz",), ("a",), ("",)], "prefix string")
    return data.unionByName(edge)


# Template overrides of the fixture (FIXTURES.md B.8).  The short
# override has no placeholder; detailed has none, so the default applies.
TEMPLATE_OVERRIDES = [
    ("short", "List the key points of the document as bullets."),
    ("standard", "Summarise the main arguments and supporting details:\n\n{text}"),
    ("detailed", ""),
]
EXTRA_INSTRUCTIONS = "Answer in English."


def template_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATE_OVERRIDES, "length string, override string")


# --------------------------------------------------------------------------- DuckDB

def _dh(col: str = "doc_id") -> str:
    return f"md5(cast({col} as varchar))"


_D = _dh()
DUCK_CTES = {
    "summaries_raw": f"""summaries_raw AS (
  SELECT doc_id,
    substr({_D},1,8)||'-'||substr({_D},9,4)||'-4'||substr({_D},14,3)||'-a'||substr({_D},18,3)||'-'||substr({_D},21,12) AS id,
    '/corpus/'||source||'/'||lang||'_'||CASE WHEN doc_id % 7 = 0 THEN 'a_rather_long_report_file_name_' ELSE 'doc_' END
      ||cast(doc_id % 100 AS varchar)||'.pdf' AS pdf_path,
    sha256(text) AS pdf_hash,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (n_chars + 1799) // 1800 END::BIGINT AS page_count,
    '[summary] '||text AS summary,
    CASE doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'standard' ELSE 'detailed' END AS length,
    'm'||lpad(cast(doc_id % 14 + 1 AS varchar), 2, '0') AS model,
    strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S')||'+00:00' AS created_at,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (n_chars + 3) // 4 END::BIGINT AS tokens_in,
    CASE WHEN doc_id % 10 = 0 OR doc_id % 17 = 0 THEN NULL ELSE 50 + doc_id % 400 END::BIGINT AS tokens_out,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars * 10 + 1 END::BIGINT AS latency_ms
  FROM documents)""",
    # the catalog as read: ISO text converted to a timestamp, tombstoned ids removed
    "catalog": """catalog AS (
  SELECT id, pdf_path, pdf_hash, page_count, summary, length, model,
    cast(created_at AS TIMESTAMP) AS created_at, tokens_in, tokens_out, latency_ms, doc_id
  FROM summaries_raw WHERE doc_id % 23 <> 0)""",
    "files": """files AS (
  SELECT d.doc_id, s.pdf_path AS path,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(d.doc_id) AS modificationTime,
    strlen(d.text)::BIGINT AS length, d.text AS text
  FROM documents d JOIN summaries_raw s USING (doc_id))""",
    "models": "models AS (SELECT * FROM (VALUES " + ", ".join(
        "('{}','{}',{},{},{})".format(p, m, i, "NULL" if o is None else o, str(d).upper())
        for p, m, i, o, d in MODEL_ROWS) + ") t(provider, model, max_input_tokens, max_output_tokens, is_default))",
    "requests": """requests AS (
  SELECT doc_id AS request_id,
    CASE doc_id % 8 WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN substr(id,1,8) WHEN 3 THEN substr(id,1,8)
      WHEN 4 THEN 'zzzzzzzz' WHEN 5 THEN upper(id)
      WHEN 6 THEN '00000000-0000-4000-a000-'||lpad(cast(doc_id AS varchar), 12, '0')
      ELSE substr(id,1,7) END AS id_text,
    CASE doc_id % 8 WHEN 0 THEN 'short' WHEN 1 THEN 'short' WHEN 2 THEN 'standard' WHEN 3 THEN 'standard'
      WHEN 4 THEN 'detailed' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'long' END AS length
  FROM summaries_raw)""",
    "prefixes": """prefixes AS (
  SELECT substr(id,1,8) AS prefix FROM summaries_raw
  UNION ALL SELECT substr(id,1,4) FROM summaries_raw
  UNION ALL SELECT * FROM (VALUES ('zzzzzzzz'), ('a'), ('')) t(prefix))""",
}
# dependencies between the CTEs above
_DEPS = {"catalog": ["summaries_raw"], "files": ["summaries_raw"], "requests": ["summaries_raw"],
         "prefixes": ["summaries_raw"]}


def duck_with(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named fixture CTEs (plus ``extra`` CTE text) and ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [DUCK_CTES[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
