"""Column expressions used by the operators (all JVM-side, no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_LENGTH, LENGTHS

# Id patterns accepted by the reference (lower-case hex only, no
# version-nibble check).  The reference matches ``^...$`` with Python's
# ``re.match``, where ``$`` also matches before one final newline; ``\n?\z``
# spells that out (Java's ``$`` would accept other line terminators too).
FULL_ID_PATTERN = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\n?\z"
SHORT_ID_PATTERN = r"\A[0-9a-f]{8}\n?\z"

# Display labels and formats of the reference's terminal views.
USAGE_TEMPLATE = "トークン: 入力 {tin} / 出力 {tout}"
RESULT_HEADER = "📄 {file_name} ({page_count}ページ)"
RESULT_FOOTER = "モデル: {model} | 要約ID: {id}"
LATENCY_TEMPLATE = "所要時間: {seconds}秒"
LIST_TIME_FORMAT = "yyyy-MM-dd HH:mm"
DETAIL_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
NAME_WIDTH = 24          # longer file names are cut ...
NAME_KEEP = 21           # ... to this many characters plus "..."
SHORT_ID_CHARS = 8


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(c: str | Column) -> Column:
    """SHA-256 hex digest of bytes (or of the UTF-8 bytes of a string)."""
    return F.sha2(col_(c), 256)


def strip_scheme(c: str | Column) -> Column:
    """Absolute path of a file-source row (drops a ``file:`` scheme)."""
    return F.regexp_replace(col_(c), r"^file:(//)?", "")


def base_name(c: str | Column) -> Column:
    """Last path component; trailing slashes are ignored as ``Path.name`` does."""
    return F.element_at(F.split(F.regexp_replace(col_(c), r"/+$", ""), "/"), -1)


def id_kind(c: str | Column) -> Column:
    """O13: 'full' for a full id, 'short' for an 8-hex prefix, else 'invalid'."""
    c = col_(c)
    return (F.when(c.rlike(FULL_ID_PATTERN), F.lit("full"))
            .when(c.rlike(SHORT_ID_PATTERN), F.lit("short"))
            .otherwise(F.lit("invalid")))


def resolve_length(c: str | Column, default: str = DEFAULT_LENGTH) -> Column:
    """The requested length, or the configured default when NULL or empty."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(default))


def is_known_length(c: str | Column) -> Column:
    return col_(c).isin(*LENGTHS)


def short_id(c: str | Column) -> Column:
    """O46."""
    return F.substring(col_(c), 1, SHORT_ID_CHARS)


def truncate_name(c: str | Column) -> Column:
    """Names longer than 24 characters become 21 characters plus '...'."""
    c = col_(c)
    return F.when(F.length(c) > NAME_WIDTH,
                  F.concat(F.substring(c, 1, NAME_KEEP), F.lit("..."))).otherwise(c)


def thousands(c: str | Column) -> Column:
    """Integer with comma thousands separators (NULL stays NULL)."""
    return F.format_number(col_(c), 0)


def usage_label(tokens_in: str | Column, tokens_out: str | Column) -> Column:
    """O20: '' when both are NULL, '-' for the missing one, else both with separators."""
    tin, tout = col_(tokens_in), col_(tokens_out)
    pre, mid = USAGE_TEMPLATE.split("{tin}")
    mid, post = mid.split("{tout}")
    return (F.when(tin.isNull() & tout.isNull(), F.lit(""))
            .otherwise(F.concat(F.lit(pre), F.coalesce(thousands(tin), F.lit("-")), F.lit(mid),
                                F.coalesce(thousands(tout), F.lit("-")), F.lit(post))))


def seconds_1dp(ms: str | Column) -> Column:
    """Milliseconds as seconds with one decimal, rounded as Python rounds ``ms / 1000``.

    Python rounds the binary value of the double ``ms / 1000``; Java's ``%.1f``
    rounds its shortest decimal form half-up, so the two differ at decimal
    ties (``ms % 100 == 50``).  Away from ties both give the tenths nearest to
    ``ms / 1000``, done here in integers.  At a tie the direction is the sign
    of ``x * 1000 - ms`` for the double ``x``, computed exactly with Dekker's
    error-free product (``x`` split in two 26-bit halves; every step is exact
    in double arithmetic, which Catalyst does not reassociate); an exact tie
    rounds half to even.
    """
    m = col_(ms).cast("bigint")
    q, r = F.floor(m / F.lit(100)).cast("bigint"), m % F.lit(100)
    x = m.cast("double") / F.lit(1000.0)
    c = x * F.lit(134217729.0)                      # 2**27 + 1
    xh = c - (c - x)
    xl = x - xh
    p = x * F.lit(1000.0)
    err = (xh * F.lit(1000.0) - p) + xl * F.lit(1000.0)
    above = (p - m.cast("double")) + err            # sign of x * 1000 - ms, exactly
    tenths = (F.when(r < 50, q).when(r > 50, q + 1)
              .when(above > 0, q + 1).when(above < 0, q)
              .when(q % 2 == 0, q).otherwise(q + 1))
    exact = F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(m >= 0, exact).otherwise(F.format_string("%.1f", x))


def latency_label(ms: str | Column) -> Column:
    pre, post = LATENCY_TEMPLATE.split("{seconds}")
    c = col_(ms)
    return F.when(c.isNotNull(), F.concat(F.lit(pre), seconds_1dp(c), F.lit(post)))


def list_time(ts: str | Column) -> Column:
    """O50, list form."""
    return F.date_format(col_(ts), LIST_TIME_FORMAT)


def detail_time(ts: str | Column) -> Column:
    """O50, detail form."""
    return F.date_format(col_(ts), DETAIL_TIME_FORMAT)


def parse_iso_timestamp(c: str | Column) -> Column:
    """ISO-8601 text (with or without offset) to a UTC timestamp; bad text gives NULL."""
    return col_(c).try_cast("timestamp")


def budget_from_limit(max_input: str | Column, fallback: int = 32000, share: tuple[int, int] = (8, 10)
                      ) -> Column:
    """``share`` (80 %) of a positive max input, truncated to an integer; otherwise the fallback."""
    m = col_(max_input)
    num, den = share
    # m * 8 / 10 is exact in double for every limit below 2**50, so floor is the int() of the reference
    return (F.when(m > 0, F.floor(m * F.lit(num) / F.lit(den)).cast("bigint"))
            .otherwise(F.lit(fallback).cast("bigint")))


def resolved_path(path: str | Column, cwd: str | None = None) -> Column:
    """The absolute path that ingest would store: scheme removed, relative to ``cwd``, ``.`` and ``..`` resolved."""
    import os

    p = strip_scheme(path)
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit((cwd or os.getcwd()).rstrip("/") + "/"), p))
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda out, x: F.when(x.isin("", "."), out)
                        .when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
                        .otherwise(F.concat(out, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))
