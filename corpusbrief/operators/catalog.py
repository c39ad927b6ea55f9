"""Queries over the summary catalog: lookup, prefix resolution, delete, latest, roll-up.

Every function works on a whole catalog and a whole batch of requests at once;
the catalog is the DataFrame returned by :func:`corpusbrief.sources.store.read_catalog`
(or any DataFrame with ``STORE_SCHEMA``).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.strategies import BROADCAST_MAX_BYTES, bytes_at_most
from ..schemas import ADDED_COLUMNS, STORE_COLUMNS, STORE_SCHEMA
from .sketch import might_contain, sketch_of

# Prefix groups that are pushed to the scan as one filter, and the lengths tried for them, longest first.
PREFIX_GROUPS = 64
PREFIX_CUTS = (36, 24, 16, 12, 8, 6, 4, 3, 2, 1)

# ------------------------------------------------------------------ schema

def conform(df: DataFrame) -> DataFrame:
    """Bring any catalog generation to ``STORE_SCHEMA``.

    Columns added by the migration come back as NULL; ISO text timestamps are
    parsed to UTC.  Idempotent, and a no-op on a current table.
    """
    for name, dtype in ADDED_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    cols = []
    for f in STORE_SCHEMA.fields:
        c = F.col(f.name)
        if f.name == "created_at" and dict(df.dtypes)[f.name] == "string":
            c = S.parse_iso_timestamp(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in STORE_COLUMNS]
    return df.select(*cols, *extra)


def migrate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows at ``STORE_SCHEMA``, failure rows) of an older generation.

    A row whose time text is missing or is no time has no place in the newest-first order: it becomes a
    failure that carries the text, instead of a row with a NULL time.
    """
    good = conform(df)
    raw = F.col("created_at").cast("string")
    # told apart before the conversion, on the raw column, so both sides see the same rows
    bad = (S.parse_iso_timestamp("created_at") if dict(df.dtypes)["created_at"] == "string"
           else F.col("created_at")).isNull()
    failures = df.where(bad).select(
        "pdf_path", F.lit("source").alias("stage"), F.lit("ValueError").alias("error_class"),
        F.concat(F.lit("bad created_at: "), F.coalesce(raw, F.lit("NULL"))).alias("message"))
    return good.where(F.col("created_at").isNotNull()), failures


def without_ids(rows: DataFrame, ids: DataFrame, max_broadcast: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``rows`` whose ``id`` is not among ``ids`` (column ``id``); rows with a NULL id stay.

    Ids within the measured byte bound are broadcast.  Beyond it, their Bloom sketch (of bounded size, whatever
    their number) is: rows that it does not hold pass by without a shuffle, and only the others are compared with
    the ids.  That is a second scan of the rows instead of a shuffle of them.
    """
    keys = ids.select("id").where("id is not null").distinct()
    if bytes_at_most(keys, max_broadcast):
        return rows.join(F.broadcast(keys), "id", "left_anti")
    told = might_contain(rows, "id", sketch_of(ids, "id"), "_maybe")
    kept = told.where(~F.col("_maybe")).drop("_maybe")
    return kept.unionByName(told.where("_maybe").drop("_maybe").join(keys, "id", "left_anti"))


def apply_tombstones(rows: DataFrame, tombstones: DataFrame, max_broadcast: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """The live catalog = rows whose id has no tombstone."""
    return without_ids(rows, tombstones, max_broadcast)


def restrict(catalog: DataFrame, col: str, keys: DataFrame, max_broadcast: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Catalog rows whose ``col`` may be among ``keys`` (one column), filtered map-side.

    When the distinct keys are within the measured byte bound they are broadcast and the catalog is
    semi-joined without a shuffle.  Beyond that their Bloom sketch filters it, so that the caller's join
    shuffles the rows asked for (and a few more) instead of the catalog.
    """
    k = keys.where(F.col(keys.columns[0]).isNotNull()).distinct().withColumnRenamed(keys.columns[0], "_k")
    if bytes_at_most(k, max_broadcast):
        return catalog.join(F.broadcast(k), catalog[col] == F.col("_k"), "left_semi")
    return might_contain(catalog, col, sketch_of(keys, keys.columns[0]), "_maybe").where("_maybe").drop("_maybe")


# ------------------------------------------------------------------ read model

def normalise(catalog: DataFrame) -> DataFrame:
    """Stored rows → read model (renames, file name, page count NULL → 0)."""
    return catalog.select(
        "id", "pdf_path", "pdf_hash",
        S.base_name("pdf_path").alias("file_name"),
        F.coalesce(F.col("page_count"), F.lit(0)).cast("bigint").alias("page_count"),
        F.col("summary").alias("summary_text"),
        F.col("length").alias("summary_length"),
        F.col("model").alias("model_name"),
        "created_at", "tokens_in", "tokens_out", "latency_ms")


def newest_first() -> list:
    """Catalog order: newest first, ties broken by the larger id."""
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def list_summaries(catalog: DataFrame, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """All rows newest first (ties broken by id); ``limit`` keeps the newest n.

    ``after`` is the (created_at, id) of the last row of a page: the rows that follow it, found by a filter that
    reaches the files' statistics, so that no earlier page is read or sorted.
    """
    rows = catalog
    if after is not None:
        at, last = after
        same_time = F.col("created_at").eqNullSafe(F.lit(at).cast("timestamp")) & (F.col("id") < last)
        rows = rows.where(same_time if at is None else same_time | (F.col("created_at") < F.lit(at)) | F.col("created_at").isNull())
    out = normalise(rows).orderBy(*newest_first())
    return out.limit(limit) if limit is not None else out


# ------------------------------------------------------------------ lookups

def get_many(catalog: DataFrame, ids: DataFrame, id_col: str = "id_text") -> DataFrame:
    """Exact-id lookup for a batch; ``found`` tells whether the id exists.

    A shuffle (or, when AQE measures one side as small, broadcast) equi-join.
    """
    cat = normalise(restrict(catalog, "id", ids.select(id_col))).withColumnRenamed("id", "_cid")
    return (ids.join(cat, ids[id_col] == cat["_cid"], "left")
            .withColumn("found", F.col("_cid").isNotNull())
            .drop("_cid"))


def get_one(catalog: DataFrame, summary_id: str) -> DataFrame:
    """O11, single id: 0 or 1 rows; the equality filter is pushed into the Parquet scan."""
    return normalise(catalog.where(F.col("id") == F.lit(summary_id)))


def get_by_prefix(catalog: DataFrame, prefix: str) -> DataFrame:
    """O12, single prefix: one row with ``match_count``, ``status`` and the row when exactly one.

    ``startswith`` is pushed into the scan; the count is a global aggregate
    with partial aggregation, so a prefix matching most of the catalog stays
    distributed.
    """
    m = normalise(catalog.where(F.col("id").startswith(prefix)))
    agg = m.agg(F.count(F.lit(1)).alias("match_count"),
                F.min_by(F.struct(*m.columns), F.col("id")).alias("_r"))
    n = F.col("match_count")
    return agg.select(F.lit(prefix).alias("prefix"), n.cast("bigint").alias("match_count"),
                      F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("status"),
                      *[F.when(n == 1, F.col("_r")[c]).alias(c) for c in m.columns])


def _prefix_lengths(catalog: DataFrame, prefixes: DataFrame, col: str) -> list[int]:
    # a prefix longer than every id matches nothing; so there are at most as many lengths as an id has characters
    longest = catalog.agg(F.max(F.length("id"))).first()[0] or 0
    rows = (prefixes.select(F.length(F.col(col)).alias("n")).where(F.col("n") <= longest)
            .distinct().collect())
    return sorted(r["n"] for r in rows)


def near_prefixes(catalog: DataFrame, prefixes: DataFrame, col: str = "prefix") -> DataFrame:
    """Catalog rows whose id may begin with one of ``prefixes``, by a filter that reaches the files' statistics.

    The prefixes are cut to the longest length that leaves at most ``PREFIX_GROUPS`` of them; an id that begins with
    a prefix begins with its cut.  In a store clustered by id (``store.compact``) what is read then grows with
    the answer.  Where every cut leaves too many, or the empty prefix is asked for, all rows are near.
    """
    p = prefixes.select(F.col(col).alias("_p")).where("_p is not null")
    cut = lambda n: F.substring("_p", 1, n)
    sizes = p.agg(*[F.approx_count_distinct(cut(n)).alias(f"n{n}") for n in PREFIX_CUTS], F.min("_p").alias("least")).first()
    if sizes["least"] is None:
        return catalog.where(F.lit(False))
    if sizes["least"] == "":
        return catalog
    for n in PREFIX_CUTS:
        if sizes[f"n{n}"] > 2 * PREFIX_GROUPS:  # far too many, by the estimate
            continue
        groups = [r["g"] for r in p.select(cut(n).alias("g")).distinct().limit(PREFIX_GROUPS + 1).collect()]
        if len(groups) <= PREFIX_GROUPS:
            return catalog.where(reduce(lambda a, b: a | b, [F.col("id").startswith(g) for g in sorted(groups)]))
    return catalog


def resolve_prefixes(catalog: DataFrame, prefixes: DataFrame, col: str = "prefix",
                     max_broadcast: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Prefix → (match count, the id when exactly one, status none/one/many).

    Literal, case-sensitive prefix match.  Ids that no prefix can name are passed over in the scan
    (:func:`near_prefixes`).  Each other id is expanded into its
    prefixes of the requested lengths only, which turns the
    ``LIKE 'p%'`` into an equi-join.  When the distinct requested prefixes are
    within the measured byte bound they are broadcast and
    semi-joined map-side before a partially aggregated count; otherwise the
    expansion is aggregated first and then joined.  Either way a prefix that
    matches most of the catalog (``''``) is only a map-side count, never a
    hot join key.
    """
    catalog = near_prefixes(catalog.select("id"), prefixes, col)
    lengths = _prefix_lengths(catalog, prefixes, col)
    wanted = prefixes.select(F.col(col).alias("_p")).distinct()
    if lengths:
        exploded = catalog.select(
            "id", F.explode(F.array(*[F.substring("id", 1, n) if n else F.lit("")
                                      for n in lengths])).alias("_p"))
        if bytes_at_most(wanted, max_broadcast):
            exploded = exploded.join(F.broadcast(wanted), "_p", "left_semi")
        matched = (exploded.groupBy("_p")
                   .agg(F.count(F.lit(1)).alias("match_count"), F.min("id").alias("_min_id")))
    else:
        matched = wanted.select("_p", F.lit(0).cast("bigint").alias("match_count"),
                                F.lit(None).cast("string").alias("_min_id"))
    out = prefixes.join(matched, prefixes[col] == matched["_p"], "left").drop("_p")
    n = F.coalesce(F.col("match_count"), F.lit(0)).cast("bigint")
    return (out.withColumn("match_count", n)
            .withColumn("status", F.when(n == 0, "none").when(n == 1, "one").otherwise("many"))
            .withColumn("matched_id", F.when(n == 1, F.col("_min_id")))
            .drop("_min_id"))


def validate_requests(requests: DataFrame, id_col: str = "id_text", length_col: str = "length",
                      default_length: str | None = None) -> DataFrame:
    """O14 + O32: id kind, resolved length, ``valid`` and the first ``reason`` it is not."""
    kw = {"default": default_length} if default_length else {}
    kind = S.id_kind(id_col)
    length = S.resolve_length(length_col, **kw)
    return (requests
            .withColumn("id_kind", kind)
            .withColumn("resolved_length", length)
            .withColumn("reason", F.when(F.col("id_kind") == "invalid", "invalid_id")
                        .when(~S.is_known_length("resolved_length"), "invalid_length"))
            .withColumn("valid", F.col("reason").isNull()))


def lookup(catalog: DataFrame, requests: DataFrame, id_col: str = "id_text") -> DataFrame:
    """Dispatch by id kind → status ok / not_found / ambiguous / invalid, plus the row.

    8-hex ids are resolved against the catalog's 8-char prefixes, pre-aggregated
    (count, min id) before the join; full ids are their own candidate.  One
    more join fetches the row of the candidate, and for full ids its presence
    decides ok / not_found.
    """
    req = requests.withColumn("id_kind", S.id_kind(id_col))
    # invalid and missing ids join with nothing: they leave before the joins, where they would be one hot key
    known = F.coalesce(F.col("id_kind") != "invalid", F.lit(False))
    unknown, req = req.where(~known), req.where(known)
    # every row a request can name shares its first 8 characters with the request: filter the
    # catalog by those prefixes (keys from the requests alone, so counting them is cheap)
    p8 = req.select(S.short_id(id_col))
    cat = restrict(catalog.withColumn("_p8", S.short_id("id")), "_p8", p8)
    short = cat.groupBy("_p8").agg(F.count(F.lit(1)).alias("_n8"), F.min("id").alias("_id8"))
    j = req.join(short, (F.col("id_kind") == "short") & (req[id_col] == short["_p8"]), "left")
    cand = (F.when(F.col("id_kind") == "full", F.col(id_col))
            .when((F.col("id_kind") == "short") & (F.col("_n8") == 1), F.col("_id8")))
    j = j.withColumn("_cand", cand)
    rows = normalise(cat.drop("_p8")).withColumnRenamed("id", "_rid")
    # so do requests without a single candidate
    out = (j.where(F.col("_cand").isNotNull()).join(rows, F.col("_cand") == F.col("_rid"), "left")
           .unionByName(j.where(F.col("_cand").isNull()), allowMissingColumns=True)
           .unionByName(unknown, allowMissingColumns=True))
    status = (F.when(F.coalesce(F.col("id_kind") == "invalid", F.lit(True)), "invalid")
              .when(F.col("id_kind") == "full",
                    F.when(F.col("_rid").isNotNull(), "ok").otherwise("not_found"))
              .when(F.col("_n8").isNull(), "not_found")
              .when(F.col("_n8") > 1, "ambiguous")
              .otherwise("ok"))
    return (out.withColumn("status", status)
            .withColumn("resolved_id", F.col("_rid"))
            .drop("_p8", "_n8", "_id8", "_cand", "_rid"))


def delete_ids(catalog: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(remaining catalog, outcome per requested id with ``deleted``)."""
    targets = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    remaining = without_ids(catalog, targets)
    present = restrict(catalog, "id", targets).select(F.col("id").alias("_hit"))
    outcome = (targets.join(present, targets["id"] == present["_hit"], "left")
               .select("id", F.col("_hit").isNotNull().alias("deleted")))
    return remaining, outcome


def resolve_and_delete(catalog: DataFrame, prefixes: DataFrame, col: str = "prefix"
                       ) -> tuple[DataFrame, DataFrame]:
    """Resolve each prefix; delete the ones that name exactly one row."""
    from ..plans.strategies import materialize

    # written once: the delete's size check and its joins then read the resolution, not re-run it
    res = materialize(resolve_prefixes(catalog, prefixes, col), "resolved-prefixes")
    ids = res.where("status = 'one'").select(F.col("matched_id").alias("id"))
    remaining, _ = delete_ids(catalog, ids)
    return remaining, res


def delete_requests(catalog: DataFrame, requests: DataFrame, id_col: str = "id_text"
                    ) -> tuple[DataFrame, DataFrame]:
    """Lookup, then delete the rows of requests with status ok.

    Returns (remaining catalog, outcome per request: status, deleted id, and whether that id is gone from
    the remaining catalog).
    """
    from ..plans.strategies import materialize

    # written once: the delete's size check and its joins then read the lookup, not re-run it
    looked = materialize(lookup(catalog, requests, id_col).select(
        *requests.columns, "id_kind", "status", "resolved_id"), "looked-up")
    ids = looked.where("status = 'ok'").select(F.col("resolved_id").alias("id"))
    remaining, _ = delete_ids(catalog, ids)
    outcome = looked.select(*requests.columns, "id_kind", "status",
                            F.when(F.col("status") == "ok", F.col("resolved_id")).alias("deleted_id"))
    still = restrict(remaining, "id", ids).select(F.col("id").alias("_still")).distinct()
    ok = (outcome.where("status = 'ok'").join(still, F.col("deleted_id") == F.col("_still"), "left")
          .withColumn("gone", F.col("_still").isNull()).drop("_still"))
    other = outcome.where("status <> 'ok'").withColumn("gone", F.lit(None).cast("boolean"))
    return remaining, ok.unionByName(other)


def latest_per_path(catalog: DataFrame, paths: DataFrame | None = None,
                    path_col: str = "pdf_path") -> DataFrame:
    """Newest row per path (ties → larger id); with ``paths`` a left join, ``found`` flag.

    Requested paths are resolved as ingest does (working folder, ``.`` and ``..``) before they are compared.

    ``max_by`` aggregates partially on the map side, so a path holding a large
    share of the catalog costs one row per map task in the shuffle.
    """
    cols = [c for c in STORE_COLUMNS if c != "pdf_path"]
    if paths is not None:
        paths = paths.withColumn("_rp", S.resolved_path(path_col))
        catalog = restrict(catalog, "pdf_path", paths.select("_rp"))
    latest = (catalog.groupBy("pdf_path")
              .agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("_r"))
              .select("pdf_path", "_r.*"))
    latest = normalise(latest)
    if paths is None:
        return latest
    lat = latest.withColumnRenamed("pdf_path", "_lp")
    return (paths.join(lat, paths["_rp"] == lat["_lp"], "left")
            .withColumn("found", F.col("_lp").isNotNull()).drop("_lp", "_rp"))


def usage_rollup(catalog: DataFrame) -> DataFrame:
    """Usage totals by (length, model), per length, and overall (``ROLLUP``)."""
    return (catalog.rollup("length", "model")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count("tokens_in").alias("n_with_usage"),
                 F.sum("tokens_in").alias("sum_tokens_in"),
                 F.sum("tokens_out").alias("sum_tokens_out"),
                 F.sum("latency_ms").alias("sum_latency_ms"),
                 F.max("latency_ms").alias("max_latency_ms"),
                 F.grouping_id().cast("bigint").alias("grouping_level")))
