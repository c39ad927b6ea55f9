"""The driver contract of __spark_entry__.py."""
import re

import __spark_entry__ as E

ROWS_ONLY: set[str] = set()


def own(named: dict) -> dict:
    """Without the queries of the optional subpackage, which has tests of its own."""
    return {k: v for k, v in named.items() if k != "pipeline" and not re.match(r"op\d+_", k)}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 200 and df.columns == ["doc_id", "length", "summary", "n_sentences", "summary_chars"]


def test_every_query_has_oracle_or_is_rows_only():
    q, sql = own(E.queries()), own(E.oracle_sql())
    assert set(sql) <= set(q)
    assert set(q) - set(sql) == ROWS_ONLY


def test_all_queries_run_on_smallest_data(spark):
    from .conftest import SF

    for name, fn in own(E.queries()).items():
        df = fn(spark, SF)
        assert df.columns, name
        df.limit(1).collect()


# single-partition exchanges that are bounded by design: the per-partition offsets of the global
# position (one row per partition) and the item limit (a top-n is the feature)
SINGLE_PARTITION_OK = {"list_summaries", "list_view", "list_view_full_id", "limit_items"}


def test_plans_have_no_cross_joins_or_single_partition_bottlenecks(spark):
    from .conftest import SF

    for name, fn in own(E.queries()).items():
        if name in ("ingest_files", "stream_ingest"):
            continue  # these write files and run a stream while being built
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        if name not in SINGLE_PARTITION_OK:
            assert "SinglePartition" not in plan, name
