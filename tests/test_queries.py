"""A selection of registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tomewright import plans

CHOSEN = (
    "bm25_files", "bm25_chunk_scores", "hybrid_search", "rrf_retrieve", "hash_embed", "extract_keywords", "list_files_page",
    "folder_tree_rollup", "acl_allowed", "effective_permission", "quota_greedy", "upsert_latest", "daily_trend_zero_fill",
    "html_to_text", "split_sentences", "normalize_tags", "events_daily_window", "think_stream", "export_paths",
    "hybrid_vector", "vector_only", "search_page", "search_exts", "hybrid_search_acl", "retrieve_allowed", "retrieve_scoped",
    "events_running_counters", "breadcrumb_recursive", "descendants", "null_safe_equal", "workspace_permission", "my_workspaces",
    "share_by_token", "tag_rename_delete", "audit_append", "load_missing", "sibling_sort", "label_maps", "stamps", "short_sizes",
    "sse_lines", "meta_merge", "vector_pack",
)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "%.6g" % v if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    assert rows(plans.queries()[name](spark, sf).toPandas()) == rows(con.execute(plans.oracle_sql()[name]).df())


def test_sizes_of_large_keys_equal_sql(spark, tmp_path):
    """Keys whose size is half a unit of the last decimal by its shortest digits, some exactly so; and none."""
    keys = (None, 0, 1, 3, 101, 1221523, 1403983, 2320543, 4517527, 5606157, 7890128, 8203540, 8887088, 9384500)
    con = duckdb.connect()
    con.execute("create table orders as select unnest(?::bigint[]) as o_orderkey", [list(keys)])
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    want = con.execute(plans.oracle_sql()["format_bytes"]).fetchall()
    got = [tuple(r) for r in plans.queries()["format_bytes"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (None, None) in got


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
