"""What the plans must look like: pruned scans, top-k instead of sorts, no products of tables."""

import re

import pytest

from scrivane.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that join single rows (counts) to a table, by name.
SINGLE_ROWS = {"chunk_digests", "chunk_search", "chunk_search_page2", "page_scales", "resume_state"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_products_and_no_row_functions(spark, name):
    if name.startswith("stream_") or name in ("file_scan", "resume_state"):
        pytest.skip("runs while it is built")
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython " not in text  # a table function of SQL is its own kind
    assert "BroadcastNestedLoopJoin" not in text or name in SINGLE_ROWS


@pytest.mark.parametrize("name, columns", [
    ("lang_source_cube", {"lang", "source", "n_chars"}), ("page_titles", {"page_id", "html"}), ("event_windows", {"ts", "event_type", "value"}), ("media_store", {"doc_id", "text", "source"}), ("link_hosts", {"url", "html"}), ("user_ranks", {"user_id", "event_type"}),
])
def test_scans_read_what_is_needed(spark, name, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.QUERIES[name](spark, SF))):
        read |= {c.split(":")[0] for c in schema.split(",") if c}
    assert read == columns


@pytest.mark.parametrize("name", ["failed_requests_top", "worst_tokens", "chunk_search"])
def test_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["page_titles", "clean_text", "escape_cells", "media_times", "event_sessions", "section_ends", "step_timeline", "lang_source_cube", "media_store", "parity_set", "calendar_dates", "ip_policy"])
def test_native_queries_stay_in_the_jvm(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text


def test_partial_aggregation_comes_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["media_store"](spark, SF))
    assert "partial_count" in text


def test_grid_join_is_an_equi_join(spark):
    text = plan(catalog.QUERIES["overprinted"](spark, SF))
    assert "SortMergeJoin" in text or "BroadcastHashJoin" in text or "ShuffledHashJoin" in text
