"""Shapes of the physical plans."""

import contextlib
import io
import re

import pytest

from shelfvoice.plans.catalog import queries

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Scan ExistingRDD")


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries()[name](spark, SF).explain()
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    ["process_reviews_file_order", "group_stats_brand", "word_freq", "category_flags", "keyword_frequency", "chunk_text"],
)
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert not any(node in text for node in PYTHON_NODES)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_file_order_ids_do_not_shuffle_reviews(spark):
    text = plan(spark, "process_reviews_file_order")
    scanned = text[: text.index("o_custkey")].count("Exchange")
    assert scanned == 0 and "SortMergeJoin" not in text


def test_flags_scan_the_text_once(spark):
    assert len(re.findall(r"FileScan.*documents", plan(spark, "category_flags"))) == 1


def test_keywords_are_matched_once(spark):
    final = plan(spark, "keyword_frequency").split("Initial Plan")[0].lower()
    assert final.count("contains(_low") == 1 and "contains(lower" not in final


def test_scan_reads_only_what_is_used(spark):
    schema = re.search(r"lineitem.*?ReadSchema: struct<(.*?)>", plan(spark, "trend_asin")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_quantity", "l_shipdate"}


def test_top_words_is_a_bounded_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_words")


def test_months_are_written_after_grouping(spark):
    final = plan(spark, "trend_brand").split("Initial Plan")[0]
    assert final.count("date_format(") <= 1 and "trunc(Date" in final or "_groupingexpression" in final
