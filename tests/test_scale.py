"""What queries do as tables grow: how often they read and shuffle, and over how many tasks they deal what a task has to compute."""

import re

import pytest
from pyspark.sql import functions as F

from clausewright.operators import rows as R
from clausewright.queries import QUERIES
from clausewright.queries.tables import parted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "shuffles"), [("varied_agreements", 3), ("varied_agreement_errors", 1)])
def test_agreements_are_computed_once(spark, sf, name, shuffles):
    """Each row was computed for its ancestors, their rows and their join, from eight reads of the orders."""
    text = plan(QUERIES[name](spark, sf))
    assert text.count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning", text)) == shuffles


def test_ancestors_of_deep_and_unplaced_items(spark):
    deep = "(a)(i)(A)(1)(x)(I)(B)"
    paths = ["(a)", "(a)(i)", "(a)(i)(A)", "(a)(i)(A)(1)", "(a)(i)(A)(1)(x)", "(a)(i)(A)(1)(x)(I)", deep]
    rows = [("d", 0, n, p, f"t{n}") for n, p in enumerate(paths)] + [("d", None, 9, "(a)(i)", "no block"), ("d", 1, 10, "(a)(i)", "alone"), ("d", 1, 11, None, "plain")]
    df = spark.createDataFrame(rows, "doc_id string, text_block_id int, pos long, list_id string, text string")
    got = {r.pos: (r.parent_list_ids, r.parent_list) for r in R.nearest_ancestors(df, by=["doc_id", "text_block_id"]).collect()}
    assert got[6] == (paths[:6], ": ".join(f"t{n}" for n in range(6))) and len(got) == 10
    assert got[9] == got[10] == got[11] == (None, None)


def test_shares_grow_with_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    assert parted(df, rows=100).rdd.getNumPartitions() == 10 and parted(df, "k", rows=10_000).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["numbered_items", "varied_lists", "varied_lists_across_texts", "list_numbering", "varied_blocks", "varied_section_values", "block_segments", "window_tags", "sentences_by_learned", "pdf_page_tokens", "word_tables"])
def test_rows_are_dealt_by_their_number(spark, sf, name):
    """A small file was one task, and partitions stayed as many however long the table."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf))


def test_grids_are_read_once(spark, sf):
    """Heads and last lines were made by two more reads of the lines."""
    assert plan(QUERIES["word_tables"](spark, sf)).count("FileScan") == 1


def test_words_are_swept_where_their_order_lies(spark, sf):
    """Words, their rows, parts and cells were shuffled by page and sorted for each step; only tables go to their document now."""
    text = plan(QUERIES["word_tables"](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2 and text.count("Window [") == 3


def test_rows_of_agreements_are_sorted_for_few_steps(spark, sf):
    """There were thirteen sorts and twenty windows, most of them over the same documents in the same order."""
    text = plan(QUERIES["varied_agreements"](spark, sf))
    assert text.count("Sort [") <= 9 and text.count("Window [") <= 12


def test_fills_of_several_gates(spark):
    df = spark.createDataFrame([(1, n, a, b) for n, a, b in [(1, "x", None), (2, None, "y"), (3, None, None), (4, "z", None)]], "d int, n int, a string, b string")
    got = R.forward_fills(df, {"a": F.col("n") < 3, "b": F.col("n") > 1}, by=["d"], order=["n"])
    assert [(r.a, r.b) for r in got.orderBy("n").collect()] == [("x", None), ("x", "y"), (None, "y"), ("z", "y")]
