"""Landed content in one small file is parsed by as many tasks as its rows need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sunledger.operators.staging import spread
from sunledger.plans import catalogue, screens


@pytest.fixture(scope="module")
def one_file(spark, sf_dir, tmp_path_factory):
    """The parts, twice, in one file."""
    folder = tmp_path_factory.mktemp("one")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_tasks_follow_rows(spark):
    rows = spark.range(1000).coalesce(1)
    dealt = spread(rows, "id", 50)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 1000
    assert spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_snapshots_are_decoded_by_many_tasks(spark, one_file):
    assert "REPARTITION_BY_NUM" in screens.snapshot_projects(spark, one_file)._jdf.queryExecution().toString()
    assert catalogue.landing(spark, one_file).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def times(query, pattern):
    """How often a plan works a pattern out."""
    return query._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_dates_of_sections_are_looked_for_once(spark, sf_dir):
    sections = catalogue.markdown_sections(spark, sf_dir)
    assert times(sections, "[A-Za-z]+ \\d{1,2},? \\d{4}") == 1 and times(sections, "#{1,3} ([^") == 1


def test_fields_of_items_are_looked_for_once(spark, sf_dir):
    """A field's pattern has its tag twice, and is asked for three times at most (two groups, one of them twice)."""
    items = catalogue.rss_items(spark, sf_dir)
    assert times(items, "<title[^>]*>") <= 6 and times(items, "<description[^>]*>") <= 6 and times(items, "<pubDate[^>]*>") == 1


@pytest.mark.parametrize("name", ["newsletter_index", "newsletter_sections", "newsletter_projects"])
def test_first_ones_of_a_newsletter_need_no_shuffle_of_texts(spark, one_file, name):
    """Newsletters are dealt before their texts are put together, and what is first in each is found where it lies."""
    plan = catalogue.QUERIES[name](spark, one_file)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_index_pages_are_read_once(spark, sf_dir):
    """Blocks and links come from one pass over the pages, and a page isn't searched again for each of its links."""
    found = screens.newsletter_index(spark, sf_dir)
    assert times(found, "Relation [") == 1 and times(found, "instr(") == 0 and times(found, "MMMM") == 2


def test_sections_are_sorted_without_their_text(spark, sf_dir):
    """What is sorted to find the first of a name is 700 characters of a section at most, and its capacity is looked for once."""
    sections = screens.newsletter_sections(spark, sf_dir)
    sort = next(x for x in sections._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1].split("\n")[1:] if "Project [" in x)
    assert "body#" in sort and "section#" not in sort
    assert times(sections, "gigawatt") <= 5 and times(sections, "PROJECT UPDATE):") == 1


def test_newsletters_and_answers_meet_without_a_join(spark, sf_dir):
    """Newsletters are parsed once, and neither side of them is broadcast or sorted for a join."""
    plan = screens.newsletter_projects(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 2 and plan.count("Sort [") == 3
