"""Queries that build files or pages from rows use all cores, however small the table's file is."""

import pytest

from scrivane.plans import catalog

SF = "/root/testdata/sf0.001"


def python_tasks(spark, name):
    """Tasks that run the query's Python, by the jobs of a full read."""
    group = f"tasks-{name}"
    spark.sparkContext.setJobGroup(group, name)
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "other")
    return max((info.numTasks for s in stages if (info := tracker.getStageInfo(s))), default=0)


@pytest.mark.parametrize("name", ["office_slides", "office_sheets", "form_fields_redacted", "markdown_pages", "tables_markdown"])
def test_rows_are_dealt_over_the_cores(spark, name):
    assert python_tasks(spark, name) >= spark.sparkContext.defaultParallelism
