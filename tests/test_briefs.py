"""Lists of pairs grow with the square of the projects: those that stored briefs are joined with are searched once, and sent to no driver."""

import pytest
from pyspark.sql import functions as F

from planweave.operators import pairs, resolve, views
from planweave.plans import registry
from planweave.plans.fixtures import AS_OF, projects
from planweave.plans.fixtures import registry as owners

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["brief_outcomes", "pairs_with_briefs"])
def test_pairs_are_searched_once(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "MapInArrow" not in text  # pairs are read as stored, not searched again by each step
    assert "SortMergeJoin [pair_id" in text and "BroadcastHashJoin [pair_id" not in text


def test_pairs_not_there_yet_are_not_broadcast(spark):
    now = pairs.overlaps(projects(spark, SF), AS_OF, registry=owners(spark, SF), facts=(), values=("pair_id", "a_id", "b_id", "exact_miles", "overlap_days"))
    briefs = now.withColumns({"miles": F.col("exact_miles"), "radius": F.lit(10)}).drop("exact_miles")
    assert "BroadcastHashJoin [pair_id" not in plan(resolve.briefs_of(now, briefs.select("pair_id", "radius")))
    changed = projects(spark, SF).where("id % 3 = 0").select("id")
    assert "BroadcastHashJoin [pair_id" not in plan(views.check_briefs(now, briefs, changed))


def test_a_brief_of_two_changed_projects_is_checked_once(spark):
    now = spark.createDataFrame([("1-2", 1, 2, 3.0, 40), ("1-3", 1, 3, 4.0, 40), ("3-4", 3, 4, 5.0, 40)], "pair_id string, a_id long, b_id long, exact_miles double, overlap_days int")
    briefs = spark.createDataFrame([("1-2", 1, 2, 3.0, 40, 10), ("1-3", 1, 3, 4.5, 40, 10), ("3-4", 3, 4, 5.0, 40, 10), ("2-9", 2, 9, 1.0, 40, 10)], "pair_id string, a_id long, b_id long, miles double, overlap_days int, radius int")
    got = views.check_briefs(now, briefs, spark.createDataFrame([(1,), (2,), (2,)], "id long"))
    assert sorted((r.pair_id, r.outcome) for r in got.collect()) == [("1-2", "kept"), ("1-3", "updated"), ("2-9", "invalidated")]
