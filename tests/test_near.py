"""Pairs are searched in the task by what they are judged by; each carries only the columns that are wanted, and a project is in few cells."""

import random

from pyspark.sql import functions as F

from planweave.functions import geo, near, owners
from planweave.operators import pairs

SHAPES = "id long, utility string, lat1 double, lng1 double, lat2 double, lng2 double, more string"


def made(spark, n=400):
    rng = random.Random(5)
    spot = [(33 + rng.random(), -84 + rng.random()) for _ in range(n)]
    ends = [(y + rng.uniform(-0.2, 0.2), x + rng.uniform(-0.2, 0.2)) if i % 3 == 0 else (y, x) for i, (y, x) in enumerate(spot)]
    ends[3] = (spot[3][0] + 3.0, spot[3][1] - 4.0)
    rows = [(i, None if i == 7 else f"U{i % 5}", *spot[i], *ends[i], "m" * 50) for i in range(n)]
    return spark.createDataFrame(rows, SHAPES)


def test_a_task_finds_what_all_pairs_hold(spark, monkeypatch):
    df = made(spark)
    a, b = pairs.prefixed(df, "a"), pairs.prefixed(df, "b")
    every = geo.with_metres(a.join(b, (F.col("a_id") < F.col("b_id")) & (F.col("a_utility") != F.col("b_utility")))).where(F.col("metres") <= pairs.RADIUS_M)
    want = {(r.a_id, r.b_id): round(r.metres, 3) for r in every.collect()}
    found = pairs.candidate_pairs(df, wanted=("id",))
    assert found.columns == ["a_id", "b_id", "metres"]  # nothing else leaves the task
    rows = found.collect()
    assert {(r.a_id, r.b_id): round(r.metres, 3) for r in rows} == want and len(rows) == len(want) > 5_000


def test_cells_cut_in_batches_are_put_together():
    import pyarrow as pa

    cells = [1] * 5 + [2] * 1 + [3] * 9 + [4] * 2
    batches = pa.table({"in_": cells, "x": list(range(len(cells)))}).to_batches(max_chunksize=3)
    kept, near.ROWS = near.ROWS, 2
    try:
        got = [t.to_pydict() for t in near.whole_cells(iter(batches))]
    finally:
        near.ROWS = kept
    assert [x for t in got for x in t["x"]] == list(range(len(cells))) and len(got) > 1
    assert sum(len(set(t["in_"])) for t in got) == 4


def test_a_project_is_shuffled_to_few_cells(spark):
    points = spark.range(2000).selectExpr("id", "25 + (id * 7919 % 1009) / 1009 * 20 AS lat1", "-110 + (id * 31337 % 2003) / 2003 * 40 AS lng1").selectExpr("*", "lat1 AS lat2", "lng1 AS lng2")
    unit = pairs.cell_unit([points], pairs.RADIUS_M)
    assert pairs.cells(points, pairs.RADIUS_M, unit).count() < 2000 * 5


def test_owners_are_judged_alike_in_tasks(spark):
    names = ["Georgia Power", "Alabama Power", "FPL", "Big Creek Solar", "Big Sky Wind", "Atlas Solar IV", "Atlas BESS IV", "UNKNOWN", "DEF/SEC", "Duke Energy Florida", "Solar 4", "TVA"]
    full = pairs.with_owners(spark.createDataFrame([(n,) for n in names], "utility string"))
    own = {r.utility: r.asDict() for r in full.collect()}
    both = pairs.prefixed(full, "a").crossJoin(pairs.prefixed(full, "b")).select("a_utility", "b_utility", owners.different_companies("a", "b").alias("differ")).collect()
    assert all(near.unlike_owners(own[r.a_utility], own[r.b_utility]) == r.differ for r in both) and len({r.differ for r in both}) == 2
