"""Cells are as narrow as a small radius and the shapes allow; equal questions are answered once."""

import random

from pyspark.sql import functions as F

from planweave.operators import pairs, similar


def test_a_small_radius_gets_small_cells(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, f"U{i % 5}", 60 + rng.random() * 0.5, -84 + rng.random() * 0.5) for i in range(900)]
    ends = [(0.0, 0.0) if i % 9 else (rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)) for i in range(900)]
    shapes = [(*r, r[2] + dy, r[3] + dx) for r, (dy, dx) in zip(rows, ends)] + [(1000, "U1", 60.1, -84.1, None, None), (1001, "U2", None, None, None, None)]
    df = spark.createDataFrame(shapes, "id long, utility string, lat1 double, lng1 double, lat2 double, lng2 double")
    units, cells = [], pairs.cells

    def watched(own, pad_m, unit_m):
        units.append(unit_m)
        return cells(own, pad_m, unit_m)

    monkeypatch.setattr(pairs, "cells", watched)
    met = lambda radius: {(r.a_id, r.b_id) for r in pairs.candidate_pairs(df, radius).select("a_id", "b_id").collect()}
    small = {radius: met(radius) for radius in (0.0, 900.0, 8000.0)}
    assert max(units) < pairs.RADIUS_M / 2
    monkeypatch.setattr(pairs, "cell_unit", lambda shapes, radius: pairs.RADIUS_M)
    assert {radius: met(radius) for radius in small} == small and all(small.values())


def test_equal_questions_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(similar, "best_run", lambda own, asked: F.rand(3) + 1)
    asked = spark.createDataFrame([(i, "tomasville boston" if i % 2 else "Boston, tomasville") for i in range(60)], "id int, q string")
    names = spark.createDataFrame([("Thomasville - Boston Rebuild",), ("Boston Tomasville",)], "name string")
    got = similar.word_similarity_join(asked, names)
    assert got.count() == 120 and got.groupBy("name").agg(F.countDistinct("similarity").alias("n")).where("n > 1").count() == 0
