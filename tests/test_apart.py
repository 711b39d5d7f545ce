"""Points near one kept before are found beside it, not by comparing all with all."""

import math
import random
import time

from pyspark.sql import functions as F

from planweave.functions import near
from planweave.operators import place


def away(a, b):
    half = lambda v: math.sin(math.radians(v) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, half(b[0] - a[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(b[1] - a[1]))))


def one_by_one(points, km):
    kept = []
    for i, p in enumerate(points):
        if not (math.isfinite(p[0]) and math.isfinite(p[1]) and any(away(points[j], p) <= km for j in kept if math.isfinite(points[j][0]) and math.isfinite(points[j][1]))):
            kept.append(i)
    return kept


def test_the_same_points_are_kept_as_one_by_one():
    import numpy as np

    rng = random.Random(3)
    towns = [(33 + rng.random() * 0.4, -84 + rng.random() * 0.4) for _ in range(300)]
    poles = [(rng.choice([-1, 1]) * (89.9 + rng.random() * 0.1), rng.uniform(-180, 180)) for _ in range(100)]
    seam = [(rng.random() * 0.3, rng.choice([-180.0, 180.0]) + rng.uniform(-0.1, 0.1)) for _ in range(100)]
    points = [*towns, *poles, *seam, *towns[:20], (math.nan, 1.0), (math.nan, 1.0), (2.0, math.inf)]
    rng.shuffle(points)
    lat, lng = np.array(points).T
    for km in (0.0, 0.05, 3.0, 40.0, 30_000.0):
        assert near.apart(lat, lng, km) == one_by_one(points, km), km


def test_many_points_of_a_name_are_deduplicated_in_time(spark):
    at = F.struct(F.col("id").alias("k"), (30 + F.col("id") % 211 * 0.02).alias("lat"), (-90 + F.col("id") % 223 * 0.02).alias("lng"))
    rows = spark.range(40_000).repartition(2).groupBy((F.col("id") % 2).alias("g")).agg(F.sort_array(F.collect_list(at)).alias("points"))
    began = time.time()
    kept = rows.select(F.size(place.dedupe_points(F.col("points"), "struct<k: bigint, lat: double, lng: double>")).alias("n")).collect()
    assert time.time() - began < 20 and all(1000 < r.n < 20_000 for r in kept)  # 400 million distances one by one
    none = rows.select(F.size(place.dedupe_points(F.when(F.col("g") < 0, F.col("points")), "struct<k: bigint, lat: double, lng: double>")).alias("n"))
    assert [r.n for r in none.collect()] == [None, None]
