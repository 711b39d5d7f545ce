import datetime

from pyspark.sql import functions as F

from planweave.functions import dates, geo, owners, score
from planweave.operators import pairs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(text):
    return F.lit(text).cast("date")


def test_windows_of_in_service_dates(spark):
    a = dates.build_window(F.lit(None).cast("date"), day("2025-12-31"), F.lit(None).cast("string"), F.lit("day"))
    b = dates.build_window(F.lit(None).cast("date"), day("2026-06-01"), F.lit(None).cast("string"), F.lit("day"))
    got = {k: one(spark, c) for k, c in dates.compare(*a, *b).items()}
    assert got["gap_days"] == 152 and got["window_start"] == datetime.date(2025, 6, 1) and got["window_end"] == datetime.date(2025, 12, 31)
    assert abs(got["ratio"] - 214 / 518) < 1e-12


def test_spellings_of_dates(spark):
    for text, want in {"Apr 15, 2026": ("2026-04-15", "day"), "Q3 2026": ("2026-07-01", "quarter"), "2Q 2026": ("2026-04-01", "quarter"), "FY 2027": ("2027-01-01", "year"), "sept 2026": ("2026-09-01", "month"), "2026-02-30": (None, None), "soon": (None, None)}.items():
        d, p = dates.parse_partial_date(F.lit(text))
        assert (str(one(spark, d)) if want[0] else one(spark, d), one(spark, p)) == want


def test_lines_that_cross_touch(spark):
    rows = [(1, "A", 33.0, -82.0, 33.0, -81.36), (2, "B", 32.9, -81.5, 33.1, -81.5), (3, "C", 33.018, -81.99, 33.018, -81.99), (4, "D", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, utility string, lat1 double, lng1 double, lat2 double, lng2 double")
    got = {(r.a_id, r.b_id): r.metres for r in pairs.candidate_pairs(df).collect()}
    assert got[1, 2] == 0 and 1800 < got[1, 3] < 2300
    assert one(spark, score.band(F.lit(0.0))) == "touching" and one(spark, score.tier(F.lit("under_8"))) == 2
    assert abs(one(spark, geo.point_distance(F.lit(33.0), F.lit(-82.0), F.lit(34.0), F.lit(-82.0))) - 110_904) < 50


def test_names_of_companies(spark):
    want = {"def-sec": "Duke Energy Florida / Seminole Electric Cooperative", "CITY OF OCALA": "City of Ocala", "TVA": "TVA", "n/a": None, "Wolverine Power Supply-X": "Wolverine Power Supply-X", "JEA/ unknown": "JEA"}
    for raw, name in want.items():
        assert one(spark, owners.canonical_utility(F.lit(raw))) == name, raw


def test_a_grid_join_loses_no_pair(spark):
    import random

    rng = random.Random(2)
    rows = [(i, f"U{i % 3}", 39.5 + rng.random(), -77.5 + rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, utility string, lat1 double, lng1 double").selectExpr("*", "lat1 AS lat2", "lng1 AS lng2")
    got = {(r.a_id, r.b_id) for r in pairs.candidate_pairs(df).select("a_id", "b_id").collect()}
    a, b = pairs.prefixed(df, "a"), pairs.prefixed(df, "b")
    every = geo.with_metres(a.join(b, (F.col("a_id") < F.col("b_id")) & (F.col("a_utility") != F.col("b_utility")))).where(F.col("metres") <= pairs.RADIUS_M)
    assert got == {(r.a_id, r.b_id) for r in every.collect()} and len(got) > 100


def test_parallel_routes_share_their_length(spark):
    from planweave.functions import corridor

    rows = [(1, "A", 33.0, -82.0, 33.0, -81.68), (2, "B", 33.005, -82.0, 33.005, -81.68), (3, "C", 33.5, -82.0, 32.5, -82.0)]
    df = spark.createDataFrame(rows, "id long, utility string, lat1 double, lng1 double, lat2 double, lng2 double")
    found = pairs.candidate_pairs(df, corridor.STRIP_M)
    for stage in corridor.shared_km("a", "b"):
        found = found.withColumns({k: F.expr(v) for k, v in stage.items()})
    got = {(r.a_id, r.b_id): r.shared_km for r in found.collect()}
    assert 28 < got[1, 2] < 31 and abs(got[1, 3] - 1.6) < 0.01


def test_names_in_title_case(spark):
    want = {
        "MCDONOUGH - OLA 230KV LINE": "McDonough - Ola 230kV Line", "LOOP IN 500/230KV (FPL)": "Loop In 500/230kV (FPL)", "LG&E AND KU": "LG&E and KU",
        "GOSHEN (SAV) - MCINTOSH": "Goshen (SAV) - McIntosh", "ATLAS BESS IV": "Atlas BESS IV", "201LC 8ME": "201LC 8ME", "CVE US NY RIVERHEAD 215": "CVE US NY Riverhead 215",
        "CITY OF BELLEVILLE - (KS)": "City of Belleville - (KS)", "SOLAR1 PROJECT2 TS25-422": "Solar1 Project2 TS25-422", "3RD ST - 31ST AVE": "3rd St - 31st Ave",
        "O'BANNION SMITH'S FT MYERS": "O'Bannion Smith's Ft Myers", "LA GRANGE - EL DORADO": "La Grange - El Dorado", "NEXTERA ENERGY RESOURCES - ERCOT": "NextEra Energy Resources - ERCOT",
        "8ME SOLAR 1ST": "8ME Solar 1st", "BLVD POWER": "Blvd Power",
    }
    rows = spark.createDataFrame(list(want.items()), "raw string, name string").withColumn("got", owners.title_case(F.col("raw")))
    rows = rows.withColumn("again", owners.title_case(F.col("got")))
    assert [(r.raw, r.got, r.again) for r in rows.collect()] == [(k, v, v) for k, v in want.items()]


def test_canonical_names_keep_their_parents(spark):
    want = {
        "CITY OF COLORADO SPRINGS - (CO)": "City of Colorado Springs - (CO)", "Enbridge Solar (Sequoia II) LLC": "Enbridge Solar (Sequoia II)", "Atlas BESS IV, LLC": "Atlas BESS IV",
        "SCANA Corporation": "SCANA", "NextEra Energy Resources - ERCOT, LLC": "NextEra Energy Resources - ERCOT", "Met-Ed": "Met-Ed", "TVA": "TVA", "NEXTERA ENERGY RESOURCES, LLC": "NextEra Energy Resources",
        "Acmex, L.L.C.": "Acmex", "JEA/FPL": "JEA / Florida Power & Light",
    }
    rows = spark.createDataFrame(list(want.items()), "raw string, name string").select("raw", owners.canonical_utility(F.col("raw")).alias("got"))
    assert {r.raw: r.got for r in rows.collect()} == want
    assert one(spark, owners.family_parent(owners.canonical_utility(F.lit("NEXTERA ENERGY RESOURCES, LLC")))) == "NextEra Energy"
