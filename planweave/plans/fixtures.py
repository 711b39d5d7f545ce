"""Planned projects derived from the orders table, by integer and double arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = [
    "FPL", "Florida Power and Light Co.", "Gulf Power", "Georgia Power", "georgia power co.", "Southern Company", "Alabama Power", "DESC",
    "Dominion Energy South Carolina", "SCANA Corporation", "DEF/SEC", "DEF-SEC", "Duke Energy Florida, LLC", "Duke Energy Progress - (SC)", "JEA", "TVA",
    "Tennessee Valley Authority", "FRP Miller Solar", "Atlas Solar IV", "Atlas BESS IV", "Big Creek Solar", "Big Sky Wind", "UNKNOWN", "Seminole Electric Cooperative, Inc.",
]
STATES = "AL FL GA KY MO MS NC OK SC TN VA TX".split()
PLACES = "Jasper Okatie Goshen McIntosh Valdosta Quitman Thomasville Boston Adamsville Grady Hammond Kraft Evans Thurmond Winder Yemassee".split()
TYPES = ["substation", "transmission line", "generation"]
KV = [None, 69, 115, 138, 230, 345, 500]
PRECISIONS = ["year", "quarter", "month", "day"]
AS_OF = "2031-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned project per order: company, place or route, dates with precision, cost, review state."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("od"), "o_orderstatus", "o_totalprice")
    k, c = F.col("k"), F.col("c")
    lat = 25 + ((k * 7919 + c * 104729) % 100003) / F.lit(100003.0) * 20
    lng = -120 + ((k * 15485863 + c * 32452843) % 100019) / F.lit(100019.0) * 45
    o = o.withColumns({"p_lat": lat, "p_lng": lng})
    routed = (k % 5 == 0) & (k % 29 != 0)
    o = o.withColumns({"r_lat2": F.when(routed, F.col("p_lat") + ((k * 31) % 101 - 50) / F.lit(250.0)), "r_lng2": F.when(routed, F.col("p_lng") + ((k * 37) % 101 - 50) / F.lit(250.0))})
    place = lambda p, r: F.when(k % 29 == 0, None).when(routed, (F.col(p) + F.col(r)) / 2).otherwise(F.col(p))
    end = F.when(k % 31 != 0, F.date_add("od", 12053))
    start = F.when((k % 31 == 0) | (k % 3 == 1), None).when(k % 3 == 0, F.date_add("od", (12053 - (k * 13) % 400).cast("int"))).otherwise(F.date_add("od", 12053))
    o = o.withColumns({"lat": place("p_lat", "r_lat2"), "lng": place("p_lng", "r_lng2"), "end_date": end, "start_date": start})
    precision = pick(PRECISIONS, k % 4)
    return o.select(
        (k + 1).alias("id"), F.concat(F.lit("src"), (k % 6).cast("string")).alias("source_key"), pick(NAMES, c % 24).alias("utility"),
        F.when(k % 11 != 0, pick(STATES, c % 12)).alias("state"),
        F.concat(pick(PLACES, k % 16), F.lit(" - "), pick(PLACES, (k + c) % 16), F.lit(" Rebuild")).alias("name"),
        F.concat(pick(PLACES, k % 16), F.lit(" ("), pick(STATES, c % 12), F.lit("/"), pick(STATES, (c + 5) % 12), F.lit(")")).alias("location_ref"),
        F.when(k % 7 != 0, pick(TYPES, k % 3)).alias("type"), pick(KV, c % 7).cast("int").alias("voltage_kv"),
        F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") * 100).cast("long")).alias("cost_usd"),
        "lat", "lng",
        F.when(k % 29 != 0, F.col("p_lat")).alias("lat1"), F.when(k % 29 != 0, F.col("p_lng")).alias("lng1"),
        F.when(k % 29 != 0, F.coalesce("r_lat2", "p_lat")).alias("lat2"), F.when(k % 29 != 0, F.coalesce("r_lng2", "p_lng")).alias("lng2"), routed.alias("routed"),
        "start_date", "end_date", F.when(F.col("start_date").isNotNull(), precision).alias("start_precision"), F.when(F.col("end_date").isNotNull(), precision).alias("end_precision"),
        ((k % 101) / F.lit(100.0)).alias("confidence"), (1 + k % 120).alias("source_page"), (k % 6 == 0).alias("reviewed"), (k % 4 == 1).alias("approximate"), (k % 29 == 0).alias("requires_review"),
    )


#: What an audit of the companies of ``NAMES`` found, by their place: corporate group, or review.
AUDIT = {14: "JEA", 15: "TVA", 17: "NextEra Energy", 23: "Seminole Electric Cooperative"}


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited owners out of the nations: a row for each company that the audit settled, and former rows that hold no more."""
    k = F.col("n_nationkey")
    group = F.coalesce(*[F.when(k == i, F.lit(g)) for i, g in AUDIT.items()])
    own = table(spark, sf_dir, "nation").where(k < len(NAMES)).select(k.alias("k"), pick(NAMES, k).alias("utility"), group.alias("corporate_group"))
    now = own.where("corporate_group IS NOT NULL").select("utility", "corporate_group", F.lit("verified").alias("status"), F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    former = own.select("utility", F.lit("Former Holdings").alias("corporate_group"), F.when(F.col("k") % 2 == 0, "verified").otherwise("review").alias("status"), F.lit("2001-01-01").cast("date").alias("valid_from"), F.lit("2010-01-01").cast("date").alias("valid_to"))
    return now.unionByName(former)


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"


PROJECTS_SQL = f"""
o0 AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS od, o_orderstatus, o_totalprice,
  25+((o_orderkey*7919+o_custkey*104729)%100003)/CAST(100003 AS DOUBLE)*20 AS p_lat,
  -120+((o_orderkey*15485863+o_custkey*32452843)%100019)/CAST(100019 AS DOUBLE)*45 AS p_lng,
  (o_orderkey%5=0 AND o_orderkey%29<>0) AS routed FROM orders),
o1 AS (SELECT *, CASE WHEN routed THEN p_lat+((k*31)%101-50)/CAST(250 AS DOUBLE) END AS r_lat2,
  CASE WHEN routed THEN p_lng+((k*37)%101-50)/CAST(250 AS DOUBLE) END AS r_lng2 FROM o0),
projects AS (SELECT k+1 AS id, 'src' || (k%6) AS source_key, list_extract({_list(NAMES)}, CAST(c%24+1 AS INT)) AS utility,
  CASE WHEN k%11<>0 THEN list_extract({_list(STATES)}, CAST(c%12+1 AS INT)) END AS state,
  list_extract({_list(PLACES)}, CAST(k%16+1 AS INT)) || ' - ' || list_extract({_list(PLACES)}, CAST((k+c)%16+1 AS INT)) || ' Rebuild' AS name,
  list_extract({_list(PLACES)}, CAST(k%16+1 AS INT)) || ' (' || list_extract({_list(STATES)}, CAST(c%12+1 AS INT)) || '/' || list_extract({_list(STATES)}, CAST((c+5)%12+1 AS INT)) || ')' AS location_ref,
  CASE WHEN k%7<>0 THEN list_extract({_list(TYPES)}, CAST(k%3+1 AS INT)) END AS type, list_extract({_list(KV)}, CAST(c%7+1 AS INT)) AS voltage_kv,
  CASE WHEN o_orderstatus='F' THEN CAST(floor(o_totalprice*100) AS BIGINT) END AS cost_usd,
  CASE WHEN k%29=0 THEN NULL WHEN routed THEN (p_lat+r_lat2)/2 ELSE p_lat END AS lat, CASE WHEN k%29=0 THEN NULL WHEN routed THEN (p_lng+r_lng2)/2 ELSE p_lng END AS lng,
  CASE WHEN k%29<>0 THEN p_lat END AS lat1, CASE WHEN k%29<>0 THEN p_lng END AS lng1,
  CASE WHEN k%29<>0 THEN coalesce(r_lat2, p_lat) END AS lat2, CASE WHEN k%29<>0 THEN coalesce(r_lng2, p_lng) END AS lng2, routed,
  CASE WHEN k%31=0 OR k%3=1 THEN NULL WHEN k%3=0 THEN od+CAST(12053-(k*13)%400 AS INT) ELSE od+12053 END AS start_date,
  CASE WHEN k%31<>0 THEN od+12053 END AS end_date,
  CASE WHEN NOT (k%31=0 OR k%3=1) THEN list_extract({_list(PRECISIONS)}, CAST(k%4+1 AS INT)) END AS start_precision,
  CASE WHEN k%31<>0 THEN list_extract({_list(PRECISIONS)}, CAST(k%4+1 AS INT)) END AS end_precision,
  (k%101)/CAST(100 AS DOUBLE) AS confidence, 1+k%120 AS source_page, k%6=0 AS reviewed, k%4=1 AS approximate, k%29=0 AS requires_review FROM o1)
"""
