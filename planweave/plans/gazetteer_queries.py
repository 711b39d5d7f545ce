"""Registered queries over gazetteers, published plans and evidence of operation, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs, place
from ..sources import gazetteers
from .fixtures import AS_OF, PLACES, PROJECTS_SQL, STATES, pick, projects, table
from .pair_queries import WINDOWS_SQL

WITH = f"WITH {PROJECTS_SQL} "


def power_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features out of answers of a map server, one a state; some without a name or a place, some placed by their centre."""
    p = F.col("p_partkey")
    name = F.when(p % 7 == 0, None).when(p % 11 == 0, " ").otherwise(F.concat(F.lit(" "), pick(PLACES, p % 16), F.lit(" "), p.cast("string")))
    tags = F.map_from_arrays(F.array(F.lit("name"), F.lit("power")), F.array(name, F.when(p % 3 == 0, "plant").otherwise("substation")))
    lat, lon = 30 + p % 100 / 7.0, -90 + p % 90 / 11.0
    center = F.struct(lat.alias("lat"), lon.alias("lon"))
    element = F.when(p % 5 == 0, F.to_json(F.struct(tags.alias("tags"), center.alias("center")))).when(p % 13 == 0, F.to_json(F.struct(tags.alias("tags")))).otherwise(F.to_json(F.struct(tags.alias("tags"), lat.alias("lat"), lon.alias("lon"))))
    answers = table(spark, sf_dir, "part").groupBy(pick(STATES, p % 12).alias("state")).agg(F.concat(F.lit('{"elements":['), F.array_join(F.collect_list(element), ","), F.lit("]}")).alias("json"))
    return gazetteers.in_gazetteer_order(gazetteers.power_features(answers)).select("state", "name", "power", "operator", "lat", "lng")


def zip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(s.alias("k"), (10000 + s).cast("string").alias("zip"), (30 + s / 16.0).cast("double").alias("lat"), (-90 + s / 8.0).cast("double").alias("lng"))
    found = own.where("k % 3 <> 0").withColumn("lat", F.col("lat") + 1)
    return gazetteers.merge_zip_points(own.where("k % 2 = 0").drop("k"), found.drop("k").unionByName(found.drop("k")))


def plan_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects of a company as a published plan, read back; dates are printed as months, quarters or years."""
    k = F.col("id")
    shown = lambda d, n: F.when(k % 3 == 0, F.date_format(d, "yyyy-MM")).when(k % 3 == 1, F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))).otherwise(F.year(d).cast("string"))
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("name"), F.col("type"), F.col("voltage_kv"), F.concat(F.lit('"'), F.split("location_ref", " ")[0], F.lit(', FL"')), shown("start_date", 0), shown("end_date", 1))]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(",", *cells).alias("r")))), lambda x: x["r"])
    text = F.concat(F.lit("Project,Category,Voltage (kV),Location,Start,End\n"), F.array_join(rows, "\n"))
    return gazetteers.plan_projects(projects(spark, sf_dir).groupBy(F.col("utility").alias("doc")).agg(text.alias("text")))


def projects_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that are not past, without those of which a source said by then that they operate; evidence names a source and a project, or none."""
    own = pairs.with_windows(projects(spark, sf_dir)).withColumn("source_url", F.when(F.col("id") % 9 != 0, F.col("source_key")))
    evidence = own.where("id % 10 = 0").select("source_url", "name", F.when(F.col("id") % 20 == 0, F.lit("2030-06-01")).otherwise(F.lit("2032-01-01")).cast("date").alias("operating_from"))
    return pairs.still_ahead(own, AS_OF, evidence).select("id", "build_end")


def locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with two ends, each with one station in the entry's state or none: midpoints and single ends."""
    k, s = F.col("id"), F.col("s_suppkey")
    stations = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.lit("GA").alias("state"), F.concat(pick(PLACES, s), F.lit(" Substation")).alias("name"), F.lit("substation").alias("power"), F.lit("X").alias("operator"), (31.0 + s / 8.0).cast("double").alias("lat"), (-85.0 + s / 8.0).cast("double").alias("lng"))
    ends = F.split(F.regexp_replace("name", " Rebuild$", ""), " - ")
    own = projects(spark, sf_dir).where(ends[0] != ends[1]).select("id", ends.alias("endpoints"), F.array(F.lit("GA")).alias("states"), F.lit("Y").alias("operator"))
    none = spark.createDataFrame([], "operator string, name string, lat double, lng double, state string, approximate boolean")
    found = place.locate(own, stations, stations.where("false").select("name", "state", "lat", "lng"), none)
    return found.select("id", F.round("lat", 2).alias("lat"), F.round("lng", 2).alias("lng"), "approximate", "requires_review", F.array_join("states", ",").alias("states"))


_txt = lambda values, k: "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST({k}+1 AS INT))"
_FIRST = "CASE WHEN id%3=0 THEN date_trunc('month',start_date) WHEN id%3=1 THEN date_trunc('quarter',start_date) ELSE date_trunc('year',start_date) END::DATE"
_LAST = "CASE WHEN id%3=0 THEN date_trunc('month',end_date)+INTERVAL 1 MONTH WHEN id%3=1 THEN date_trunc('quarter',end_date)+INTERVAL 3 MONTH ELSE date_trunc('year',end_date)+INTERVAL 12 MONTH END"
_KIND = "CASE id%3 WHEN 0 THEN 'month' WHEN 1 THEN 'quarter' ELSE 'year' END"

SQL = {
    "power_features": f"""SELECT {_txt(STATES, 'p_partkey%12')} AS state, {_txt(PLACES, 'p_partkey%16')}||' '||p_partkey AS name, CASE WHEN p_partkey%3=0 THEN 'plant' ELSE 'substation' END AS power, '' AS operator,
      round_even(30+p_partkey%100/7.0::DOUBLE,3) AS lat, round_even(-90+p_partkey%90/11.0::DOUBLE,3) AS lng FROM part WHERE p_partkey%7<>0 AND p_partkey%11<>0 AND (p_partkey%5=0 OR p_partkey%13<>0)""",
    "zip_merge": "SELECT (10000+s_suppkey)::VARCHAR AS zip, round_even(30+s_suppkey/16.0::DOUBLE+CASE WHEN s_suppkey%2=0 THEN 0 ELSE 1 END,4) AS lat, round_even(-90+s_suppkey/8.0::DOUBLE,4) AS lng FROM supplier WHERE s_suppkey%2=0 OR s_suppkey%3<>0",
    "plan_projects": WITH + f"""SELECT utility AS doc, row_number() OVER (PARTITION BY utility ORDER BY id)::INT AS row, name, type, voltage_kv, string_split(location_ref,' ')[1]||', FL' AS location_ref, {_FIRST} AS start_date, CASE WHEN start_date IS NOT NULL THEN {_KIND} END AS start_precision,
      ({_LAST} - INTERVAL 1 DAY)::DATE AS end_date, CASE WHEN end_date IS NOT NULL THEN {_KIND} END AS end_precision, true AS requires_review FROM projects""",
    "projects_ahead": f"""WITH {PROJECTS_SQL}, {WINDOWS_SQL}, w AS (SELECT *, CASE WHEN id%9<>0 THEN source_key END AS url FROM windowed), e AS (SELECT DISTINCT url, name FROM w WHERE id%20=0)
      SELECT w.id, build_end FROM w WHERE (build_end IS NULL OR build_end >= DATE '{AS_OF}') AND NOT EXISTS (SELECT 1 FROM e WHERE e.url IS NOT DISTINCT FROM w.url AND e.name IS NOT DISTINCT FROM w.name)""",
    "locate_exact": WITH + f""", g AS (SELECT {_txt(PLACES[:10], 's_suppkey')} AS name, 31+s_suppkey/8.0::DOUBLE AS lat, -85+s_suppkey/8.0::DOUBLE AS lng FROM supplier WHERE s_suppkey<10),
      q AS (SELECT id, string_split(replace(name,' Rebuild',''),' - ') AS e FROM projects), f AS (SELECT id, e[1]<>e[2] AS two, a.lat AS la, a.lng AS na, b.lat AS lb, b.lng AS nb FROM q LEFT JOIN g a ON a.name=e[1] LEFT JOIN g b ON b.name=e[2])
      SELECT id, round(CASE WHEN la IS NOT NULL AND lb IS NOT NULL AND {{near}} THEN (la+lb)/2 ELSE coalesce(la,lb) END,2) AS lat, round(CASE WHEN la IS NOT NULL AND lb IS NOT NULL AND {{near}} THEN (na+nb)/2 ELSE coalesce(na,nb) END,2) AS lng,
        (la IS NULL)<>(lb IS NULL) OR (la IS NOT NULL AND lb IS NOT NULL AND NOT {{near}}) AS approximate, la IS NULL AND lb IS NULL AS requires_review, CASE WHEN la IS NULL AND lb IS NULL THEN '' ELSE 'GA' END AS states FROM f WHERE two""".replace(
        "{near}", "2*6371.0*asin(sqrt(pow(sin(radians(lb-la)/2),2)+cos(radians(la))*cos(radians(lb))*pow(sin(radians(nb-na)/2),2)))<=75*1.609344"
    ),
}

QUERIES = {f.__name__: f for f in (power_features, zip_merge, plan_projects, projects_ahead, locate_exact)}
