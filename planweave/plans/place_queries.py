"""Registered queries over places, and the SQL that checks them; gazetteers are derived from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import place
from .fixtures import PLACES, PROJECTS_SQL, STATES, pick, projects, table

WITH = f"WITH {PROJECTS_SQL} "
#: Names of equipment around a place name, and the place name that is left.
DRESSES = ["{} Tie", "{}'s Substation 230/115 kV", "N. {} #2", "{} (spare) Switching Station", "Mt {} No. 3", "{} & Main 69 kV Tap"]
KEYS = ["{}", "{}s", "north {}", "{}", "mount {}", "{} and main"]


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature a supplier: names repeat over states, each eighth stands a kilometre from the one before, each fifth is a plant."""
    k = F.col("k")
    base = k - F.when(k % 8 == 7, 1).otherwise(0)
    at = lambda m, n, a, b: a + ((base * m) % n) / F.lit(float(n)) * b + F.when(k % 8 == 7, 0.009).otherwise(0.0)
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = F.concat(pick(PLACES, base % 16), F.when(k % 2 == 0, F.lit(" Substation")).otherwise(F.lit(" Switching Station")))
    return own.select("k", pick(STATES, (base * 7) % 12).alias("state"), name.alias("name"), F.when(k % 5 == 0, "plant").otherwise("substation").alias("power"), F.when(k % 3 == 0, F.lit("Georgia Power")).otherwise(F.lit("Duke Energy")).alias("operator"), at(7919, 1009, 28, 10).alias("lat"), at(104729, 2003, -98, 20).alias("lng"))


def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dressed-up place names and what is left of them."""
    k = F.col("id")
    name = F.replace(pick(DRESSES, k % 6), F.lit("{}"), F.split("name", " - ")[0])
    own = projects(spark, sf_dir).select("id", name.alias("name"))
    return own.select("id", place.name_key(F.col("name")).alias("key"), place.place_name(F.col("name")).alias("place"))


def dedupe_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a name and state, those within three kilometres of one kept before left out."""
    points = F.sort_array(F.collect_list(F.struct("k", "lat", "lng")))
    own = gazetteer(spark, sf_dir).groupBy("state", F.regexp_replace("name", " .*", "").alias("name")).agg(points.alias("points"))
    return own.select("state", "name", F.size("points").alias("n"), F.size(place.dedupe_points(F.col("points"), "struct<k: bigint, lat: double, lng: double>")).alias("n_kept"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.split(F.regexp_replace("name", " Rebuild$", ""), " - ")
    two = F.filter(F.array(F.col("state"), F.lit("GA")), lambda s: s.isNotNull())
    return projects(spark, sf_dir).select("id", F.concat(ends[0], F.lit(" Tap")).alias("name"), ends.alias("endpoints"), two.alias("states"), F.col("utility").alias("operator"))


def substation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many substations each project's first end may be."""
    found = place.substation_candidates(asked(spark, sf_dir), gazetteer(spark, sf_dir), F.size)
    return found.select("id", F.col("options").alias("n_options"))


def zip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier")
    zips = own.select(F.lpad((10000 + s).cast("string"), 5, "0").alias("zip"), (30 + s % 10.0).alias("lat"), (-90 + s % 13.0).alias("lng"), s.alias("k"))
    middles = zips.where("k % 3 <> 0").select("zip", (F.col("lat") + F.when(F.col("k") % 2 == 0, 0.25).otherwise(1.5)).alias("lat"), F.col("lng"))
    asked_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lpad((10000 + F.col("c_custkey") % 140).cast("string"), 5, "0").alias("zip"))
    return place.locate_zip(asked_, zips.drop("k"), middles)


def county_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties that a text names: a state borders decide, words before the name are left out."""
    s = F.col("s_suppkey")
    counties = table(spark, sf_dir, "supplier").select(pick(PLACES, s % 16).alias("name"), pick(STATES, s * 7 % 12).alias("state"))
    text = F.concat(F.lit("Rebuild in Upper "), F.split("name", " - ")[0], F.lit(" County, "), F.coalesce("state", F.lit("ZZ")), F.lit(" and near Nowhere County, GA."))
    return place.named_counties(projects(spark, sf_dir).select("id", text.alias("text")), counties)


def locate_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects placed by the names of their ends; Thurmond is blocked for one company, Winder set for another."""
    names = spark.createDataFrame([("Georgia Power", "Thurmond", None, None, None, False), ("FPL", "Winder Substation", 33.5, -83.5, "GA", False), ("TVA", "Grady", 31.0, -84.25, "GA", True)], "operator string, name string, lat double, lng double, state string, approximate boolean")
    towns = gazetteer(spark, sf_dir).where("k % 11 = 0").select(F.regexp_replace("name", " .*", "").alias("name"), "state", "lat", "lng")
    found = place.locate(asked(spark, sf_dir), gazetteer(spark, sf_dir).where("k % 11 <> 0"), towns, names)
    return found.select("id", "lat", "lng", "approximate", "requires_review", F.size(F.coalesce("ends", F.array().cast("array<struct<lat: double, lng: double>>"))).alias("n_ends"), F.array_join("states", ",").alias("states"))


_K = lambda values, k: "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST({k}+1 AS INT))"
_FEATURES = f"""b AS (SELECT p_partkey AS k, p_partkey - CASE WHEN p_partkey%8=7 THEN 1 ELSE 0 END AS base FROM part),
features AS (SELECT k, base, {_K(STATES, '(base*7)%12')} AS state, {_K(PLACES, 'base%16')} AS name, k%5=0 AS plant, CASE WHEN k%3=0 THEN 'georgia' ELSE 'duke' END AS op,
  28+((base*7919)%1009)/1009.0::DOUBLE*10+CASE WHEN k%8=7 THEN 0.009 ELSE 0 END AS lat, -98+((base*104729)%2003)/2003.0::DOUBLE*20+CASE WHEN k%8=7 THEN 0.009 ELSE 0 END AS lng FROM b)"""
_KM = "2*6371.0*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lng-{a}.lng)/2),2)))"

SQL = {
    "place_keys": WITH + f", n AS (SELECT id, lower(string_split(name,' - ')[1]) AS p, id%6 AS f FROM projects), q AS (SELECT id, replace({_K(KEYS, 'f')}, '{{}}', p) AS key, f, p FROM n) SELECT id, key, CASE WHEN f=5 THEN upper(p[1])||p[2:]||' And' ELSE array_to_string(list_transform(string_split(key,' '), lambda w: upper(w[1])||w[2:]),' ') END AS place FROM q",
    # features of one group stand farther apart than three kilometres, but for the eighths beside the one before
    "dedupe_places": f"WITH {_FEATURES}, near AS (SELECT DISTINCT x.k FROM features x JOIN features y ON x.state=y.state AND x.name=y.name AND y.k<x.k AND {_KM.format(a='y', b='x')}<=3) SELECT state, name, count(*) AS n, count(*)-count(near.k) AS n_kept FROM features LEFT JOIN near USING (k) GROUP BY state, name",
    "substation_match": WITH + f""", {_FEATURES}, a AS (SELECT id, string_split(name,' - ')[1] AS name, utility, coalesce(state,'GA') AS s1, 'GA' AS s2 FROM projects),
      h AS (SELECT id, f.*, (op='georgia' AND utility ILIKE '%georgia%') OR (op='duke' AND utility ILIKE '%duke%') AS owned FROM a JOIN features f ON f.name=a.name AND f.state IN (s1,s2)),
      m AS (SELECT id, bool_and(plant) AS plants FROM h GROUP BY id), h1 AS (SELECT h.* FROM h JOIN m USING (id) WHERE NOT plant OR plants),
      o AS (SELECT id, bool_or(owned) AS has FROM h1 GROUP BY id), h2 AS (SELECT h1.* FROM h1 JOIN o USING (id) WHERE owned OR NOT has)
      SELECT x.id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM h2 y WHERE y.id=x.id AND y.base=x.base AND y.k<x.k))::INT AS n_options FROM h2 x GROUP BY x.id""",
    "zip_points": """WITH z AS (SELECT s_suppkey AS k, (10000+s_suppkey)::VARCHAR AS zip, 30+(s_suppkey%10)::DOUBLE AS lat, -90+(s_suppkey%13)::DOUBLE AS lng FROM supplier)
      SELECT c_custkey AS id, zip, lat+CASE WHEN k%3<>0 AND k%2=0 THEN 0.25 ELSE 0 END AS lat, lng FROM customer JOIN z ON zip=(10000+c_custkey%140)::VARCHAR""",
    "county_mentions": WITH + f", c AS (SELECT DISTINCT {_K(PLACES, 's_suppkey%16')} AS name, {_K(STATES, 's_suppkey*7%12')} AS state FROM supplier) SELECT id, c.name, c.state FROM projects p JOIN c ON c.name=string_split(p.name,' - ')[1] AND c.state=p.state",
}

QUERIES = {f.__name__: f for f in (place_keys, dedupe_places, substation_match, zip_points, county_mentions, locate_projects)}
