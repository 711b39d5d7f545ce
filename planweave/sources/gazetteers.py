"""Gazetteers and plans as others publish them: named power features, points of ZIP codes, plans as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from . import tables, texts

#: One answer of a map server: elements with their tags, and a place of their own or of their centre.
FEATURES = "elements array<struct<tags: map<string, string>, lat: double, lon: double, center: struct<lat: double, lon: double>>>"


def power_features(answers: DataFrame) -> DataFrame:
    """Answers (state, json) to named and placed features: state, name, power, operator, lat, lng, to three places; equal ones once.

    Elements without a name, or without a place, are left out; an answer that is no JSON has none.
    """
    own = answers.select("state", F.explode(F.from_json("json", FEATURES)["elements"]).alias("e"))
    tag = lambda k: F.try_element_at(F.col("e.tags"), F.lit(k))
    place = lambda c, o: F.bround(F.coalesce(F.col(f"e.{c}"), F.col(f"e.center.{c}")), 3).alias(o)
    found = own.select("state", F.trim(tag("name")).alias("name"), F.coalesce(tag("power"), F.lit("")).alias("power"), F.coalesce(tag("operator"), F.lit("")).alias("operator"), place("lat", "lat"), place("lon", "lng"))
    return found.where("name <> '' AND lat IS NOT NULL AND lng IS NOT NULL").distinct()


def in_gazetteer_order(features: DataFrame) -> DataFrame:
    return features.orderBy("state", F.lower("name"), "lat", "lng")


def merge_zip_points(known: DataFrame, found: DataFrame) -> DataFrame:
    """Points of ZIP codes (zip, lat, lng), to four places: those known stay, of codes that are new one point is taken."""
    new = found.where("lat IS NOT NULL AND lng IS NOT NULL").join(known.select("zip"), "zip", "left_anti").groupBy("zip").agg(F.min(F.struct("lat", "lng")).alias("p")).select("zip", "p.*")
    return known.select("zip", "lat", "lng").unionByName(new).select("zip", *[F.bround(c, 4).alias(c) for c in ("lat", "lng")])


#: Columns of a published plan, in any order.
PLAN = {"Project": "name", "Category": "type", "Voltage (kV)": "voltage_kv", "Location": "location_ref", "Start": "start", "End": "end"}


def plan_projects(plans: DataFrame) -> DataFrame:
    """Delimited plans (doc, text) to projects: doc, row, name, type, voltage_kv, location_ref, dates with precision, requires_review.

    The first row names the columns. The start is the first day of what is printed, the end the last one; a row without a
    name is left out. Projects need review until they are placed.
    """
    rows = tables.split_plan(plans)
    heads = rows.where("row = 0").select("doc", F.col("cells").alias("heads"))
    cell = lambda c: F.nullif(F.trim(F.get("cells", (F.array_position("heads", F.lit(c)) - 1).cast("int"))), F.lit(""))
    named = rows.where("row > 0").join(heads, "doc").select("doc", "row", *[F.when(F.array_contains("heads", c), cell(c)).alias(n) for c, n in PLAN.items()])
    (start, sp), (end, ep) = dates.parse_partial_date(F.col("start")), dates.parse_partial_date(F.col("end"))
    own = named.where("name IS NOT NULL").withColumns({"start_date": start, "start_precision": sp, "end_day": end, "end_precision": ep})
    last = dates.period_end(F.col("end_day"), F.col("end_precision"))
    kv = F.col("voltage_kv").try_cast("double")
    return own.select("doc", "row", "name", texts.coerce_type(F.col("type")).alias("type"), F.when(kv.isNotNull(), F.greatest(F.lit(1), F.bround(kv).cast("int"))).alias("voltage_kv"), "location_ref", "start_date", "start_precision", last.alias("end_date"), "end_precision", F.lit(True).alias("requires_review"))
