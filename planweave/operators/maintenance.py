"""Edits and replacements of projects, plans and briefs as joins that give the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import texts


def replace_source(projects: DataFrame, new_rows: DataFrame, source_key: str, supersedes: list[str] = ()) -> DataFrame:
    """The table with one source's rows, and those of the sources it supersedes, exchanged for new ones."""
    gone = [source_key, *supersedes]
    return projects.where(~F.col("source_key").isin(gone)).unionByName(new_rows, allowMissingColumns=True)


def stale_sources(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources that are missing from the ledger or whose digest has changed."""
    return manifest.join(ledger, ["source_key", "sha"], "left_anti")


#: Fields that a patch may set as they are, besides its dates and its place.
EDITABLE = ["utility", "state", "name", "type", "voltage_kv", "location_ref", "cost_usd", "confidence", "source_page", "reviewed", "approximate"]


def apply_patches(projects: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patched projects, and rejected patches (id): a patch that would end before it starts, or names no type that there is, changes nothing.

    Patches have an id and any of ``EDITABLE``, start_date, end_date, lat and lng; null leaves a field as it is, other columns
    are an error. Types may be spelled loosely, voltages become whole kilovolts. Moving a project, which takes both
    coordinates, drops its route and the need of review, and makes it exact unless the patch says otherwise; an edited date
    has the precision of a day.
    """
    known = {*EDITABLE, "id", "lat", "lng", "start_date", "end_date"}
    if wrong := [c for c in patches.columns if c not in known]:
        raise ValueError(f"no such field: {', '.join(wrong)}")
    fields = [c for c in patches.columns if c != "id"]
    both = projects.join(patches.select("id", *[F.col(c).alias(f"new_{c}") for c in fields]), "id", "left")
    new = lambda c: F.col(f"new_{c}") if c in fields else F.lit(None)
    kind = texts.coerce_type(new("type")) if "type" in fields else F.lit(None)
    ok = F.coalesce(F.coalesce(new("start_date"), F.col("start_date")) <= F.coalesce(new("end_date"), F.col("end_date")), F.lit(True)) & (new("type").isNull() | kind.isNotNull())
    values = {c: new(c) for c in fields if c in EDITABLE or c.endswith("_date")}
    if "type" in values:
        values["type"] = kind
    if "voltage_kv" in values:
        values["voltage_kv"] = F.when(new("voltage_kv").isNotNull(), F.greatest(F.lit(1), F.bround(new("voltage_kv")).cast("int")))
    changed = {c: F.when(ok, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()}
    moved = ok & new("lat").isNotNull() & new("lng").isNotNull()
    for c in ("start", "end"):
        changed[f"{c}_precision"] = F.when(ok & new(f"{c}_date").isNotNull(), "day").otherwise(F.col(f"{c}_precision"))
    changed |= {c: F.when(moved, new(c[:3])).otherwise(F.col(c)) for c in ("lat", "lng", "lat1", "lng1", "lat2", "lng2")}
    rough = F.coalesce(new("approximate"), F.lit(False)) if "approximate" in fields else F.lit(False)
    changed |= {"routed": F.col("routed") & ~moved, "requires_review": F.col("requires_review") & ~moved, "approximate": F.when(moved, rough).otherwise(changed.get("approximate", F.col("approximate")))}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in projects.columns]), both.where(~ok).select("id")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key whose row differs: the names of the fields that do."""
    a, b = old.alias("a"), new.alias("b")
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    return a.join(b, key).select(key, names.alias("fields")).where(F.size("fields") > 0).select(key, F.array_join("fields", ",").alias("fields"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of those of equal key."""
    return old.join(new, key, "left_anti").unionByName(new)


def upsert_briefs(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Stored briefs (pair_id, ...) with those of ``new`` in the place of theirs: written at the time ``at``, and not stale."""
    fresh = new.withColumns({"stale": F.lit(False), "written_at": F.lit(at).cast("timestamp")})
    return old.join(new.select("pair_id"), "pair_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def admit_plans(plans: DataFrame, most: int) -> DataFrame:
    """Plans (plan_id, utility, arrival) with ``admitted``: those of the first ``most`` companies to arrive.

    The arrival of each company is an aggregate; only companies, not plans, are ranked.
    """
    first = plans.groupBy(F.lower(F.trim("utility")).alias("u")).agg(F.min("arrival").alias("first"))
    ranked = first.orderBy("first", "u").limit(most).select("u")
    known = plans.withColumn("u", F.lower(F.trim("utility"))).join(ranked.withColumn("ok", F.lit(True)), "u", "left")
    return known.select("plan_id", F.coalesce("ok", F.lit(False)).alias("admitted"))


def load_status(parts: DataFrame) -> DataFrame:
    """Per plan: loaded only if every part (plan_id, ok, n) is; a failed plan keeps no rows."""
    own = parts.groupBy("plan_id").agg(F.bool_and("ok").alias("ok"), F.sum("n").alias("n"))
    return own.select("plan_id", F.when(F.col("ok"), "loaded").otherwise("failed").alias("status"), F.when(F.col("ok"), F.col("n")).otherwise(0).alias("n_projects"))
