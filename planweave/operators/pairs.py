"""Pairs of projects of different companies, near in space and building at the same time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import corridor, dates, geo, near, owners, score
from ..functions.stored import stored

RADIUS_M = 25 * geo.METERS_PER_MILE
#: Height of a grid band in degrees of latitude.
BAND = 0.4
SHAPE = ("lat1", "lng1", "lat2", "lng2")


def cells(df: DataFrame, pad_m: float, unit_m: float) -> DataFrame:
    """Explodes each shape into the grid cells its box, grown by ``pad_m``, reaches: band, cell, and the first of both.

    Cells are about ``unit_m`` wide and high: a band's cells as wide as that at its highest latitude, so a box reaches a
    few at most at any latitude. The grown box itself stays: south, north, west, east.
    """
    band, pad = BAND * unit_m / RADIUS_M, pad_m / 110_000
    df = df.withColumns({"south": F.least("lat1", "lat2") - pad, "north": F.greatest("lat1", "lat2") + pad})
    wide = pad_m / (110_000 * F.cos(F.radians(F.least(F.lit(88.0), F.greatest(F.abs("south"), F.abs("north"))))))
    df = df.withColumns({"west": F.least("lng1", "lng2") - wide, "east": F.greatest("lng1", "lng2") + wide, "band0_": F.floor(F.col("south") / band).cast("int")})
    df = df.withColumn("band_", F.explode(F.sequence("band0_", F.floor(F.col("north") / band).cast("int"))))
    # the margin is not less in small cells: long shapes of a pair may lie north of the band they meet in
    top = F.least(F.lit(88.0), F.greatest(F.abs(F.col("band_") * band), F.abs((F.col("band_") + 1) * band)) + max(unit_m, RADIUS_M) / 110_000)
    df = df.withColumn("width_", unit_m / (110_000 * F.cos(F.radians(top))))
    side = pad_m / unit_m * F.col("width_")
    df = df.withColumn("cell0_", F.floor((F.least("lng1", "lng2") - side) / F.col("width_")).cast("int"))
    return df.withColumn("cell_", F.explode(F.sequence("cell0_", F.floor((F.greatest("lng1", "lng2") + side) / F.col("width_")).cast("int")))).drop("width_")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


#: Rows of a side in one cell, above which the cell is dealt in parts; so many dense cells may be sent to every task.
DENSE, SENT = 20_000, 20_000


def dense_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in which a side has more than ``DENSE`` rows: band_, cell_, and in how many parts each side is dealt there (pa_, pb_)."""
    side = lambda df, s, na, nb: df.select(F.col(f"{s}_band_").alias("band_"), F.col(f"{s}_cell_").alias("cell_"), F.lit(na).alias("na"), F.lit(nb).alias("nb"))
    counts = side(a, "a", 1, 0).unionByName(side(b, "b", 0, 1)).groupBy("band_", "cell_").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / DENSE)).cast("int")
    return counts.where((F.col("na") > DENSE) | (F.col("nb") > DENSE)).where("na > 0 AND nb > 0").select("band_", "cell_", parts("na").alias("pa_"), parts("nb").alias("pb_"))


def dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part each (``part_a``, ``part_b``): in a dense cell a row of one side meets every part of the other, and is in one of its own.

    So a cell's pairs are spread over parts of bounded size, each pair in one of them, and no cell is work for one task.
    """
    dense = dense_cells(a, b)
    found = dense.limit(SENT + 1).collect()
    if not found:
        return a.withColumns({"a_part_a": F.lit(0), "a_part_b": F.lit(0)}), b.withColumns({"b_part_a": F.lit(0), "b_part_b": F.lit(0)})
    if len(found) <= SENT:  # few enough to be sent out; else the planner joins them as it likes
        dense = F.broadcast(a.sparkSession.createDataFrame([tuple(r) for r in found], dense.schema))

    def parts(df: DataFrame, s: str) -> DataFrame:
        own, other = ("a", "b") if s == "a" else ("b", "a")
        on = dense.select(F.col("band_").alias(f"{s}_band_"), F.col("cell_").alias(f"{s}_cell_"), "pa_", "pb_")
        joined = df.join(on, [f"{s}_band_", f"{s}_cell_"], "left")
        mine = F.coalesce(F.pmod(F.xxhash64(f"{s}_id", *[f"{s}_{c}" for c in SHAPE]), F.col(f"p{own}_")).cast("int"), F.lit(0))
        met = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"p{other}_"), F.lit(1)) - 1))
        return joined.select(*df.columns, mine.alias(f"{s}_part_{own}"), met.alias(f"{s}_part_{other}"))

    return parts(a, "a"), parts(b, "b")


#: Least width of a cell in metres.
LEAST_UNIT = 250.0


def cell_unit(shapes: list[DataFrame], radius_m: float) -> float:
    """How wide cells are: twice the radius, but if it is small not less than shapes are long, by root mean square.

    So a shape reaches a few cells on the whole, and a cell holds no more shapes than lie near each other.
    """
    if radius_m >= RADIUS_M:
        return 2 * radius_m
    size, n = 0.0, 0
    for df in shapes:
        high = (F.greatest("lat1", "lat2") - F.least("lat1", "lat2")) * 111_000
        wide = (F.greatest("lng1", "lng2") - F.least("lng1", "lng2")) * 111_000 * F.cos(F.radians("lat1"))
        square = F.pow(F.greatest(high, wide), 2)
        row = df.where(square < float("inf")).agg(F.sum(square).alias("size"), F.count(square).alias("n")).first()
        size, n = size + (row.size or 0.0), n + row.n
    return max(LEAST_UNIT, min(RADIUS_M, max(2 * radius_m, (size / n) ** 0.5 if n else 0.0)))


def candidate_pairs(projects: DataFrame, radius_m: float = RADIUS_M, extra: Column | None = None, others: DataFrame | None = None, wanted: tuple[str, ...] | None = None, reduced: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Each pair a.id < b.id of unlike companies whose shapes are within the radius, once: a_ and b_ columns, metres.

    Both sides are shuffled by cell, as wide as ``cell_unit`` says, and sorted by it; a pair that meets in several cells is kept
    in the first. Only one side is grown by the radius. Cells with many rows are dealt in parts, which the data decides, not the
    planner. In a task the rows of a cell are searched along sorted strips, and pairs are handed on in batches, so that it holds
    rows of a cell but not its pairs. Columns ``from_``, ``to_`` and ``owned_`` are judged there (see ``judged``) and dropped;
    ``extra`` is a condition on what is left; ``wanted`` are the columns that pairs have of each side, else all. With ``others`` the pairs are those of a row of ``projects`` with one of
    ``others``, whichever id is less. ``reduced`` says which of the pairs that a task finds at once leave it (see ``near``), and
    ``more`` the columns that it adds.
    """
    placed = lambda df: df.where(F.col("lat1").isNotNull() & F.col("lng1").isNotNull()).withColumn("key_", F.lower(F.trim("utility")))
    own, met = placed(projects), placed(projects if others is None else others)
    unit = cell_unit([own] if others is None else [own, met], radius_m)
    a, b = dealt(prefixed(cells(own, radius_m, unit), "a"), prefixed(cells(met, 0, unit), "b"))

    def side(df: DataFrame, s: str, n: int) -> DataFrame:
        of = lambda c: F.col(f"{s}_{c}")
        # one number, so that rows are sorted by it alone: 18 bits of the band, 20 of the cell, 12 of either part
        place = ((of("band_") + (1 << 17)).cast("long") * (1 << 20) + of("cell_") + (1 << 19)) * (1 << 24) + of("part_a") * (1 << 12) + of("part_b")
        marks = [place.alias("in_"), F.lit(n).alias("side_")]
        first = [(of("band_") == of("band0_")).alias("first_band_"), (of("cell_") == of("cell0_")).alias("first_cell_")]
        return df.select(*marks, *first, *[of(c).alias(c) for c in (own if n == 0 else met).columns])

    rows = side(a, "a", 0).unionByName(side(b, "b", 1), allowMissingColumns=True)
    dropped = {*near.MARKS, *near.SPAN, near.OWNED}
    kept = [[f for f in df.schema.fields if f.name not in dropped and (wanted is None or f.name in wanted)] for df in (own, met)]
    schema = StructType([*(StructField(f"{s}_{f.name}", f.dataType) for s, fields in zip("ab", kept) for f in fields), StructField("metres", DoubleType()), *(StructField(c, DoubleType()) for c in more)])
    rows = rows.repartition("in_").sortWithinPartitions("in_")
    found = rows.mapInArrow(near.pairs_within(radius_m, tuple([f.name for f in fields] for fields in kept), others is None, reduced, more), schema)
    return found if extra is None else found.where(extra)


def with_windows(projects: DataFrame) -> DataFrame:
    first, last = dates.build_window(F.col("start_date"), F.col("end_date"), F.col("start_precision"), F.col("end_precision"))
    return projects.withColumns({"build_start": first, "build_end": last})


def with_owners(projects: DataFrame, registry: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Canonical name and ownership, worked out once per distinct name and joined back; ``registry``: audited owners, see ``owners.audited``."""
    names = owners.once(projects.select("utility").distinct(), "company", owners.canonical_utility(F.col("utility")))
    names = names.join(owners.ownership(names.where("company IS NOT NULL"), registry, as_of), "company", "left")
    none = F.array().cast("array<string>")
    names = names.withColumns({"entities": F.coalesce("entities", none), "stem": F.coalesce("stem", none), "needs_review": F.coalesce("needs_review", F.lit(True)), "withheld": F.coalesce("withheld", F.lit(False))})
    return projects.join(names, "utility", "left")


def company_groups(named: DataFrame) -> DataFrame:
    """The groups of distinct names that keep their members from being matched, over columns of ``with_owners``: utility, kind, key, needs_review, n_names.

    Two names may be matched if and only if neither has a row of kind ``none`` (no company, or withheld), they share no
    ``entity``, and, if one of them needs review, neither has a row of kind ``any`` (an owner, but no word of its own), they share no
    ``family`` (a first word that few have) and neither's ``stem`` is a ``beginning`` of the other. So all names are judged
    by rows in proportion to the names, and no pairs are formed. A beginning that is nobody's stem is no group. Names that
    are null form no group, repeated rows count once.
    """
    own = named.select("utility", "entities", "stem", "needs_review", "withheld").where("utility IS NOT NULL").dropDuplicates(["utility"])
    row = lambda df, kind, key: df.select("utility", F.lit(kind).alias("kind"), key.alias("key"), "needs_review")
    barred = (F.size("entities") == 0) | F.col("withheld")
    shared = F.get("stem", F.lit(0)).isin(owners.COMMON_FIRST)
    worded = own.where(F.size("stem") > 0)
    whole = row(worded.where(shared), "stem", F.array_join("stem", " "))
    longer = worded.where(shared & (F.size("stem") > 1)).withColumn("long_", F.explode(F.sequence(F.lit(1), F.size("stem") - 1)))
    begun = row(longer, "beginning", F.array_join(F.slice("stem", 1, F.col("long_")), " ")).join(whole.select("key").distinct(), "key", "left_semi").select("utility", "kind", "key", "needs_review")
    rows = row(own.where(barred), "none", F.lit("")).union(row(own.where((F.size("stem") == 0) & ~barred), "any", F.lit("")))
    rows = rows.union(own.select("utility", F.lit("entity").alias("kind"), F.explode("entities").alias("key"), "needs_review"))
    rows = rows.union(row(worded.where(~shared), "family", F.get("stem", F.lit(0)))).union(whole).union(begun)
    return rows.join(rows.groupBy("kind", "key").agg(F.count("*").alias("n_names")), ["kind", "key"])


def ahead_of(projects: DataFrame, as_of: str, evidence: DataFrame | None = None) -> DataFrame:
    """Projects of which no evidence (id, operating_from) says that they operate by then, and whose last day is not past.

    Evidence counts for what is published at that time: the first day of operation is not after ``as_of``.
    """
    ahead = projects.where(F.col("build_end") >= F.lit(as_of).cast("date"))
    return ahead if evidence is None else ahead.join(evidence.where(F.col("operating_from") <= F.lit(as_of).cast("date")), "id", "left_anti")


def still_ahead(projects: DataFrame, as_of: str, evidence: DataFrame | None = None) -> DataFrame:
    """Projects that are undated or whose last day is not past, but for those that a source says to operate.

    Evidence (source_url, name, operating_from) speaks of the projects of that source and name, a missing one being a value
    like others, from its day on.
    """
    day = F.lit(as_of).cast("date")
    ahead = projects.where(F.coalesce(F.col("build_end") >= day, F.lit(True)))
    if evidence is None:
        return ahead
    said = evidence.where(F.col("operating_from") <= day).select(F.col("source_url").alias("url_"), F.col("name").alias("name_")).distinct()
    return ahead.join(said, ahead["source_url"].eqNullSafe(said["url_"]) & ahead["name"].eqNullSafe(said["name_"]), "left_anti")


#: What the pairs of ``overlaps`` have of each side, unless fewer columns are asked for, and what scores are made of.
FACTS = ("company", "state", "name", "location_ref", "end_date")
SCORED = ("id", "utility", "type", "voltage_kv", "cost_usd", "routed", *SHAPE, "build_start", "build_end")
#: Values of pairs that take the land of near routes into account.
LAND = ("shared_km", "total_low", "total_high", "if_aligned_low", "if_aligned_high")
#: What of either side a value of a pair is made of, besides the id and the distance.
_DAYS, _LAND = ("build_start", "build_end"), ("cost_usd", "voltage_kv", "routed", *SHAPE, "build_start", "build_end")
MADE_OF = {
    **dict.fromkeys(("pair_id", "a_id", "b_id", "metres", "exact_miles", "miles", "band", "tier"), ()), **dict.fromkeys(("window_start", "window_end", "overlap_days", "ratio", "gap_days"), _DAYS),
    **dict.fromkeys(("composite", "indeterminate"), ("type", "voltage_kv", *_DAYS)), "shared_km": ("routed", *SHAPE),
    **dict.fromkeys(("total_low", "total_high", "if_aligned_low", "if_aligned_high"), _LAND),
}


def overlaps(projects: DataFrame, as_of: str, min_days: int = 30, radius_m: float = RADIUS_M, evidence: DataFrame | None = None, changed: DataFrame | None = None, registry: DataFrame | None = None, within_m: float | None = None, facts: tuple[str, ...] = FACTS, values: tuple[str, ...] | None = None) -> DataFrame:
    """The qualifying pairs with scores, bands and value ranges; whatever one side decides is decided before the join.

    With ``changed`` (id) only pairs with a side among these are found: one join of these with all. With ``within_m`` only those
    at most so far apart are searched; they are scored by ``radius_m`` all the same. ``facts``: the columns of projects, and their company, that
    are wanted of each side, since each pair carries them. ``values``: the columns of pairs that are wanted (of ``MADE_OF``), if not all;
    pairs then carry what these are made of and no more.
    """
    return matched(ready(projects, as_of, evidence, registry, facts), as_of, min_days, radius_m, changed, within_m, values, facts)


def ready(projects: DataFrame, as_of: str, evidence: DataFrame | None = None, registry: DataFrame | None = None, facts: tuple[str, ...] = FACTS) -> DataFrame:
    """The projects still ahead with what pairs are judged by: windows, companies, owners."""
    ahead = ahead_of(with_owners(with_windows(projects), registry, as_of), as_of, evidence)
    return ahead.select(*dict.fromkeys([*SCORED, *facts]), "entities", "needs_review", "withheld", "stem")


def judged(every: DataFrame, as_of: str, min_days: int) -> DataFrame:
    """The rows of ``ready`` that any pair can have, with the days that pairs must share, and with their owners: from_, to_, owned_.

    Two projects share enough days if the later ``from_`` is not after the earlier ``to_``.
    """
    span = {"from_": F.unix_date(F.greatest(F.col("build_start"), F.lit(as_of).cast("date"))), "to_": F.unix_date("build_end") + 1 - max(1, min_days)}
    able = every.where((F.size("entities") > 0) & ~F.col("withheld") & F.col("lat1").isNotNull() & F.col("lng1").isNotNull()).withColumns(span).where("to_ >= from_")
    own = ("entities", "needs_review", "withheld", "stem")
    return able.withColumn("owned_", F.struct(*own)).drop(*own)


def matched(every: DataFrame, as_of: str, min_days: int, radius_m: float, changed: DataFrame | None, within_m: float | None, values: tuple[str, ...] | None = None, facts: tuple[str, ...] = ()) -> DataFrame:
    """``overlaps`` over the rows of ``ready``; with ``values`` these columns, and ``facts`` of each side."""
    reach = radius_m if within_m is None else min(radius_m, within_m)
    every = stored(judged(every, as_of, min_days), "judged")
    parts = None if values is None else tuple(dict.fromkeys(["id", *facts, *(c for v in values for c in MADE_OF[v])]))
    if changed is None and values is not None and set(LAND) & set(values):
        return valued(every, radius_m, reach, values, facts)
    narrow = {} if parts is None else {"wanted": parts}
    if changed is None:
        pairs = candidate_pairs(every, reach, **narrow)
    else:
        ids = changed.select("id").distinct()
        own = every.join(ids, "id", "left_semi").withColumn("both", F.lit(True))
        narrow = {k: (*v, "both") for k, v in narrow.items()}
        pairs = in_order(candidate_pairs(own, reach, None, every.join(ids.withColumn("both", F.lit(True)), "id", "left"), **narrow))
    found = scored(compared(pairs, every), radius_m)
    return found if values is None else found.select(*outputs(values, facts))


def outputs(values: tuple[str, ...], facts: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys([*values, *(f"{s}_{c}" for s in "ab" for c in facts)]))


def compared(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """Pairs with their shared days; columns of ``SCORED`` that they don't carry are null, and so is what would be made of them."""
    lacking = {f"{s}_{c}": F.lit(None).cast(every.schema[c].dataType) for c in SCORED for s in "ab" if f"{s}_{c}" not in pairs.columns}
    return pairs.withColumns(lacking).withColumns(dates.compare(F.col("a_build_start"), F.col("a_build_end"), F.col("b_build_start"), F.col("b_build_end")))


def valued(every: DataFrame, radius_m: float, reach: float, values: tuple[str, ...], facts: tuple[str, ...]) -> DataFrame:
    """``matched`` with values of land: few pairs share any, and all others are valued without the steps that measure it.

    Routes of tier 0 or 1 are near each other, so a join of the routes alone, no farther than such a pair reaches, finds them;
    the other pairs carry no shapes. No pair is in both parts, and none is in neither, since a condition parts them.
    """
    parts = lambda but: tuple(dict.fromkeys(["id", "routed", *facts, *(c for v in values for c in MADE_OF[v] if c not in but)]))
    land = F.coalesce(F.col("a_routed") & F.col("b_routed") & (score.tier(score.band(F.col("metres") / 1000)) <= 1), F.lit(False))
    farthest = max(1000 * most for _, most, t in score.BANDS if t <= 1) * (1 + 1e-9)
    near = candidate_pairs(every.where("routed"), min(reach, farthest), land, wanted=parts(()))
    far = candidate_pairs(every, reach, ~land, wanted=parts(SHAPE))
    both = [scored(compared(df, every), radius_m, measured).select(*outputs(values, facts)) for df, measured in ((near, True), (far, False))]
    return both[0].unionByName(both[1])


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs of a changed side a, with the lesser id first; of two changed sides (``both``) a pair is kept once."""
    pairs = pairs.where((F.col("a_id") < F.col("b_id")) | F.col("b_both").isNull()).drop("a_both", "b_both")
    swap, names = F.col("a_id") > F.col("b_id"), [c[2:] for c in pairs.columns if c.startswith("a_")]
    sides = {f"{x}_{n}": F.when(swap, F.col(f"{y}_{n}")).otherwise(F.col(f"{x}_{n}")) for n in names for x, y in ("ab", "ba")}
    return pairs.withColumns(sides)


def scored(pairs: DataFrame, radius_m: float = RADIUS_M, measured: bool = True) -> DataFrame:
    """Pairs with all values; without ``measured`` it is known that none shares land."""
    miles = F.col("metres") / geo.METERS_PER_MILE
    own = score.factors(miles, F.col("ratio"), F.col("a_type"), F.col("b_type"), F.col("a_voltage_kv"), F.col("b_voltage_kv"), radius_m / geo.METERS_PER_MILE)
    band = score.band(F.col("metres") / 1000)
    out = pairs.withColumns({"pair_id": F.concat_ws("-", "a_id", "b_id"), "exact_miles": miles, "band": band, "composite": score.composite(own), "indeterminate": score.indeterminate(own)})
    out = out.withColumn("tier", score.tier(F.col("band")))
    land = F.col("a_routed") & F.col("b_routed") & (F.col("tier") <= 1)  # land is valued for these alone
    out = corridor.with_shared_km(out, land) if measured else out.withColumn("shared_km", F.lit(None).cast("double"))
    value = score.impact(F.col("tier"), F.col("a_cost_usd"), F.col("b_cost_usd"), F.col("a_voltage_kv"), F.col("b_voltage_kv"), F.col("shared_km"), F.col("window_start").isNotNull())
    return out.withColumns(value).withColumn("miles", F.round("exact_miles", 3))


def ranked(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs by rank: the first ``most``, or all of them, which are stored before, since a sort reads its rows twice."""
    own = pairs if most is not None else stored(pairs, "pairs")
    own = own.orderBy("tier", F.desc("composite"), "miles", "a_id", "b_id")
    return own if most is None else own.limit(most)


def best_per_project(pairs: DataFrame) -> DataFrame:
    """The best-ranked pair of each project: both sides posted, the least rank kept by a partial aggregate."""
    rank = F.struct(F.col("tier"), (-F.col("composite")).alias("c"), F.col("miles"), F.col("a_id"), F.col("b_id"))
    sides = pairs.select(F.explode(F.array("a_id", "b_id")).alias("id"), rank.alias("rank"))
    return sides.groupBy("id").agg(F.min("rank").alias("rank")).select("id", F.concat_ws("-", "rank.a_id", "rank.b_id").alias("pair_id"), F.col("rank.tier").alias("tier"))


def best_pairs(projects: DataFrame, as_of: str, min_days: int = 30, radius_m: float = RADIUS_M, evidence: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """What ``best_per_project`` says of ``overlaps``: id, pair_id, tier; tier after tier, so that not all pairs are formed.

    The tier ranks first and is a matter of distance. So who has a pair within the reach of a tier has the best one there, and
    only the others are searched farther. Projects that no pair can have, by their company or by their days left, are left out.
    """
    left = F.datediff(F.col("build_end"), F.greatest(F.col("build_start"), F.lit(as_of).cast("date"))) + 1
    able = ready(projects, as_of, evidence, registry).where((F.size("entities") > 0) & ~F.col("withheld") & (left >= max(1, min_days)))
    own = stored(able.where("lat1 IS NOT NULL AND lng1 IS NOT NULL"), "able")
    reach = {t: 1000 * most for _, most, t in score.BANDS}  # the widest band of a tier is its last
    searching, done = None, []
    for tier in sorted(t for t in reach if t and 2 * reach[t] <= radius_m):  # what touches is found with what is near
        best = best_per_project(matched(own, as_of, min_days, radius_m, searching, reach[tier] * (1 + 1e-9))).where(F.col("tier") <= tier)
        done.append(stored(best if searching is None else best.join(searching, "id", "left_semi"), "best-pairs"))
        searching = stored((own.select("id") if searching is None else searching).join(done[-1].select("id"), "id", "left_anti"), "searching")
    last = best_per_project(matched(own, as_of, min_days, radius_m, searching, None))
    last = last if searching is None else last.join(searching, "id", "left_semi")
    for best in done:
        last = last.unionByName(best)
    return last
