"""Scores, bands, tiers and value ranges of project pairs as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"distance": 0.55, "overlap": 0.30, "type_similarity": 0.075, "voltage_similarity": 0.075}
VOLTAGE_SCALE = 500.0
#: Bands by kilometres below, their tier.
BANDS = (("touching", 0.001, 0), ("under_1_6", 1.6, 1), ("under_8", 8.0, 2), ("under_25", 25.0, 3), ("under_40", 40.0, 3))
#: Widths of a right of way in metres by kilovolts up to, and without a voltage.
ROW_WIDTHS, ROW_DEFAULT = ((69, 23.0), (138, 30.0), (230, 38.0), (345, 46.0), (10_000, 61.0)), 30.0


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def factors(miles: Column, ratio: Column, type_a: Column, type_b: Column, kv_a: Column, kv_b: Column, radius: float) -> dict[str, Column]:
    """The four factors, null where a side is missing."""
    near = clamp(1 - miles / radius) if radius > 0 else F.when(miles <= 0, 1.0).otherwise(0.0)
    return {
        "distance": near, "overlap": clamp(ratio), "type_similarity": (type_a == type_b).cast("double"),
        "voltage_similarity": F.when((kv_a > 0) & (kv_b > 0), clamp(1 - F.abs(kv_a - kv_b) / VOLTAGE_SCALE)),
    }


def composite(own: dict[str, Column]) -> Column:
    return clamp(sum((F.coalesce(c, F.lit(0.0)) * WEIGHTS[k] for k, c in own.items()), F.lit(0.0)))


def indeterminate(own: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(c.isNull(), F.lit(k)) for k, c in own.items()])


def band(km: Column) -> Column:
    out = F.when(km <= BANDS[0][1], BANDS[0][0])
    for name, most, _ in BANDS[1:]:
        out = out.when(km < most, name)
    return out


def tier(band_: Column) -> Column:
    out = F.when(band_ == BANDS[0][0], BANDS[0][2])
    for name, _, t in BANDS[1:]:
        out = out.when(band_ == name, t)
    return out.otherwise(4)


def row_width(kv: Column) -> Column:
    out = F.when(kv.isNull() | (kv == 0), ROW_DEFAULT)
    for most, width in ROW_WIDTHS:
        out = out.when(kv <= most, width)
    return out


def impact(tier_: Column, cost_a: Column, cost_b: Column, kv_a: Column, kv_b: Column, shared_km: Column, overlaps: Column) -> dict[str, Column]:
    """Low and high totals: of what the timing allows, and if the schedules were aligned."""
    cost = F.least(F.nullif(cost_a, F.lit(0)), F.nullif(cost_b, F.lit(0)))
    share = lambda part, flat: F.when(cost.isNotNull(), F.bround(cost * part).cast("long")).otherwise(flat)
    acres = shared_km * 1000 * F.least(row_width(kv_a), row_width(kv_b)) * 0.5 / 4046.86
    land = lambda usd: F.when((tier_ <= 1) & (shared_km > 0), F.bround(acres * usd).cast("long")).otherwise(0)
    upto = lambda t, usd: F.when(tier_ <= t, usd).otherwise(0)
    timed = (share(0.01, 150_000) + upto(2, 100_000) + upto(0, 50_000), share(0.03, 400_000) + upto(2, 300_000) + upto(0, 250_000))
    fixed = (upto(1, 50_000) + land(5_000), upto(1, 200_000) + land(20_000))
    inside = tier_ <= 3
    own = {}
    for name, t, f in (("low", timed[0], fixed[0]), ("high", timed[1], fixed[1])):
        own[f"total_{name}"] = F.when(inside, F.when(overlaps, t).otherwise(0) + f).cast("long")
        own[f"if_aligned_{name}"] = F.when(inside, t + f).cast("long")
    return own
