"""Dates of partial precision as Columns: periods, build windows, overlaps, spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAD_MONTHS = 12
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def period_start(date: Column, precision: Column) -> Column:
    of = lambda unit: F.trunc(date, unit)
    return F.when(precision == "year", of("YEAR")).when(precision == "quarter", of("QUARTER")).when(precision == "month", of("MONTH")).otherwise(date)


def period_end(date: Column, precision: Column) -> Column:
    last = lambda unit, n: F.date_sub(F.add_months(F.trunc(date, unit), n), 1)
    return F.when(precision == "year", last("YEAR", 12)).when(precision == "quarter", last("QUARTER", 3)).when(precision == "month", last("MONTH", 1)).otherwise(date)


def build_window(start: Column, end: Column, sp: Column, ep: Column) -> tuple[Column, Column]:
    """First and last day of the build: a real range as published, else a year up to the in-service period."""
    real = start.isNotNull() & end.isNotNull() & (start < end)
    date, precision = F.coalesce(end, start), F.when(end.isNotNull(), ep).otherwise(sp)
    first = F.when(real, period_start(start, sp)).otherwise(F.add_months(period_start(date, precision), -LEAD_MONTHS))
    return first, F.when(real, period_end(end, ep)).otherwise(period_end(date, precision))


def compare(a0: Column, a1: Column, b0: Column, b1: Column) -> dict[str, Column]:
    """Shared window, overlap days, share of both windows together, days between the in-service ends."""
    first, last = F.greatest(a0, b0), F.least(a1, b1)
    meet = first <= last
    days = F.when(meet, F.datediff(last, first) + 1).otherwise(0)
    all_days = F.datediff(a1, a0) + 1 + F.datediff(b1, b0) + 1 - days
    return {"window_start": F.when(meet, first), "window_end": F.when(meet, last), "overlap_days": days, "ratio": days / all_days, "gap_days": F.abs(F.datediff(a1, b1))}


def parse_partial_date(text: Column) -> tuple[Column, Column]:
    """First day and precision of the spellings in which plans print dates; nulls if none fits."""
    t = F.lower(F.trim(text))
    month = lambda i, p: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.regexp_extract(t, p, i), 1, 3))
    number = lambda i, p: F.regexp_extract(t, p, i).try_cast("int")
    names = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
    iso, us = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ].*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    forms = [
        (iso, "day", lambda p: (number(1, p), number(2, p), number(3, p))), (us, "day", lambda p: (number(3, p), number(1, p), number(2, p))),
        (r"^(\d{4})-(\d{1,2})$", "month", lambda p: (number(1, p), number(2, p), F.lit(1))), (r"^(\d{1,2})/(\d{4})$", "month", lambda p: (number(2, p), number(1, p), F.lit(1))),
        (r"^q([1-4])\s*(?:fy\s*)?(\d{4})$", "quarter", lambda p: (number(2, p), number(1, p) * 3 - 2, F.lit(1))), (r"^(?:fy\s*)?(\d{4})\s*q([1-4])$", "quarter", lambda p: (number(1, p), number(2, p) * 3 - 2, F.lit(1))),
        (r"^([1-4])q\s*(\d{4})$", "quarter", lambda p: (number(2, p), number(1, p) * 3 - 2, F.lit(1))), (r"^(?:fy|cy)?\s*(\d{4})$", "year", lambda p: (number(1, p), F.lit(1), F.lit(1))),
        (rf"^{names}\s+(\d{{4}})$", "month", lambda p: (number(2, p), month(1, p), F.lit(1))),
        (rf"^{names}\s+(\d{{1,2}}),?\s+(\d{{4}})$", "day", lambda p: (number(3, p), month(1, p), number(2, p))), (rf"^(\d{{1,2}})\s+{names},?\s+(\d{{4}})$", "day", lambda p: (number(3, p), month(2, p), number(1, p))),
    ]
    date = F.coalesce(*[F.when(t.rlike(p), F.try_to_date(F.format_string("%04d-%02d-%02d", *[x.cast("int") for x in of(p)]), "yyyy-MM-dd")) for p, _, of in forms])
    precision = F.coalesce(*[F.when(t.rlike(p), F.lit(kind)) for p, kind, _ in forms])
    return date, F.when(date.isNotNull(), precision)
