"""Fields out of texts: plan pages in blocks or sections, table lines, loose records, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State names and codes; loose spellings of project types.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM",
    "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
TYPES = {"substation": "substation", "switching station": "substation", "transmission line": "transmission line", "line": "transmission line", "transmission": "transmission line", "generation": "generation", "generator": "generation"}


def state_code(text: Column) -> Column:
    """Code of a state's name or code; null if neither."""
    t = F.upper(F.trim(text))
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.when(t.isin(list(STATES.values())), t).otherwise(F.try_element_at(names, t))


def coerce_type(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.trim(text)))


def parse_block_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) of entries In-Service Year, Project Name, Description: a row per entry."""
    entry = F.explode(F.split("text", r"(?=In-Service Year:)"))
    blocks = pages.select("doc", "page", entry.alias("t")).where(F.col("t").rlike("^In-Service Year:"))
    field = lambda a, b: F.trim(F.regexp_replace(F.regexp_extract("t", rf"(?s){a}:\s*(.*?)\s*{b}", 1), r"\s+", " "))
    return blocks.select("doc", "page", field("In-Service Year", "Project Name:").try_cast("int").alias("year"), field("Project Name", "Description:").alias("name"), field("Description", r"(?:Supporting|$)").alias("description"))


HEADINGS = ("Project ID", "Project Description", "Project Need", "Planned In-Service Date", "Estimated Project Cost")


def parse_section_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) with one project each, text under known headings; pages that lack one are left out."""
    section = lambda a, b: F.trim(F.regexp_extract("text", rf"(?s){a}\n(.*?)\n{b}", 1))
    whole = F.lit(True)
    for h in HEADINGS:
        whole = whole & F.col("text").contains(h + "\n")
    money = F.transform(F.regexp_extract_all(F.regexp_extract("text", rf"(?s){HEADINGS[-1]}\n(.*)$", 1), F.lit(r"\$([\d,]+)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))
    fields = [section(a, b) for a, b in zip(HEADINGS, HEADINGS[1:])]
    return pages.where(whole).select("doc", "page", fields[0].alias("project"), fields[1].alias("description"), fields[2].alias("need"), fields[3].alias("date_text"), F.element_at(money, -1).alias("cost_usd"))


LINE = r"^(\S+)\s+(.+?) - (\d+) to (.+?) - (\d+)\s+(\d{2})/(\d{4})\s+(\d+)\s+([\d.]+)$"


def parse_table_lines(pages: DataFrame) -> DataFrame:
    """One row per line of a page that reads as kind, two ends with their bus numbers, month, kV and miles."""
    own = pages.select("doc", F.explode(F.split("text", "\n")).alias("t")).where(F.col("t").rlike(LINE))
    g = lambda i: F.regexp_extract("t", LINE, i)
    return own.select("doc", g(1).alias("kind"), g(2).alias("from_end"), g(3).cast("long").alias("from_bus"), g(4).alias("to_end"), g(5).cast("long").alias("to_bus"), F.make_date(g(7).cast("int"), g(6).cast("int"), F.lit(1)).alias("in_service"), g(8).cast("int").alias("kv"), g(9).cast("double").alias("miles"))


RAW = "id long, name string, kv string, page string, state string, kind string, start string, finish string, certainty double"


def normalise_records(raw: DataFrame, n_pages: int) -> DataFrame:
    """Loose JSON records (json) to typed rows with a confidence of certainty and completeness."""
    r = raw.select(F.from_json("json", RAW).alias("r")).select("r.*")
    kv = F.regexp_extract("kv", r"([\d.]+)", 1).try_cast("double")
    kv = F.when(kv.between(0.1, 2000), F.greatest(F.lit(1), F.bround(kv).cast("int")))
    page = F.regexp_extract("page", r"(\d+)", 1).try_cast("int")
    start, finish = F.try_to_date("start", "yyyy-MM-dd"), F.try_to_date("finish", "yyyy-MM-dd")
    out = r.select("id", F.nullif(F.trim("name"), F.lit("")).alias("name"), kv.alias("voltage_kv"), F.when(page.between(1, n_pages), page).alias("page"), state_code(F.col("state")).alias("state"), coerce_type(F.col("kind")).alias("type"), start.alias("start_date"), F.when(start.isNull() | (finish >= start), finish).alias("end_date"), "certainty")
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("voltage_kv", "page", "state", "type", "start_date")), F.col("name").isNotNull().cast("int"))
    return out.withColumn("confidence", F.round(0.6 * F.coalesce("certainty", F.lit(0.5)) + 0.4 * filled / 6, 4)).drop("certainty")


def print_date(date: str, precision: str) -> Column:
    return F.when(F.col(precision) == "year", F.date_format(date, "yyyy")).when(F.col(precision).isin("month", "quarter"), F.date_format(date, "yyyy-MM")).otherwise(F.date_format(date, "yyyy-MM-dd"))


def write_snapshot(projects: DataFrame) -> DataFrame:
    """Rows as text: dates at their precision, the route as ``lat lng;lat lng``."""
    point = lambda i: F.concat_ws(" ", F.format_string("%.6f", f"lat{i}"), F.format_string("%.6f", f"lng{i}"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return projects.select(text("id").alias("id"), text("utility").alias("utility"), text("state").alias("state"), text("voltage_kv").alias("voltage_kv"), F.coalesce(print_date("end_date", "end_precision"), F.lit("")).alias("in_service"), F.when(F.col("routed"), F.concat_ws(";", point(1), point(2))).otherwise("").alias("route"))


def read_snapshot(rows: DataFrame) -> DataFrame:
    """The inverse: blanks are null, a date's precision is that of its spelling."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = blank("in_service")
    date = F.try_to_date(F.when(F.length(d) == 4, F.concat(d, F.lit("-01-01"))).when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d), "yyyy-MM-dd")
    precision = F.when(F.length(d) == 4, "year").when(F.length(d) == 7, "month").when(F.length(d) == 10, "day")
    route = F.transform(F.split(blank("route"), ";"), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("lat"), F.split(p, " ")[1].cast("double").alias("lng")))
    return rows.select(blank("id").cast("long").alias("id"), blank("utility").alias("utility"), blank("state").alias("state"), blank("voltage_kv").cast("int").alias("voltage_kv"), date.alias("in_service"), precision.alias("precision"), route.alias("route"))
