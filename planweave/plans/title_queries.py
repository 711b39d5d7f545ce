"""Registered queries over the titles, headers and form lines of plans; what goes in is printed from the tables, so SQL knows what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import titles
from .fixtures import PLACES, PROJECTS_SQL, pick, projects, table

WITH = f"WITH {PROJECTS_SQL} "
#: Titles with two places {a} and {b}; what they say: places, kilovolts, kind.
FORMS = [
    ("GTC: {a} - {b} 230 KV REBUILD", "{a}|{b}", 230, "transmission line"), ("SOCO: REPLACE {a} 230/115 KV AUTOBANK", "{a}", 230, "substation"),
    ("{a} TIE - WEST {b} TIE 100 KV TRANSMISSION LINES, INSTALL RAS", "{a} TIE|WEST {b} TIE", 100, "transmission line"), ("SOCO: {a}-{b} 500 KV LINE", "{a}|{b}", 500, "transmission line"),
    ("SOCO: REMOVE LIMITING ELEMENTS ON SOUTH {a} 115 KV", "SOUTH {a}", 115, "substation"), ("{a} AND {a} SUBSTATION NEW BREAKERS", "{a}", 161, "substation"),
]
PAGES = [
    ("{a} – {b} 230 kV #2: Construct", "Construct {b} – Riverport 115 kV to feed it.", "{a}|{b}", "{b}|Riverport", 230, "transmission line"), ("{a} Sub: #1 & #2 230-115kV Autobanks, Replace", "Replace transformers.", "{a}", "", 230, "substation"),
    ("{a}-{b} 115KV-Rebld SPDC 230/115KV 1272 (Approx 18 Miles)", "Rebuild {a} – {b} 115kV #1.", "{a}|{b}", "{a}|{b}", 230, "transmission line"), ("{a} 115KV Transmission Tap – Construct (1.4 miles)", "The {a} - {b} 46 kV line.", "{a}", "{a}|{b}", 115, "transmission line"),
]


def filled(text: Column, a: Column, b: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{a}"), a), F.lit("{b}"), b)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.split(F.regexp_replace("name", " Rebuild$", ""), " - ")
    return projects(spark, sf_dir).select("id", ends[0].alias("a"), ends[1].alias("b"))


def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, voltages and kinds out of printed titles."""
    own = named(spark, sf_dir)
    name = filled(pick([f[0] for f in FORMS], F.col("id") % len(FORMS)), F.upper("a"), F.upper("b"))
    parts = own.select("id", name.alias("name"), F.lit("Loop in the 161 kV line").alias("d")).withColumns(titles.title_parts(F.col("name"), F.col("d")))
    return parts.select("id", "title", "voltage_kv", F.array_join("endpoints", "|").alias("endpoints"), "kind")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of titles and descriptions, dates and voltages of projects with a page of their own; each seventh prints April 31."""
    own, k = named(spark, sf_dir), F.col("id")
    text = lambda i: filled(pick([p[i] for p in PAGES], k % len(PAGES)), F.col("a"), F.col("b"))
    dates = F.when(k % 7 == 0, "4/31/26").otherwise(F.format_string("%d/%d/%d (phase 1) and 12/1/2029", k % 12 + 1, k % 28 + 1, 2025 + k % 4))
    own = own.select("id", text(0).alias("t"), text(1).alias("d"), dates.alias("w")).withColumns(titles.single_page_parts(F.col("t"), F.col("d"), F.col("w")))
    return own.select("id", F.array_join("endpoints", "|").alias("endpoints"), F.array_join("described", "|").alias("described"), "first_date", "last_date", "precision", "voltage_kv", "kind")


def form_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of form pages set from orders, read back to line entries: joint owners, a misprinted year, headers between."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k = F.col("k")
    code = pick(["DEF", "DEF-SEC", "FPL", "PEC", "OWNERSHIP"], k % 5)
    first = F.when(k % 5 == 1, F.concat(F.lit("DEF "), F.upper(pick(PLACES, k % 16)))).otherwise(F.concat(F.upper(pick(PLACES, k % 16)), F.lit(" SUBSTATION")))
    last = F.concat(F.upper(pick(PLACES, F.col("c") % 16)), F.lit(" WEST"))
    when = F.concat((k % 12 + 1).cast("string"), F.lit("/"), F.when(k % 9 == 0, F.lit("3033")).otherwise((2026 + k % 8).cast("string")))
    side = lambda t, x: F.transform(F.split(t, " "), lambda w, i: F.struct((F.lit(float(x)) + i * 40.0).alias("x0"), w.alias("text")))
    cells = F.concat(side(code, 40), side(first, 99), side(last, 260), side(F.concat_ws(" ", F.lit("7.5"), when, F.lit("230"), F.lit("919"), F.lit("NA")), 440))
    words = o.select((k % 97).alias("page"), k.cast("double").alias("top"), F.inline(cells)).withColumn("x1", F.col("x0") + 30.0)
    own = titles.line_entry_parts(titles.form_rows(words))
    return own.select("row", "owner", "end_a", "end_b", "title", "in_service", "miles", "note")


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order: the area's letters over a watermark's, set in any order, and read."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("page"))
    area = F.concat(pick(["SOUTHERN", "DUKE PROGRESS EAST", "LG&E/KU", "TVA"], F.col("page") % 4), F.lit(" Balancing Authority Area"))
    letters = lambda t, size, x, n: F.transform(F.split(t, ""), lambda ch, i: F.struct((30.0 + (i % 2) * 0.3).alias("top"), (x + 9.0 * i).alias("x0"), F.lit(size).alias("size"), ch.alias("text")))
    glyphs = o.select("doc", "page", F.inline(F.concat(letters(F.lit("CONFIDENTIAL"), 40.0, 11.0, 0), letters(area, 18.2, 10.0, 0))))
    return titles.header_from_glyphs(glyphs)


_text = lambda values, k: "list_extract([" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"], CAST({k}+1 AS INT))"
_fill = lambda t, a, b: f"replace(replace({t}, '{{a}}', {a}), '{{b}}', {b})"
_once = lambda t: f"array_to_string(list_filter(string_split({t},'|'), lambda x, i: list_position(string_split({t},'|'), x)=i), '|')"
_NAMED = WITH + ", n AS (SELECT id, string_split(replace(name,' Rebuild',''),' - ')[1] AS a, string_split(replace(name,' Rebuild',''),' - ')[2] AS b, id%6 AS f, id%4 AS p FROM projects)"

SQL = {
    "title_parts": _NAMED + f""" SELECT id, regexp_replace({_fill(_text([f[0] for f in FORMS], 'f'), 'upper(a)', 'upper(b)')}, '^[A-Z]+: ', '') AS title, {_text([f[2] for f in FORMS], 'f')}::DOUBLE AS voltage_kv,
      {_once(_fill(_text([f[1] for f in FORMS], 'f'), 'upper(a)', 'upper(b)'))} AS endpoints, {_text([f[3] for f in FORMS], 'f')} AS kind FROM n""",
    "page_parts": _NAMED + f""", d AS (SELECT *, make_date(2025+id%4, id%12+1, id%28+1) AS d0 FROM n) SELECT id, {_once(_fill(_text([p[2] for p in PAGES], 'p'), 'a', 'b'))} AS endpoints, {_once(_fill(_text([p[3] for p in PAGES], 'p'), 'a', 'b'))} AS described,
      CASE WHEN id%7=0 THEN DATE '2026-04-01' ELSE d0 END AS first_date, CASE WHEN id%7=0 THEN DATE '2026-04-01' ELSE DATE '2029-12-01' END AS last_date, CASE WHEN id%7=0 THEN 'month' ELSE 'day' END AS precision,
      {_text([p[4] for p in PAGES], 'p')}::DOUBLE AS voltage_kv, CASE WHEN p=0 AND a=b THEN 'substation' ELSE {_text([p[5] for p in PAGES], 'p')} END AS kind FROM d""",
    "form_entries": f"""WITH o AS (SELECT o_orderkey AS k, {_text(PLACES, 'o_orderkey%16')} AS a, {_text(PLACES, 'o_custkey%16')} AS b FROM orders WHERE o_orderkey%5<>4),
      y AS (SELECT *, CASE WHEN k%9=0 THEN 2033 ELSE 2026+k%8 END AS year FROM o)
      SELECT k AS row, {_text(['Duke Energy Florida', 'Duke Energy Florida / Seminole Electric Cooperative', 'Florida Power & Light', 'PowerSouth'], 'k%5')} AS owner, upper(a)||CASE WHEN k%5=1 THEN '' ELSE ' SUBSTATION' END AS end_a, upper(b)||' WEST' AS end_b,
        a||' - '||b||' West 230 kV Line' AS title, make_date(year, k%12+1, 1) AS in_service, 7.5::DOUBLE AS miles, CASE WHEN k%9=0 THEN 'printed '||(k%12+1)||'/3033; read as 2033' ELSE '' END AS note FROM y""",
    "page_headers": "SELECT o_orderkey%50 AS doc, o_orderkey AS page, list_extract(['SOUTHERN','DUKE PROGRESS EAST','LG&E/KU','TVA'], CAST(o_orderkey%4+1 AS INT)) AS area FROM orders",
}

QUERIES = {f.__name__: f for f in (title_parts, page_parts, form_entries, page_headers)}
