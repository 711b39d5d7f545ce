import datetime

import pytest
from pyspark.sql import functions as F

from planweave.sources import titles

DAY = datetime.date


def one(spark, **texts):
    return spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))


@pytest.mark.parametrize(("name", "ends", "kv", "kind"), [
    ("GTC: ADAMSVILLE - BUZZARD ROOST 230 KV REBUILD", ["ADAMSVILLE", "BUZZARD ROOST"], 230, "transmission line"),
    ("SOCO: REPLACE HURRICANE CREEK 230/115 KV AUTOBANK", ["HURRICANE CREEK"], 230, "substation"),
    ("LAWSONS FORK TIE - WEST SPARTANBURG TIE 100 KV TRANSMISSION LINES, INSTALL RAS", ["LAWSONS FORK TIE", "WEST SPARTANBURG TIE"], 100, "transmission line"),
    ("SOCO: ASHLEY PARK-WANSLEY 500 KV LINE", ["ASHLEY PARK", "WANSLEY"], 500, "transmission line"),
    ("SOCO: REMOVE LIMITING ELEMENTS ON SOUTH COWETA 115 KV", ["SOUTH COWETA"], 115, "substation"),
    ("SOCO: LINE CREEK TERMINAL EQUIPMENT REPLACEMENT", ["LINE CREEK"], 161, "transmission line"),
    ("CAMPOBELLO TIE AND CAMPOBELLO TIE 100 KV", ["CAMPOBELLO TIE"], 100, "substation"),
    ("SAV: MCINTOSH - PURRYSBURG 230KV REACTORS", ["MCINTOSH", "PURRYSBURG"], 230, "substation"),
    ("EVANS PRIMARY - THOMSON PRIMARY 115KV REBUILD", ["EVANS PRIMARY", "THOMSON PRIMARY"], 115, "transmission line"),
    ("", [], 161, "substation"),
])
def test_title_parts(spark, name, ends, kv, kind):
    r = one(spark, name=name, d="Loop in the 161 kV line").withColumns(titles.title_parts(F.col("name"), F.col("d"))).first()
    assert (r.endpoints, r.voltage_kv, r.kind) == (ends, kv, kind)


@pytest.mark.parametrize(("title", "ends"), [
    ("Jasper – Okatie 230 kV #2: Construct", ["Jasper", "Okatie"]),
    ("Okatie 230-115kV Substation, Jasper – Yemassee 230kV #1 Fold-in", ["Okatie"]),
    ("Stevens Creek - Hooks 115kV/LR Plumb Branch 46kV Rebuilds", ["Stevens Creek", "Hooks"]),
    ("Harleyville 115KV Transmission Tap – Construct (1.4 miles)", ["Harleyville"]),
    ("Edenwood Sub: #1 & #2 230-115kV Autobanks, Replace with 336MVA", ["Edenwood"]),
    ("Canadys-Ritter 115KV-Rebld SPDC 230/115KV 1272 (Approx 18 Miles)", ["Canadys", "Ritter"]),
])
def test_page_titles(spark, title, ends):
    r = one(spark, t=title, d="", w="10/1/2025 (phase 1) and 10/1/26").withColumns(titles.single_page_parts(F.col("t"), F.col("d"), F.col("w"))).first()
    assert r.endpoints == ends and (r.first_date, r.last_date, r.precision) == (DAY(2025, 10, 1), DAY(2026, 10, 1), "day")


@pytest.mark.parametrize(("text", "ends"), [
    ("Construct Okatie – Riverport 230 kV to feed new Distribution substation.", ["Okatie", "Riverport"]),
    ("Fold in the existing Canadys – Church Creek and Canadys – Faber Place 230kV lines at the Dawson 230kV substation (phase 1). Rebuild Canadys – Dawson 230kV #1 and #2 with B1272 ACSR (phase 2).", ["Canadys", "Faber Place", "Dawson"]),
    ("Rebuilding the Williams Goose Creek 230 and 115 kV lines and the Williams - Faber Place 230 kV line across the Goose Creek Reservoir.", ["Williams", "Faber Place"]),
    ("Replace wooden H-Frame structures with Self Supporting Steel Structures.", []),
    (None, []),
])
def test_described_lines(spark, text, ends):
    assert one(spark, d=text).select(titles.described_endpoints(F.col("d")).alias("e")).first().e == ends


def test_dates_that_no_month_has(spark):
    r = one(spark, w="4/31/26").select(*titles.printed_dates(F.col("w"))).first()
    assert tuple(r) == (DAY(2026, 4, 1), DAY(2026, 4, 1), "month")
    assert tuple(one(spark, w="to be set").select(*titles.printed_dates(F.col("w"))).first()) == (None, None, None)


def words(spark, rows):
    return spark.createDataFrame([(62, float(20 * i) + (0.3 if j % 2 else 0.0), t, float(x), float(x + 6 * len(t))) for i, row in enumerate(rows) for j, (t, x) in enumerate(row)], "page int, top double, text string, x0 double, x1 double")


def test_form_rows_part_at_the_widest_gap(spark):
    rows = [
        [("OWNERSHIP", 32), ("TERMINALS", 229), ("CKT.", 424)],
        [("DEF", 50), ("NOVA", 99), ("SUBSTATION", 126), ("SWEETWATER", 258), ("SUBSTATION", 324), ("1.0", 443), ("01/2028", 508), ("230", 588), ("919", 647), ("NA", 705)],
        [("DEF-SEC", 39), ("DEF", 99), ("MARTIN", 119), ("WEST", 155), ("SEC", 258), ("SILVER", 278), ("SPRINGS", 312), ("NORTH", 354), ("1.0", 443), ("3/2026", 511), ("230", 588), ("1195", 645), ("NA", 705)],
        [("FPL", 51), ("OASIS", 99), ("QUARRY", 257), ("15", 444), ("12/3033", 508), ("500", 588), ("3464", 645), ("NA", 705)],
        [("PEC", 95), ("SOUTHPORT", 164), ("HIGHPOINT", 273), ("7.3", 402), ("12", 470), ("/", 481), ("2026", 486), ("115", 555), ("217", 621), ("NA", 682)],
    ]
    nova, joint, oasis, pec = titles.line_entry_parts(titles.form_rows(words(spark, rows))).orderBy("row").collect()
    assert (nova.owner, nova.end_a, nova.end_b, nova.title) == ("Duke Energy Florida", "NOVA SUBSTATION", "SWEETWATER SUBSTATION", "Nova - Sweetwater 230 kV Line")
    assert (nova.in_service, nova.miles, nova.note) == (DAY(2028, 1, 1), 1.0, "")
    assert (joint.owner, joint.end_a, joint.end_b) == ("Duke Energy Florida / Seminole Electric Cooperative", "MARTIN WEST", "SILVER SPRINGS NORTH")
    assert oasis.in_service == DAY(2033, 12, 1) and oasis.note == "printed 12/3033; read as 2033"
    assert (pec.owner, pec.end_a, pec.end_b, pec.in_service) == ("PowerSouth", "SOUTHPORT", "HIGHPOINT", DAY(2026, 12, 1))


def test_header_under_a_watermark(spark):
    text = "SOUTHERN Balancing Authority Area"
    header = [(1, 30.2 if i % 2 else 29.8, 10.0 + 9 * i, 18.1, ch) for i, ch in enumerate(text)]
    mark = [(1, 30.0, 11.0 + 9 * i, 40.0, "D") for i in range(12)] + [(1, 300.0, 5.0, 18.0, "x"), (2, 400.0, 5.0, 18.0, "y")]
    glyphs = spark.createDataFrame([("d", *g) for g in reversed(header + mark)], "doc string, page int, top double, x0 double, size double, text string")
    assert sorted(tuple(r) for r in titles.header_from_glyphs(glyphs).collect()) == [("d", 1, "SOUTHERN"), ("d", 2, "")]


def test_names_are_read_once_per_code_and_terminal(spark, monkeypatch):
    rows = [(1, i, c, a, "B SUBSTATION", 1.0, 1, 2030, 230.0) for i, (c, a) in enumerate([("DEF", "DEF JASPER"), ("DEF", "DEF JASPER"), (None, None)])]
    own = spark.createDataFrame(rows, "page long, row long, owner_code string, terminal_a string, terminal_b string, miles double, month int, year int, voltage_kv double")
    asked, read = [], titles.owners.once
    monkeypatch.setattr(titles.owners, "once", lambda df, name, value: asked.append(df.count()) or read(df, name, value))
    got = titles.line_entry_parts(own)
    assert asked == [1, 1, 1] and not {"owner_", "short_a_", "short_b_", "key_"} & set(got.columns)
    assert [(r.owner, r.end_a, r.title) for r in got.orderBy("row").collect()] == [("Duke Energy Florida", "JASPER", "Jasper - B 230 kV Line")] * 2 + [(None, None, None)]


def test_heights_between_two_lines_go_to_the_even_one(spark):
    glyphs = spark.createDataFrame([(1, 1, top, x, 18.2, t) for top, x, t in [(0.5, 1.0, "A"), (-0.3, 2.0, "B"), (1.5, 0.0, "D"), (2.5, 0.5, "E"), (0.2, 3.0, "C")]], "doc int, page int, top double, x0 double, size double, text string")
    header = titles.header_from_glyphs(glyphs)
    assert header.first().area == "ABCDE" and "bround" not in header._jdf.queryExecution().toString()
