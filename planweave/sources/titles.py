"""Fields out of the titles and lines that plans print: page headers from glyphs, places, voltages, kinds, dates, line entries.

Titles are taken apart into words; what a word does is looked up in lists. One row gives one row, so all of it is
Column expressions; arrays hold the words of one title or line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import owners
from ..functions.stored import stored

#: Words behind the places of a title; words in front of them; words that part two places.
BEHIND = (
    "NEW TRANSMISSION TL LINE SUBSTATION SUB AREA NETWORK PROTECTION RELAY BREAKER STATCOM SWITCHING MODERNIZATION GENERATION SOLAR IMPROVEMENT IMPROVEMENTS "
    "UPGRADE UPGRADES REBUILD RECONDUCTOR REACTOR CAP BANK AUTOBANK TERMINAL EQUIPMENT OVERSTRESSED SOLUTION LIMITING"
).split()
VERBS = "REPLACE INSTALL ADD CONSTRUCT UPGRADE EXPAND".split()
VERB_PHRASES = ["REMOVE LIMITING ELEMENTS ON", "REMOVE LIMITING ELEMENTS AT"]
BETWEEN = ["-", "–", "TO", "AND", "&"]
#: Words of a title that tell lines and substations.
LINE_WORDS = "LINE LINES TL RECONDUCTOR REBUILD FIBER CIRCUIT".split()
SUB_WORDS = "SUBSTATION SUB AUTOTRANSFORMER AUTOTRANSFORMERS TRANSFORMER TRANSFORMERS BREAKER BREAKERS STATCOM CAPACITOR CAPACITORS REACTOR REACTORS CONDENSER BUS SVC TS SS".split()
#: The same for filings of one project a page, in lower case; words that begin a description's names.
BEHIND_PAGE = "sub substation transmission tap line tie loop rebuild rebld construct fold-in spdc".split()
LINE_WORDS_PAGE = "line tap tie loop rebuild rebld spdc section".split()
LEADING = "construct rebuild rebuilding replace replacing convert the".split()
#: Height of the header band and size of its letters, in points; what follows the area's name.
HEADER_TOP, HEADER_SIZE, HEADER_END = 80, 18, " Balancing Authority"

KV = r"((?:\d{2,3}(?:\.\d+)?\s*[-/]\s*)*\d{2,3}(?:\.\d+)?)\s*KV"


def header_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """Letters of pages (doc, page, top, x0, size, text) to the area that each page's header names: doc, page, area.

    Headers and watermarks lie over each other: letters of the header's size in its band are read line by line, a line
    being letters of one rounded height. Pages without such letters have an empty area.
    """
    header = (F.col("top") < HEADER_TOP) & (F.rint("size") == HEADER_SIZE)
    letter = F.when(header, F.struct(F.rint("top").alias("line"), F.col("x0"), F.col("text")))  # bround would print and parse each number
    read = glyphs.groupBy("doc", "page").agg(F.sort_array(F.collect_list(letter)).alias("letters"))
    text = F.array_join(F.col("letters")["text"], "")
    return read.select("doc", "page", F.trim(F.split_part(text, F.lit(HEADER_END), F.lit(1))).alias("area"))


def voltage(text: Column) -> Column:
    """The highest of the voltages that a text prints, several parted by strokes included; null if none."""
    groups = F.regexp_extract_all(F.upper(text), F.lit(KV), F.lit(1))
    return F.array_max(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[-/]\s*"))), lambda v: v.try_cast("double")))


def has_word(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.upper(text), "[^A-Z0-9]+"), F.array(*[F.lit(w.upper()) for w in words]))


def without_owner(name: Column) -> Column:
    """A title without the codes of owners in front of it."""
    return F.trim(F.regexp_replace(name, r"^\s*(?:[A-Z&]{2,6}:\s*)+", ""))


def before_first(words: Column, ends) -> Column:
    """The words before the first, but for the very first word, of which ``ends(word, index)`` is true."""
    at = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & ends(w, i), i)), lambda i: i.isNotNull())
    return F.slice(words, F.lit(1), F.coalesce(F.array_min(at), F.size(words)))


def endpoints(title: Column) -> Column:
    """Places in a title such as ``A - B 230 KV ...``: its words up to a voltage or a word for what is done, parted, each once."""
    head = F.split_part(F.upper(title), F.lit(","), F.lit(1))
    for phrase in VERB_PHRASES:
        head = F.when(head.startswith(phrase + " "), F.substr(head, F.lit(len(phrase) + 2))).otherwise(head)
    head = F.regexp_replace(F.regexp_replace(head, r"(?<=[A-Z])([-–])(?=[A-Z])", " $1 "), "&", " & ")
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    words = F.when(F.get(words, F.lit(0)).isin(VERBS), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    number = r"^\d{2,3}(\.\d+)?(/\d{2,3}(\.\d+)?)*"
    volts = lambda w, i: w.rlike(number + "KV") | (w.rlike(number + "$") & F.coalesce(F.get(words, i + 1).rlike("^(KV|/)"), F.lit(False)))
    kept = before_first(words, lambda w, i: volts(w, i) | F.regexp_replace(w, "[^A-Z0-9]+$", "").isin(BEHIND))
    parts = F.split(F.array_join(F.transform(kept, lambda w: F.when(w.isin(BETWEEN), "\t").otherwise(w)), " "), "\t")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= 3))


def title_parts(name: Column, description: Column) -> dict[str, Column]:
    """Title without owner codes, voltage (of the name, else of the description), places, and kind of a plan's entry."""
    title = without_owner(name)
    ends = endpoints(title)
    line = has_word(title, LINE_WORDS) | F.upper(title).rlike(r"\bLOOP[- ]IN\b")
    sub = has_word(title, SUB_WORDS) | F.upper(title).rlike(r"\bSWITCHING STATION\b")
    kind = F.when((sub & ~line) | (~line & (F.size(ends) < 2)), "substation").otherwise("transmission line")
    return {"title": title, "voltage_kv": F.coalesce(voltage(name), voltage(description)), "endpoints": ends, "kind": kind}


def page_endpoints(title: Column) -> Column:
    """Places with which the title of a one-page project begins."""
    head = F.regexp_replace(F.split_part(title, F.lit(":"), F.lit(1)), r"\(.*?\)", " ")
    head = F.regexp_replace(F.regexp_extract(head, r"(?i)^(.*?)(?:[,&]|\band\b|/|$)", 1), f"(?i){KV}.*$", "")
    place = lambda p: F.array_join(before_first(F.filter(F.split(p, r"\s+"), lambda w: w != ""), lambda w, i: F.lower(w).isin(BEHIND_PAGE)), " ")
    bare = F.transform(F.split(F.regexp_replace(head, r"(?i)\s+reservoir crossings?\b.*$", ""), r"\s*[-–]\s*"), place)
    return F.array_distinct(F.filter(bare, lambda p: (F.length(p) >= 3) & ~F.lower(p).rlike("^(construct|rebuild)")))


def described_endpoints(description: Column) -> Column:
    """Ends of the lines that a description names: capitalised words on either side of a dash, with a voltage behind."""
    sides = F.split(description, r"\s*[-–]\s*")
    run = r"(?:[A-Z][A-Za-z0-9.']*\s+)*"
    left = lambda i: F.regexp_extract(F.element_at(sides, i), rf"\b({run}[A-Z][A-Za-z0-9.']*)$", 1)
    right = lambda i: F.regexp_extract(F.element_at(sides, i + 1), rf"^({run}[A-Z][A-Za-z0-9.']*)\s+\d{{2,3}}\s*kV", 1)
    both = F.transform(F.sequence(F.lit(1), F.size(sides) - 1), lambda i: F.when((left(i) != "") & (right(i) != ""), F.array(left(i), right(i))))
    names = F.when(F.size(sides) > 1, F.flatten(F.filter(both, lambda p: p.isNotNull()))).otherwise(F.array().cast("array<string>"))

    def bare(name: Column) -> Column:
        words = F.split(name, r"\s+")
        own = F.filter(F.transform(words, lambda w, i: F.when(~F.lower(w).isin(LEADING), i + 1)), lambda i: i.isNotNull())
        return F.array_join(F.slice(words, F.coalesce(F.array_min(own), F.lit(1)), F.size(words)), " ")

    return F.array_distinct(F.filter(F.transform(names, bare), lambda n: F.length(n) >= 3))


def printed_dates(text: Column) -> tuple[Column, Column, Column]:
    """First and last of the dates month/day/year in a text, and their precision: a day that its month lacks leaves the month."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/(?:\d{4}|\d{2}))\b"), F.lit(1))

    def date(p: Column, day: Column) -> Column:
        year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
        return F.try_to_date(F.concat_ws("-", year, F.lpad(p[0], 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    whole = lambda d: date(F.split(d, "/"), F.split(d, "/")[1])
    month = lambda d: F.when(F.split(d, "/")[1].cast("int").between(1, 31), date(F.split(d, "/"), F.lit("1")))
    days = F.transform(found, lambda d: F.coalesce(whole(d), month(d)))
    rough = F.exists(found, lambda d: whole(d).isNull())
    return F.array_min(days), F.array_max(days), F.when(F.array_min(days).isNull(), None).when(rough, "month").otherwise("day")


def single_page_parts(title: Column, description: Column, date_text: Column) -> dict[str, Column]:
    """Of a project that has a page of its own: places of its title and of its description, dates, voltage, kind."""
    first, last, precision = printed_dates(date_text)
    ends = page_endpoints(title)
    line = has_word(title, LINE_WORDS_PAGE) | F.lower(title).rlike(r"\bfold-in\b")
    return {
        "endpoints": ends, "described": described_endpoints(description), "first_date": first, "last_date": last, "precision": precision,
        "voltage_kv": voltage(title), "kind": F.when((F.size(ends) >= 2) | line, "transmission line").otherwise("substation"),
    }


#: How a row of a form ends: month and year, kilovolts, megavolt-amperes. Years above this are misprints of a thousand less if they begin with 3.
FORM_END, MISPRINT = r"^(\d{1,2})\s*/\s*(\d{4})\s+(\d+(?:\.\d+)?)\s+\d+", 2100


def form_rows(words: DataFrame) -> DataFrame:
    """Words of form pages (page, top, text, x0, x1) to line entries: page, row, owner_code, terminal_a, terminal_b, miles, month, year, voltage_kv.

    A row is the words of one rounded height. It begins with the owners' code; the first number from the third word on is
    the miles; the words between are the two terminals, parted at the widest gap, the first of equals. Other rows are left out.
    """
    word = F.struct(F.col("x0"), F.col("x1"), F.col("text").alias("t"))
    rows = words.groupBy("page", F.rint("top").cast("long").alias("row")).agg(F.sort_array(F.collect_list(word)).alias("w"))
    rows = rows.where((F.size("w") >= 6) & F.get("w", F.lit(0))["t"].rlike("^[A-Z]{2,4}(-[A-Z]{2,4})?$"))
    number = F.filter(F.transform("w", lambda w, i: F.when((i >= 2) & w["t"].rlike(r"^\d+(\.\d+)?$"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("n", F.array_min(number)).where("n >= 3")
    text = lambda a: F.array_join(F.transform(a, lambda w: w["t"]), " ")
    rows = rows.withColumns({"end": text(F.slice("w", F.col("n") + 2, F.size("w"))), "terms": F.slice("w", F.lit(2), F.col("n") - 1)}).where(F.col("end").rlike(FORM_END))
    gap = lambda i: F.struct((F.element_at("terms", i + 1)["x0"] - F.element_at("terms", i)["x1"]).alias("gap"), (-i).alias("i"))
    rows = rows.withColumn("cut", -F.array_max(F.transform(F.sequence(F.lit(1), F.size("terms") - 1), gap))["i"])
    part = lambda i: F.regexp_extract("end", FORM_END, i)
    return rows.select(
        "page", "row", F.get("w", F.lit(0))["t"].alias("owner_code"), text(F.slice("terms", F.lit(1), F.col("cut"))).alias("terminal_a"), text(F.slice("terms", F.col("cut") + 1, F.size("terms"))).alias("terminal_b"),
        F.get("w", F.col("n"))["t"].cast("double").alias("miles"), part(1).cast("int").alias("month"), part(2).cast("int").alias("year"), part(3).cast("double").alias("voltage_kv"),
    )


def line_entry_parts(rows: DataFrame) -> DataFrame:
    """Entries (owner_code, terminal_a, terminal_b, month, year, voltage_kv, ...) with owner, end_a, end_b, title, in_service and note.

    A terminal loses the owner's code in front of it and what stands in parentheses; a misprinted year is read and noted.
    Names are read once per distinct code and terminal, not per entry; entries are stored for that.
    """
    rows = stored(rows, "entries")
    codes = F.split("owner_code", "-")

    def bare(terminal: str) -> Column:
        words = F.split(F.trim(terminal), r"\s+")
        rest = F.when((F.size(words) > 1) & F.array_contains(codes, words[0]), F.slice(words, 2, F.size(words))).otherwise(words)
        return F.trim(F.regexp_replace(F.array_join(rest, " "), r"\s*\(.*?\)", ""))

    wrong = (F.col("year") > MISPRINT) & F.col("year").cast("string").startswith("3")
    year = F.when(wrong, F.col("year") - 1000).otherwise(F.col("year"))
    short = lambda c: owners.title_case(F.regexp_replace(c, r"\s+(SUBSTATION|SWITCHING STATION)$", ""))

    def read(df: DataFrame, column: str, name: str, value) -> DataFrame:
        known = df.select(F.col(column).alias("key_")).where("key_ IS NOT NULL").distinct()
        known = stored(owners.once(known, name, value(F.col("key_"))), "names")
        return df.join(known, F.col(column) == F.col("key_"), "left").drop("key_")

    kv = F.regexp_replace(F.col("voltage_kv").cast("string"), r"\.0$", "")
    out = rows.withColumns({"end_a": bare("terminal_a"), "end_b": bare("terminal_b")})
    for column, name, value in (("owner_code", "owner_", owners.canonical_utility), ("end_a", "short_a_", short), ("end_b", "short_b_", short)):
        out = read(out, column, name, value)
    return out.withColumns({
        "owner": F.coalesce("owner_", "owner_code"), "title": F.concat("short_a_", F.lit(" - "), "short_b_", F.lit(" "), kv, F.lit(" kV Line")),
        "in_service": F.try_to_date(F.format_string("%04d-%02d-01", year, F.col("month")), "yyyy-MM-dd"),
        "note": F.when(wrong, F.format_string("printed %d/%d; read as %d", "month", "year", year)).otherwise(""),
    }).drop("owner_", "short_a_", "short_b_")
