"""Delimited plans, files by kind, rows as text, and the ledger of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")
#: Most characters of a cell.
CELL = 300
#: First bytes of files, in hexadecimal, by kind.
MAGIC = {"25504446": "pdf", "D0CF11E0A1B11AE1": "ole", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "1F8B": "gzip"}
#: Members that tell zip archives apart.
MEMBERS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}


def file_kind(content: Column, path: Column) -> Column:
    """The kind of a file by its bytes; its name only tells delimited texts from others."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    whole = F.decode(content, "ISO-8859-1")
    start = F.lower(F.ltrim(F.regexp_replace(text, "^ï»¿", "")))
    out = F.when(F.octet_length(content) == 0, "empty")
    for magic, kind in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    for member, kind in MEMBERS.items():
        out = out.when(head.startswith("504B0304") & F.contains(whole, F.lit(member)), kind)
    out = out.when(head.startswith("504B0304"), "zip").when(text.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"), "binary")
    out = out.when(start.rlike(r"^[\[{]") & F.try_parse_json(F.decode(content, "UTF-8")).isNotNull(), "json")
    out = out.when(start.rlike(r"^(<!doctype html|<html)"), "html").when(start.startswith("<?xml"), "xml")
    return out.when(F.lower(path).rlike(r"\.(csv|tsv)$"), "csv").otherwise("text")


def triage_files(files: DataFrame) -> DataFrame:
    """Files as ``binaryFile`` reads them (path, content) to path, format, length and sha."""
    return files.select("path", file_kind(F.col("content"), F.col("path")).alias("format"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha"))


#: Marks of a cell's and a row's end, which printed text does not hold.
CELL_END, ROW_END = "\x01", "\x02"


def split_plan(plans: DataFrame) -> DataFrame:
    """Texts of delimited plans (doc, text) to rows (doc, row, cells): the separator is the one that its first line holds most often.

    Cells are trimmed, line breaks in quotes become spaces, and a cell ends after ``CELL`` characters; quotes are doubled inside
    quotes. A text is split at its quotes first: separators and line breaks end a cell or a row in every other piece, those
    outside of quotes, so the work is in proportion to the text. A quote that is never closed holds to the end.
    """
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    counts = F.array(*[F.struct((F.length(first) - F.length(F.replace(first, F.lit(s)))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
    own = plans.withColumn("sep", F.array_max(counts)["s"])
    clean = F.replace(F.translate("text", CELL_END + ROW_END, ""), F.lit("\r\n"), F.lit("\n"))
    outside = lambda p: F.replace(F.replace(p, F.lit("\n"), F.lit(ROW_END)), F.col("sep"), F.lit(CELL_END))
    pieces = F.transform(F.split(clean, '"'), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(F.replace(p, F.lit("\n"), F.lit(" "))))
    rows = F.filter(F.split(F.array_join(pieces, '"'), ROW_END), lambda x: F.trim(F.translate(x, CELL_END, " ")) != "")
    bare = lambda c: F.substring(F.trim(F.replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))), 1, CELL)
    return own.select("doc", F.posexplode(rows).alias("row", "line")).select("doc", "row", F.transform(F.split("line", CELL_END), bare).alias("cells"))


def render_rows(rows: DataFrame) -> DataFrame:
    """Rows (doc, row, cells), the first of each document its header, to lines (doc, row, line): columns, then each row's cells that are not empty."""
    heads = rows.where("row = 0").select("doc", F.col("cells").alias("heads"))
    name = lambda i: F.coalesce(F.nullif(F.get("heads", i), F.lit("")), F.concat(F.lit("col"), (i + 1).cast("string")))
    named = F.transform("cells", lambda c, i: F.when(c != "", F.concat(name(i), F.lit("="), c)))
    own = rows.join(heads, "doc")
    line = F.when(F.col("row") == 0, F.concat(F.lit("Columns: "), F.array_join(F.transform("cells", lambda c, i: name(i)), ", "))).otherwise(F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), F.array_join(F.filter(named, lambda x: x.isNotNull()), "; ")))
    return own.select("doc", "row", line.alias("line"))


def list_plans(plans: DataFrame) -> DataFrame:
    return plans.orderBy(F.desc("created_at"), "plan_id")


def set_status(plans: DataFrame, changes: DataFrame) -> DataFrame:
    """Plans with the status and error of ``changes`` (plan_id, status, error); a change of no plan does nothing."""
    new = changes.select("plan_id", F.struct("status", "error").alias("new_"))
    joined = plans.join(new, "plan_id", "left")
    return joined.withColumns({c: F.when(F.col("new_").isNotNull(), F.col(f"new_.{c}")).otherwise(F.col(c)) for c in ("status", "error")}).drop("new_")


def insert_plans(plans: DataFrame, new: DataFrame) -> DataFrame:
    """The new plans in the place of those of the same id."""
    return plans.join(new.select("plan_id"), "plan_id", "left_anti").unionByName(new, allowMissingColumns=True)
