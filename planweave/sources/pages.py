"""Tables out of the text of pages: rows that wrap, page selections, page runs, words in columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitch_wrapped_rows(lines: DataFrame, start: str, skip: str | None = None) -> DataFrame:
    """Lines (doc, page, line, text) joined to records: one begins where the text matches ``start``; others go on, also over pages.

    Lines that match ``skip``, and not ``start``, belong to none. Records are numbered by counts: of starts within a page,
    and of the pages before; so a document's lines are never in one task, only its pages' counts. A dash that a line ends
    with gets its blank back.
    """
    begins = F.coalesce(F.col("text").rlike(start), F.lit(False))
    own = lines.withColumn("begins", begins.cast("int"))
    if skip is not None:
        own = own.where((F.col("begins") == 1) | ~F.coalesce(F.col("text").rlike(skip), F.lit(True)))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("doc", "page").agg(F.sum("begins").alias("n")).select("doc", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = own.join(counts, ["doc", "page"])
    island = own.withColumn("record", F.col("before") + F.sum("begins").over(Window.partitionBy("doc", "page").orderBy("line"))).where("record > 0")
    parts = F.sort_array(F.collect_list(F.struct("page", "line", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.trim(p["text"])), " ")
    return island.groupBy("doc", "record").agg(F.regexp_replace(text, r"(\w)- (\w)", "$1 - $2").alias("text"))


def page_runs(pages: DataFrame) -> DataFrame:
    """Distinct pages (doc, page) as text: ``1-3,7,9-10``."""
    order = Window.partitionBy("doc").orderBy("page")
    runs = pages.distinct().withColumn("g", F.col("page") - F.row_number().over(order)).groupBy("doc", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("pages"))


#: A part of a page selection: a page, or its first and last.
PART = r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$"


def page_specs(specs: DataFrame, counts: DataFrame) -> DataFrame:
    """Selections (doc, spec) such as ``18-45, 50`` against the documents' page counts (doc, n, perhaps first): doc, ranges, normal, error.

    ``normal`` names the pages in order, each once. A selection with a part that is no page or range, runs backwards, or lies
    outside of the document has an error and no ranges; a blank one selects every page.
    """
    part = lambda p, i: F.nullif(F.regexp_extract(p, PART, i), F.lit("")).cast("long")
    parts = F.transform(F.split("spec", ","), lambda p: F.struct(part(p, 1).alias("a"), F.coalesce(part(p, 2), part(p, 1)).alias("b")))
    own = specs.join(counts, "doc").withColumn("parts", F.when(F.trim("spec") == "", F.array(F.struct(F.lit(1).cast("long").alias("a"), F.col("n").cast("long").alias("b")))).otherwise(parts))
    wrong = F.exists("parts", lambda p: p["a"].isNull())
    first = F.col("first") if "first" in counts.columns else F.lit(1)
    outside = F.exists("parts", lambda p: (p["a"] < first) | (p["a"] > p["b"]) | (p["b"] > F.col("n")))
    error = F.when(F.col("spec").isNull() | wrong, "no page selection").when(outside, "outside of the document")
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")

    def add(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        meets = (F.size(kept) > 0) & (p["a"] <= last["b"] + 1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], p["b"]).alias("b"))
        return F.when(meets, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(p)))

    own = own.withColumn("error", error).withColumn("ranges", F.when(F.col("error").isNull(), F.aggregate(F.array_sort("parts"), none, add)))
    text = lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))
    return own.select("doc", "ranges", F.array_join(F.transform("ranges", text), ",").alias("normal"), "error")


def select_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages (doc, page, text) named by a selection (doc, spec); the others are blank. Raises an error if a selection is wrong."""
    counts = pages.groupBy("doc").agg(F.max("page").alias("n"), F.least(F.lit(1), F.min("page")).alias("first"))
    checked = page_specs(specs, counts)
    checked = checked.withColumn("ranges", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("doc").cast("string"), "error"))).otherwise(F.col("ranges")))
    kept = F.coalesce(F.exists("ranges", lambda r: F.col("page").between(r["a"], r["b"])), F.lit(False))
    return pages.join(checked.select("doc", "ranges"), "doc", "left").select("doc", "page", F.when(kept, F.col("text")).otherwise("").alias("text"))


#: Chunks of a batch that a task hands on.
CHUNKS = 64


def segments(text: str, limit: int) -> Iterator[str]:
    """A page as it is if it fits, else its lines packed in order; a line that is too long is a segment of its own."""
    if len(text) <= limit:
        yield text
        return
    part, size = [], 0
    for line in text.splitlines():
        if part and size + len(line) > limit:
            yield "\n".join(part)
            part, size = [], 0
        part.append(line)
        size += len(line) + 1
    if part:
        yield "\n".join(part)


def chunk_pages(pages: DataFrame, limit: int) -> DataFrame:
    """Pages (doc, page, text) packed in order into chunks of at most ``limit`` characters: doc, chunk, first_page, last_page, n_chars, body.

    Pages of a document are read in order by one task, since each chunk begins where the one before ends; a task holds
    one chunk at a time, so that a document may have any number of pages. Blank and null pages are passed over.
    """
    kinds = dict(pages.dtypes)
    schema = f"doc {kinds['doc']}, chunk int, first_page {kinds['page']}, last_page {kinds['page']}, n_chars long, body string"

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc", "chunk", "first_page", "last_page", "n_chars", "body"]
        done, doc, chunk, held, size, kind = [], None, 0, [], 0, None

        def close() -> None:
            body = "\n\n".join(f"=== PAGE {p} ===\n{t}" for p, t in held)
            done.append((doc, chunk, held[0][0], held[-1][0], size, body))

        def batch() -> pa.RecordBatch:
            types = [kind.field("doc").type, pa.int32(), kind.field("page").type, kind.field("page").type, pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

        for b in batches:
            kind = b.schema
            for d, page, text in zip(*(b.column(c).to_pylist() for c in ("doc", "page", "text"))):
                if held and d != doc:
                    close()
                    held, size = [], 0
                if d != doc:
                    doc, chunk = d, 0
                for segment in segments(text, limit):
                    if held and size + len(segment) > limit:
                        close()
                        held, size, chunk = [], 0, chunk + 1
                    held.append((page, segment))
                    size += len(segment)
                if len(done) >= CHUNKS:
                    yield batch()
                    done.clear()
        if held:
            close()
        if done:
            yield batch()

    own = pages.where("text <> ''").select("doc", "page", "text").repartition("doc").sortWithinPartitions("doc", "page")
    return own.mapInArrow(pack, schema)


def split_columns(words: DataFrame) -> DataFrame:
    """Words (row, word, x0, x1) of one line split where the gap between neighbours is widest, the earliest of equals."""
    order = Window.partitionBy("row").orderBy("x0")
    gaps = words.withColumns({"gap": F.col("x0") - F.lag("x1").over(order), "pos": F.row_number().over(order)})
    cut = gaps.where(F.col("gap").isNotNull()).groupBy("row").agg(F.max_by("pos", F.struct("gap", -F.col("pos"))).alias("cut"))
    side = lambda test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("pos", "word")))), lambda x: x["word"]), " ")
    return gaps.join(cut, "row").groupBy("row").agg(side(F.col("pos") < F.col("cut")).alias("left_text"), side(F.col("pos") >= F.col("cut")).alias("right_text"))
