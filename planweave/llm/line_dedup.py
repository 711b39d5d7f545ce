"""Line dedup by winnowing over line hashes.

1. A window is a shortest run of whole lines with at least ``min_words`` words, starting or ending at any line. The
   line with the least hash of each window is selected (the last one of ties; lines of few words come last): any two
   equal runs of that many words have such a line in common. Selected lines, each once, are posted as fingerprints
   with their positions.
2. Positions are joined on the fingerprint; those whose fingerprint stands nowhere else are done.
3. From each joined position the match is extended both ways, to every window that selected it, by the hashes of the
   lines before and after: the first place of each such extension, in the order of document and line, is kept, and the
   lines of later ones are deleted. As windows start and end at every line, a whole equal run is covered. A run in the
   same document counts as later only from the end of the first on.

So a line is deleted if and only if it lies in a window that also stands at an earlier place. Lines are
compared without white space at their ends; lines without words belong to the run around them. A line that a third
of all documents hold is one group of a partial aggregate, never a list or a set of pairs.

Defined results: a null text stays null and an empty one empty, with no lines deleted; null document ids come
first in the order, equal ones follow the order of rows, so of repeated rows the first keeps its lines; only
the columns named in ``keep`` are carried, but for names of the columns that are added; an empty table gives no
rows; a text of any length is one task's row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, number_rows

#: Passages of over 50 words go.
MIN_WORDS = 51
#: Lines of fewer words are fingerprints only where a window has no other.
SHORT = 5
#: Columns that the operator adds or uses.
OWN = ["text", "n_lines", "n_deleted_lines", "n_deleted_words", "row_", "id_", "text_", "spans_"]


def hashed_lines(text: str | None, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """Number, words and hash of each line with words; nothing of a text that holds no window."""
    import xxhash

    at, words, hashes = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        if n := len(line.split()):
            at.append(i)
            words.append(n)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - 2**63)
    return (at, words, hashes) if sum(words) >= min_words else ([], [], [])


def windows(words: list[int], hashes: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(first, past the last, selected) of each window, as places in the list of lines with words."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)  # one past the last line of the window that starts here
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    found = {(s, e) for s, e in enumerate(ends.tolist()) if e < len(total)} | {(s, e) for e, s in enumerate(starts.tolist(), 1) if s >= 0}
    ranks = [(n < SHORT, h, -i) for i, (n, h) in enumerate(zip(words, hashes, strict=True))]
    return [(s, e, -min(ranks[s:e])[2]) for s, e in found]


def hash_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows with a window (row_, id_, at, words, hashes): all that is compared later."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(r, d, *own) for r, d, t in zip(batch.column("row_").to_pylist(), batch.column("id_").to_pylist(), batch.column("text_"), strict=True) if (own := hashed_lines(t.as_py(), min_words))[0]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["row_", "id_", "at", "words", "hashes"])

    rows = docs.select("row_", F.col("id_").cast("long").alias("id_"), "text_")
    return rows.mapInArrow(run, "row_ long, id_ long, at array<int>, words array<int>, hashes array<long>")


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The selected lines, each once: row_, position (in the list of lines with words), fingerprint."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, places, prints = [], [], []
            for row, words, hashes in zip(batch.column("row_").to_pylist(), batch.column("words"), batch.column("hashes"), strict=True):
                h = hashes.as_py()
                for i in sorted({p for _, _, p in windows(words.as_py(), h, min_words)}):
                    rows.append(row)
                    places.append(i)
                    prints.append(h[i])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(prints, pa.int64())], ["row_", "position", "fingerprint"])

    return lines.select("row_", "words", "hashes").mapInArrow(run, "row_ long, position int, fingerprint long")


def joined_positions(posted: DataFrame) -> DataFrame:
    """The positions whose fingerprint stands at another place too, by row: row_, positions."""
    again = posted.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    return posted.join(again, "fingerprint").groupBy("row_").agg(F.collect_list("position").alias("positions"))


def extensions(lines: DataFrame, positions: DataFrame, min_words: int) -> DataFrame:
    """The windows around the joined positions: row_, id_, first_line, last_line, fingerprint, and the hash of its lines."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        names = ["row_", "id_", "first_line", "last_line", "fingerprint", "window"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                raw, there, at = np.array(r["hashes"], "<i8").tobytes(), set(r["positions"]), r["at"]
                for s, e, p in windows(r["words"], r["hashes"], min_words):
                    if p in there:
                        found = (r["row_"], r["id_"], at[s], at[e - 1], r["hashes"][p], xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e], seed=10) - 2**63)
                        for column, v in zip(rows, found, strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    return lines.join(positions, "row_").mapInArrow(run, "row_ long, id_ long, first_line int, last_line int, fingerprint long, window long")


def repeats(extended: DataFrame) -> DataFrame:
    """Windows that stand at an earlier place as well: row_, first_line, last_line."""
    place = F.struct("id_", "row_", "first_line", "last_line")
    first = extended.groupBy("fingerprint", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    after = (F.col("row_") != F.col("first.row_")) | (F.col("first_line") > F.col("first.last_line"))
    return extended.join(first, ["fingerprint", "window"]).where(after).select("row_", "first_line", "last_line")


def drop_lines(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the text after deletion, n_lines, n_deleted_lines and n_deleted_words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, n_lines, n_deleted, n_words = [], [], [], []
            for text, spans in zip(batch.column("text_").to_pylist(), batch.column("spans_").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines) if text else 0)
                if not spans:
                    texts.append(text)
                    n_deleted.append(0)
                    n_words.append(0)
                    continue
                kept, done, gone = [], 0, 0
                for s in sorted(spans, key=lambda s: s["first_line"]):
                    if s["first_line"] > done:
                        kept += lines[done : s["first_line"]]
                    if s["last_line"] >= done:
                        cut = lines[max(done, s["first_line"]) : s["last_line"] + 1]
                        gone += sum(len(x.split()) for x in cut)
                        done = s["last_line"] + 1
                kept += lines[done:]
                texts.append("\n".join(kept))
                n_deleted.append(len(lines) - len(kept))
                n_words.append(gone)
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_deleted_lines": pa.array(n_deleted, pa.int64()), "n_deleted_words": pa.array(n_words, pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], [*keep, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in keep]).schema)
    return rows.mapInArrow(run, f"{schema + ', ' if keep else ''}text string, n_lines long, n_deleted_lines long, n_deleted_words long")


def line_dedup(docs: DataFrame, keep: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document: ``keep`` (doc_id if not given), its text without later runs, and what was deleted."""
    keep = carried(keep or ["doc_id"], OWN)
    numbered = number_rows(docs, [*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("id_"), F.col("text").alias("text_")])
    lines = materialize(hash_lines(numbered, min_words), "lines")
    extended = materialize(extensions(lines, joined_positions(fingerprints(lines, min_words)), min_words), "extensions")
    spans = repeats(extended).groupBy("row_").agg(F.collect_set(F.struct("first_line", "last_line")).alias("spans_"))
    return drop_lines(numbered.join(spans, "row_", "left"), keep)
