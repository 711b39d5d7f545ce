"""Benchmark decontamination over a distributed positional inverted index.

Three passes, none of which shuffles a text. The first counts how often each benchmark word occurs in the corpus. The
second stores the index, dealt by document: for each document that holds the rarest word of
any window, the postings (word, positions) of the words of these windows. The third intersects, for each
window, the position lists moved by the word's offset, from the rarest word on, and keeps exact phrases and,
if ``slop`` is given, proximity matches: the rarest word in its place, every other one at most ``slop`` words from its.
What is found is joined to the documents by hashes of the whole text. The benchmark is the query set: it goes to the tasks in blocks of at most
``BLOCK_BYTES`` of text, so what is broadcast is bounded whatever its size.

Words are runs of ASCII digits and letters (in lower case) and of any characters beyond ASCII.

Defined results: a null or empty document has no words and no hits; an item without words matches nothing;
items with equal ids count once; a null item id is an empty string; repeated documents each get their row;
an empty benchmark hits nothing; other columns are carried only if named in ``keep``, but for names of the columns
that are added; an empty table gives no rows; a text of any length is one task's row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, carried, materialize, text_key, worker_state

WINDOW = 13
BLOCK_BYTES = 4_000_000
#: Bytes of a text that are split into words at a time.
SEGMENT = 4_000_000
#: Hit spans that are held before they are merged.
SPANS = 10_000
#: Columns that the operator adds or uses.
OWN = ["n_words", "n_hit", "spans", "items", "near_items", "contaminated", "text_", *TEXT]

#: One byte for each byte: ASCII letters in lower case, digits and bytes beyond ASCII as they are, the rest a space.
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_in(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, a bounded part at a time."""
    clean, at = (text or b"").translate(BYTES), 0
    while at < len(clean):
        to = clean.find(b" ", at + SEGMENT)
        to = to if to >= 0 else len(clean)
        yield clean[at:to].split()
        at = to


class Query:
    """Benchmark items with the corpus counts of their words: which windows, each once, hang on which rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int) -> None:
        self.items, self.counts = items, counts
        self.anchors: dict[bytes, dict[tuple[int, int], list[int]]] = {}
        self.sizes = [min(window, len(words)) for _, words in items]
        for k, (_, words) in enumerate(items):
            rare, seen = [(counts.get(w, 0), w) for w in words], set()
            for s in range(len(words) - self.sizes[k] + 1 if words else 0):
                if (own := tuple(words[s : s + self.sizes[k]])) in seen:
                    continue
                seen.add(own)
                at = min(range(s, s + self.sizes[k]), key=rare.__getitem__)
                self.anchors.setdefault(words[at], {}).setdefault((k, at), []).append(s)

    def needed(self, anchors: set[bytes]) -> set[bytes]:
        """All words of the windows that hang on these."""
        return {w for a in anchors for (k, _), starts in self.anchors[a].items() for s in starts for w in self.items[k][1][s : s + self.sizes[k]]}

    def matches(self, postings: dict[bytes, list[int]], slop: int = 0) -> Iterator[tuple[int, int, int, bool]]:
        """Item, first and last place of each match, and whether it is exact."""
        there = {w: set(p) for w, p in postings.items()}
        none: set[int] = set()
        for a in self.anchors.keys() & postings.keys():
            for (k, at), starts in self.anchors[a].items():
                words, size = self.items[k][1], self.sizes[k]
                moved = [p - at for p in postings[a]]
                for s in starts:
                    live = moved
                    for j in sorted(range(s, s + size), key=lambda j: self.counts.get(words[j], 0)):
                        own = there.get(words[j], none)
                        live = [d for d in live if d + j in own]
                        if not live:
                            break
                    yield from ((k, d + s, d + s + size - 1, True) for d in live)
                    if slop:
                        exact = set(live)
                        for d in moved:
                            if d not in exact and all(any(d + j + x in there.get(words[j], none) for x in range(-slop, slop + 1)) for j in range(s, s + size)):
                                yield k, max(0, d + s - slop), d + s + size - 1 + slop, False


def query_of(name: str, sent) -> Query:
    """The worker's own copy of the query set, built once."""
    return worker_state(("decontamination", name), lambda: Query(*sent.value))


def read_items(bench: DataFrame) -> list[tuple[str, list[bytes]]]:
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text")).collect()
    return [(r.id, [w for part in words_in(r.text and bytes(r.text)) for w in part]) for r in rows]


def corpus_counts(docs: DataFrame, items: list[tuple[str, list[bytes]]]) -> dict[bytes, int]:
    """Occurrences in all documents of each word of the items."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(w for _, words in items for w in words))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, known = Counter(), sent.value
        for batch in batches:
            for text in batch.column(0):
                for words in words_in(text.as_py()):
                    own.update(filter(known.__contains__, words))
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["word", "n"])

    parts = docs.select(F.col("text_").cast("binary").alias("text_")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def build_index(docs: DataFrame, name: str, sent) -> DataFrame:
    """Per document: hashes of its text, n_words, and the postings of the windows whose rarest word it holds, if any."""

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        query = query_of(name, sent)
        anchors = frozenset(query.anchors)
        kind = pa.list_(pa.struct([("word", pa.binary()), ("at", pa.list_(pa.int32()))]))
        for batch in batches:
            n_words, postings = [], []
            for text in batch.column("text_"):
                parts = list(words_in(text.as_py()))
                n_words.append(sum(map(len, parts)))
                found = set().union(*map(anchors.intersection, parts))
                if not found:
                    postings.append(None)
                    continue
                own: dict[bytes, list[int]] = {w: [] for w in query.needed(found)}
                at = 0
                for words in parts:
                    for k, w in enumerate(words, at):
                        if w in own:
                            own[w].append(k)
                    at += len(words)
                postings.append([{"word": w, "at": p} for w, p in own.items() if p])
            keys = [batch.column(c) for c in TEXT]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n_words, pa.int64()), pa.array(postings, kind)], [*TEXT, "n_words", "postings"])

    rows = docs.select(*text_key(), F.col("text_").cast("binary").alias("text_"))
    return rows.mapInArrow(post, "t1 long, t2 long, n_words long, postings array<struct<word: binary, at: array<int>>>")


def search_index(index: DataFrame, name: str, sent, slop: int = 0) -> DataFrame:
    """Per text with a hit: its hashes, hit spans (first, last), items hit, and items only near by."""

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        query = query_of(name, sent)
        span = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            spans, items, near = [], [], []
            for postings in batch.column("postings"):
                own = {x["word"]: x["at"] for x in postings.as_py() or ()}
                hits, exact, close, room = [], set(), set(), SPANS
                for k, a, b, is_exact in query.matches(own, slop) if own else ():
                    if is_exact:
                        hits.append((a, b))
                        exact.add(query.items[k][0])
                        if len(hits) >= room:
                            hits = merged(hits)
                            room = SPANS + 2 * len(hits)
                    else:
                        close.add(query.items[k][0])
                spans.append([list(x) for x in merged(hits)])
                items.append(sorted(exact))
                near.append(sorted(close - exact))
            columns = [*(batch.column(c) for c in (*TEXT, "n_words")), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*TEXT, "n_words", "spans", "items", "near_items"])

    found = index.where("postings IS NOT NULL").mapInArrow(search, "t1 long, t2 long, n_words long, spans array<array<int>>, items array<string>, near_items array<string>")
    own = [F.first(c).alias(c) for c in ("n_words", "spans", "items", "near_items")]  # copies of a text have the same hits
    return found.where("size(items) + size(near_items) > 0").groupBy(*TEXT).agg(*own)


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_texts(docs: DataFrame, bench: DataFrame, window: int, slop: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (text_): the number of words of each text, and what is found in those with a hit, by hashes of the text; both stored."""
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    counts, hits = None, None
    for b in range(blocks):
        items, name = read_items(bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)), uuid.uuid4().hex
        sent = docs.sparkSession.sparkContext.broadcast((items, corpus_counts(docs, items), window))
        index = materialize(build_index(docs, name, sent), "index")
        counts = index.groupBy(*TEXT).agg(F.first("n_words").alias("n_words")) if counts is None else counts
        found = search_index(index, name, sent, slop)
        hits = found if hits is None else hits.union(found)
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    hits = hits.groupBy(*TEXT).agg(F.first("n_words").alias("n_words"), *[joined(c) for c in ("spans", "items", "near_items")])
    hits = hits.withColumn("spans", merge_spans("spans")).withColumn("items", F.array_sort(F.array_distinct("items")))
    hits = hits.withColumn("near_items", F.array_sort(F.array_distinct(F.array_except("near_items", "items"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0] + 1)
    hits = hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return counts, materialize(hits, "hits")  # stored, so that the planner knows how few there are


def find_contamination(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, spans, items, near_items and contaminated."""
    keep = carried(keep or ["doc_id"], OWN)
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_"))
    counts, hits = search_texts(docs, bench, window, slop, block_bytes)
    rows = docs.select(*[f"`{c}`" for c in keep], *text_key()).join(counts, list(TEXT)).join(hits.drop("n_words"), list(TEXT), "left").drop(*TEXT)
    none = {c: F.array().cast(hits.schema[c].dataType) for c in ("spans", "items", "near_items")} | {"n_hit": F.lit(0).cast("long"), "contaminated": F.lit(False)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they are, whose text is not contaminated; texts are not moved unless many are."""
    _, hits = search_texts(docs.select(F.col("text").alias("text_")), bench, window, 0, block_bytes)
    gone = hits.where("contaminated").select(*[F.col(c).alias(f"{c}_") for c in TEXT])
    one, two = text_key("text")
    return docs.join(gone, (one == F.col("t1_")) & (two == F.col("t2_")), "left_anti")


def merge_spans(column: str):
    """Sorted spans cut so that none overlaps one before it; empty ones go."""
    spans = F.sort_array(column)
    ends = lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(s, 1, i), lambda x: x[1])), F.lit(-1))
    cut = F.transform(spans, lambda s, i: F.array(F.greatest(s[0], ends(spans, i) + 1), s[1]))
    return F.filter(cut, lambda s: s[0] <= s[1])
