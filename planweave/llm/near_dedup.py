"""Near-duplicate classes by a join over inverted signature coordinates.

1. Each text becomes the set of its five-word shingles (64-bit hashes), a digest of that set and a MinHash
   signature of 64 coordinates. Texts of one set are one node, whatever their number.
2. A node is posted under (coordinate, value) pairs. Only its rarest are posted (26 at a similarity of 0.85, 30 at
   0.8): two signatures that agree in at least ``matches_for`` of 64 coordinates share one of them, since prefixes
   follow one order of all pairs.
   Rarity comes from a sketch of fixed size, so that pairs which many texts share are skipped.
3. In each posting list all nodes are matched with leaders: a node of the list's largest class (at first the node
   whose coordinate values are the most common ones, the text in the middle of its copies) and one of a class drawn
   anew each round, in all lists alike. Collisions are counted over the whole signature, and those with enough agreeing coordinates are
   confirmed on full shingle sets. Links are contracted. Lists of over ``SMALL`` nodes go through such rounds until one
   links few against the first: leaders meet all nodes of their lists, so where they link few, few pairs are left to
   link. A large group of near copies costs its size and not its square.
4. Of the pairs of a list that still lie in different classes, one of each two classes and share is tested, the one
   that agrees most; links are contracted, and what is left is tested in finer shares, until no pair is left.

Before any set is fetched, pairs must pass two native tests: so many agreeing coordinates,
and an odd sketch (the parity of the shingles in each of 512 hash cells), whose unequal cells are never more than
the shingles in which two sets differ.

A pair of just the Jaccard similarity asked for is missed by its signature with a probability of at most ``MISSED``
(6e-7 at 0.85, 1.2e-6 at 0.8), a closer one more rarely still.
All links are confirmed exactly, in integers. Every step is a join, a grouping or a map over bounded rows.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer than
five words is one shingle; equal texts are linked; null document ids never name a class that has others;
``first`` marks one row of each class (so of repeated rows, too), ``kept`` follows document ids; an empty
table gives no rows; other columns are carried only if named in ``keep``; a text of any length is one task's row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT, carried, materialize, number_rows, text_key

SHINGLE = 5
COORDINATES = 64
#: Least similarity of a link in hundredths if none is given, and how often a pair of the least similarity may fail by its signature.
PERCENT, MISSED = 85, 1.5e-6
SKETCH_BITS = 16
#: Cells of the odd sketch, and the numbers that hold them.
CELLS = 512
ODD = [f"o{k}" for k in range(CELLS // 64)]
#: Parts that the copies of a text are dealt to.
SALTS = 8
#: Lists of at most so many nodes have a bounded number of pairs for each posting.
SMALL = 8
#: Rounds of leaders end with one that links less than this part of what the first one did.
FEW = 1 / 16
#: Shingles that are hashed under all coordinates at a time.
SLICE = 4096


def matches_for(percent: int) -> int:
    """The most coordinates that may be asked to agree: 39 of 64 at 85 %, 35 at 80 %."""
    p, missed = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed > MISSED:
            return m
    return COORDINATES


def constants(n: int):
    import numpy as np

    own = np.random.default_rng(9)
    return own.integers(0, 2**63, n, dtype="u8") * 2 + 1, own.integers(0, 2**63, n, dtype="u8")


def shingles(text: bytes | None):
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, "u8")
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes):
    """The least value of each coordinate, 32 bits."""
    import numpy as np

    a, b = constants(COORDINATES)
    least = np.full(COORDINATES, 2**32 - 1, "u8")
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE, None]
        least = np.minimum(least, ((part * a + b) >> np.uint64(32)).min(axis=0))
    return least.astype("<u4")


def odd_sketch(hashes) -> bytes:
    import numpy as np

    return np.packbits(np.bincount((hashes >> np.uint64(55)).astype("i8"), minlength=CELLS).astype("u1") & 1).tobytes()


def sign(docs: DataFrame) -> DataFrame:
    """Per row: row_, doc_id, hashes of the text, n, digest of the set (null without shingles), least values and odd sketch as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, digests, least, odd = [], [], [], []
            for text in batch.column("text_"):
                own = shingles(text.as_py())
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                least.append(signature(own).tobytes() if len(own) else None)
                odd.append(odd_sketch(own) if len(own) else None)
            carried_ = [batch.column(c) for c in ("row_", "doc_id", *TEXT)]
            columns = [*carried_, pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, least, odd))]
            yield pa.RecordBatch.from_arrays(columns, ["row_", "doc_id", *TEXT, "n", "digest", "least", "odd"])

    rows = docs.select("row_", F.col("id_").cast("long").alias("doc_id"), *text_key(), F.col("text_").cast("binary").alias("text_"))
    return rows.mapInArrow(run, "row_ long, doc_id long, t1 long, t2 long, n long, digest binary, least binary, odd binary")


def tokens(batch):
    """(coordinate, value) pairs as one number each, a row per signature."""
    import numpy as np

    least = np.frombuffer(b"".join(batch.column("least").to_pylist()), "<u4").reshape(-1, COORDINATES).astype("u8")
    return least << np.uint64(6) | np.arange(COORDINATES, dtype="u8")


def bucket_of(token):
    import numpy as np

    return (token * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - SKETCH_BITS)


def rarity(nodes: DataFrame):
    """Rank of each sketch bucket by how many pairs fall into it: a table of fixed size."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(2**SKETCH_BITS, "i8")
        for batch in batches:
            total += np.bincount(bucket_of(tokens(batch)).ravel().astype("i8"), minlength=2**SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return ranked(nodes.select("least").mapInArrow(run, "bucket long, n long"))


def post(nodes: DataFrame, ranks, matches: int) -> DataFrame:
    """The prefix postings: key, node, and how common the values of all coordinates of the node are."""
    prefix = COORDINATES - max(1, matches) + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = tokens(batch)
            ranked_ = ranks[bucket_of(own).astype("i8")]
            order = np.sort(ranked_ << np.uint64(38) | own, axis=1)[:, :prefix] & np.uint64(2**38 - 1)
            node = np.repeat(batch.column("node").to_numpy(), prefix)
            common = np.repeat(ranked_.sum(axis=1, dtype="i8"), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype("i8")), pa.array(node), pa.array(common)], ["key", "node", "common"])

    return nodes.select("node", "least").mapInArrow(run, "key long, node long, common long")


def ranked(parts: DataFrame):
    """Rank of each sketch bucket by its count over all parts (bucket, n)."""
    import numpy as np

    counts = np.zeros(2**SKETCH_BITS, "i8")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return np.searchsorted(np.unique(counts), counts).astype("u8")


def planes(nodes: DataFrame) -> DataFrame:
    """Four bits of every coordinate, a number for each bit, so that equal coordinates are equal; and the odd sketch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            least = tokens(batch) >> np.uint64(6)
            bits = [np.packbits((least >> np.uint64(k) & np.uint64(1)).astype("u1"), axis=1).view("<i8").ravel() for k in range(4)]
            odd = np.frombuffer(b"".join(batch.column("odd").to_pylist()), "<i8").reshape(-1, len(ODD)).T
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), *map(pa.array, bits), *(pa.array(np.ascontiguousarray(x)) for x in odd)], ["node", "n", "p0", "p1", "p2", "p3", *ODD])

    return nodes.select("node", "n", "least", "odd").mapInArrow(run, "node long, n long, p0 long, p1 long, p2 long, p3 long, " + ", ".join(f"{c} long" for c in ODD))


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and odd sketches allow the similarity, and enough coordinates agree in four bits.

    Linked sets have 100 i >= percent u, so with d = u - i unequal and n + m = u + i shingles in all,
    (100 + percent) d <= (100 - percent) (n + m).
    """
    of = lambda t, c: F.col(f"{t}.{c}")
    sizes = 100 * F.least(of(a, "n"), of(b, "n")) >= percent * F.greatest(of(a, "n"), of(b, "n"))
    cells = sum((F.bit_count(of(a, c).bitwiseXOR(of(b, c))) for c in ODD[1:]), F.bit_count(of(a, ODD[0]).bitwiseXOR(of(b, ODD[0]))))
    return sizes & (unequal(a, b) <= COORDINATES - matches_for(percent)) & ((100 + percent) * cells <= (100 - percent) * (of(a, "n") + of(b, "n")))


def unequal(a: str, b: str) -> Column:
    x = [F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}")) for k in range(4)]
    return F.bit_count(x[0].bitwiseOR(x[1]).bitwiseOR(x[2]).bitwiseOR(x[3]))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of nodes (node, t1, t2): node, text; of equal texts, which are dealt out by a salt, one is taken."""
    rows = docs.select(*text_key(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"), F.col("text_").cast("binary").alias("text"))
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return materialize(rows.join(nodes, [*TEXT, "salt"]).groupBy("node").agg(F.first("text").alias("text")), "texts")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Adds to pairs of nodes (a, b) whether they are linked on their full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(docs, nodes.select("node", *TEXT).join(wanted, "node"))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            linked, known = [], {}
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a not in known:
                    known = {a: shingles(ta.as_py())}
                x, y = known[a], shingles(tb.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame, rows: int) -> DataFrame:
    """The least node that each node of ``edges`` (a, b) reaches: node, comp. Labels spread and jump until none changes."""
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "links", rows)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp"))
    labels = materialize(labels, "labels", rows)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("new"))
        spread = materialize(spread, "labels", rows)
        jump = spread.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = materialize(spread.join(jump, "new").select("node", F.col("far").alias("new"), "comp"), "labels", rows)
        labels = moved.select("node", F.col("new").alias("comp"))
        if moved.where(F.col("new") != F.col("comp")).isEmpty():
            return labels


def contract(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, comp) after links (a, b) between nodes: those of the classes themselves are joined up."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    roots = components(edges, edges.count()).withColumnRenamed("comp", "root").withColumnRenamed("node", "comp")
    return materialize(comps.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comps")


def meet_leaders(own: DataFrame, round_: int) -> DataFrame:
    """Of lists (key, node, common, comp) the nodes with the leaders of other classes that they meet, once: node, leader.

    Draws don't depend on the list, so that lists of one group agree on their leaders.
    """
    draw = F.col("common") if round_ == 0 else F.xxhash64("node", F.lit(round_))
    classes = own.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(F.struct(draw.alias("draw"), "node")).alias("first"))
    largest, drawn = F.max(F.struct("n", "first.draw", "first.node", "comp")), F.max(F.struct(F.xxhash64("comp", F.lit(round_)).alias("h"), "first.node", "comp"))
    leader = lambda s: F.struct(s["node"].alias("leader"), s["comp"].alias("leader_comp"))
    leaders = classes.groupBy("key").agg(F.array_distinct(F.array(leader(largest), leader(drawn))).alias("leaders"))
    return own.join(leaders.select("key", F.inline("leaders")), "key").where(F.col("comp") != F.col("leader_comp")).select("node", "leader").distinct()


def link_nodes(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Classes of nodes (node, t1, t2, n, least, odd): node, comp."""
    posted = post(nodes, rarity(nodes), matches_for(percent))
    shared = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = materialize(posted.join(shared, "key"), "lists")
    bits = materialize(planes(nodes.join(lists.select("node").distinct(), "node")), "planes")
    comps = bits.select("node", F.col("node").alias("comp"))
    tested = None

    def put(pairs: DataFrame, what: str) -> int:
        """Tests pairs (a, b), contracts those that are linked, and says how many are."""
        nonlocal comps, tested
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        done = materialize(confirm(materialize(pairs, f"pairs-{what}"), nodes, docs, percent), f"tested-{what}")
        new = done.where("linked").select("a", "b")
        tested = done.select("a", "b") if tested is None else tested.union(done.select("a", "b"))
        if links := new.count():
            comps = contract(comps, new)
        return links

    def open_lists(own: DataFrame) -> DataFrame:
        """The lists that still hold several classes."""
        own = own.join(comps, "node")
        several = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        return own.join(several, "key")

    round_, first = 0, 0
    while True:
        own = open_lists(lists if round_ == 0 else lists.where(F.col("size") > SMALL))
        cand = meet_leaders(own, round_)
        x, y = bits.alias("x"), bits.alias("y")
        near = cand.join(x, F.col("x.node") == cand["node"]).join(y, F.col("y.node") == cand["leader"]).where(may_link("x", "y", percent))
        near = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), cand["node"].alias("node"), F.struct(unequal("x", "y"), F.col("leader")).alias("far"))
        best = near.groupBy("node").agg(F.min(F.struct("far", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        links = put(best, str(round_))
        first = first or links
        if links <= FEW * first:
            break
        round_ += 1
    full = open_lists(lists).join(bits, "node")
    a, b = full.alias("a"), full.alias("b")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & may_link("a", "b", percent))
    rest = rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), unequal("a", "b").alias("far")).groupBy("a", "b").agg(F.min("far").alias("far"))
    rest = materialize(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    share = 1
    while True:
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        left = rest.join(of("a"), "a").join(of("b"), "b").where("a_comp <> b_comp").join(tested, ["a", "b"], "left_anti")
        two = [F.least("a_comp", "b_comp").alias("one"), F.greatest("a_comp", "b_comp").alias("other"), F.pmod(F.xxhash64("a", "b"), F.lit(share)).alias("share")]
        best = materialize(left.groupBy(*two).agg(F.min(F.struct("far", "a", "b")).alias("best")).select("best.a", "best.b"), "best")
        if best.isEmpty():
            return comps
        put(best, "rest")
        share *= 64


def near_dedup(docs: DataFrame, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``keep``, doc_id, n_shingles, component_id, kept, first; ``percent``: the least similarity of a link."""
    keep = carried(keep or [], ["doc_id", "n_shingles", "component_id", "kept", "first", "row_", "id_", "text_"])
    columns = [*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("id_"), F.col("text").alias("text_")]
    # rows get their numbers once: here if columns are joined to them later, else as they are signed and stored
    docs = number_rows(docs, columns) if keep else docs.select(*columns, F.monotonically_increasing_id().alias("row_"))
    signed = materialize(sign(docs), "signed")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_"))
    classes = materialize(signed.where("n > 0").groupBy("digest").agg(F.min("row_").alias("node"), lead.alias("lead")), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("row_")), "row_").select(F.col("row_").alias("node"), *TEXT, "n", "least", "odd")
    comps = link_nodes(materialize(nodes, "nodes"), docs, percent)
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    leads = named.groupBy("comp").agg(F.min("lead").alias("lead"))
    named = named.select("digest", "comp").join(leads, "comp").select("digest", F.col("lead.doc_id").alias("component_id"), F.col("lead.row_").alias("first_row"))
    rows = signed.select("row_", "doc_id", "n", "digest").join(named, "digest", "left")
    own = F.col("digest").isNull()
    found = rows.select(
        "row_", "doc_id", F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (own | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
        (own | (F.col("row_") == F.col("first_row"))).alias("first"),
    )
    return (docs.select("row_", *[f"`{c}`" for c in keep]).join(found, "row_") if keep else found).drop("row_")
