"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon holds the words and word beginnings that mark toxic texts. Features are densities of lexicon hits, hits near
second-person words, capitals, punctuation and obfuscated spellings. All is cross-fitted, whatever the number of rows:
the features that trees learn from come from a lexicon of the other half of the sample, so that chance words do not
mislead them, and the calibration from margins of trees that were fitted on the other thirds. The final lexicon and
trees are then fitted on all of the sample, which holds at most ``SAMPLE`` rows of each label, first in the order of a
hash of the id; all else covers all rows, and texts are whole everywhere.

Defined results: a null text scores as an empty one; a label that is null or has no document is left out, of
contradicting labels of one document the toxic one counts; repeated rows are scored one by one; with no labelled rows
every score is 0, with labels of one kind only every score is that label; columns are carried only if named in
``keep``, but for one named ``score`` or ``text_``; an empty table gives no rows; a text of any length is one task's row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize

SAMPLE = 6_000
#: Lengths of the beginnings of words that the lexicon may hold.
STEMS = (3, 4, 5, 6)
LEXICON = 2_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Words between a hit and a second-person word that count as near.
NEAR = 5
REMEMBERED = 100_000
#: Words and beginnings that a task counts before it hands its counts on.
COUNTED = 100_000
#: Parts of the sample that the calibration is fitted across.
FOLDS = 3

#: Second-person words of four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros contigo".split())
#: Signs written for letters, and the letters.
SIGNS = str.maketrans("013457@$!|", "oieastasii")
UPPER = bytes(range(65, 91))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGES = PUNCTUATION.decode() + "¡¿«»“”‘’„…"

FEATURES = (
    "log_words", "hit_share", "log_hits", "hidden_share", "log_hidden", "near_share", "log_near", "second_share",
    "capital_word_share", "capital_share", "punctuation_share", "exclamation_share", "mixed_share",
)

HIT, HIDDEN, PERSON, CAPITALS, MIXED = 1, 2, 4, 8, 16


def core_of(word: str) -> str:
    return word.strip(EDGES).lower()


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()

    def holds(self, core: str) -> bool:
        return core in self.words or any(core[:k] in self.stems for k in STEMS if len(core) > k)

    def flags(self, word: str) -> int:
        """What one word counts for."""
        core = core_of(word)
        out = PERSON if core in SECOND else 0
        if self.holds(core):
            out |= HIT
        elif not core.isalpha():
            plain = re.sub(r"[\W\d_]", "", word.strip(EDGES.translate(SIGNS)).lower().translate(SIGNS))
            if plain and plain != core:
                out |= MIXED | HIDDEN * self.holds(plain)
        if len(core) > 2 and word.isupper():
            out |= CAPITALS
        return out


@dataclass
class Boosted:
    """Trees over binned features: a node is (feature, bin, left, right) or a leaf (None, value)."""

    edges: list = field(default_factory=list)
    start: float = 0.0
    trees: list = field(default_factory=list)

    def bins(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margins(self, x):
        import numpy as np

        b, out = self.bins(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = [(tree, np.arange(len(x)))]
            while at:
                node, rows = at.pop()
                if node[0] is None:
                    out[rows] += node[1]
                else:
                    left = b[rows, node[0]] <= node[1]
                    at += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def boost(x, y, w, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Logistic loss, second-order leaves, histograms of at most ``BINS`` bins a feature."""
    import numpy as np

    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Boosted([np.unique(np.quantile(x[:, j], qs)) for j in range(x.shape[1])])
    p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    model.start = float(np.log(p / (1 - p)))
    b, f = model.bins(x), np.full(len(x), model.start)

    def grow(rows, g, h, left_depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for j in range(x.shape[1]) if left_depth and len(rows) > 1 else ():
            gs = np.bincount(b[rows, j], g[rows], len(model.edges[j]) + 1).cumsum()[:-1]
            hs = np.bincount(b[rows, j], h[rows], len(model.edges[j]) + 1).cumsum()[:-1]
            if len(gs):
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            value = float(rate * total_g / (total_h + 1))
            f[rows] += value
            return (None, value)
        left = b[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[left], g, h, left_depth - 1), grow(rows[~left], g, h, left_depth - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        model.trees.append(grow(np.arange(len(x)), w * (y - p), w * p * (1 - p), depth))
    return model


def isotonic(margins, y, w) -> tuple[list, list]:
    """Pool adjacent violators: knots (mean margin, share of label 1) in ascending order."""
    import numpy as np

    blocks: list[list[float]] = []  # weight, weighted margins, weighted labels
    for i in np.argsort(margins, kind="stable"):
        blocks.append([w[i], w[i] * margins[i], w[i] * y[i]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[1] / b[0] for b in blocks], [b[2] / b[0] for b in blocks]


@dataclass
class Model:
    lexicon: Lexicon
    boosted: Boosted | None = None
    knots: tuple = ((), ())
    constant: float = 0.0

    def scores(self, x):
        import numpy as np

        if self.boosted is None:
            return np.full(len(x), self.constant)
        m = self.boosted.margins(x)
        calibrated = np.interp(m, *self.knots)
        # a thousandth of the uncalibrated score keeps the order inside the calibration's level steps
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-m)), 0, 1)


class Featurizer:
    """Features of texts; remembers the flags of words it has seen."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, {}

    def flags(self, words: list[str]) -> bytes:
        try:
            return bytes(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for w in words:
                if w not in self.known:
                    self.known[w] = self.lexicon.flags(w)
            return bytes(map(self.known.__getitem__, words))

    def of(self, text: str | None) -> list[float]:
        import numpy as np

        raw = (text or "").encode("utf-8", "replace")
        flags = np.frombuffer(self.flags((text or "").split()), "u1")
        n, size = max(1, len(flags)), max(1, len(raw))
        hits = np.flatnonzero(flags & (HIT | HIDDEN))
        second = np.flatnonzero(flags & PERSON)
        near = 0
        if len(hits) and len(second):
            k = np.searchsorted(second, hits)
            after, before = second[np.minimum(k, len(second) - 1)] - hits, hits - second[np.maximum(k - 1, 0)]
            near = int(((np.abs(after) <= NEAR) | (np.abs(before) <= NEAR)).sum())
        n_hidden = int(np.count_nonzero(flags & HIDDEN))
        count = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
        return [
            float(np.log1p(len(flags))), len(hits) / n, float(np.log1p(len(hits))), n_hidden / n, float(np.log1p(n_hidden)), near / max(1, len(hits)), float(np.log1p(near)), len(second) / n,
            np.count_nonzero(flags & CAPITALS) / n, count(UPPER) / size, count(PUNCTUATION) / size, count(b"!") / size, np.count_nonzero(flags & MIXED) / n,
        ]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that far more texts of label 1 hold than of label 0; ``sample`` has text and y."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(own: Counter, y: int):
            keys = list(own)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1:] for k in keys], pa.string()), pa.array(own.values(), pa.int64()), pa.array([y] * len(keys), pa.int32())]
            own.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "token", "n", "y"])

        own = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cores = {core_of(w) for w in set((text.as_py() or "").split())} - {""}
                own[y].update({"w" + c for c in cores} | {"s" + c[:k] for c in cores for k in STEMS if len(c) > k})
                if len(own[y]) > COUNTED:
                    yield rows(own[y], y)
        for y in (0, 1):
            yield rows(own[y], y)

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    tokens = sample.mapInArrow(count, "kind string, token string, n long, y int").groupBy("kind", "token").agg(of(1).alias("a"), of(0).alias("b"))
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    share = (F.col("a") / max(1, positive)) / ((F.col("b") + 0.5) / (negative + 1))
    least = max(3, positive // 80)
    rows = tokens.where((F.col("a") >= least) & (share >= 15)).orderBy(F.desc("a"), "kind", "token").limit(LEXICON).collect()
    return Lexicon(frozenset(r.token for r in rows if r.kind == "w"), frozenset(r.token for r in rows if r.kind == "s"))


def featurize(rows: DataFrame, lexicon: Lexicon, keep: list) -> DataFrame:
    """``keep`` and ``features``."""
    kept = rows.select(*keep, F.col("text").alias("text_"))
    names = kept.columns[:-1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Featurizer(lexicon)
        for batch in batches:
            x = [own.of(t.as_py()) for t in batch.column("text_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text_")
    return kept.mapInArrow(run, f"{schema}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    import numpy as np

    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = materialize(known.where(F.col("doc_id").isNotNull()), "labels")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(Lexicon(), constant=float(max(totals, default=0)))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample) for y in (0, 1)]
    chosen = picked[0].union(picked[1])  # at most twice ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "y"])
    rows = materialize(rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "toxic-sample")
    half = lambda k: rows.where(F.col("half") == k)
    parts = [featurize(half(k), learn_lexicon(half(1 - k).select("text", "y")), ["y", F.xxhash64("text").alias("h")]) for k in (0, 1)]
    data = parts[0].union(parts[1]).toPandas().sort_values(["h", "y"], kind="stable")
    lexicon = learn_lexicon(rows.select("text", "y"))
    if data["y"].nunique() < 2:
        return Model(lexicon, constant=float(data["y"].max() if len(data) else 0))
    x, y = np.array(data["features"].tolist()), data["y"].to_numpy(float)
    n1, n0 = y.sum(), (1 - y).sum()
    w = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    w *= len(w) / w.sum()
    fold, margins = np.random.default_rng(8).permutation(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        a, b = fold != k, fold == k
        margins[b] = boost(x[a], y[a], w[a]).margins(x[b])
    return Model(lexicon, boost(x, y, w), isotonic(margins, y, w))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id if not given) and ``score`` for every document."""
    keep = carried(keep or ["doc_id"], ["score", "text_"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = Featurizer(model.lexicon)
        for batch in batches:
            x = np.array([own.of(t.as_py()) for t in batch.column("text_")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(x), pa.float64())], [*keep, "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text_")
    return kept.mapInArrow(run, f"{schema}, score double")
