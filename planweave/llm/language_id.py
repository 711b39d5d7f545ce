"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label; emissions come from affixes, character n-grams, the word itself and
lexicons of frequent words, the label of a text's beginning and transitions between the labels of neighbours are
learned, and forward-backward gives each word's posterior, so that switches inside a text are seen. A document's
language is that of the largest mean posterior over all its words that hold a letter. A word of over ``PIECE``
characters is a run of pieces of at most that length, each a link of the chain, so that all of it is seen.

The field is fitted on at most ``SAMPLE`` labelled rows of each language, first in the order of a hash of the text; a
text of over ``SAMPLE_CHARS`` characters gives that many, in passages of ``PASSAGE`` spread evenly over all of it.
Chains of several rows in a row teach the transitions.

Defined results: a null text and one without a letter get ``und`` and score 1; labels are the distinct
non-null ones of the training rows, and without any all texts get ``und``, score 0; repeated rows are treated
one by one; a chain is a whole text, of whatever length, and lies in one task's memory; only the columns named in
``keep`` are carried, but for names of the columns that are added; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize

SAMPLE = 300
SAMPLE_CHARS, PASSAGE = 20_000, 1_000
LEXICON = 300
HASH_BITS = 17
#: Characters of a link of the chain, and of these with the marks of beginning and end.
PIECE, WIDTH = 22, 24
EPOCHS = 3
#: Cells (chains times words) that are worked on at a time.
CELLS = 400_000
REMEMBERED = 200_000
LETTER = re.compile(r"[^\W\d_]")


def features(cores: list[str], lexicons: list[frozenset]):
    """Hashed features of words, a row each, 0 for none: n-grams of two and three characters between the marks of
    beginning and end (those at a mark are affixes), affixes of three, the word itself and the lexicons that hold it."""
    import numpy as np

    x = np.array([f"<{c}>" for c in cores], f"U{WIDTH}").view("u4").reshape(len(cores), WIDTH).astype("u8")
    n = (x > 0).sum(axis=1)
    width = int(n.max(initial=2))
    rows = np.arange(len(x))
    columns = []

    def add(h, kind: int, there) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        columns.append(np.where(there, (h * np.uint64(0xD1B54A32D192ED03) >> np.uint64(64 - HASH_BITS)).astype("i4") | 1, 0))

    two = x[:, : width - 1] << np.uint64(21) | x[:, 1:width]
    three = two[:, :-1] << np.uint64(21) | x[:, 2:width]
    for i in range(width - 1):
        add(two[:, i], 2, n > i + 1)
    for i in range(width - 2):
        add(three[:, i], 3, n > i + 2)
    four = lambda i: (three[rows, i] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ x[rows, np.minimum(i + 3, WIDTH - 1)]
    if width > 4:
        add(four(np.zeros(len(x), "i8")), 4, n > 4)
        add(four(np.maximum(n - 4, 0)), 5, n > 4)
    odd = np.random.default_rng(1).integers(0, 2**62, WIDTH, dtype="u8") * np.uint64(2) + np.uint64(1)
    add((x * odd).sum(axis=1, dtype="u8"), 6, n > 2)
    for k, own in enumerate(lexicons):
        columns.append(np.fromiter((2 * k + 2 if c in own else 0 for c in cores), "i4", len(cores)))
    return np.stack(columns, axis=1)


def core_of(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}«»¿¡…#*$%&|").lower()


def links_of(text: str) -> tuple[list[str], list[int] | None]:
    """The words of a text, long ones in pieces, and the number of each link's word (None: each link is a word)."""
    words = text.split()
    if not any(len(w) > PIECE and len(core_of(w)) > PIECE for w in words):
        return words, None
    links, owner = [], []
    for i, w in enumerate(words):
        core = w if len(w) <= PIECE else core_of(w)
        parts = [w] if len(core) <= PIECE else [core[k : k + PIECE] for k in range(0, len(core), PIECE)]
        links += parts
        owner += [i] * len(parts)
    return links, owner


@dataclass
class Field:
    labels: list
    lexicons: list
    weights: object = None  # features x labels
    transitions: object = None
    start: object = None


class Emitter:
    """Emissions of words, remembered: row numbers into a growing table."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.at: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.field.labels)), "f4")
        self.letters = np.zeros(1024, bool)

    def codes(self, words: list[str]):
        import numpy as np

        if len(self.at) > REMEMBERED:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.at]:
            first, n = len(self.at), len(self.at) + len(new)
            while n > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            cores = [core_of(w) for w in new]
            has = np.array([bool(LETTER.search(c)) for c in cores])
            self.scores[first:n] = np.where(has[:, None], summed(self.field.weights, features(cores, self.field.lexicons)), 0)
            self.letters[first:n] = has
            self.at.update(zip(new, range(first, n), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), "i4", len(words))


def summed(weights, rows):
    """Sum of the weights of each row of features."""
    import numpy as np

    out = np.zeros((len(rows), weights.shape[1]), "f4")
    for column in rows.T:
        out += weights[column]
    return out


def posteriors(emissions: list, field: Field, moves=None) -> list:
    """Forward-backward over all chains at once, the longest first; a posterior of labels for each link.

    ``moves``, if given, is a matrix that the posteriors of neighbouring labels are added to.
    """
    import numpy as np

    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order])
    steps, n_labels = int(lengths[0]), len(field.labels)
    e = np.zeros((steps, len(order), n_labels), "f4")
    for r, i in enumerate(order):
        x = emissions[i]
        e[: len(x), r] = np.exp(np.clip(x - x.max(axis=1, keepdims=True), -30, 0))
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    a = np.exp(field.transitions - field.transitions.max()).astype("f4")
    forward = np.zeros_like(e)
    ones = np.ones((n_labels, 1), "f4")
    now = e[0] * np.exp(field.start - field.start.max()).astype("f4")
    forward[0] = now = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        now = (now[:n] @ a) * e[t, :n]
        now /= now @ ones
        forward[t, :n] = now
    back = np.ones((len(order), n_labels), "f4")
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        right = back[:n] * e[t + 1, :n]
        if moves is not None:
            pair = forward[t, :n, :, None] * a * right[:, None, :]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = right @ a.T
        back[:n] = x / (x @ ones)
        forward[t, :n] *= back[:n]
    forward /= np.maximum(forward.sum(axis=2, keepdims=True), 1e-30)
    out: list = [None] * len(order)
    for r, i in enumerate(order):
        out[i] = forward[: lengths[r], r]
    return out


def batches_of(lengths: list[int]) -> Iterator[list[int]]:
    """Chains of like length together, at most ``CELLS`` cells at a time."""
    own: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if own and (len(own) + 1) * lengths[own[0]] > CELLS:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def train(texts: list[list[str]], gold: list[int], labels: list, seed: int = 6) -> Field:
    """Stochastic gradient (Adagrad) on the likelihood of the labels of links."""
    import numpy as np

    rng = np.random.default_rng(seed)
    cores = [[c for w in words if LETTER.search(c := core_of(w)[:PIECE])] for words in texts]
    counts = [Counter(c for own, y in zip(cores, gold, strict=True) if y == k for c in own) for k in range(len(labels))]
    field = Field(labels, [frozenset(w for w, _ in c.most_common(LEXICON)) for c in counts])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for own in cores for w in own))}
    lists = features(list(vocabulary), field.lexicons)
    owner, at = np.nonzero(lists)
    flat = lists[owner, at]
    k = len(labels)
    field.weights = np.zeros((1 << HASH_BITS, k), "f4")
    field.transitions, field.start = np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(field.weights, 1e-2), np.full((k, k), 1.0), np.full(k, 1.0)]
    chains = [np.array([vocabulary[w] for w in own], "i4") for own in cores]
    there = [i for i, c in enumerate(chains) if len(c)]
    for _ in range(EPOCHS):
        order = rng.permutation(there).tolist()
        joined = []  # chains of one to three rows: switches to learn from
        while order:
            own = [order.pop() for _ in range(min(len(order), int(rng.choice([1, 2, 3], p=[0.6, 0.25, 0.15]))))]
            joined.append((np.concatenate([chains[i] for i in own]), np.concatenate([np.full(len(chains[i]), gold[i]) for i in own])))
        for at in range(0, len(joined), 40):
            part = joined[at : at + 40]
            used = np.unique(np.concatenate([c for c, _ in part]))
            mask = np.zeros(len(lists), bool)
            mask[used] = True
            mine = mask[owner]
            scores = np.zeros((len(lists), k), "f4")
            for j in range(k):
                scores[:, j] = np.bincount(owner[mine], field.weights[flat[mine], j], len(lists))
            gradient, moves, begin = np.zeros((len(lists), k)), np.zeros((k, k)), np.zeros(k)
            for group in batches_of([len(c) for c, _ in part]):
                expected = np.zeros((k, k))
                for i, p in zip(group, posteriors([scores[part[i][0]] for i in group], field, expected), strict=True):
                    words, y = part[i]
                    d = -p.astype("f8")
                    d[np.arange(len(y)), y] += 1
                    begin += d[0]
                    for j in range(k):
                        gradient[:, j] += np.bincount(words, d[:, j], len(lists))
                    np.add.at(moves, (y[:-1], y[1:]), 1)
                moves -= expected
            total = sum(len(c) for c, _ in part)
            for j in range(k):
                g = np.bincount(flat[mine], gradient[owner[mine], j], 1 << HASH_BITS) / total * 50
                squares[0][:, j] += g**2
                field.weights[:, j] += (0.3 * g / np.sqrt(squares[0][:, j])).astype("f4")
            g = moves / total * 50
            squares[1] += g**2
            field.transitions = np.clip(field.transitions + 0.3 * g / np.sqrt(squares[1]), -6, 6)
            g = begin / len(part)
            squares[2] += g**2
            field.start = np.clip(field.start + 0.3 * g / np.sqrt(squares[2]), -6, 6)
    return field


def label_words(texts: list[str | None], emitter: Emitter) -> list:
    """For each text its links' posteriors, which links hold a letter, and the links' words; None without any letter."""
    out: list = [None] * len(texts)
    split = [links_of(text) if text and LETTER.search(text) else ([], None) for text in texts]
    codes, first, chains = emitter.codes([w for links, _ in split for w in links]), 0, []
    for i, (links, _) in enumerate(split):
        if links:
            chains.append((i, codes[first : first + len(links)]))
        first += len(links)
    for group in batches_of([len(c) for _, c in chains]):
        for j, p in zip(group, posteriors([emitter.scores[chains[j][1]] for j in group], emitter.field), strict=True):
            i, part = chains[j]
            out[i] = (p, emitter.letters[part], split[i][1])
    return out


def predict(texts: list[str | None], emitter: Emitter) -> tuple[list, list]:
    labels, scores = [], []
    field = emitter.field
    if not field.labels:
        return ["und"] * len(texts), [0.0] * len(texts)
    for at in range(0, len(texts), 400):
        for found in label_words(texts[at : at + 400], emitter):
            if found is None:
                labels.append("und")
                scores.append(1.0)
                continue
            p, letters, _ = found
            mean = (p[letters] if letters.any() else p).mean(axis=0)
            k = int(mean.argmax())
            labels.append(field.labels[k])
            scores.append(float(min(1.0, max(0.0, mean[k]))))
    return labels, scores


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from ``text`` and non-null ``lang`` of ``docs``."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text", F.lit(6)).alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")  # only the top of each label leaves a task
    chosen = known.select("lang", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("rank")
    rows = known.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    n, passages = F.length("text"), SAMPLE_CHARS // PASSAGE
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(passages - 1)), lambda i: F.substring("text", F.floor(i * (n - PASSAGE) / (passages - 1)).cast("int") + 1, F.lit(PASSAGE))), " ")
    rows = materialize(rows.select("lang", F.when(n <= SAMPLE_CHARS, F.col("text")).otherwise(spread).alias("text"), "h"), "language-sample").orderBy("lang", "h").collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return Field([], [])
    at = {x: i for i, x in enumerate(langs)}
    return train([links_of(r.text)[0] for r in rows], [at[r.lang] for r in rows], langs)


def identify(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id if not given), lang_pred and score for every document."""
    keep = carried(keep or ["doc_id"], ["lang_pred", "score", "text_"])
    sent = docs.sparkSession.sparkContext.broadcast(field)  # of a size fixed by HASH_BITS, labels and LEXICON

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        emitter = Emitter(sent.value)
        for batch in batches:
            labels, scores = predict(batch.column("text_").to_pylist(), emitter)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text_")
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def spans(texts: list[str | None], emitter: Emitter) -> list[list[tuple[str, int, int]]]:
    """Runs of words of one language in each text: (label, first word, last word)."""
    import numpy as np

    out = []
    for found in label_words(texts, emitter):
        best = np.zeros(0, "i8")
        if found:
            p, _, owner = found
            first = np.flatnonzero(np.diff(owner, prepend=-1)) if owner else np.arange(len(p))  # a word's pieces count together
            best = np.add.reduceat(p, first, axis=0).argmax(axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
        out.append([(emitter.field.labels[best[a]], a, b - 1) for a, b in zip(cuts, cuts[1:])])
    return out
