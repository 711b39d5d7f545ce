"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they lie, cut only if longer than a sequence, and their pieces packed in
buckets of bounded size, dealt by row number so that no key can fill one. In a bucket each bin is filled
greedily with the longest piece that fits; then its smallest piece gives way to two unpacked pieces that
fit the expanded gap more tightly. Bins that stay too empty are opened again in the next round over fewer
buckets, as long as a round leaves at most half of its pieces; then the rest is packed as it lies. A bucket
never grows, and its last bin is the only one that a larger bucket could have filled.

Defined results: a null text is empty and becomes the end id alone; repeated rows (also with equal or
null document ids) are packed one by one; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_state

SEQUENCE = 2048
#: Pieces a bucket holds on average; bounds a task's memory and keeps the search long enough to fit well.
BUCKET = 40_000
#: A bin under this share is opened again in the next round.
FULL = 0.99
#: Words of letters whose ids a worker remembers, in each of two generations.
REMEMBERED = 120_000
#: Punctuation that the tokenizer always splits from a word of letters.
TAIL = ".,;:!?"
#: Words of letters that the tokenizer keeps whole and lower-cases letter by letter: ASCII, Latin-1 and Latin Extended-A but for the dotted capital I.
LATIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*$"
#: Bytes of text that are split into words at a time.
SEGMENT = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def gather(starts, sizes, flat):
    """The runs of ``flat`` that begin at ``starts``, one after another."""
    import numpy as np

    total = int(sizes.sum())
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    return flat[at]


class WordIds:
    """Token ids of texts, worked out once per distinct word of a block.

    The tokenizer always cuts at white space, so a text's ids are those of its words put together. Words of Latin
    letters, perhaps with punctuation after them, are looked up by their lower case, which a worker remembers in two
    generations: a full one becomes the old one, and what is found in the old one lives on. The rest go through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.plain.get_vocab_size(), bool)
        for token, i in self.plain.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cores: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def encode_cores(self, cores: list[str]) -> list[bytes]:
        """Words of lower-case Latin letters; each ends with its first token that is a word's last."""
        import numpy as np

        parts = [" ".join(cores[k : k + 2000]) for k in range(0, len(cores), 2000)]
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in self.plain.encode_batch_fast(parts, add_special_tokens=False)])
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(cores):
            raise ValueError("a word's ids don't end where the word does")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def ids_of(self, cores: list[str]) -> list[bytes]:
        """Of distinct words of lower-case Latin letters, perhaps an empty one."""
        known, old = self.cores, self.old
        found = [known.get(c) or old.get(c) if c else b"" for c in cores]
        if new := [i for i, x in enumerate(found) if x is None]:
            for i, x in zip(new, self.encode_cores([cores[i] for i in new]), strict=True):
                found[i] = x
        known.update(zip(cores, found, strict=True))
        if len(known) > REMEMBERED:
            self.cores, self.old = {}, known
        return found

    def table(self, words):
        """Of distinct words: where their first and second part begin in one run of ids, the sizes of both, and the run."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        core = pc.utf8_rtrim(words, TAIL)
        simple = pc.match_substring_regex(core, LATIN)
        cores = pc.utf8_lower(core.filter(simple)).dictionary_encode()
        whole = words.filter(simple)
        n_tail = pc.subtract(pc.binary_length(whole), pc.binary_length(core.filter(simple))).to_numpy()
        tails = [whole[i].as_py()[-n_tail[i] :] for i in np.flatnonzero(n_tail)]
        kinds = {t: k for k, t in enumerate(dict.fromkeys(tails), 1)}
        entries = self.ids_of(cores.dictionary.to_pylist())
        first, second = np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
        is_simple = simple.to_numpy(zero_copy_only=False)
        first[is_simple] = cores.indices.to_numpy()
        at_tail = len(entries)
        entries += [b"", *self.encode(list(kinds))]
        tail = np.full(len(whole), at_tail)
        tail[n_tail > 0] = at_tail + np.fromiter(map(kinds.__getitem__, tails), "i8", len(tails))
        second[is_simple], second[~is_simple] = tail, at_tail
        first[~is_simple] = len(entries) + np.arange(int((~is_simple).sum()))
        entries += self.encode(words.filter(pc.invert(simple)).to_pylist())
        sizes = np.fromiter(map(len, entries), "i8", len(entries)) // 4
        starts = np.cumsum(sizes) - sizes
        return starts[first], sizes[first], starts[second], sizes[second], np.frombuffer(b"".join(entries), "<u4")

    def block(self, texts):
        """Ids of all texts of an Arrow array without nulls, and how many each has."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype("i8")
        bounds = bounds - bounds[0]
        a, n_a, b, n_b, flat = self.table(coded.dictionary)
        starts, sizes = np.stack([a, b], axis=1)[codes].ravel(), np.stack([n_a, n_b], axis=1)[codes].ravel()
        ends = np.concatenate([[0], np.cumsum(sizes)])[2 * bounds]
        return gather(starts, sizes, flat), np.diff(ends)

    def of_batch(self, texts) -> Iterator[bytes]:
        """Ids of each text of an Arrow array of strings, as little-endian bytes; texts are taken in blocks of bounded size."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + sizes[to] <= SEGMENT):
                held, to = held + sizes[to], to + 1
            if held <= SEGMENT:
                ids, counts = self.block(pc.fill_null(texts.slice(at, to - at), ""))
                data, a = ids.tobytes(), 0
                for n in counts.tolist():
                    yield data[a : a + 4 * n]
                    a += 4 * n
            else:
                yield b"".join(self.block(pa.array([part]))[0].tobytes() for part in cut_long(texts[at].as_py()))
            at = to


def cut_long(text: str) -> Iterator[str]:
    """Parts of a text, cut at spaces."""
    at, step = 0, SEGMENT // 4
    while at < len(text):
        to = text.find(" ", at + step)
        to = to if to >= 0 else len(text)
        yield text[at:to]
        at = to


def word_ids(path: str | None) -> WordIds:
    """The worker's own, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return worker_state(("packing", path), lambda: WordIds(path))


def tokenize(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: place in the document, length, CRC-32 of the ids, and if asked the ids."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = word_ids(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.of_batch(batch.column("text")), strict=True):
                data = ids + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(data), 4 * length)):
                    part = data[a : a + 4 * length]
                    row = [doc, k, a // 4, len(part) // 4, zlib.crc32(part)]
                    for column, v in zip(rows, row + [memoryview(part).cast("I").tolist()] * with_ids, strict=False):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def fill(lengths: list[int], size: int) -> list[list[int]]:
    """Best-two-fit: bins of indexes into ``lengths``. ``mask`` has a bit for each length at hand."""
    at_hand: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        at_hand.setdefault(n, []).append(i)
    mask = 0
    for n in at_hand:
        mask |= 1 << n
    below = [(1 << (n + 1)) - 1 for n in range(size + 1)]

    def take(n: int) -> int:
        nonlocal mask
        own = at_hand[n]
        i = own.pop()
        if not own:
            del at_hand[n]
            mask &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal mask
        at_hand.setdefault(n, []).append(i)
        mask |= 1 << n

    def two(gap: int, least: int) -> tuple[int, int] | None:
        """The two lengths at hand with the largest sum over ``least`` and within ``gap``."""
        best, found = least, None
        a = (mask & below[gap - 1]).bit_length() - 1
        while a > 0 and 2 * a > best:
            b = (mask & below[min(a, gap - a)]).bit_length() - 1
            if b == a and len(at_hand[a]) < 2:
                b = (mask & below[a - 1]).bit_length() - 1
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = (mask & below[a - 1]).bit_length() - 1
        return found

    bins = []
    while mask:
        own, gap = [], size
        while gap and (n := (mask & below[gap]).bit_length() - 1) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap and own and mask:
            n, i = own[-1]  # the last is the smallest
            if gap + n >= 2 and (pair := two(gap + n, n)):
                own[-1:] = [(m, take(m)) for m in pair]
                give(n, i)
        bins.append([i for _, i in own])
    return bins


def packer(length: int, base: int, last: bool):
    """Packs one bucket; unless it is the last round, pieces of bins that are not full get sequence -1."""
    import numpy as np

    def fit(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:

        group = group.sort_values(["length", "row_"], kind="stable").reset_index(drop=True)
        bins = fill(group["length"].tolist(), length)
        seq, off, sizes = np.zeros(len(group), "int64"), np.zeros(len(group), "int64"), group["length"].to_numpy()
        for k, own in enumerate(bins):
            ends = np.cumsum(sizes[own])
            seq[own] = base + (int(key[0]) << 24) + k if last or ends[-1] >= FULL * length else -1
            off[own] = ends - sizes[own]
        return group.drop(columns="bucket_").assign(sequence_id=seq, offset=off)

    return fit


def pack(pieces: DataFrame, length: int = SEQUENCE, bucket: int = BUCKET) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``length``."""
    numbered = materialize(pieces.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    columns = pieces.columns
    whole = numbered.where(F.col("length") == length).select(*columns, (-1 - F.col("row_")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, done, round_ = numbered.where(F.col("length") < length), [whole], 0
    n, before = todo.count(), math.inf
    while n:
        buckets = math.ceil(n / bucket)
        last = buckets == 1 or n > before / 2

        dealt = todo.withColumn("bucket_", F.pmod(F.xxhash64("row_", F.lit(round_)), F.lit(buckets)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + ", sequence_id long, offset long"
        packed = materialize(dealt.groupBy("bucket_").applyInPandas(packer(length, round_ << 56, last), schema), "packed")
        done.append(packed.where(F.col("sequence_id") >= 0).drop("row_"))
        todo = packed.where(F.col("sequence_id") < 0).drop("sequence_id", "offset")
        before, n = n, 0 if last else todo.count()
        round_ += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select(*out.columns))
    return out


def best_fit_packing(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return pack(tokenize(docs, length, tokenizer, with_ids), length)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of ids from pieces packed ``with_ids``: sequence_id and ids in order."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda x: x["ids"])).alias("ids"))
