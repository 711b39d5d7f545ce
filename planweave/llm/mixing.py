"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target in words; a document of it is taken ``target / source size`` times on average, as often as
the whole part says and once more by a fractional inclusion probability. The cube method moves these probabilities
through the null space of two constraints, the source's words and its documents, until they are 0 or 1. A source is dealt
to blocks of bounded size by a hash of its rows. In a block, units far larger than the mean move first, against all others,
then all others three at a time; ``LANDING`` units of all sizes are held back. They and at most two more stay fractional and
meet in fewer blocks in the next round, until one block holds all that is left of a source. That block lands its last units:
of all roundings of these few, the one nearest in words, then in documents. Only a document of more than an eighth of the
words of its block, in a source of several blocks, waits for the last block and may leave the source off by half of itself.

Nulls: a null text has no words, a null source is a source and comes last. Texts of any length are counted natively.
Ties and repeated rows: rows of one ``doc_id`` and size are alike and each is a unit of its own; a choice among them is
arbitrary. An empty table gives an empty table. Columns of other names are carried if named in ``keep``; the operator's
own names win over columns of the table that clash with them. The same rows give the same mix, however they are dealt.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, number_rows

#: Weights of the sources in their order, repeated; share of all words to mix; most times a document is taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Rows of a block, on average. Units that a source keeps for its landing.
BLOCK, LANDING = 2_500, 12
#: Units of more than so many times their block's mean size are decided first, against all others.
LARGE = LANDING / 2
#: A probability so near to 0 or 1 has arrived there.
NEAR = 1e-9

OWN = ["size", "source_size", "target", "copies", "taken"]


def sources(sized: DataFrame, weights: tuple, share: float, repeats: int) -> DataFrame:
    """Per source: its words and rows, and the target: a share by weight, at most ``repeats`` times its words.

    The excess of those at the limit is shared again by weight until none is above. The ranks come from a range sort.
    """
    own = sized.groupBy("source_").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows_"))
    own = materialize(own.orderBy(F.col("source_").asc_nulls_last()).withColumn("at_", F.monotonically_increasing_id()), "sources")
    part, begins, so_far = F.shiftright("at_", 33), {}, 0
    for r in sorted(own.groupBy(part.alias("part")).count().collect()):
        begins[r["part"]], so_far = so_far, so_far + r["count"]
    if not begins:
        return own.select("source_", "source_size", "rows_", F.lit(0).cast("long").alias("rank_"), F.lit(0.0).alias("target"))
    begin = F.element_at(F.create_map(*[F.lit(int(x)).cast("long") for kv in begins.items() for x in kv]), part.cast("long"))
    rank = begin + F.col("at_").bitwiseAND((1 << 33) - 1)
    own = own.withColumn("rank_", rank.cast("long")).withColumn("weight_", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank_") % len(weights) + 1).cast("int")))
    total = own.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, F.col("source_size") * repeats
    while True:  # the level rises, and with it who is at the limit: it ends when a level leaves all as they are
        above = limit <= F.lit(level) * F.col("weight_")
        full, open_weight = own.agg(F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight_")))).first()
        after = (total * share - full) / open_weight if open_weight else level
        if after <= level:
            break
        level = after
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight_"))
    return own.select("source_", "source_size", "rows_", "rank_", target.alias("target"))


def decide_large(size: np.ndarray, p: np.ndarray, free: np.ndarray, most: float, rng: random.Random) -> None:
    """Moves each unit far larger than the others, of at most ``most``, to 0 or 1, through the null space of (size, 1) over all ``free`` units.

    Three units at a time could not: a few small ones reach their ends long before a large one has moved.
    """
    inside = lambda x: (x > NEAR) & (x < 1 - NEAR)
    for i in np.argsort(-size, kind="stable")[: int((size > LARGE * size.mean()).sum())]:
        while size[i] <= most and inside(p[i]):
            rest = np.flatnonzero(inside(p) & free)
            rest = rest[rest != i]
            off = size[rest] - size[rest].mean() if len(rest) else np.zeros(0)
            if not (off * off).sum():
                return
            step = -1 / len(rest) - (size[i] - size[rest].mean()) / (off * off).sum() * off
            at, step = np.append(rest, i), np.append(step, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.nanmin(np.where(step > 0, (1 - p[at]) / step, np.where(step < 0, p[at] / -step, np.inf)))
                down = np.nanmin(np.where(step > 0, p[at] / step, np.where(step < 0, (1 - p[at]) / -step, np.inf)))
            p[at] += (up if rng.random() * (up + down) < down else -down) * step
            ends = at[~inside(p[at])]
            if not len(ends):  # rounding: the nearest one
                ends = at[[np.argmin(np.minimum(p[at], 1 - p[at]))]]
            p[ends] = np.round(p[ends])


def flight(size: list, p: list, order: list, rng: random.Random) -> list:
    """Moves ``p`` of the units in ``order`` through the null space of (size, 1), three units at a time; who stays fractional."""
    window: list = []
    for i in order:
        window.append(i)
        while len(window) == 3 or (len(window) == 2 and size[window[0]] == size[window[1]]):
            a, b, c = (size[j] for j in (window if len(window) == 3 else [*window, window[0]]))
            step = (float(b - c), float(c - a), float(a - b)) if len(window) == 3 and (a != b or b != c) else (1.0, -1.0)
            up = min((1 - p[j]) / s if s > 0 else p[j] / -s for j, s in zip(window, step) if s)
            down = min(p[j] / s if s > 0 else (1 - p[j]) / -s for j, s in zip(window, step) if s)
            by = up if rng.random() * (up + down) < down else -down
            for j, s in zip(window, step):
                p[j] += by * s
            arrived = [j for j in window if p[j] < NEAR or p[j] > 1 - NEAR]
            if not arrived:  # rounding: the nearest one
                arrived = [min(window, key=lambda j: min(p[j], 1 - p[j]))]
            for j in arrived:
                p[j] = float(round(p[j]))
            window = [j for j in window if j not in arrived]
    return window


def land(size: list, p: list, left: list, words: float, rows: float) -> None:
    """Rounds the few units ``left`` so that they come nearest to so many words, then to so many rows."""
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off_words = np.abs(choices @ np.array([size[i] for i in left], dtype=float) - words)
    off_rows = np.abs(choices.sum(axis=1) - rows)
    best = choices[np.lexsort((off_rows, off_words))[0]]
    for i, x in zip(left, best):
        p[i] = float(x)


def fly_block(units: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One block: all but the units held back fly; these land if the block is its source's only one."""
    units = units.sort_values(["key_", "size", "p_"], kind="stable")
    size, p = units["size"].to_numpy(), units["p_"].to_numpy().copy()
    words, rows = float(size @ p), float(p.sum())
    rank, block, blocks = (int(units[c].iloc[0]) for c in ("rank_", "block_", "blocks_"))
    rng = random.Random(f"{seed} {rank} {block} {blocks}")
    by_size = np.argsort(size, kind="stable")
    by_size = by_size[: max(1, int((size <= LARGE * size.mean()).sum()))]
    held = np.unique(by_size[np.arange(LANDING) * (len(by_size) - 1) // (LANDING - 1)])
    free = np.ones(len(p), dtype=bool)
    free[held] = False
    decide_large(size.astype(float), p, free, np.inf if blocks == 1 else size.sum() / 8, rng)
    order = np.flatnonzero(free & (p > 0) & (p < 1)).tolist()
    size, p = size.tolist(), p.tolist()
    left = flight(size, p, order, rng) + held.tolist()
    if blocks == 1 and left:
        inside = set(left)
        decided = [i for i in range(len(p)) if i not in inside]
        land(size, p, left, words - sum(size[i] * p[i] for i in decided), rows - sum(p[i] for i in decided))
    return pd.DataFrame({"row_": units["row_"].to_numpy(), "key_": units["key_"].to_numpy(), "rank_": rank, "size": size, "p_": p})


def decide(units: DataFrame, seed: int) -> DataFrame:
    """0 or 1 for each fractional unit (row_, key_, rank_, size, p_, and rows_ of its source), by rounds of blocks."""
    done = []
    fly = lambda block: fly_block(block, seed)
    for step in range(99):
        dealt = units.withColumn("blocks_", F.ceil(F.col("rows_") / BLOCK).cast("long"))
        dealt = dealt.withColumn("block_", F.pmod(F.xxhash64("key_", F.lit(step)), F.col("blocks_"))).drop("rows_")
        flown = materialize(dealt.groupBy("rank_", "block_").applyInPandas(fly, "row_ long, key_ long, rank_ long, size long, p_ double"), "flown")
        done.append(flown.where("p_ IN (0.0, 1.0)").select("row_", F.col("p_").cast("long").alias("more_")))
        left = flown.where("p_ NOT IN (0.0, 1.0)")
        rows = materialize(left.groupBy("rank_").agg(F.count(F.lit(1)).alias("rows_")), "left")
        if rows.isEmpty():
            break
        units = left.join(rows, "rank_")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, keep: list[str] = ("doc_id",), weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """``keep`` of every row, its size, its source's size and target, and how often it is taken: ``copies``, ``taken`` words."""
    keep = carried(list(keep), OWN)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(*keep, F.col("source").cast("string").alias("source_"), size.alias("size"), F.col("doc_id").alias("doc_id_"))
    numbered = number_rows(sized, [*keep, "source_", "size", "doc_id_"])
    by = F.when(F.col("doc_id_").isNotNull(), F.xxhash64("doc_id_", "size", F.lit(seed))).otherwise(F.xxhash64("row_", F.lit(seed)))
    plan = materialize(sources(numbered, weights, share, repeats), "plan")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = numbered.join(plan, numbered["source_"].eqNullSafe(plan["source_"])).withColumns({"whole_": F.floor(times).cast("long"), "p_": times - F.floor(times)})
    units = planned.where((F.col("p_") > NEAR) & (F.col("p_") < 1 - NEAR)).select("row_", by.alias("key_"), "rank_", "size", "p_", "rows_")
    more = decide(units, seed)
    sure = F.when(F.col("p_") >= 1 - NEAR, 1).otherwise(0)
    out = planned.join(more, "row_", "left").withColumn("copies", F.col("whole_") + F.coalesce("more_", sure))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
