"""Quality rules: a threshold table compiled into one projection of native expressions.

Defined results: a null, empty or blank text has no words, so all counts are 0 and it fails the
base rule; repeated rows each get their own result; ratios over no words or no lines are null and
pass their rule; stop words count in any case; other columns of the input, whatever their names, are left out of the
result; an empty table gives no rows; a text of any length is one row of one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is it for with as was on be by this are or an at from not have but which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat "
    "la le et les un du une que est pour qui dans par plus pas au sur ne se ce il sont avec de en "
    "el los las y del lo con una su al como más o pero sus"
).split()

#: What may stand after a stop word.
TAIL = ".,;:!?"


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose ``measure`` is null or lies between ``low`` and ``high``, both included."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Measures are named in ``measures``.
RULES = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.04),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def repeated_words(words: Column) -> Column:
    """Words inside a window of three that the array holds twice or more, the first one included.

    Hashes of the windows tell most texts apart from those with a repeat; only these compare the
    windows themselves, sorted so that equal ones are neighbours.
    """
    at = F.sequence(F.lit(1), F.size(words) - 2)
    none = F.lit(0)

    def covered(w: Column) -> Column:
        window = F.transform(at_of(w), lambda i: F.struct(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("t"), i.alias("i")))
        return let(F.sort_array(window), lambda s: let(F.sort_array(starts(s)), spanned))

    def at_of(w: Column) -> Column:
        return F.sequence(F.lit(1), F.size(w) - 2)

    def starts(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, j: x["t"] == F.get(s, j)["t"]
        return F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce((j + 1 < n) & same(x, j + 1), F.lit(False))), lambda x: x["i"])

    def spanned(r: Column) -> Column:
        steps = F.transform(r, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) < 4, none).when(F.size(F.array_distinct(hashes)) == F.size(words) - 2, none).otherwise(covered(words))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts and ratios of one text; ``lines`` are its lines that hold a word."""
    n, n_lines = F.size(words), F.size(lines)
    word_chars = F.length(F.array_join(words, ""))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    dup = n_lines - F.size(F.array_distinct(lines))
    stops = F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(TAIL)).isin(STOP_WORDS)))
    ratio = lambda x, y: F.when(y > 0, x / y)
    share = lambda test: ratio(F.size(F.filter(lines, test)), n_lines)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": F.coalesce(symbols, F.lit(0)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
        "mean_word_chars": ratio(word_chars, n),
        "symbol_ratio": ratio(F.coalesce(symbols, F.lit(0)), n),
        "stop_ratio": ratio(stops, n),
        "dup_line_ratio": ratio(dup, n_lines),
        "bullet_line_ratio": share(lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-•*‣·][\x20\x09-\x0D]")),
        "ellipsis_line_ratio": share(lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, as one array expression over the measures' columns."""
    failed = []
    for r in rules:
        if r.low is not None:
            failed.append(F.when(F.col(r.measure) < r.low, F.lit(f"{r.measure} < {r.low:g}")))
        if r.high is not None:
            failed.append(F.when(F.col(r.measure) > r.high, F.lit(f"{r.measure} > {r.high:g}")))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, all measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    split = docs.select(
        F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"), words_of(F.col(f"`{text}`")).alias("words"),
        F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    lines = F.coalesce(F.col("lines"), F.array().cast("array<string>"))
    measured = split.select(key, *[c.alias(k) for k, c in measures(F.col("text"), F.col("words"), lines).items()])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))
    judged = measured.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
