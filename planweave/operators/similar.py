"""Fuzzy search of a table of queries in a table of names: a set-similarity join over trigrams, then exact word similarity.

Word similarity of a query and a name is the largest share, over all runs of the name's trigrams in their order, of the
trigrams that run and query have in common among those that either has. A run has no more of them in common with the query
than the whole name, so a name needs at least ``threshold`` times the query's trigrams: names are posted under their trigrams,
and of each query only its rarest trigrams are looked up, as many as a similar name can't lack altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trigrams(text: Column) -> Column:
    """Ordered trigrams of each word, two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def best_run(own: Column, asked: Column) -> Column:
    """Word similarity of ordered trigrams ``own`` to the set ``asked``: from each trigram of the set on, one pass that counts as it goes.

    A trigram adds to a run if its former place lies before the run's start, so a step needs no look at the run. Runs that
    begin or end with a trigram of the query's are enough; others have one more that is not in common.
    """
    n = F.size(asked)
    mark = lambda t: F.transform(t, lambda g, i: F.struct(F.array_contains(asked, g).alias("hit"), i.alias("at"), former(t, g, i).alias("former")))
    former = lambda t, g, i: F.coalesce(F.array_max(F.filter(F.transform(t, lambda h, j: F.when((h == g) & (j < i), j)), lambda j: j.isNotNull())), F.lit(-1))
    start = F.struct(F.lit(0).alias("common"), F.lit(0).alias("size"), F.lit(0.0).alias("best"))

    def step(first: Column):
        def go(s: Column, t: Column) -> Column:
            new = (t["at"] >= first) & (t["former"] < first)
            common, size = s["common"] + (new & t["hit"]).cast("int"), s["size"] + new.cast("int")
            share = F.when(t["hit"] & (t["at"] >= first), common / (size + n - common)).otherwise(0.0)
            return F.struct(common.alias("common"), size.alias("size"), F.greatest(s["best"], share).alias("best"))

        return go

    def best(marks: Column) -> Column:
        starts = F.filter(marks, lambda t: t["hit"])
        return F.coalesce(F.array_max(F.transform(starts, lambda t: F.aggregate(marks, start, step(t["at"]), lambda s: s["best"]))), F.lit(0.0))

    return let(mark(own), best)


def word_similarity_join(queries: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Queries (id, q) and distinct names (name) that are similar to them: id, name, similarity, of at least ``threshold``.

    Queries or names without a letter or digit are similar to nothing.
    """
    own = names.select("name").distinct().select("name", F.explode(F.array(trigrams(F.col("name")))).alias("own_")).where(F.size("own_") > 0)
    posted = own.select("name", F.explode(F.array_distinct("own_")).alias("g"))
    # what many ask in the same trigrams is answered once, and joined back
    sets = queries.select("id", F.array_sort(F.array_distinct(trigrams(F.col("q")))).alias("asked_")).where(F.size("asked_") > 0)
    asked = sets.select("asked_").distinct()
    counts = posted.groupBy("g").agg(F.count(F.lit(1)).alias("names_"))
    ranked = asked.select("asked_", F.explode("asked_").alias("g")).join(counts, "g", "left")
    ranked = ranked.groupBy("asked_").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("names_", F.lit(0)).alias("names_"), "g"))).alias("by_"))
    need = F.ceil(F.size("by_") * F.lit(threshold) - 1e-9).cast("int")
    looked = ranked.select("asked_", F.explode(F.slice("by_", F.lit(1), F.greatest(F.size("by_") - need + 1, F.lit(1)))).alias("b")).select("asked_", "b.g")
    # few bytes, much work: dealt to all tasks by number, which the planner doesn't merge
    dealt = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = looked.join(posted, "g").select("asked_", "name").distinct().repartition(dealt, "asked_", "name")
    enough = F.size(F.array_intersect("own_", "asked_")) >= F.size("asked_") * F.lit(threshold) - 1e-9
    scored = met.join(own, "name").where(enough).withColumn("similarity", best_run(F.col("own_"), F.col("asked_")))
    return sets.join(scored.where(F.col("similarity") >= threshold), "asked_").select("id", "name", "similarity")


def fuzzy_projects(queries: DataFrame, projects: DataFrame, threshold: float = 0.5, texts: tuple = ("utility", "name", "location_ref")) -> DataFrame:
    """Queries (id, q) to projects by the most similar of their texts: query, id, similarity."""
    posted = projects.select(F.col("id").alias("project"), F.explode(F.array_distinct(F.array(*texts))).alias("name")).where("name IS NOT NULL")
    hits = word_similarity_join(queries, posted, threshold)
    return hits.join(posted, "name").groupBy(F.col("id").alias("query"), F.col("project").alias("id")).agg(F.max("similarity").alias("similarity"))
