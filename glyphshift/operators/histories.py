"""Earlier readings of words, by walking sound changes backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANY = object()  # every context counts


def chosen_bindings(words: DataFrame, bindings: DataFrame, context: object = ANY) -> DataFrame:
    """words(word_id, place, symbol, modern, ...) with the allowed patterns of
    each of their bindings(symbol, modern, context, patterns). A context (None:
    the unqualified one) takes its own bindings; unqualified ones stand in only
    where no binding is qualified."""
    met = words.join(bindings, ["symbol", "modern"])
    if context is ANY:
        return met
    here = F.col("context").eqNullSafe(F.lit(context))
    at = Window.partitionBy("word_id", "place")
    told = met.withColumn("_own", F.bool_or(here).over(at)).withColumn("_some", F.bool_or(F.col("context").isNotNull()).over(at))
    return told.where(here | (~F.col("_own") & ~F.col("_some"))).drop("_own", "_some")


def earlier_forms(starts: DataFrame, patterns: DataFrame, limit: int = 50) -> DataFrame:
    """word_id, place, historical: the ends of all backward walks from
    starts(word_id, place, modern, before, after, patterns) over
    patterns(id, source, target, left_ends, right_starts).

    A pattern that changes nothing ends a walk where it is; no node is entered
    twice; a binding without patterns keeps its reading. A round of joins for
    each link of the longest chain, each written to the checkpoint folder; more
    than limit rounds fail."""
    done = starts.where(F.size("patterns") == 0).select("word_id", "place", F.col("modern").alias("historical"))
    cur = starts.where(F.size("patterns") > 0).select("word_id", "place", "before", "after", F.col("patterns").alias("allowed"), F.col("modern").alias("node"), F.array("modern").alias("seen"))
    fits = lambda c, g, f: F.coalesce(F.col(g), F.lit("")).eqNullSafe("") | f(F.coalesce(F.col(c), F.lit("")), F.col(g))
    for _ in range(limit):
        guard = fits("before", "left_ends", F.endswith) & fits("after", "right_starts", F.startswith)
        step = cur.join(patterns, (F.col("target") == F.col("node")) & F.array_contains("allowed", F.col("id")) & guard, "left").checkpoint()
        ends = (F.col("source") == F.col("node")) | (F.col("id").isNull() & (F.size("seen") > 1))
        done = done.unionByName(step.where(ends).select("word_id", "place", F.col("node").alias("historical")))
        cur = step.where((F.col("source") != F.col("node")) & ~F.array_contains("seen", F.col("source"))).select("word_id", "place", "before", "after", "allowed", F.col("source").alias("node"), F.concat("seen", F.array("source")).alias("seen"))
        if cur.isEmpty():
            return done.distinct()
    raise ValueError(f"a chain of patterns is longer than {limit}")


def reconstructed(words: DataFrame, bindings: DataFrame, patterns: DataFrame, context: object = ANY) -> DataFrame:
    """word_id, status and historical (sorted): every combination of the places'
    earlier forms. One is resolved, several are candidates; a place without any
    leaves its word unresolved."""
    along = Window.partitionBy("word_id").orderBy("place")
    near = words.withColumn("before", F.lag("modern").over(along)).withColumn("after", F.lead("modern").over(along))
    forms = earlier_forms(chosen_bindings(near, bindings, context), patterns)
    options = forms.groupBy("word_id", "place").agg(F.array_sort(F.collect_set("historical")).alias("options"))
    places = words.select("word_id", "place").join(options, ["word_id", "place"], "left")
    rows = places.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("place", "options"))).alias("p"))
    product = F.aggregate("p", F.array(F.lit("")), lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(F.coalesce(x["options"], F.array().cast("array<string>")), lambda o: F.concat(a, o)))))
    found = rows.select("word_id", F.array_sort(F.array_distinct(product)).alias("historical"))
    n = F.size("historical")
    return found.select("word_id", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("candidates").alias("status"), "historical")
