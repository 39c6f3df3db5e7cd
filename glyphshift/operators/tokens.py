"""Rules over token sequences: conditions on neighbours, left-to-right use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching


def split_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, idx, surface: what stands between spaces. A tokenizer's own table
    has the same first columns and more of them."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, " ")).alias("idx", "surface"))


def with_context(tokens: DataFrame, columns: list[str], reach: int = 1) -> DataFrame:
    """tokens plus prev1_*, next1_* and so on."""
    at = Window.partitionBy("doc_id").orderBy("idx")
    for k in range(1, reach + 1):
        for c in columns:
            tokens = tokens.withColumn(f"prev{k}_{c}", F.lag(c, k).over(at)).withColumn(f"next{k}_{c}", F.lead(c, k).over(at))
    return tokens


def applied(tokens: DataFrame, rules: list[tuple[str, int, int, Column]]) -> DataFrame:
    """doc_id, idx, rule, size: rules (id, priority, tokens taken, condition on a
    token with its context), highest priority first and then by id; left to
    right, and past the tokens that a rule took."""
    options = F.array(*[F.when(c, F.struct(F.lit(-p).alias("p"), F.lit(r).alias("rule"), F.lit(n).alias("size"))) for r, p, n, c in rules])
    hit = tokens.withColumn("_h", F.get(F.array_sort(F.array_compact(options)), F.lit(0))).where("_h is not null")
    spans = hit.select("doc_id", F.struct(F.col("idx").alias("start"), (F.col("idx") + F.col("_h.size")).alias("end"), F.col("_h.rule").alias("rule")).alias("s"))
    kept = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("doc_id", F.explode(matching.greedy(F.col("s"))).alias("k"))
    return kept.select("doc_id", F.col("k.start").alias("idx"), "k.rule", (F.col("k.end") - F.col("k.start")).alias("size"))


def boundaries(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, start, end, ...) plus gate: allowed where both ends are
    token boundaries, else crosses_lexical_boundary."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = tokens.withColumn("start", F.coalesce(F.sum(F.length("surface") + 1).over(before), F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("surface")).cast("int"))
    left, right = ends.select("doc_id", "start", F.lit(True).alias("_l")), ends.select("doc_id", "end", F.lit(True).alias("_r"))
    j = candidates.join(left.distinct(), ["doc_id", "start"], "left").join(right.distinct(), ["doc_id", "end"], "left")
    return j.withColumn("gate", F.when(F.col("_l") & F.col("_r"), "allowed").otherwise("crosses_lexical_boundary")).drop("_l", "_r")
