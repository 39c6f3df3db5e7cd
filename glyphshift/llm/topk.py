"""Exact top-k inner products by the threshold algorithm.

Each block of candidates has a list for every dimension, sorted by component. A
query walks all lists in step, from the end its own component favours, and scores
in full every row it meets. It stops once the best score that an unseen row could
still reach (the sum of the list heads at that depth) is below its kth result, or
no row is unseen; depths double, down to the whole list. Its first block gives a
query a kth score, which every other block starts from.

Queries and candidates are both dealt into blocks whose sizes have bounds, so no
task holds either whole; a block's kth results are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE, TOP, EVERY = 256, 5, 50
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096


def block_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = TOP, floors: list[int | None] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(query's place, vec_ids, scores, depth, rows scored) of its k best rows
    with another id, ties to the smaller id. floors: a kth score that a query has
    from elsewhere. Integer components; exact in float64 up to 2**53, beyond that
    in Python integers."""
    n, dims = rows.shape
    exact = dims * max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) < 2**53
    table = rows.astype(np.float64) if exact else rows.astype(object)
    asked = queries.astype(np.float64) if exact else queries.astype(object)
    order = np.argsort(rows, axis=0, kind="stable")
    heads = np.take_along_axis(rows, order, axis=0)
    for q in range(len(asked)):
        vector, floor = asked[q], floors[q] if floors else None
        low, high = np.flatnonzero(queries[q] < 0), np.flatnonzero(queries[q] > 0)
        seen, best_ids, best = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, table.dtype)
        depth, scored = 0, 0
        while depth < n:
            upto = min(n, max(1, 2 * depth)) if len(low) + len(high) else n
            met = np.zeros(n, bool)
            met[order[depth:upto, low].ravel()] = True
            met[order[n - upto : n - depth, high].ravel()] = True
            if upto == n:
                met[:] = True  # a query of zeros has no list to walk
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            depth, scored = upto, scored + len(new)
            new = new[row_ids[new] != query_ids[q]]
            scores = table[new] @ vector
            ids, scores = np.concatenate((best_ids, row_ids[new])), np.concatenate((best, scores))
            if len(scores) > 4 * k and exact:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= cut], scores[scores >= cut]
            first = np.lexsort((ids, -scores))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x]))[:k], int)
            best_ids, best = ids[first], scores[first]
            if scored == n:
                break
            kth = best[-1] if len(best) == k else None
            kth = floor if kth is None else kth if floor is None else max(kth, floor)
            if kth is not None and depth < n and heads[depth, low].astype(table.dtype) @ vector[low] + heads[n - depth - 1, high].astype(table.dtype) @ vector[high] < kth:
                break
        yield q, best_ids, best, depth, scored


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    `every`, the k best of all rows with another id by integer inner product of
    floor(scale * x).

    Rows whose id or vector is null or empty, or that hold a null or non-finite
    component, take no part. Vectors score only against those of their own
    length, however long. Rows repeating an id with the same vector count once;
    with another vector each is a candidate, and a query of its own under the
    same id. Ties go to the smaller id. An empty table gives no rows. Other
    columns of the table are not read, whatever their names."""
    spark = vectors.sparkSession
    common.prepare(spark)
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    ints = F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(whole).select("vec_id", ints.alias("v"))
    rows = common.written(rows.withColumn("dims", F.size("v")).withColumn("h", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "h"]), "topk-rows")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), queries.count()
    across, down = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(m / QUERY_BLOCK))
    block = lambda size, seed: F.pmod(F.xxhash64("h", "vec_id", F.lit(seed)), F.lit(size)).cast("int")
    asked = queries.withColumn("b", block(down, 1)).withColumn("home", F.pmod(F.col("b"), F.lit(across)))
    there = rows.withColumn("a", block(across, 2))

    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("query_id", "query_h", "vec_id", "score")}
        if len(asked) and len(there):
            ids, h = asked["vec_id"].to_numpy(), asked["h"].to_numpy()
            floors = [None if pd.isna(x) else int(x) for x in asked["floor"]]
            for q, found, scores, _, _ in block_topk(np.stack(asked["v"]).astype(np.int64), ids, np.stack(there["v"]).astype(np.int64), there["vec_id"].to_numpy(), k, floors):
                keep = [(i, int(s)) for i, s in zip(found.tolist(), scores) if floors[q] is None or s >= floors[q]]
                out["query_id"] += [ids[q]] * len(keep)
                out["query_h"] += [h[q]] * len(keep)
                out["vec_id"] += [i for i, _ in keep]
                out["score"] += [s for _, s in keep]
        return pd.DataFrame(out)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = (d.toDF(*d.columns) for d in (left, right))  # one table on both sides
        cells = left.groupBy("a", "b", "dims").cogroup(right.groupBy("a", "b", "dims"))
        return cells.applyInPandas(search, "query_id long, query_h long, vec_id long, score long")

    # The home block of a block of queries, which gives each of them a kth score.
    none = F.lit(None).cast("string")
    homes = there.withColumn("b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(down - 1)), lambda b: F.pmod(b, F.lit(across)) == F.col("a"))))
    found = meet(asked.withColumn("a", F.col("home")).withColumn("floor", none), homes)
    best = Window.partitionBy("query_id", "query_h").orderBy(F.col("score").desc(), F.col("vec_id"))
    if across > 1:
        found = common.written(found, "topk-home")
        kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("query_h").alias("h"), F.col("score").cast("string").alias("floor"))
        others = F.filter(F.sequence(F.lit(0), F.lit(across - 1)), lambda a: a != F.col("home"))
        left = asked.join(kth, ["vec_id", "h"], "left").withColumn("a", F.explode(others))
        right = there.withColumn("b", F.explode(F.filter(F.sequence(F.lit(0), F.lit(down - 1)), lambda b: F.pmod(b, F.lit(across)) != F.col("a"))))
        found = found.unionByName(meet(left, right))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
