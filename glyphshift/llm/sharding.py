"""Proportional stratified interleaving of rows into shards.

The rows of each source are shuffled by a seeded key and ranked; a row's
fractional rank is (rank + 1/2) / rows of its source. All rows sorted by it are
cut into shards of equal counts, so any shard holds each source in the
proportion of the whole. No text is shuffled, and no source meets in one task:
ranks are an offset for each sorted partition plus the place inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PAD_BYTES = 16


def _placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows in the given order, with part (which range of it) and place (in the
    part, from 0); written, for the ranges of a later run may differ."""
    spark = rows.sparkSession
    spread = rows.repartitionByRange(common.parallelism(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return common.written(spread.withColumn("_at", at).withColumn("part", F.shiftright("_at", 33)).withColumn("place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), name)


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot (gapless from 0 in a shard).

    Shard counts differ by one at most. A null source is a source of its own; a
    null text has size PAD_BYTES and the checksum of no bytes; repeated rows are
    interchangeable and each placed once; an empty table gives no rows. Equal
    texts are rows like any other: by the law of rows a shard's count is all that
    binds, so copies lie where their ids are dealt, in any shards. Columns other
    than the three that are named are not read, whatever their names."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(body) + PAD_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))).alias("dealt"),
    )
    order = [F.col("source").asc_nulls_first(), F.col("dealt"), F.col("doc_id"), F.col("text_crc32")]
    placed = _placed(rows, order, "shard-sources")
    # The first place and the count of each source in each part: as many rows as parts and sources together.
    runs = placed.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    runs = runs.select(F.col("source").alias("_s"), F.col("part").alias("_p"), (F.col("offset") - F.col("first")).alias("shift"), "total")
    ranked = placed.join(runs, placed["source"].eqNullSafe(runs["_s"]) & (placed["part"] == runs["_p"])).select(
        *rows.columns, ((F.col("place") + F.col("shift") + 0.5) / F.col("total")).alias("fraction"))
    lined = _placed(ranked, [F.col("fraction"), F.col("source").asc_nulls_first(), F.col("dealt"), F.col("doc_id"), F.col("text_crc32")], "shard-line")
    parts = lined.groupBy("part").agg(F.count("*").alias("n"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    index, total = F.col("offset") + F.col("place"), F.col("rows")
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return (lined.join(parts, "part").withColumn("index", index).withColumn("shard", F.expr(f"cast(index * {shards} div rows as int)"))
            .withColumn("slot", (F.col("index") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "shard", "slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", rows_per_file: int = 1_000_000) -> None:
    """Write docs as Parquet under path/shard=N, in slot order inside each file;
    placed is what interleave() gives for them. Each row is written once: rows
    that repeat an id and a text take its places in turn. Columns of docs named
    shard or slot are replaced."""
    names = common.without(docs, ["shard", "slot"])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, body = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    keyed = rows.withColumn("_i", id_).withColumn("_c", F.crc32(F.coalesce(body, F.lit("")).cast("binary"))).withColumn("_n", F.octet_length(F.coalesce(body, F.lit(""))) + PAD_BYTES)
    turn = F.row_number().over(Window.partitionBy("_i", "_c", "_n").orderBy(F.monotonically_increasing_id()))
    at = placed.select(F.col("doc_id").alias("_i2"), F.col("text_crc32").alias("_c2"), F.col("size").alias("_n2"), "shard", "slot")
    at = at.withColumn("_k2", F.row_number().over(Window.partitionBy("_i2", "_c2", "_n2").orderBy("shard", "slot")))
    own = keyed.withColumn("_k", turn)
    both = own.join(at, own["_i"].eqNullSafe(at["_i2"]) & (own["_c"] == at["_c2"]) & (own["_n"] == at["_n2"]) & (own["_k"] == at["_k2"]))
    piece = F.expr(f"slot div {rows_per_file}")
    out = both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")
    out.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
