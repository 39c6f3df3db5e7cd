"""Writers: whole or not at all, with a manifest of digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by rename; a failure leaves the old one."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(conf)
    had = fs.exists(to(path)) and fs.rename(to(path), to(old))
    if not fs.rename(to(new), to(path)):
        if had:
            fs.rename(to(old), to(path))
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(to(old), True)


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows and a digest that doesn't depend on their order. Row hashes
    are combined by sums, so nothing is collected."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(8)]
    return df.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(",", "rows", *[f"s{k}" for k in range(8)]).cast("binary"), 256).alias("digest"))


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Range-sharded by key and sorted inside, so a key's readers skip the rest."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_repeated(df: DataFrame, path: str, *columns: str, dictionary_mb: int = 64) -> None:
    """Parquet for rows that hold few distinct, very long strings in `columns`: each
    string is stored once in a row group, and rows name it. Parquet's own dictionary
    page of 1 MB doesn't take a longer one, and every row then repeats it. What passes
    `dictionary_mb` is written out in full, as ever. Those columns get no statistics,
    which would compare whole strings in each row. The session is left as it is."""
    w = df.write.option("parquet.dictionary.page.size", dictionary_mb << 20)
    for c in columns:
        w = w.option(f"parquet.column.statistics.enabled#{c}", "false")
    w.parquet(path)


def write_profile(rules: DataFrame, path: str, name: str) -> None:
    """One JSON object: the profile's name and its rules(id, enabled, priority) in
    the order of ids. A profile lists rules that people wrote, so it's one row."""
    row = F.struct(F.col("id").cast("string").alias("id"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("priority", F.lit(0)).cast("int").alias("priority"))
    whole = rules.agg(F.array_sort(F.collect_list(row)).alias("rules")).select(F.to_json(F.struct(F.lit(name).alias("name"), "rules")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
