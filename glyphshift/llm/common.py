"""What the operators of this subpackage share: the shared folder, written
intermediates, word splitting, hashing and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small
    enough that a batch of very long texts fits a worker. On a cluster the
    package itself is shipped with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Where it names none, a local one is set if all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphshift-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/glyphshift/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost
    executors, and lets Spark drop the shuffle files of the job that made it, at
    once unless that was a small one."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    if not small:
        free(spark)
    return out


def free(spark: SparkSession) -> None:
    """Let go of what finished jobs left. Spark removes shuffle files when the
    driver's JVM has collected the plan that owned them, else they stay on the
    executors' disks for as long as the driver's heap does not fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a written intermediate that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with its own columns of these names under free ones, so that columns of
    these names can be added, and the pairs (own name, name now)."""
    asked = {n.lower() for n in names}
    taken = asked | {c.lower() for c in df.columns}
    pairs = []
    for c in df.columns:
        now, k = c, 0
        while now.lower() in asked or now != c and now.lower() in taken:
            now, k = f"{c}_{k}", k + 1
        taken.add(now.lower())
        pairs.append((c, now))
    return df.toDF(*[now for _, now in pairs]), pairs


def given_back(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The columns that set_aside renamed, under their own names; no others."""
    return df.select(*[F.col(f"`{now}`").alias(c) for c, now in pairs])


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df that none of these names would clash with."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def chosen_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, hash of text) is in wanted(_id, _key), one
    for each pair."""
    own, pairs = set_aside(docs, ["_id", "_key", "_text"])
    keyed = own.withColumn("_text", F.xxhash64("text"))
    kept = keyed.join(wanted, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_text"] == F.col("_key")), "left_semi")
    return given_back(kept.dropDuplicates(["doc_id", "_text"]), pairs)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


@contextmanager
def uncollected():
    """No garbage collection meanwhile: where a large cache is filled, it would
    walk all of it again and again. Afterwards it is as before, for a worker goes
    on to other tasks, which do leave cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_WORKER: dict = {}


def worker_state(name: str, make):
    """What an operator keeps in its Python worker from task to task. A worker
    serves one operator after another, so only the latest one's is kept."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = make()
    return _WORKER[name]


class WordHashes(dict):
    """bytes of a word -> 64-bit hash, remembering a bounded number of words."""

    def __init__(self, seed: int = 0, bound: int = 300_000) -> None:
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) >= self.bound:
            self.clear()
        self[word] = h
        return h


class Known:
    """A cache of two generations: what is asked for again outlives the turnover
    that comes when the young one has `bound` entries."""

    def __init__(self, bound: int) -> None:
        self.bound, self.new, self.old = bound, {}, {}

    def unknown(self, keys: set) -> set:
        """The keys in neither generation; the others are in `new` from now on."""
        rest = keys - self.new.keys()
        again = rest & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return rest - again

    def turn(self) -> None:
        """Between batches only: a batch reads back what it has put in."""
        if len(self.new) >= self.bound:
            self.old, self.new = self.new, {}


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> _S32)) * _C2
    x = (x ^ (x >> _S29)) * _C1
    return x ^ (x >> _S32)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashed neighbours, order kept."""
    return mix(a * _C1 + b)


def window_hashes(h: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hash of the n values from each position on, by doubling: a window of 2n
    is made of two of n. Windows that overrun the end are left out."""
    double = {1: h}
    while 2 * max(double) <= max(lengths):
        n = max(double)
        double[2 * n] = joined(double[n][: len(double[n]) - n], double[n][n:])
    out = {}
    for n in lengths:
        got, at = None, 0
        for m in sorted(double, reverse=True):
            if n & m:
                part = double[m][at:]
                if got is None:
                    got = part
                else:
                    k = max(0, min(len(got), len(part)))
                    got = joined(got[:k], part[:k])
                at += m
        out[n] = got[: max(0, len(h) - n + 1)]
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal keys from batches sorted by the key: tables that
    never split a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the least node that can be reached, for every node of the
    undirected edges (u long, v long).

    Alternating stars: each node's larger neighbours are tied to the least one
    around it, then its smaller ones, until every node hangs on its root. Both
    steps are a min by node (combined before the shuffle, so a node with very
    many links is harmless) and a join of two written tables, which adaptive
    execution can split. The links stay in the shared folder; nothing but two
    numbers gets to the driver."""
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur, mark = written(ends, name), None
    for _ in range(rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name, small=True)
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name, small=True)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name, small=True)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = written(small, name)
        got = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for df in (cur, least, large, low):
            dropped(new.sparkSession, df)
        cur, mark, same = new, tuple(got), tuple(got) == mark
        if same or not got[0]:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


