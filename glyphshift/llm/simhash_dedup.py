"""SimHash near-duplicates by pivot distance tables.

Every fingerprint is placed by its Hamming distances to fixed reference
fingerprints (pivots). Distances to one pivot differ by at most the distance of
the two fingerprints, so a pair whose tables differ by more than the radius in
any coordinate is discarded without being compared; the rest is verified.

Pivots come in families: a base and, for each of BLOCKS bit ranges, the base
with that range flipped. The two distances of such a couple tell how many bits
of the range differ from the base. Two fingerprints within radius 4 differ in at
most 4 of the 6 ranges, so in at least 2 ranges all their coordinates agree:
pairs are looked for under the coordinates of each 2 of the 6 ranges (15 keys
for a fingerprint), which loses none. The rest of the bits of two fingerprints
under one key are 5 parts of which at least one agrees, so a key of very many
fingerprints is split by the coordinates of each of those parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, BLOCKS, FAMILIES, SEED = 4, 6, 8, 42
KEEP_BLOCKS = BLOCKS - RADIUS
#: A key of more fingerprints is split.
HOT = 1024


def fingerprint(text: bytes | None, words: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, repeats counted; no word: 0."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    hash_of = xxhash.xxh64_intdigest
    if len(found) < words:
        return hash_of(line, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    h = np.array([hash_of(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus `fp` long: the fingerprint's bits as a signed 64-bit number."""
    columns = docs.columns
    kept = [c for c in columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in common.binary(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps, pa.int64())], [*kept, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{kinds}, fp long" if kinds else "fp long")


def _pivots() -> tuple[np.ndarray, list[np.uint64]]:
    base = np.random.default_rng(20240817).integers(0, 2**64, FAMILIES, dtype=np.uint64)
    edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
    masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edges, edges[1:])]
    return base, masks


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Distances to all pivots: for each, FAMILIES bases, then the bases with
    range 0 flipped, range 1 flipped, ... as uint8 (rows: fingerprints)."""
    base, masks = _pivots()
    pivots = np.concatenate([base, *(base ^ m for m in masks)])
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.uint8)


def pivot_keys(fps: np.ndarray) -> np.ndarray:
    """A key for each choice of KEEP_BLOCKS ranges (columns): the ranges and the
    distances inside them, hashed to 64 bits."""
    table = distance_table(fps).astype(np.int64)
    inside = [table[:, FAMILIES * (b + 1) : FAMILIES * (b + 2)] - table[:, :FAMILIES] for b in range(BLOCKS)]
    packed = []
    for part in inside:
        h = np.zeros(len(fps), np.uint64)
        for column in (part + 64).astype(np.uint64).T:
            h = common.joined(h, column)
        packed.append(h)
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), KEEP_BLOCKS)):
        h = np.full(len(fps), n + 1, np.uint64)
        for b in chosen:
            h = common.joined(h, packed[b])
        keys.append(h)
    return np.stack(keys, axis=1)


def part_keys(fps: np.ndarray, key: int) -> np.ndarray:
    """A key for each of RADIUS + 1 parts (columns) of the bits outside the ranges
    of the key-th choice: the part's pivot coordinates, hashed to 64 bits."""
    base, masks = _pivots()
    chosen = list(combinations(range(BLOCKS), KEEP_BLOCKS))[key]
    bits = [i for b, m in enumerate(masks) if b not in chosen for i in range(64) if int(m) >> i & 1]
    keys = []
    for n, part in enumerate(np.array_split(np.array(bits), RADIUS + 1)):
        mask = np.uint64(sum(1 << int(i) for i in part))
        h = np.full(len(fps), n + 1, np.uint64)
        inside = np.bitwise_count(fps[:, None] ^ (base ^ mask)[None, :]).astype(np.int64) - np.bitwise_count(fps[:, None] ^ base[None, :])
        for column in (inside + 64).astype(np.uint64).T:
            h = common.joined(h, column)
        keys.append(h)
    return np.stack(keys, axis=1)


def within(fa: np.ndarray, ta: np.ndarray, fb: np.ndarray, tb: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) at radius or less: pivots first, a few at a time, then the bits."""
    i, j = (x.ravel() for x in np.indices((len(fa), len(fb)), dtype=np.int32))
    for at in range(0, ta.shape[1], FAMILIES):
        if not len(i):
            break
        a, b = ta[i, at : at + FAMILIES].astype(np.int16), tb[j, at : at + FAMILIES].astype(np.int16)
        near = np.abs(a - b).max(axis=1) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fa[i] ^ fb[j]) <= radius
    return i[near], j[near]


def group_links(fps: np.ndarray, radius: int = RADIUS, block: int = 256) -> list[tuple[int, int]]:
    """Links that join the distinct fingerprints of one key just as all their
    pairs would: each cluster is grown from its least member, and members are
    compared only with what is still outside."""
    links, outside = [], np.sort(fps)
    while len(outside) > 1:
        root, outside = outside[0], outside[1:]
        front = np.array([root], np.uint64)
        table = distance_table(outside)
        while len(front) and len(outside):
            hit = np.zeros(len(outside), bool)
            for a in range(0, len(front), block):
                part = front[a : a + block]
                for b in range(0, len(outside), 4096):
                    _, j = within(part, distance_table(part), outside[b : b + 4096], table[b : b + 4096], radius)
                    hit[b + np.unique(j)] = True
            front, outside, table = outside[hit], outside[~hit], table[~hit]
            links += [(int(x), int(root)) for x in front]
    return links


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) long: links that connect the distinct fingerprints of nodes(fp)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = pivot_keys(fps.view(np.uint64))
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(fps))), pa.array(np.repeat(fps, n))], ["key", "choice", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, choices, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "choice", "fp"))
            parts, owners = [], []
            for c in np.unique(choices):
                own = fps[choices == c]
                found = common.joined(keys[choices == c].view(np.uint64)[:, None], part_keys(own.view(np.uint64), int(c)))
                parts.append(found.ravel())
                owners.append(np.repeat(own, found.shape[1]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "fp"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.sorted_groups(batches, "key"):
            keys, fps = (table.column(c).to_numpy() for c in ("key", "fp"))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            found: list[tuple[int, int]] = []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                found += group_links(fps[a:b].view(np.uint64))
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    keyed = nodes.select("fp").mapInArrow(spread, "key long, choice int, fp long")
    large = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "simhash-hot")
    if not large.isEmpty():
        many = keyed.join(large, "key", "left_semi").select("key", "choice", "fp").mapInArrow(split, "key long, fp long")
        keyed = keyed.join(large, "key", "left_anti").select("key", "fp").unionByName(many)
    dealt = keyed.select("key", "fp").repartition(common.parallelism(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(joined, "u long, v long").distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of each row; (fp, component_id, size, first: the
    component's least row as struct(no_id, doc_id, text_key)) of each fingerprint."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    fps = common.written(fingerprints(rows), "simhash-fps")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = common.written(fps.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = common.components(common.written(links(nodes), "simhash-links"), "simhash-components")
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = common.written(labelled.select("fp", "root", "least", "n"), "simhash-labelled")
    whole = common.written(labelled.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("size")), "simhash-whole")
    answer = labelled.select("fp", "root").join(whole, "root").select("fp", F.col("first.doc_id").alias("component_id"), "size", "first")
    return fps, common.written(answer, "simhash-answer")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp long, component_id (least doc_id reachable by links of RADIUS
    or fewer differing bits), size long (documents of the component).

    Null texts and texts without words have fingerprint 0 and link like any
    other. Rows with the same fingerprint, copies included, are one node and one
    component; a null doc_id takes part but is never a component_id unless all
    of the component are null. Repeated rows are answered once each; an empty
    table gives no rows. Other columns are not read, whatever their names."""
    fps, answer = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return fps.join(answer, "fp").select("doc_id", "fp", "component_id", "size")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs, its columns as they are, without all but one document of each group:
    its least (doc_id, text hash), nulls last. Of a row that is repeated one stays."""
    _, answer = _classes(docs.select("doc_id", "text"))
    first = common.written(answer.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")).distinct(), "simhash-kept")
    return common.chosen_rows(docs, first)
