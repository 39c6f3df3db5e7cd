"""Near duplicates by the Jaccard similarity of five-word shingle sets, links
followed transitively.

Equal sets are one node. Each has the SimHash of its shingles; fingerprints within
the radius of simhash_dedup are found by its pivot distance tables, and such links
are verified first. Two sets at the similarity may differ in more bits than that,
so further candidates share one of BANDS keys of ROWS minhashes each: a pair at the similarity asked for misses all of them with probability
(1 - 0.8**4)**40, 7e-10, a closer one with less. What the signatures estimate
only chooses and discards (a pair at 0.8 is below DOUBT with probability under
1e-15); every link is verified on the sets themselves.

Nodes that share a key are compared in two rounds, so that a large group of
near copies costs rows in proportion to its size: first a tree of likely pairs
in each group; then the sets of the nodes that may reach the similarity with one
that the first round's links have not joined to them come together by group and
are verified there. No round makes a row for each pair; a pair is looked at in
the group of the first key that it shares, and a group's task gives a link only
where it joins two clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash_dedup

WORDS, SIMILARITY, BANDS, ROWS, SEED, DOUBT = 5, 0.8, 40, 4, 42, 0.5
#: Sets that come together in one task; larger groups are verified in cells of two such parts.
CELL = 4096
_FACTORS = np.random.default_rng(20240819).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; a shorter text
    is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    known = common.worker_state("shingles", lambda: common.WordHashes(seed=SEED))
    return np.unique(common.window_hashes(np.fromiter((known[w] for w in found), np.uint64, len(found)), [WORDS])[WORDS])


def minhashes(found: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, (found[at : at + 4096, None] * _FACTORS[None, :]).min(axis=0))
    return out


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        part = np.ascontiguousarray(found[at : at + 65_536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (hash of the set), fp (its SimHash), size, signature (a
    byte of each minhash) and band keys of docs(doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, signatures, keys = [], [], [], [], []
            for text in common.binary(batch.column("text")):
                found = shingles(text)
                least = common.mix(minhashes(found))
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for column in least.reshape(BANDS, ROWS).T:
                    band = common.joined(band, column)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                fps.append(fingerprint(found))
                sizes.append(len(found))
                signatures.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "fp", "size", "signature", "keys"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, node long, fp long, size int, signature binary, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole runs with start and end of each run of two rows or more."""
    for table in common.sorted_groups(batches, key):
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        many = ends - starts > 1
        if many.any():
            yield table, starts[many], ends[many]


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(common.parallelism(df.sparkSession), key).sortWithinPartitions(key)


def members(nodes: DataFrame) -> DataFrame:
    """(gid, node, band): the groups of nodes that share a band key, with the
    first such band; keys shared by the same nodes are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _runs(batches, "key"):
            fps, bands = table.column("node").to_numpy(), table.column("band").to_numpy()
            groups: dict[int, tuple[np.ndarray, int]] = {}
            for a, b in zip(starts, ends):
                own = np.sort(fps[a:b])
                gid = xxhash.xxh64_intdigest(own.tobytes())
                groups[gid] = (own, min(int(bands[a]), groups.get(gid, (own, BANDS))[1]))
            sizes = [len(g) for g, _ in groups.values()]
            gids, first = np.repeat(np.array(list(groups), np.uint64).view(np.int64), sizes), np.repeat(np.array([b for _, b in groups.values()], np.int32), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(gids), pa.array(np.concatenate([g for g, _ in groups.values()])), pa.array(first)], ["gid", "node", "band"])

    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("key", "node", "band")
    return _dealt(keyed, "key").mapInArrow(run, "gid long, node long, band int").groupBy("gid", "node").agg(F.min("band").alias("band"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of minhashes that agree, rows of a by rows of b."""
    out = np.empty((len(a), len(b)), np.float32)
    for at in range(0, len(b), 1024):
        out[:, at : at + 1024] = (a[:, None, :] == b[None, at : at + 1024, :]).mean(axis=2, dtype=np.float32)
    return out


def likely_tree(signatures: np.ndarray, block: int = 32) -> list[tuple[int, int]]:
    """Pairs estimated at the similarity that join the group as all such would:
    each cluster grows from its first member, a link for each that joins."""
    links, outside = [], np.arange(len(signatures))
    while len(outside) > 1:
        front, outside = outside[:1], outside[1:]
        while len(front) and len(outside):
            grown = []
            for at in range(0, len(front), block):
                if not len(outside):
                    break
                part = front[at : at + block]
                near = _agree(signatures[part], signatures[outside])
                hit = near.max(axis=0) >= SIMILARITY
                links += zip(part[near.argmax(axis=0)[hit]].tolist(), outside[hit].tolist())
                grown.append(outside[hit])
                outside = outside[~hit]
            front = np.concatenate(grown)
    return links


def open_pairs(signatures: np.ndarray, sizes: np.ndarray, roots: np.ndarray, band: int, block: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of different roots that may reach the similarity and whose first
    common band is this one, a block of rows at a time."""
    for at in range(0, len(roots), block):
        part, rest = signatures[at : at + block], signatures[at:]
        may = _agree(part, rest) >= DOUBT
        may &= roots[at : at + block, None] != roots[None, at:]
        small, large = np.minimum(sizes[at : at + block, None], sizes[None, at:]), np.maximum(sizes[at : at + block, None], sizes[None, at:])
        i, j = np.nonzero(np.triu(may & (small >= SIMILARITY * large - 1e-9), 1))
        if band and len(i):
            before = (part[i, : band * ROWS] == rest[j, : band * ROWS]).reshape(len(i), band, ROWS).all(axis=2).any(axis=1)
            i, j = i[~before], j[~before]
        if len(i):
            yield i + at, j + at


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, signatures, sizes, roots) of each group of several roots."""
    for table, starts, ends in _runs(batches, key):
        sizes, roots = (table.column(c).to_numpy() for c in ("size", "root"))
        packed = table.column("signature").to_pylist()
        for a, b in zip(starts, ends):
            if len(np.unique(roots[a:b])) > 1:
                yield table.slice(a, b - a), np.frombuffer(b"".join(packed[a:b]), np.uint8).reshape(b - a, -1), sizes[a:b], roots[a:b]


def likely(groups: DataFrame) -> DataFrame:
    """(u, v): a tree of likely pairs of each of groups(gid, node, band, size,
    signature, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, signatures, _, _ in _groups(batches, "gid"):
            found = np.array(likely_tree(signatures), np.int64).reshape(-1, 2)
            u, v = (rows.column("node").to_numpy()[found[:, k]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return _dealt(groups, "gid").mapInArrow(run, "u long, v long").distinct()


def doubtful(groups: DataFrame) -> DataFrame:
    """The rows of groups that have an open pair there, and the cell of it: parts
    of CELL rows meet two by two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, signatures, sizes, roots in _groups(batches, "gid"):
            hit = np.zeros(len(roots), bool)
            for i, j in open_pairs(signatures, sizes, roots, rows.column("band")[0].as_py()):
                hit[i] = hit[j] = True
            own = np.flatnonzero(hit)
            parts = -(-len(own) // CELL)
            at = np.arange(len(own)) // CELL
            for a in range(parts):
                for b in range(a, parts):
                    some = rows.take(pa.array(own[(at == a) | (at == b)]))
                    cell = xxhash.xxh64_intdigest(np.array([rows.column("gid")[0].as_py(), a, b], np.int64).tobytes()) >> 1
                    for batch in some.select(["node", "band", "size", "signature", "root"]).combine_chunks().to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, cell, np.int64)), *batch.columns], ["cell", "node", "band", "size", "signature", "root"])

    return _dealt(groups.select("gid", "node", "band", "size", "signature", "root"), "gid").mapInArrow(run, "cell long, node long, band int, size int, signature binary, root long")


def joining(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between clusters of cells whose sets(node, found) reach the
    similarity; where two clusters are joined already no more are looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, signatures, sizes, roots in _groups(batches, "cell"):
            nodes, packed = rows.column("node").to_numpy(), rows.column("found")
            found = [np.frombuffer(x.as_py(), np.uint64) for x in packed]
            label, links = np.unique(roots, return_inverse=True)[1], []
            for i, j in open_pairs(signatures, sizes, roots, rows.column("band")[0].as_py()):
                for a, b in zip(i.tolist(), j.tolist()):
                    if label[a] != label[b] and similarity(found[a], found[b]) >= SIMILARITY - 1e-12:
                        label[label == label[b]] = label[a]
                        links.append((a, b))
            if links:
                u, v = (nodes[[x[k] for x in links]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return _dealt(cells.join(sets, "node"), "cell").mapInArrow(run, "u long, v long").distinct()


def near_by_bits(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes(node, fp) that join all whose fingerprints are equal or
    within the radius, by simhash_dedup's pivot distance tables."""
    heads = common.written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "shingle-heads")
    of = lambda c: heads.select(F.col("fp").alias(f"_{c}"), F.col("head").alias(c))
    near = simhash_dedup.links(heads.select("fp")).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    far = near.join(of("u"), "_u").join(of("v"), "_v").select("u", "v")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    return far.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets(node, found) reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY - 1e-12 for x, y in zip(a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, found binary) of wanted(node, id, key): the set of that row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t).tobytes() for t in common.binary(batch.column("text"))], pa.binary())], ["node", "found"])

    hit = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["text_key"] == wanted["key"]))
    return hit.select("node", "text").mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def components(docs: DataFrame) -> DataFrame:
    """node, root, least: struct(no_id, doc_id, text_key) of each distinct set of
    docs(doc_id, text_key, text); nodes of one root are near duplicates."""
    common.prepare(docs.sparkSession)
    rows = common.written(prints(docs), "shingle-rows")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    same = F.struct("fp", "size", "signature", "keys")
    nodes = rows.groupBy("node").agg(F.min(row).alias("least"), F.first(same).alias("same")).select("node", "least", "same.*")
    nodes = common.written(nodes, "shingle-nodes")
    common.dropped(nodes.sparkSession, rows)
    groups = common.written(members(nodes), "shingle-groups")
    bits = common.written(near_by_bits(nodes.select("node", "fp")), "shingle-bits")
    busy = groups.select("node").unionByName(bits.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = nodes.join(busy, "node", "left_semi").select("node", F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key"))
    sets = common.written(_sets(docs, wanted), "shingle-sets")
    known = groups.join(nodes.select("node", "size", "signature"), "node")
    pairs = bits.unionByName(likely(known.withColumn("root", F.col("node")))).distinct()
    first = common.written(verified(pairs, sets), "shingle-links")
    roots = common.components(first, "shingle-components")
    known = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = common.written(doubtful(known), "shingle-cells")
    rest = common.written(joining(cells, sets), "shingle-links")
    if not rest.isEmpty():
        roots = common.components(first.unionByName(rest), "shingle-components")
    common.dropped(nodes.sparkSession, sets)
    return nodes.select("node", "least").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs, its columns as they are, without all but one document of each group
    of near duplicates: its least (doc_id, text hash), nulls last. Null texts and
    texts without words are one group; of a row that is repeated one stays; an
    empty table gives no rows."""
    found = components(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"))
    first = common.written(found.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")), "shingle-kept")
    return common.chosen_rows(docs, first)
