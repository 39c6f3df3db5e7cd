"""Token ids in a binary file format: canonical, length-limited Huffman codes.

The ids of all documents are counted; code lengths of at most LIMIT bits come
from those counts by package-merge, codes from the lengths alone (canonical). A
segment holds consecutive documents in doc_id order as one bit stream. After
every BLOCK ids the writer notes the bit offset, so blocks decode independently:
the reader advances all blocks of a segment in step, one table look-up of LIMIT
bits for an id.

The files are Parquet rows of segments (committed by Spark, so a lost executor
leaves no half-written file): `head` fields plus `bits` with the stream and
`checkpoints` with the offsets. Code lengths are a file beside them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LIMIT, BLOCK, SEGMENT_IDS, END_ID = 16, 512, 1 << 20, 0
CHUNKS_KEPT = 500_000
_STOPS = ",.!?;:"


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge. One id
    alone gets one bit. ValueError if 2**limit codes are too few."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit codes of {limit} bits")
    if len(ids) < 2:
        return {i: 1 for i in ids}
    n = len(ids)
    weight = np.array([counts[i] for i in ids], np.float64)
    # Each level keeps, for its sorted items, which are packages; the items of the last level tell how often each id was used.
    levels: list[np.ndarray] = []
    items = weight
    for _ in range(limit - 1):
        m = len(items) // 2
        packages = items[: 2 * m : 2] + items[1 : 2 * m : 2]
        both = np.concatenate((weight, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order >= n)
        items = both[order]
    lengths = np.zeros(n, np.int64)
    taken = 2 * n - 2
    for packaged in reversed(levels):
        used = packaged[:taken]
        lengths[: int((~used).sum())] += 1
        taken = 2 * int(used.sum())
    lengths[:taken] += 1
    return dict(zip(ids, lengths.tolist()))


def canonical(lengths: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code by id, length by id, id by table slot, length by table slot); codes
    ascend by (length, id), and a slot is the next `limit` bits of a stream."""
    size = max(lengths, default=0) + 1
    codes, bits = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
    slot_id, slot_bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    code = last = 0
    for i in sorted(lengths, key=lambda i: (lengths[i], i)):
        code <<= lengths[i] - last
        last = lengths[i]
        codes[i], bits[i] = code, last
        slot_id[code << (limit - last) : (code + 1) << (limit - last)] = i
        slot_bits[code << (limit - last) : (code + 1) << (limit - last)] = last
        code += 1
    return codes, bits, slot_id, slot_bits


def encode(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(stream, bit offset of each block's first id)."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    length = bits[ids].astype(np.int64)
    ends = np.cumsum(length)
    starts = ends - length
    words = np.zeros(int(ends[-1] + 31) // 32 + 2, np.uint64)
    value = codes[ids] << (64 - (starts & 31) - length).astype(np.uint64)  # within two 32-bit words
    at = starts >> 5
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::block].astype(np.uint64)


def decode(stream: bytes, checkpoints: np.ndarray, n: int, slot_id: np.ndarray, slot_bits: np.ndarray, block: int = BLOCK, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a stream, all blocks in step."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(stream + b"\0" * 8, np.uint8)
    ahead = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    mask, tail = (1 << limit) - 1, n - (len(at) - 1) * block
    last = len(ahead) - 1
    for step in range(block):
        slot = (ahead[np.minimum(at >> 3, last)] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32(mask)
        out[step] = slot_id[slot]
        at += slot_bits[slot]
        if step + 1 == tail:
            at[-1] = checkpoints[-1]  # the last block is done; what it reads on is cut off below
    return out.T.ravel()[:n]


def _tokenizer(path: str) -> dict:
    """The worker's tokenizer, its ids' byte lengths and the chunks known."""

    def make() -> dict:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        # A byte-level token has one character for each byte.
        width = np.zeros(tok.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        for token, i in tok.get_vocab(with_added_tokens=True).items():
            width[i] = len(token)
        stops = {c: np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in _STOPS}
        return {"tok": tok, "width": width, "added": [x.content for x in tok.get_added_tokens_decoder().values()], "chunks": common.Known(CHUNKS_KEPT), "stops": stops}

    return common.worker_state(f"token store {path}", make)


def byte_level_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian uint32 ids of each text, as the tokenizers library's
    encode(text, add_special_tokens=False) gives them for a byte-level
    vocabulary without a normalizer.

    A text is cut before each space. Its pieces never cross such a cut if the
    chunks have no white space at their ends, so a chunk's ids hold wherever it
    occurs: the library encodes each new chunk once, many in one call. Texts with
    other white space around a space, or with an added token's name, go to the
    library whole."""
    state = _tokenizer(path)
    tok, width, added, known = state["tok"], state["width"], state["added"], state["chunks"]
    known.turn()
    cut = [t.split(" ") for t in texts]
    missing = known.unknown(set().union(*cut))
    odd = {c for c in missing if c.strip() != c or not c}
    # A letter run and the stop after it are pieces of their own.
    tailed = [c for c in missing - odd if c[-1] in _STOPS and c[:-1].isalpha()]
    new = list(known.unknown((missing - odd).difference(tailed).union([c[:-1] for c in tailed])))
    for at in range(0, len(new), 2000):
        part = new[at : at + 2000]
        ids = np.array(tok.encode_batch_fast(["".join([" " + c for c in part])], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(c.encode()) + 1 for c in part])
        cuts = np.searchsorted(np.cumsum(width[ids]), ends, side="left") + 1
        raw, a = ids.astype("<u4").tobytes(), 0
        for c, b in zip(part, (4 * cuts).tolist()):
            known.new[c] = raw[a:b]
            a = b
    stops = state["stops"]
    known.new.update([(c, known.new[c[:-1]] + stops[c[-1]]) for c in tailed])
    whole = [not c[0] or c[0][-1].isspace() or any(a in t for a in added) or not odd.isdisjoint(c[1:]) for t, c in zip(texts, cut)]
    firsts = iter(tok.encode_batch_fast([c[0] for c, w in zip(cut, whole) if not w], add_special_tokens=False))
    rest = iter(tok.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
    get = known.new.__getitem__
    return [np.array(next(rest).ids, "<u4").tobytes() if w else np.array(next(firsts).ids, "<u4").tobytes() + b"".join(map(get, c[1:])) for c, w in zip(cut, whole)]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, seq, doc_ids, n_tokens and ids (uint16 or uint32 bytes, by `wide`)
    of segments: runs of documents in ascending doc_id order inside each part,
    parts in ascending order. Nulls are first; equal doc_ids by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, doc_ids, sizes, held, n = None, 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            wide = bool(len(ids) and ids.max() >= 1 << 16)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "doc_ids": doc_ids, "n_tokens": sizes, "wide": wide, "ids": ids.astype("<u4" if wide else "<u2").tobytes()}], schema=schema)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            part = batch.column("part")[0].as_py() if part is None else part
            with common.uncollected():
                coded = byte_level_ids(texts, path)
            for d, ids in zip(batch.column("doc_id").to_pylist(), coded):
                doc_ids.append(d)
                sizes.append(len(ids) // 4 + 1)
                held += [ids, end]
                n += sizes[-1]
                if n >= SEGMENT_IDS:
                    yield segment()
                    seq, doc_ids, sizes, held, n = seq + 1, [], [], [], 0
        if doc_ids:
            yield segment()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("wide", pa.bool_()), ("ids", pa.binary())])
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = rows.repartitionByRange(common.parallelism(spark), *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return placed.mapInArrow(run, "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, wide boolean, ids binary")


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of docs(doc_id, text) under path: `lengths` and `segments`."""
    spark = docs.sparkSession
    common.prepare(spark)
    segments = common.written(tokenized(docs, tokenizer, end_id), "token-segments")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                got = np.bincount(_ids(row), minlength=len(total))
                got[: len(total)] += total
                total = got
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live], pa.int64())], ["id", "n"])

    # As many rows as the vocabulary has ids.
    counts = {r["id"]: r["n"] for r in segments.select("wide", "ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    shared = spark.sparkContext.broadcast(canonical(lengths)[:2])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = _ids(row)
                stream, at = encode(ids, codes, bits)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("part", "seq", "doc_ids", "n_tokens")} | {"n_ids": len(ids), "checkpoints": at.astype("<u8").tobytes(), "bits": stream}], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("checkpoints", pa.binary()), ("bits", pa.binary())])
    packed = segments.mapInArrow(pack, "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, checkpoints binary, bits binary")
    packed.write.option("compression", "none").parquet(f"{path}/segments")
    common.dropped(spark, segments)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) token_ids from the files."""
    common.prepare(spark)
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/lengths").collect()}  # the vocabulary at most
    shared = spark.sparkContext.broadcast(canonical(lengths)[2:])
    segments = spark.read.parquet(f"{path}/segments")
    sums = segments.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_id, slot_bits = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), row["n_ids"], slot_id, slot_bits).astype("<u4")
                ends = np.cumsum(row["n_tokens"])
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                n = len(ends)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.concatenate(([0], ends[:-1])), pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32", *["token_ids"] * with_ids]
    rows = segments.mapInArrow(unpack, "part int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids)
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)


def stored(docs: DataFrame, tokenizer: str, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write docs' ids and read them back from the files: a row per document.

    Null and empty texts hold the end id alone; repeated rows are stored once
    each; an empty table makes empty files and no rows."""
    spark = docs.sparkSession
    path = path or common.shared_path(spark, "token-store")
    write_store(docs, path, tokenizer)
    return read_store(spark, path, with_ids)
