"""Removal of repeated word windows by level-wise doubling.

Lengths double up to the wanted one: for 35 words, windows of 9, of 18 and of 35
(a last step may be shorter than a doubling). At each level windows are counted
over all documents, and those that occur once at that length end there; the
others, alone, are extended to the next length.

* First level: of all 9-word windows only the least in each 35-word window, its
  anchor, is counted. Equal 35-word windows have equal anchors at equal places,
  so none is lost, and a fourteenth of the positions is shuffled.
* Between: an anchor that repeats is extended to the window of the next length
  that holds it and fits inside: to its right, or where that overruns the 35-word
  window to its left. Only what repeats again goes on.
* Last level: all 35-word windows of an anchor's place form one span. Equal spans
  are found by one hash; every window of a span that occurs twice repeats. Where
  an anchor stands in several different spans (the rims of copied passages), its
  single 35-word windows are compared.

Longer repeats consist of repeated 35-word windows, so no candidate is left to
double when the wanted length is reached. Window hashes double from single words
up. A hit has equal 64-bit hashes at every level, the last two of which are 128
bits together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LEAST = 35, 9
_PLACE = 28  # bits of a position inside a batch
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hashes() -> common.WordHashes:
    return common.worker_state("repeats", lambda: common.WordHashes(seed=5))


def _line(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts in one line, first position of each, words of each)."""
    known = _hashes()
    words = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    return h, np.cumsum(sizes) - sizes, sizes


def levels(n: int, least: int = LEAST) -> list[int]:
    """The lengths that are counted, each at most twice the one before, up to n;
    the first is `least` at most."""
    out = [n]
    while out[0] > least or len(out) < 2 and n > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def spans(texts: list[bytes | None], n: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For each span: text's place, hash of its anchor, hash of the anchor's
    extension below n words (the anchor itself if there is no such level), hash of
    the span, first window's word position in the text, number of windows."""
    steps = levels(n)
    k = steps[0]
    h, first, sizes = _line(texts)
    none = np.zeros(0, np.int64)
    nothing = (none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none)
    if len(h) < n:
        return nothing
    hashed = common.window_hashes(h, steps)
    place = np.arange(len(hashed[k]), dtype=np.uint64)
    least = (hashed[k] >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place
    width, p = n - k + 1, 1
    while 2 * p <= width:
        least = np.minimum(least[: len(least) - p], least[p:])
        p *= 2
    least = np.minimum(least[: len(least) - (width - p)], least[width - p :]) if width > p else least
    at = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(first + sizes, sizes))
    if not len(at):
        return nothing
    doc = np.repeat(np.arange(len(texts)), sizes)[at]
    anchor = (least[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    # The side to which the anchor is extended at each level between, for each window.
    longer, side = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for m in steps[1:-1]:
        right = anchor + m <= at + n
        begin = np.where(right, anchor, anchor + k - m)
        longer = common.joined(longer ^ right.astype(np.uint64), hashed[m][begin])
        side = 2 * side + right
    if len(steps) < 3:
        longer = hashed[k][anchor]
    new = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (side[1:] != side[:-1])
    start = np.flatnonzero(np.concatenate(([True], new)))
    count = np.diff(np.concatenate((start, [len(at)])))
    a, b = at[start], at[start] + count - 1
    span = common.joined(common.joined(hashed[n][a], hashed[n][b]), (count * 4096 + anchor[start] - a).astype(np.uint64))
    return doc[start], hashed[k][anchor[start]], longer[start], span, a - first[doc[start]], count


def _rows(batch: pa.RecordBatch, take: np.ndarray, name: str) -> pa.Array:
    return batch.column(name).take(pa.array(take))


def repeated_ranges(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """row_id, ranges array<struct<a,b>>: the word ranges [a, b) of a row of
    docs(row_id, text) that windows occurring elsewhere cover. Rows without any
    are left out."""
    spark = docs.sparkSession

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, short, anchor, span, at, count = spans(common.binary(batch.column("text")), n)
            signed = [pa.array(x.view(np.int64)) for x in (short, anchor, span)]
            yield pa.RecordBatch.from_arrays([_rows(batch, doc, "row_id"), *signed, pa.array(at * 4096 + count)], ["row_id", "short", "anchor", "span", "place"])

    found = common.written(docs.select("row_id", "text").mapInArrow(first_level, "row_id long, short long, anchor long, span long, place long"), "repeat-spans")
    # What stands once at the first length ends here.
    again = common.written(found.groupBy("short").agg(F.count("*").alias("n")).where("n > 1").select("short"), "repeat-short")
    left = common.written(found.join(again, "short").select("row_id", F.xxhash64("short", "anchor").alias("anchor"), "span", "place"), "repeat-left")
    common.dropped(spark, found)
    common.dropped(spark, again)
    # Of those, what stands once at the lengths between; then what does at n words, or may in part.
    each = left.groupBy("anchor", "span").agg(F.count("*").alias("n"))
    longer = each.groupBy("anchor").agg(F.sum("n").alias("rows"), F.count("*").alias("spans")).where("rows > 1").select("anchor", (F.col("spans") > 1).alias("mixed"))
    state = each.join(longer, "anchor").select("anchor", "span", (F.col("n") > 1).alias("whole"), "mixed")
    state = common.written(state, "repeat-state")
    hits = common.written(left.join(state, ["anchor", "span"]).select("row_id", "anchor", "span", "place", "whole", "mixed"), "repeat-hits")
    common.dropped(spark, left)
    common.dropped(spark, state)

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = common.binary(batch.column("text")), batch.column("spans").to_pylist()
            h, first, sizes = _line(texts)
            if len(h) < n:
                continue
            hashed = common.window_hashes(h, [n])[n]
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in asked])
            place = np.array([x["place"] for xs in asked for x in xs], np.int64)
            anchor = np.array([x["anchor"] for xs in asked for x in xs], np.int64)
            at, count = place // 4096, place % 4096
            each = np.repeat(np.arange(len(at)), count)
            word = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([_rows(batch, doc[each], "row_id"), pa.array(anchor[each]), pa.array(hashed[first[doc[each]] + word].view(np.int64)), pa.array(word)], ["row_id", "anchor", "hash", "word"])

    # All windows of a repeated span repeat; one copy of it witnesses for the others that share some of them.
    witness = hits.where("mixed and whole").groupBy("anchor", "span").agg(F.min(F.struct("row_id", "place")).alias("one")).select("one.row_id", "anchor", "one.place")
    rims = hits.where("mixed and not whole").select("row_id", "anchor", "place").unionByName(witness)
    rims = rims.groupBy("row_id").agg(F.collect_set(F.struct("anchor", "place")).alias("spans"))
    windows = common.written(docs.select("row_id", "text").join(rims.hint("shuffle_hash"), "row_id").mapInArrow(second_level, "row_id long, anchor long, hash long, word long"), "repeat-windows")
    # Written, so that both sides of the join are plain shuffles, which adaptive execution can split at a hot window.
    twice = common.written(windows.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash"), "repeat-twice")
    single = windows.join(twice, ["anchor", "hash"]).select("row_id", F.struct(F.col("word").alias("a"), (F.col("word") + n).alias("b")).alias("r"))
    at, count = F.expr("place div 4096"), F.col("place") % 4096
    full = hits.where("whole").select("row_id", F.struct(at.alias("a"), (at + count - 1 + n).alias("b")).alias("r"))
    ranges = common.written(full.unionByName(single).groupBy("row_id").agg(F.collect_set("r").alias("ranges")), "repeat-ranges")
    common.dropped(spark, hits)
    common.dropped(spark, windows)
    common.dropped(spark, twice)
    return ranges


def remove_repeats(docs: DataFrame, n: int = WINDOW, text: str = "text", join: str = "space") -> DataFrame:
    """docs with repeated windows of n words cut out of the text, plus n_words
    and n_removed. Every occurrence goes, the first too.

    join="space": the kept words, joined by one space. join="source": the text
    as it was but for the removed words, with a line break where a cut joins two
    kept passages. A null text has no words (kept text empty, for "source" null);
    texts of under n words lose none; repeated rows count as places of their own;
    an empty table gives no rows. A column of docs that is named n_words or
    n_removed is replaced; other names don't matter."""
    spark = docs.sparkSession
    common.prepare(spark)
    columns = common.without(docs, ["n_words", "n_removed"])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    body = f"c{columns.index(text)}"
    rows = rows.withColumn("row_id", F.xxhash64(*rows.columns))
    names = rows.columns[:-1]
    ranges = repeated_ranges(rows.select("row_id", F.col(body).alias("text")), n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for t, found in zip(common.binary(batch.column(body)), batch.column("ranges").to_pylist()):
                words = (t or b"").split()
                keep = None
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["a"] for r in found], 1)
                    np.add.at(edge, [r["b"] for r in found], -1)
                    keep = np.cumsum(edge)[:-1] == 0
                total.append(len(words))
                gone.append(0 if keep is None else int((~keep).sum()))
                if join == "source":
                    kept.append(t if keep is None else _passages(t, keep))
                else:
                    kept.append(b" ".join(words if keep is None else compress(words, keep.tolist())))
            out = [pa.array(kept, pa.binary()).cast(pa.string()) if c == body else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "row_id")
    done = rows.join(ranges.hint("shuffle_hash"), "row_id", "left").mapInArrow(cut, f"{kinds}, n_words long, n_removed long")
    return done.toDF(*columns, "n_words", "n_removed")


def _passages(text: bytes, keep: np.ndarray) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    places = [m.span() for m in _WORD.finditer(text)]
    return b"\n".join(text[places[a][0] : places[b - 1][1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
