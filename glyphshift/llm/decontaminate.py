"""Benchmark decontamination: BM25 over test items with block-max WAND.

Roles are turned round: the items are the indexed documents, each passage of a
training text is a query. What is retrieved is verified: a passage holds an item
if it holds enough of the question's five-word shingles and, in the same passage,
enough of the answer's word pairs. An item's BM25 weights are divided by the score
that any passage which verification accepts is sure to reach, so one threshold, 1,
retrieves every such item. A passage whose words can't reach it under any item is
passed over at once; the others run block-max WAND.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a shingle, and the share of them that must be held, for a question and for an answer.
SHINGLE, QUESTION, ANSWER_SHINGLE, ANSWER = 5, 0.8, 2, 0.6
K1, B, POSTINGS, BLOCKS = 1.2, 0.75, 16, 64
SEGMENT_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of n words; of fewer words, all of them."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def question_answer(text: str) -> tuple[str, str]:
    """An item's parts: its last sentence is the answer, if it has several."""
    parts = _SENTENCE.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class ItemIndex:
    """Items of like length: postings in blocks with their largest weights."""

    def __init__(self, items: list[tuple[int, str, str]], counts: Counter, n_items: int, mean: float) -> None:
        """items: (id, question, answer). counts: items holding each word, of all n_items."""
        self.items = []
        postings: dict[str, list[tuple[int, float]]] = {}
        self.longest = 0
        for item_id, question, answer in items:
            q, a = words_of(question), words_of(answer)
            words = q + a
            if not words:
                continue
            asked, said = shingles(q), shingles(a, ANSWER_SHINGLE)
            self.longest = max(self.longest, len(words))
            place = len(self.items)
            self.items.append((item_id, shingles(words), asked, said))
            weight = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (n_items - counts[w] + 0.5) / (counts[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            # A word that a passage lacks spoils one shingle at least.
            lacking = sum(len(g) - math.ceil(share * len(g) - 1e-9) for g, share in ((asked, QUESTION), (said, ANSWER)))
            sure = sum(sorted(weight.values())[: max(0, len(weight) - lacking)])
            for w, x in weight.items():
                postings.setdefault(w, []).append((place, x / sure * (1 + 1e-9) if sure > 0 else 1.0))
        self.lists = {}
        for w, found in postings.items():
            ids, xs = [p for p, _ in found], [x for _, x in found]
            self.lists[w] = (ids, xs, [max(xs[i : i + POSTINGS]) for i in range(0, len(xs), POSTINGS)], max(xs))
        self.places = {w: n for n, w in enumerate(self.lists)}
        wide = max(1, -(-len(self.items) // BLOCKS))
        self.maxima = np.zeros((len(self.lists), -(-len(self.items) // wide) or 1), np.float32)
        for n, (ids, xs, _, _) in enumerate(self.lists.values()):
            np.maximum.at(self.maxima[n], np.array(ids) // wide, np.array(xs, np.float32))

    def retrieve(self, words: set[str]) -> list[tuple[int, float]]:
        """(place, score) of all items that reach 1, by block-max WAND."""
        live = [[0, *self.lists[w]] for w in words if w in self.lists]  # position, ids, weights, block maxima, maximum
        out = []
        while live:
            live.sort(key=lambda x: x[1][x[0]])
            total, pivot = 0.0, -1
            for n, x in enumerate(live):
                total += x[4]
                if total >= 1:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = live[pivot][1][live[pivot][0]]
            while pivot + 1 < len(live) and live[pivot + 1][1][live[pivot + 1][0]] == item:
                pivot += 1
            # The blocks that hold the pivot item, or would.
            blocks, until = 0.0, math.inf
            for x in live[: pivot + 1]:
                ids, b = x[1], x[0] // POSTINGS
                while b < len(x[3]) and ids[min(len(ids), (b + 1) * POSTINGS) - 1] < item:
                    b += 1
                if b < len(x[3]):
                    blocks += x[3][b]
                    until = min(until, ids[min(len(ids), (b + 1) * POSTINGS) - 1] + 1)
            if blocks < 1:
                after = live[pivot + 1][1][live[pivot + 1][0]] if pivot + 1 < len(live) else math.inf
                target = max(item + 1, min(until, after))
            elif live[0][1][live[0][0]] == item:
                score = sum(x[2][x[0]] for x in live[: pivot + 1])
                if score >= 1:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            for x in live[: pivot + 1]:
                ids, p = x[1], x[0]
                while p < len(ids) and ids[p] < target:
                    p += 1
                x[0] = p
            live = [x for x in live if x[0] < len(x[1])]
        return out

    def screen(self, texts: list[list[str]]) -> list[list[int]]:
        """First words of the passages of each text that could reach 1: the block
        maxima of a passage's distinct words, summed for every block of items.

        A passage is two stretches of the longest item's words and the next one
        starts a stretch later, so any run as long as an item lies in one whole."""
        out: list[list[int]] = [[] for _ in texts]
        stretch, vocab = self.longest, len(self.places)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not self.items or not sizes.sum():
            return out
        get = self.places.get
        ids = np.fromiter((get(w, vocab) for ws in texts for w in ws), np.int64, int(sizes.sum()))
        parts = -(-sizes // stretch)
        first = np.cumsum(parts) - parts
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        live = np.flatnonzero(ids < vocab)
        met = np.unique((first[doc[live]] + place[live] // stretch) * vocab + ids[live])
        if not len(met):
            return out
        part, word = met // vocab, met % vocab
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.zeros((int(parts.sum()) + 1, self.maxima.shape[1]), np.float32)
        sums[part[starts]] = np.add.reduceat(self.maxima[word], starts, axis=0)
        owner = np.repeat(np.arange(len(texts)), parts)
        both = sums[:-1].copy()
        both[:-1][owner[1:] == owner[:-1]] += sums[1:-1][owner[1:] == owner[:-1]]
        for p in np.flatnonzero(both.max(axis=1) >= 1 - 1e-4).tolist():
            d = int(owner[p])
            out[d].append((p - int(first[d])) * stretch)
        return out

    def matches(self, words: list[str], starts: list[int]) -> dict[int, tuple[float, float, float, float, int]]:
        """item id -> (score, overlap of the whole, question's, answer's, first
        word of the passage) of the best of the screened passages of a text."""
        found: dict[int, tuple] = {}
        size = 2 * self.longest
        for a in starts:
            passage = words[a : a + size]
            held: dict[int, set] = {}
            for place, score in self.retrieve(set(passage)):
                item_id, whole, asked, said = self.items[place]
                question, answer = _share(asked, passage, held), _share(said, passage, held)
                if question >= QUESTION - 1e-9 and answer >= ANSWER - 1e-9:
                    got = (score, _share(whole, passage, held), question, answer, a)
                    if item_id not in found or got[:2] > found[item_id][:2]:
                        found[item_id] = got
        return found


def _share(wanted: set[tuple[str, ...]], words: list[str], held: dict[int, set]) -> float:
    """Share of the shingles that the words hold; of none, all. held keeps the
    words' own shingles by length."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    if n not in held:
        held[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & held[n]) / len(wanted)


def _word_counts(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """(word, n) over all items of rows(id, t, a), the number of items that say
    anything and their mean length in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(f"{t} {a}") for t, a in zip(batch.column("t").to_pylist(), batch.column("a").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["size", "words"])

    said = rows.select("t", "a").mapInArrow(run, "size long, words array<string>").where("size > 0")
    n, mean = said.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(1.0))).first()
    return said.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), n, mean


def index_segments(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[list[ItemIndex]]:
    """Indexes of segments of items whose texts take about segment_bytes each;
    in a segment, one index for each range of lengths. Word counts and the mean
    length are those of all items, so scores don't depend on the segments; the
    driver holds one segment and the counts of its words at a time."""
    body = F.coalesce(F.col(text), F.lit(""))
    after = F.coalesce(F.col(answer), F.lit("")) if answer else F.lit("")
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), body.alias("t"), after.alias("a")).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("a")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / segment_bytes))
    known, n_items, mean = _word_counts(rows)
    known = common.written(known, "item-words") if parts > 1 else known
    for part in range(parts):
        got = [(r["id"], *((r["t"], r["a"]) if answer else question_answer(r["t"]))) for r in rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).orderBy("id", "t").collect()]
        sized = [(len(words_of(q)) + len(words_of(a)), (i, q, a)) for i, q, a in got]
        sized = [x for x in sized if x[0]]
        words = {w for _, (_, q, a) in sized for w in words_of(f"{q} {a}")}
        some = known
        if parts > 1:
            some = known.join(items.sparkSession.createDataFrame([(w,) for w in words], "word string"), "word", "left_semi")
        counts = Counter({r["word"]: r["n"] for r in some.collect()})
        ranges: dict[int, list] = {}
        for n, x in sized:
            ranges.setdefault(max(0, math.ceil(math.log(n / 64, 4))) if n > 64 else 0, []).append(x)
        yield [ItemIndex(x, counts, n_items, mean) for _, x in sorted(ranges.items())]


def _found(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """contaminated() of docs(doc_id, text_key, text), with text_key."""
    spark = docs.sparkSession
    common.prepare(spark)
    names = ["doc_id", "text_key", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "at_word"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    out = None
    for indexes in index_segments(items, **options):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = list(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist())), [words_of(t) for t in batch.column("text").to_pylist()]
                best: list[dict] = [{} for _ in texts]
                for index in shared.value:
                    for words, starts, own in zip(texts, index.screen(texts), best):
                        for i, got in index.matches(words, starts).items() if starts else ():
                            own[i] = max(own.get(i, got), got)
                rows = [(*d, i, *got) for d, own in zip(ids, best) for i, got in sorted(own.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        part = docs.mapInArrow(run, "doc_id long, text_key long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, at_word long")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap,
    at_word: a row for each item that a document holds, QUESTION or more of the
    question's shingles and ANSWER or more of the answer's in one passage of
    however long a text; other documents have none. An item without an answer of
    its own (one sentence) is judged by the question alone; a question without
    its answer is no match.

    Null and empty texts or items match nothing; items without an id take no
    part; items that repeat an id are one item of that id; repeated documents
    are answered once each, a null doc_id too; an empty table on either side
    gives no rows. Other columns are not read, whatever their names."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return _found(rows, items, **options).drop("text_key")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, its columns as they are, without the rows whose text holds an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    bad = common.written(_found(rows, items).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "leaks")
    own, pairs = common.set_aside(docs, ["_id", "_key"])
    return common.given_back(own.join(bad, own["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(own["text"]) == F.col("_key")), "left_anti"), pairs)
