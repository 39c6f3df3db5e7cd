"""Dictionary matches in texts and the decision between overlapping ones."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workers

WINDOW = 64  # characters that are looked at together; a substring of a short text is cheap
LIMIT = 24  # candidates of an overlap component beyond which it stays unresolved
AMBIGUOUS = frozenset({"ambiguous_lexical_boundary", "ambiguous_lexical_identity", "ambiguous_morphology"})


def substring_matches(docs: DataFrame, keys: DataFrame, key: str = "key", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, end (0-based, end exclusive, code points) and the columns
    of keys, for every occurrence of every key.

    Only places whose first two characters some key begins with are looked at
    (the rest of a shorter key is empty), and there only the lengths that such
    keys have; the rest is an equi join. keys is a rule table: it's broadcast if
    Spark finds it small and shuffled otherwise."""
    known = keys.where(F.length(key) > 0)
    heads = known.select(F.substring(key, 1, 2).alias("_h"), F.length(key).alias("_n")).distinct()
    told = heads.agg(F.max("_n"), F.array_sort(F.collect_set("_h"))).first()
    longest, prefixes = told[0] or 1, told[1] or []
    sizes = sorted({min(2, len(h)) for h in prefixes}) or [1]
    text_at = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if text_at.rdd.getNumPartitions() < cores:  # a small table in few files would keep most cores idle
        text_at = text_at.repartition(cores)
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / WINDOW).cast("int")))
    cut = text_at.select("doc_id", "_t", piece.alias("_w")).select("doc_id", (F.col("_w") * WINDOW).alias("_at"), F.substring("_t", F.col("_w") * WINDOW + 1, F.lit(WINDOW + longest - 1)).alias("_p"))
    upto = F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("_p")))

    def places(n: int) -> Column:
        head = lambda i: F.substring("_p", i, F.lit(n))
        return F.transform(F.filter(upto, lambda i: head(i).isin([h for h in prefixes if len(h) == n])), lambda i: F.struct(i.alias("i"), head(i).alias("h")))

    starts = [places(n) for n in sizes]
    each = cut.select("doc_id", "_at", "_p", F.explode(F.concat(*starts)).alias("_x")).select("doc_id", "_at", "_p", F.col("_x.i").alias("_i"), F.col("_x.h").alias("_h"))
    spans = each.join(heads, "_h").select("doc_id", (F.col("_at") + F.col("_i") - 1).alias("start"), "_n", F.substring("_p", F.col("_i"), F.col("_n")).alias(key))
    spans = spans.where(F.length(key) == F.col("_n")).select("doc_id", "start", (F.col("start") + F.col("_n")).alias("end"), key)
    return spans.join(known, key)


def best_at(matches: DataFrame, priority: Column, order: Column) -> DataFrame:
    """One match for each place: highest priority, then the longest, then the
    least order."""
    rest = [c for c in matches.columns if c not in ("doc_id", "start")]
    best = F.min_by(F.struct(*rest), F.struct((-priority).alias("p"), (-F.col("end")).alias("e"), order.alias("o")))
    return matches.groupBy("doc_id", "start").agg(best.alias("b")).select("doc_id", "start", *[F.col(f"b.{c}").alias(c) for c in rest])


def longest_at_start(matches: DataFrame) -> DataFrame:
    """matches plus longest: no longer one starts at the same place."""
    at = Window.partitionBy("doc_id", "start")
    return matches.withColumn("longest", F.col("end") == F.max("end").over(at))


def overlap_components(items: DataFrame, ordered: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """items plus component: overlapping intervals of a document, chained, share
    a number."""
    before = Window.partitionBy("doc_id").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True))
    return items.withColumn("_o", opens.cast("int")).withColumn("component", F.sum("_o").over(upto)).drop("_o")


def best_selection(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]] | None:
    """The selection of distinct (start, end, output) without overlap that covers
    most, None if several do. Each prefix in the order of ends keeps its best
    cover, whether one selection has it or more, and its last choice."""
    spans = sorted(set(spans), key=lambda x: (x[1], x[0], x[2]))
    ends = [e for _, e, _ in spans]
    cover, ways, took = [0], [1], [None]
    for j, (s, e, _) in enumerate(spans):
        before = bisect_right(ends, s, 0, j)
        with_, without = cover[before] + e - s, cover[j]
        cover.append(max(with_, without))
        ways.append(min(2, (ways[before] if with_ >= without else 0) + (ways[j] if without >= with_ else 0)))
        took.append(before if with_ >= without else None)
    if ways[-1] > 1:
        return None
    out, j = [], len(spans)
    while j:
        if took[j] is None:
            j -= 1
        else:
            out.append(spans[j - 1])
            j = took[j]
    return out[::-1]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(merged: tuple[list[int], list[int]], s: int, e: int) -> bool:
    k = bisect_left(merged[0], e) - 1
    return k >= 0 and merged[1][k] > s


def decide(starts: list[int], ends: list[int], outputs: list[str], precedences: list[int], candidates: list[bool], gates: list[str | None], limit: int = LIMIT) -> tuple[list[str], list[str | None], list[tuple[int, int, list[str]]]]:
    """(status and reason of each candidate of one text, unresolved regions)."""
    n = len(starts)
    status, reason = ["blocked"] * n, list(gates)
    live = sorted((i for i in range(n) if gates[i] is None), key=lambda i: (starts[i], -ends[i], outputs[i]))
    certain = {(starts[i], ends[i]) for i in live if not candidates[i]}
    rest = []
    for i in live:
        if candidates[i] and (starts[i], ends[i]) in certain:
            reason[i] = "candidate_alternative"
        else:
            rest.append(i)
    levels = sorted({precedences[i] for i in rest})
    above = {p: _merged([(starts[i], ends[i]) for i in rest if precedences[i] > p]) for p in levels[:-1]}
    # The farthest end of the longer spans around each span, among peers of its precedence, blocked alternatives too.
    around: dict[tuple[int, int, int], int] = {}
    for p in {precedences[i] for i in live if precedences[i] > 0}:
        far = -1
        for s, e in dict.fromkeys((starts[i], ends[i]) for i in live if precedences[i] == p):
            around[p, s, e] = far
            far = max(far, e)
    longest: dict[int, int] = {}
    left = []
    for i in rest:
        s, e, p = starts[i], ends[i], precedences[i]
        if p in above and _meets(above[p], s, e):
            reason[i] = "shadowed_by_higher_precedence"
        elif p > 0 and around[p, s, e] >= e:
            reason[i] = "shadowed_by_longer_high_precedence"
        else:
            left.append(i)
            longest[s] = max(longest.get(s, 0), e)
    components: list[tuple[int, int, list[int]]] = []
    for i in left:
        s, e = starts[i], ends[i]
        if e < longest[s]:
            reason[i] = "shadowed_by_longer_match"
        elif components and s < components[-1][1]:
            a, b, items = components[-1]
            components[-1] = (a, max(b, e), [*items, i])
        else:
            components.append((s, e, [i]))
    regions: list[tuple[int, int, str]] = []
    taken = []
    for a, b, items in components:
        chosen = best_selection([(starts[i], ends[i], outputs[i]) for i in items]) if len(items) <= limit or len(items) == 1 else None
        if chosen is None:
            why = "conflicting_productive_outputs" if all(starts[i] == a and ends[i] == b for i in items) else "unresolved_shifted_overlap"
            regions.append((a, b, why))
            for i in items:
                status[i], reason[i] = "unresolved", why
            continue
        taken += chosen
        for i in items:
            if (starts[i], ends[i], outputs[i]) in chosen:
                status[i], reason[i] = "applied", None
            else:
                reason[i] = "outranked_by_overlap"
    won, open_ = _merged([(s, e) for s, e, _ in taken]), [(s, e) for s, e, _ in regions]
    for i in sorted((i for i in range(n) if gates[i] in AMBIGUOUS), key=lambda i: (starts[i], -ends[i], outputs[i])):
        s, e = starts[i], ends[i]
        if not _meets(won, s, e) and not any(x < e and y > s for x, y in open_):
            regions.append((s, e, gates[i]))
            open_.append((s, e))
    merged: list[tuple[int, int, list[str]]] = []
    for s, e, why in sorted(regions):
        if merged and s < merged[-1][1]:
            a, b, reasons = merged[-1]
            merged[-1] = (a, max(b, e), reasons if why in reasons else [*reasons, why])
        else:
            merged.append((s, e, [why]))
    return status, reason, merged


def decisions(docs: DataFrame, candidates: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each document: doc_id; items, its candidates(doc_id, start, end,
    output, precedence, candidate, ...) in one array; status (applied, blocked,
    unresolved) and reason of each; regions left unresolved, with their reasons;
    rendered, the text with the applied outputs in place. Never picks one of
    several outputs by order.

    In turn: what a gate (an optional column: the reason it doesn't hold, else
    null) keeps out; an alternative gives way to a certain rule on its span; lower
    precedence to an overlapping higher one; of one precedence above 0, a shorter
    one to a longer one around it; a shorter match to a longer one of the same
    start; what still overlaps is applied if one selection alone covers most. More
    than `limit` candidates in one overlap stay unresolved. A text's candidates
    meet in its row, which they are in proportion to."""
    workers.prepare(docs.sparkSession)
    names = [c for c in candidates.columns if c != "doc_id"]
    items = candidates.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("items"))
    rows = docs.select("doc_id", F.col(text).alias("_t")).join(items, "doc_id", "left")
    gated = "gate" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            flat = lists.flatten()
            field = {c: flat.field(c).to_pylist() for c in ("start", "end", "output", "precedence", "candidate")}
            gates = flat.field("gate").to_pylist() if gated else [None] * len(flat)
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_pylist()
            at, status, reason, regions, rendered = 0, [], [], [], []
            for t, size in zip(batch.column("_t").to_pylist(), sizes):
                part = slice(at, at + size)
                at += size
                own = [field[c][part] for c in ("start", "end", "output", "precedence", "candidate")]
                s, r, open_ = decide(*own, gates[part], limit)
                status.append(s)
                reason.append(r)
                regions.append([{"start": a, "end": b, "reasons": x} for a, b, x in open_])
                pieces, done = [], 0
                for a, b, out in sorted({(own[0][i], own[1][i], own[2][i]) for i in range(size) if s[i] == "applied"}) if t is not None else ():
                    pieces += [t[done:a], out]
                    done = b
                rendered.append(None if t is None else "".join([*pieces, t[done:]]))
            region = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("reasons", pa.list_(pa.string()))]))
            columns = [batch.column("doc_id"), lists, pa.array(status, pa.list_(pa.string())), pa.array(reason, pa.list_(pa.string())), pa.array(regions, region), pa.array(rendered, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "items", "status", "reason", "regions", "rendered"])

    words = T.ArrayType(T.StringType())
    region = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reasons", words)]))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["items"], T.StructField("status", words), T.StructField("reason", words), T.StructField("regions", region), T.StructField("rendered", T.StringType())])
    return rows.mapInArrow(run, schema)


def arbitrate(docs: DataFrame, candidates: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """candidates plus status and reason: decisions(), a row for each candidate."""
    made = decisions(docs, candidates, text, limit)
    each = made.select("doc_id", F.explode(F.arrays_zip("items", "status", "reason")).alias("x"))
    return each.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"x.items.{c}").alias(c) for c in candidates.columns], "x.status", "x.reason")


def applied_spans(decided: DataFrame) -> DataFrame:
    """The distinct applied spans of arbitrate()'s rows."""
    return decided.where("status = 'applied'").dropDuplicates(["doc_id", "start", "end", "output"])


def rendered_offsets(decided: DataFrame) -> DataFrame:
    """Applied spans with rendered_start and rendered_end: shifted by the growth
    of all before."""
    before = Window.partitionBy("doc_id").orderBy("start", "end", "output").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.sum(F.length("output") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    return applied_spans(decided).withColumn("rendered_start", F.col("start") + grown).withColumn("rendered_end", F.col("start") + grown + F.length("output"))


def greedy(items: Column) -> Column:
    """Of array<struct<start,end,...>> sorted by preference within a start: left
    to right, each that begins at or after the last taken one's end."""
    kind = F.struct(F.lit(0).alias("at"), F.slice(items, 1, 0).alias("kept"))
    return F.aggregate(items, kind, lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))["kept"]


def walked(spans: DataFrame) -> DataFrame:
    """spans(doc_id, start, end, ...) that a left-to-right walk takes, each past
    the end of the one before; one span for each start. Spans that nothing
    overlaps are taken as they are; only the others are folded, each overlap
    component by itself."""
    names = [c for c in spans.columns if c != "doc_id"]
    grouped = overlap_components(spans).groupBy("doc_id", "component").agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in names if c not in ("start", "end")]))).alias("s"))
    kept = F.when(F.size("s") == 1, F.col("s")).otherwise(greedy(F.col("s")))
    return grouped.select("doc_id", F.explode(kept).alias("k")).select("doc_id", *[F.col(f"k.{c}").alias(c) for c in names])


def spans_and_gaps(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, end, known: all distinct spans(doc_id, start, end), and as
    unknown the runs of characters that none of them covers, whole texts without a
    span too."""
    own = spans.select("doc_id", "start", "end").distinct()
    regions = overlap_components(own).groupBy("doc_id", "component").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = Window.partitionBy("doc_id").orderBy("start")
    before = regions.select("doc_id", F.coalesce(F.lag("end").over(at), F.lit(0)).alias("a"), F.col("start").alias("b"))
    sizes = docs.select("doc_id", F.length(text).alias("n")).where("n > 0")
    last = sizes.join(regions.groupBy("doc_id").agg(F.max("end").alias("e")), "doc_id", "left").select("doc_id", F.coalesce("e", F.lit(0)).alias("a"), F.col("n").alias("b"))
    gaps = before.unionByName(last).where("b > a").select("doc_id", F.col("a").alias("start"), F.col("b").alias("end"), F.lit(False).alias("known"))
    return own.withColumn("known", F.lit(True)).unionByName(gaps)
