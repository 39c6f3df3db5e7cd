"""Resolution of words as units, by lexicon and historical relations, and of
texts under a plan of spans. Everything is a join and a CASE: a unit's row meets
its candidates' counts, and never more than its own candidates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon as L
from . import workers


def native_lookup(words: DataFrame, exact: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """words(surface) plus native struct(status, surface, reading, surfaces,
    readings), null if no relation has the surface. exact(channel, surface,
    target) has one target for each surface and channel ("surface", "reading"),
    ambiguous(channel, surface, alternatives) several: with one of these a word is
    candidates, otherwise resolved."""
    of = lambda df, channel, value, name: df.where(F.col("channel") == channel).select("surface", F.col(value).alias(name))
    out = words
    for df, value, names in ((exact, "target", ("_s", "_r")), (ambiguous, "alternatives", ("_ss", "_rs"))):
        for channel, name in zip(("surface", "reading"), names):
            out = out.join(of(df, channel, value, name), "surface", "left")
    open_ = F.col("_ss").isNotNull() | F.col("_rs").isNotNull()
    none = F.array().cast("array<string>")
    made = F.struct(F.when(open_, "candidates").otherwise("resolved").alias("status"), F.coalesce("_s", "surface").alias("surface"), F.col("_r").alias("reading"), F.array_sort(F.coalesce("_ss", none)).alias("surfaces"), F.array_sort(F.coalesce("_rs", none)).alias("readings"))
    return out.select(*words.columns, F.when(open_ | F.col("_s").isNotNull() | F.col("_r").isNotNull(), made).alias("native"))


def resolved_units(words: DataFrame, lexicon: DataFrame, identities: DataFrame, contextual: DataFrame, exact: DataFrame, ambiguous: DataFrame, safe_from: str = "", safe_to: str = "") -> DataFrame:
    """words(id, surface, said, protected) plus kind, disposition, route, rendered
    and kana.

    said is an annotation's reading, which candidates must have. lexicon(surface,
    identity, readings array, viable array, morphology boolean): none gives what
    the native tables say of the surface; several are candidates; one is resolved,
    in this order: preserved or candidates by context, resolved by context, sino
    candidates, native candidates, then its own relation or the surface's, with
    characters mapped from safe_from to safe_to; where nothing is known the source
    needs a review. identities(identity, status, route, reading, target,
    needs_morphology): a relation that needs morphology holds only for a candidate
    that has it; several readings of one identity are candidates."""
    base = words.select("id", "surface", "said", "protected").distinct()
    own = lexicon.groupBy("surface", "identity", "readings", "viable", "morphology").agg(F.lit(1).alias("_one"))
    hit = base.where("not protected").join(own, "surface").where(F.col("said").isNull() | F.array_contains("readings", F.col("said")))
    counted = hit.groupBy("id", "surface").agg(F.count("*").alias("n"), F.first("identity").alias("identity"), F.first("viable").alias("viable"), F.first("morphology").alias("morphology"))
    units = native_lookup(base.join(counted, ["id", "surface"], "left").withColumn("n", F.coalesce("n", F.lit(0))), exact, ambiguous)
    told = L.contextual(units.where("n = 1").select("id", "surface", "viable"), contextual).select("id", "surface", F.col("status").alias("context"), F.col("target").alias("context_target"))
    units = units.join(told, ["id", "surface"], "left").join(identities, "identity", "left")
    sino = F.col("status").eqNullSafe("candidates")
    accepted = F.col("status").eqNullSafe("resolved") & (~F.coalesce("needs_morphology", F.lit(False)) | F.coalesce("morphology", F.lit(False)))
    status = F.col("native.status")
    native_ok, native_open = ~accepted & ~sino & status.eqNullSafe("resolved"), ~accepted & ~sino & status.eqNullSafe("candidates")
    relation = F.when(accepted, F.struct(F.col("route"), F.col("reading"), F.coalesce("target", "surface").alias("surface"))).when(native_ok, F.struct(F.lit("native").alias("route"), F.col("native.reading").alias("reading"), F.col("native.surface").alias("surface")))
    units = units.withColumn("_rel", relation)
    known = F.col("_rel").isNotNull()
    plain = F.coalesce(F.col("_rel.surface"), F.col("surface"))
    mapped = F.translate(plain, safe_from, safe_to) if safe_from else plain
    fallback = F.translate(F.col("native.surface"), safe_from, safe_to) if safe_from else F.col("native.surface")
    one, none, many = F.col("n") == 1, F.col("n") == 0, F.col("n") > 1
    context = F.col("context")
    kind = F.when(F.col("protected"), "protected").when(one, "resolved").when(many, "candidates").when(status.eqNullSafe("resolved"), "resolved").otherwise("unresolved")
    disposition = (
        F.when(F.col("protected"), "PRESERVE").when(many, "CANDIDATES").when(none & status.eqNullSafe("candidates"), "CANDIDATES").when(none & status.eqNullSafe("resolved"), "AUTO").when(none, "UNRESOLVED")
        .when(context == "preserve", "PRESERVE").when(context == "candidates", "CANDIDATES").when(context == "resolved", "AUTO").when(sino | native_open, "CANDIDATES").when(known | (mapped != plain), "AUTO").otherwise("SOURCE_REVIEW")
    )
    rendered = (
        F.when(F.col("protected"), F.col("surface")).when(~one, F.coalesce(F.when(status == "resolved", F.when(none, fallback).otherwise(F.col("surface"))).when(status == "candidates", F.col("native.surface")), F.col("surface")))
        .when(context.isin("preserve", "candidates"), F.col("surface")).when(context == "resolved", F.col("context_target")).when(sino, F.col("surface")).when(native_open, F.col("native.surface")).otherwise(mapped)
    )
    route = F.when(F.col("protected"), None).when(one & sino & (context == "none"), F.coalesce("route", F.lit("sino"))).when(one & native_open & (context == "none"), "native").when(one, F.col("_rel.route")).when(none & status.isNotNull(), "native").when(many & status.eqNullSafe("candidates"), "native")
    kana = F.when(one & native_open & (context == "none"), F.col("native.reading")).when(one, F.col("_rel.reading")).when(none, F.col("native.reading"))
    return units.select("id", "surface", kind.alias("kind"), disposition.alias("disposition"), route.alias("route"), rendered.alias("rendered"), F.when(~F.col("protected"), kana).alias("kana"))


def span_faults(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, fault) of spans(doc_id, start, end) that are empty or
    outside their text, or begin before the one before them ends."""
    at = Window.partitionBy("doc_id").orderBy("start", "end")
    joined = spans.join(docs.select("doc_id", F.length(text).alias("_n")), "doc_id", "left").withColumn("_before", F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1)))
    bad = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.coalesce("_n", F.lit(0))), "invalid_span").when(F.col("_before") > F.col("start"), "overlapping_spans")
    return joined.select("doc_id", "start", "end", bad.alias("fault")).where("fault is not null")


_SPANS = "array<struct<start:int,end:int,protected:boolean>>"


def _plans_of(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[int, int, bool]]]]:
    """(text, spans in their order) of each row."""
    lists = batch.column("spans")
    flat = lists.flatten()
    each = list(zip(*(flat.field(c).to_pylist() for c in ("start", "end", "protected")))) if len(flat) else []
    at = 0
    for text, size in zip(batch.column("text").to_pylist(), pc.list_value_length(lists).fill_null(0).to_pylist()):
        yield text, sorted(each[at : at + size], key=lambda x: x[:2])
        at += size


def evaluated_plans(plans: DataFrame, units: DataFrame) -> DataFrame:
    """evaluated() of plans(doc_id, text, spans array<struct<start, end,
    protected>>): a text with its plan in one row.

    A text is cut in one pass. Each distinct word of a text asks the units once, and
    what they say comes back to the text's row; a text never leaves it, and no place
    of it becomes a row."""
    workers.prepare(plans.sparkSession)
    kind = plans.schema["doc_id"].dataType.simpleString()
    plans = plans.select("doc_id", "text", F.col("spans").cast(_SPANS).alias("spans"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owners, surfaces, kept = [], [], []
                for n, (text, spans) in enumerate(_plans_of(part)):
                    own = {(text[a:b], p) for a, b, p in spans} if text is not None else ()
                    owners += [n] * len(own)
                    surfaces += [x for x, _ in own]
                    kept += [p for _, p in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owners, pa.int32())), pa.array(surfaces, pa.string()), pa.array(kept, pa.bool_())], ["doc_id", "surface", "protected"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("told")
            flat = lists.flatten()
            each = list(zip(*(flat.field(c).to_pylist() for c in ("surface", "protected", "kind", "disposition", "rendered")))) if len(flat) else []
            at, made = 0, []
            for (text, spans), size in zip(_plans_of(batch), pc.list_value_length(lists).fill_null(0).to_pylist()):
                told = {x[:2]: x[2:] for x in each[at : at + size]}
                at += size
                if text is None:
                    made.append((None, 0, 0, 0, 0, 0, None))
                    continue
                pieces, done, gaps, n = [], 0, 0, [0] * 5
                for a, b, protected in spans:
                    if a > done:
                        pieces.append(text[done:a])
                        gaps += 1
                    word, done = text[a:b], b
                    kind, disposition, rendered = told.get((word, protected), ("unresolved", None, None))
                    auto = disposition == "AUTO"
                    pieces.append(rendered if auto and kind == "resolved" else word)
                    n[0] += kind == "resolved"
                    n[1] += auto
                    n[2] += kind == "candidates" or disposition == "CANDIDATES"
                    n[3] += kind == "unresolved"
                    n[4] += kind == "protected" or disposition == "PRESERVE"
                if done < len(text):
                    pieces.append(text[done:])
                    gaps += 1
                made.append(("".join(x or "" for x in pieces), *n, gaps))
            columns = [pa.array([m[k] for m in made], pa.string() if k == 0 else pa.int64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "rendered", "resolved", "auto", "candidates", "unresolved", "kept", "literal"]
    # What is no unit counts as unresolved, so units of which nothing else is known need not come back.
    known = units.where("kind <> 'unresolved' or disposition <> 'UNRESOLVED'").select("surface", "protected", "kind", "disposition", "rendered")
    words = plans.mapInArrow(asked, f"doc_id {kind}, surface string, protected boolean")
    told = words.join(known, ["surface", "protected"]).groupBy("doc_id").agg(F.collect_list(F.struct(*known.columns)).alias("told"))
    rest = ", ".join(f"{c} {'string' if c == 'rendered' else 'long'}" for c in names[1:])
    return plans.join(told, "doc_id", "left").mapInArrow(walked, f"doc_id {kind}, {rest}")


def evaluated(docs: DataFrame, spans: DataFrame, units: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, rendered and counts (resolved, auto, candidates, unresolved, kept,
    literal) of texts under a plan of spans(doc_id, start, end, protected), which
    must have no faults. units are resolved_units() of (id = surface, protected);
    a span that is none of them is unresolved; only what is resolved and AUTO is rendered; the gaps are literals."""
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "protected")).alias("spans"))
    return evaluated_plans(docs.select("doc_id", F.col(text).alias("text")).join(own, "doc_id", "left"), units)


def planned(docs: DataFrame, pattern: str, keep: Callable[[int], bool], protect: Callable[[int], bool]) -> DataFrame:
    """plans for evaluated_plans(): spans are what a pattern finds in the text, of
    the lengths that keep() takes, protected where protect() says so."""
    workers.prepare(docs.sparkSession)
    own = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, ends = [0], [], []
            for text in batch.column("text").to_pylist():
                for m in own.finditer(text or ""):
                    a, b = m.span()
                    if keep(b - a):
                        starts.append(a)
                        ends.append(b)
                sizes.append(len(starts))
            spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([protect(b - a) for a, b in zip(starts, ends)], pa.bool_())], ["start", "end", "protected"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)], ["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, spans {_SPANS}")


def domain_decision(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked(id, surface, domains array) by homophone rows(forms array, historical
    array, tags array): not_found; no_domain_constraint; context_required without
    a domain; context_miss; matched, with the historical forms and the tags met.

    Rows are brought down to what a surface has and what each of its tags gives;
    each distinct surface and set of domains is decided once and told to all that
    ask it, so no asked row meets the rows of its surface."""
    told = rows.select(F.explode("forms").alias("surface"), "historical", "tags")
    known = told.groupBy("surface").agg(F.count("tags").alias("n"), F.count_if(F.size("tags") > 0).alias("q"))
    forms = told.select("surface", F.explode("tags").alias("_tag"), "historical").groupBy("surface", "_tag").agg(F.collect_set("historical").alias("_h"))
    distinct = asked.select("surface", "domains").distinct()
    hit = distinct.select("surface", "domains", F.explode(F.array_distinct("domains")).alias("_tag")).join(forms, ["surface", "_tag"])
    union = F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("_h")))))
    met = hit.groupBy("surface", "domains").agg(union.alias("candidates"), F.array_sort(F.collect_set("_tag")).alias("matched"))
    same = lambda a, b: a["surface"].eqNullSafe(b["surface"]) & a["domains"].eqNullSafe(b["domains"])
    own = distinct.join(known, "surface", "left").alias("a").join(met.alias("b"), ["surface", "domains"], "left")
    none = F.array().cast("array<string>")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "not_found").when(F.col("q") == 0, "no_domain_constraint").when(F.size("domains") == 0, "context_required").when(F.col("matched").isNull(), "context_miss").otherwise("matched")
    decided = own.select("surface", "domains", status.alias("status"), F.coalesce("candidates", none).alias("candidates"), F.coalesce("matched", none).alias("matched"))
    ids = asked.select("id", "surface", "domains").distinct()
    return ids.join(decided, same(ids, decided)).select(ids["id"], "status", "candidates", "matched")
