"""Lexical lookup, composition, reading reconstruction and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(words: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """words with n_found, value (of the only entry, else null) and all, sorted.
    lexicon(key, value) is grouped first, so a word meets one row."""
    known = lexicon.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("all"))
    return words.join(known, key, "left").select(*words.columns, F.coalesce(F.size("all"), F.lit(0)).alias("n_found"), F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("value"), "all")


def admitted_readings(forms: DataFrame, readings: DataFrame) -> DataFrame:
    """Forms and readings of an entry: a reading restricted to some forms goes
    with those alone, one of no form in ideographs (nokanji) with kana forms."""
    both = forms.join(readings, "entry")
    return both.where(((F.size("restricted") == 0) | F.array_contains("restricted", F.col("form"))) & ~(F.col("nokanji") & F.col("kanji")))


def compositions(words: DataFrame, parts: DataFrame) -> DataFrame:
    """surface, reading, left, right: ways in which two known parts make a word
    in both. Split points are exploded, so both lookups are equi joins."""
    cut = words.select("surface", "reading", F.explode(F.sequence(F.lit(1), F.length("surface") - 1)).alias("i")) if "surface" in words.columns else words
    cut = cut.select("surface", "reading", F.substring("surface", F.lit(1), F.col("i")).alias("left"), F.substring("surface", F.col("i") + 1, F.length("surface")).alias("right"))
    a = parts.select(F.col("surface").alias("left"), F.col("reading").alias("lr"))
    b = parts.select(F.col("surface").alias("right"), F.col("reading").alias("rr"))
    return cut.join(a, "left").join(b, "right").where(F.concat("lr", "rr") == F.col("reading")).select("surface", "reading", "left", "right").distinct()


def contextual(words: DataFrame, relations: DataFrame) -> DataFrame:
    """words(id, surface, viable array<string>) against relations(surface, target,
    bindings array, preserve, candidate): preserved if a preserving one is
    eligible; none without an eligible target; resolved if one target alone is
    admitted (by a relation that is no candidate) and it covers every viable
    binding, or holds for all; else candidates. A relation is eligible that names
    no binding or a viable one."""
    hit = words.join(relations, "surface", "left")
    ok = F.coalesce(F.col("target").isNotNull() & ((F.size("bindings") == 0) | F.arrays_overlap("bindings", "viable")), F.lit(False))
    hit = hit.withColumn("_ok", ok & ~F.col("preserve")).withColumn("_sure", F.col("_ok") & ~F.col("candidate")).withColumn("_keep", ok & F.col("preserve"))
    g = hit.groupBy("id", "surface", "viable").agg(
        F.bool_or("_keep").alias("keep"), F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col("target")))).alias("targets"), F.collect_set(F.when(F.col("_sure"), F.col("target"))).alias("sure"),
        F.bool_or(F.col("_sure") & (F.size("bindings") == 0)).alias("global"), F.flatten(F.collect_set(F.when(F.col("_sure"), F.col("bindings")))).alias("held"),
    )
    keep = F.coalesce("keep", F.lit(False))
    covers = F.coalesce("global", F.lit(False)) | (F.size("viable") > 0) & (F.size(F.array_except("viable", "held")) == 0)
    status = F.when(keep, F.lit("preserve")).when(F.size("targets") == 0, F.lit("none")).when((F.size("sure") == 1) & covers, F.lit("resolved")).otherwise(F.lit("candidates"))
    none = F.array().cast("array<string>")
    return g.select("id", "surface", status.alias("status"), F.when(status == "resolved", F.get("sure", F.lit(0))).alias("target"), F.when(keep, none).otherwise(F.col("targets")).alias("targets"))


def preferred(c: DataFrame) -> DataFrame:
    """Cascade over id, sources array, authoritative, exact, rules array<struct
    <admissible array, preferred>>, rendering, manual: the first that decides.
    An exact value outside the sources fails closed; rules count only if their
    admissible set is the source set, and must agree; nothing drops the sources."""
    same = F.filter("rules", lambda r: F.array_sort(r["admissible"]) == F.array_sort(F.col("sources")))
    agreed = F.array_distinct(F.transform(same, lambda r: r["preferred"]))
    inside = lambda x: F.array_contains("sources", x)
    basis = (
        F.when(F.col("authoritative").isNotNull(), "authoritative").when(F.col("exact").isNotNull() & ~inside(F.col("exact")), "incompatible")
        .when(F.col("exact").isNotNull(), "exact").when(F.size(agreed) == 1, "diachronic").when(F.col("rendering").isNotNull() & inside(F.col("rendering")), "rendering")
        .when(F.col("manual").isNotNull() & inside(F.col("manual")), "manual").when(F.size("sources") == 1, "single").otherwise("none")
    )
    pick = F.when(basis == "authoritative", F.col("authoritative")).when(basis == "exact", F.col("exact")).when(basis == "diachronic", F.get(agreed, F.lit(0))).when(basis == "rendering", F.col("rendering")).when(basis == "manual", F.col("manual")).when(basis == "single", F.get("sources", F.lit(0)))
    return c.select("id", basis.alias("basis"), pick.alias("selected"), F.array_join(F.array_sort("sources"), "|").alias("sources"))


def numbered(entries: DataFrame) -> DataFrame:
    """key of entries(seq, form, reading): form/reading, with #n where several
    entries share both."""
    same = Window.partitionBy("form", "reading")
    base = F.concat_ws("/", "form", "reading")
    n = F.row_number().over(same.orderBy("seq"))
    return entries.withColumn("key", F.when(F.count("*").over(same) > 1, F.concat(base, F.lit("#"), n)).otherwise(base))


def agreed_reading(readings: Column, own: Column | None = None) -> Column:
    """The only reading, else the lemma's own if it is one of them, else null."""
    only = F.when(F.size(readings) == 1, F.get(readings, F.lit(0)))
    return only if own is None else F.coalesce(only, F.when(F.array_contains(readings, own), own))


def dense_ids(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """df plus 0-based ids in the order of keys. Ranges are counted, and a row's
    id is its range's offset plus its place inside; only the counts meet in one
    task. The sorted ranges are written to the checkpoint folder, as their bounds
    could differ if they were computed twice."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33).alias("_part")  # how Spark builds these numbers
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.col("_m") - F.shiftleft("_part", 33)
    return placed.withColumn("_part", part).join(bases, "_part").select(*df.columns, (F.col("_base") + inside).alias(name))


def lemma_conflicts(records: DataFrame) -> DataFrame:
    """Lemma ids of records(lemma_id, lemma, origin, ...) that name two lemmas."""
    return records.groupBy("lemma_id").agg(F.count_distinct(F.struct("lemma", "origin")).alias("n")).where("n > 1")


def compiled_slice(records: DataFrame) -> DataFrame:
    """id, surface, lemma_id, morphology and the sorted set of readings for each
    (surface, lemma_id, morphology); ids follow that order."""
    rows = records.groupBy("surface", "lemma_id", "morphology").agg(F.array_sort(F.collect_set("reading")).alias("readings"))
    return dense_ids(rows, "surface", "lemma_id", "morphology")


def surface_offsets(compiled: DataFrame) -> DataFrame:
    """surface, candidate_offset, candidate_count: where a surface's candidates
    stand in a compiled slice."""
    return compiled.groupBy("surface").agg(F.min("id").alias("candidate_offset"), F.count("*").alias("candidate_count"))


def changed_relations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current(id, form) after changes(seq, op, id, form): an id's last change
    decides; remove drops it, add and update set its form."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("op", "form"), F.struct("seq", "op")).alias("c"))
    both = current.join(last, "id", "full")
    return both.where("c is null or c.op <> 'remove'").select("id", F.when(F.col("c").isNull(), F.col("form")).otherwise(F.col("c.form")).alias("form"))


def as_relations(lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, id, record) of lists {kind: (table, id column)}; a record is its
    row as JSON, nulls included, so the inverse loses nothing."""
    parts = [d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")) for kind, (d, key) in lists.items()]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def from_relations(relations: DataFrame, kind: str, schema) -> DataFrame:
    """The list of a kind, as it was before as_relations."""
    return relations.where(F.col("kind") == kind).select(F.from_json("record", schema).alias("r")).select("r.*")
