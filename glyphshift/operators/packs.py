"""Validation of a rule pack's own tables: each check gives (code, id) rows, and
nothing is passed over because another check has found it too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R

KINDS = ("sources", "evidence", "lexical", "constraints", "units", "relations", "safety", "hints")


def first_by_id(df: DataFrame) -> DataFrame:
    """Of rows that share an id the first, by seq."""
    rest = [c for c in df.columns if c != "id"]
    return df.groupBy("id").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("r")).select("id", "r.*")


def pack_faults(t: dict[str, DataFrame]) -> DataFrame:
    """(code, id) of what is wrong with a pack: KINDS, each with id and seq;
    sources(kind), evidence(source, type, direction, raw_from, raw_to,
    projected_from, projected_to, notes array), lexical(source, evidence array),
    constraints(lexical array), relations(unit, direction, channel, match, targets
    array, constraint, evidence array, admission), safety(unit, constraint, evidence
    array, admission), hints(constraint, evidence array). Codes that begin with R_
    ask for a review, the others are errors."""
    first = {k: first_by_id(t[k]) for k in ("sources", "evidence", "lexical", "constraints", "units")}
    missing = lambda df, column, kind: df.where(F.col(column).isNotNull()).join(first[kind].select(F.col("id").alias(column)), column, "left_anti").select("id")
    each = lambda df, column: df.select("id", F.explode(column).alias("ref"))
    absent = lambda df, column, kind: each(df, column).join(first[kind].select(F.col("id").alias("ref")), "ref", "left_anti").select("id")
    relations, safety, hints, evidence = t["relations"], t["safety"], t["hints"], t["evidence"]
    admitted = relations.where("admission = 'admitted'")
    single = admitted.where("size(targets) = 1").withColumn("target", F.get("targets", F.lit(0)))
    scope = F.coalesce("constraint", F.lit(""))
    keyed = single.withColumn("_k", F.concat_ws("\u0000", "direction", "channel", "match", scope, "target"))
    firsts = keyed.groupBy("_k").agg(F.min("seq").alias("_first"))
    owned = relations.select("unit").unionByName(safety.where("unit is not null").select("unit")).distinct()

    known = first["evidence"].join(first["sources"].select(F.col("id").alias("source"), F.col("kind").alias("_kind")), "source", "left").select(F.col("id").alias("ref"), "_kind", "type", "direction", "raw_from", "raw_to", "projected_from", "projected_to")
    oracle = lambda df: each(df.where("admission = 'admitted'").select("id", "seq", "evidence"), "evidence").join(known, "ref").groupBy("id").agg(F.bool_and(F.col("_kind").eqNullSafe("candidate_oracle")).alias("all")).where("all")

    bound = relations.where("constraint is not null").join(first["constraints"].select(F.col("id").alias("constraint"), "lexical"), "constraint")
    resolved = bound.select("id", "seq", F.explode_outer("lexical").alias("ref")).join(first["lexical"].select(F.col("id").alias("ref"), F.lit(1).alias("_one")), "ref", "left").groupBy("id", "seq").agg(F.count("_one").alias("n"))

    claims = single.select("id", "seq", "match", "target", "constraint", F.explode_outer("evidence").alias("ref")).join(known.where("type = 'mapping'"), "ref", "left")
    char = claims.where((F.length("match") == 1) & (F.length("target") == 1) & F.col("constraint").isNull())
    reverse = (F.col("direction") == "historical_to_modern") & (F.col("raw_from") == F.col("target")) & (F.col("raw_to") == F.col("match"))
    direct = (F.col("direction") == "modern_to_historical") & (F.col("raw_from") == F.col("match")) & (F.col("raw_to") == F.col("target"))
    told = char.groupBy("id", "seq").agg(F.coalesce(F.bool_or(reverse), F.lit(False)).alias("rev"), F.coalesce(F.bool_or(direct), F.lit(False)).alias("dir"))

    forward = F.col("direction") == "modern_to_historical"
    side = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    layers = claims.where("type is not null").select("id", "match", "target", side("raw_from", "raw_to").alias("rm"), side("raw_to", "raw_from").alias("rt"), side("projected_from", "projected_to").alias("pm"), side("projected_to", "projected_from").alias("pt")).where(F.col("match") == F.coalesce("pm", "rm"))
    moved = F.col("pt").isNotNull() & (F.col("pt") != F.col("rt"))

    # Longer matches that hold a shorter one: their substrings are exploded, so that meeting is an equi join.
    short = single.groupBy(F.col("match").alias("part"), scope.alias("_c")).agg(F.collect_set("target").alias("targets_"), F.collect_set("unit").alias("units_"))
    cuts = single.where("length(match) > 1").select("id", "seq", "match", "target", "unit", scope.alias("_c"), F.explode(F.sequence(F.lit(1), F.length("match") - 1)).alias("n")).select("*", F.explode(F.sequence(F.lit(1), F.length("match") - F.col("n") + 1)).alias("i"))
    cuts = cuts.withColumn("part", F.substring("match", F.col("i"), F.col("n"))).groupBy("id", "seq", "match", "target", "unit", "_c", "part").agg(F.count("*").alias("times"), F.min("i").alias("at"))
    met = cuts.join(short, ["part", "_c"]).where("size(targets_) = 1")
    made = F.concat(F.expr("left(match, at - 1)"), F.get("targets_", F.lit(0)), F.expr("substring(match, at + length(part))"))
    derived = (F.col("times") == 1) & (made == F.col("target"))
    longer = met.groupBy("id", "seq").agg(F.bool_or(derived).alias("sure"), F.bool_or(~derived & F.array_contains("units_", F.col("unit"))).alias("open"))

    checks = {
        "E_DUPLICATE_ID": [t[k].groupBy("id").count().where("count > 1") for k in KINDS],
        "E_UNRESOLVED_EVIDENCE": [missing(evidence, "source", "sources"), missing(t["lexical"], "source", "sources"), absent(t["lexical"], "evidence", "evidence"), absent(relations, "evidence", "evidence"), absent(safety, "evidence", "evidence"), absent(hints, "evidence", "evidence")],
        "E_PROJECTION_AUDIT_MISSING": [evidence.where("type = 'mapping' and (projected_from is not null or projected_to is not null) and coalesce(size(notes), 0) < 1")],
        "E_DANGLING_LOCAL_REF": [absent(t["constraints"], "lexical", "lexical"), missing(relations, "unit", "units"), missing(relations, "constraint", "constraints"), missing(safety, "unit", "units"), missing(safety, "constraint", "constraints"), missing(hints, "constraint", "constraints")],
        "E_REQUIRED_LEXICAL_BINDING_MISSING": [resolved.where("n = 0")],
        "E_SILENT_MULTI_TARGET_COLLAPSE": [admitted.where("size(targets) <> 1")],
        "E_DUPLICATE_EXECUTABLE_AUTHORITY": [keyed.join(firsts, "_k").where("seq > _first")],
        "E_ORPHAN_RESTORATION_UNIT": [t["units"].join(owned.select(F.col("unit").alias("id")), "id", "left_anti")],
        "E_REVIEW_ONLY_AUTHORITY": [oracle(relations), oracle(safety)],
        "E_UNSAFE_SINGLE_CHAR_REVERSE": [told.where("rev and not dir")], "E_PURE_CHARACTER_CONTAMINATION": [told.where("not rev or dir")],
        "E_LAYER_LEAKAGE": [layers.where(moved & (F.col("target") == F.col("rt")))],
        "R_LAYER_LEAKAGE_SUSPECTED": [layers.where(moved & (F.col("target") != F.col("rt")) & (F.col("target") != F.col("pt")) | F.col("pt").isNull() & (F.col("target") != F.col("rt")))],
        "E_REDUNDANT_LONGER_RULE": [longer.where("sure")], "R_REDUNDANT_LONGER_RULE_UNPROVEN": [longer.where("open and not sure")],
    }
    return R.violations({f"{code}/{k}": df for code, found in checks.items() for k, df in enumerate(found)}).select(F.substring_index("code", "/", 1).alias("code"), "id")
