"""Operators on a knowledge graph's tables: policies, validation, routes,
evidence, and what lexemes tell of forms and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .lexicon import compositions

FACT_KINDS = ("literal_form", "literal_reading", "form_relation", "reading_relation", "render_equivalence")
CLASSES, DIRECTIONS, LOSSINESS = R.CLASSES, ("forward_only", "reverse_traversable"), ("lossless", "many_to_one", "one_to_many")
DISPOSITIONS = ("literal_fact", "rule_definition", "rule_binding", "profile_policy", "derived_only", "excluded_with_reason")


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.collect_set(c))


def disabled_rules(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile and id of the rules(id, origin, default_enabled) that each of
    profiles(profile, enable, disable, origins: arrays) leaves out: those it
    disables, those of an origin it doesn't allow, those off by default that it
    doesn't enable. Unknown ids, and enabling a rule of another origin, fail."""
    named = profiles.select("profile", F.explode(F.concat("enable", "disable")).alias("id"))
    unknown = named.join(rules, "id", "left_anti").first()
    if unknown:
        raise ValueError(f"profile {unknown['profile']}: unknown rule {unknown['id']}")
    origin = F.coalesce("origin", F.lit("historically_attested"))
    foreign = profiles.select("profile", "origins", F.explode("enable").alias("id")).join(rules, "id").where(~F.array_contains("origins", origin)).first()
    if foreign:
        raise ValueError(f"profile {foreign['profile']}: rule {foreign['id']} is of an origin that it doesn't allow")
    each = rules.crossJoin(F.broadcast(profiles))  # profiles are a handful of rows, written by people
    off = F.array_contains("disable", F.col("id")) | ~F.array_contains("origins", origin) | ~F.coalesce("default_enabled", F.lit(True)) & ~F.array_contains("enable", F.col("id"))
    return each.where(off).select("profile", "id")


def with_rules(rules: DataFrame, more: DataFrame) -> DataFrame:
    """rules and those of more whose id is none of theirs."""
    return rules.unionByName(more.join(rules.select("id"), "id", "left_anti"), allowMissingColumns=True)


def graph_faults(sources: DataFrame, facts: DataFrame, rules: DataFrame, bindings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(code, id) of all that breaks a graph's rules. sources(id); facts(id, kind,
    surface, reading, target, sources, evidence, origin, derived_from, mechanism);
    rules(id, class, directionality, lossiness, from, to, dependencies, sources,
    evidence); bindings(id, rule, sources, evidence); dispositions(record,
    disposition, targets, reason)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    kinds = [df.select("id", F.lit(k).alias("kind")) for k, df in (("fact", facts), ("rule", rules), ("binding", bindings))]
    known = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    cited = facts.select("id", "sources").unionByName(rules.select("id", "sources")).unionByName(bindings.select("id", "sources"))
    backed = facts.select("id", "evidence").unionByName(rules.select("id", "evidence")).unionByName(bindings.select("id", "evidence"))
    origin = F.coalesce("origin", F.lit("historically_attested"))
    derived = ~empty("derived_from") | F.col("mechanism").isNotNull()
    relation = F.col("kind").isin("form_relation", "reading_relation", "render_equivalence")
    d = dispositions.withColumn("id", F.col("record"))
    wanted = F.when(F.col("disposition") == "literal_fact", "fact").when(F.col("disposition") == "rule_definition", "rule").when(F.col("disposition") == "rule_binding", "binding")
    aimed = d.select("id", "disposition", wanted.alias("wanted"), F.explode("targets").alias("target")).join(known.select(F.col("id").alias("target"), "kind").distinct(), "target", "left")
    checks = {
        "duplicate_source": sources.groupBy("id").count().where("count > 1"), "duplicate_id": known.groupBy("id").count().where("count > 1"),
        "no_sources": cited.where(empty("sources")), "no_evidence": backed.where(empty("evidence")), "unknown_source": cited.select("id", F.explode("sources").alias("s")).join(sources.select(F.col("id").alias("s")).distinct(), "s", "left_anti").select("id").distinct(),
        "unknown_kind": facts.where(~F.col("kind").isin(*FACT_KINDS)), "form_without_surface": facts.where((F.col("kind") == "literal_form") & blank("surface")), "reading_missing": facts.where((F.col("kind") == "literal_reading") & blank("reading")),
        "relation_incomplete": facts.where(relation & (blank("surface") & blank("reading") | blank("target"))), "derived_is_attested": facts.where(derived & (origin == "historically_attested")), "derivation_missing": facts.where((F.col("origin") == "kinotch_derived") & (empty("derived_from") | F.col("mechanism").isNull())),
        "unknown_class": rules.where(~F.col("class").isin(*CLASSES)), "unknown_direction": rules.where(~F.col("directionality").isin(*DIRECTIONS)), "unknown_lossiness": rules.where(~F.col("lossiness").isin(*LOSSINESS)), "forms_missing": rules.where(empty("from") | empty("to")),
        "many_to_one_shape": rules.where((F.col("lossiness") == "many_to_one") & ((F.size("from") < 2) | (F.size("to") != 1))), "many_to_one_reverse": rules.where((F.col("lossiness") == "many_to_one") & (F.col("directionality") == "reverse_traversable")), "one_to_many_shape": rules.where((F.col("lossiness") == "one_to_many") & ((F.size("from") != 1) | (F.size("to") < 2))),
        "missing_dependency": rules.select("id", F.explode("dependencies").alias("on")).join(rules.select(F.col("id").alias("on")).distinct(), "on", "left_anti").select("id").distinct(), "missing_rule": bindings.join(rules.select(F.col("id").alias("rule")), "rule", "left_anti"),
        "repeated_disposition": d.groupBy("id").count().where("count > 1"), "unknown_disposition": d.where(~F.col("disposition").isin(*DISPOSITIONS)), "targets_missing": d.where(wanted.isNotNull() & empty("targets")), "wrong_target": aimed.where("wanted is not null and (kind is null or kind <> wanted)").select("id").distinct(),
        "missing_target": aimed.where("disposition = 'derived_only' and kind is null").select("id").distinct(), "reason_missing": d.where(F.col("disposition").isin("derived_only", "profile_policy", "excluded_with_reason") & blank("reason")), "unexpected_targets": d.where((F.col("disposition") == "excluded_with_reason") & ~empty("targets")),
    }
    return R.violations(checks)


def integration_faults(safety: DataFrame, exported: DataFrame) -> DataFrame:
    """(code, id): admitted safety(id, admission, effect, blocks array<struct<pack,
    relation>>) that block a fallback without naming one, or name a relation that
    no pack of exported(pack, relation) has."""
    own = safety.where((F.col("admission") == "admitted") & (F.col("effect") == "block_fallback"))
    none = F.coalesce(F.size("blocks"), F.lit(0)) < 1
    named = own.where(~none).select("id", F.explode("blocks").alias("b")).select("id", "b.pack", "b.relation")
    return R.violations({"fallback_missing": own.where(none), "external_unresolved": named.join(exported.distinct(), ["pack", "relation"], "left_anti")})


def fact_route(kind: Column, surface: Column, reading: Column, target: Column, tags: Column) -> Column:
    """Where a fact is used; each goes one way."""
    tagged = lambda p: F.coalesce(F.exists(tags, lambda t: t.startswith(p)), F.lit(False))
    relation = (kind == "form_relation") & target.isNotNull() & ~surface.eqNullSafe(target)
    return F.when(surface.isNull() & reading.isNull(), "not_in_pack").when(tagged("safety:"), "safety_constraint").when(relation & tagged("context:"), "context_required_only").when(relation, "transform_candidate").otherwise("lookup_only")


def evidence_entries(items: DataFrame, dispositions: DataFrame, sources: DataFrame, programs: DataFrame, bindings: DataFrame) -> DataFrame:
    """id, kind, records, dispositions, snapshots and programs of items(id, kind,
    sources): the source records that dispositions(record, disposition, targets)
    tie to it (to a rule without any, through bindings(id, rule)), or its
    registered sources; the part of a record before # is its snapshot. One that has
    neither fails. programs(program, canonical array) name what they come from."""
    ledger = dispositions.select(F.explode("targets").alias("id"), "record", "disposition")
    direct = ledger.groupBy("id").agg(sorted_set("record").alias("records"), sorted_set("disposition").alias("kinds"))
    through = bindings.select("id", "rule").join(ledger, "id").groupBy(F.col("rule").alias("id")).agg(sorted_set("record").alias("records2"), sorted_set("disposition").alias("kinds2"))
    known = items.select("id", F.explode("sources").alias("s")).join(sources.select(F.col("id").alias("s")).distinct(), "s", "left_semi").groupBy("id").agg(sorted_set("s").alias("registered"))
    used = programs.select("program", F.explode("canonical").alias("id")).groupBy("id").agg(sorted_set("program").alias("programs"))
    out = items.select("id", "kind")
    for df in (direct, through, known, used):
        out = out.join(df, "id", "left")
    none = F.array().cast("array<string>")
    via = F.col("kind") == "rule"
    records = F.coalesce("records", F.when(via, F.col("records2")), none)
    registered = F.coalesce("registered", none)
    bare = (F.size(records) == 0) & (F.size(registered) == 0)
    checked = F.when(bare, F.raise_error(F.concat(F.lit("neither a source record nor a registered source: "), "id"))).otherwise(records)
    snapshot = F.array_sort(F.array_distinct(F.concat(F.transform(records, lambda r: F.substring_index(r, "#", 1)), registered)))
    told = F.when(F.size(records) > 0, checked).otherwise(F.transform(registered, lambda s: F.concat(s, F.lit("#project-rule"))))
    return out.select("id", "kind", F.when(bare, checked).otherwise(told).alias("records"), F.coalesce("kinds", F.when(via, F.col("kinds2")), none).alias("dispositions"), snapshot.alias("snapshots"), F.coalesce("programs", F.array().cast(used.schema["programs"].dataType)).alias("programs"))


def authority_join(records: DataFrame, lexemes: DataFrame, patterns: DataFrame, sep: str | None = None) -> DataFrame:
    """id, status and targets of records(id, scope, disposition, responsibility,
    surface, modern, historical): profile_scope, excluded, the lexemes(form,
    lexeme) of its form (unbound, unique, homograph), or its symbol and, for a sino
    reading, the pattern, which patterns(id) must have. With sep the targets are one
    string.

    A form may have very many lexemes: its list, or string, is made once, meets the
    records in the last join, and is never shuffled with them."""
    listed = sorted_set("lexeme")
    by_form = lexemes.groupBy(F.col("form").alias("surface")).agg(listed.alias("l")).select("surface", F.size("l").alias("n"), (F.col("l") if sep is None else F.array_join("l", sep)).alias("lexemes"))
    sino = F.col("responsibility") == "historical_kana_sino"
    pattern = F.concat(F.lit("pattern:"), "historical", F.lit(">"), "modern")
    told = records.withColumn("pattern", pattern).join(patterns.select(F.col("id").alias("pattern"), F.lit(True).alias("_known")).distinct(), "pattern", "left")
    excluded, lexical = F.col("disposition") == "excluded_unresolved", F.col("scope") == "lexeme"
    profile = F.col("scope") == "profile"
    lost = F.raise_error(F.concat("id", F.lit(": missing pattern "), "pattern")).cast("string")
    made = (lambda *x: F.array(*x)) if sep is None else (lambda *x: F.array_join(F.array(*x), sep))
    symbol = F.concat(F.lit("symbol:"), "surface")
    own = F.when(sino, made(symbol, F.when(F.col("_known"), F.col("pattern")).otherwise(lost))).otherwise(made(symbol))
    none = F.array().cast("array<string>") if sep is None else F.lit("")
    # What a record's row says of itself is settled before it meets the lexemes; only those that ask for them do.
    head = F.when(profile, "profile_scope").when(excluded, "excluded").when(lexical, None).otherwise("symbol")
    told = told.select("id", head.alias("_head"), F.when(head == "symbol", own).otherwise(none).alias("_own"), F.when(head.isNull(), F.col("surface")).alias("surface"))
    n = F.coalesce("n", F.lit(0))
    bound = F.when(n == 0, "unbound").when(n == 1, "unique").otherwise("homograph")
    j = told.join(by_form, "surface", "left")
    return j.select("id", F.coalesce("_head", bound).alias("status"), F.when(F.col("_head").isNotNull(), F.col("_own")).otherwise(F.coalesce("lexemes", none)).alias("targets"))


def written_forms(words: DataFrame, records: DataFrame, readings: DataFrame) -> DataFrame:
    """surface, reading, status (none, resolved, candidates), basis and candidates
    of words(surface, reading): what records(id, surface, historical, alternatives,
    disposition) say of the form itself, else what they say of a part that begins
    or ends it and whose reading, by readings(form, reading), is that of its place."""
    none = F.array().cast("array<string>")
    own = records.where(F.col("disposition") != "excluded_unresolved").select("surface", "disposition", F.when(F.col("historical").isNotNull(), F.array("historical")).otherwise(F.coalesce("alternatives", none)).alias("c")).where("size(c) > 0")
    told = own.groupBy("surface").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("candidates"), F.bool_and(F.col("disposition") == "admitted").alias("_admitted"))
    told = told.select("surface", "candidates", ((F.size("candidates") == 1) & F.col("_admitted")).alias("exact"))
    cuts = compositions(words.select("surface", "reading"), readings.select(F.col("form").alias("surface"), "reading").distinct())
    heads = cuts.join(told.withColumnsRenamed({"surface": "left"}), "left").select("surface", "reading", F.transform("candidates", lambda c: F.concat(c, F.col("right"))).alias("c"), "exact")
    tails = cuts.join(told.withColumnsRenamed({"surface": "right"}), "right").select("surface", "reading", F.transform("candidates", lambda c: F.concat(F.col("left"), c)).alias("c"), "exact")
    composed = heads.unionByName(tails).groupBy("surface", "reading").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("parts"), F.bool_and("exact").alias("sure"))
    j = words.join(told, "surface", "left").join(composed, ["surface", "reading"], "left")
    one = F.coalesce((F.size("parts") == 1) & F.col("sure"), F.lit(False))
    direct = F.col("candidates").isNotNull()
    status = F.when(direct, F.when(F.col("exact"), "resolved").otherwise("candidates")).when(F.col("parts").isNotNull(), F.when(one, "resolved").otherwise("candidates")).otherwise("none")
    basis = F.when(direct & F.col("exact"), "source_exact").when(~direct & one, "generated_productive_span").when(status != "none", "source_candidates")
    return j.select("surface", "reading", status.alias("status"), basis.alias("basis"), F.coalesce("candidates", "parts", none).alias("candidates"))


def reading_of(form: Column, family: Column) -> Column:
    """The member of a family (parted by ・) that reads a form; null where that is
    open. With kana at its end, the member that shares just that kana, and more of
    the form's end than any other; without, the only member, or the only one that
    begins no other."""
    kana = F.regexp_extract(form, "[ぁ-ゖ]*$", 0)
    members = F.split(family, "・")
    fits = F.filter(members, lambda m: m.endswith(kana) & (F.length(m) > F.length(kana)))
    # A form's last character before its kana is none, so no more than the kana is shared.
    bare = F.filter(members, lambda m: ~F.exists(members, lambda o: (o != m) & o.startswith(m)))
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    return F.when(kana != "", only(fits)).when(F.size(members) == 1, F.get(members, F.lit(0))).otherwise(only(bare))


def period_rules(records: DataFrame) -> DataFrame:
    """record, form, reading, rule_id of records(record, period, family, forms): a
    rule for each form whose reading in the family is clear; the others have null."""
    each = records.select("record", "period", "family", F.explode("forms").alias("form")).withColumn("reading", reading_of(F.col("form"), F.col("family")))
    told = F.to_json(F.array("record", "form"))
    rule = F.when(F.col("reading").isNotNull(), F.concat(F.lit("ir:period:"), "period", F.lit(":"), F.substring(F.sha2(told.cast("binary"), 256), 1, 16)))
    return each.select("record", "form", "reading", rule.alias("rule_id"))


def lexemes_by_reading(asked: DataFrame, readings: DataFrame, heads: DataFrame) -> DataFrame:
    """reading, lexeme, surface of the lexemes that readings(lexeme, surface,
    reading) give asked(reading): the written form is told only if the lexeme's own
    head(lexeme, head_surface, head_reading) names it, or it is the only one."""
    carriers = readings.join(asked.select("reading").distinct(), "reading").groupBy("reading", "lexeme").agg(sorted_set("surface").alias("forms"))
    j = carriers.join(heads, "lexeme", "left")
    named = (F.col("head_reading") == F.col("reading")) & F.array_contains("forms", F.col("head_surface"))
    surface = F.when(named, F.col("head_surface")).when(F.size("forms") == 1, F.get("forms", F.lit(0)))
    return j.select("reading", "lexeme", surface.alias("surface"))


def morphology_row(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The distinct asked(id, lexeme, surface, reading) plus row: the only row of
    rows(row, lexeme, source, surface, reading) in scope from the first source that
    has any (unidic, then jmdict); several decide nothing. A null asks for nothing.

    Rows are first brought down to one for each lexeme, surface and reading, with
    the least and the greatest row of each source: one alone is in scope if both are
    the same over the four kinds of rows (either may ask for nothing). So nothing
    asked for ever meets the rows one by one."""
    row = lambda s: F.when(F.col("source") == s, F.col("row"))
    ends = [(f(row(s)), f"{n}_{s}") for s in ("unidic", "jmdict") for f, n in ((F.min, "a"), (F.max, "b"))]
    known = rows.groupBy("lexeme", F.col("surface").alias("_s"), F.col("reading").alias("_r")).agg(*[c.alias(n) for c, n in ends])
    out = asked.distinct()
    for k, (s, r) in enumerate(((False, False), (True, False), (False, True), (True, True))):
        own = known.where((F.col("_s").isNotNull() == s) & (F.col("_r").isNotNull() == r))
        names = {"lexeme": "lexeme", **({"_s": "surface"} if s else {}), **({"_r": "reading"} if r else {})}
        own = own.select(*[F.col(x).alias(y) for x, y in names.items()], *[F.col(n).alias(f"_{n}_{k}") for _, n in ends])
        out = out.join(own, list(names.values()), "left")
    over = lambda f, n: f(*[F.col(f"_{n}_{k}") for k in range(4)])
    least = {s: over(F.least, f"a_{s}") for s in ("unidic", "jmdict")}
    only = lambda s: F.when(least[s] == over(F.greatest, f"b_{s}"), least[s])
    return out.select(*asked.columns, F.when(least["unidic"].isNotNull(), only("unidic")).otherwise(only("jmdict")).alias("row"))


def display_reading(candidates: DataFrame) -> DataFrame:
    """surface, value, source: the reading to show for a surface with candidates(
    surface, reading, priorities array): the only one that has a priority, else the
    only one; none otherwise."""
    g = candidates.groupBy("surface").agg(F.collect_set("reading").alias("all"), F.collect_set(F.when(F.size("priorities") > 0, F.col("reading"))).alias("first"))
    value = F.when(F.size("first") == 1, F.get("first", F.lit(0))).when(F.size("all") == 1, F.get("all", F.lit(0)))
    return g.select("surface", value.alias("value"), F.when(F.size("first") == 1, "priority").when(F.size("all") == 1, "consensus").alias("source"))


def sino_applies(origin: Column, resolved: Column, components: Column) -> Column:
    """Whether a reconstructed sino reading applies to a candidate: it is of sino
    origin, or the reading is resolved and each component(evidence array) has
    evidence."""
    full = (F.size(components) > 0) & F.forall(components, lambda c: F.coalesce(F.size(c["evidence"]), F.lit(0)) > 0)
    return origin.eqNullSafe("sino") | resolved & F.coalesce(full, F.lit(False))


def route_collisions(native: DataFrame, sino: DataFrame) -> DataFrame:
    """Identities that both routes(identity, reading) claim; there should be none."""
    return native.select("identity", F.col("reading").alias("native")).join(sino.select("identity", F.col("reading").alias("sino")), "identity")


def bound_lexemes(relations: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relations(id, constraint) with the binding ids of their constraint by
    bindings(constraint, binding), and (code, id) of what doesn't fit: a constraint
    without a binding, a binding of no relation's constraint."""
    told = bindings.groupBy("constraint").agg(sorted_set("binding").alias("bindings"))
    out = relations.join(told, "constraint", "left").withColumn("bindings", F.coalesce("bindings", F.array().cast("array<string>")))
    asked = relations.where(F.col("constraint").isNotNull()).select("constraint").distinct()
    faults = R.violations({"unbound_constraint": asked.join(told, "constraint", "left_anti").withColumnRenamed("constraint", "id"), "unused_binding": bindings.join(asked, "constraint", "left_anti").select(F.col("binding").alias("id")).distinct()})
    return out, faults


def safe_characters(pairs: DataFrame) -> DataFrame:
    """source, target and exclusion (null where a pair may be applied) of pairs(
    source, target, evidence array): one character on both sides, not the same, a
    source of one target alone, with evidence."""
    known = pairs.groupBy("source").agg(F.count_distinct("target").alias("_n"))
    one = lambda c: F.length(c) == 1
    why = F.when(~one("source") | ~one("target"), "not_one_character").when(F.col("source") == F.col("target"), "identity").when(F.col("_n") > 1, "ambiguous_source").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no_evidence")
    return pairs.join(known, "source").select("source", "target", why.alias("exclusion"))


def alternate_hits(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """segment and key of segments(segment, alternates array) that one of keys(key,
    contextual) is: any key by the segment itself, one with a context by another
    spelling of it too; each key once."""
    own = segments.select("segment", F.col("segment").alias("key"), F.lit(False).alias("_alt"))
    other = segments.select("segment", F.explode(F.array_distinct("alternates")).alias("key")).where(F.col("key").isNotNull() & (F.col("key") != F.col("segment"))).withColumn("_alt", F.lit(True))
    return own.unionByName(other).join(keys, "key").where(~F.col("_alt") | F.col("contextual")).select("segment", "key").distinct()


def interned(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with the values of string columns as numbers, and the table (column, id,
    value) that they stand for; null stays null. Ids go by value, in its order."""
    from .lexicon import dense_ids

    values_ = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null").distinct()
    table = dense_ids(values_, "column", "value")
    out = df
    for c in columns:
        out = out.join(table.where(F.col("column") == c).select(F.col("value").alias(c), F.col("id").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*df.columns), table


def inflated(compact: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """What interned() was given."""
    out = compact
    for c in columns:
        out = out.join(table.where(F.col("column") == c).select(F.col("id").alias(c), F.col("value").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*compact.columns)
