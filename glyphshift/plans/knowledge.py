"""Queries of knowledge-graph tables, which are made of `part` and its like."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import knowledge as K
from . import inputs as I
from .registry import checkpointed, query, table, values


def _many(*x):
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]) if x else F.array().cast("array<string>")


def _id(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _at(options, k):
    return F.element_at(F.array(*map(F.lit, options)), (k + 1).cast("int"))


@query("""WITH r AS (SELECT 'r' || p_partkey AS id, ['historically_attested', 'project_defined', 'tar', NULL][p_size % 4 + 1] AS origin, p_size % 5 <> 0 AS on_ FROM part)
SELECT profile, id FROM r, (VALUES ('plain', ['r5'], ['r1', 'r2'], ['historically_attested', 'tar', 'project_defined']), ('old', [], ['r3'], ['historically_attested'])) p(profile, enable, disable, origins)
WHERE list_contains(disable, id) OR NOT list_contains(origins, coalesce(origin, 'historically_attested')) OR (NOT on_ AND NOT list_contains(enable, id))""")
def p17_profile_policy(spark, sf_dir):
    """Rules that profiles leave out, by list, origin and default."""
    p = table(spark, sf_dir, "part")
    rules = p.select(_id("r", F.col("p_partkey")).alias("id"), _at(("historically_attested", "project_defined", "tar", None), F.col("p_size") % 4).alias("origin"), (F.col("p_size") % 5 != 0).alias("default_enabled"))
    profiles = values(spark, "('plain', array('r5'), array('r1','r2'), array('historically_attested','tar','project_defined')), ('old', array(), array('r3'), array('historically_attested'))", "profile, enable, disable, origins").withColumn("enable", F.col("enable").cast("array<string>"))
    return K.disabled_rules(rules, profiles)


@query("SELECT 'r' || p_partkey AS id, p_brand AS body FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'r' || p_partkey, p_type FROM part WHERE p_partkey % 3 <> 0 AND p_size % 2 = 0")
def e7_profile_rules(spark, sf_dir):
    """A profile's rules added to those that are there."""
    p = table(spark, sf_dir, "part")
    rule = lambda df, c: df.select(_id("r", F.col("p_partkey")).alias("id"), F.col(c).alias("body"))
    return K.with_rules(rule(p.where("p_partkey % 3 = 0"), "p_brand"), rule(p.where("p_size % 2 = 0 or p_partkey % 3 = 0"), "p_type"))


_GRAPH = """f AS (SELECT 'i' || p_partkey AS id, ['literal_form', 'literal_reading', 'form_relation', 'other'][p_size % 4 + 1] AS kind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS surface, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS reading, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS target,
 CASE WHEN p_partkey % 8 = 0 THEN [] ELSE ['s' || p_partkey % 14] END AS sources, CASE WHEN p_partkey % 9 = 0 THEN [] ELSE ['e'] END AS evidence, CASE WHEN p_partkey % 5 = 0 THEN 'kinotch_derived' END AS origin, CASE WHEN p_partkey % 6 = 0 THEN ['x'] ELSE [] END AS derived, CASE WHEN p_partkey % 10 = 0 THEN 'm' END AS mechanism FROM part),
r AS (SELECT 'i' || (c_custkey + 150) AS id, ['diachronic', 'render', 'nothing'][c_custkey % 3 + 1] AS class, ['forward_only', 'reverse_traversable', 'both'][c_custkey % 7 % 3 + 1] AS dir, ['lossless', 'many_to_one', 'one_to_many', '?'][c_custkey % 4 + 1] AS loss, CASE c_nationkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'b'] END AS f, CASE c_nationkey % 4 WHEN 0 THEN ['c', 'd'] ELSE ['c'] END AS t, CASE WHEN c_custkey % 11 = 0 THEN ['i' || (c_custkey + 155)] ELSE [] END AS deps, ['s' || c_nationkey] AS sources FROM customer),
b AS (SELECT 'b' || s_suppkey AS id, 'i' || (s_suppkey * 60) AS rule FROM supplier), src AS (SELECT 's' || n_nationkey % 12 AS id FROM nation),
d AS (SELECT 'rec' || (o_orderkey - o_orderkey % 2) AS record, ['literal_fact', 'rule_definition', 'rule_binding', 'profile_policy', 'derived_only', 'excluded_with_reason', 'lost'][o_orderkey % 7 + 1] AS disp, CASE o_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['i' || o_custkey] ELSE ['b1', 'i' || (o_custkey * 3)] END AS targets, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'why' END AS reason FROM orders),
known AS (SELECT id, 'fact' AS k FROM f UNION ALL SELECT id, 'rule' FROM r UNION ALL SELECT id, 'binding' FROM b), cited AS (SELECT id, sources FROM f UNION ALL SELECT id, sources FROM r UNION ALL SELECT id, [] FROM b),
aim AS (SELECT record, disp, unnest(targets) AS target FROM d), w AS (SELECT aim.*, k, CASE disp WHEN 'literal_fact' THEN 'fact' WHEN 'rule_definition' THEN 'rule' WHEN 'rule_binding' THEN 'binding' END AS wanted FROM aim LEFT JOIN (SELECT DISTINCT id, k FROM known) ON id = target)"""


@query(f"""WITH {_GRAPH}
SELECT 'duplicate_source' AS code, id FROM src GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_id', id FROM known GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'no_sources', id FROM cited WHERE len(sources) = 0 UNION ALL SELECT 'no_evidence', id FROM f WHERE len(evidence) = 0 UNION ALL SELECT 'no_evidence', id FROM b
UNION ALL SELECT DISTINCT 'unknown_source', id FROM (SELECT id, unnest(sources) AS s FROM cited) WHERE s NOT IN (SELECT id FROM src) UNION ALL SELECT 'unknown_kind', id FROM f WHERE kind = 'other' UNION ALL SELECT 'form_without_surface', id FROM f WHERE kind = 'literal_form' AND surface IS NULL UNION ALL SELECT 'reading_missing', id FROM f WHERE kind = 'literal_reading' AND reading = ''
UNION ALL SELECT 'relation_incomplete', id FROM f WHERE kind = 'form_relation' AND ((surface IS NULL AND reading = '') OR target IS NULL) UNION ALL SELECT 'derived_is_attested', id FROM f WHERE origin IS NULL AND (len(derived) > 0 OR mechanism IS NOT NULL) UNION ALL SELECT 'derivation_missing', id FROM f WHERE origin IS NOT NULL AND (len(derived) = 0 OR mechanism IS NULL)
UNION ALL SELECT 'unknown_class', id FROM r WHERE class = 'nothing' UNION ALL SELECT 'unknown_direction', id FROM r WHERE dir = 'both' UNION ALL SELECT 'unknown_lossiness', id FROM r WHERE loss = '?' UNION ALL SELECT 'forms_missing', id FROM r WHERE len(f) = 0 UNION ALL SELECT 'many_to_one_shape', id FROM r WHERE loss = 'many_to_one' AND (len(f) < 2 OR len(t) <> 1)
UNION ALL SELECT 'many_to_one_reverse', id FROM r WHERE loss = 'many_to_one' AND dir = 'reverse_traversable' UNION ALL SELECT 'one_to_many_shape', id FROM r WHERE loss = 'one_to_many' AND (len(f) <> 1 OR len(t) < 2) UNION ALL SELECT DISTINCT 'missing_dependency', id FROM r WHERE len(deps) > 0 AND deps[1] NOT IN (SELECT id FROM r) UNION ALL SELECT 'missing_rule', id FROM b WHERE rule NOT IN (SELECT id FROM r)
UNION ALL SELECT 'repeated_disposition', record FROM d GROUP BY record HAVING count(*) > 1 UNION ALL SELECT 'unknown_disposition', record FROM d WHERE disp = 'lost' UNION ALL SELECT 'targets_missing', record FROM d WHERE disp IN ('literal_fact', 'rule_definition', 'rule_binding') AND len(targets) = 0 UNION ALL SELECT DISTINCT 'wrong_target', record FROM w WHERE wanted IS NOT NULL AND (k IS NULL OR k <> wanted)
UNION ALL SELECT DISTINCT 'missing_target', record FROM w WHERE disp = 'derived_only' AND k IS NULL UNION ALL SELECT 'reason_missing', record FROM d WHERE disp IN ('derived_only', 'profile_policy', 'excluded_with_reason') AND reason = '' UNION ALL SELECT 'unexpected_targets', record FROM d WHERE disp = 'excluded_with_reason' AND len(targets) > 0""")
def c38_graph_validation(spark, sf_dir):
    """Sources, facts, rules, bindings and dispositions of a graph."""
    t = lambda n: table(spark, sf_dir, n)
    key, size = F.col("p_partkey"), F.col("p_size")
    facts = t("part").select(
        _id("i", key).alias("id"), _at(("literal_form", "literal_reading", "form_relation", "other"), size % 4).alias("kind"), F.when(size % 3 != 0, F.col("p_brand")).alias("surface"), F.when(size % 5 == 0, "").otherwise(F.col("p_type")).alias("reading"), F.when(size % 7 != 0, F.col("p_name")).alias("target"),
        F.when(key % 8 == 0, _many()).otherwise(_many(_id("s", key % 14))).alias("sources"), F.when(key % 9 == 0, _many()).otherwise(_many("e")).alias("evidence"), F.when(key % 5 == 0, "kinotch_derived").alias("origin"), F.when(key % 6 == 0, _many("x")).otherwise(_many()).alias("derived_from"), F.when(key % 10 == 0, "m").alias("mechanism"),
    )
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rules = t("customer").select(
        _id("i", c + 150).alias("id"), _at(("diachronic", "render", "nothing"), c % 3).alias("class"), _at(("forward_only", "reverse_traversable", "both"), c % 7 % 3).alias("directionality"), _at(("lossless", "many_to_one", "one_to_many", "?"), c % 4).alias("lossiness"), F.when(n % 3 == 0, _many()).when(n % 3 == 1, _many("a")).otherwise(_many("a", "b")).alias("from"),
        F.when(n % 4 == 0, _many("c", "d")).otherwise(_many("c")).alias("to"), F.when(c % 11 == 0, _many(_id("i", c + 155))).otherwise(_many()).alias("dependencies"), _many(_id("s", n)).alias("sources"), _many("e").alias("evidence"),
    )
    s, o = F.col("s_suppkey"), F.col("o_orderkey")
    bindings = t("supplier").select(_id("b", s).alias("id"), _id("i", s * 60).alias("rule"), _many().alias("sources"), _many().alias("evidence"))
    k = F.col("o_custkey")
    disp = t("orders").select(_id("rec", o - o % 2).alias("record"), _at(K.DISPOSITIONS[:3] + ("profile_policy", "derived_only", "excluded_with_reason", "lost"), o % 7).alias("disposition"), F.when(k % 3 == 0, _many()).when(k % 3 == 1, _many(_id("i", k))).otherwise(_many("b1", _id("i", k * 3))).alias("targets"), F.when(o % 5 == 0, "").otherwise("why").alias("reason"))
    return K.graph_faults(t("nation").select(_id("s", F.col("n_nationkey") % 12).alias("id")), facts, rules, bindings, disp)


@query("""WITH s AS (SELECT 'c' || p_partkey AS id, p_size % 3 <> 0 AS admitted, p_size % 2 = 0 AS blocks_, CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN [{'p': p_brand, 'r': 'q' || p_size % 10}] ELSE [{'p': p_brand, 'r': 'q' || p_size % 7}, {'p': 'none', 'r': 'q1'}] END AS blocks FROM part), e AS (SELECT DISTINCT p_brand AS p, 'q' || p_size % 5 AS r FROM part),
o AS (SELECT * FROM s WHERE admitted AND blocks_) SELECT 'fallback_missing' AS code, id FROM o WHERE len(blocks) = 0 UNION ALL SELECT 'external_unresolved', id FROM (SELECT id, unnest(blocks) AS b FROM o) WHERE (b.p, b.r) NOT IN (SELECT p, r FROM e)""")
def j16_integration(spark, sf_dir):
    """Relations of other packs that blocks rely on."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    ref = lambda pack, r: F.struct(pack.alias("pack"), _id("q", r).alias("relation"))
    none = F.array().cast("array<struct<pack:string,relation:string>>")
    blocks = F.when(F.col("p_partkey") % 4 == 0, none).when(F.col("p_partkey") % 4 == 1, F.array(ref(F.col("p_brand"), size % 10))).otherwise(F.array(ref(F.col("p_brand"), size % 7), ref(F.lit("none"), F.lit(1))))
    safety = p.select(_id("c", F.col("p_partkey")).alias("id"), F.when(size % 3 != 0, "admitted").otherwise("review").alias("admission"), F.when(size % 2 == 0, "block_fallback").otherwise("preserve_exact").alias("effect"), blocks.alias("blocks"))
    return K.integration_faults(safety, p.select(F.col("p_brand").alias("pack"), _id("q", size % 5).alias("relation")))


@query("SELECT kind, CASE WHEN surface IS NULL AND reading IS NULL THEN 'not_in_pack' WHEN safe THEN 'safety_constraint' WHEN kind = 'form_relation' AND target IS NOT NULL AND surface IS DISTINCT FROM target THEN CASE WHEN ctx THEN 'context_required_only' ELSE 'transform_candidate' END ELSE 'lookup_only' END AS route, count(*) AS n FROM (SELECT ['literal_form', 'form_relation', 'form_relation'][p_partkey % 3 + 1] AS kind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS surface, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END AS reading, CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 5 = 1 THEN NULL ELSE p_name END AS target, p_size % 7 = 0 AS safe, p_size % 4 = 1 AS ctx FROM part) GROUP BY ALL")
def a16_fact_routes(spark, sf_dir):
    """Each fact goes one way."""
    size = F.col("p_size")
    tags = F.array_compact(F.array(F.when(size % 7 == 0, "safety:x"), F.when(size % 4 == 1, "context:y"), F.lit("src")))
    f = table(spark, sf_dir, "part").select(_at(("literal_form", "form_relation", "form_relation"), F.col("p_partkey") % 3).alias("kind"), F.when(size % 3 != 0, F.col("p_brand")).alias("surface"), F.when(size % 2 != 0, F.col("p_type")).alias("reading"), F.when(size % 5 == 0, F.col("p_brand")).when(size % 5 != 1, F.col("p_name")).alias("target"), tags.alias("tags"))
    return f.groupBy("kind", K.fact_route(*[F.col(c) for c in ("kind", "surface", "reading", "target", "tags")]).alias("route")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'rule' ELSE 'fact' END AS kind, ['s' || p_partkey % 6, 's1'] AS sources FROM part), d AS (SELECT 'src' || l_suppkey || '#' || l_linenumber AS record, l_returnflag AS disposition, 'p' || l_partkey AS id FROM lineitem WHERE l_partkey % 4 <> 0),
b AS (SELECT 'p' || p_partkey AS id, 'p' || (p_partkey - p_partkey % 4) AS rule FROM part WHERE p_partkey % 4 = 1), l AS (SELECT id, record, disposition FROM d UNION ALL SELECT rule, record, disposition FROM b JOIN d USING (id) JOIN i ON i.id = rule WHERE kind = 'rule' AND rule NOT IN (SELECT id FROM d)),
g AS (SELECT id, count(DISTINCT record) AS records, string_agg(DISTINCT disposition, ',' ORDER BY disposition) AS dispositions, list(DISTINCT split_part(record, '#', 1)) AS snaps FROM l GROUP BY id)
SELECT id, kind, CAST(coalesce(g.records, len(list_filter(list_distinct(sources), lambda s: s <= 's4'))) AS BIGINT) AS records, coalesce(dispositions, '') AS dispositions, array_to_string(list_sort(list_distinct(list_concat(coalesce(snaps, []), list_filter(sources, lambda s: s <= 's4')))), ',') AS snapshots, CAST(1 + CAST(substring(id, 2) AS BIGINT) % 2 AS BIGINT) AS programs FROM i LEFT JOIN g USING (id)""")
def c42_evidence_map(spark, sf_dir):
    """What each canonical item rests on, and which programs name it."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    items = p.select(_id("p", key).alias("id"), F.when(F.col("p_size") % 3 == 0, "rule").otherwise("fact").alias("kind"), _many(_id("s", key % 6), "s1").alias("sources"))
    disp = table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select(F.concat(_id("src", F.col("l_suppkey")), _id("#", F.col("l_linenumber"))).alias("record"), F.col("l_returnflag").alias("disposition"), _many(_id("p", F.col("l_partkey"))).alias("targets"))
    bindings = p.where("p_partkey % 4 = 1").select(_id("p", key).alias("id"), _id("p", key - key % 4).alias("rule"))
    programs = p.select(key.alias("program"), _many(_id("p", key)).alias("canonical")).unionByName(p.where("p_partkey % 2 = 1").select((key + 1_000_000).alias("program"), _many(_id("p", key)).alias("canonical")))
    e = K.evidence_entries(items, disp, values(spark, "('s0'), ('s1'), ('s2'), ('s3'), ('s4')", "id"), programs, bindings)
    return e.select("id", "kind", F.size("records").cast("long").alias("records"), F.array_join("dispositions", ",").alias("dispositions"), F.array_join("snapshots", ",").alias("snapshots"), F.size("programs").cast("long").alias("programs"))


@query("""WITH r AS (SELECT o_orderkey AS id, ['lexeme', 'profile', 'symbol', 'lexeme'][o_orderkey % 4 + 1] AS scope, CASE WHEN o_orderkey % 9 = 0 THEN 'excluded_unresolved' ELSE 'admitted' END AS disposition, o_orderkey % 6 = 2 AS sino, o_orderpriority AS surface, 'm' || o_custkey % 5 AS modern FROM orders),
l AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT' WHEN c_custkey = 1 THEN '2-HIGH' ELSE c_mktsegment END AS form, 'x' || c_custkey AS lexeme FROM customer), g AS (SELECT form, list_sort(list(DISTINCT lexeme)) AS lexemes FROM l GROUP BY form)
SELECT id, CASE WHEN scope = 'profile' THEN 'profile_scope' WHEN disposition = 'excluded_unresolved' THEN 'excluded' WHEN scope = 'lexeme' THEN CASE coalesce(len(lexemes), 0) WHEN 0 THEN 'unbound' WHEN 1 THEN 'unique' ELSE 'homograph' END ELSE 'symbol' END AS status,
CASE WHEN scope = 'profile' OR disposition = 'excluded_unresolved' THEN '' WHEN scope = 'lexeme' THEN coalesce(array_to_string(lexemes, '|'), '') WHEN sino THEN 'symbol:' || surface || '|pattern:h>' || modern ELSE 'symbol:' || surface END AS targets FROM r LEFT JOIN g ON form = surface""")
def j9_authority_join(spark, sf_dir):
    """Source records bound to lexemes, symbols or a profile."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    records = table(spark, sf_dir, "orders").select(o.alias("id"), _at(("lexeme", "profile", "symbol", "lexeme"), o % 4).alias("scope"), F.when(o % 9 == 0, "excluded_unresolved").otherwise("admitted").alias("disposition"), F.when(o % 6 == 2, "historical_kana_sino").otherwise("form").alias("responsibility"), F.col("o_orderpriority").alias("surface"), _id("m", F.col("o_custkey") % 5).alias("modern"), F.lit("h").alias("historical"))
    lexemes = table(spark, sf_dir, "customer").select(F.when(c % 3 == 0, "1-URGENT").when(c == 1, "2-HIGH").otherwise(F.col("c_mktsegment")).alias("form"), _id("x", c).alias("lexeme"))
    patterns = table(spark, sf_dir, "nation").select(_id("pattern:h>m", F.col("n_nationkey") % 5).alias("id"))
    return K.authority_join(records, lexemes, patterns, "|")


@query(f"""WITH {I.WORDS}, r AS (SELECT w AS surface, CASE WHEN unicode(w) % 3 = 0 THEN 'H' || w END AS h, CASE WHEN unicode(w) % 3 = 1 THEN ['A' || w, 'B' || w] ELSE [] END AS alt, ['admitted', 'review', 'excluded_unresolved'][length(w) % 3 + 1] AS d FROM words WHERE length(w) <= 4),
t AS (SELECT surface, CASE WHEN h IS NOT NULL THEN [h] ELSE alt END AS c, d = 'admitted' AND h IS NOT NULL AS exact FROM r WHERE d <> 'excluded_unresolved' AND (h IS NOT NULL OR len(alt) > 0)),
p AS (SELECT w FROM words WHERE length(w) <= 4), cut AS (SELECT w, left(w, CAST(i AS INTEGER)) AS a, substring(w, CAST(i AS INTEGER) + 1) AS b FROM (SELECT w, unnest(generate_series(1, length(w) - 1)) AS i FROM words) WHERE left(w, CAST(i AS INTEGER)) IN (SELECT w FROM p) AND substring(w, CAST(i AS INTEGER) + 1) IN (SELECT w FROM p)),
f AS (SELECT w, unnest(list_transform(c, lambda x: x || b)) AS c, exact FROM cut JOIN t ON surface = a UNION ALL SELECT w, unnest(list_transform(c, lambda x: a || x)), exact FROM cut JOIN t ON surface = b),
g AS (SELECT w, list_sort(list(DISTINCT c)) AS parts, bool_and(exact) AS sure FROM f GROUP BY w)
SELECT words.w AS surface, CASE WHEN t.c IS NOT NULL THEN CASE WHEN exact THEN 'resolved' ELSE 'candidates' END WHEN parts IS NOT NULL THEN CASE WHEN len(parts) = 1 AND sure THEN 'resolved' ELSE 'candidates' END ELSE 'none' END AS status,
CASE WHEN t.c IS NOT NULL THEN CASE WHEN exact THEN 'source_exact' ELSE 'source_candidates' END WHEN parts IS NOT NULL THEN CASE WHEN len(parts) = 1 AND sure THEN 'generated_productive_span' ELSE 'source_candidates' END END AS basis, coalesce(array_to_string(coalesce(t.c, parts), '|'), '') AS candidates FROM words LEFT JOIN t ON t.surface = words.w LEFT JOIN g ON g.w = words.w""")
def j8_written_forms(spark, sf_dir):
    """A form's own authority, else what its parts lend it."""
    w, n = F.col("w"), F.length("w")
    d = I.words(spark, sf_dir)
    first = F.ascii(w) % 3
    records = d.where(n <= 4).select(w.alias("id"), w.alias("surface"), F.when(first == 0, F.concat(F.lit("H"), w)).alias("historical"), F.when(first == 1, F.array(F.concat(F.lit("A"), w), F.concat(F.lit("B"), w))).alias("alternatives"), _at(("admitted", "review", "excluded_unresolved"), n % 3).alias("disposition"))
    known = d.where(n <= 4).select(w.alias("form"), w.alias("reading"))
    out = K.written_forms(d.select(w.alias("surface"), w.alias("reading")), records, known)
    return out.select("surface", "status", "basis", F.array_join("candidates", "|").alias("candidates"))


_FAMILY = "CASE length(w) % 4 WHEN 0 THEN k || 'る' WHEN 1 THEN k || 'る・' || k || 'す' WHEN 2 THEN k || '・' || k || 'る' ELSE k || 'う・' || 'か' || k || 'う' END"


@query(f"""WITH {I.WORDS}, r AS (SELECT w, {I.spelt_sql('w', I.HAN)} AS h, replace({I.spelt_sql('w', I.READ)}, 'ー', 'あ') AS k FROM words), x AS (SELECT w, {_FAMILY} AS family, unnest([h || 'る', h, h || 'う']) AS form, k FROM r)
SELECT w AS record, form, CASE WHEN ends_with(form, 'る') THEN CASE WHEN length(w) % 4 IN (0, 1, 2) THEN k || 'る' END WHEN ends_with(form, 'う') THEN CASE WHEN length(w) % 4 = 2 AND ends_with(k, 'う') AND length(k) > 1 THEN k END ELSE CASE length(w) % 4 WHEN 0 THEN k || 'る' WHEN 1 THEN NULL WHEN 2 THEN k || 'る' ELSE NULL END END AS reading FROM x""")
def c45_period_rules(spark, sf_dir):
    """Forms aligned with the readings of their family; open ones kept."""
    w, n = F.col("w"), F.length("w")
    k = F.regexp_replace(I.spelt(w, I.READ), "ー", "あ")
    h = I.spelt(w, I.HAN)
    family = F.when(n % 4 == 0, F.concat(k, F.lit("る"))).when(n % 4 == 1, F.concat(k, F.lit("る・"), k, F.lit("す"))).when(n % 4 == 2, F.concat(k, F.lit("・"), k, F.lit("る"))).otherwise(F.concat(k, F.lit("う・か"), k, F.lit("う")))
    records = I.words(spark, sf_dir).select(w.alias("record"), F.lit("2014").alias("period"), family.alias("family"), F.array(F.concat(h, F.lit("る")), h, F.concat(h, F.lit("う"))).alias("forms"))
    return K.period_rules(records).where("(reading is null) = (rule_id is null)").select("record", "form", "reading")


@query("""WITH r AS (SELECT p_size AS lexeme, p_brand AS surface, split_part(p_type, ' ', 1) AS reading FROM part), h AS (SELECT p_size AS lexeme, min(p_brand) AS hs, min(split_part(p_type, ' ', 1)) AS hr FROM part GROUP BY p_size), g AS (SELECT reading, lexeme, list_sort(list(DISTINCT surface)) AS forms FROM r GROUP BY ALL)
SELECT reading, CAST(lexeme AS BIGINT) AS lexeme, CASE WHEN hr = reading AND list_contains(forms, hs) THEN hs WHEN len(forms) = 1 THEN forms[1] END AS surface FROM g JOIN h USING (lexeme)""")
def j2_reading_lookup(spark, sf_dir):
    """Lexemes by reading; a written form only where it is told."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("lexeme"), F.col("p_brand").alias("surface"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("reading"))
    heads = p.groupBy("lexeme").agg(F.min("surface").alias("head_surface"), F.min("reading").alias("head_reading"))
    return K.lexemes_by_reading(p.select("reading"), p, heads)


@query("""WITH m AS (SELECT p_partkey AS row, p_size AS lexeme, CASE WHEN p_partkey % 3 = 0 THEN 'unidic' ELSE 'jmdict' END AS source, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS s, CASE WHEN p_partkey % 5 = 0 THEN 'r' || p_size % 4 END AS r FROM part), a AS (SELECT c_custkey AS id, c_nationkey + 1 AS lexeme, 'Brand#' || (c_custkey % 5 + 1) || (c_nationkey % 5 + 1) AS surface, CASE WHEN c_custkey % 4 <> 0 THEN 'r' || c_custkey % 4 END AS reading FROM customer),
g AS (SELECT id, count(*) FILTER (source = 'unidic') AS u, max(row) FILTER (source = 'unidic') AS ur, count(*) FILTER (source = 'jmdict') AS j, max(row) FILTER (source = 'jmdict') AS jr FROM a JOIN m ON m.lexeme = a.lexeme AND (s IS NULL OR s IS NOT DISTINCT FROM surface) AND (r IS NULL OR r IS NOT DISTINCT FROM reading) GROUP BY id)
SELECT id, CASE WHEN u > 0 THEN CASE WHEN u = 1 THEN ur END WHEN j = 1 THEN jr END AS row FROM a LEFT JOIN g USING (id)""")
def f36_morphology_row(spark, sf_dir):
    """the only row in scope of the first source that has any."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("row"), F.col("p_size").cast("long").alias("lexeme"), F.when(k % 3 == 0, "unidic").otherwise("jmdict").alias("source"), F.when(k % 2 == 0, F.col("p_brand")).alias("surface"), F.when(k % 5 == 0, _id("r", F.col("p_size") % 4)).alias("reading"))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("id"), (n + 1).cast("long").alias("lexeme"), F.concat(F.lit("Brand#"), (c % 5 + 1).cast("string"), (n % 5 + 1).cast("string")).alias("surface"), F.when(c % 4 != 0, _id("r", c % 4)).alias("reading"))
    return K.morphology_row(asked, rows).select("id", "row")


@query("SELECT p_brand AS surface, CASE WHEN count(DISTINCT p_type) FILTER (p_size % 9 = 0) = 1 THEN max(p_type) FILTER (p_size % 9 = 0) WHEN count(DISTINCT p_type) = 1 THEN max(p_type) END AS value, CASE WHEN count(DISTINCT p_type) FILTER (p_size % 9 = 0) = 1 THEN 'priority' WHEN count(DISTINCT p_type) = 1 THEN 'consensus' END AS source FROM part GROUP BY p_brand")
def f34_display_reading(spark, sf_dir):
    """the reading that alone has a priority, or is alone."""
    return K.display_reading(table(spark, sf_dir, "part").select(F.col("p_brand").alias("surface"), F.col("p_type").alias("reading"), F.when(F.col("p_size") % 9 == 0, _many("news1")).otherwise(_many()).alias("priorities")))


@query("SELECT p_partkey AS id, p_size % 3 = 0 OR (p_size % 2 = 0 AND p_partkey % 4 <> 0) AS applies FROM part")
def c29_sino_applicability(spark, sf_dir):
    """By origin, or resolved with evidence for every component."""
    none = F.array().cast("array<string>")
    part = lambda e: F.struct(F.when(e, _many("e")).otherwise(none).alias("evidence"))
    k = F.col("p_partkey")
    parts = F.array(part(k % 4 != 0), part(F.lit(True)))
    return table(spark, sf_dir, "part").select(k.alias("id"), K.sino_applies(F.when(F.col("p_size") % 3 == 0, "sino").otherwise("native"), F.col("p_size") % 2 == 0, parts).alias("applies"))


@query("SELECT DISTINCT a.s_name AS identity, a.s_nationkey AS native, b.s_suppkey AS sino FROM supplier a JOIN supplier b ON b.s_name = a.s_name WHERE a.s_suppkey % 2 = 0 AND b.s_suppkey % 3 = 0")
def j22_route_collisions(spark, sf_dir):
    """Identities that two routes claim."""
    s = table(spark, sf_dir, "supplier")
    return K.route_collisions(s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("identity"), F.col("s_nationkey").alias("reading")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("identity"), F.col("s_suppkey").alias("reading")))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'k' || p_size END AS c FROM part), b AS (SELECT 'k' || s_suppkey AS c, 'b' || s_nationkey AS b FROM supplier), g AS (SELECT c, string_agg(DISTINCT b, '|' ORDER BY b) AS b FROM b GROUP BY c)
SELECT 'bound' AS code, CAST(id AS VARCHAR) AS id, coalesce(g.b, '') AS bindings FROM r LEFT JOIN g USING (c) UNION ALL SELECT 'unbound_constraint', c, '' FROM (SELECT DISTINCT c FROM r WHERE c IS NOT NULL) WHERE c NOT IN (SELECT c FROM b) UNION ALL SELECT DISTINCT 'unused_binding', b, '' FROM b WHERE c NOT IN (SELECT c FROM r WHERE c IS NOT NULL)""")
def j20_lexical_bindings(spark, sf_dir):
    """Relations with the bindings of their constraint, and what is left over."""
    rel = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 4 != 0, _id("k", F.col("p_size"))).alias("constraint"))
    out, faults = K.bound_lexemes(rel, table(spark, sf_dir, "supplier").select(_id("k", F.col("s_suppkey")).alias("constraint"), _id("b", F.col("s_nationkey")).alias("binding")))
    return out.select(F.lit("bound").alias("code"), "id", F.array_join("bindings", "|").alias("bindings")).unionByName(faults.withColumn("bindings", F.lit("")))


@query(f"""WITH {I.WORDS}, p AS (SELECT DISTINCT left(w, 1 + length(w) % 2) AS s, {I.spelt_sql('right(w, 1)', I.HAN)} AS t, length(w) % 3 <> 0 AS e FROM words UNION SELECT DISTINCT left(w, 1), left(w, 1), true FROM words WHERE length(w) = 2),
g AS (SELECT s, t, bool_or(e) AS e FROM p GROUP BY ALL) SELECT s AS source, t AS target, CASE WHEN length(s) <> 1 THEN 'not_one_character' WHEN s = t THEN 'identity' WHEN count(*) OVER (PARTITION BY s) > 1 THEN 'ambiguous_source' WHEN NOT e THEN 'no_evidence' END AS exclusion FROM g""")
def c47_safe_characters(spark, sf_dir):
    """Pairs of characters that may be applied, and why others may not."""
    w, n = F.col("w"), F.length("w")
    d = I.words(spark, sf_dir)
    pairs = d.select(F.left(w, 1 + n % 2).alias("source"), I.spelt(F.right(w, F.lit(1)), I.HAN).alias("target"), (n % 3 != 0).alias("e")).unionByName(d.where(n == 2).select(F.left(w, F.lit(1)).alias("source"), F.left(w, F.lit(1)).alias("target"), F.lit(True).alias("e")))
    g = pairs.groupBy("source", "target").agg(F.bool_or("e").alias("e")).select("source", "target", F.when(F.col("e"), _many("x")).otherwise(_many()).alias("evidence"))
    return K.safe_characters(g)


@query(f"""WITH {I.WORDS}, s AS (SELECT w AS segment, [upper(w), reverse(w), left(w, length(w) - 1)] AS alts FROM words), k AS (SELECT w AS key, length(w) % 2 = 0 AS c FROM words WHERE length(w) <= 5),
a AS (SELECT segment, segment AS key, false AS alt FROM s UNION ALL SELECT DISTINCT segment, unnest(alts), true FROM s) SELECT DISTINCT segment, a.key FROM a JOIN k USING (key) WHERE NOT alt OR (c AND segment <> a.key)""")
def j5_alternate_spellings(spark, sf_dir):
    """Keys met by other spellings of a segment, where they have a context."""
    w = F.col("w")
    d = I.words(spark, sf_dir)
    segments = d.select(w.alias("segment"), F.array(F.upper(w), F.reverse(w), F.left(w, F.length(w) - 1)).alias("alternates"))
    return K.alternate_hits(segments, d.where("length(w) <= 5").select(w.alias("key"), (F.length(w) % 2 == 0).alias("contextual")))


@query("SELECT doc_id, lang, source FROM documents")
def k6_compact_roundtrip(spark, sf_dir):
    """K6: columns interned in one table of values, and inflated again."""
    checkpointed(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    compact, told = K.interned(d, ["lang", "source"])
    return K.inflated(compact, told, ["lang", "source"])


@query("SELECT event_id, sha256('{' || array_to_string(list_transform(list_sort(json_keys(j)), lambda k: chr(34) || k || chr(34) || ':' || CAST(json_extract(j, '$.' || k) AS VARCHAR)), ',') || '}') AS digest FROM (SELECT event_id, json_object('z', event_id, 'b', event_type, 'a', user_id) AS j FROM events)")
def f43_canonical_json(spark, sf_dir):
    """keys sorted at every depth, and the digest of that."""
    j = F.to_json(F.struct(F.col("event_id").alias("z"), F.col("event_type").alias("b"), F.col("user_id").alias("a")))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(strings.canonical_json(j).cast("binary"), 256).alias("digest"))


@query("SELECT p_partkey AS id, replace(replace(replace(replace(replace(url_encode(p_name || ' (' || p_type || ')~*' || chr(39) || '!é/'), '%28', '('), '%29', ')'), '%2A', '*'), '%27', chr(39)), '%21', '!') AS part FROM part")
def f42_stable_ids(spark, sf_dir):
    """texts as parts of ids."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), strings.stable_id_part(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")~*'!é/"))).alias("part"))
