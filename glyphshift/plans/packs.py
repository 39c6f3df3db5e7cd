"""Queries of pack validation and productive relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ir as IR
from ..operators import matching as M
from ..operators import packs as K
from .registry import query, table, values
from .rewriting import _DECIDED, RULES

_PACK = """src AS (SELECT 's' || s_suppkey % 7 AS id, s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN 'candidate_oracle' ELSE 'book' END AS kind FROM supplier),
ev AS (SELECT 'e' || p_partkey % 150 AS id, p_partkey AS seq, 's' || p_size % 8 AS source, CASE WHEN p_size % 5 = 0 THEN 'note' ELSE 'mapping' END AS type, CASE WHEN p_size % 2 = 0 THEN 'modern_to_historical' ELSE 'historical_to_modern' END AS d, CASE WHEN p_size % 2 = 0 THEN m ELSE g END AS rf, CASE WHEN p_size % 2 = 0 THEN g ELSE m END AS rt, CASE WHEN p_size % 9 = 0 AND p_size % 2 = 1 THEN 'P' END AS pf, CASE WHEN p_size % 9 = 0 AND p_size % 2 = 0 THEN 'P' END AS pt, p_partkey % 2 AS notes FROM (SELECT *, left(p_brand, 1 + p_partkey % 2 * 6) AS m, left(p_type, 1 + p_partkey % 2 * 4) AS g FROM part)),
lx AS (SELECT 'l' || c_custkey % 140 AS id, c_custkey AS seq, 's' || c_nationkey % 9 AS source, ['e' || c_custkey] AS evidence FROM customer), co AS (SELECT 'c' || n_nationkey AS id, n_nationkey AS seq, CASE WHEN n_nationkey % 4 = 0 THEN [] ELSE ['l' || n_nationkey * 7] END AS lexical FROM nation), un AS (SELECT 'u' || n_nationkey AS id, n_nationkey AS seq FROM nation),
re AS (SELECT 'r' || p_partkey % 190 AS id, p_partkey AS seq, 'u' || p_size % 20 AS unit, 'd' AS direction, 'surface' AS channel, left(p_brand, 1 + p_partkey % 2 * 6) AS match, CASE WHEN p_size % 13 = 0 THEN [p_type, p_brand] WHEN p_size % 6 = 1 THEN ['Q' || substring(left(p_brand, 1 + p_partkey % 2 * 6), 2)] ELSE [left(p_type, 1 + p_partkey % 2 * 4)] END AS targets, CASE WHEN p_size % 4 = 0 THEN 'c' || p_partkey % 30 END AS c, ['e' || p_partkey % 160] AS evidence, CASE WHEN p_size % 3 = 0 THEN 'review' ELSE 'admitted' END AS admission FROM part),
sa AS (SELECT 'x' || s_suppkey AS id, s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN 'u' || (s_suppkey + 20) END AS unit, 'c' || s_suppkey * 9 AS c, ['e' || s_suppkey * 20] AS evidence, 'admitted' AS admission FROM supplier), hi AS (SELECT 'h' || o_orderkey % 1400 AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_custkey % 40 END AS c, ['e' || o_custkey] AS evidence FROM orders),
f1 AS (SELECT id, arg_min(kind, seq) AS kind FROM src GROUP BY id), f2 AS (SELECT id, arg_min(struct_pack(source, type, d, rf, rt, pf := coalesce(pf, ''), pt := coalesce(pt, '')), seq) AS r FROM ev GROUP BY id), f3 AS (SELECT DISTINCT id FROM lx),
known AS (SELECT f2.id AS ref, r.type AS type, r.d AS d, r.rf AS rf, r.rt AS rt, nullif(r.pf, '') AS pf, nullif(r.pt, '') AS pt, f1.kind FROM f2 LEFT JOIN f1 ON f1.id = r.source), adm AS (SELECT * FROM re WHERE admission = 'admitted'), one AS (SELECT *, targets[1] AS target, coalesce(c, '') AS cc FROM adm WHERE len(targets) = 1),
cl AS (SELECT one.id, seq, match, target, c, type, d, rf, rt, pf, pt FROM one LEFT JOIN (SELECT * FROM known WHERE type = 'mapping') k ON k.ref = evidence[1]),
ch AS (SELECT id, seq, bool_or(coalesce(d = 'historical_to_modern' AND rf = target AND rt = match, false)) AS rev, bool_or(coalesce(d = 'modern_to_historical' AND rf = match AND rt = target, false)) AS dir FROM cl WHERE length(match) = 1 AND length(target) = 1 AND c IS NULL GROUP BY id, seq),
la AS (SELECT id, match, target, CASE WHEN d = 'modern_to_historical' THEN rf ELSE rt END AS rm, CASE WHEN d = 'modern_to_historical' THEN rt ELSE rf END AS rt_, CASE WHEN d = 'modern_to_historical' THEN pf ELSE pt END AS pm, CASE WHEN d = 'modern_to_historical' THEN pt ELSE pf END AS pt_ FROM cl WHERE type IS NOT NULL),
ly AS (SELECT * FROM la WHERE match = coalesce(pm, rm)), sh AS (SELECT match AS part, cc, list(DISTINCT target) AS ts, list(DISTINCT unit) AS us FROM one GROUP BY ALL),
lo AS (SELECT a.id, a.seq, (length(a.match) - length(replace(a.match, part, ''))) // length(part) AS times_, strpos(a.match, part) AS at_, strpos(substring(a.match, strpos(a.match, part) + 1), part) = 0 AS once, a.match, a.target, a.unit, part, ts, us FROM one a JOIN sh ON sh.cc = a.cc AND length(part) < length(a.match) AND contains(a.match, part) AND len(ts) = 1),
lv AS (SELECT *, once AND left(match, at_ - 1) || ts[1] || substring(match, at_ + length(part)) = target AS derived FROM lo), lg AS (SELECT id, seq, bool_or(derived) AS sure, bool_or(NOT derived AND list_contains(us, unit)) AS open_ FROM lv GROUP BY id, seq)"""


@query(f"""WITH {_PACK}
SELECT code, id, count(*) AS n FROM (SELECT 'E_DUPLICATE_ID' AS code, id FROM src GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'E_DUPLICATE_ID', id FROM ev GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'E_DUPLICATE_ID', id FROM lx GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'E_DUPLICATE_ID', id FROM re GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'E_DUPLICATE_ID', id FROM hi GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM ev WHERE source NOT IN (SELECT id FROM f1) UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM lx WHERE source NOT IN (SELECT id FROM f1) UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM lx WHERE evidence[1] NOT IN (SELECT id FROM f2) UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM re WHERE evidence[1] NOT IN (SELECT id FROM f2) UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM sa WHERE evidence[1] NOT IN (SELECT id FROM f2) UNION ALL SELECT 'E_UNRESOLVED_EVIDENCE', id FROM hi WHERE evidence[1] NOT IN (SELECT id FROM f2)
UNION ALL SELECT 'E_PROJECTION_AUDIT_MISSING', id FROM ev WHERE type = 'mapping' AND (pf IS NOT NULL OR pt IS NOT NULL) AND notes = 0 UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM co WHERE len(lexical) > 0 AND lexical[1] NOT IN (SELECT id FROM f3) UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM re WHERE unit NOT IN (SELECT id FROM un) UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM re WHERE c IS NOT NULL AND c NOT IN (SELECT id FROM co) UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM sa WHERE unit IS NOT NULL AND unit NOT IN (SELECT id FROM un) UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM sa WHERE c NOT IN (SELECT id FROM co) UNION ALL SELECT 'E_DANGLING_LOCAL_REF', id FROM hi WHERE c IS NOT NULL AND c NOT IN (SELECT id FROM co)
UNION ALL SELECT 'E_REQUIRED_LEXICAL_BINDING_MISSING', re.id FROM re JOIN co ON co.id = c WHERE len(list_filter(lexical, lambda x: list_contains((SELECT list(id) FROM f3), x))) = 0 UNION ALL SELECT 'E_SILENT_MULTI_TARGET_COLLAPSE', id FROM adm WHERE len(targets) <> 1 UNION ALL SELECT 'E_DUPLICATE_EXECUTABLE_AUTHORITY', id FROM (SELECT *, min(seq) OVER (PARTITION BY match, cc, target) AS f FROM one) WHERE seq > f
UNION ALL SELECT 'E_ORPHAN_RESTORATION_UNIT', id FROM un WHERE id NOT IN (SELECT unit FROM re) AND id NOT IN (SELECT unit FROM sa WHERE unit IS NOT NULL) UNION ALL SELECT 'E_REVIEW_ONLY_AUTHORITY', id FROM (SELECT adm.id, coalesce(kind = 'candidate_oracle', false) AS o FROM adm JOIN known ON ref = evidence[1]) GROUP BY id HAVING bool_and(o) UNION ALL SELECT 'E_REVIEW_ONLY_AUTHORITY', id FROM (SELECT sa.id, coalesce(kind = 'candidate_oracle', false) AS o FROM sa JOIN known ON ref = evidence[1]) GROUP BY id HAVING bool_and(o)
UNION ALL SELECT CASE WHEN rev AND NOT dir THEN 'E_UNSAFE_SINGLE_CHAR_REVERSE' ELSE 'E_PURE_CHARACTER_CONTAMINATION' END, id FROM ch UNION ALL SELECT CASE WHEN pt_ IS NOT NULL AND pt_ <> rt_ AND target = rt_ THEN 'E_LAYER_LEAKAGE' ELSE 'R_LAYER_LEAKAGE_SUSPECTED' END, id FROM ly WHERE (pt_ IS NOT NULL AND pt_ <> rt_ AND (target = rt_ OR target <> pt_)) OR (pt_ IS NULL AND target <> rt_) UNION ALL SELECT CASE WHEN sure THEN 'E_REDUNDANT_LONGER_RULE' ELSE 'R_REDUNDANT_LONGER_RULE_UNPROVEN' END, id FROM lg WHERE sure OR open_) GROUP BY code, id""".replace("len(list_filter(lexical, lambda x: list_contains((SELECT list(id) FROM f3), x))) = 0", "(len(lexical) = 0 OR lexical[1] NOT IN (SELECT id FROM f3))"))
def c36_pack_validation(spark, sf_dir):
    """A pack's sources, evidence, constraints, relations and safety: fifteen
    codes, two of which ask for a review."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    many = lambda *x: F.array(*x) if x else F.array().cast("array<string>")
    p, key, size = t("part"), F.col("p_partkey"), F.col("p_size")
    match, given = F.expr("left(p_brand, 1 + cast(p_partkey % 2 as int) * 6)"), F.expr("left(p_type, 1 + cast(p_partkey % 2 as int) * 4)")
    even = size % 2 == 0
    s, c, k, o = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey"), F.col("o_orderkey")
    pack = {
        "sources": t("supplier").select(text("s", s % 7).alias("id"), s.alias("seq"), F.when(s % 3 == 0, "candidate_oracle").otherwise("book").alias("kind")),
        "evidence": p.select(text("e", key % 150).alias("id"), key.alias("seq"), text("s", size % 8).alias("source"), F.when(size % 5 == 0, "note").otherwise("mapping").alias("type"), F.when(even, "modern_to_historical").otherwise("historical_to_modern").alias("direction"), F.when(even, match).otherwise(given).alias("raw_from"), F.when(even, given).otherwise(match).alias("raw_to"), F.when((size % 9 == 0) & ~even, "P").alias("projected_from"), F.when((size % 9 == 0) & even, "P").alias("projected_to"), F.when(key % 2 == 1, many(F.lit("n"))).otherwise(many()).alias("notes")),
        "lexical": t("customer").select(text("l", c % 140).alias("id"), c.alias("seq"), text("s", F.col("c_nationkey") % 9).alias("source"), many(text("e", c)).alias("evidence")),
        "constraints": t("nation").select(text("c", k).alias("id"), k.alias("seq"), F.when(k % 4 == 0, many()).otherwise(many(text("l", k * 7))).alias("lexical")), "units": t("nation").select(text("u", k).alias("id"), k.alias("seq")),
        "relations": p.select(text("r", key % 190).alias("id"), key.alias("seq"), text("u", size % 20).alias("unit"), F.lit("d").alias("direction"), F.lit("surface").alias("channel"), match.alias("match"), F.when(size % 13 == 0, many("p_type", "p_brand")).when(size % 6 == 1, many(F.concat(F.lit("Q"), F.substring(match, F.lit(2), F.lit(99))))).otherwise(many(given)).alias("targets"), F.when(size % 4 == 0, text("c", key % 30)).alias("constraint"), many(text("e", key % 160)).alias("evidence"), F.when(size % 3 == 0, "review").otherwise("admitted").alias("admission")),
        "safety": t("supplier").select(text("x", s).alias("id"), s.alias("seq"), F.when(s % 2 == 0, text("u", s + 20)).alias("unit"), text("c", s * 9).alias("constraint"), many(text("e", s * 20)).alias("evidence"), F.lit("admitted").alias("admission")),
        "hints": t("orders").select(text("h", o % 1400).alias("id"), o.alias("seq"), F.when(o % 5 == 0, text("c", F.col("o_custkey") % 40)).alias("constraint"), many(text("e", F.col("o_custkey"))).alias("evidence")),
    }
    return K.pack_faults(pack).groupBy("code", "id").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_DECIDED.replace("(VALUES " + RULES + ")", "(VALUES ('the', 'dhe', 0, false), ('th', 'Þ', 0, false), ('an', 'on', 0, false), ('an', 'en', 0, false), ('er', 'ar', 0, false), ('her', 'her', 1, false), ('tion', 'cion', 0, false))")}
SELECT output, status, count(*) AS n FROM decided GROUP BY output, status""")
def c22_productive_resolution(spark, sf_dir):
    """Productive mappings of one channel; what is to be preserved wins, equal
    spans with several outputs stay open."""
    rel = values(spark, """('mapping','substring_productive','surface',array('the'),array('dhe')), ('mapping','substring_productive','surface',array('th'),array('Þ')), ('mapping','substring_productive','surface',array('an'),array('on')), ('mapping','substring_productive','surface',array('an'),array('en')),
        ('mapping','substring_productive','surface',array('er'),array('ar')), ('preserve','preserve_block','surface',array('her'),array('her')), ('mapping','exact_only','surface',array('of'),array('ouf')), ('mapping','substring_productive','reading',array('in'),array('yn')), ('mapping','substring_productive','surface',array('tion'),array('cion'))""", "kind, mode, channel, from, to")
    docs = table(spark, sf_dir, "documents")
    d = M.arbitrate(docs, M.substring_matches(docs, IR.productive_keys(rel, "surface")))
    return d.where("reason is null or reason not like 'shadowed%'").groupBy("output", "status").agg(F.count("*").alias("n"))
