"""Queries of lexical lookup and resolution. Words of `documents` and names of
`nation` and `customer` serve as a lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import lexicon as L
from ..operators import projection as P
from ..operators import readings as RD
from . import inputs as I
from .registry import checkpointed, query, table, values


@query("""SELECT w.word, count(l.value) AS n_found, CASE WHEN count(l.value) = 1 THEN max(l.value) END AS value FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents) w
LEFT JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word, p_brand AS value FROM part UNION SELECT DISTINCT source, lang FROM documents UNION SELECT 'the', 'a' UNION SELECT 'the', 'b' UNION SELECT 'and', 'c') l USING (word) GROUP BY w.word""")
def j1_surface_lookup(spark, sf_dir):
    """Unique, several or none."""
    d = table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    p = table(spark, sf_dir, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"), F.col("p_brand").alias("value"))
    lexicon = p.unionByName(d.select(F.col("source").alias("word"), F.col("lang").alias("value")).distinct()).unionByName(values(spark, "('the','a'), ('the','b'), ('and','c')", "word, value"))
    return L.lookup(words, lexicon, "word").select("word", F.col("n_found").cast("long").alias("n_found"), "value")


@query("""WITH f AS (SELECT p_partkey AS entry, p_brand AS form, true AS kanji FROM part UNION ALL SELECT p_partkey, p_name, false FROM part),
r AS (SELECT p_partkey AS entry, split_part(p_type, ' ', 1) AS reading, CASE WHEN p_size % 3 = 0 THEN [p_brand] ELSE CAST([] AS VARCHAR[]) END AS restricted, p_size % 5 = 0 AS nokanji FROM part UNION ALL SELECT p_partkey, split_part(p_type, ' ', 2), CAST([] AS VARCHAR[]), false FROM part)
SELECT entry, form, reading FROM f JOIN r USING (entry) WHERE (len(restricted) = 0 OR list_contains(restricted, form)) AND NOT (nokanji AND kanji)""")
def j10_restricted_readings(spark, sf_dir):
    """Readings of some forms alone, and readings of no form in ideographs."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entry")
    forms = p.select("entry", F.col("p_brand").alias("form"), F.lit(True).alias("kanji")).unionByName(p.select("entry", F.col("p_name").alias("form"), F.lit(False).alias("kanji")))
    none = F.array().cast("array<string>")
    first = p.select("entry", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("reading"), F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).otherwise(none).alias("restricted"), (F.col("p_size") % 5 == 0).alias("nokanji"))
    second = p.select("entry", F.split_part("p_type", F.lit(" "), F.lit(2)).alias("reading"), none.alias("restricted"), F.lit(False).alias("nokanji"))
    return L.admitted_readings(forms, first.unionByName(second)).select("entry", "form", "reading")


@query("""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]{2,8}')),
p AS (SELECT word FROM w WHERE length(word) <= 4)
SELECT surface, surface AS reading, "left", "right" FROM (SELECT word AS surface, left(word, CAST(i AS INTEGER)) AS "left", substring(word, CAST(i AS INTEGER) + 1) AS "right" FROM (SELECT word, unnest(generate_series(1, length(word) - 1)) AS i FROM w)) WHERE "left" IN (SELECT word FROM p) AND "right" IN (SELECT word FROM p)""")
def j7_compositions(spark, sf_dir):
    """Words that two known words make."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("surface")).where(F.col("surface").rlike("^[a-z]{2,8}$")).distinct()
    w = w.withColumn("reading", F.col("surface"))
    return L.compositions(w, w.where(F.length("surface") <= 4))


_SINO = "('月','がつ',null,'ぐわつ'), ('月','がつ','x','ぐゑつ'), ('亜','あ',null,'わ'), ('亜','あ',null,'ゑ'), ('字','さ','x','しや'), ('火','か',null,'くわ'), ('田','た',null,'たふ'), ('江','え',null,'ゑ'), ('森','え','y','ゑ'), ('森','え','x','ゐえ')"
_CONTEXT = "CASE length(w) % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END"


def _sino(spark):
    r = values(spark, _SINO, "character, modern, context, historical")
    return r.withColumn("context", F.col("context").cast("string"))


@query(f"""WITH RECURSIVE {I.WORDS}, rel(character, modern, context, historical) AS (VALUES {_SINO}),
base AS (SELECT * FROM rel UNION SELECT character, left(modern, length(modern) - 1) || 'っ', context, historical FROM rel WHERE right(modern, 1) IN ('く', 'き', 'ち', 'つ')
  UNION SELECT character, translate(left(historical, length(historical) - 1), 'ゐゑをぢづ', 'いえおじず') || 'っ', context, left(historical, length(historical) - 1) || 'っ' FROM rel WHERE ends_with(historical, 'ふ')),
forms AS (SELECT * FROM base UNION SELECT character, translate(left(modern, 1), 'かきくけこさしすせそたちつてとはひふへほ', 'がぎぐげござじずぜぞだぢづでどばびぶべぼ') || substring(modern, 2), context, translate(left(historical, 1), 'かきくけこさしすせそたちつてとはひふへほ', 'がぎぐげござじずぜぞだぢづでどばびぶべぼ') || substring(historical, 2) FROM base WHERE contains('かきくけこさしすせそたちつてとはひふへほ', left(modern, 1)) AND contains('かきくけこさしすせそたちつてとはひふへほ', left(historical, 1))),
q AS (SELECT w, {I.spelt_sql('w', I.HAN)} AS s, replace({I.spelt_sql('w', I.READ)}, 'つ', 'がつ') AS r, length(w) % 4 = 0 AS anyc, {_CONTEXT} AS c FROM words),
seg AS (SELECT w, i, a0, n, substring(s, i, 1) AS ch, substring(r, a0 + 1, n) AS seg, anyc, c FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM (SELECT *, unnest(range(0, length(r))) AS a0 FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM q))) WHERE a0 + n <= length(r) AND a0 >= i - 1 AND a0 <= 2 * (i - 1) AND regexp_full_match(substring(r, a0 + 1, n), '[ぁ-ゔ][ゃゅょゎ]?[いうくきちつんっ]?')),
hit AS (SELECT seg.*, f.historical, f.context, f.character IS NOT NULL AS known FROM seg LEFT JOIN forms f ON f.character = ch AND f.modern = seg),
chosen AS (SELECT w, i, a0, n, known, seg, historical, anyc OR NOT known OR context IS NOT DISTINCT FROM c AS exact, context IS NULL AS plain, bool_or(known AND context IS NOT DISTINCT FROM c) OVER p AS any_exact, bool_or(known AND context IS NOT NULL) OVER p AS any_context, anyc FROM hit WINDOW p AS (PARTITION BY w, i, a0, n)),
opt AS (SELECT DISTINCT w, i, a0, a0 + n AS upto, CASE WHEN known THEN historical ELSE seg END AS h FROM chosen WHERE CASE WHEN NOT known THEN NOT ends_with(seg, 'っ') WHEN anyc THEN true WHEN any_exact THEN exact WHEN any_context THEN false ELSE plain END),
walk AS (SELECT w, 0 AS i, 0::BIGINT AS a0, '' AS h FROM q UNION SELECT o.w, walk.i + 1, o.upto, walk.h || o.h FROM walk JOIN opt o ON o.w = walk.w AND o.i = walk.i + 1 AND o.a0 = walk.a0),
done AS (SELECT q.w, count(DISTINCT h) AS n, string_agg(DISTINCT h, '|' ORDER BY h) AS found FROM walk JOIN q ON q.w = walk.w AND walk.i = length(q.s) AND walk.a0 = length(q.r) GROUP BY q.w)
SELECT q.w, CASE WHEN n IS NULL OR n > 64 THEN 'none' WHEN n = 1 THEN 'resolved' ELSE 'candidates' END AS status, CASE WHEN n <= 64 THEN found ELSE '' END AS spellings FROM q LEFT JOIN done USING (w)""")
def c17_component_spellings(spark, sf_dir):
    """Spellings of whole words by their characters' readings and
    the forms that these take inside a word; more than 64 leave it unresolved."""
    w, n = F.col("w"), F.length("w")
    words = I.words(spark, sf_dir).select("w", I.spelt(w, I.HAN).alias("surface"), F.replace(I.spelt(w, I.READ), F.lit("つ"), F.lit("がつ")).alias("reading"), (n % 4 == 0).alias("any_context"), F.when(n % 4 == 1, "x").when(n % 4 == 2, "y").alias("context"))
    return RD.reconstructed(words, _sino(spark)).select("w", "status", F.array_join("spellings", "|").alias("spellings"))


@query("""WITH rel AS (SELECT p_brand AS character, p_size % 10 AS modern, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'c' || p_partkey % 3 END AS context, p_type AS historical FROM part),
asked AS (SELECT s_suppkey AS id, 'Brand#' || (s_nationkey % 5 + 1) || (s_suppkey % 5 + 1) AS character, s_suppkey % 10 AS modern, s_suppkey % 2 = 0 AS any_context, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'c' || s_suppkey % 3 END AS context FROM supplier),
g AS (SELECT id, count(DISTINCT historical) AS n, string_agg(DISTINCT historical, '|' ORDER BY historical) AS r FROM asked a JOIN rel USING (character, modern) WHERE any_context OR a.context IS NOT DISTINCT FROM rel.context GROUP BY id)
SELECT id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'resolved' ELSE 'candidates' END AS status, coalesce(r, '') AS readings FROM asked LEFT JOIN g USING (id)""")
def c18_direct_lookup(spark, sf_dir):
    """Readings of a character in every, in one or in no context."""
    k = lambda c: F.when(F.col(c) % 3 != 0, F.concat(F.lit("c"), (F.col(c) % 3).cast("string")))
    rel = table(spark, sf_dir, "part").select(F.col("p_brand").alias("character"), (F.col("p_size") % 10).cast("long").alias("modern"), k("p_partkey").alias("context"), F.col("p_type").alias("historical"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 5 + 1).cast("string"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), brand.alias("character"), (F.col("s_suppkey") % 10).cast("long").alias("modern"), (F.col("s_suppkey") % 2 == 0).alias("any_context"), k("s_suppkey").alias("context"))
    return RD.direct(asked, rel).select("id", "status", F.array_join("readings", "|").alias("readings"))


@query("""WITH words AS (SELECT c_custkey AS id, c_mktsegment AS surface, CASE c_custkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['b' || c_nationkey % 5] WHEN 2 THEN ['b' || c_nationkey % 5, 'b' || c_nationkey % 7] ELSE ['b1', 'b2'] END AS viable FROM customer),
rel AS (SELECT c_mktsegment AS surface, n_name AS target, CASE WHEN n_nationkey % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['b' || n_nationkey % 7] END AS bindings, n_nationkey % 8 = 5 AS preserve, n_nationkey % 3 = 0 AS candidate FROM nation JOIN (SELECT DISTINCT c_mktsegment FROM customer) ON length(c_mktsegment) = length(n_name)),
hit AS (SELECT w.id, w.viable, r.*, len(bindings) = 0 OR list_has_any(bindings, viable) AS ok FROM words w JOIN rel r USING (surface)),
g AS (SELECT id, bool_or(ok AND preserve) AS keep, list_sort(list(DISTINCT target) FILTER (ok AND NOT preserve)) AS t, count(DISTINCT target) FILTER (ok AND NOT preserve AND NOT candidate) AS admitted, max(target) FILTER (ok AND NOT preserve AND NOT candidate) AS the, coalesce(bool_or(len(bindings) = 0) FILTER (ok AND NOT preserve AND NOT candidate), false) AS global_, flatten(list(bindings) FILTER (ok AND NOT preserve AND NOT candidate)) AS held, any_value(viable) AS viable FROM hit GROUP BY id)
SELECT id, CASE WHEN keep THEN 'preserve' WHEN t IS NULL THEN 'none' WHEN admitted = 1 AND (global_ OR (len(viable) > 0 AND list_has_all(held, viable))) THEN 'resolved' ELSE 'candidates' END AS status,
CASE WHEN NOT keep AND admitted = 1 AND (global_ OR (len(viable) > 0 AND list_has_all(held, viable))) THEN the END AS target, CASE WHEN keep THEN '' ELSE coalesce(array_to_string(t, '|'), '') END AS targets FROM (SELECT w.id, coalesce(keep, false) AS keep, t, admitted, the, global_, held, w.viable FROM words w LEFT JOIN g USING (id))""")
def c14_contextual_resolution(spark, sf_dir):
    """Preserved; resolved where one target is admitted and it covers all
    viable bindings; else candidates, evidence for candidates alone among them."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    b = lambda x, m: F.concat(F.lit("b"), (F.col(x) % m).cast("string"))
    none = F.array().cast("array<string>")
    four = F.col("c_custkey") % 4
    viable = F.when(four == 0, none).when(four == 1, F.array(b("c_nationkey", 5))).when(four == 2, F.array(b("c_nationkey", 5), b("c_nationkey", 7))).otherwise(F.array(F.lit("b1"), F.lit("b2")))
    words = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("surface"), viable.alias("viable"))
    segments = c.select(F.col("c_mktsegment").alias("surface")).distinct().withColumn("size", F.length("surface"))
    k = F.col("n_nationkey")
    rel = n.withColumn("size", F.length("n_name")).join(segments, "size").select("surface", F.col("n_name").alias("target"), F.when(k % 9 == 0, none).otherwise(F.array(b("n_nationkey", 7))).alias("bindings"), (k % 8 == 5).alias("preserve"), (k % 3 == 0).alias("candidate"))
    return L.contextual(words, rel).select("id", "status", "target", F.array_join("targets", "|").alias("targets"))


@query("""WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct([p_brand, p_type])) AS sources, CASE WHEN p_size % 11 = 0 THEN 'Z' END AS auth, CASE WHEN p_size % 7 = 0 THEN p_brand WHEN p_size % 7 = 1 THEN 'other' END AS exact,
 p_size % 5 = 0 AS r1, p_size % 5 IN (0, 1) AS r2, p_size % 2 = 0 AS rendered, p_size % 3 = 0 AS manual, p_brand, p_type FROM part),
b AS (SELECT *, CASE WHEN auth IS NOT NULL THEN 'authoritative' WHEN exact = 'other' THEN 'incompatible' WHEN exact IS NOT NULL THEN 'exact' WHEN r2 AND NOT r1 THEN 'diachronic' WHEN rendered THEN 'rendering' WHEN manual THEN 'manual' WHEN len(sources) = 1 THEN 'single' ELSE 'none' END AS basis FROM s)
SELECT id, basis, CASE basis WHEN 'authoritative' THEN auth WHEN 'exact' THEN exact WHEN 'diachronic' THEN p_type WHEN 'rendering' THEN p_type WHEN 'manual' THEN p_brand WHEN 'single' THEN sources[1] END AS selected, array_to_string(sources, '|') AS sources FROM b""")
def c21_preference_cascade(spark, sf_dir):
    """The first basis that decides; rules count whose admissible set is
    the source set, and if they agree."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    rule = lambda on, ok, best: F.when(on, F.struct(ok.alias("admissible"), best.alias("preferred")))
    both = F.array("p_type", "p_brand")
    rules = F.array_compact(F.array(rule(size % 5 == 0, both, F.col("p_brand")), rule(size % 5 <= 1, both, F.col("p_type")), rule(size % 5 == 3, F.array("p_brand"), F.col("p_brand"))))
    c = p.select(F.col("p_partkey").alias("id"), F.array_distinct(F.array("p_brand", "p_type")).alias("sources"), F.when(size % 11 == 0, "Z").alias("authoritative"), F.when(size % 7 == 0, F.col("p_brand")).when(size % 7 == 1, "other").alias("exact"), rules.alias("rules"), F.when(size % 2 == 0, F.col("p_type")).alias("rendering"), F.when(size % 3 == 0, F.col("p_brand")).alias("manual"))
    return L.preferred(c)


_RULES = f"""('d1','diachronic','surface',array('th','t'),array('dh'),array('z9'),false,null,null),
('a1','orthographic','surface',array('dhe','an'),array('de','on'),array('d1'),false,null,null),
('a2','orthographic','surface',array('or'),array('ör','oer'),array(),true,null,null),
('z9','phonological','surface',array('ph'),array('f'),array(),true,'old',null),
('b1','orthographic','reading',array('ing','in'),array('yn'),array(),true,null,null),
('e1','diachronic','surface',array('he'),array('hi'),array(),false,null,array('even')),
('s1','render','surface',array('o'),array('ø'),array(),true,null,null),
('x1','render','surface',array('dis'),array('dys'),array(),true,null,null)"""
_RULE_COLUMNS = "id, class, channel, from, to, dependencies, lossless, period, identities"


def _rules(spark):
    r = values(spark, _RULES, _RULE_COLUMNS)
    r = r.withColumns({"dependencies": F.col("dependencies").cast("array<string>"), "identities": F.col("identities").cast("array<string>"), "period": F.col("period").cast("string")})
    return r.withColumn("scope", F.when(F.col("id") == "s1", "late")).withColumn("exact", F.col("id") == "x1").withColumn("lossiness", F.when(F.col("lossless"), "lossless").otherwise("many_to_one"))


@query(f"""WITH {I.WORDS}, s0 AS (SELECT w, w AS s, w AS r, length(w) % 2 = 0 AS even FROM words),
e1 AS (SELECT *, CASE WHEN even THEN replace(s, 'he', 'hi') ELSE s END AS s1, contains(s, 'he') AND NOT even AS no_e1 FROM s0),
z9 AS (SELECT *, contains(s1, 'ph') AS no_z9 FROM e1),
d1 AS (SELECT *, replace(replace(s1, 'th', 'dh'), 't', 'dh') AS s2 FROM z9),
a1 AS (SELECT *, replace(replace(s2, 'dhe', 'de'), 'an', 'on') AS s3 FROM d1),
a2 AS (SELECT *, contains(s3, 'or') AS no_a2 FROM a1),
b1 AS (SELECT *, replace(replace(r, 'ing', 'yn'), 'in', 'yn') AS r1 FROM a2),
x1 AS (SELECT *, CASE WHEN w = 'dis' THEN 'dys' ELSE s3 END AS s4, contains(s3, 'dis') AND s3 <> 'dis' AS no_x1 FROM b1)
SELECT w, s4 AS out_surface, r1 AS out_reading, CASE WHEN s1 <> s THEN s WHEN s2 <> s1 THEN s1 WHEN s3 <> s2 THEN s2 END AS retained,
 concat_ws(',', CASE WHEN s1 <> s THEN 'e1' END, CASE WHEN s2 <> s1 THEN 'd1' END, CASE WHEN s3 <> s2 THEN 'a1' END, CASE WHEN r1 <> r THEN 'b1' END, CASE WHEN s4 <> s3 THEN 'x1' END) AS steps,
 concat_ws(',', CASE WHEN no_e1 THEN 'e1:predicate_mismatch:lexicalIdentity' END, CASE WHEN no_z9 THEN 'z9:predicate_mismatch:period' END, CASE WHEN no_a2 THEN 'a2:one_to_many_requires_selection' END, CASE WHEN no_x1 THEN 'x1:predicate_mismatch:exactToken' END) AS blocked,
 CASE WHEN length(w) = 5 AND s4 = w AND r1 = w THEN 'source_attested' WHEN s4 <> w OR r1 <> r THEN 'generated' ELSE 'identity' END AS authority FROM x1""")
def c12_forward_projection(spark, sf_dir):
    """A rule table in its order over two channels, with what
    rules ask of a state, first forms kept, and forms that a source attests."""
    w = I.words(spark, sf_dir)
    states = w.select("w", F.col("w").alias("surface"), F.col("w").alias("reading"), F.when(F.length("w") % 2 == 0, "even").otherwise("odd").alias("identity"))
    bindings = values(spark, "('e1', array('even','odd'))", "rule, lexemes")
    facts = w.where("length(w) = 5").select(F.concat(F.lit("f:"), "w").alias("id"), F.lit("literal_reading").alias("kind"), F.col("w").alias("surface"), F.col("w").alias("reading"), F.lit(None).cast("array<string>").alias("lexemes"))
    out = P.projected(states, _rules(spark), bindings, facts)
    return out.select("w", "out_surface", "out_reading", F.coalesce("retained_surface", "retained_reading").alias("retained"), F.array_join("steps", ",").alias("steps"), F.array_join("blocked", ",").alias("blocked"), "authority")


@query(f"""WITH {I.WORDS}, k AS (SELECT w, replace(replace(replace(w, 'i', 'じ'), 'u', 'ず'), 'x', 'い') AS r, length(w) - length(replace(replace(w, 'i', ''), 'u', '')) AS n FROM words)
SELECT w, CASE WHEN length(w) % 10 = 0 THEN 'resolved' WHEN length(w) % 5 = 0 THEN 'candidates' WHEN n BETWEEN 1 AND 8 THEN 'candidates' ELSE 'unresolved' END AS status,
CAST(CASE WHEN length(w) % 10 = 0 THEN 1 WHEN length(w) % 5 = 0 THEN 2 WHEN n > 8 THEN 0 ELSE 2 ** n END AS BIGINT) AS n,
CASE WHEN length(w) % 5 = 0 THEN r || 'a' WHEN n > 8 THEN NULL ELSE r END AS least, CASE WHEN length(w) % 10 = 0 THEN r || 'a' WHEN length(w) % 5 = 0 THEN r || 'b' WHEN n > 8 THEN NULL ELSE replace(replace(r, 'じ', 'ぢ'), 'ず', 'づ') END AS most FROM k""")
def c13_restoration(spark, sf_dir):
    """Facts of the observed form first; else what the rules take back
    to the observation; over 256 hypotheses a word stays unresolved."""
    r = F.replace(F.replace(F.replace(F.col("w"), F.lit("i"), F.lit("じ")), F.lit("u"), F.lit("ず")), F.lit("x"), F.lit("い"))
    w = I.words(spark, sf_dir)
    q = w.select("w", F.col("w").alias("surface"), r.alias("reading"), F.array("w").alias("lexemes"))
    made = [w.where("length(w) % 5 = 0").select(F.concat(F.lit("f:"), "w", F.lit(t)).alias("id"), F.col("w").alias("surface"), F.concat(r, F.lit(t)).alias("reading"), F.array("w").alias("lexemes"), (F.length("w") % 10 == 0).alias("ten")) for t in ("a", "b")]
    facts = made[0].unionByName(made[1].where("not ten")).drop("ten").withColumn("kind", F.lit("historical_reading"))
    rules = values(spark, "('z','orthographic','reading',array('ぢ','じ'),array('じ'),false,'many_to_one'), ('d','orthographic','reading',array('づ','ず'),array('ず'),false,'many_to_one')", "id, class, channel, from, to, lossless, lossiness").withColumn("dependencies", F.array().cast("array<string>"))
    out = P.restored(q, rules, facts)
    return out.select("w", "status", F.size("readings").cast("long").alias("n"), F.array_min("readings").alias("least"), F.array_max("readings").alias("most"))


@query("SELECT c_custkey AS seq, c_mktsegment || '/' || c_nationkey || CASE WHEN count(*) OVER w > 1 THEN '#' || row_number() OVER (w ORDER BY c_custkey) ELSE '' END AS key FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey)")
def w9_duplicate_ordinals(spark, sf_dir):
    """W9 F45."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("form"), F.col("c_nationkey").cast("string").alias("reading"))
    return L.numbered(c).select("seq", "key")


@query("SELECT s_nationkey AS nation, CASE WHEN count(DISTINCT s_suppkey % 3) = 1 THEN max(s_suppkey % 3) WHEN bool_or(s_suppkey % 3 = 0) THEN 0 END AS reading FROM supplier GROUP BY s_nationkey")
def f34_agreed_reading(spark, sf_dir):
    """F34 F35."""
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(F.col("s_suppkey") % 3).alias("r"))
    return g.select("nation", L.agreed_reading(F.col("r"), F.lit(0).cast("bigint")).alias("reading"))


@query("""WITH g AS (SELECT p_brand AS surface, CAST(p_size AS BIGINT) AS lemma_id, p_type AS morphology, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS readings FROM part GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY surface, lemma_id, morphology) - 1 AS id FROM g)
SELECT id, surface, lemma_id, morphology, readings, min(id) OVER (PARTITION BY surface) AS candidate_offset, count(*) OVER (PARTITION BY surface) AS candidate_count FROM n""")
def s14_compiled_slice(spark, sf_dir):
    """Candidates with dense ids, and where a surface's stand."""
    checkpointed(spark)
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("surface"), F.col("p_size").cast("long").alias("lemma_id"), F.col("p_type").alias("morphology"), F.col("p_name").alias("reading"))
    done = L.compiled_slice(p)
    return done.join(L.surface_offsets(done), "surface").select("id", "surface", "lemma_id", "morphology", F.array_join("readings", "|").alias("readings"), "candidate_offset", "candidate_count")


@query("SELECT CAST(p_size AS BIGINT) AS lemma_id, count(DISTINCT (p_brand, p_type)) AS n FROM part GROUP BY p_size HAVING count(DISTINCT (p_brand, p_type)) > 1")
def s14_lemma_conflicts(spark, sf_dir):
    """Ids that name several lemmas."""
    return L.lemma_conflicts(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("lemma_id"), F.col("p_brand").alias("lemma"), F.col("p_type").alias("origin")))


@query("""WITH c AS (SELECT CAST(s_nationkey AS BIGINT) AS id, arg_max(s_acctbal < 0, s_suppkey) AS gone, arg_max(s_name, s_suppkey) AS form FROM supplier GROUP BY s_nationkey)
SELECT coalesce(c.id, CAST(n.n_regionkey AS BIGINT)) AS id, coalesce(c.form, n.form) AS form FROM (SELECT n_regionkey, min(n_name) AS form FROM nation GROUP BY n_regionkey) n FULL JOIN c ON c.id = n.n_regionkey WHERE gone IS NULL OR NOT gone""")
def c35_relation_changes(spark, sf_dir):
    """Added, updated and removed relations; the last change decides."""
    now = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("id")).agg(F.min("n_name").alias("form"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.when(F.col("s_acctbal") < 0, "remove").otherwise("update").alias("op"), F.col("s_nationkey").cast("long").alias("id"), F.col("s_name").alias("form"))
    return L.changed_relations(now, changes)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def c40_relation_roundtrip(spark, sf_dir):
    """Lists as one table of relations, and a list back from it."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier")}
    return L.from_relations(L.as_relations({n: (d, d.columns[0]) for n, d in t.items()}), "supplier", t["supplier"].schema)
