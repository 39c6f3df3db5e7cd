"""Queries of inflection: words of the corpus in kana, with endings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inflection as N
from . import inputs as I
from .registry import query, table

_ENDINGS = ", ".join(f"('{p}', '{e}', '{b}', '{f}')" for p, e, b, f in N.endings())
_PICK = sorted({e for _, e, _, _ in N.endings()})
_LIST = "[" + ", ".join(f"'{e}'" for e in _PICK) + "]"
_BASE = "CASE length(w) % 6 WHEN 0 THEN 'く' WHEN 1 THEN 'る' WHEN 2 THEN 'い' WHEN 3 THEN '' WHEN 4 THEN 'む' ELSE 'す' END"
_PARTS = "CASE length(w) % 6 WHEN 0 THEN CASE WHEN length(w) % 4 = 0 THEN ['v5k-s', 'n'] ELSE ['v5k'] END WHEN 1 THEN CASE WHEN length(w) % 4 = 1 THEN ['v1'] ELSE ['v5r', 'v1'] END WHEN 2 THEN ['adj-i'] WHEN 3 THEN ['n', 'vs-s'] WHEN 4 THEN ['v5m'] ELSE ['v5u'] END"


@query(f"""WITH {I.WORDS}, k AS (SELECT w, {I.spelt_sql('w', I.READ)} AS k, row_number() OVER (ORDER BY w) AS i FROM words),
lex AS (SELECT w, {I.spelt_sql('w', I.HAN)} || {_BASE} AS surface, CASE WHEN length(w) % 5 = 0 THEN k ELSE k || {_BASE} END AS reading, {_PARTS} AS parts FROM k),
said AS (SELECT DISTINCT {I.spelt_sql('w', I.HAN)} || ({_LIST})[1 + (unicode(left(w, 1)) * 31 + length(w) * 7 + unicode(right(w, 1))) % {len(_PICK)}] AS surface FROM k),
rules(pos, inflected, base_end, form) AS (VALUES {_ENDINGS})
SELECT said.surface, lex.surface AS base, pos, form, CASE WHEN ends_with(reading, base_end) THEN left(reading, length(reading) - length(base_end)) || inflected END AS reading
FROM said JOIN rules ON ends_with(said.surface, inflected) AND length(said.surface) > length(inflected) JOIN lex ON lex.surface = left(said.surface, length(said.surface) - length(inflected)) || base_end
WHERE list_contains(parts, pos) OR (pos = 'vs' AND (list_contains(parts, 'vs-i') OR list_contains(parts, 'vs-s')))""")
def f33_deinflection(spark, sf_dir):
    """238 endings by class of verb and adjective, admitted by the lexeme's
    class, with the inflected form's reading."""
    w, n = F.col("w"), F.length("w")
    d = I.words(spark, sf_dir).withColumn("k", I.spelt(w, I.READ)).withColumn("h", I.spelt(w, I.HAN))
    base = F.when(n % 6 == 0, "く").when(n % 6 == 1, "る").when(n % 6 == 2, "い").when(n % 6 == 3, "").when(n % 6 == 4, "む").otherwise("す")
    many = lambda *x: F.array(*map(F.lit, x))
    parts = F.when(n % 6 == 0, F.when(n % 4 == 0, many("v5k-s", "n")).otherwise(many("v5k"))).when(n % 6 == 1, F.when(n % 4 == 1, many("v1")).otherwise(many("v5r", "v1"))).when(n % 6 == 2, many("adj-i")).when(n % 6 == 3, many("n", "vs-s")).when(n % 6 == 4, many("v5m")).otherwise(many("v5u"))
    lexicon = d.select(F.concat("h", base).alias("surface"), F.when(n % 5 == 0, F.col("k")).otherwise(F.concat("k", base)).alias("reading"), parts.alias("parts"))
    pick = (F.ascii(F.left(w, F.lit(1))) * 31 + n * 7 + F.ascii(F.right(w, F.lit(1)))) % len(_PICK) + 1
    said = d.select(F.concat("h", F.element_at(many(*_PICK), pick.cast("int"))).alias("surface")).distinct()
    return N.deinflected(said, lexicon)


_TOKEN = f"""{I.WORDS}, t AS (SELECT w, {I.spelt_sql('w', I.HAN)} || ['かう', 'きて', 'せば', 'る', ''][length(w) % 5 + 1] AS surface, CASE WHEN length(w) % 7 = 0 THEN '名詞' ELSE '動詞' END AS pos, CASE WHEN length(w) % 8 = 0 THEN 'する' ELSE {I.spelt_sql('w', I.HAN)} || ['う', 'く', 'す', 'る', '来'][length(w) % 5 + 1] END AS basic,
 [NULL, '五段・カ行イ音便', '一段', 'サ変・スル'][unicode(left(w, 1)) % 4 + 1] AS kind, ['基本形', '連用形', '連用タ接続', '未然形', '仮定形', '命令形', '意志形', '音便'][unicode(right(w, 1)) % 8 + 1] AS form FROM words),
c AS (SELECT *, pos = '動詞' AS verb, pos = '動詞' AND (basic = 'する' OR coalesce(contains(kind, 'サ変'), false)) AS sahen, pos = '動詞' AND coalesce(contains(kind, '一段'), false) AS ichidan, pos = '動詞' AND coalesce(contains(kind, '五段'), false) AS godan, contains(form, 'タ接続') AS ta, pos = '動詞' AND contains(form, '連用') AND NOT contains(form, 'タ接続') AS renyou,
 ['かう', 'きて', 'せば', 'る', ''][length(w) % 5 + 1] AS tail FROM t),
g(last, a, i, e, o) AS (VALUES ('う', 'わ', 'い', 'え', 'お'), ('く', 'か', 'き', 'け', 'こ'), ('す', 'さ', 'し', 'せ', 'そ'), ('る', 'ら', 'り', 'れ', 'ろ'))"""


def _tokens(spark, sf_dir):
    w, n = F.col("w"), F.length("w")
    at = lambda options, k: F.element_at(F.array(*map(F.lit, options)), (k + 1).cast("int"))
    h = I.spelt(w, I.HAN)
    return I.words(spark, sf_dir).select(
        "w", F.concat(h, at(("かう", "きて", "せば", "る", ""), n % 5)).alias("surface"), F.when(n % 7 == 0, "名詞").otherwise("動詞").alias("pos"), F.when(n % 8 == 0, "する").otherwise(F.concat(h, at(("う", "く", "す", "る", "来"), n % 5))).alias("basic"),
        at((None, "五段・カ行イ音便", "一段", "サ変・スル"), F.ascii(F.left(w, F.lit(1))) % 4).alias("kind"), at(("基本形", "連用形", "連用タ接続", "未然形", "仮定形", "命令形", "意志形", "音便"), F.ascii(F.right(w, F.lit(1))) % 8).alias("form"),
    )


@query(f"WITH {_TOKEN} SELECT verb, sahen, ichidan, godan, ta AS renyou_ta, renyou, count(*) AS n FROM c GROUP BY ALL")
def p20_verb_classes(spark, sf_dir):
    """P20: classes of verbs by features of their tokens."""
    classes = N.verb_class(F.col("pos"), F.col("basic"), F.col("kind"), F.col("form"))
    return _tokens(spark, sf_dir).groupBy(*[c.alias(k) for k, c in classes.items()]).agg(F.count("*").alias("n"))


def _suffix(renyou: str, plain: str) -> str:
    return f"""CASE WHEN sahen THEN CASE WHEN form IN ('仮定形', '命令形') THEN 'せ' WHEN form = '基本形' THEN 'す' END WHEN ichidan THEN CASE WHEN renyou THEN {plain} ELSE tail END WHEN NOT godan OR ta OR g.last IS NULL THEN tail
 WHEN form = '未然形' THEN a WHEN form = '連用形' THEN {renyou} WHEN form IN ('仮定形', '命令形') THEN e WHEN form = '意志形' THEN o || 'う' WHEN form = '基本形' THEN g.last ELSE tail END"""


@query(f"WITH {_TOKEN} SELECT w, {_suffix('i', 'tail')} AS suffix, {_suffix(repr(''), repr(''))} AS compressed FROM c LEFT JOIN g ON g.last = right(basic, 1)")
def f32_minimal_suffix(spark, sf_dir):
    """F32: the least ending of each verb form, and with renyou forms compressed."""
    args = [F.col(c) for c in ("surface", "pos", "basic", "kind", "form")]
    return _tokens(spark, sf_dir).select("w", N.minimal_suffix(*args).alias("suffix"), N.minimal_suffix(*args, compress=True).alias("compressed"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'n' || c_nationkey % 3 ELSE 'n' || c_nationkey % 3 || ',s' || c_custkey % 2 END AS pos, CASE WHEN c_custkey % 5 = 0 THEN 't' || c_nationkey % 2 END AS type, CASE WHEN c_custkey % 7 = 0 THEN 'f1' END AS form,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE ['n' || c_custkey % 3, 's' || c_nationkey % 2, 'x'] END AS own, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 't1' END AS own_type, 'f' || c_custkey % 2 AS own_form FROM customer)
SELECT id, coalesce((pos IS NULL OR (own IS NOT NULL AND own[1:len(string_split(pos, ','))] = string_split(pos, ','))) AND (type IS NULL OR type IS NOT DISTINCT FROM own_type) AND (form IS NULL OR form IS NOT DISTINCT FROM own_form), false) AS ok FROM r""")
def p15_morphology(spark, sf_dir):
    """First parts of speech, conjugation type and form."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    pos = F.when(k % 3 == 1, text("n", n % 3)).when(k % 3 == 2, F.concat(text("n", n % 3), F.lit(","), text("s", k % 2)))
    required = F.struct(pos.alias("pos"), F.when(k % 5 == 0, text("t", n % 2)).alias("type"), F.when(k % 7 == 0, "f1").alias("form"))
    record = F.struct(F.when(k % 11 != 0, F.array(text("n", k % 3), text("s", n % 2), F.lit("x"))).alias("pos"), F.when(k % 4 != 0, "t1").alias("type"), text("f", k % 2).alias("form"))
    d = table(spark, sf_dir, "customer").select(k.alias("id"), required.alias("a"), record.alias("b"))
    return d.select("id", N.morphology_matches(F.col("a"), F.col("b")).alias("ok"))
