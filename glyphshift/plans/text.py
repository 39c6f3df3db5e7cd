"""Queries of the scalar functions, over words and texts of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kana, strings
from . import inputs as I
from .registry import query, table, values

_W = I.WORDS


def _spelt(script: str, name: str = "s") -> str:
    return f"{_W}, {name}_ AS (SELECT w, {I.spelt_sql('w', script)} AS s FROM words)"


def _each(c: str, case: str) -> str:
    """DuckDB: each character x of c by the expression, joined again."""
    return f"array_to_string(list_transform({I.chars_sql(c)}, lambda x: {case}), '')"


_FOLD = "CASE WHEN x = 'ヽ' THEN 'ゝ' WHEN x = 'ヾ' THEN 'ゞ' WHEN unicode(x) BETWEEN 12449 AND 12534 THEN chr(unicode(x) - 96) ELSE x END"
_KATA = "CASE WHEN x = 'ゝ' THEN 'ヽ' WHEN x = 'ゞ' THEN 'ヾ' WHEN unicode(x) BETWEEN 12353 AND 12438 THEN chr(unicode(x) + 96) ELSE x END"
_NOW = "CASE x WHEN 'ゐ' THEN 'い' WHEN 'ゑ' THEN 'え' WHEN 'を' THEN 'お' WHEN 'ぢ' THEN 'じ' WHEN 'づ' THEN 'ず' ELSE x END"


@query(f"""WITH {_spelt(I.OLD)}, m AS (SELECT *, {_each('s', _NOW)} AS now FROM s_)
SELECT w, {_each('s', _FOLD)} AS hira, {_each('s', _KATA)} AS kata, CASE WHEN length(w) % 2 = 0 AND length(w) % 3 <> 0 THEN replace(replace(s, 'っ', 'つ'), 'ッ', 'ツ') ELSE s END AS full_sokuon,
CASE WHEN starts_with(now, 'くゎ') THEN 'か' || substring(now, 3) WHEN starts_with(now, 'ぐゎ') THEN 'が' || substring(now, 3) ELSE now END AS modern FROM m""")
def f1_kana_forms(spark, sf_dir):
    """Syllabaries, full-size sokuon where two flags allow it, and
    historical spellings as they are written now."""
    s, n = I.spelt(F.col("w"), I.OLD), F.length("w")
    return I.words(spark, sf_dir).select("w", kana.to_hiragana(s, marks=True).alias("hira"), kana.to_katakana(s).alias("kata"), kana.full_sokuon(s, n % 2 == 0, n % 3 != 0).alias("full_sokuon"), kana.modernized(s).alias("modern"))


_LAST = "regexp_extract(acc, '[^|]*$')"
_VOICE = "CASE WHEN regexp_matches({0}, '[\\p{{Hiragana}}\\p{{Katakana}}]') THEN nfc_normalize({0} || chr(12441)) ELSE {0} END"


@query(f"""WITH {_spelt(I.MARKS)}, e AS (SELECT w, s, CASE WHEN regexp_matches(s, '^[ゝヽ々ゞヾ]') THEN NULL ELSE replace(substring(list_reduce({I.chars_sql('s')},
  lambda acc, x: acc || '|' || CASE WHEN x IN ('ゝ', 'ヽ', '々') THEN {_LAST} WHEN x IN ('ゞ', 'ヾ') THEN {_VOICE.format(_LAST)} ELSE x END, ''), 2), '|', '') END AS expanded FROM s_),
r AS (SELECT *, {I.chars_sql("coalesce(expanded, s)")} AS l FROM e)
SELECT w, expanded, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE
  WHEN i = 1 OR i % 5 = 1 THEN l[i] WHEN l[i] = l[i - 1] AND regexp_matches(l[i - 1], '\\p{{Han}}') THEN '々'
  WHEN l[i] = l[i - 1] AND regexp_matches(l[i - 1], '\\p{{Hiragana}}') THEN 'ゝ' WHEN l[i] = l[i - 1] AND regexp_matches(l[i - 1], '\\p{{Katakana}}') THEN 'ヽ'
  WHEN regexp_matches(l[i - 1], '\\p{{Hiragana}}') AND l[i] = nfc_normalize(l[i - 1] || chr(12441)) THEN 'ゞ' WHEN regexp_matches(l[i - 1], '\\p{{Katakana}}') AND l[i] = nfc_normalize(l[i - 1] || chr(12441)) THEN 'ヾ'
  ELSE l[i] END), '') AS rendered FROM r""")
def f4_iteration_marks(spark, sf_dir):
    """Marks written out (null where one has nothing to repeat), and
    rendered again in units of five characters."""
    s = I.spelt(F.col("w"), I.MARKS)
    full = I.words(spark, sf_dir).select("w", kana.expand_marks(s, strict=False).alias("expanded"), s.alias("s"))
    body = F.coalesce("expanded", "s")
    units = F.filter(F.sequence(F.lit(0), F.length(body)), lambda i: i % 5 == 0)
    return full.select("w", "expanded", kana.render_marks(body, units).alias("rendered"))


@query(f"WITH {_W}, r AS (SELECT w, right(w, 2) AS span FROM words), x AS (SELECT *, CASE WHEN length(w) >= 4 AND ends_with(w, span || span) THEN left(w, length(w) - 2) || '〳〵' ELSE w END AS rendered FROM r) SELECT w, rendered, CASE WHEN ends_with(rendered, '〳〵') THEN left(rendered, length(rendered) - 2) || span ELSE rendered END AS expanded FROM x")
def f6_span_repetition(spark, sf_dir):
    """a span that ends a word twice over, and back."""
    r = I.words(spark, sf_dir).withColumn("span", F.right("w", F.lit(2)))
    r = r.withColumn("rendered", F.when(F.length("w") >= 4, kana.render_span(F.col("w"), F.col("span"))).otherwise(F.col("w")))
    return r.select("w", "rendered", kana.expand_span(F.col("rendered"), F.col("span")).alias("expanded"))


_IS_KANA = "(unicode(x) BETWEEN 12353 AND 12447 OR unicode(x) BETWEEN 12448 AND 12543)"


@query(f"""WITH {_spelt(I.MIXED)}, l AS (SELECT w, s, {I.chars_sql('s')} AS l FROM s_), k AS (SELECT *, list_transform(l, lambda x: {_IS_KANA}) AS k FROM l),
o AS (SELECT *, len(l) - coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: NOT k[i])), 0) AS tail FROM k)
SELECT w, list_contains(k, false) AS han, list_sum(list_transform(l, lambda x: CASE WHEN unicode(x) BETWEEN 12448 AND 12543 THEN 0 ELSE 1 END)) = 0 AS katakana,
list_sum(list_transform(l, lambda x: CASE WHEN unicode(x) BETWEEN 12448 AND 12543 THEN 0 ELSE 1 END)) = 0 AND ends_with(s, 'ー') AS long_vowel, left(s, length(s) - tail) AS stem, right(s, tail) AS okurigana,
array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND k[i - 1] AND NOT k[i] THEN '/' || l[i] ELSE l[i] END), '') AS segments FROM o""")
def p19_character_classes(spark, sf_dir):
    """Ideographs, katakana alone, a long vowel at its end; the kana
    that end a word; a new segment at each ideograph after kana."""
    s = F.col("s")
    stem, okurigana = strings.stem_and_okurigana(s)
    d = I.words(spark, sf_dir).withColumn("s", I.spelt(F.col("w"), I.MIXED))
    return d.select("w", strings.contains_kanji(s).alias("han"), strings.is_katakana(s).alias("katakana"), strings.has_trailing_long_vowel(s).alias("long_vowel"), stem.alias("stem"), okurigana.alias("okurigana"), F.array_join(strings.kana_kanji_segments(s), "/").alias("segments"))


_MODES = "('plain'), ('ruby-whole-explicit'), ('ruby-whole-implicit'), ('ruby-components-explicit'), ('ruby-components-implicit')"


@query(f"""WITH {_W}, b AS (SELECT w, {I.spelt_sql('w', I.MIXED)} AS s, {I.spelt_sql('w', I.READ)} AS r FROM words),
p AS (SELECT *, list_max(list_filter(range(0, least(length(s), length(r)) + 1), lambda i: left(s, i) = left(r, i))) AS p FROM b),
q AS (SELECT *, list_max(list_filter(range(0, least(length(s), length(r)) - p + 1), lambda i: right(s, i) = right(r, i))) AS q FROM p),
f AS (SELECT *, substring(s, p + 1, length(s) - p - q) AS target, substring(r, p + 1, length(r) - p - q) AS ruby FROM q),
g AS (SELECT *, target <> '' AND ruby <> '' AND regexp_full_match(target, '\\p{{Han}}+') AS ok, length(w) % 2 = 0 AS historical FROM f),
h AS (SELECT *, CASE WHEN ok AND historical THEN left(s, p) || target || '《' || ruby || '》' || right(s, q) ELSE s || '《' || r || '》' END AS whole, array_to_string(list_transform(range(1, length(s) + 1), lambda i: substring(s, i, 1) || '《' || substring(r, i, 1) || '》'), '') AS parts FROM g)
SELECT w, mode, CASE mode WHEN 'plain' THEN s WHEN 'ruby-whole-explicit' THEN '｜' || whole WHEN 'ruby-whole-implicit' THEN whole
 WHEN 'ruby-components-explicit' THEN CASE WHEN length(w) % 3 = 0 THEN '｜' || parts ELSE '｜' || whole END ELSE CASE WHEN length(w) % 3 = 0 THEN parts ELSE whole END END AS rendered
FROM h, (VALUES {_MODES}) m(mode)""")
def f19_ruby_rendering(spark, sf_dir):
    """Five modes; a historical reading is factored, one by
    components needs a reading for each of them."""
    d = I.words(spark, sf_dir).select("w", I.spelt(F.col("w"), I.MIXED).alias("s"), I.spelt(F.col("w"), I.READ).alias("r"))
    part = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.named_struct(F.lit("surface"), F.substring("s", i, F.lit(1)), F.lit("reading"), F.when(F.length("w") % 3 == 0, F.substring("r", i, F.lit(1)))))
    mode = F.explode(F.array(*[F.lit(m) for m in ("plain", "ruby-whole-explicit", "ruby-whole-implicit", "ruby-components-explicit", "ruby-components-implicit")]))
    d = d.select("w", "s", "r", part.alias("parts"), mode.alias("mode"))
    return d.select("w", "mode", strings.render_ruby(F.col("s"), F.col("r"), F.col("mode"), F.length("w") % 2 == 0, F.col("parts")).alias("rendered"))


#: Texts with annotations: each word of eight letters or more bears one, every other has its bar; n counts them.
_ANNOTATED = f"""{_W}, t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS l FROM documents),
line AS (SELECT doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN length(l[i]) >= 8 THEN CASE WHEN i % 2 = 0 THEN '｜' ELSE '' END || {I.spelt_sql('l[i]', I.HAN)} || '《' || {I.spelt_sql('l[i]', I.READ)} || '》' ELSE {I.spelt_sql('l[i]', I.READ)} END), 'は') AS line FROM t)"""


def _annotated(spark, sf_dir):
    parts = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    bar = lambda i: F.when(i % 2 == 1, "｜").otherwise("")
    made = F.transform(parts, lambda x, i: F.when(F.length(x) >= 8, F.concat(bar(i), I.spelt(x, I.HAN), F.lit("《"), I.spelt(x, I.READ), F.lit("》"))).otherwise(I.spelt(x, I.READ)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made, "は").alias("line"))


_H, _K = "\\p{Han}々〆〇ヶ", "ぁ-ゟ゠-ヿ"


@query(f"""WITH {_ANNOTATED}, e AS (SELECT doc_id, regexp_replace(line, '(^|[^｜{_H}])([{_H}]+)《([{_K}]+)》', '\\1｜\\2《\\3》', 'g') AS e FROM line)
SELECT doc_id, md5(e) AS explicit_md5, len(regexp_extract_all(e, '｜[^《》｜]+《[^《》]+》')) AS n, md5(array_to_string(regexp_extract_all(e, '｜([^《》｜]+)《[^《》]+》', 1), '|')) AS bases_md5, md5(regexp_replace(regexp_replace(e, '《[^《》]*》', '', 'g'), '｜', '', 'g')) AS plain_md5 FROM e""".replace("\\\\", "\\"))
def f15_ruby_parsing(spark, sf_dir):
    """Runs of ideographs get the bar of their annotation; bases, and
    the text without any."""
    e = _annotated(spark, sf_dir).withColumn("e", strings.implicit_ruby_to_explicit(F.col("line")))
    md5 = lambda c: F.md5(c.cast("binary"))
    found = strings.explicit_ruby(F.col("e"))
    return e.select("doc_id", md5(F.col("e")).alias("explicit_md5"), F.size(found).cast("long").alias("n"), md5(F.array_join(F.transform(found, lambda x: x["base"]), "|")).alias("bases_md5"), md5(strings.without_ruby(F.col("e"))).alias("plain_md5"))


@query(f"""WITH {_ANNOTATED}, p AS (SELECT doc_id, regexp_split_to_array(line, '《[^《》]*》') AS l FROM line),
n AS (SELECT doc_id, len(l) - 1 AS n, length(array_to_string(l, '')) - length(regexp_replace(array_to_string(l, ''), '｜', '', 'g')) AS bars FROM p),
b AS (SELECT doc_id, line, regexp_replace(regexp_replace(line, '《[^《》]*》', '', 'g'), '｜', '', 'g') AS base FROM line)
SELECT doc_id, length(base) AS base_length, length(line) - length(base) AS added, CAST(length(line) AS BIGINT) AS last_end FROM b JOIN n USING (doc_id)""")
def w8_annotation_offsets(spark, sf_dir):
    """Places of the text without annotations mapped to the annotated one; the
    last one's end is the end of the line."""
    d = _annotated(spark, sf_dir)
    ranges = d.select("doc_id", "line", strings.annotation_ranges(F.col("line")).alias("ranges"))
    ranges = ranges.withColumn("base", F.length(strings.without_ruby(F.col("line"))))
    mapped = strings.to_annotated(F.col("ranges"), F.greatest(F.col("base") - 1, F.lit(0)), F.col("base"))
    return ranges.select("doc_id", F.col("base").cast("long").alias("base_length"), (F.length("line") - F.col("base")).cast("long").alias("added"), mapped["end"].cast("long").alias("last_end"))


@query("SELECT doc_id, source, contains(source, '1') AND source <> 'src10' AS matched, CASE WHEN regexp_full_match(source, 'src1.*') THEN 'src1*' WHEN regexp_full_match(source, '.*9') THEN '*9' END AS first FROM documents")
def p1_value_matches(spark, sf_dir):
    """Signed wildcard lists."""
    pos, neg = strings.split_signed(F.lit("*1*, -src10"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", strings.value_matches(F.col("source"), pos, neg).alias("matched"), strings.first_match(F.col("source"), F.array(F.lit("src1*"), F.lit("*9"))).alias("first"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\bth(\w*?)e\b', 'Þ\1', 'g')) AS wild, substring(sha256(lang || chr(31) || source), 1, 16) AS short_id, 'doc:' || doc_id AS typed, md5(translate(lower(text), 'aeiou', 'AEIOU')) AS mapped FROM documents")
def f13_replacement_and_ids(spark, sf_dir):
    """F13 F26 F41 F45."""
    t = F.col("text")
    wild = F.regexp_replace(t, r"\bth(\w*?)e\b", "Þ$1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(wild.cast("binary")).alias("wild"), strings.short_id(F.col("lang"), F.col("source")).alias("short_id"), strings.typed_id(F.lit("doc"), F.col("doc_id").cast("string")).alias("typed"), F.md5(F.translate(F.lower(t), "aeiou", "AEIOU").cast("binary")).alias("mapped"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS d, CAST(o_orderkey AS VARCHAR) AS digits,
CAST(length(o_orderpriority) + (length(o_orderpriority) - length(replace(o_orderpriority, 'E', ''))) AS BIGINT) AS utf16, CAST(length(o_orderpriority) AS BIGINT) AS n_atoms, replace(o_orderpriority, 'O', '*') AS plain FROM orders""")
def f47_small_scalars(spark, sf_dir):
    """F39 F44 F46 F47 and UTF-16 offsets: dates and digits of orders, and their
    priorities with characters beyond the first plane, combining marks, escapes."""
    p = F.col("o_orderpriority")
    date = F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.day("o_orderdate"), F.lit("日"))
    wide = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "".join(map(chr, range(0xFF10, 0xFF1A))))
    atoms = strings.atoms(F.regexp_replace(p, "E", "か゚"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.slashed_dates(date).alias("d"), kana.half_digits(wide).alias("digits"), strings.utf16_length(F.translate(p, "E", "𠮷")).cast("long").alias("utf16"), F.size(atoms).cast("long").alias("n_atoms"), strings.unescaped(F.regexp_replace(p, "O", r"\\*")).alias("plain"))


@query("SELECT doc_id, source, CAST(list_reduce(list_transform(range(1, length(source) + 1), lambda i: CAST(ascii(substring(source, CAST(i AS INTEGER), 1)) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) % 7 AS BIGINT) AS pick FROM documents")
def f25_deterministic_pick(spark, sf_dir):
    """one of seven by FNV-1a of a seed."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", (strings.fnv1a(F.col("source")) % 7).alias("pick"))


@query("SELECT page_id, coalesce(u.marker, d.marker, '｜') AS marker FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages) p LEFT JOIN (SELECT url, '＋' AS marker FROM pages WHERE length(url) > 40) u ON u.url = p.url LEFT JOIN (SELECT host, '＊' AS marker FROM (VALUES ('blog.tionsh.example.net'), ('blog.ththan.example.net')) t(host)) d ON d.host = p.host")
def f17_page_markers(spark, sf_dir):
    """marker by url, else by host, else the default."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    own = p.where("length(url) > 40").select("url", F.lit("＋").alias("own"))
    hosts = values(spark, "('blog.tionsh.example.net','＊'), ('blog.ththan.example.net','＊')", "host, theirs")
    return p.join(own, "url", "left").join(F.broadcast(hosts), "host", "left").select("page_id", F.coalesce("own", "theirs", F.lit("｜")).alias("marker"))


_SIX = "six AS (SELECT doc_id, l FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS l FROM documents) WHERE len(l) >= 6)"


@query(f"""WITH {_SIX} SELECT doc_id, l[1] || l[2] || l[6] || '|' || l[1] || l[3] || l[4] || l[6] || '|' || l[1] || l[3] || l[5] || l[6] || '|-' || l[2] || '|' || l[3] || ',' || l[4] AS alternatives, l[2] AS first_negative FROM six""")
def f9_bracket_alternatives(spark, sf_dir):
    """Lists with nested alternatives, a negative and an escaped
    comma, made of each text's first six words."""
    from ..sources import readers

    parts = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", parts.alias("l")).where("size(l) >= 6")
    w = [F.col("l")[i] for i in range(6)]
    src = F.concat(w[0], F.lit("["), w[1], F.lit(","), w[2], F.lit("["), w[3], F.lit(","), w[4], F.lit("]]"), w[5], F.lit(", -"), w[1], F.lit(", "), w[2], F.lit("\\,"), w[3])
    made = d.select("doc_id", readers.listed_values_udf(src).alias("v"))
    return made.select("doc_id", F.array_join("v", "|").alias("alternatives"), F.get(strings.split_listed(F.col("v"))[1], F.lit(0)).alias("first_negative"))


@query(f"""WITH {_SIX}, h AS (SELECT doc_id, {I.spelt_sql('l[1]', I.HAN)} AS a, {I.spelt_sql('l[2]', I.HAN)} AS b, {I.spelt_sql('l[3]', I.READ)} AS k, {I.spelt_sql('l[4]', I.HAN)} AS c, {I.spelt_sql('l[5]', I.HAN)} AS d FROM six)
SELECT doc_id, a || replace(k, 'ー', '') AS preferred, b || replace(k, 'ー', '') AS alternative FROM h UNION ALL SELECT doc_id, c, d FROM h""")
def f38_bracketed_forms(spark, sf_dir):
    """the form that an example prefers, and the one it gives in brackets."""
    parts = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", parts.alias("l")).where("size(l) >= 6")
    h = lambda i: I.spelt(F.col("l")[i], I.HAN)
    example = F.concat(h(0), F.lit("（"), h(1), F.lit("）"), F.regexp_replace(I.spelt(F.col("l")[2], I.READ), "ー", ""), F.lit("。"), h(3), F.lit("（"), h(4), F.lit("）。"))
    return d.select("doc_id", F.explode(strings.bracketed_forms(example)).alias("x")).select("doc_id", "x.preferred", "x.alternative")


@query(r"SELECT doc_id, md5(regexp_replace(text, '([a-z]+)(ing|ed|ly)([ .,]|$)', '\1-\2\3', 'g')) AS marked FROM documents")
def c3_ending_rules(spark, sf_dir):
    """Pattern rules on inflected endings, over the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", "([a-z]+)(ing|ed|ly)([ .,]|$)", "$1-$2$3").cast("binary")).alias("marked"))


@query(f"WITH {_spelt(I.KATA)} SELECT w, replace(replace(replace(replace(replace(regexp_replace(s || 'の' || s, 'ー(の|$)', '\\1', 'g'), 'ーア', 'ア'), 'ーイ', 'イ'), 'ーウ', 'ウ'), 'ーエ', 'エ'), 'ーオ', 'オ') AS short FROM s_")
def f30_long_vowel_abbreviation(spark, sf_dir):
    """katakana without the long vowel mark at the end of a part."""
    s = I.spelt(F.col("w"), I.KATA)
    return I.words(spark, sf_dir).select("w", kana.abbreviated_long_vowels(F.concat(s, F.lit("の"), s)).alias("short"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([aeiou])(n)', '[\2\1|\0]$', 'g')) AS expanded_md5 FROM documents")
def f14_replacement_templates(spark, sf_dir):
    """groups, the match and a literal sign in a template."""
    made = strings.expand_template(F.col("text"), "([aeiou])(n)", "[$2$1|$&]$$")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(made.cast("binary")).alias("expanded_md5"))
