"""The engine's own operators: literal cases, order independence, and every
query against its SQL on the smallest tables."""

from __future__ import annotations

import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphshift.functions import kana, strings
from glyphshift.operators import matching as M
from glyphshift.operators import readings as RD
from glyphshift.operators import rules as R
from glyphshift.plans import registry
from glyphshift.sources import readers, writers
from glyphshift.streaming.rewriting import rewrite_stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    told = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(got.columns)
    key = sorted(columns)
    expected = sorted(tuple(str(r[columns.index(c)]) for c in key) for r in told.fetchall())
    assert sorted(tuple(str(r[c]) for c in key) for r in got.collect()) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert registry.QUERIES.items() <= __spark_entry__.queries().items()


def decide(spark, text, rules):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = spark.createDataFrame(rules, "key string, output string, precedence int, candidate boolean")
    m = M.substring_matches(docs, table)
    return M.decisions(docs, m).first()["rendered"], M.arbitrate(docs, m)


@pytest.mark.parametrize("turn", [False, True])
def test_shifted_overlap_is_never_decided_by_order(spark, turn):
    rules = [("AB", "X", 0, False), ("BC", "Y", 0, False)]
    made, d = decide(spark, "ABC", rules[::-1] if turn else rules)
    assert {(r["status"], r["reason"]) for r in d.collect()} == {("unresolved", "unresolved_shifted_overlap")}
    assert made == "ABC"


def test_certain_rule_before_alternatives(spark):
    made, d = decide(spark, "装丁", [("装丁", "裝幀", 0, False), ("装丁", "装釘", 0, True), ("装丁", "装幀", 0, True)])
    assert made == "裝幀"
    assert sorted(r["reason"] or "" for r in d.collect()) == ["", "candidate_alternative", "candidate_alternative"]


def test_conflicting_candidates_stay(spark):
    made, d = decide(spark, "ごらん", [("ごらん", "ご覧", 0, True), ("ごらん", "御覧", 0, True)])
    assert {r["reason"] for r in d.collect()} == {"conflicting_productive_outputs"} and made == "ごらん"


def test_longest_and_characters(spark):
    rules = [("学", "學", 0, False), ("円", "圓", 0, False), ("応", "應", 0, False), ("円応", "圓應", 0, False), ("竜", "龍", 0, False), ("宝", "寶", 0, False), ("校", "校", 1, False)]
    assert decide(spark, "超学校円応竜宝X", rules)[0] == "超學校圓應龍寶X"


def test_longer_peers_of_high_precedence(spark):
    made, d = decide(spark, "ABCDEF", [("ABCD", "X", 1, False), ("BC", "Y", 1, False), ("DEF", "Z", 1, False)])
    assert made == "XEF" and {r["key"]: r["reason"] for r in d.collect()} == {"ABCD": None, "BC": "shadowed_by_longer_high_precedence", "DEF": "outranked_by_overlap"}


def test_gates_and_regions():
    # What an ambiguous gate keeps out leaves its region open, unless something was applied or is open there.
    status, reason, regions = M.decide([0, 1, 4, 4, 8], [3, 5, 6, 7, 9], list("abcde"), [0] * 5, [False] * 5, ["ambiguous_lexical_boundary", "ambiguous_morphology", None, "crosses_lexical_boundary", None])
    assert status == ["blocked", "blocked", "applied", "blocked", "applied"] and regions == [(0, 3, ["ambiguous_lexical_boundary"])]
    # More candidates than the limit in one overlap stay unresolved, one span or several.
    many = M.decide(list(range(30)), [x + 2 for x in range(30)], ["o"] * 30, [0] * 30, [False] * 30, [None] * 30)
    assert set(many[0]) == {"unresolved"} and many[2] == [(0, 31, ["unresolved_shifted_overlap"])]
    same = M.decide([0] * 25, [2] * 25, [str(x) for x in range(25)], [0] * 25, [True] * 25, [None] * 25)
    assert set(same[1]) == {"conflicting_productive_outputs"}


@pytest.mark.parametrize("seed", range(20))
def test_best_selection_by_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        spans = sorted({(s, s + r.randint(1, 4), r.choice("ab")) for s in (r.randint(0, 8) for _ in range(r.randint(1, 7)))})
        best: list = []
        for n in range(1 << len(spans)):
            some = [x for k, x in enumerate(spans) if n >> k & 1]
            if all(a[1] <= b[0] for a, b in zip(some, some[1:])):
                best.append((sum(e - s for s, e, _ in some), some))
        top = [x for c, x in best if c == max(c for c, _ in best)]
        assert M.best_selection(spans) == (top[0] if len(top) == 1 else None)


def test_arbitration_properties(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(r.choice("abc") for _ in range(r.randint(0, 700)))) for i in range(30)] + [(99, None), (98, "")], "doc_id long, text string")
    rules = [("ab", "X", 0, False), ("ba", "YY", 0, False), ("abc", "", 1, False), ("cc", "C", 0, True), ("cc", "D", 0, True), ("b", "bb", 0, False)]
    table = spark.createDataFrame(rules, "key string, output string, precedence int, candidate boolean")
    m = M.substring_matches(docs, table)
    found = {(d, i) for d, t in docs.collect() for i in range(len(t or "")) for k in ("ab", "abc") if (t or "").startswith(k, i)}
    assert {(x["doc_id"], x["start"]) for x in m.where("key like 'ab%'").collect()} == found
    d = M.arbitrate(docs, m)
    again = M.arbitrate(docs.repartition(7), M.substring_matches(docs.repartition(7), table.repartition(3)))
    key = lambda df: sorted((x["doc_id"], x["start"], x["end"], x["output"], x["status"], x["reason"] or "") for x in df.collect())
    assert key(d) == key(again) and d.count() == m.count()
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    grown = {}
    for doc in texts:
        taken = sorted({(x[1], x[2], x[3]) for x in key(d) if x[0] == doc and x[4] == "applied"})
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        grown[doc] = sum(len(o) - (e - s) for s, e, o in taken)
    for x in M.decisions(docs, m).collect():
        assert x["rendered"] is None if texts[x["doc_id"]] is None else len(x["rendered"]) == len(texts[x["doc_id"]]) + grown[x["doc_id"]]


def test_marks_fail_without_base(spark):
    with pytest.raises(Exception, match="iteration mark"):
        spark.createDataFrame([("ゝあ",)], "w string").select(kana.expand_marks(F.col("w"))).collect()


def test_marks_of_voiced_kana_and_katakana(spark):
    cases = {"みすず": "みすゞ", "かが": "かゞ", "ココロ": "コヽロ", "カガミ": "カヾミ", "ウヴ": "ウヾ", "がか": "がか", "はぱ": "はぱ", "ラーー": "ラーー", "人人": "人々", "𠮷𠮷": "𠮷々", "あ": "あ", "": ""}
    got = spark.createDataFrame([(w,) for w in cases], "w string").select("w", kana.render_marks(F.col("w")).alias("r")).collect()
    assert {r["w"]: r["r"] for r in got} == cases


def test_components_of_words_of_any_length(spark):
    parts = spark.createDataFrame([("学", "がく", None, "がく"), ("校", "こう", None, "かう"), ("法", "ほう", None, "はふ"), ("法", "ほう", "仏教用語", "ほふ")], "character string, modern string, context string, historical string")
    words = spark.createDataFrame([("学校" * n, "がっこう" * n) for n in (1, 2, 30)] + [("学校学", "がくこう"), ("", ""), (None, None), ("学ぶ", "まなぶ"), ("法", "ほう"), ("法被", "はっぴ"), ("法" * 7, "ほう" * 7), ("法" * 6, "ほう" * 6)], "surface string, reading string")
    got = {r["surface"]: (r["status"], r["spellings"]) for r in RD.reconstructed(words, parts).collect()}
    assert all(got["学校" * n] == ("resolved", ["がくかう" * n]) for n in (1, 2, 30))
    assert got["法"] == ("candidates", ["はふ", "ほふ"]) and got["法被"] == ("resolved", ["はっぴ"])
    assert all(got[w][0] == "none" for w in ("", None, "学ぶ", "法" * 7)) and got["学校学"] == ("resolved", ["がくこう"]) and len(got["法" * 6][1]) == 64
    asked = spark.createDataFrame([("法", "ほう", False, c) for c in (None, "仏教用語", "other")], "surface string, reading string, any_context boolean, context string")
    assert {r["context"]: r["spellings"] for r in RD.reconstructed(asked, parts).collect()} == {None: ["はふ"], "仏教用語": ["ほふ"], "other": []}


def test_ruby_and_dates(spark):
    row = spark.range(1).select(strings.implicit_ruby_to_explicit(F.lit("学校《がっこう》")).alias("a"), strings.slashed_dates(F.lit("2014年2月3日")).alias("b"), strings.utf16_length(F.lit("𠮷野")).alias("c")).first()
    assert tuple(row) == ("｜学校《がっこう》", "2014/2/3", 3)


def test_rule_order_fails_closed(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "id string, stage int, depends_on array<string>")
    good = R.ordered(make([("b", 0, ["a"]), ("a", 0, []), ("c", 1, ["b"])]))
    assert [x["id"] for x in good.collect()] == ["a", "b", "c"]
    # What becomes ready is taken by its id at once, not by its depth.
    assert [x["id"] for x in R.ordered(make([("a", 0, []), ("b", 0, ["a"]), ("c", 0, [])])).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="later stage"):
        R.ordered(make([("a", 0, ["b"]), ("b", 1, [])]))
    rules = spark.createDataFrame([("a", "render", ["z"]), ("z", "diachronic", []), ("m", "diachronic", ["a"])], "id string, class string, dependencies array<string>")
    order = lambda **o: [x["id"] for x in R.projection_order(rules, **o).collect()]
    assert order() == ["z", "a", "m"] and order(disabled=["a"]) == ["m", "z"] and order(only=["a"]) == ["a"]
    with pytest.raises(ValueError):
        order(only=["nothing"])
    with pytest.raises(ValueError):
        R.ordered(make([("a", 0, ["x"])]))
    with pytest.raises(ValueError):
        R.ordered(make([("a", 0, ["b"]), ("b", 0, ["a"])]))


def test_readers(spark, tmp_path):
    (tmp_path / "a.json5").write_text("// c\n{rules: [{from: 'x', to: \"y\",},], // t\n}")
    assert readers.read_json5(spark, str(tmp_path / "a.json5"), "rules array<struct<`from`:string,`to`:string>>").first()["rules"][0]["to"] == "y"
    (tmp_path / "d.txt").write_text("かう /買う/ ;buy\n;old /除く/\nbroken\n")
    got = readers.line_dictionary(spark.read.text(str(tmp_path / "d.txt"))).collect()
    assert [(r["key"], r["target"], r["disabled"], r["remainder"]) for r in got] == [("かう", "買う", False, None), ("old", "除く", True, None), (None, None, False, "broken")]
    (tmp_path / "t.csv").write_text('a,b\n"x ""q"", y",2\n')
    assert readers.read_quoted_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).first()["a"] == 'x "q", y'
    with pytest.raises(ValueError):
        readers.read_quoted_csv(spark, str(tmp_path / "t.csv"), ["a", "c"])
    assert readers.split_delimited(r'a,[b,c]d,e\,f,"g,""h"') == ["a", "[b,c]d", "e,f", 'g,"h']
    assert readers.listed_values(r"a[b,c[d,e]]f, -g, h\,i, [x, j\-k") == ["abf", "acdf", "acef", "-g", "h,i", "[x, j\\-k"]
    assert readers.bracket_alternatives("に[依,因]る") == ["に依る", "に因る"]
    page = "<table><tr><td>ほう<td>はふ<td>x<td>法</tr><tr><td>y</td><td>報（仏）?</td></tr></table>"
    rows = readers.carried_headings(readers.html_table(spark.createDataFrame([(1, page)], "doc long, html string"))).collect()
    assert [(r["heading"], r["character"], r["context"], r["remainder"]) for r in rows] == [("ほう", "法", None, None), ("ほう", "報", "仏", None), ("ほう", None, None, "?")]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>かう</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert readers.read_xlsx(spark, str(tmp_path / "b.xlsx")).first()["cells"] == ["かう", None, "7"]
    (tmp_path / "e.xml").write_text("<d><entry><seq>1</seq><k>学校</k></entry></d>")
    assert readers.read_entries_xml(spark, str(tmp_path / "e.xml"), "entry", "seq long, k string").first()["k"] == "学校"


def test_writers(spark, tmp_path):
    df = spark.range(10)
    for n in (10, 3):
        writers.replace_atomically(df.limit(n), str(tmp_path / "x"))
        assert spark.read.parquet(str(tmp_path / "x")).count() == n
    assert writers.table_digest(df).first() == writers.table_digest(df.repartition(4)).first()
    assert writers.table_digest(df).first() != writers.table_digest(df.limit(9)).first()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "the an"), (2, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([("the", "dhe", 0, False), ("an", "on", 0, False)], "key string, output string, precedence int, candidate boolean")
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    rewrite_stream(docs, rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["doc_id"], r["rendered"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "dhe on"), (2, "odher")}
