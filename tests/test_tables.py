"""Rule tables, projections, units, inflection and knowledge tables on literal cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from glyphshift.functions import strings
from glyphshift.operators import inflection, ir, knowledge, stages, units
from glyphshift.operators import projection as P
from glyphshift.sources import writers


def plan(*rows):
    base = {"stage": 0, "kind": "tokens", "id": "", "ord": 0, "priority": 0, "source": "", "target": "", "type": None, "match_target": None, "regex": False, "conditions": None, "sequence": None, "options": None, "enabled": True}
    return stages.Plan([base | {"ord": n} | {k: json.dumps(v) if k in ("conditions", "sequence", "options") else v for k, v in r.items()} for n, r in enumerate(rows)])


def tokens(*told):
    made = [dict(zip(("surface_form", "basic_form", "pos", "conjugated_form"), t)) for t in told]
    return lambda _: made


def test_dictionary_takes_priority_then_length_then_order():
    rules = [{"kind": "dictionary", "source": s, "target": t, "priority": p} for s, t, p in (("ab", "X", 0), ("abc", "Y", 0), ("bc", "Z", 0), ("c", "W", 5), ("[d,e]f", "V", 0), ("g*h", "<*>", 0), (r"\*", "star", 0))]
    run = lambda t: plan(*rules).run(t, None)
    assert run("abcab") == "YX" and run("xbcc") == "xZW" and run("dfef") == "VV"
    assert run("g--h gh") == "<--> <>" and run("a*b") == "astarb" and run("  ") == "  " and run(None) is None


def test_dictionary_folds_kana_and_annotates():
    rules = [{"kind": "dictionary", "source": "かう", "target": "買う", "options": {"kana_insensitive": True}}, {"kind": "dictionary", "source": "がく", "target": "学", "options": {"ruby_from_source": True}}, {"kind": "dictionary", "regex": True, "source": "(?<a>[0-9]+)年", "target": "$<a>/$$"}]
    assert plan(*rules).run("カウ がく 12年", None) == "買う ｜学《がく》 12/$"


def test_token_rules_by_context():
    rule = {"source": "なる", "target": "成る", "conditions": {"current": [{"pos": "動"}]}, "match_target": "basic_form"}
    assert plan(rule).run("なっ", tokens(("なっ", "なる", "動詞"))) == "成っ"
    assert plan(rule).run("なっ", tokens(("なっ", "なる", "名詞"))) == "なっ"
    mama = [{"source": "まま", "target": "儘", "conditions": {"current": [{"pos": "名"}], "prev": [{"pos": "-動詞"}]}, "priority": 1}, {"source": "まま", "target": "間々"}]
    assert plan(*mama).run("このまま", tokens(("この", "この", "連体詞"), ("まま", "まま", "名詞"))) == "この儘"
    assert plan(*mama).run("いるまま", tokens(("いる", "いる", "動詞"), ("まま", "まま", "名詞"))) == "いる間々"
    # A prev condition needs a token there.
    assert plan(*mama).run("まま", tokens(("まま", "まま", "名詞"))) == "間々"
    sequence = {"source": "面倒ごと", "target": "面倒事", "sequence": [{"surface": "面倒"}, {"surface": "ごと"}]}
    assert plan(sequence).run("面倒ごとだ", tokens(("面倒", "面倒", "名詞"), ("ごと", "ごと", "接尾"), ("だ", "だ", "助動詞"))) == "面倒事だ"
    adjective = {"source": "よい", "target": "良い", "type": "adjective"}
    assert plan(adjective).run("よかっ", tokens(("よかっ", "よい", "形容詞"))) == "良かっ" and plan(adjective).run("よし", tokens(("よし", "よい", "形容詞"))) == "よし"


def test_later_stage_keeps_a_shared_source():
    rules = [{"stage": 0, "kind": "dictionary", "source": "a, b", "target": "1"}, {"stage": 1, "kind": "dictionary", "source": "a", "target": "2"}]
    assert plan(*rules).run("ab", None) == "21"
    assert plan({**rules[0], "priority": 1}, rules[1]).run("ab", None) == "11"


def test_long_vowels_and_choice():
    assert plan({"kind": "long-vowels", "source": "バター", "target": "x", "options": {"min_length": 3}}).run("コンピューターのバターとキーとユーザーエラー", None) == "コンピュータのバターとキーとユーザエラ"
    pick = [stages.Rule({"source": "a", "target": "[x,y,z]"}, 0).template(m) for m in ("a", "a", "b")]
    assert pick[0] == pick[1] and set(pick) <= set("xyz")


def test_needs_tokens(spark):
    rows = [("a", None, None, None, None), ("b", "verb", None, None, None), ("c", None, "basic_form", None, None), ("d", None, None, '{"current":[],"prev":{"pos":"x"}}', None), ("e", "plain", " ", '{"current":[]}', "[]"), ("f", None, None, None, '[{"pos":"x"}]')]
    df = spark.createDataFrame(rows, "id string, type string, match_target string, conditions string, sequence string")
    assert {r["id"] for r in df.where(stages.needs_tokens(df)).collect()} == {"b", "c", "d", "f"}


def rule(id_, source, target, **more):
    return {"id": id_, "class": "orthographic", "channel": "reading", "from": source, "to": target, "lossless": False, "lossiness": "many_to_one", **more}


def test_projection_and_restoration():
    z, d = rule("z", ["ぢ", "じ"], ["じ"]), rule("d", ["づ", "ず"], ["ず"])
    got = P.Projector([z, d]).project({"surface": "鼻血", "reading": "はなぢ"})
    assert got["reading"] == "はなじ" and got["retained"] == {"reading": "はなぢ"} and got["steps"] == ["z"] and got["authority"] == "generated"
    p = P.Projector([z, d])
    assert p.restore({"surface": "三日月", "reading": "みかずき"}) == ("candidates", [("三日月", "みかずき", "forward_agreement"), ("三日月", "みかづき", "forward_agreement")])
    assert p.restore({"surface": "x", "reading": "かた"}) == ("unresolved", [("x", "かた", "forward_agreement")])
    assert p.restore({"surface": "x", "reading": "ず" * 9}) == ("unresolved", [])
    fact = {"id": "f", "kind": "historical_reading", "surface": "鼻血", "reading": "はなぢ", "lexemes": ["l"]}
    tied = P.Projector([rule("k", ["か"], ["が"])], facts=[fact])
    assert tied.restore({"surface": "鼻血", "reading": "はなじ", "lexemes": ["l"]})[0] == "resolved"
    assert tied.restore({"surface": "鼻血", "reading": "はなじ"})[0] == "unresolved"
    assert p.restore({"surface": "s", "reading": "はなじ", "retained": {"reading": "はなぢ"}}) == ("resolved", [("s", "はなぢ", "retained_identity")])


def test_projection_asks_and_binds():
    rules = [rule("a", ["x"], ["y"], channel="surface", period="old"), rule("b", ["x"], ["1", "2"], channel="surface"), rule("c", ["x"], ["z"], channel="surface", morphology={"usage": "u"}), rule("d", ["q"], ["r"], channel="surface", flags=["on"])]
    got = P.Projector(rules).project({"surface": "xq", "reading": None})
    assert got["surface"] == "xq" and got["blocked"] == ["a:predicate_mismatch:period", "b:one_to_many_requires_selection", "c:predicate_mismatch:morphology", "d:predicate_mismatch:policyFlag"]
    assert P.Projector(rules, flags={"on"}, period="old").project({"surface": "xq", "reading": None})["surface"] == "yr"
    bound = P.Projector([rule("s", ["x"], ["w"], channel="surface")], bindings=[{"rule": "s", "lexemes": ["symbol:x"], "context": {"usage": "u"}}])
    assert bound.project({"surface": "x", "morphology": {"usage": "u"}})["surface"] == "w" and bound.project({"surface": "x"})["surface"] == "x" and bound.project({"surface": "xx", "morphology": {"usage": "u"}})["surface"] == "xx"


def test_deinflection(spark):
    assert len(inflection.endings()) == 238
    words = spark.createDataFrame([(w,) for w in ("味わおう", "思わない", "書きます", "高かった", "勉強した", "行って", "x")], "surface string")
    lexicon = spark.createDataFrame([("味わう", "あじわう", ["v5u"]), ("思う", "おもう", ["v5u"]), ("書く", "かく", ["v5k"]), ("高い", "たかい", ["adj-i"]), ("勉強", "べんきょう", ["n", "vs"]), ("行く", "いく", ["v5k-s"]), ("思わ", "おもわ", ["n"])], "surface string, reading string, parts array<string>")
    got = {(r["surface"], r["base"], r["reading"]) for r in inflection.deinflected(words, lexicon).collect()}
    assert got == {("味わおう", "味わう", "あじわおう"), ("思わない", "思う", "おもわない"), ("書きます", "書く", "かきます"), ("高かった", "高い", "たかかった"), ("勉強した", "勉強", "べんきょうした"), ("行って", "行く", "いって")}


def test_unit_resolution(spark):
    words = spark.createDataFrame([("学校", "学校", None, False), ("合弁", "合弁", None, False), ("台風", "台風", None, False), ("今日", "今日", "きょう", False), ("未知", "未知", None, False), ("保", "学", None, True)], "id string, surface string, said string, protected boolean")
    lexicon = spark.createDataFrame([("学校", "l1", ["がっこう"], ["b0"], False), ("合弁", "l2", ["ごうべん"], ["petal", "manage"], False), ("台風", "l3", ["たいふう"], ["b3"], False), ("今日", "l4", ["こんにち"], ["b4"], False), ("今日", "l5", ["きょう"], ["b5"], False)], "surface string, identity string, readings array<string>, viable array<string>, morphology boolean")
    identities = spark.createDataFrame([("l1", "resolved", "sino", "がくかう", None, False), ("l5", "resolved", "native", "けふ", None, True)], "identity string, status string, route string, reading string, target string, needs_morphology boolean")
    contextual = spark.createDataFrame([("合弁", "合瓣", ["petal"], False, False), ("合弁", "合辦", ["manage"], False, False), ("台風", "颱風", [], False, False)], "surface string, target string, bindings array<string>, preserve boolean, candidate boolean")
    exact = spark.createDataFrame([("reading", "未知", "みち")], "channel string, surface string, target string")
    none = spark.createDataFrame([], "channel string, surface string, alternatives array<string>")
    got = {r["id"]: (r["kind"], r["disposition"], r["rendered"], r["kana"]) for r in units.resolved_units(words, lexicon, identities, contextual, exact, none, "学", "學").collect()}
    assert got == {"学校": ("resolved", "AUTO", "學校", "がくかう"), "合弁": ("resolved", "CANDIDATES", "合弁", None), "台風": ("resolved", "AUTO", "颱風", None), "今日": ("resolved", "SOURCE_REVIEW", "今日", None), "未知": ("resolved", "AUTO", "未知", "みち"), "保": ("protected", "PRESERVE", "学", None)}


def test_basic_forms(spark):
    cases = [("走った", "走る", "走る", "駆る", False, "駆った"), ("食べた", "食べる", "食べる", "喰う", False, "喰う"), ("飲んだ", "飲む", "呑む", "汲む", False, "汲む"), ("高く", "高い", "高い", "貴い", True, "貴く"), ("高し", "高い", "高い", "貴い", True, "高し")]
    df = spark.createDataFrame(cases, "s string, b string, f string, t string, a boolean, want string")
    got = df.select("want", strings.basic_form_replaced(*[F.col(c) for c in "sbfta"]).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_annotation_offsets(spark):
    line = "は｜今日《きょう》と学校《がっこう》へ"
    df = spark.createDataFrame([(line,)], "line string").select("line", strings.annotation_ranges("line").alias("r"))
    at = lambda a, b: F.struct(*[strings.to_annotated(F.col("r"), F.lit(a), F.lit(b))[c].alias(c) for c in ("start", "end")])
    row = df.select(at(0, 1).alias("a"), at(1, 3).alias("b"), at(3, 4).alias("c"), at(4, 5).alias("d"), at(6, 7).alias("e"), at(2, 5).alias("f")).first()
    assert [line[x["start"] : x["end"]] for x in row] == ["は", "｜今日《きょう》", "と", "学校《がっこう》", "へ", "｜今日《きょう》と学校《がっこう》"]


def test_compiled_rules_fail_closed(spark):
    facts = spark.createDataFrame([("f1", "form_relation", "學", "学", None, [], ["src"], [], None), ("f2", "form_relation", "學", "学", None, [], ["src", "candidate"], [], None)], "id string, kind string, surface string, target string, reading string, lexemes array<string>, tags array<string>, periods array<string>, origin string")
    table = ir.compiled(facts)
    assert {(r["direction"], r["input"], len(r["branches"])) for r in table.collect()} == {("to-historical", "学", 2), ("to-modern", "學", 2)}
    assert ir.verified(table).isEmpty()
    assert {(r["key"], r["output"], r["candidate"]) for r in ir.postings(table, "to-historical").collect()} == {("学", "學", False), ("学", "學", True)}


def test_policies_fail_closed(spark):
    rules = spark.createDataFrame([("a", None, True), ("b", "tar", True)], "id string, origin string, default_enabled boolean")
    make = lambda on, off: spark.createDataFrame([("p", on, off, ["historically_attested"])], "profile string, enable array<string>, disable array<string>, origins array<string>")
    assert [r["id"] for r in knowledge.disabled_rules(rules, make([], [])).collect()] == ["b"]
    for on, off in ((["x"], []), ([], ["x"]), (["b"], [])):
        with pytest.raises(ValueError):
            knowledge.disabled_rules(rules, make(on, off))


def test_rules_on_basic_forms_need_no_character_of_theirs_in_the_text():
    p = plan({"source": "doesbo", "target": "Zoesbo", "match_target": "basic_form"})
    assert p.run("DOESBO DORA", stages.spaced_tokens) == "ZoesboDORA"
    assert p.run("DORA EL", stages.spaced_tokens) == "DORA EL"


def test_a_lexeme_of_many_rows_is_asked_by_many(spark):
    """40,000 rows of one lexeme and 40,000 that ask for it are no pairs."""
    n = 40_000
    rows = spark.range(n).selectExpr("id AS row", "1L AS lexeme", "if(id = 7, 'unidic', 'jmdict') AS source", "if(id % 2 = 0 or id = 7, 's', null) AS surface", "if(id % 3 = 0 or id = 7, 'r', null) AS reading")
    asked = spark.range(n).selectExpr("id", "1L AS lexeme", "if(id % 2 = 0, 's', 't') AS surface", "if(id % 3 = 0, 'r', null) AS reading")
    got = {(r["surface"], r["reading"], r["row"]) for r in knowledge.morphology_row(asked, rows).select("surface", "reading", "row").distinct().collect()}
    assert got == {("s", "r", 7), ("s", None, None), ("t", "r", None), ("t", None, None)}
    few = rows.where("row in (1, 7)")
    assert {r["row"] for r in knowledge.morphology_row(asked.where("surface = 't'"), few.unionByName(few)).collect()} == {1}


def test_a_surface_of_many_rows_is_asked_by_many(spark):
    """40,000 rows of one surface and 40,000 that ask for it are no pairs."""
    n = 40_000
    rows = spark.range(n).selectExpr("array('x') AS forms", "array(concat('h', id % 3)) AS historical", "if(id % 2 = 0, array('law'), array('sea', 'art')) AS tags")
    asked = spark.range(n).selectExpr("id", "if(id % 5 = 0, 'y', 'x') AS surface", "if(id % 2 = 0, array('law', 'none'), array('none')) AS domains")
    got = units.domain_decision(asked, rows)
    assert got.count() == n
    assert {(r["status"], *r["candidates"], *r["matched"]) for r in got.drop("id").distinct().collect()} == {("not_found",), ("context_miss",), ("matched", "h0", "h1", "h2", "law")}


def test_lists_of_a_form_are_not_shuffled_with_its_records(spark):
    """The last join is the one with the lexemes, and nothing is dealt after it."""
    either = lambda a, b, name: f"if(id < 0, '{a}', '{b}') AS {name}"
    records = spark.range(300).selectExpr("id", either("symbol", "lexeme", "scope"), either("x", "admitted", "disposition"), either("historical_kana_sino", "form", "responsibility"), either("g", "f", "surface"), either("n", "m", "modern"), either("k", "h", "historical"))
    lexemes = spark.range(2000).selectExpr("'f' AS form", "concat('x', id) AS lexeme")
    patterns = spark.createDataFrame([("pattern:h>m",)], "id string")
    got = knowledge.authority_join(records, lexemes, patterns, "|")
    assert {len(r["targets"].split("|")) for r in got.collect()} == {2000}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_ = knowledge.authority_join(records, lexemes, patterns)._jdf.queryExecution().optimizedPlan().toString()
        outer = [line for line in plan_.splitlines() if "Join LeftOuter" in line]
        assert "surface" in outer[0] and "pattern" in outer[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_restoration_takes_facts_of_any_number(spark):
    """More facts than a table that is sent may have rows."""
    rules = spark.createDataFrame([("z", "orthographic", "reading", ["ぢ", "じ"], ["じ"], False, "many_to_one", [])], "id string, class string, channel string, `from` array<string>, `to` array<string>, lossless boolean, lossiness string, dependencies array<string>")
    facts = spark.range(P.MOST_SENT + 2).selectExpr("concat('f', id) AS id", "if(id = 1, 'form_relation', 'historical_reading') AS kind", "concat('s', id) AS surface", "concat('r', id) AS reading", "if(id = 1, 't', null) AS target", "array(concat('l', id)) AS lexemes")
    asked = spark.createDataFrame([("s7", "r", ["l7"]), ("t", "x", ["l1"]), ("none", "はなじ", []), (None, "x", [])], "surface string, reading string, lexemes array<string>")
    got = {r["surface"]: (r["status"], r["surfaces"], r["readings"]) for r in P.restored(asked, rules, facts).collect()}
    assert got["s7"] == ("resolved", ["s7"], ["r7"]) and got["t"] == ("resolved", ["s1"], ["x"])
    assert got["none"] == ("candidates", ["none", "none"], ["はなじ", "はなぢ"]) and got[None][0] == "unresolved"


def test_a_long_text_is_evaluated_in_one_pass(spark):
    """60,000 spans of one text of 240,000 characters."""
    n = 60_000
    docs = spark.createDataFrame([(1, "ab, " * n), (2, None), (3, "ab!")], "doc_id long, text string")
    unit = spark.createDataFrame([("ab", False, "resolved", "AUTO", "X"), ("ab", True, "protected", "PRESERVE", "ab")], "surface string, protected boolean, kind string, disposition string, rendered string")
    spans = spark.range(n).selectExpr("1L AS doc_id", "int(4 * id) AS start", "int(4 * id + 2) AS end", "id % 2 = 1 AS protected")
    got = {r["doc_id"]: r for r in units.evaluated(docs, spans, unit).collect()}
    assert got[1]["rendered"] == "X, ab, " * (n // 2) and tuple(got[1])[2:] == (n // 2, n // 2, 0, 0, n // 2, n)
    assert tuple(got[2])[1:] == (None, 0, 0, 0, 0, 0, None) and tuple(got[3])[1:] == ("ab!", 0, 0, 0, 0, 0, 1)
    plans = units.planned(docs, "[a-z]+", lambda k: k == 2, lambda k: False)
    assert {r["doc_id"]: r["resolved"] for r in units.evaluated_plans(plans, unit).collect()} == {1: n, 2: 0, 3: 1}


def test_long_lists_of_a_form_are_stored_once(spark, tmp_path):
    """Every record's row has its form's whole list, and the file has the list once."""
    n, k = 40, 200_000
    records = spark.range(n).selectExpr("id", "'lexeme' AS scope", "'admitted' AS disposition", "'form' AS responsibility", "IF(id = 7, 'none', 'f') AS surface", "'m' AS modern", "'h' AS historical")
    lexemes = spark.range(k).selectExpr("'f' AS form", "concat('x', id) AS lexeme")
    got = knowledge.authority_join(records, lexemes, spark.createDataFrame([("pattern:h>m",)], "id string"), "|").coalesce(1)
    size = lambda p: sum(f.stat().st_size for f in p.glob("*.parquet"))
    writers.write_repeated(got, str(tmp_path / "once"), "targets")
    back = spark.read.parquet(str(tmp_path / "once"))
    whole = "|".join(sorted(f"x{i}" for i in range(k)))
    assert {r["id"]: r["targets"] for r in back.collect()} == {i: "" if i == 7 else whole for i in range(n)}
    assert back.dtypes == got.dtypes
    assert size(tmp_path / "once") < 2 * len(whole)
    writers.write_repeated(got, str(tmp_path / "over"), "targets", dictionary_mb=1)
    assert size(tmp_path / "over") > 10 * size(tmp_path / "once")
    assert writers.table_digest(spark.read.parquet(str(tmp_path / "over"))).first() == writers.table_digest(back).first()
