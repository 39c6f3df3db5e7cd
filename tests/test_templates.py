"""Replacement templates, relation changes and dispositions: literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphshift.functions import strings
from glyphshift.operators import audit as A
from glyphshift.operators import lexicon as L
from glyphshift.operators import programs as P
from glyphshift.sources import readers, writers


@pytest.mark.parametrize("pattern, template, made", [
    ("(b)(c)", "$2$1", "acbd"), ("(b)(c)", "$$1", "a$1d"), ("(b)(c)", "<$&>", "a<bc>d"), ("(b)(c)", "$12", "ab2d"), ("(b)(c)", "$3", "a$3d"), ("(b)(c)", "$0", "a$0d"),
    ("(?<x>b)c", "$<x>$<y>", "abd"), ("bc", "[$`|$']", "a[a|d]d"), ("(b)c", "\\$", "a\\$d"), ("b(z)?c", "-$1-", "a--d"), ("x", "y", "abcd"),
])
def test_template(spark, pattern, template, made):
    t = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "id int, t string").select("id", strings.expand_template(F.col("t"), pattern, template).alias("t"))
    assert {r["id"]: r["t"] for r in t.collect()} == {1: made, 2: None, 3: ""}


def test_last_change_decides(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, form string")
    changes = spark.createDataFrame([(1, "remove", 1, None), (2, "add", 1, "x"), (3, "update", 2, "y"), (4, "remove", 2, None), (5, "add", 4, "z"), (6, "remove", 9, None)], "seq int, op string, id long, form string")
    assert sorted(map(tuple, L.changed_relations(now, changes).collect())) == [(1, "x"), (3, "c"), (4, "z")]


def test_relations_keep_nulls(spark):
    d = spark.createDataFrame([(1, None, "é\"\n"), (2, 0.5, None)], "id long, x double, t string")
    back = L.from_relations(L.as_relations({"d": (d, "id"), "e": (d, "id")}), "d", d.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))


def test_no_record_is_lost(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    got = A.dispositions(d, "id", [("fact", "is_a", F.col("x") == "a"), ("rule", "not_a", F.col("x") != "a")]).collect()
    assert {r["record"]: r["disposition"] for r in got} == {1: "fact", 2: "unclassified", 3: "rule"}


def test_dense_ids_of_uneven_ranges(spark):
    d = spark.createDataFrame([(k // 7 * 3, k) for k in range(500)], "a int, b int").repartition(5)
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir("/tmp/glyphshift-test")
    got = L.dense_ids(d, "a", "b").collect()
    assert {r["b"]: r["id"] for r in got} == {k: k for k in range(500)}
    assert L.dense_ids(d.limit(0), "a").count() == 0


def test_profile_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("b", False, 3), ("a", None, None)], "id string, enabled boolean, priority int")
    writers.write_profile(rules, str(tmp_path / "p"), "plain")
    assert sorted(map(tuple, readers.read_profile(spark, str(tmp_path / "p")).collect())) == [("plain", "a", True, 0), ("plain", "b", False, 3)]
    writers.write_profile(rules.union(rules), str(tmp_path / "q"), "twice")
    with pytest.raises(ValueError, match="twice"):
        readers.read_profile(spark, str(tmp_path / "q"))


def test_rule_tree(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"name": "r", "rules": [{"a": 1}], "children": [{"name": "x", "enabled": false, "children": [{"name": "y", "rules": [{"b": 2}, {"b": 3}]}]}, {}]}')
    got = {(r["locator"], tuple(r["node"]), r["enabled"], r["rule"]) for r in readers.read_rule_tree(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("/rules/0", ("r",), True, '{"a": 1}'), ("/children/0/children/0/rules/0", ("r", "x", "y"), False, '{"b": 2}'), ("/children/0/children/0/rules/1", ("r", "x", "y"), False, '{"b": 3}')}
    (tmp_path / "f.json").write_text('[{"c": 1}]')
    assert readers.read_rule_tree(spark, str(tmp_path / "f.json")).first()["locator"] == "/0"


def test_program_circles_and_dangling_calls(spark):
    rows = [("p", None, None, None, None, None, [], False, ["q"]), ("q", None, None, None, None, None, [("x", False)], None, ["p", "gone"])]
    programs = spark.createDataFrame(rows, P.PROGRAM)
    states = spark.createDataFrame([(1, "p", None, None, None, None), (2, "gone", "a", None, ["x"], {})], "state_id long, program string, profile string, symbol string, lexemes array<string>, context map<string,string>")
    assert [tuple(r) for r in P.dangling_calls(programs).collect()] == [("q", "gone")]
    with pytest.raises(ValueError, match="deeper"):
        P.run_programs(states, programs, depth=3)
    straight = programs.withColumn("calls", F.when(F.col("program") == "p", F.array(F.lit("q"))))
    assert [tuple(r) for r in P.run_programs(states, straight).collect()] == [(1, "x", False, False)]
