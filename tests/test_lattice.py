"""Segmentation lattices and sound histories against brute force and literal cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphshift.operators import histories as H
from glyphshift.operators import lattice as L
from glyphshift.operators import matching as M
from glyphshift.plans import registry

POLICIES = ["anywhere", "left_boundary", "right_boundary", "lexical_boundary", "whole_lexeme", None]


def paths(n: int, spans: set[tuple[int, int]]) -> list[list[tuple[int, int, bool]]]:
    """All cheapest paths over 0..n, by trying every one."""
    edges = [(s, e, True) for s, e in spans] + [(p, p + 1, False) for p in range(n)]
    done, held = [], [(0, [])]
    while held:
        at, path = held.pop()
        if at == n:
            done.append(path)
        held += [(e, [*path, (s, e, x)]) for s, e, x in edges if s == at]
    cost = lambda p: (sum(not x for _, _, x in p), len(p))
    least = min(map(cost, done))
    return [p for p in done if cost(p) == least]


def verdict(best, names, start, end, policy, identity):
    def structure(p):
        bounds = {0} | {e for _, e, _ in p}
        unit = (start, end, True) in p
        return unit if policy == "whole_lexeme" or identity else {"left_boundary": start in bounds, "right_boundary": end in bounds, "lexical_boundary": start in bounds and end in bounds}.get(policy, True)

    held = [structure(p) for p in best]
    if not all(held):
        return "ambiguous_lexical_boundary" if any(held) else "crosses_lexical_boundary"
    if identity and identity not in names.get((start, end), ()):
        return "lexical_identity_mismatch"
    return "ambiguous_lexical_identity" if identity and len(names[start, end]) > 1 else None


def test_gate_equals_brute_force(spark):
    pick = random.Random(5)
    lexical, asked, expected = [], [], {}
    for doc in range(120):
        n = pick.randint(2, 8)
        spans = {(s, min(n, s + pick.randint(1, 4))) for s in (pick.randrange(n) for _ in range(pick.randint(0, 8)))}
        names = {x: {f"w{k}" for k in range(pick.randint(1, 2))} for x in sorted(spans)}
        lexical += [(doc, s, e, w) for (s, e), ws in names.items() for w in ws]
        best = paths(n, spans)
        for i in range(12):
            s = pick.randrange(n)
            e, policy, identity = pick.randint(s + 1, n), pick.choice(POLICIES), pick.choice([None, None, "w0", "w1"])
            asked.append((doc, s, e, policy, identity, i))
            expected[doc, i] = verdict(best, names, s, e, policy, identity)
    words = spark.createDataFrame(lexical, "doc_id long, start int, end int, lexeme string")
    found = L.gate(spark.createDataFrame(asked, "doc_id long, start int, end int, policy string, identity string, i int"), words).collect()
    assert {(r["doc_id"], r["i"]): r["reason"] for r in found} == expected and len(found) == len(asked)
    assert all(r["ok"] == (r["reason"] is None) for r in found)


def test_gate_query_equals_brute_force_on_short_texts(spark):
    docs = spark.createDataFrame([(1, "the heathen an"), (2, ""), (3, None), (4, "tionan")], "doc_id long, text string")
    words = spark.createDataFrame([("the", "a"), ("hea", "b"), ("an", "c"), ("then", "d")], "key string, lexeme string")
    asked = spark.createDataFrame([("he", "lexical_boundary", None), ("then", "whole_lexeme", None)], "key string, policy string, identity string")
    got = {(r["doc_id"], r["key"], r["start"]): r["reason"] for r in L.gate(M.substring_matches(docs, asked), M.substring_matches(docs, words)).collect()}
    # "heathen": hea + then covers all, so the first "he" is cut at its end.
    assert got == {(1, "he", 1): "crosses_lexical_boundary", (1, "he", 4): "crosses_lexical_boundary", (1, "he", 8): "crosses_lexical_boundary", (1, "then", 7): None}
    assert "a19_applicability_gate" in registry.QUERIES


def test_segmentations_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, start int, end int, lexeme string")
    assert L.segmentations(none).count() == 0
    asked = spark.createDataFrame([(1, 0, 2, "lexical_boundary", None)], "doc_id long, start int, end int, policy string, identity string")
    assert L.gate(asked, none).first()["ok"]


@pytest.mark.parametrize("context, taken", [(H.ANY, ["x", "y", "z"]), (None, ["z"]), ("a", ["x"]), ("q", [])])
def test_bindings_of_a_context(spark, context, taken):
    words = spark.createDataFrame([(1, 0, "S", "kou")], "word_id long, place int, symbol string, modern string")
    bindings = spark.createDataFrame([("S", "kou", "a", ["x"]), ("S", "kou", "b", ["y"]), ("S", "kou", None, ["z"])], "symbol string, modern string, context string, patterns array<string>")
    got = H.chosen_bindings(words, bindings, context).select(F.col("patterns")[0].alias("p")).collect()
    assert sorted(r["p"] for r in got) == taken


def test_unqualified_binding_serves_where_none_is_qualified(spark):
    words = spark.createDataFrame([(1, 0, "S", "kou")], "word_id long, place int, symbol string, modern string")
    bindings = spark.createDataFrame([("S", "kou", None, ["z"])], "symbol string, modern string, context string, patterns array<string>")
    assert H.chosen_bindings(words, bindings, "q").count() == 1


def test_gates_of_a_long_text_meet_in_its_row():
    """100,000 words and as many candidates; a shape is solved once."""
    n = 100_000
    words = [x for i in range(n) for x in ((5 * i, 5 * i + 3, "a"), (5 * i + 2, 5 * i + 4, "b"))]
    asked = [(5 * i + k, 5 * i + 4, "left_boundary", None) for i in range(n) for k in (1, 4)]
    L._shape.cache_clear()
    got = L.refusals(words, asked)
    assert set(got[1::2]) == {None} and len(set(got[::2])) == 1 and L._shape.cache_info().misses == 1
