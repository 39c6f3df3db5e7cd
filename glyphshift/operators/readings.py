"""Historical readings of words by their characters, from a table of relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kana
from . import workers
from .projection import sent_rows

#: More spellings than this leave a word unresolved.
MOST = 64
CODAS = ("く", "き", "ち", "つ")
_SYLLABLE = re.compile(r"[ぁ-ゔ][ゃゅょゎ]?[いうくきちつんっ]?")
_HAN = re.compile(r"[々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")


def in_word_forms(modern: Column, historical: Column) -> Column:
    """array<struct<modern, historical>>: the forms that a reading takes inside a
    word: as it is; with a last く, き, ち or つ as っ; of one in ふ, its rest in
    modern spelling with っ; and each of these with its first kana voiced, or
    half-voiced, on both sides."""
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    pair = lambda m, h: F.struct(m.alias("modern"), h.alias("historical"))
    base = F.array_compact(F.array(
        pair(modern, historical),
        F.when(F.right(modern, F.lit(1)).isin(*CODAS), pair(F.concat(cut(modern), F.lit("っ")), historical)),
        F.when(historical.endswith("ふ"), pair(F.concat(kana.modernized(cut(historical)), F.lit("っ")), F.concat(cut(historical), F.lit("っ")))),
    ))

    def with_first(x: Column, plain: str, other: str) -> Column:
        first = lambda c: F.translate(F.substring(c, F.lit(1), F.lit(1)), plain, other)
        known = F.substring(x["modern"], F.lit(1), F.lit(1)).isin(*plain) & F.substring(x["historical"], F.lit(1), F.lit(1)).isin(*plain)
        rest = lambda c: F.substring(c, F.lit(2), F.length(c))
        return F.when(known, pair(F.concat(first(x["modern"]), rest(x["modern"])), F.concat(first(x["historical"]), rest(x["historical"]))))

    voiced = F.transform(base, lambda x: with_first(x, kana.UNVOICED, kana.VOICED))
    half = F.transform(base, lambda x: with_first(x, "はひふへほ", kana.HALF))
    return F.concat(base, F.array_compact(voiced), F.array_compact(half))


def direct(asked: DataFrame, relations: DataFrame) -> DataFrame:
    """asked(character, modern, any_context, context) plus status and readings of
    relations(character, modern, context, historical): every usage, or those of
    one context, null being the unqualified ones. None, resolved or candidates."""
    same = F.col("any_context") | F.col("context").eqNullSafe(F.col("_context"))
    r = relations.select("character", "modern", F.col("context").alias("_context"), "historical")
    hit = asked.join(r, ["character", "modern"], "left").groupBy(*asked.columns).agg(F.array_sort(F.collect_set(F.when(same, F.col("historical")))).alias("readings"))
    status = F.when(F.size("readings") == 0, F.lit("none")).when(F.size("readings") == 1, F.lit("resolved")).otherwise(F.lit("candidates"))
    return hit.select(*asked.columns, status.alias("status"), "readings")


def _options(forms: dict, own: set, character: str, segment: str, any_context: bool, context: str | None) -> list[tuple[str, bool]]:
    """(historical, has evidence) for a character over a piece of the reading."""
    if not _SYLLABLE.fullmatch(segment):
        return []
    all_ = forms.get((character, segment), [])
    found = all_
    if not any_context and all_:
        found = [x for x in all_ if x[1] == context]
        if not found:
            if any(c is not None for _, c in all_):
                return []
            found = [x for x in all_ if x[1] is None]
    if found:
        return [(h, True) for h, _ in found]
    return [] if segment.endswith("っ") or (character, segment) in own else [(segment, False)]


def spellings(forms: dict, own: set, surface: str | None, reading: str | None, any_context: bool = True, context: str | None = None, most: int = MOST) -> list[str] | None:
    """All historical spellings of a word, sorted; null if there is none or there
    are more than `most`. Characters in turn; what stands before a place is a set."""
    if not surface or not reading or not _HAN.fullmatch(surface):
        return None
    n, m = len(surface), len(reading)
    # Steps from each place of the reading to a later one, for each character.
    steps = [{at: [(end, h) for end in range(at + 1, min(m, at + 4) + 1) for h, _ in _options(forms, own, c, reading[at:end], any_context, context)] for at in range(i, m)} for i, c in enumerate(surface)]
    ends = {m}
    live = [set()] * n + [ends]
    for i in range(n - 1, -1, -1):
        live[i] = {at for at, on in steps[i].items() if any(end in live[i + 1] for end, _ in on)}
    if 0 not in live[0]:
        return None
    states: dict[int, set[str]] = {0: {""}}
    for i in range(n):
        after: dict[int, set[str]] = {}
        for at, done in states.items():
            for end, h in steps[i][at]:
                if end in live[i + 1]:
                    after.setdefault(end, set()).update(d + h for d in done)
        states = after
        # What stands before a place that can be completed gives as many spellings at least.
        if any(len(done) > most for done in states.values()):
            return None
    return sorted(states[m])


def reconstructed(words: DataFrame, relations: DataFrame, most: int = MOST) -> DataFrame:
    """words(surface, reading and, if there, any_context, context) plus status
    (none, resolved, candidates) and spellings, by relations(character, modern,
    context, historical), which every task holds if they are few enough. A word of
    any length; more than `most` spellings are none."""
    workers.prepare(words.sparkSession)
    made = relations.select("character", "context", F.explode(in_word_forms(F.col("modern"), F.col("historical"))).alias("f")).select("character", "context", "f.modern", "f.historical").distinct()
    rows = sent_rows(made)
    shared = words.sparkSession.sparkContext.broadcast([(r["character"], r["modern"], r["historical"], r["context"]) for r in rows])
    asked = "any_context" in words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[tuple[str, str], list] = {}
        for character, modern, historical, context in shared.value:
            forms.setdefault((character, modern), []).append((historical, context))
        own = set(forms)
        for batch in batches:
            n = batch.num_rows
            any_, context = (batch.column(c).to_pylist() for c in ("any_context", "context")) if asked else ([True] * n, [None] * n)
            got = [spellings(forms, own, *x, most=most) for x in zip(batch.column("surface").to_pylist(), batch.column("reading").to_pylist(), any_, context)]
            status = ["none" if x is None else "resolved" if len(x) == 1 else "candidates" for x in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string()), pa.array([x or [] for x in got], pa.list_(pa.string()))], [*batch.schema.names, "status", "spellings"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{kept}, status string, spellings array<string>")
