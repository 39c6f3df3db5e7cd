"""Inflected forms: what they may be inflections of, verb classes, and the least
ending that a verb needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings

#: The dictionary's classes of godan verbs: ending of the basic form, its a, i, e and o rows, て and た.
CLASSES = {
    "v5u": ("う", *strings.GODAN["う"]), "v5k": ("く", *strings.GODAN["く"]), "v5k-s": ("く", "か", "き", "け", "こ", "って", "った"), "v5g": ("ぐ", *strings.GODAN["ぐ"]),
    "v5s": ("す", *strings.GODAN["す"]), "v5t": ("つ", *strings.GODAN["つ"]), "v5n": ("ぬ", *strings.GODAN["ぬ"]), "v5b": ("ぶ", *strings.GODAN["ぶ"]), "v5m": ("む", *strings.GODAN["む"]),
    "v5r": ("る", *strings.GODAN["る"]), "v5r-i": ("る", *strings.GODAN["る"]), "v5aru": ("る", "ら", "い", "え", "ろ", "って", "った"),
}
MIZEN, RENYOU, ONBIN, KATEI, VOLITION = "未然形-一般", "連用形-一般", "連用形-音便", "仮定形-一般+ば", "意志推量形"
#: Endings after a godan row (a, i, e, o, て, た as 1 to 6 of a class) and what the form is called.
GODAN_FORMS = [
    (1, "ない", f"{MIZEN}+ない"), (1, "なかった", f"{MIZEN}+なかった"), (1, "ず", f"{MIZEN}+ず"), (1, "れる", f"{MIZEN}+れる"), (1, "せる", f"{MIZEN}+せる"),
    (2, "ます", f"{RENYOU}+ます"), (2, "ました", f"{RENYOU}+ました"), (2, "ません", f"{RENYOU}+ません"), (2, "たい", f"{RENYOU}+たい"), (2, "ながら", f"{RENYOU}+ながら"),
    (5, "", f"{ONBIN}+て"), (6, "", f"{ONBIN}+た"), (6, "ら", f"{ONBIN}+たら"), (5, "いる", f"{ONBIN}+ている"), (3, "ば", KATEI), (3, "る", "可能"), (4, "う", VOLITION),
]
#: Endings of the other classes, which replace that of the basic form.
OTHER_FORMS = {
    ("v1", "る"): [("ない", f"{MIZEN}+ない"), ("なかった", f"{MIZEN}+なかった"), ("ず", f"{MIZEN}+ず"), ("られる", f"{MIZEN}+られる"), ("させる", f"{MIZEN}+させる"), ("ます", f"{RENYOU}+ます"), ("ました", f"{RENYOU}+ました"), ("ません", f"{RENYOU}+ません"), ("たい", f"{RENYOU}+たい"), ("ながら", f"{RENYOU}+ながら"), ("て", f"{RENYOU}+て"), ("た", f"{RENYOU}+た"), ("たら", f"{RENYOU}+たら"), ("ている", f"{RENYOU}+ている"), ("れば", KATEI), ("よう", VOLITION), ("ろ", "命令形")],
    ("adj-i", "い"): [("く", RENYOU), ("くて", f"{RENYOU}+て"), ("かった", "連用形-促音便+た"), ("くない", f"{RENYOU}+ない"), ("ければ", KATEI), ("さ", "語幹+さ")],
    ("vs", ""): [("する", "終止形-一般"), ("した", f"{RENYOU}+た"), ("して", f"{RENYOU}+て"), ("します", f"{RENYOU}+ます"), ("しました", f"{RENYOU}+ました"), ("しない", f"{MIZEN}+ない"), ("しよう", VOLITION), ("すれば", KATEI), ("される", f"{MIZEN}+れる"), ("させる", f"{MIZEN}+させる"), ("している", f"{RENYOU}+ている")],
}


def endings() -> list[tuple[str, str, str, str]]:
    """(pos, inflected ending, ending of the basic form, form), made from the rows."""
    godan = [(pos, rows[at] + tail, rows[0], form) for pos, rows in CLASSES.items() for at, tail, form in GODAN_FORMS]
    return godan + [(pos, tail, base, form) for (pos, base), forms in OTHER_FORMS.items() for tail, form in forms]


def admits(parts: Column, pos: Column) -> Column:
    """Whether one of a lexeme's classes is a rule's; vs stands for vs-i and vs-s too."""
    return F.array_contains(parts, pos) | (pos == "vs") & F.arrays_overlap(parts, F.array(F.lit("vs-i"), F.lit("vs-s")))


def deinflected(words: DataFrame, lexicon: DataFrame, table: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """surface, base, pos, form, reading: the known words that each of
    words(surface) may be an inflection of, by lexicon(surface, reading, parts
    array): a word counts whose class the ending is of. The reading is the base's
    with the same ending; null where it ends otherwise. Every pair is kept. Lengths
    of endings are exploded, so both steps are equi joins."""
    rules = words.sparkSession.createDataFrame(table or endings(), "pos string, inflected string, base_end string, form string")
    sizes = sorted({len(e) for _, e, _, _ in table or endings()})
    cut = words.select("surface", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.length("surface") > F.col("n"))
    cut = cut.select("surface", F.expr("left(surface, length(surface) - n)").alias("stem"), F.expr("right(surface, n)").alias("inflected"))
    told = cut.join(F.broadcast(rules), "inflected").withColumn("base", F.concat("stem", "base_end"))  # a fixed table of a few hundred rows
    known = lexicon.select(F.col("surface").alias("base"), F.col("reading").alias("said"), "parts")
    hit = told.join(known, "base").where(admits(F.col("parts"), F.col("pos")))
    read = F.when(F.col("said").endswith(F.col("base_end")), F.concat(F.expr("left(said, length(said) - length(base_end))"), "inflected"))
    return hit.select("surface", "base", "pos", "form", read.alias("reading"))


def verb_class(pos: Column, basic: Column, kind: Column, form: Column) -> dict[str, Column]:
    """sahen, ichidan, godan; renyou before た or て, renyou otherwise."""
    verb = pos.eqNullSafe("動詞")
    has = lambda c, s: F.coalesce(F.contains(c, F.lit(s)), F.lit(False))
    ta = has(form, "タ接続") | has(form, "テ接続")
    return {"verb": verb, "sahen": verb & (basic.eqNullSafe("する") | has(kind, "サ変")), "ichidan": verb & has(kind, "一段"), "godan": verb & has(kind, "五段"), "renyou_ta": ta, "renyou": verb & has(form, "連用") & ~ta}


def minimal_suffix(surface: Column, pos: Column, basic: Column, kind: Column, form: Column, compress: bool = False) -> Column:
    """The least kana that a verb keeps after its ideographs; null for a form of
    する that has none. compress drops that of a renyou form."""
    c = verb_class(pos, basic, kind, form)
    trailing = strings.stem_and_okurigana(surface)[1]
    has = lambda s: F.coalesce(F.contains(form, F.lit(s)), F.lit(False))
    last = F.right(basic, F.lit(1))
    rows = F.create_map(*[x for k, v in strings.GODAN.items() for x in (F.lit(k), F.array(F.lit(k), *map(F.lit, v)))])
    row = F.try_element_at(rows, last)
    at = lambda k: F.get(row, F.lit(k))
    basic_like = has("基本") | has("連体")
    godan = (
        F.when(c["renyou_ta"] | row.isNull(), trailing).when(has("未然"), at(1)).when(has("連用"), F.lit("") if compress else at(2)).when(has("仮定") | has("命令"), at(3))
        .when(has("意志") | has("推量"), F.concat(at(4), F.lit("う"))).when(basic_like, at(0)).otherwise(trailing)
    )
    sahen = F.when(has("仮定") | has("命令"), "せ").when(basic_like, "す")
    ichidan = F.when(c["renyou"], F.lit("")).otherwise(trailing) if compress else trailing
    return F.when(c["sahen"], sahen).when(c["ichidan"], ichidan).when(~c["godan"], trailing).otherwise(godan)


def morphology_matches(required: Column, record: Column) -> Column:
    """Whether a record(pos array, type, form) is what a requirement(pos "a,b",
    type, form) asks: the first parts of speech, and equal type and form."""
    wanted = F.split(required["pos"], ",")
    pos = required["pos"].isNull() | record["pos"].isNotNull() & (F.slice(record["pos"], F.lit(1), F.size(wanted)) == wanted)
    same = [required[k].isNull() | required[k].eqNullSafe(record[k]) for k in ("type", "form")]
    return F.coalesce(pos & same[0] & same[1], F.lit(False))
