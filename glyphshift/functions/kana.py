"""Kana as Column functions. The two syllabaries lie 0x60 apart, so tables are
built from code ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
#: Unvoiced kana whose voiced form is the next code point, and the row that also has a half-voiced one.
UNVOICED = "かきくけこさしすせそたちつてとはひふへほ"
VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼ"
HALF = "ぱぴぷぺぽ"


def to_hiragana(c: Column, marks: bool = False) -> Column:
    """Katakana as hiragana; with marks the iteration marks too."""
    return F.translate(c, KATAKANA + ("ヽヾ" if marks else ""), HIRAGANA + ("ゝゞ" if marks else ""))


def to_katakana(c: Column) -> Column:
    """Hiragana as katakana, iteration marks too."""
    return F.translate(c, HIRAGANA + "ゝゞ", KATAKANA + "ヽヾ")


def voiced(c: Column) -> Column:
    """A kana with the voicing mark, composed where Unicode has such a character;
    anything else as it is."""
    kana = c.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")
    table = F.translate(c, _PLAIN, _VOICED)
    return F.when(~kana, c).when(table != c, table).otherwise(F.concat(c, F.lit("\u3099")))


def _kata(s: str) -> str:
    return "".join(chr(ord(x) + 0x60) for x in s)


#: Characters whose voiced form is one character too, and that form, as Unicode composes them.
_PLAIN = UNVOICED + "うゝ" + _kata(UNVOICED) + "ウワヰヱヲヽ"
_VOICED = VOICED + "ゔゞ" + _kata(VOICED) + "ヴヷヸヹヺヾ"


def full_sokuon(c: Column, wanted: Column | None = None, same: Column | None = None) -> Column:
    """っ in full size, where that is wanted and both stand for the same historical
    spelling."""
    full = F.translate(c, "っッ", "つツ")
    return full if wanted is None else F.when(wanted & same, full).otherwise(c)


def modernized(c: Column) -> Column:
    """Historical spellings as they are written now: ゐゑを, the ぢづ pair, and くゎ
    and ぐゎ at the start."""
    out = F.translate(c, "ゐゑをぢづ", "いえおじず")
    return F.regexp_replace(F.regexp_replace(out, "^くゎ", "か"), "^ぐゎ", "が")


def half_digits(c: Column) -> Column:
    return F.translate(c, "".join(map(chr, range(0xFF10, 0xFF1A))), "0123456789")


def expand_marks(c: Column, boundaries: Column | None = None, strict: bool = True) -> Column:
    """ゝ, ヽ and 々 replaced by what stands before them, ゞ and ヾ by its voiced
    form. A mark at the start or at one of the boundaries (0-based places where a
    unit begins) has nothing to repeat, 〳 and 〵 need their span: both fail, or
    give null if not strict."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    marks = ("ゝ", "ヽ", "々", "ゞ", "ヾ")
    edge = lambda i: i == 0 if boundaries is None else (i == 0) | F.array_contains(boundaries, i)
    bad = F.exists(F.transform(chars, lambda x, i: x.isin("〳", "〵") | x.isin(*marks) & edge(i)), lambda b: b)

    def step(s: Column, x: Column) -> Column:
        new = F.when(x.isin("ゝ", "ヽ", "々"), s["last"]).when(x.isin("ゞ", "ヾ"), voiced(s["last"])).otherwise(x)
        return F.struct(F.concat(s["out"], new).alias("out"), new.alias("last"))

    out = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit("").alias("last")), step)["out"]
    return F.when(bad, F.raise_error(F.concat(F.lit("iteration mark without a base: "), c)).cast("string") if strict else F.lit(None)).otherwise(out)


def render_marks(c: Column, boundaries: Column | None = None) -> Column:
    """The second of two equal ideographs as 々, of two equal kana as ゝ or ヽ,
    and a voiced kana after its unvoiced form as ゞ or ヾ; none where a unit
    begins. It looks at the source on both sides, so each place is on its own."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")

    def mark(x: Column, i: Column) -> Column:
        before = F.get(chars, i - 1)
        inside = i > 0 if boundaries is None else (i > 0) & ~F.array_contains(boundaries, i)
        again, voicing = inside & (x == before), inside & (x != before) & (x == F.translate(before, _PLAIN, _VOICED))
        hira, kata = before.rlike(r"\p{IsHiragana}"), before.rlike(r"\p{IsKatakana}")
        return (
            F.when(again & before.rlike(r"\p{IsHan}"), F.lit("々"))
            .when(again & hira, F.lit("ゝ")).when(again & kata, F.lit("ヽ"))
            .when(voicing & hira, F.lit("ゞ")).when(voicing & kata, F.lit("ヾ"))
            .otherwise(x)
        )

    return F.array_join(F.transform(chars, mark), "")


def render_span(c: Column, span: Column) -> Column:
    """A span that ends the text twice over, the second time as 〳〵."""
    return F.when(c.endswith(F.concat(span, span)), F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(span)), F.lit("〳〵"))).otherwise(c)


def expand_span(c: Column, span: Column, strict: bool = True) -> Column:
    """〳〵 at the end replaced by the span that must stand before it; a mark at
    the start or after something else fails, or gives null if not strict."""
    head = F.substring(c, F.lit(1), F.length(c) - 2)
    bad = c.rlike("^[〳〵]") | c.endswith(F.lit("〳〵")) & ~head.endswith(span)
    fail = F.raise_error(F.concat(F.lit("span mark without its span: "), c)).cast("string") if strict else F.lit(None)
    return F.when(bad, fail).when(c.endswith(F.lit("〳〵")), F.concat(head, span)).otherwise(c)


def abbreviated_long_vowels(c: Column, excluded: tuple[str, ...] = (), shortest: int = 1) -> Column:
    """Katakana words without the long vowel mark at their end, or before a vowel
    kana that starts the next part. Parts that are excluded, or shorter than
    `shortest` with the mark, keep it and run on into what follows."""
    pieces = F.split(c, "(?<=ー)(?=[アイウエオ])|(?<=ー)(?![ァ-ヺー])")

    def step(s: Column, p: Column) -> Column:
        run = F.regexp_extract(F.concat(s["open"], p), "[ァ-ヺー]+$", 0)
        drop = run.endswith("ー") & (F.length(run) >= shortest) & ~run.isin(*excluded, "")
        kept = F.when(drop, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        return F.struct(F.concat(s["out"], kept).alias("out"), F.when(drop, F.lit("")).otherwise(run).alias("open"))

    return F.aggregate(pieces, F.struct(F.lit("").alias("out"), F.lit("").alias("open")), step)["out"]
