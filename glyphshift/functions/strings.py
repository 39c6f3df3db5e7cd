"""Characters, patterns, annotations and identifiers as Column functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KANA, HAN = r"ぁ-ゟ゠-ヿㇰ-ㇿｦ-ﾟ", r"一-鿿㐀-䶿々〆〇ヶ"
KATAKANA = r"゠-ヿㇰ-ㇿｦ-ﾟ"


def contains_kanji(c: Column) -> Column:
    return c.rlike(f"[{HAN}]")


def is_kana(c: Column) -> Column:
    return c.rlike(f"^[{KANA}]+$")


def is_katakana(c: Column) -> Column:
    return c.rlike(f"^[{KATAKANA}]+$")


def has_trailing_long_vowel(c: Column) -> Column:
    return is_katakana(c) & c.endswith("ー")


def stem_and_okurigana(c: Column) -> tuple[Column, Column]:
    return F.regexp_extract(c, f"^(.*?)([{KANA}]*)$", 1), F.regexp_extract(c, f"^(.*?)([{KANA}]*)$", 2)


def kana_kanji_segments(c: Column) -> Column:
    """Parts of a text; one begins at each ideograph that follows kana."""
    return F.filter(F.split(c, f"(?<=[{KANA}])(?=[{HAN}])"), lambda x: x != "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share at the start."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.size(F.filter(same, lambda x: x)) - 1


def shared_suffix(a: Column, b: Column) -> Column:
    n = common_prefix_length(F.reverse(a), F.reverse(b))
    return F.when(n == 0, F.lit("")).otherwise(F.right(a, n))


def split_listed(items: Column) -> tuple[Column, Column]:
    """(positive, negative) of an array of items; `-x` is negative, `\\-x` the literal -x."""
    plain = lambda x: F.when(x.startswith("\\-"), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    signed = lambda x: x.startswith("-")
    pos = F.transform(F.filter(items, lambda x: ~signed(x)), plain)
    neg = F.transform(F.filter(items, signed), lambda x: plain(F.trim(F.substring(x, F.lit(2), F.length(x)))))
    return F.filter(pos, lambda x: x != ""), F.filter(neg, lambda x: x != "")


def split_signed(c: Column, sep: str = ",") -> tuple[Column, Column]:
    """(positive, negative) items of a list; `-x` is negative, `\\-x` the literal -x."""
    items = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    pos = F.transform(F.filter(items, lambda x: ~x.startswith("-")), lambda x: F.when(x.startswith("\\-"), F.substring(x, F.lit(2), F.length(x))).otherwise(x))
    return pos, F.transform(F.filter(items, lambda x: x.startswith("-")), lambda x: F.substring(x, F.lit(2), F.length(x)))


def glob_regex(c: Column, lazy: bool = True, anchored: bool = True) -> Column:
    """Java pattern of a wildcard string: * takes anything and is captured."""
    body = F.regexp_replace(F.regexp_replace(c, r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", "(.*?)" if lazy else "(.*)")
    return F.concat(F.lit("^"), body, F.lit("$")) if anchored else body


def glob_matches(value: Column, pattern: Column) -> Column:
    return F.regexp_like(value, glob_regex(pattern))


def value_matches(value: Column, positive: Column, negative: Column, fold=None) -> Column:
    """None of the negative patterns and, if there are any, one of the positive."""
    fold = fold or (lambda x: x)
    hit = lambda p: glob_matches(fold(value), fold(p))
    return ~F.exists(negative, hit) & ((F.size(positive) == 0) | F.exists(positive, hit))


def first_match(value: Column, patterns: Column) -> Column:
    """The first pattern that matches, null if none does."""
    return F.get(F.filter(patterns, lambda p: glob_matches(value, p)), F.lit(0))


def explicit_ruby(c: Column) -> Column:
    """Annotations ｜base《reading》 as array<struct<base,reading>>."""
    pattern = "｜([^《》｜]+)《([^《》]+)》"
    bases, readings = F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2)
    return F.transform(F.arrays_zip(bases.alias("base"), readings.alias("reading")), lambda x: F.struct(x["base"].alias("base"), x["reading"].alias("reading")))


def implicit_ruby_to_explicit(c: Column) -> Column:
    """A reading after a run of ideographs gets the bar that marks its base."""
    return F.regexp_replace(c, rf"(^|[^｜{HAN}])([{HAN}]+)《([{KANA}]+)》", "$1｜$2《$3》")


def without_ruby(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "《[^《》]*》", ""), "｜", "")


_ANNOTATION = re.compile(rf"(?:(｜)([^《》｜]+)|([{HAN}]+))《([^《》]+)》")


def annotations(text: str | None) -> list[dict[str, int]]:
    """Annotations base《reading》 of a text, with or without the bar, in order:
    where the base lies in the text without annotations (0-based), and where bar,
    base and reading lie in this one."""
    out, added = [], 0
    for m in _ANNOTATION.finditer(text or ""):
        size, start = len(m[2] or m[3]), m.start() - added
        out.append({"base_start": start, "base_end": start + size, "start": m.start(), "end": m.end()})
        added += m.end() - m.start() - size
    return out


#: As an Arrow UDF: each place depends on all before it.
annotation_ranges = F.udf(annotations, T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("base_start", "base_end", "start", "end")])), useArrow=True)


def to_annotated(ranges: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of a range of the text without annotations in the text
    with them: the whole annotations that it touches, else moved by what the ones
    before it add."""
    hit = F.filter(ranges, lambda r: (start < r["base_end"]) & (end > r["base_start"]))
    added = F.aggregate(F.filter(ranges, lambda r: r["base_end"] <= start), F.lit(0), lambda n, r: n + (r["end"] - r["start"]) - (r["base_end"] - r["base_start"]))
    none = F.size(hit) == 0
    return F.struct(F.when(none, start + added).otherwise(F.get(hit, F.lit(0))["start"]).alias("start"), F.when(none, end + added).otherwise(F.element_at(hit, -1)["end"]).alias("end"))


def bound(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def factor_ruby(surface: Column, reading: Column) -> Column:
    """struct(prefix, base, reading, suffix): what both ends of the surface share
    with the reading; base null if the middle isn't all ideographs."""
    part = lambda c, a, n: F.substring(c, a, n)

    def ends(h: Column) -> Column:
        rest, said = part(surface, h + 1, F.length(surface)), part(reading, h + 1, F.length(reading))
        tail = common_prefix_length(F.reverse(rest), F.reverse(said))
        return bound(F.struct(h.alias("h"), rest.alias("rest"), said.alias("said"), tail.alias("tail")), middle)

    def middle(x: Column) -> Column:
        base, ruby = part(x["rest"], F.lit(1), F.length(x["rest"]) - x["tail"]), part(x["said"], F.lit(1), F.length(x["said"]) - x["tail"])
        ok = base.rlike(r"^\p{IsHan}+$") & (ruby != "")
        return F.struct(part(surface, F.lit(1), x["h"]).alias("prefix"), F.when(ok, base).alias("base"), F.when(ok, ruby).alias("reading"), F.right(x["rest"], x["tail"]).alias("suffix"))

    return bound(common_prefix_length(surface, reading), ends)


RUBY_MODES = ("plain", "ruby-whole-explicit", "ruby-whole-implicit", "ruby-components-explicit", "ruby-components-implicit")


def render_ruby(surface: Column, reading: Column, mode: Column, historical: Column | bool = True, components: Column | None = None) -> Column:
    """plain, ruby-whole-explicit, ruby-whole-implicit, ruby-components-explicit,
    ruby-components-implicit. A historical reading is factored: literal kana at
    both ends bears none. components array<struct<surface, reading>>: if one has
    no reading, the whole bears it. Without a reading, the surface alone."""
    plain = F.concat(surface, F.lit("《"), reading, F.lit("》"))
    factored = bound(factor_ruby(surface, reading), lambda f: F.coalesce(F.concat(f["prefix"], f["base"], F.lit("《"), f["reading"], F.lit("》"), f["suffix"]), plain))
    whole = F.when(F.lit(historical), factored).otherwise(plain)
    parts = F.lit(None).cast("string")
    if components is not None:
        full = (F.size(components) > 0) & F.forall(components, lambda x: x["reading"].isNotNull() & (x["reading"] != ""))
        parts = F.when(full, F.array_join(F.transform(components, lambda x: F.concat(x["surface"], F.lit("《"), x["reading"], F.lit("》"))), ""))
    bar = F.when(mode.isin("ruby-whole-explicit", "ruby-components-explicit"), "｜").otherwise("")
    made = F.when(mode.startswith("ruby-components"), F.coalesce(parts, whole)).otherwise(whole)
    return F.when(reading.isNull() | (reading == "") | ~mode.isin(*RUBY_MODES[1:]), surface).otherwise(F.concat(bar, made))


def atoms(c: Column) -> Column:
    """Base characters with the combining marks and variation selectors after them."""
    return F.regexp_extract_all(c, F.lit(r"(?s).[̀-゙゚ͯ︀-️]*"), F.lit(0))


def unescaped(c: Column) -> Column:
    r"""\x as x for any x; a backslash at the end stays."""
    return F.regexp_replace(c, r"\\(.)", "$1")


def bracketed_forms(example: Column) -> Column:
    """array<struct<preferred, alternative>> of an example such as 揚（上）がる: the
    ideographs before the bracket or those inside, with the kana after it."""
    pattern = r"(\p{IsHan}+)（(\p{IsHan}+)）([ぁ-ゖ]*)"
    part = lambda n: F.regexp_extract_all(example, F.lit(pattern), F.lit(n))
    whole = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("k"))
    return F.transform(whole, lambda x: F.struct(F.concat(x["a"], x["k"]).alias("preferred"), F.concat(x["b"], x["k"]).alias("alternative")))


def typed_id(space: Column, key: Column) -> Column:
    return F.concat(space, F.lit(":"), key)


def id_parts(c: Column) -> tuple[Column, Column]:
    return F.split_part(c, F.lit(":"), F.lit(1)), F.regexp_replace(c, "^[^:]*:", "")


def stable_id_part(c: Column) -> Column:
    """A text as a part of an id: all but letters, digits and -_.!~*'() as %XX."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def _canonical(text: str | None) -> str | None:
    return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


#: JSON with keys sorted at every depth and no spaces; as an Arrow UDF, for depth has no bound.
canonical_json = F.udf(_canonical, T.StringType(), useArrow=True)


def short_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, n)


def slashed_dates(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1/$2/$3")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over ASCII characters, as long."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF))


def canonical(c: Column) -> Column:
    """A set of strings: distinct, sorted, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


#: Endings that an adjective in い takes, in the word that is replaced and in its replacement alike.
ADJECTIVE_ENDINGS = ("い", "く", "かっ", "けれ", "かれ", "さ")


def basic_form_replaced(surface: Column, basic: Column, source: Column, target: Column, adjective: Column) -> Column:
    """What stands for an inflected surface when its basic form, source, becomes
    target. Where the basic form is another, target itself. An adjective keeps its
    ending, or stays if it has none that is known; a verb keeps what follows the
    stem that source and target don't share, if they share an ending and the
    surface begins with that stem, else target itself."""
    shared = shared_suffix(source, target)
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    from_, to = cut(source, F.length(shared)), cut(target, F.length(shared))
    verb = F.when((shared == "") | (from_ == "") | ~surface.startswith(from_), target).otherwise(F.concat(to, F.substring(surface, F.length(from_) + 1, F.length(surface))))
    a, b = cut(source, 1), cut(target, 1)
    varied = source.endswith("い") & target.endswith("い") & (a != "") & (b != "") & (source != target)
    fits = F.filter(F.array(*map(F.lit, ADJECTIVE_ENDINGS)), lambda e: F.concat(a, e) == surface)
    kept = F.when(varied & (F.size(fits) > 0), F.concat(b, F.get(fits, F.lit(0)))).otherwise(surface)
    return F.when((source == "") | (target == "") | (basic != source), target).when(adjective, kept).otherwise(verb)


#: Rows of godan verbs: the ending of the basic form, those of the a, i, e and o rows, て and た.
GODAN = {
    "う": ("わ", "い", "え", "お", "って", "った"), "く": ("か", "き", "け", "こ", "いて", "いた"), "ぐ": ("が", "ぎ", "げ", "ご", "いで", "いだ"),
    "す": ("さ", "し", "せ", "そ", "して", "した"), "つ": ("た", "ち", "て", "と", "って", "った"), "ぬ": ("な", "に", "ね", "の", "んで", "んだ"),
    "ぶ": ("ば", "び", "べ", "ぼ", "んで", "んだ"), "む": ("ま", "み", "め", "も", "んで", "んだ"), "る": ("ら", "り", "れ", "ろ", "って", "った"),
}


def surface_variants(source: Column, target: Column, adjective: Column) -> Column:
    """array<struct<from, to>>: the inflected forms in which a basic form may be
    met and what stands for each; none if the two don't end alike."""
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    last = F.right(source, F.lit(1))
    rows = F.create_map(*[x for k, v in GODAN.items() for x in (F.lit(k), F.array(F.lit(k), *map(F.lit, v)))])
    ends = F.when(adjective, F.when(last == "い", F.array(*map(F.lit, ADJECTIVE_ENDINGS)))).otherwise(F.try_element_at(rows, last))
    ok = (last == F.right(target, F.lit(1))) & (F.length(source) > 1) & (F.length(target) > 1) & ends.isNotNull()
    made = F.transform(ends, lambda e: F.struct(F.concat(cut(source), e).alias("from"), F.concat(cut(target), e).alias("to")))
    none = F.array().cast("array<struct<from:string,to:string>>")
    return F.when(ok, F.array_distinct(F.filter(made, lambda x: x["from"] != x["to"]))).otherwise(none)


_MARK = re.compile(r"\$(?:(?P<sign>[$&`'])|<(?P<name>[A-Za-z]\w*)>|(?P<number>\d\d?))")


def template_parts(template: str, groups: int, names: tuple[str, ...] = ()) -> list[tuple[str, object]]:
    """Pieces of a replacement template: ("text", str), ("group", number or name)
    and ("before" | "after", None) for what surrounds the match. A two-digit
    number that no group has is a one-digit one with a digit after it; a number
    without a group stays as it's written, an unknown name gives nothing."""
    parts, at = [], 0
    for m in _MARK.finditer(template):
        parts.append(("text", template[at : m.start()]))
        at = m.end()
        if m["sign"]:
            parts.append({"$": ("text", "$"), "&": ("group", 0), "`": ("before", None), "'": ("after", None)}[m["sign"]])
        elif m["name"]:
            parts.append(("group", m["name"]) if m["name"] in names else ("text", ""))
        else:
            digits = next((d for d in (m["number"], m["number"][0]) if 0 < int(d) <= groups), None)
            parts += [("group", int(digits)), ("text", m["number"][len(digits) :])] if digits else [("text", m[0])]
    return [p for p in [*parts, ("text", template[at:])] if p[1] != ""]


def expand_template(text: Column, pattern: str, template: str) -> Column:
    """text with every match of pattern replaced by the template. JVM-side, but
    for templates that quote what surrounds the match, which Spark's own
    replacement can't: those go through Arrow batches. The pattern is to mean
    the same to Java and Python; names are written (?<name>...)."""
    own = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    parts = template_parts(template, own.groups, tuple(own.groupindex))
    if not any(kind in ("before", "after") for kind, _ in parts):
        java = "".join(f"${{{x}}}" if isinstance(x, str) and kind == "group" else f"${x}" if kind == "group" else x if kind == "raw" else re.sub(r"([\\$])", r"\\\1", x) for kind, x in _apart(parts))
        return F.regexp_replace(text, F.lit(pattern), F.lit(java))

    def fill(m: re.Match) -> str:
        said = {"text": lambda x: x, "group": lambda x: m[x] or "", "before": lambda _: m.string[: m.start()], "after": lambda _: m.string[m.end() :]}
        return "".join(said[kind](x) for kind, x in parts)

    @F.pandas_udf("string")
    def expanded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else own.sub(fill, t))

    return expanded(text)


def _apart(parts: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """A digit after a group's number would be read as part of it where such a
    group exists; escaped, it's a digit."""
    out = []
    for kind, x in parts:
        if kind == "text" and out and out[-1][0] == "group" and x[0].isdigit():
            out.append(("raw", "\\" + x[0]))
            x = x[1:]
        if x != "":
            out.append((kind, x))
    return out
