"""Inputs that queries share: words of all documents, spelt in other scripts by
letter, so that operators on kana and ideographs meet every word of the corpus.
None of the tables holds Japanese text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import table

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: A character for each letter: marks and voicing pairs; spellings that changed; kana and ideographs; ideographs alone; katakana.
MARKS = "人がヽゞかきぱばくカ々さびあゝしヾざすゝはウヴくー漢"
OLD = "ゑヰヶカゐンゔゎぢ漢ヴヽヲづをぁあっッくんゞぐヾゝヺ"
MIXED = "あ学校い字う口え日ラ木水お月火山川森う田ー国人々ン村"
READ = "あかきいさうけえにらもみおつひやりえうたーこんまんら"
HAN = "亜学校意字宇口江日羅木水尾月火山川森雨田原国人楽本村"
KATA = "アカキイサウケエニラモミオツヒヤリエウターコンマンラ"

#: Distinct words of one script's letters, as SQL: words(w).
WORDS = "words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '')"


def words(spark, sf_dir) -> DataFrame:
    """w: the distinct runs of a to z in the lower-case texts of documents."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()


def spelt(c: Column, script: str) -> Column:
    return F.translate(c, LATIN, script)


def spelt_sql(c: str, script: str) -> str:
    return f"translate({c}, '{LATIN}', '{script}')"


def chars_sql(c: str) -> str:
    """A DuckDB list of the characters of a string."""
    return f"string_split({c}, '')"
