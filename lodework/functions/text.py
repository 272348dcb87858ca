"""Text folding and character inventory."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Latin letters that fold to more than one ASCII letter.
LIGATURES = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Þ": "TH", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
}
# Letters with a stroke or hook, which have no decomposition.
STROKES = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d",
           "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ı": "i"}


def _one_to_one() -> dict[str, str]:
    """Latin letters up to U+024F and U+1E00..U+1EFF whose decomposition starts with an ASCII letter."""
    table = dict(STROKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char not in LIGATURES and base.isascii() and base.isalpha():
            table[char] = base
    return table


def fold_ascii(column: Column) -> Column:
    """Latin text folded to ASCII letters; other characters stay."""
    table = _one_to_one()
    folded = F.translate(column, "".join(table), "".join(table.values()))
    for char, plain in LIGATURES.items():
        folded = F.replace(folded, F.lit(char), F.lit(plain))
    return folded


def fold_keys(df: DataFrame, column: str, name: str = "match_key") -> DataFrame:
    """Key for matching and removing duplicates: folded, lower case, single spaces."""
    return df.withColumn(name, F.trim(F.regexp_replace(F.lower(fold_ascii(F.col(column))), r"\s+", " ")))


@F.pandas_udf(T.StringType())
def _char_name(chars):
    return chars.map(lambda c: unicodedata.name(c, "") or None)


def char_inventory(df: DataFrame, column: str) -> DataFrame:
    """(char, uses, code_point, char_name) over whole texts.

    Characters are counted before the shuffle; only the distinct ones are named.
    """
    counted = (df.select(column).select(F.explode(F.split(F.col(column), "")).alias("char")).where(F.col("char") != "")
               .groupBy("char").agg(F.count(F.lit(1)).alias("uses")))
    return counted.withColumn("code_point", F.ascii("char").cast("long")).withColumn("char_name", _char_name("char"))
