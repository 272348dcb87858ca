"""Rows that every operator must take: nulls, empty and long texts, repeated rows, columns with clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, _id string, _text string, key string, "
          "counts string, kept string, row string, spans string, part int")


def texts() -> dict:
    r = random.Random(7)
    syllables = ["th", "er", "on", "an", "re", "ti", "ou", "ea", "é", "ü"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    out = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "Two words", 6: "a\x1cb  c\n\n d", 7: "日本語 😀 ½ café́ x", 8: "<|endoftext|> a <|startoftext|>b"}
    for i in range(10, 70):
        out[i] = "\n".join(prose(r.randint(3, 40)).capitalize() for _ in range(r.randint(1, 6)))
    out[70] = out[71] = out[20]  # copies
    out[72] = out[20].upper()
    out[73] = prose(20_000)
    out[74] = "a" * 60_000
    out[75] = "deadbeef01234567 " * 1500
    out[76] = "the same three words " * 400
    return out


def documents(spark, rows=None):
    rows = texts().items() if rows is None else rows
    made = [(i, t, [None, "en", "de"][(i or 0) % 3], "src", len(t or ""), 1, "x", "y", "k", "c", "t", "r", "s", 2) for i, t in rows]
    made += [x for x in made if x[0] == 5]  # a repeated row
    made.append((None, "no id", "en", "src", 5, 1, "x", "y", "k", "c", "t", "r", "s", 2))
    return spark.createDataFrame(made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    rows = {}
    for r in df.collect():
        rows.setdefault(r[0], []).append(r)
    return rows


def in_folder(spark, path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


__all__ = ["F", "by_id", "documents", "empty", "in_folder", "texts"]
