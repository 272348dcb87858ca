"""String similarity of pairs, and similarity joins without a cross product."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodework.operators.search import bigrams
from lodework.session import stage


def edit_sim(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer text; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def gram_set(text: Column) -> Column:
    return F.array_distinct(bigrams(F.concat(F.lit(" "), text, F.lit(" "))))


def overlap_share(x: Column, y: Column) -> Column:
    """Shared elements over the larger set."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def bigram_sim(a: Column, b: Column) -> Column:
    """Distinct 2-grams of `` text `` in both, over the larger number."""
    return overlap_share(gram_set(a), gram_set(b))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def token_sim(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, cosine, jaccard) of the words of two texts per row, for texts of any length.

    Words are counted per (row, word) with partial sums, so the work is linear in the texts.
    """
    def side(column, mine, other):
        words = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return pairs.select(key, F.explode(words).alias("w"), F.lit(mine).cast("long").alias("x"), F.lit(other).cast("long").alias("y"))

    counted = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(key, "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = counted.groupBy(key).agg(F.sum(x * y).alias("dot"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"),
                                    F.count_if((x > 0) & (y > 0)).alias("both"), F.count(F.lit(1)).alias("any"))
    norms = F.sqrt(F.col("xx").cast("double")) * F.sqrt(F.col("yy").cast("double"))
    scored = sums.select(F.col(key).alias("_key"), (F.col("dot") / F.nullif(norms, F.lit(0.0))).alias("_cosine"),
                         (F.col("both") / F.col("any")).alias("_jaccard"))
    # rows whose texts hold no word at all
    return pairs.join(scored, F.col(key) == F.col("_key"), "left").select(
        key, F.coalesce("_cosine", F.lit(0.0)).alias("cosine"), F.coalesce("_jaccard", F.lit(0.0)).alias("jaccard"))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word-count vectors of two short texts."""

    def words(text):
        return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    x, y = words(a), words(b)

    def uses(all_words, w):
        return F.size(F.filter(all_words, lambda v: v == w)).cast("double")

    def norm(all_words):
        return F.sqrt(F.aggregate(F.transform(F.array_distinct(all_words), lambda w: F.pow(uses(all_words, w), F.lit(2.0))),
                                  F.lit(0.0), lambda acc, v: acc + v))

    dot = F.aggregate(F.transform(F.array_intersect(x, y), lambda w: uses(x, w) * uses(y, w)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), dot / (norm(x) * norm(y))).otherwise(0.0)


def _jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, with transpositions."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, char in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == char:
                taken[j] = True
                left.append(char)
                break
    if not left:
        return 0.0
    right = [char for j, char in enumerate(b) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro raised by a tenth per equal leading character (at most four) when it is above 0.7."""

    def one(x, y):
        if x is None or y is None:
            return None
        base = _jaro(x, y)
        same = 0
        while same < min(4, len(x), len(y)) and x[same] == y[same]:
            same += 1
        return base + same * 0.1 * (1 - base) if base > 0.7 else base

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# rare elements that two texts must share before they are compared
SHARED = 3


def _numbered_grams(text: Column) -> Column:
    """2-grams of `` text `` as a bag: the i-th use of a gram is its own element."""
    grams = F.array_sort(bigrams(F.concat(F.lit(" "), text, F.lit(" "))))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\u0001"), (i - F.array_position(grams, g) + 1).cast("string")))


def fuzzy_join(left: DataFrame, right: DataFrame, l_col: str, r_col: str, sim: str = "bigram",
               minimum: float = 0.8) -> DataFrame:
    """(l_col, r_col, similarity): all pairs of distinct texts at least ``minimum`` alike; exact.

    ``sim`` is bigram, jaccard (words) or edit (``minimum`` at least 0.5).  Elements are ordered by how
    rare they are; two texts that are alike enough must share several of their first rare elements, so
    only those meet in an equi-join and pairs that share too few are dropped before scoring.  Copies of a text are
    compared once: join the pairs back to the rows to spread them.
    """
    if sim == "edit" and minimum < 0.5:
        raise ValueError("edit similarity joins need a minimum of at least 0.5")
    elements = {"bigram": gram_set, "jaccard": token_set, "edit": _numbered_grams}[sim]

    def side(df, column, tag):
        values = df.select(F.col(column).alias(f"{tag}v")).where(F.col(column).isNotNull()).distinct()
        return values.withColumn(f"{tag}e", elements(F.col(f"{tag}v")))

    # each side is cut once and read again for the counts, the rare elements and the scores
    lhs, rhs = stage(side(left, l_col, "l"), "fuzzy-left"), stage(side(right, r_col, "r"), "fuzzy-right")
    uses = stage(lhs.select(F.explode("le").alias("e")).unionByName(rhs.select(F.explode("re").alias("e")))
                 .groupBy("e").agg(F.count(F.lit(1)).alias("uses")), "fuzzy-uses")

    def prefix(df, tag):
        """Rows (value, size, element) of the rare elements that decide."""
        size = F.size(f"{tag}e")
        if sim == "edit":
            edits = F.floor((1 - minimum) * F.length(f"{tag}v") / minimum + 1e-9)
            keep, size = 2 * edits + SHARED, F.length(f"{tag}v")
        else:
            keep = size - F.ceil(minimum * size - 1e-9) + SHARED
        rare = (df.select(f"{tag}v", keep.alias("keep"), size.alias(f"{tag}n"), F.explode(f"{tag}e").alias("e")).join(uses, "e")
                .groupBy(f"{tag}v", "keep", f"{tag}n").agg(F.array_sort(F.collect_list(F.struct("uses", "e"))).alias("s")))
        return (rare.select(f"{tag}v", f"{tag}n", F.explode(F.slice("s", 1, F.col("keep").cast("int"))).alias("x"))
                .select(f"{tag}v", f"{tag}n", F.col("x.e").alias("e")))

    # sizes too far apart cannot be alike enough
    near = F.least("ln", "rn") >= minimum * F.greatest("ln", "rn") - 1e-9
    longer = F.greatest("ln", "rn")
    edits = F.floor((1 - minimum) * longer + 1e-9).cast("int")
    needed = longer + 1 - 2 * edits if sim == "edit" else F.ceil(minimum * longer - 1e-9)
    candidates = (prefix(lhs, "l").join(prefix(rhs, "r"), "e").where(near).groupBy("lv", "rv", "ln", "rn")
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.least(needed, F.lit(SHARED))))
    if sim == "edit":
        # the bounded distance stops early and is -1 beyond the bound
        distance = F.call_function("levenshtein", F.col("lv"), F.col("rv"), edits)
        scored = (candidates.withColumn("d", distance).where("d >= 0")
                  .withColumn("similarity", F.when(longer == 0, 1.0).otherwise(1 - F.col("d") / longer)))
    else:
        x, y = F.col("le"), F.col("re")
        shared = F.size(F.array_intersect(x, y))
        whole = F.greatest(F.size(x), F.size(y)) if sim == "bigram" else F.size(x) + F.size(y) - shared
        scored = candidates.join(lhs, "lv").join(rhs, "rv").withColumn("similarity", shared / F.greatest(whole, F.lit(1)))
    return (scored.where(F.col("similarity") >= minimum - 1e-12)
            .select(F.col("lv").alias(l_col), F.col("rv").alias(r_col), "similarity"))
