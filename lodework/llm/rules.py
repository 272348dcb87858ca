"""Quality rules: simple bounds, then robust multivariate outliers per language and source.

Every text gives a few counts, these a vector of transformed statistics.  In each group (language, source) of texts
within the bounds, location and scatter are minimum-covariance-determinant estimates: concentration steps take the
three quarters of the group nearest by Mahalanobis distance, estimate from those, and measure all again.  Texts
farther than ``CUTOFF`` are rejected.  All of it is DataFrame expressions.

Groups of any size cost the same per row: a step is one aggregation by (group, distance bin), which each task starts
on its own rows, and the h-subset is read from the few bins of a group.  Statistics are integers (in 1/1024), so sums
are exact and a result does not depend on the order of rows.

Defined results: null text is the empty text and fails the base rule; null language or source is a group of its own;
a group of fewer than ``LEAST`` texts has no estimate and keeps what the base rule keeps; equal rows get equal
verdicts; no column's scatter falls below its floor, so a constant statistic does no harm; rows carry all columns
of the input, whatever their names, within ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodework.llm.common import whole_text
from lodework.session import stage

UNIT = 1024
#: Share of a group that a concentration step takes, and the number of steps.
SUBSET, STEPS = 0.75, 3
LEAST = 20
#: Squared distance beyond which a text is rejected.  Far above the chi-square quantiles of five statistics (0.9999:
#: 25.7), as clean text has heavier tails than a normal distribution.
CUTOFF = 100.0
#: (name, least standard deviation, from which column of counts) of the transformed statistics.
STATISTICS: tuple[tuple[str, float, Callable[[Column], Column]], ...] = (
    ("length", 1.0, lambda c: F.log(F.greatest(c.n_words, F.lit(1)))),
    ("word_length", 0.15, lambda c: F.log(F.greatest(c.word_chars, F.lit(1)) / F.greatest(c.n_words, F.lit(1)))),
    ("symbols", 0.15, lambda c: F.log1p(100 * c.n_symbols / F.greatest(c.word_chars, F.lit(1)))),
    ("repeats", 0.5, lambda c: F.log1p(100 * c.n_repeat_words / F.greatest(c.n_words, F.lit(1)))),
    ("lines", 0.5, lambda c: F.log1p(c.n_dup_lines)),
)
N = len(STATISTICS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = r"[ \t-\r]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that a text has twice or more."""
    n = F.size(words)
    window = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])
    starts = F.sequence(F.lit(0), n - 3)
    hashed = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1).w == x.w)) | F.coalesce(F.get(s, j + 1).w == x.w, F.lit(False)))
    counted = let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(again(s), lambda x: F.array(x.i, x.i + 1, x.i + 2))))))
    # equal windows have equal hashes: most texts are settled by the first test
    repeated = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 3, 0).when(repeated, counted).otherwise(0)


def text_counts(text: Column) -> Column:
    """The counts of a text, as a struct of bigints."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(w).cast("bigint").alias("n_repeat_words")))


def base_failed(counts: Column) -> Column:
    return (counts.n_words < 50) | (100 * counts.n_repeat_words > 50 * counts.n_words)


def _distance(x: list[Column], model: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the scatter's Cholesky factor."""
    y: list[Column] = []
    for i in range(N):
        y.append((x[i] - F.col(f"{model}m{i}") - sum((F.col(f"{model}l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"{model}l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(model: DataFrame) -> DataFrame:
    """Columns ``lij`` from the scatter in ``cij``."""
    for j in range(N):
        model = model.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))))
        model = model.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, N)})
    return model.select("key", "n", *[f"m{i}" for i in range(N)], *[f"l{i}{j}" for i in range(N) for j in range(i + 1)])


def _start(fit: DataFrame) -> DataFrame:
    """A first model: medians, and quartile ranges as scatter, from counts of coarse values."""
    coarse = fit.select("key", F.posexplode("x").alias("dim", "v")).select("key", "dim", F.floor(F.col("v") / 32).alias("bin"))
    counts = coarse.groupBy("key", "dim", "bin").agg(F.count("*").alias("n"))
    upto = W.partitionBy("key", "dim").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("key", "dim")
    ranked = counts.select("key", "dim", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) * 32.0 + 16
    per = ranked.groupBy("key", "dim").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("total").alias("n"))
    floors = F.array(*[F.lit(f * UNIT) for _, f, _ in STATISTICS])
    sd = F.greatest((F.col("q3") - F.col("q1")) / 1.349, floors[F.col("dim")])
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    model = per.withColumn("sd", sd).groupBy("key").agg(
        F.max("n").alias("n"), *[pick(i, F.col("q2")).alias(f"m{i}") for i in range(N)], *[pick(i, F.col("sd")).alias(f"l{i}{i}") for i in range(N)])
    return model.select("*", *[F.lit(0.0).alias(f"l{i}{j}") for i in range(N) for j in range(i)])


def _step(fit: DataFrame, model: DataFrame) -> DataFrame:
    """The model of the nearest ``SUBSET`` of each group under the model before."""
    x = [F.col("x")[i] for i in range(N)]
    pairs = [(i, j) for i in range(N) for j in range(i + 1)]
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    binned = fit.join(model, "key").select("key", "x", F.floor(16 * F.log1p(_distance(x))).cast("int").alias("bin"))
    bins = binned.groupBy("key", "bin").agg(
        F.count("*").alias("n"), *[exact(x[i]).alias(f"s{i}") for i in range(N)], *[exact(x[i] * x[j]).alias(f"p{i}{j}") for i, j in pairs])
    upto = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    inner = bins.select("*", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("inside"), F.sum("n").over(W.partitionBy("key")).alias("total"))
    taken = inner.where(F.col("inside") < F.ceil(SUBSET * F.col("total")))
    sums = taken.groupBy("key").agg(F.max("total").alias("n"), F.sum("n").cast("double").alias("h"),
                                    *[F.sum(f"s{i}").cast("double").alias(f"s{i}") for i in range(N)], *[F.sum(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in pairs])
    floor = lambda i: (STATISTICS[i][1] * UNIT) ** 2
    moments = sums.select("key", "n", *[(F.col(f"s{i}") / F.col("h")).alias(f"m{i}") for i in range(N)],
                          *[(F.col(f"p{i}{j}") / F.col("h") - F.col(f"s{i}") / F.col("h") * (F.col(f"s{j}") / F.col("h")) + (floor(i) if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs])
    return _cholesky(moments)


def estimate(fit: DataFrame) -> DataFrame:
    """Per ``key`` the count ``n``, location ``mi`` and Cholesky factor ``lij`` of vectors ``x`` (array of bigint)."""
    model = stage(_start(fit), "rules-model")
    for _ in range(STEPS):
        model = stage(_step(fit, model), "rules-model")
    return model


def judge(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row per document: its columns (those in ``keep``, else all) in the struct ``row``, the struct ``counts``,
    ``base_failed``, ``distance`` (null without an estimate) and ``kept``."""
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    counted = docs.select(row, F.to_json(F.struct(*[docs[c].cast("string").alias(f"c{i}") for i, c in enumerate(by)])).alias("key"), text_counts(whole_text(docs, text_col)).alias("counts"))
    c = F.col("counts")
    x = F.array(*[F.round(f(c) * UNIT).cast("bigint") for _, _, f in STATISTICS]).alias("x")
    scored = stage(counted.select("row", "key", "counts", base_failed(c).alias("base_failed"), x), "rules-counts")
    model = estimate(scored.where(~F.col("base_failed")).select("key", "x"))
    far = F.when(F.col("n") >= LEAST, _distance([F.col("x")[i] for i in range(N)]))
    judged = scored.join(model, "key", "left").select("row", "counts", "base_failed", far.alias("distance"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF)))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The verdicts with the counts behind them, one row per document."""
    judged = judge(docs, text_col, by, keep=(id_col,))
    return judged.select(F.col("row")[id_col].alias("doc_id"), *[F.col(f"counts.{c}") for c in COUNTS], "base_failed", "kept", "distance")
