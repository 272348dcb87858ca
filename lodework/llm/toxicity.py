"""Toxicity scores from a counterfactual-regularised classifier.

Logistic regression over which words a text has, and which beginnings of words (four and five letters, for what is
inflected).  For each labelled text that names a group of people, the same text with another group's name in place is
scored too, and the loss has the squared change of the logit: a group's mention alone must not move the score.

The fit takes a bounded sample of labelled rows (``FIT_ROWS``, those of least hash of their id) in one task; features
must occur in ``LEAST`` of them and be associated with the label.  Scoring takes all texts in parallel; the model is at
most ``FEATURES`` numbers.

Defined results: null text is the empty text, whose score is the model's base rate; a label that is null or neither 0
nor 1 is not learned from, of several rows for an id all count; without any labelled row every score is 0.5, and with
one class only the smoothed share of that class; ``held_out`` is false for a null id; equal texts get equal scores; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import blocks, id_and_text

FIT_ROWS = 8192
LEAST, FEATURES, ASSOCIATED = 6, 4096, 4.0
#: Weights of the counterfactual and the ridge penalty, and steps of the fit.
COUNTERFACTUAL, RIDGE, STEPS = 10.0, 1e-4, 300
WORDS = re.compile(r"\w+")

# Names of groups of people; one of a line may stand for another of the same line.
GROUPS = tuple(line.split() for line in """
    women men girls boys
    woman man girl boy
    female male
    muslim christian jewish hindu buddhist sikh atheist catholic protestant
    muslims christians jews hindus buddhists sikhs atheists catholics protestants
    black white asian latino hispanic african arab
    blacks whites asians latinos hispanics africans arabs
    gay straight lesbian bisexual transgender heterosexual
    gays lesbians bisexuals heterosexuals
    mexican american chinese indian russian turkish german french spanish italian polish
    immigrants refugees foreigners locals citizens
    old young elderly disabled deaf blind
    femmes hommes filles garçons
    musulmans chrétiens juifs hindous bouddhistes athées
    noirs blancs asiatiques arabes
    homosexuels hétérosexuels
    frauen männer mädchen jungen
    muslime christen juden hindus buddhisten atheisten
    schwarze weiße asiaten araber
    mujeres hombres niñas niños
    musulmanes cristianos judíos hindúes budistas ateos
    negros blancos asiáticos árabes
""".strip().splitlines())
#: Each name to the next of its group, so that a swap is the same everywhere.
SWAP = {name: group[(i + 1) % len(group)] for group in reversed(GROUPS) for i, name in enumerate(group)}


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def shared_words(text: str) -> set[str]:
    """The words, each held once in memory however many texts have it."""
    return set(map(sys.intern, words_of(text)))


def features(words: set[str]) -> set[str]:
    """A word is itself; a beginning has a mark that no word has."""
    return words | {"4-" + w[:4] for w in words} | {"5-" + w[:5] for w in words if len(w) > 4}


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def fit(texts: list[set[str]], labels: list[int]) -> dict[str, float]:
    """Weights by feature; the empty feature's is the base."""
    y = np.array(labels, float)
    base = (y.sum() + 1) / (len(y) + 2)
    model = {"": float(np.log(base / (1 - base)))}
    if not 0 < y.sum() < len(y):
        return model
    seen, positive = Counter(), Counter()
    for words, label in zip(texts, labels, strict=True):
        own = features(words)
        seen.update(own)
        if label:
            positive.update(own)
    share = y.mean()
    strength = {f: abs(positive[f] - n * share) / np.sqrt(n * share * (1 - share)) for f, n in seen.items() if n >= LEAST}
    chosen = sorted((f for f, s in strength.items() if s >= ASSOCIATED), key=lambda f: (-strength[f], f))[:FEATURES]
    if not chosen:
        return model
    number = {f: i for i, f in enumerate(chosen)}
    rows, columns = [], []
    moved_rows, moved_columns, moved_signs, pairs = [], [], [], 0
    for r, words in enumerate(texts):
        own = features(words)
        held = [number[f] for f in own if f in number]
        rows += [r] * len(held)
        columns += held
        if not SWAP.keys().isdisjoint(words):
            other = features(swapped(words))
            for side, sign in ((own - other, 1.0), (other - own, -1.0)):
                moved = [number[f] for f in side if f in number]
                moved_rows += [pairs] * len(moved)
                moved_columns += moved
                moved_signs += [sign] * len(moved)
            pairs += 1
    order = np.lexsort((columns, rows))
    rows, columns = np.array(rows, int)[order], np.array(columns, int)[order]
    moved_rows, moved_columns, moved_signs = np.array(moved_rows, int), np.array(moved_columns, int), np.array(moved_signs, float)
    weights, bias = np.zeros(len(chosen)), model[""]
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):  # Adam, all rows at each step
        error = 1 / (1 + np.exp(-(np.bincount(rows, weights[columns], len(y)) + bias))) - y
        slope = np.bincount(columns, error[rows], len(chosen)) / len(y) + RIDGE * weights
        if pairs:
            change = np.bincount(moved_rows, moved_signs * weights[moved_columns], pairs)
            slope += COUNTERFACTUAL * 2 * np.bincount(moved_columns, moved_signs * change[moved_rows], len(chosen)) / len(y)
        slope = np.append(slope, error.mean())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {"": float(bias)} | {f: float(weights[i]) for f, i in number.items()}


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> dict[str, float]:
    """The model of a bounded sample of labelled texts."""
    known = labels.select(labels[id_col].cast("bigint").alias("_id"), labels[label_col].cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)  # so many numbers: small enough to broadcast
    joined = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "_id").select("_id", "_label", "_text")

    def run(batches):
        found = [(i, label, shared_words(text)) for b in batches for i, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort(key=lambda x: (x[0], x[1]))
        model = fit([w for _, _, w in found], [label for _, label, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.string()), pa.array(list(model.values()), pa.float64())], ["feature", "weight"])

    return {r.feature: r.weight for r in joined.repartition(1).mapInArrow(run, "feature string, weight double").collect()}  # at most FEATURES + 1


def apply(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        words = {f for f in model if "-" not in f}
        begins = {n: {f[2:] for f in model if f.startswith(f"{n}-")} for n in (4, 5)}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                logits = []
                for text in texts[a:b]:
                    own = words_of(text)
                    total = [model[w] for w in own & words]
                    total += [model[f"4-{p}"] for p in {w[:4] for w in own} & begins[4]]
                    total += [model[f"5-{p}"] for p in {w[:5] for w in own} & begins[5]]
                    logits.append(sum(sorted(total)) + model.get("", 0.0))  # sorted: sets have no order
                scores = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels, then score every document."""
    return apply(docs, learn(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
