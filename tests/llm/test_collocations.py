"""Phrases from count streams against counting by dictionary."""

import random
import re
from collections import Counter

import pytest

from lodework.llm import collocations
from tests.llm.cases import documents, empty, texts


def brute(rows, least=10, covered=50, top=2000):
    """lang -> list of (rank, phrase, a, l, r, n, score)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            of = counts.setdefault(lang, Counter())
            for size in (1, 2, 3):
                of.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, of in counts.items():
        found = []
        for phrase, a in of.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(n >= least and 100 * n >= covered * a and phrase in (p[:2], p[1:]) for p, n in of.items() if len(p) == 3):
                continue
            score, k = min((1000000 * a * a // (of[phrase[:k]] * of[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), of[phrase[:k]], of[phrase[k:]]))
        out[lang] = [(i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return {lang: rows for lang, rows in out.items() if rows}


def run(df, **kw):
    out = {}
    for r in collocations.collocations(df, **kw).collect():
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return {lang: sorted(rows) for lang, rows in out.items()}


def made(seed, docs=150):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "a\x1cb", "é", "日本", "new", "york", "times", "x=", "\x00", "ſ"] + [f"w{i}" for i in range(30)]
    weights = [40, 9, 30, 5, 5, 5, 9, 9, 9, 3, 2, 2] + [2] * 30
    rows = []
    for _ in range(docs):
        words = r.choices(vocabulary, weights, k=r.randint(0, 80))
        text = "".join(w + r.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        rows.append((r.choice(["en", "en", "en", "de", None, "und"]), r.choice([text, text + " new york times", text])))
    return rows + [("en", None), (None, ""), ("de", " \t\n"), *[("en", "new york times of w1")] * 40]


@pytest.mark.parametrize("range_rows", [40, 1 << 20])
def test_phrases_of_brute_force(spark, monkeypatch, range_rows):
    """Many narrow ranges cut through frequent words and pairs; one range holds all."""
    monkeypatch.setattr(collocations, "RANGE_ROWS", range_rows)
    rows = made(range_rows)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = run(df)
    assert got == brute(rows) and len(got) >= 3
    assert run(df, top=3) == brute(rows, top=3)


def test_blocks_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 50)
    rows = made(5, 60)
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert run(df, least=3, covered=80) == brute(rows, 3, 80)


def test_odd_rows_and_products_past_64_bits(spark):
    df = documents(spark)
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert len(rows) == len(texts()) + 2
    assert run(df) == brute(rows)
    assert collocations.collocations(empty(spark)).count() == 0
    n = 4_000_000  # 1000000 * n * n needs more than 64 bits
    many = spark.createDataFrame([("en", "a b " * (n // 8))] * 8, "lang string, text string")
    assert run(many)["en"][0] == (1, "a b a", n - 8, n, n, 2 * n, 1000000 * (n - 8) ** 2 // n**2)
