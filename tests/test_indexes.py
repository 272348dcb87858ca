"""Search indexes against scoring, matching and comparing everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodework.operators import search, vectors

VOCABULARY = [f"w{i}" for i in range(300)]


def corpus(r, n=700):
    weights = [1 / (i + 1) for i in range(len(VOCABULARY))]
    rows = [(i, " ".join(r.choices(VOCABULARY, weights, k=r.choice([0, 1, 3, 8, 40, 120])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), *[(n + 2 + i, rows[3][1]) for i in range(5)]]


def bm25(rows, query, k, k1=1.2, b=0.75):
    texts = {i: (t or "").split() for i, t in rows}
    mean = sum(map(len, texts.values())) / len(texts)
    counts = {i: Counter(ws) for i, ws in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    scores = {}
    for w in set(query.split()) & df.keys():
        idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
        for i, c in counts.items():
            if w in c:
                scores[i] = scores.get(i, 0) + idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(texts[i]) / mean))
    return sorted((round(-s, 6), i) for i, s in scores.items())[:k]


@pytest.mark.parametrize("k,packed", [(1, 4), (10, 16), (2000, 128)])
def test_pruned_bm25_gives_the_rows_of_scoring_everything(spark, monkeypatch, k, packed):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", packed)
    r = random.Random(k)
    rows = corpus(r)
    index = search.build_bm25(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text")
    asked = [(q, " ".join(r.choices(VOCABULARY, k=r.randint(1, 12)))) for q in range(12)] + [(12, "w0 w1 w299"), (13, "unknown"), (14, None), (15, rows[3][1])]
    queries = spark.createDataFrame(asked, "q long, text string")
    got = {}
    for row in search.bm25_topk_many(index, queries, "q", "text", k).collect():
        got.setdefault(row.q, []).append((row.distance, row.id))
    for q, text in asked:
        want = bm25(rows, text or "", k)
        assert [d for d, _ in want] == pytest.approx([d for d, _ in sorted(got.get(q, []))], abs=2e-6)
        if k == 2000:  # all that match, so ties at the end can't differ
            assert {i for _, i in want} == {i for _, i in got.get(q, [])}
    single = search.bm25_topk(index, asked[0][1], k).collect()
    assert [(row.distance, row.id) for row in single] == sorted(got[0])


def test_blocks_stay_closed(spark, monkeypatch):
    """One rare word decides; most blocks of the frequent words of the query are not unpacked."""
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 8)
    r = random.Random(1)
    rows = [(i, " ".join(["w0"] * r.randint(1, 3) + ["w1"] + r.choices(VOCABULARY[10:], k=10) + (["rare"] * 3 if i % 400 == 0 else []))) for i in range(2000)]
    index = search.build_bm25(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    score = search._Scorer(index, 1.2, 0.75)
    planned = search._planned(index, spark.createDataFrame([(0, "w0 w1 rare")], "q long, text string"), "q", "text", 3, score)
    every = planned.join(index.blocks, "term").count()
    opened = search.bm25_open(index, planned, score).count()
    assert every > 300 and opened <= 5
    assert sum(len(row.entries) for row in index.blocks.collect()) == index.terms.agg(F.sum("df")).first()[0]


def test_packed_numbers_come_back():
    r = np.random.default_rng(0)
    for high in (2, 200, 1 << 15, 1 << 20, 1 << 27):
        places = np.unique(r.integers(0, high, 300))
        data, sizes = search.pack(np.diff(places, prepend=0))
        assert (search.unpack(data.tobytes()) == places).all() and sizes.sum() == len(data)


@pytest.mark.parametrize("chars", [60, 1 << 22])
def test_substrings_by_packed_bigrams(spark, monkeypatch, chars):
    monkeypatch.setattr(search, "SEGMENT_CHARS", chars)
    r = random.Random(chars)
    texts = ["".join(r.choices("abcé日😀 \n", k=r.randint(0, 60))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(900, None), (901, texts[0]), (0, texts[0])]
    index = search.build_bigrams(spark.createDataFrame(rows, "id long, body string").repartition(3), "id", "body")
    for pattern in ["a", "ab", "日😀", "abc", "é日 ", "\na", "aaaa", texts[5][:7], "zz", texts[7]]:
        got = sorted(row.id for row in search.bigram_candidates(index, pattern).collect())
        assert sorted(set(got)) == sorted({i for i, t in rows if t is not None and pattern in t}), pattern
    if chars > 60:
        held = index.blocks.agg(F.sum(F.octet_length("places"))).first()[0]
        assert held < sum(len(t.encode()) for t in texts)


def points(r, n, width):
    centres = r.normal(size=(8, width)) * 4
    rows = centres[r.integers(0, 8, n)] + r.normal(size=(n, width))
    rows[5:9] = rows[4]  # equal vectors
    rows[10] = 0
    return rows


def nearest(rows, query, k, metric):
    if metric == "l2":
        dist = np.sqrt(((rows - query) ** 2).sum(1))
    elif metric == "inner":
        dist = -(rows @ query)
    else:
        with np.errstate(invalid="ignore"):
            dist = 1 - rows @ query / (np.linalg.norm(rows, axis=1) * np.linalg.norm(query))
    order = [i for i in np.lexsort((np.arange(len(rows)), np.round(dist, 9))) if not np.isnan(dist[i])][:k]
    return [(int(i), round(float(dist[i]), 6)) for i in order]


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner"])
def test_pivot_join_of_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "CHUNK", 50)
    monkeypatch.setattr(vectors, "ASKED", 20)
    monkeypatch.setattr(vectors, "PIVOTS", 12)
    r = np.random.default_rng(2)
    rows = points(r, 900, 6)
    asked = np.concatenate([rows[:40], r.normal(size=(20, 6)) * 5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(5000, None)], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, v array<double>")
    got = {}
    for row in vectors.knn(df, "id", "v", queries, "q", "v", 7, metric).collect():
        got.setdefault(row.qid, []).append((row.rn, row.id, round(row.distance, 6)))
    for q, v in enumerate(asked):
        assert [x[1:] for x in sorted(got.get(q, []))] == (nearest(rows, v, 7, metric) if metric != "cosine" or v.any() else [])
    few = vectors.knn(df.limit(3), "id", "v", queries.limit(2), "q", "v", 7, metric)
    assert few.count() <= 6


def test_pivots_keep_cells_apart(spark, monkeypatch):
    """Far groups: a query meets the rows of its own group alone."""
    seen = spark.sparkContext.accumulator(0)
    plain = vectors._distances

    def counted(rows, query, metric):
        seen.add(len(rows))
        return plain(rows, query, metric)

    monkeypatch.setattr(vectors, "_distances", counted)
    r = np.random.default_rng(3)
    rows = np.repeat(np.eye(20) * 1000, 50, axis=0) + r.normal(size=(1000, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    assert vectors.knn(df, "id", "v", df.where("id % 50 = 0"), "id", "v", 5).count() == 100
    assert 0 < seen.value < 20 * 1000 / 4


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner"])
def test_codes_find_neighbours(spark, monkeypatch, metric):
    """Clustered vectors: a tenth of the lists is enough."""
    monkeypatch.setattr(vectors, "CHUNK", 100)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 3
    rows = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    index = vectors.build_ann(df, "id", "v", metric=metric)
    assert len(index.sizes) > 40 and sum(index.sizes.values()) == 3000
    found = {}
    for row in vectors.ann_search(index, df.where("id % 50 = 0"), "id", "v", 10, probes=max(1, len(index.sizes) // 10)).collect():
        found.setdefault(row.qid, set()).add(row.id)
    share = np.mean([len(found[q] & {i for i, _ in nearest(rows, rows[q], 10, metric)}) / 10 for q in range(0, 3000, 50)])
    assert share >= 0.9
