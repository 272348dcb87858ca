"""SetSketch near-duplicates against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from lodework.llm import setsketch
from tests.llm.cases import by_id, documents, empty, texts


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, percent=85):
    """(size, least linked id) of every row of (id, text); ids are distinct here."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders, root = {}, {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, s) in enumerate(sets):
        shared = {}
        for x in s:
            for other in holders.get(x, ()):
                shared[other] = shared.get(other, 0) + 1
            holders.setdefault(x, []).append(at)
        for other, n in shared.items():
            j, t = sets[other]
            if 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, r, edits):
    words = list(words)
    for at in r.sample(range(len(words)), edits):
        words[at] = f"x{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Groups of edited copies around a text, chains, texts that share half, short texts, exact copies."""
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(15):
        base = prose(r.randint(3, 120))
        out += [edited(base, r, min(len(base), r.choice([0, 0, 1, 2, 3, 5]))) for _ in range(r.randint(1, 25))]
    chain = prose(100)
    for _ in range(30):
        chain = edited(chain, r, 1).split()
        out.append(" ".join(chain))
    half = prose(60)
    out += [" ".join(half + prose(r.randint(5, 60))) for _ in range(60)]
    out += [" ".join(prose(n)) for n in (1, 2, 3, 4, 5) for _ in range(3)] + ["", " \n", None, "One", "one"] + [" ".join(prose(80)) for _ in range(50)]
    r.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("outsiders", [1, 32])
def test_components_of_brute_force(spark, monkeypatch, rows, outsiders):
    monkeypatch.setattr(setsketch, "OUTSIDERS", outsiders)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 100


def test_group_without_a_common_neighbour(spark):
    """Every text is 0.8 like the centre and 0.67 like the others but for pairs: the star links none, the outsiders all pairs."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(40):
        own = edited(base, r, 9)
        rows += [(2 * g, own), (2 * g + 1, own + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in setsketch.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_crowd_of_texts_nearly_alike_makes_few_pairs(spark, monkeypatch):
    """Hardly any two are linked, but for every tenth and a copy of it with one more edit; all pairs would be 54,000."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    made = [edited(base, r, r.choice([4, 5])) for _ in range(300)]
    made += [edited(t.split(), r, 1) for t in made[::10]]
    r.shuffle(made)
    rows = list(enumerate(made))
    pairs, confirmed = [], setsketch.confirmed

    def counted(found, *others):
        pairs.append(found.count())
        return confirmed(found, *others)

    monkeypatch.setattr(setsketch, "confirmed", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(pairs) < 10 * len(rows), pairs


def test_odd_rows(spark):
    known = {**texts(), 99: "no id"}
    want = brute(known.items())
    got = by_id(setsketch.near_duplicates(documents(spark)))
    assert len(got[5]) == 2 and got[None][0].component_id is None and got[None][0].kept
    for i in texts():
        assert {(r.n_shingles, r.component_id, r.kept) for r in got[i]} == {(*want[i], want[i][1] == i)}
    assert setsketch.near_duplicates(empty(spark)).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    whole = r.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)
    a, b = whole[:3000], whole[1000:]
    assert (setsketch.merge(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.union1d(a, b))).all()
    pairs = []
    for _ in range(200):
        x = r.integers(0, 1 << 64, 1300, np.uint64, endpoint=False)
        pairs.append((setsketch.registers(x[:1000]), setsketch.registers(x[300:])))  # 700 of 1300
    best, below = setsketch.similarity_estimate(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.full(200, 1000), np.full(200, 1000))
    assert abs(best.mean() - 700 / 1300) < 0.01 and best.std() < 0.06
    assert (below(best) <= 1e-6).all() and (below(0.99) > setsketch.SLACK).all()
