"""SimHash groups, quality rules and secrets against brute force."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodework.llm import rules, secret_scan, simhash
from tests.llm.cases import by_id, documents, empty, texts

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    values = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(v ^ values) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(v): find(i) for i, v in enumerate(values)}


def test_fingerprints_and_components(spark):
    known = texts()
    prints = {i: brute_fingerprint(t) for i, t in known.items()}
    roots = brute_roots([*prints.values(), brute_fingerprint("no id")])
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    got = by_id(simhash.near_duplicates(documents(spark)))
    assert len(got[5]) == 2 and got[None][0].component_id is None
    for i, p in prints.items():
        assert {(r.fingerprint, r.component_id) for r in got[i]} == {(f"{p:016x}", least[roots[p]])}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [2, 128])
def test_links_keep_every_near_pair(spark, monkeypatch, crowd):
    """Groups around a centre, chains, and noise; a low crowd limit sends most through midpoints."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(crowd)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = r.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(60)}
    chain = r.getrandbits(64)
    for b in r.sample(range(64), 40):
        chain ^= 1 << b
        values.add(chain)
    values |= {r.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {row.node % (1 << 64): row.root % (1 << 64) for row in simhash.components(simhash.links(nodes)).collect()}
    expected = brute_roots(values)
    groups, wanted = Counter(), Counter()
    for v in values:
        groups[found.get(v, v)] += 1
        wanted[expected[v]] += 1
    assert sorted(groups.values()) == sorted(wanted.values())
    for v in values:
        assert expected[v] == expected[found.get(v, v)]


def test_thresholds_are_least_cost():
    r = np.random.default_rng(2)
    costs = r.integers(0, 9, (200, 3, 3)).astype(float)
    for row, chosen in zip(costs, simhash.allocate(costs, 0), strict=True):
        ways = [(row[0, a + 1] + row[1, b + 1] + row[2, -a - b + 1]) for a in (-1, 0, 1) for b in (-1, 0, 1) if -1 <= -a - b <= 1]
        assert chosen.sum() == 0 and sum(row[p, t + 1] for p, t in enumerate(chosen)) == min(ways)


def brute_counts(text):
    words = WORDS.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    known = texts() | {100: "# a | b <x>\n a | b\n\n# a | b <x>\n \n", 101: "x y z x y z", 102: "x y z\x0bx\ry\fz"}
    got = by_id(rules.quality_report(documents(spark, known.items())))
    for i, text in known.items():
        n, *rest = brute_counts(text)
        for row in got[i]:
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, *rest)
            assert row.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (row.kept and row.base_failed)
    assert rules.quality_report(empty(spark)).count() == 0


def brute_mcd(x):
    """The concentration steps on one group, from sorted distances' bins as the operator has them."""
    n, floors = rules.N, np.array([f * rules.UNIT for _, f, _ in rules.STATISTICS])
    bins = np.floor(x / 32)
    at = lambda q: np.array([np.sort(bins[:, d])[int(np.ceil(q * len(x))) - 1] for d in range(n)]) * 32 + 16
    m, scale = at(0.5), np.maximum((at(0.75) - at(0.25)) / 1.349, floors)
    inverse = np.diag(1 / scale**2)
    for _ in range(rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, inverse, x - m)
        b = np.floor(16 * np.log1p(d))
        inside = np.array([(b < v).sum() for v in b])
        near = x[inside < np.ceil(rules.SUBSET * len(x))]
        m = near.mean(0)
        inverse = np.linalg.inv(near.T @ near / len(near) - np.outer(m, m) + np.diag(floors**2))
    return np.einsum("ij,jk,ik->i", x - m, inverse, x - m)


def test_outliers(spark):
    r = random.Random(11)
    prose = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 300)) for _ in range(r.randint(60, 400)))
    rows = [(i, prose()) for i in range(300)] + [(i, prose().replace(" ", "*** ")) for i in range(300, 330)]
    docs = documents(spark, rows).where("doc_id IS NOT NULL")
    got = {x.doc_id: x for x in rules.quality_report(docs, by=()).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 330))
    c = np.array([brute_counts(t) for _, t in [*rows, rows[5]]], float)  # documents() repeats row 5
    n, chars, symbols, lines, repeats = c.T
    x = np.round(rules.UNIT * np.stack([np.log(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(100 * repeats / n), np.log1p(lines)], 1))
    assert np.allclose([got[i].distance for i, _ in rows], brute_mcd(x)[:-1], rtol=1e-6)
    few = rules.quality_report(documents(spark, rows[295:310]).where("doc_id IS NOT NULL")).collect()
    assert all(x.kept and x.distance is None for x in few)


def brute_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, (p, n) in enumerate((("AKIA[A-Z0-9]+", 18), ("[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


SECRET = "Xk9Qz7LmP2vR8tYw4BnC6dF1gH3jK5sA"


def test_secrets(spark):
    r = random.Random(3)
    parts = ["token", "=", " ", '"', "api_key", ":", "SECRET", "AKIA", "ab12cd", "ABCDEF99", "é", "😀", "\n", "x.y-z", "'"]
    known = texts() | {i: "".join(r.choices(parts, k=r.randint(1, 40))) for i in range(1000, 1400)}
    known[2000] = f"see {SECRET} and thanonontioninerthanonontion getUserNameFromDatabase /usr/local/share/documents/readme 12345678901234567890123"
    got = by_id(secret_scan.secret_report(documents(spark, known.items())))
    for i, text in known.items():
        base = brute_spans(text)
        for row in got[i]:
            assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert [s for s in row.spans.split(",") if s and s[:6] != "random"] == [s for s in base.split(",") if s]
            assert (row.n_assign, row.n_access, row.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))
    assert [s for s in got[2000][0].spans.split(",") if s[:6] == "random"] == [f"random:4:{4 + len(SECRET)}"]
    assert secret_scan.secret_report(empty(spark)).count() == 0


def test_base64url_and_slashes(spark):
    """Random tokens are found whole, with whatever marks they have; words joined by such marks are not."""
    r = random.Random(6)
    marks, plain = "-_", string.ascii_letters + string.digits
    make = lambda n, extra: "".join(r.choices(plain + extra, k=n))
    url = [t for t in (make(n, marks) for n in [32, 39, 43, 64] * 40) if "-" in t[1:-1] or "_" in t[1:-1]]
    slashed = ["".join(c if (k + 1) % 9 else "/" for k, c in enumerate(make(64, "+"))) for _ in range(20)]
    words = ["getting-started-with-the-new-release", "user_name_from_the_database_table", "how-to-write-better-commit-messages", "/usr/local/share/documents/readme",
             "/home/someone/projects/website/images", "------------------------------", "________________________________", "////////////////////////"]
    texts_ = url + slashed + words
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secret_scan.secret_report(docs).collect()}
    whole = [got[i] == f"random:4:{4 + len(t)}" for i, t in enumerate(texts_)]
    assert sum(whole[: len(url)]) >= 0.9 * len(url) and all(whole[len(url) : len(url) + len(slashed)])
    assert [texts_[i] for i in range(len(url) + len(slashed), len(texts_)) if got[i]] == []


def test_masking(spark):
    docs = documents(spark, [(1, f"a token = \"abcdefghijkl\" b 0123456789abcdef0 é {SECRET}."), (2, "clean"), (3, None)])
    found = secret_scan.scan(docs).select("row.doc_id", secret_scan.masked(F.col("row.text"), F.col("spans")).alias("t"))
    assert {(x.doc_id, x.t) for x in found.collect() if x.doc_id} == {(1, 'a [SECRET]" b [SECRET] é [SECRET].'), (2, "clean"), (3, None)}


def test_false_discovery_step(spark):
    tokens = spark.createDataFrame([(0, 40, 6.0)] * 3 + [(0, 40, 0.1)] * 200, "s long, e long, z double")
    mean, least = secret_scan.threshold(tokens)
    found = tokens.where(secret_scan._bin(F.col("z"), F.col("e") - F.col("s"), mean) >= least)
    assert found.count() == 3
    assert secret_scan.threshold(tokens.limit(0)) == (1.0, secret_scan.BINS + 1)
