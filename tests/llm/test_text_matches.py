"""Benchmark leaks, licence notices, page texts and toxicity."""

import random
import re
import time

import numpy as np
import pytest

from lodework.llm import decontaminate, html_text, licenses, toxicity
from lodework.llm.pieces import PieceCache
from tests.llm.cases import by_id, documents, empty, texts

LIST = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def brute_align(a, b):
    """(score, matched) of the best; an alignment starts anew where its score would be below zero."""
    rows, best = [[(0, 0)] * (len(b) + 1)], (0, 0)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            (s, m), (t, n), (u, k) = rows[-1][j], rows[-1][j + 1], row[-1]
            row.append(max((0, 0), (s + 2, m + 1) if x == y else (s - 1, m), (t - 1, n), (u - 1, k)))
        rows.append(row)
        best = max(best, max(row))
    return best


def test_alignment():
    r = random.Random(1)
    for _ in range(200):
        a, b = [[r.randint(0, 4) for _ in range(r.randint(n, 15))] for n in (1, 0)]
        score, matched, start, end = decontaminate.align(np.array(a), np.array(b, int))
        assert (score, matched) == brute_align(a, b)
        assert 0 <= start <= end <= len(b)


def leak_case(seed=4):
    r = random.Random(seed)
    make = lambda n: [r.choice(LIST) + str(r.randint(0, 99)) for _ in range(n)]
    items = {i: make(r.randint(12, 60)) for i in range(20)} | {20: ["unum", "duo"], 21: []}
    docs, wanted = {}, set()
    for i in range(200):
        words = make(r.randint(5, 300))
        if i % 4 == 0:
            item = r.randrange(20)
            copy = list(items[item])
            if i % 8 == 0:  # edited: every ninth word
                copy[4::9] = ["changed"] * len(copy[4::9])
            at = r.randint(0, len(words))
            words[at:at] = copy
            wanted.add((i, item))
        elif i % 4 == 1:  # a short part of an item is no copy
            item = items[r.randrange(20)]
            words[2:2] = item[: len(item) // 3]
        docs[i] = ", ".join(words).capitalize()
    docs[300], docs[301] = "so unum duo it is", None
    return docs, items, wanted | {(300, 20)}


def test_leaks(spark):
    docs, items, wanted = leak_case()
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(30, None), (None, "nulla " * 9)], "item_id long, text string")
    got = decontaminate.leaks(documents(spark, docs.items()), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and all(r.similarity >= 0.8 for r in got)
    for r in got:
        words = decontaminate.words_of(docs[r.doc_id])
        assert r.end - r.start <= 1.3 * len(items[r.item_id]) and len(set(words[r.start : r.end]) & set(items[r.item_id])) >= 0.7 * len(set(items[r.item_id]))
    assert decontaminate.leaks(empty(spark), benchmark).count() == 0
    assert decontaminate.leaks(documents(spark), benchmark.limit(0)).count() == 0


def test_leaks_of_brute_force(spark):
    """Every pair that aligns well enough and has a seed is found, wherever it stands in a long text."""
    docs, items, _ = leak_case(9)
    docs = {i: docs[i] for i in range(0, 60)} | {77: " ".join(docs[i] for i in range(60))}
    known, want = PieceCache(lambda w: list(range(len(w)))), set()
    for d, text in docs.items():
        words = decontaminate.words_of(text)
        grams = set(zip(*(words[k:] for k in range(5))))
        for i, item in items.items():
            if len(item) >= 5 and grams & set(zip(*(item[k:] for k in range(5)))):
                number = {w: k for k, w in enumerate(dict.fromkeys(item))}
                _, matched, start, end = decontaminate.align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in words]))
                if decontaminate.similarity(matched, len(item), end - start) >= 0.8:
                    want.add((d, i))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs.items()), benchmark).collect()} == want
    assert known == {}


def aligned_pairs(docs, items):
    want = set()
    for d, text in docs.items():
        words = decontaminate.words_of(text)
        for i, item in items.items():
            number = {w: k for k, w in enumerate(dict.fromkeys(item))}
            _, matched, start, end = decontaminate.align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in words], int))
            if decontaminate.similarity(matched, len(item), end - start) >= 0.8:
                want.add((d, i))
    return want


def edited(r, item, gaps):
    """A copy with as many words changed, or left out and put in, as similarity 0.8 allows, spread evenly or not."""
    n, fresh = len(item), (f"new{k}" for k in range(1000))
    for edits in range(n // 5, -1, -1):
        places = {int((k + 0.5) * n / edits) for k in range(edits)} if r.random() < 0.5 else set(r.sample(range(n), edits))
        copy = [w for k, word in enumerate(item) for w in ([] if k in places and gaps else [next(fresh)] if k in places else [word])]
        for k in range(edits if gaps else 0):
            copy.insert(r.randint(1, max(len(copy) - 1, 1)), next(fresh))
        if aligned_pairs({0: " ".join(copy)}, {0: item}):
            return copy


def test_leaks_of_alignment_alone(spark):
    """Copies edited as much as may be are found, short and long, whether or not they keep runs of words."""
    r = random.Random(12)
    items = {i: [r.choice(LIST) + str(r.randint(0, 300)) for _ in range(n)] for i, n in enumerate([1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 10, 12, 15, 15, 19, 20, 20, 25, 30, 40, 59])}
    fill = lambda: [r.choice(LIST) + str(r.randint(301, 600)) for _ in range(r.randint(0, 80))]
    docs = {k: " ".join(fill() + edited(r, items[k % len(items)], k % 3 == 2) + fill()) for k in range(8 * len(items))}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = aligned_pairs(docs, items)
    assert len(want) >= len(docs)
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), benchmark).collect()} == want


def test_leaks_of_templated_items(spark):
    """Items that share all words but one: a copy with that word edited is a copy of each."""
    r = random.Random(13)
    frame = [r.choice(LIST) + str(r.randint(0, 300)) for _ in range(20)]
    items = {i: frame[:10] + [f"own{i}"] + frame[11:] for i in range(40)}
    docs = {1: " ".join(["before"] * 30 + frame[:10] + ["changed"] + frame[11:] + ["after"] * 30), 2: " ".join(items[7]), 3: " ".join(frame[:12])}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), benchmark).collect()}
    assert got == {(d, i) for d in (1, 2) for i in items} == aligned_pairs(docs, items)


def test_cut_stretches_overlap(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 300)
    item = [f"w{k}" for k in range(30)]
    docs = {k: " ".join([f"f{j}" for j in range(k)] + item * 40) for k in range(6)}
    benchmark = spark.createDataFrame([(1, " ".join(item)), (1, "two words")], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), benchmark).collect()
    assert sorted((x.doc_id, x.item_id, x.similarity, x.start) for x in got) == [(k, 1, 1.0, k) for k in range(6)]


def test_rising_and_patience():
    assert [[3, 1, 2, 9, 4][i] for i in licenses.rising([3, 1, 2, 9, 4])] == [1, 2, 4]
    assert licenses.rising([]) == []
    text, template = [9, 1, 2, 3, 2, 5, 7], [1, 2, 3, 4, 2, 5]
    pairs = licenses.patience(text, template)
    assert pairs == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5)]
    r = random.Random(2)
    for _ in range(200):
        a, b = [[r.randint(0, 9) for _ in range(r.randint(0, 14))] for _ in range(2)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_every_template(number):
    finder, (name, notice) = licenses.Finder(), licenses.TEMPLATES[number]
    words = licenses.WORDS.findall(notice.replace("*", "").lower())
    text = LIST + words + ["the", "of", "and"] * 20 + words + LIST * 40
    got = finder.find(text)
    assert [(x[0], x[2:]) for x in got] == [(name, (20, 20 + len(words), 1.0)), (name, (80 + len(words), 80 + 2 * len(words), 1.0))]
    if len(words) > 20:
        words[9] = "altered"
        words.insert(12, "added")
        assert [x[0] for x in finder.find(LIST + words)] == [name]
    assert all(x[1] != number for x in finder.find(LIST * 30 + words[: len(words) // 2]))


def test_notices(spark):
    rows = [(1, "x\nReleased under the MIT License."), (2, "Released under the new licence"), (3, None), (4, "Licensed under the Apache License, Version 2.0. " * 3)]
    got = by_id(licenses.notices(documents(spark, rows)))
    assert {i: [r.license for r in v] for i, v in got.items()} == {1: ["MIT"], 4: ["Apache-2.0"] * 3}
    assert licenses.notices(empty(spark)).count() == 0
    assert licenses.notices(documents(spark)).count() == 0


PAGES = {
    "": "", "<p>a&amp;b&nbsp; c<br>d": "a&b c d", "<!-- <p>no</p> --><p>yes</p><!-- open": "yes", "just < text": "just < text",
    "<head><title>t</title></head><body><nav><a>x</a></nav><div class='ad'>buy <div>now</div> this</div><article><h1>T</h1><p><b>one<br><p>two</article><footer>f</footer>": "T one two",
    "<main><header class='post-header'><h1>Title</h1></header><p>Body</p><div class=ad>BUY</div><form><label>m</label></form><p>End</p></main><section class=comments><p>" + "nice " * 40: "Title Body End",
    "<div class=menu>" + "<a>link</a> " * 30 + "</div><div id=content><p>" + "word " * 40 + "</p><p>short.</p></div><div>tail</div>": "word " * 40 + "short.",
    "<script>var a='<p>x</p>'</script><style>p{}</style><p>in <i>l</i>ine</p>": "in line",
    "<body class='has-sidebar'><div class='container menu'><article>kept</article></div>": "kept",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(html):
    assert html_text.main_text(html) == PAGES[html]


PLAIN = {
    # the main text stands beside teasers that are articles
    "<div id=story><p>" + "main " * 40 + "</p></div>" + "<article class=card><a href=x>Teaser one</a></article>" * 3: "main " * 40,
    "<main>x</main><div><p>" + "main " * 40 + "</p></div>": "main " * 40,
    # every paragraph in its own div, the short ones too
    "<div>" + "<div>" + "long " * 30 + "</div><div>short one</div><div>" + "more " * 30 + "</div></div>": "long " * 30 + "short one " + "more " * 30,
    "<div>first of the lines is short, as all are here</div><div>and so is the second line</div><div>third line, which ends it all</div><nav>menu</nav><div>x</div>":
        "first of the lines is short, as all are here and so is the second line third line, which ends it all",
    "<div>" + "long " * 30 + "</div><div><a>a link</a> <a>b link</a></div><div>" + "more " * 30 + "</div>": "long " * 30 + "more " * 30,
    "<div><article>" + "own " * 40 + "</article>after</div>": "own " * 40,
}


@pytest.mark.parametrize("html", PLAIN)
def test_distribution_decides(html):
    assert html_text.main_text(html) == PLAIN[html].strip()


#: Words that a class has beside others decide nothing; whole marks do.
CLASSES = {
    '<div id="page" class="has-sidebar"><p>{}</p></div>': True,
    '<div class="layout social-news"><p>{}</p></div>': True,
    '<div class="post-with-comments"><p>{}</p></div>': True,
    '<article><div class="related-work"><p>{}</p></div></article>': True,
    '<div class="site-footer"><p>{}</p></div>': False,
    '<div class="wide cookie-banner"><p>{}</p></div>': False,
    '<article><div class="related-posts"><p>{}</p></div></article>': False,
}


@pytest.mark.parametrize("html", CLASSES)
def test_classes(html):
    text = "word " * 60
    assert html_text.main_text(html.format(text)) == (text.strip() if CLASSES[html] else "")


def test_short_sections_at_the_ends():
    long = "word " * 60
    page = "<div>{}</div><div><p>" + long + "</p></div><div>{}</div>"
    assert html_text.main_text(page.format("<h1>Title</h1>", "The end.")) == "Title " + long + "The end."
    assert html_text.main_text(page.format("12 May", "<b>x</b> y")) == long.strip()


@pytest.mark.parametrize("html", ["<b>" * 50_000 + "<i>x</i>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000 + "x", "<div>" * 50_000 + "<article>" * 50_000 + "x"])
def test_many_open_tags(html):
    start = time.perf_counter()
    assert set(html_text.main_text(html)) == {"x"}
    assert time.perf_counter() - start < 20  # seconds; quadratic ways take minutes


def brute_lines(html):
    """Lines of a page by Python's parser, where every element is closed and nothing is marked by class."""
    from html.parser import HTMLParser

    lines, now, unseen = [], [], []

    class Lines(HTMLParser):
        def border(self):
            lines.append(" ".join("".join(now).split()))
            now.clear()

        def handle_starttag(self, tag, attrs):
            if tag in html_text.UNSEEN | html_text.OTHER:
                unseen.append(tag)
            if tag in html_text.BREAKS:
                self.border()

        def handle_endtag(self, tag):
            if tag in html_text.BREAKS:
                self.border()
            if unseen and unseen[-1] == tag:
                unseen.pop()

        def handle_data(self, data):
            if not unseen:
                now.append(data)

    parser = Lines(convert_charrefs=True)
    parser.feed(html)
    parser.close()
    parser.border()
    return [x for x in lines if x]


def test_lines_of_brute_force():
    r = random.Random(4)
    names = ["p", "div", "section", "ul", "b", "i", "a", "span", "nav", "aside", "h2", "blockquote"]

    def element(depth):
        inner = "".join(element(depth + 1) if depth < 4 and r.random() < 0.5 else r.choice(["word ", "a &amp; b ", "&eacute;t\u00e9 &#x4e2d; ", "  two\n words ", ""]) for _ in range(r.randint(0, 4)))
        name = r.choice(names)
        if name == "p":  # paragraphs hold no blocks
            inner = re.sub(r"</?(?:p|div|section|ul|nav|aside|h2|blockquote)>", "", inner)
        return f"<{name}>{inner}</{name}>"

    for _ in range(300):
        html = "<body>" + "".join(element(0) for _ in range(r.randint(1, 4))) + "</body>"
        assert [x[0] for x in html_text.Page(html).lines if x[0]] == brute_lines(html), html


def test_page_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "<p>é 😀", "x"), (2, None, "<p>é 😀", "x"), (None, "u", "<p>" + "w " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url, r.text[:3], r.n_chars) for r in got if r.page_id) == sorted([(1, "u", "", 0), (2, None, "é 😀", 3), (2, None, "é 😀", 3)], key=str)
    assert [r.n_chars for r in got if r.page_id is None] == [99_999]
    assert html_text.extract(pages.limit(0)).count() == 0


def toxic_case(n=600):
    r = random.Random(8)
    docs, labels = {}, {}
    for i in range(n):
        words = [r.choice(LIST) for _ in range(r.randint(5, 60))]
        labels[i] = int(i % 5 == 0)
        if labels[i]:
            words[2:2] = ["awful" + r.choice(["", "er", "est"]), r.choice(["muslims", "women"]) if i % 2 else "people"]
        docs[i] = " ".join(words)
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_case()
    table = spark.createDataFrame([(i, 1, v) for i, v in labels.items()] + [(3, 1, None), (None, 1, 1), (4, 1, 7)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(documents(spark, docs.items()), table))
    held = [r for i, v in got.items() if i is not None for r in v if r.held_out]
    assert 80 < len(held) < 160 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for v in got.values() for r in v)
    only = toxicity.score(documents(spark, [(1, "a"), (2, None)]), table.limit(0)).collect()
    assert {r.score for r in only} == {0.5}
    assert toxicity.score(empty(spark), table).count() == 0


def test_counterfactuals_move_scores_less(monkeypatch):
    docs, labels = toxic_case()
    texts_, y = [toxicity.words_of(t) for t in docs.values()], list(labels.values())
    gap = lambda model: abs(model.get("muslims", 0) - model.get("christians", 0))
    held = gap(toxicity.fit(texts_, y))
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    free = gap(toxicity.fit(texts_, y))
    assert free > 0.5 and held < 0.5 * free
    assert toxicity.fit([], []) == {"": 0.0} and set(toxicity.fit([{"a"}], [1])) == {""}


def test_texts_are_whole():
    assert len(texts()[73].split()) == 20_000


def test_words_are_hashed_once(monkeypatch):
    """Each distinct word of a stretch of text is hashed once and none is looked up at every place."""
    asked = []
    hashed = decontaminate.xxhash.xxh64_intdigest
    monkeypatch.setattr(decontaminate.xxhash, "xxh64_intdigest", lambda w: asked.append(w) or hashed(w))
    words = ["one", "two", "thrée"] * 1000
    assert decontaminate.hashes_of(words).tolist() == [hashed(w.encode()) for w in words]
    assert sorted(asked) == ["one", "thrée", "two"] and len(decontaminate.hashes_of([])) == 0


def test_words_of_ascii():
    every = "".join(map(chr, range(128))) + " Two_words, 3rdK"
    assert decontaminate.words_of(every) == re.findall(r"\w+", every.lower())
    assert decontaminate.words_of(every[:-1]) == re.findall(r"\w+", every[:-1].lower())
