"""The pipeline's stages: what goes, what stays, and how."""

import random

import corpus_pipeline
from lodework.llm import decontaminate, rules, secret_scan, simhash
from tests.llm.cases import documents, empty, in_folder
from tests.llm.test_dedup_rules import SECRET, brute_fingerprint, brute_roots
from tests.llm.test_text_matches import LIST


def corpus():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(LIST) + str(r.randint(0, 500)) for _ in range(n))
    docs = {i: prose(r.randint(60, 200)) for i in range(40)}
    item = prose(30)
    docs[50] = docs[3]
    docs[51] = docs[4].upper()
    docs[52] = docs[5] + " " + item
    docs[53] = prose(90) + f" token = {SECRET}"
    docs[54], docs[55] = None, "too short"
    return docs, item


def test_stages(spark, tmp_path):
    docs, item = corpus()
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = documents(spark, docs.items()).where("doc_id IS NOT NULL")
    table = table.union(table.where("doc_id = 7"))
    folder = in_folder(spark, tmp_path / "in", documents=table, benchmark=benchmark)
    kept, columns = table, table.columns
    seen = {}
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, kept, folder)
        if number < 4:
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in kept.collect()}
    assert set(docs) - set(seen["quality"]) == {54, 55}
    # one of each group: brute force over what the stage was given
    left = {i: docs[i] for i in seen["quality"]}
    roots = brute_roots([brute_fingerprint(t) for t in left.values()])
    first = {}
    for i, t in left.items():
        group = roots[brute_fingerprint(t)]
        first[group] = min(first.get(group, i), i)
    assert set(seen["near_dedup"]) == set(first.values()) and not {50, 51} & set(seen["near_dedup"])
    assert spark.read.parquet(str(tmp_path / "near_dedup")).count() == len(first)
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {52}
    assert SECRET not in seen["secrets"][53].text and seen["secrets"][53].text.endswith("[SECRET]")
    assert seen["secrets"][53].n_chars == len(seen["secrets"][53].text) and seen["secrets"][6].text == docs[6]
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in seen["tokens"].values()) and set(seen["tokens"]) == set(seen["secrets"])
    whole = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.ids_sha256) for r in whole.collect()} == {(i, r.ids_sha256) for i, r in seen["tokens"].items()}


def test_rows_that_share_an_id(spark, tmp_path):
    docs, item = corpus()
    a, b, c = docs[1], docs[2], docs[6]
    # id 5 is in the group of 3 and in that of 9; the last group has no id; equal rows are one
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c.upper()), (7, docs[7]), (7, docs[7]), (None, docs[7])]
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _row long")
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (7, docs[7])], key=str)
    folder = in_folder(spark, tmp_path / "in", benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    leaky = [(1, a), (1, b + " " + item), (None, c + " " + item), (None, b)]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(leaky, "doc_id long, text string"), folder)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (None, b)], key=str)


def test_empty_documents(spark, tmp_path):
    folder = in_folder(spark, tmp_path / "in", documents=empty(spark), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "tokens"]
    assert all((rules.judge, simhash.near_duplicates, decontaminate.leaks, secret_scan.scan))
