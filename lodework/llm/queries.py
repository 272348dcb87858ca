"""One registered query per operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodework.llm import bpe, collocations, decontaminate, html_text, licenses, repair, rules, secret_scan, setsketch, simhash, token_counts, toxicity, turns
from lodework.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Independent SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_report(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(table(spark, sf_dir, "documents"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[.,;:!?\n-\r]')) AS p FROM documents),
d AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x : x <> '') AS w FROM pieces),
u AS MATERIALIZED (SELECT lang, w1, count(*) AS n FROM (SELECT lang, unnest(w) AS w1 FROM d) GROUP BY ALL),
b AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS n FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM d)) GROUP BY ALL HAVING count(*) >= 10),
t AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS n FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM d)) GROUP BY ALL HAVING count(*) >= 10),
tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(n) AS m FROM (SELECT lang, w1, w2, n FROM t UNION ALL SELECT lang, w2, w3, n FROM t) GROUP BY ALL),
cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.n AS a, 1 AS k, x.n AS l, y.n AS r FROM b JOIN u x ON x.lang = b.lang AND x.w1 = b.w1 JOIN u y ON y.lang = b.lang AND y.w1 = b.w2
    LEFT JOIN longer g ON g.lang = b.lang AND g.w1 = b.w1 AND g.w2 = b.w2 WHERE g.m IS NULL OR 100 * g.m < 50 * b.n
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.n, 1, x.n, y.n FROM t JOIN u x ON x.lang = t.lang AND x.w1 = t.w1 JOIN b y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.n, 2, x.n, y.n FROM t JOIN b x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN u y ON y.lang = t.lang AND y.w1 = t.w3),
s AS (SELECT *, CAST((1000000 * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM m QUALIFY rank <= 2000)
SELECT k.lang, rank, phrase, a, l, r, tot.n, score FROM k JOIN tot ON tot.lang = k.lang
"""


@query
def op13_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(table(spark, sf_dir, "conversations"))
