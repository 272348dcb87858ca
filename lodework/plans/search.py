"""Queries over full text and string similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodework.operators.search import (STOP_WORDS, bigram_candidates, bm25_topk, bm25_topk_many, build_bigrams, build_bm25,
                                       build_positions, fts)
from lodework.operators.similarity import (bigram_sim, edit_sim, fuzzy_join, jaro, jaro_winkler, token_sim)
from lodework.plans.registry import plan

STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS_SQL = f"""
tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w : w <> '' AND NOT list_contains({STOPS_SQL}, w))) AS term FROM documents),
post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT d.doc_id AS id, count(t.term) AS len FROM documents d LEFT JOIN tok t ON d.doc_id = t.id GROUP BY 1),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
stat AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM len)
"""
PART_SQL = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))"


@plan("bm25_index", f"""
WITH {TOKENS_SQL}
SELECT term, df, tfs AS total_tf, documents, total_length FROM dfs JOIN (SELECT term, CAST(sum(tf) AS BIGINT) AS tfs FROM post GROUP BY 1) USING (term),
 (SELECT count(*) AS documents, CAST(sum(len) AS BIGINT) AS total_length FROM len)
""")
def bm25_index(spark, t):
    index = build_bm25(t.documents, "doc_id", "text")
    return index.terms.select("term", "df", "total_tf", F.lit(index.documents).cast("long").alias("documents"),
                              F.lit(index.total_length).cast("long").alias("total_length"))


SEARCH_TEXT = "Onesen hention of nation"


@plan("bm25_search", f"""
WITH {TOKENS_SQL}
SELECT post.id, round(-sum({PART_SQL}), 6) AS distance FROM post JOIN dfs USING (term) JOIN len ON post.id = len.id, stat
WHERE term IN ('onesen', 'hention', 'nation') GROUP BY post.id ORDER BY distance, post.id LIMIT 25
""")
def bm25_search(spark, t):
    return bm25_topk(build_bm25(t.documents, "doc_id", "text"), SEARCH_TEXT, 25)


@plan("bm25_search_many", f"""
WITH {TOKENS_SQL},
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w : w <> '' AND NOT list_contains({STOPS_SQL}, w))) AS term FROM benchmark),
s AS (SELECT item_id, post.id, round(-sum({PART_SQL}), 6) AS distance FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN len ON post.id = len.id, stat GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, id) AS rn FROM s)
SELECT item_id, id, distance, rn FROM r WHERE rn <= 5
""")
def bm25_search_many(spark, t):
    return bm25_topk_many(build_bm25(t.documents, "doc_id", "text"), t.benchmark, "item_id", "text", 5)


WORDS_SQL = r"w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x : x <> '') AS ws FROM documents)"


@plan("fts_match_ranked", f"""
WITH {WORDS_SQL}
SELECT 'and' AS mode, id, CAST(len(list_filter(ws, lambda x : x IN ('the', 'tion'))) AS BIGINT) AS matches FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'tion')
UNION ALL SELECT 'or', id, CAST(len(list_filter(ws, lambda x : x IN ('hention', 'tion'))) AS BIGINT) FROM w WHERE list_contains(ws, 'hention') OR list_contains(ws, 'tion')
UNION ALL SELECT 'phrase', id, CAST(len(list_filter(range(1, len(ws)), lambda i : ws[i] = 'of' AND ws[i + 1] = 'the')) AS BIGINT) AS m FROM w
 WHERE len(list_filter(range(1, len(ws)), lambda i : ws[i] = 'of' AND ws[i + 1] = 'the')) > 0
""")
def fts_match_ranked(spark, t):
    index = build_positions(t.documents, "doc_id", "text")
    parts = [fts(index, terms, mode).select(F.lit(mode).alias("mode"), "id", "matches")
             for terms, mode in ((["the", "tion"], "and"), (["hention", "tion"], "or"), (["of", "the"], "phrase"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan("fts_top", f"""
WITH {WORDS_SQL}, m AS (SELECT id, CAST(len(list_filter(ws, lambda x : x IN ('hention', 'tion', 'the'))) AS BIGINT) AS matches FROM w)
SELECT row_number() OVER (ORDER BY matches DESC, id) AS rn, id, matches FROM m WHERE matches > 0 QUALIFY rn <= 40
""")
def fts_top(spark, t):
    best = fts(build_positions(t.documents, "doc_id", "text"), ["hention", "tion", "the"], "or", 40)
    return best.select(F.row_number().over(Window.orderBy(F.desc("matches"), "id")).alias("rn").cast("long"), "id", "matches")


@plan("bigram_search", "SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text LIKE '%tion the%'")
def bigram_search(spark, t):
    return bigram_candidates(build_bigrams(t.documents, "doc_id", "text"), "tion the").select(
        "id", F.length("text").cast("long").alias("chars"))


def name_pairs(t):
    """Each part name beside the name of the next part."""
    left = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"))
    right = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("b"))
    return left.join(right, "p_partkey")


PAIRS_SQL = """p AS (SELECT l.p_partkey, l.p_name || ' ' || l.p_type AS a, r.p_name || ' ' || r.p_type AS b FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1)"""
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i : substr(' ' || {0} || ' ', i, 2)))"


@plan("bigram_similarity", f"""
WITH {PAIRS_SQL}, g AS (SELECT p_partkey, {GRAMS.format('a')} AS x, {GRAMS.format('b')} AS y FROM p)
SELECT p_partkey, round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) AS similarity FROM g
""")
def bigram_similarity(spark, t):
    return name_pairs(t).select("p_partkey", F.round(bigram_sim(F.col("a"), F.col("b")), 6).alias("similarity"))


@plan("edit_similarity", f"""
WITH {PAIRS_SQL} SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM p
""")
def edit_similarity(spark, t):
    return name_pairs(t).select("p_partkey", F.round(edit_sim(F.col("a"), F.col("b")), 6).alias("similarity"))


@plan("token_cosine_jaccard", f"""
WITH {PAIRS_SQL}, wa AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(a), ' ')) AS w FROM p) GROUP BY 1, 2),
wb AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(b), ' ')) AS w FROM p) GROUP BY 1, 2),
na AS (SELECT p_partkey, sqrt(sum(n * n)) AS v, count(*) AS d FROM wa GROUP BY 1), nb AS (SELECT p_partkey, sqrt(sum(n * n)) AS v, count(*) AS d FROM wb GROUP BY 1),
ab AS (SELECT wa.p_partkey, sum(wa.n * wb.n) AS dot, count(*) AS shared FROM wa JOIN wb ON wa.p_partkey = wb.p_partkey AND wa.w = wb.w GROUP BY 1)
SELECT na.p_partkey, round(coalesce(dot, 0) / (na.v * nb.v), 6)::DOUBLE AS cosine, round(coalesce(shared, 0) / (na.d + nb.d - coalesce(shared, 0)), 6)::DOUBLE AS jaccard
FROM na JOIN nb USING (p_partkey) LEFT JOIN ab USING (p_partkey)
""")
def token_similarity(spark, t):
    return token_sim(name_pairs(t), "p_partkey", "a", "b").select("p_partkey", F.round("cosine", 6).alias("cosine"), F.round("jaccard", 6).alias("jaccard"))


@plan("jaro_similarity", f"""
WITH {PAIRS_SQL} SELECT p_partkey, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS winkler FROM p
""")
def jaro_similarity(spark, t):
    return name_pairs(t).select("p_partkey", F.round(jaro("a", "b"), 6).alias("jaro"), F.round(jaro_winkler("a", "b"), 6).alias("winkler"))


@plan("fuzzy_join", f"""
WITH l AS (SELECT DISTINCT p_name || ' ' || p_brand AS a FROM part), r AS (SELECT DISTINCT p_brand || ' ' || p_name AS b FROM part),
k AS (SELECT DISTINCT p_name || ' ' || p_type AS a FROM part),
lg AS (SELECT a, {GRAMS.format('a')} AS x FROM l), rg AS (SELECT b, {GRAMS.format('b')} AS y FROM r)
SELECT 'bigram' AS kind, a, b, round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) AS similarity FROM lg, rg
WHERE len(list_intersect(x, y)) / greatest(len(x), len(y)) >= 0.85
UNION ALL
SELECT 'edit', a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) FROM k, (SELECT a AS b FROM k)
WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.8
""")
def fuzzy(spark, t):
    left = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("a"))
    right = t.part.select(F.concat_ws(" ", "p_brand", "p_name").alias("b"))
    kinds = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("a"))
    grams = fuzzy_join(left, right, "a", "b", "bigram", 0.85).withColumn("kind", F.lit("bigram"))
    edits = fuzzy_join(kinds, kinds.toDF("b"), "a", "b", "edit", 0.8).withColumn("kind", F.lit("edit"))
    return grams.unionByName(edits).withColumn("similarity", F.round("similarity", 6))
