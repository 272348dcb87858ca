"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.vectors import ann_search, build_ann, centroids, cosine_dist, inner, knn, l2
from lodework.plans.registry import plan

CENTRES_SQL = """
c AS (SELECT label, list(x ORDER BY pos) AS centre FROM
  (SELECT label, pos, round(avg(x), 4) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
"""


def label_centres(t):
    """Mean vector per label, rounded so that both engines ask with the same numbers."""
    centres = centroids(t.embeddings, "label", "embedding")
    return centres.withColumn("centre", F.transform("centre", lambda x: F.round(x, 4)))


@plan("vector_distance", f"""
WITH {CENTRES_SQL}
SELECT vec_id, round(list_distance(embedding::DOUBLE[], centre), 6) AS l2, round(1 - list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS cosine,
       round(list_inner_product(embedding::DOUBLE[], centre), 6) AS inner_product
FROM embeddings JOIN c USING (label)
""")
def vector_distance(spark, t):
    a, b = F.col("embedding"), F.col("centre")
    return t.embeddings.join(label_centres(t), "label").select(
        "vec_id", F.round(l2(a, b), 6).alias("l2"), F.round(cosine_dist(a, b), 6).alias("cosine"),
        F.round(inner(a, b), 6).alias("inner_product"))


@plan("knn_exact", f"""
WITH {CENTRES_SQL}, d AS (SELECT c.label, e.vec_id, list_distance(e.embedding::DOUBLE[], centre) AS distance FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rn FROM d)
SELECT CAST(label AS BIGINT) AS label, vec_id, round(distance, 6) AS distance, rn FROM r WHERE rn <= 10
""")
def knn_exact(spark, t):
    return knn(t.embeddings, "vec_id", "embedding", label_centres(t), "label", "centre", 10).select(
        F.col("qid").alias("label"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rn")


@plan("ann_index", "SELECT m AS metric, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries, true AS recall_ok FROM (VALUES ('cosine'), ('l2')) v(m)")
def ann_index(spark, t):
    """Recall of the ten nearest rows of every row whose id is divisible by 50."""
    queries, out = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("asked"), "embedding"), None
    for metric in ("cosine", "l2"):
        index = build_ann(t.embeddings, "vec_id", "embedding", metric=metric)
        # these vectors have hardly any clusters: a tenth of the lists holds half of the neighbours
        found = ann_search(index, queries, "asked", "embedding", 10, probes=-(-4 * len(index.sizes) // 5)).select("qid", "id")
        exact = knn(t.embeddings, "vec_id", "embedding", queries, "asked", "embedding", 10, metric).select("qid", "id")
        row = (exact.join(found.withColumn("hit", F.lit(1.0)), ["qid", "id"], "left")
               .agg(F.count_distinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
               .select(F.lit(metric).alias("metric"), "queries", (F.col("recall") >= 0.9).alias("recall_ok")))
        out = row if out is None else out.unionByName(row)
    return out
