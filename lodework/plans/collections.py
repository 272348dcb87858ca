"""Queries over document collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.collections import aggregate, collection, delete, find, insert, update
from lodework.plans.registry import plan


def event_documents(t):
    body = F.to_json(F.struct("event_type", "user_id", "value", F.from_json("props", "k long").alias("props")))
    return collection(t.events.withColumn("body", body), "event_id", "body")


TEXT_SQL = """'{"event_type":"' || event_type || '","props":{"k":' || json_extract(props, '$.k') || '},"user_id":' || user_id || '}'"""


@plan("doc_insert_find", f"""
SELECT CAST(event_id AS VARCHAR) AS _id, {TEXT_SQL} AS doc FROM events
WHERE event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50
""")
def doc_insert_find(spark, t):
    body = F.to_json(F.struct("user_id", "event_type", F.from_json("props", "k long").alias("props")))
    docs = collection(t.events.withColumn("body", body), "event_id", "body")
    early, late = docs.where(F.col("_id").cast("long") < 5000), docs.where(F.col("_id").cast("long") >= 5000)
    found = find(insert(early, late), {"event_type": "purchase", "props.k": {"$gte": 50}})
    return found.select("_id", F.to_json("doc").alias("doc"))


@plan("doc_update_delete", """
WITH lowest AS (SELECT min(CAST(event_id AS VARCHAR)) AS id FROM events WHERE event_type = 'view'),
kept AS (SELECT * FROM events, lowest WHERE CAST(event_id AS VARCHAR) <> id AND NOT (event_type = 'error' AND user_id < 20))
SELECT CAST(event_id AS VARCHAR) AS _id, CASE WHEN event_type = 'signup' THEN 'member' ELSE event_type END AS event_type,
       CASE WHEN event_type = 'signup' THEN 1::BIGINT ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, user_id FROM kept
""")
def doc_update_delete(spark, t):
    docs = event_documents(t)
    docs = update(docs, {"event_type": "signup"}, {"$set": {"event_type": "member", "props.k": 1}})
    docs = delete(docs, {"event_type": "view"}, one=True)
    docs = delete(docs, {"event_type": "error", "user_id": {"$lt": 20}})
    read = [F.variant_get("doc", f"$.{p}", kind).alias(p.split(".")[-1])
            for p, kind in (("event_type", "string"), ("props.k", "long"), ("user_id", "long"))]
    return docs.select("_id", *read)


@plan("doc_aggregate", """
SELECT event_type AS _id, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS mean_k, max(value) AS top FROM events WHERE value >= 10 GROUP BY 1
UNION ALL SELECT NULL, count(*), round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6), max(value) FROM events WHERE value >= 10
""")
def doc_aggregate(spark, t):
    docs = event_documents(t)
    measures = {"n": {"$sum": 1}, "mean_k": {"$avg": "$props.k"}, "top": {"$max": "$value"}}
    groups = aggregate(docs, [{"$match": {"value": {"$gte": 10}}}, {"$group": {"_id": "$event_type", **measures}}, {"$sort": {"_id": 1}}])
    whole = aggregate(docs, [{"$match": {"value": {"$gte": 10}}}, {"$group": {"_id": None, **measures}}])
    both = groups.unionByName(whole).withColumn("mean_k", F.round("mean_k", 6))
    return both.withColumn("top", F.variant_get("top", "$", "double"))
