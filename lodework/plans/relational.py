"""Queries over projections, filters, set operations, order and row rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.functions.regex import regex_count, regex_extract, regex_filter
from lodework.functions.text import fold_ascii
from lodework.operators.ordered import topk
from lodework.operators.tabular import collated, insert_rows, rewrite, semver_key, semver_latest, table_diff
from lodework.plans.registry import plan
from lodework.session import stage

VERSION_SQL = ("(p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) || "
               "CASE WHEN p_partkey % 5 = 0 THEN '-rc1' WHEN p_partkey % 5 = 1 THEN '-rc.2' ELSE '' END)")


def versions(part):
    return part.withColumn("version", F.expr(VERSION_SQL))


@plan("project_case", """
SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 'high'
       WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band,
       CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS key_text,
       (SELECT count(*) FROM region) = 5 AS five_regions FROM orders
""")
def project_case(spark, t):
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    regions = t.region.agg(F.count(F.lit(1))).scalar()
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.when(price > mean, "high").when(price > 50000, "middle").otherwise("low").alias("band"),
        F.rint(price).cast("long").alias("whole"), F.col("o_orderkey").cast("string").alias("key_text"),
        (regions == 5).alias("five_regions"))


@plan("filter_predicates", """
SELECT p_partkey, p_name, p_type, p_size FROM part
WHERE p_size BETWEEN 5 AND 40 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_name LIKE '%ring%'
  AND NOT p_brand = 'Brand#1' AND nullif(p_size, 7) IS NOT NULL AND p_retailprice >= 900
""")
def filter_predicates(spark, t):
    return (t.part.where(F.col("p_size").between(5, 40) & F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")
                         & F.col("p_name").like("%ring%") & ~(F.col("p_brand") == "Brand#1")
                         & F.nullif(F.col("p_size"), F.lit(7)).isNotNull() & (F.col("p_retailprice") >= 900))
            .select("p_partkey", "p_name", "p_type", "p_size"))


@plan("cte_derived", """
WITH spend AS (SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1)
SELECT c_mktsegment, count(*) AS customers, CAST(max(total) AS DOUBLE) AS best
FROM (SELECT * FROM spend WHERE orders > 5) s JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def cte_derived(spark, t):
    return spark.sql("""
        WITH spend AS (SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
                       FROM {orders} GROUP BY o_custkey)
        SELECT c_mktsegment, count(*) AS customers, CAST(max(total) AS DOUBLE) AS best
        FROM (SELECT * FROM spend WHERE orders > 5) s JOIN {customer} ON o_custkey = c_custkey
        GROUP BY c_mktsegment""", orders=t.orders, customer=t.customer)


@plan("regex_match", """
SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://(www|m)\\.[a-z]+') AND regexp_matches(html, '(?i)<NAV>')
""")
def regex_match(spark, t):
    found = regex_filter(t.pages, "url", r"^https?://(www|m)\.[a-z]+")
    return regex_filter(found, "html", r"(?i)<NAV>").select("page_id", "url")


@plan("regex_extract", """
SELECT page_id, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host,
       nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS page_no,
       nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages
""")
def regex_extracted(spark, t):
    df = regex_extract(t.pages, "url", r"^https?://([^/?#]+)", 1, "host")
    df = regex_extract(df, "url", r"[?&]page=(\d+)", 1, "page_no")
    return regex_extract(df, "html", r"<title>([^<]*)</title>", 1, "title").select("page_id", "host", "page_no", "title")


@plan("regex_count", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers,
       CAST(len(regexp_extract_all(text, '[A-Za-z]+@[A-Za-z.]+')) AS BIGINT) AS addresses FROM documents
""")
def regex_counted(spark, t):
    df = regex_count(t.documents, "text", "[0-9]+", "numbers")
    return regex_count(df, "text", "[A-Za-z]+@[A-Za-z.]+", "addresses").select("doc_id", "numbers", "addresses")


@plan("rewrite_update_delete", """
WITH base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority FROM orders),
grown AS (SELECT * FROM base UNION ALL SELECT c_custkey + 1000000000, 'N', c_acctbal, NULL FROM customer),
updated AS (SELECT o_orderkey, CASE WHEN priority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                   CASE WHEN priority = '1-URGENT' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, priority FROM grown)
SELECT * FROM updated WHERE NOT coalesce(priority = '2-HIGH' AND o_totalprice < 100000, false)
""")
def rewrite_rows(spark, t):
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice",
                           F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    grown = insert_rows(base, t.customer.select((F.col("c_custkey") + 1000000000).alias("o_orderkey"),
                                                F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice")))
    updated = rewrite(grown, F.col("priority") == "1-URGENT",
                      {"o_orderstatus": F.lit("X"), "o_totalprice": F.round(F.col("o_totalprice") * 2, 2)})
    return rewrite(updated, (F.col("priority") == "2-HIGH") & (F.col("o_totalprice") < 100000))


@plan("sort_limit", """
SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status FROM orders
ORDER BY status ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 100
""")
def sort_limit(spark, t):
    return (t.orders.select("o_orderkey", "o_totalprice", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
            .orderBy(F.asc_nulls_last("status"), F.desc("o_totalprice"), "o_orderkey").limit(100))


@plan("topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rn FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def topk_per_group(spark, t):
    return topk(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select(
        "o_custkey", "o_orderkey", "o_totalprice", "rn")


@plan("semver_sort", f"""
WITH v AS (SELECT p_brand, p_size, p_partkey % 10 AS minor, p_partkey % 7 AS patch,
                  CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 = 1 THEN 0 ELSE 2 END AS pre, {VERSION_SQL} AS version FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, minor DESC, patch DESC, pre DESC) AS rn,
             count(*) OVER (PARTITION BY p_brand) AS versions,
             count(*) FILTER (WHERE (p_size, minor, patch) >= (10, 5, 3) AND NOT ((p_size, minor, patch) = (10, 5, 3) AND pre < 2))
               OVER (PARTITION BY p_brand) AS from_10_5_3 FROM v)
SELECT p_brand, version AS latest, versions, from_10_5_3 FROM r WHERE rn = 1
""")
def semver_sort(spark, t):
    df = versions(t.part)
    recent = df.where(semver_key(F.col("version")) >= semver_key(F.lit("10.5.3"))).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("from_10_5_3"))
    return (semver_latest(df, ["p_brand"], "version").join(recent, "p_brand", "left")
            .select("p_brand", "latest", "versions", F.coalesce("from_10_5_3", F.lit(0)).alias("from_10_5_3")))


@plan("collated_sort", """
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM documents)
SELECT replace(lower(strip_accents(word)), 'ß', 'ss') AS folded, count(*) AS uses FROM w GROUP BY 1
""")
def collated_sort(spark, t):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]+"), 0)).alias("word"))
    # staged: the range sort reads its input twice
    plain = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    return (plain.groupBy(collated("word").alias("key")).agg(F.min(fold_ascii(F.lower("word"))).alias("folded"),
                                                              F.sum("n").alias("uses"))
            .orderBy("key").select("folded", "uses"))


@plan("set_ops", """
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT c_custkey AS k FROM customer)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'union_all', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)
UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'intersect_all', k FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b)
UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM b)
UNION ALL SELECT 'except_all', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)
""")
def set_ops(spark, t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    c = t.customer.select(F.col("c_custkey").alias("k"))
    parts = {"union": a.unionByName(b).distinct(), "union_all": a.unionByName(b), "intersect": a.intersect(b),
             "intersect_all": a.intersectAll(b), "except": c.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for op, df in parts.items():
        df = df.select(F.lit(op).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@plan("table_diff", """
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(a.o_orderkey, d.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN d.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
       CASE WHEN a.o_orderkey IS NOT NULL AND d.o_orderkey IS NOT NULL THEN
            concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM d.o_orderstatus THEN 'o_orderstatus' END,
                           CASE WHEN a.o_totalprice IS DISTINCT FROM d.o_totalprice THEN 'o_totalprice' END) END AS changed
FROM a FULL JOIN d ON a.o_orderkey = d.o_orderkey
WHERE a.o_orderkey IS NULL OR d.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM d.o_orderstatus
   OR a.o_totalprice IS DISTINCT FROM d.o_totalprice
""")
def diff(spark, t):
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    desired = base.where(key % 13 != 0).select(
        "o_orderkey", F.when(key % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return table_diff(base.where(key % 11 != 0), desired, ["o_orderkey"])
