"""Queries over checks and partition upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators import quality
from lodework.plans.registry import plan
from lodework.session import scratch_path, stage
from lodework.sources.files import retain, write_partitioned


@plan("data_checks", """
WITH c AS (
 SELECT 'balance is not negative' AS name, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS failing FROM customer
 UNION ALL SELECT 'customer key is unique', (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'lines are unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
 UNION ALL SELECT 'name has a number', count(*) FILTER (WHERE NOT regexp_matches(c_name, '#[0-9]{9}$')) FROM customer
 UNION ALL SELECT 'orders refer to customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
 UNION ALL SELECT 'orders stay the same', 0)
SELECT row_number() OVER (ORDER BY name) AS number, name, failing = 0 AS ok, CAST(failing AS BIGINT) AS failing,
       CASE WHEN failing = 0 THEN 'ok ' ELSE 'not ok ' END || row_number() OVER (ORDER BY name) || ' - ' || name AS line FROM c
""")
def data_checks(spark, t):
    return quality.run_checks([
        quality.check_rows(t.customer, [quality.row_check("balance is not negative", F.col("c_acctbal") >= 0),
                                        quality.row_check("name has a number", F.col("c_name").rlike("#[0-9]{9}$"))]),
        quality.check_unique(t.customer, "customer key is unique", ["c_custkey"]),
        quality.check_unique(t.lineitem, "lines are unique", ["l_orderkey", "l_linenumber"]),
        quality.check_reference(t.orders, "orders refer to customers", "o_custkey", t.customer, "c_custkey"),
        quality.check_same_rows(t.orders, stage(t.orders, "orders-copy"), "orders stay the same")])


@plan("partition_retention", """
SELECT CAST(ts AS DATE) AS ts_day, count(*) AS row_count FROM events
WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 7) GROUP BY 1
""")
def partition_retention(spark, t):
    path = scratch_path(spark, "retained")
    part = write_partitioned(t.events, path, "ts", "day")
    retain(spark, path, part, keep=7, dry_run=False)
    return spark.read.parquet(path).groupBy(part).agg(F.count(F.lit(1)).alias("row_count"))
