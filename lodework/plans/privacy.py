"""Queries over masking and encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodework.operators.privacy import decrypt, encrypt, mask, opened
from lodework.plans.registry import plan

FAKE_NAMES = ["Alder", "Birch", "Cedar", "Elm", "Fir", "Hazel", "Larch", "Maple", "Oak", "Pine", "Rowan"]


@plan("anonymize", f"""
SELECT c_custkey, {FAKE_NAMES}[CAST(('0x' || substr(sha256('secret:demo|' || c_name), 1, 12))::BIGINT % 11 AS INT) + 1] AS c_name,
       left(c_mktsegment, 1) || repeat('*', length(c_mktsegment) - 2) || right(c_mktsegment, 1) AS c_mktsegment,
       CAST(floor(c_acctbal / 500) * 500 AS DOUBLE) AS c_acctbal, NULL::INTEGER AS c_nationkey FROM customer
""")
def anonymize(spark, t):
    return mask(t.customer, {"c_name": ("fake", FAKE_NAMES), "c_mktsegment": ("partial", 1, 1), "c_acctbal": ("round", 500),
                             "c_nationkey": ("null",)}, "demo")


@plan("encrypt_columns", """
SELECT c_custkey, c_name, c_acctbal, true AS hidden, true AS wrong_key_fails FROM customer
""")
def encrypt_columns(spark, t):
    plain = t.customer.select("c_custkey", "c_name", "c_acctbal")
    cipher = encrypt(plain, ["c_name", "c_acctbal"], "demo").withColumn("stored", F.col("c_name"))
    types = {"c_name": "string", "c_acctbal": "double"}
    plain_again = decrypt(cipher, types, "demo")
    return plain_again.select(
        "c_custkey", "c_name", "c_acctbal", (F.col("stored") != F.col("c_name").cast("binary")).alias("hidden"),
        opened(F.col("stored"), "c_name", "other").isNull().alias("wrong_key_fails"))
