"""From raw documents to token ids: quality rules, near-dedup, decontamination, secret masking, byte-level BPE.

Each stage takes the documents that the one before kept, with all their columns, and returns those it keeps; the last
returns their ids.  Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.llm import bpe, decontaminate, rules, secret_scan, simhash
from lodework.llm.common import table
from lodework.session import apply_runtime_settings, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie too far from their language and source go."""
    return rules.judge(docs).where("kept").select("row.*")


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The documents with a key of their own, which ids that are null or repeat are not, and the name of its column."""
    key = "_row"
    while key in docs.columns:
        key = "_" + key
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), label), key


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays, that of least id; of rows that share this id, one.

    Groups are those of the texts: rows that share an id without being alike are judged one by one, rows without an id
    like all others, and such a row stays only if its group has no id.
    """
    rows, key = numbered(docs, "dedup-rows")
    found = simhash.near_duplicates(rows, key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    # no texts: narrow rows, staged since the survivors are looked for in them
    groups = stage(found.join(ids, "row"), "dedup-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    others = groups.join(first, "component_id").where("row != first.row").select(F.col("row").alias(key))
    # as a rule too many to broadcast: the same join at every size
    return rows.join(others.hint("merge"), key, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, row by row: those without an id too, those that only share one not."""
    rows, key = numbered(docs, "leak-rows")
    leaked = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaked, key, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    found = secret_scan.scan(docs)
    text = secret_scan.masked(F.col("row.text"), F.col("spans"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]
#: Fingerprints, alignments and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_runtime_settings(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
