"""Property graphs as two DataFrames, and iterative graph jobs.

vertices(id string, label, props VARIANT); edges(src, dst, type, props VARIANT).  The id of a vertex is
its label and key as text, so ids never collide.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions.json import path_test
from lodework.session import stage


def vertex_id(label: str, *keys: str | Column) -> Column:
    return F.concat_ws(":", F.lit(label), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def _props(columns: list[str]) -> Column:
    return F.to_variant_object(F.struct(*columns)) if columns else F.parse_json(F.lit("{}"))


def create_vertices(df: DataFrame, label: str, key: list[str], props: list[str]) -> DataFrame:
    """One vertex per row of a table."""
    return df.select(vertex_id(label, *key).alias("id"), F.lit(label).alias("label"), _props(props).alias("props"))


def create_edges(df: DataFrame, type_: str, src: Column, dst: Column, props: list[str] | None = None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), _props(props or []).alias("props"))


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a graph to its folder; labels and edge types are partitions, so a match reads only its own."""
    vertices.write.mode(mode).partitionBy("label").parquet(os.path.join(path, "vertices"))
    edges.write.mode(mode).partitionBy("type").parquet(os.path.join(path, "edges"))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(os.path.join(path, "vertices")).select("id", "label", "props"),
            spark.read.parquet(os.path.join(path, "edges")).select("src", "dst", "type", "props"))


def drop_graph(spark: SparkSession, path: str) -> bool:
    """Remove the folder of a graph; false when there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def _nodes(vertices: DataFrame, node: dict, i: int) -> DataFrame:
    """Vertices that fit one place of a pattern."""
    found = vertices
    if node.get("label"):
        found = found.where(F.col("label") == node["label"])
    for path, op, value in node.get("where", []):
        found = found.where(path_test(F.col("props"), path, op, value))
    return found.select(F.col("id").alias(f"n{i}"), F.col("props").alias(f"n{i}_props"))


def match(vertices: DataFrame, edges: DataFrame, pattern: list[dict]) -> DataFrame:
    """Rows n0, n0_props, r0_props, n1, .. for a chain node - hop - node ..

    A node is {"label", "where": [(path, op, value)]}; a hop is {"type", "direction": "out" | "in"}.
    Each hop is one equi-join over the edges of its type and one over the vertices of its label.
    """
    found = _nodes(vertices, pattern[0], 0)
    for step in range(1, len(pattern), 2):
        hop, node, i = pattern[step], pattern[step + 1], step // 2 + 1
        near, far = ("src", "dst") if hop.get("direction", "out") == "out" else ("dst", "src")
        ties = edges if not hop.get("type") else edges.where(F.col("type") == hop["type"])
        ties = ties.select(F.col(near).alias("_near"), F.col(far).alias("_far"), F.col("props").alias(f"r{i - 1}_props"))
        found = (found.join(ties, F.col(f"n{i - 1}") == F.col("_near"))
                 .join(_nodes(vertices, node, i), F.col("_far") == F.col(f"n{i}")).drop("_near", "_far"))
    return found


def reach(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(origin, id, hops): everything within ``max_hops`` edges of each source id, with the fewest hops.

    Origins are numbered and packed: 64 of them are one word, so a node that many origins reach is a row per word.  A
    hop joins the newest words with the edges, OR-aggregates them by (node, block of origins), in each task before the
    shuffle, and takes off the bits known before.  Each hop is staged, so lineage stays short and a lost executor costs
    one round at most.  The words become rows only in the result.
    """
    pairs = stage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "reach-edges")
    # numbers are dense within a task that wrote them: so are the blocks
    numbers = stage(sources.select(F.col("id").alias("origin")).where("origin IS NOT NULL").distinct()
                    .withColumn("_number", F.monotonically_increasing_id()), "reach-origins")
    numbers = numbers.select("origin", F.shiftright("_number", 6).alias("block"), F.expr("CAST(_number & 63L AS INT)").alias("bit"))
    frontier = stage(numbers.groupBy(F.col("origin").alias("id"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
                     .withColumn("hops", F.lit(0).cast("long")), "reach")
    known = frontier
    for hop in range(1, max_hops + 1):
        met = frontier.join(pairs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
        both = met.select("id", "block", "bits", F.lit(0).cast("long").alias("old")).unionByName(
            known.select("id", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
        new = both.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        step = new.select("id", "block", F.expr("bits & ~old").alias("bits"), F.lit(hop).cast("long").alias("hops")).where("bits != 0")
        frontier = stage(step, "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    every = F.filter(F.array(*[F.lit(b) for b in range(64)]), lambda b: F.getbit("bits", b) == 1)
    return known.select("id", "block", "hops", F.explode(every).alias("bit")).join(numbers, ["block", "bit"]).select("origin", "id", "hops")


def _lanes(edges: DataFrame) -> DataFrame:
    """Directed edges (source, target, cost), parallel ones once."""
    lanes = stage(edges.groupBy("source", "target").agg(F.min(F.col("cost").cast("double")).alias("cost")), "lanes")
    if not lanes.where("cost < 0").isEmpty():
        raise ValueError("edge costs must not be negative")
    return lanes


def _offers(frontier: DataFrame, lanes: DataFrame) -> DataFrame:
    """(origin, node, offer): the least (cost, hops, prev) that the frontier's nodes offer their neighbours."""
    return (frontier.join(lanes, F.col("node") == F.col("source")).groupBy("origin", F.col("target").alias("node"))
            .agg(F.min(F.struct((F.col("best.cost") + lanes["cost"]).alias("cost"), (F.col("best.hops") + 1).alias("hops"),
                                F.col("node").alias("prev"))).alias("best")))


def shortest_path_trees(edges: DataFrame, origins: DataFrame, width: float | None = None) -> DataFrame:
    """(origin, node, cost, hops, prev) of every node that each ``origin`` reaches over directed edges (source, target, cost).

    Delta-stepping: nodes are settled in buckets of ``width`` of cost (by default four times the mean cost of an edge).
    Within a bucket, nodes improved in one round make offers in the next; when it is still, its rows are written once
    and never again, and their offers beyond the bucket join the pending ones.  A round touches the bucket and what it
    offers, not what has been settled.  A node keeps the least (cost, hops, prev), which makes ties repeatable.
    Negative costs raise.
    """
    kind = edges.schema["source"].dataType
    lanes = _lanes(edges)
    if width is None:
        width = 4 * (lanes.agg(F.avg("cost")).first()[0] or 0.0) or 1.0
    nothing = F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(kind).alias("prev"))
    start = origins.select(F.col(origins.columns[0]).cast(kind).alias("origin")).where("origin IS NOT NULL").distinct()
    pending = stage(start.select("origin", F.col("origin").alias("node"), nothing.alias("best")), "paths-pending")
    settled = None
    keys = ["origin", "node"]
    while (least := pending.agg(F.min("best.cost")).first()[0]) is not None:
        end = (least // width + 1) * width
        # costs so large that a step is lost in rounding still move on
        end = end if end > least else float("inf")
        bucket = frontier = pending.where(F.col("best.cost") < end)
        while True:
            offers = _offers(frontier, lanes).where(F.col("best.cost") < end).withColumnRenamed("best", "offer")
            if settled is not None:
                # the offers are few: what is settled is looked through, not dealt out
                done = settled.select(*keys).join(offers.select(*keys), keys, "left_semi")
                offers = offers.join(done, keys, "left_anti")
            merged = stage(bucket.join(offers, keys, "full").select(
                *keys, F.least("best", "offer").alias("best"),
                F.coalesce(F.col("best").isNull() | (F.col("offer") < F.col("best")), F.lit(False)).alias("improved")), "paths-bucket")
            bucket, frontier = merged.select(*keys, "best"), merged.where("improved").select(*keys, "best")
            if frontier.isEmpty():
                break
        settled = bucket if settled is None else settled.unionByName(bucket)
        later = _offers(bucket, lanes).unionByName(pending).where(F.col("best.cost") >= end)
        later = later.groupBy(*keys).agg(F.min("best").alias("best"))
        pending = stage(later.join(settled.select(*keys), keys, "left_anti"), "paths-pending")
    if settled is None:
        return pending.select(*keys, "best.cost", "best.hops", "best.prev")
    return settled.select(*keys, "best.cost", "best.hops", "best.prev")


def shortest_paths(edges: DataFrame, source) -> DataFrame:
    """(node, cost, hops, prev) of every node that ``source`` reaches; see ``shortest_path_trees``."""
    return shortest_path_trees(edges, edges.sparkSession.range(1).select(F.lit(source))).drop("origin")


def routes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(origin, target, seq, node, cost, agg_cost) along the cheapest path of each pair (origin, target) of a table.

    ``cost`` is that of the edge leaving the node.  The paths are read by pointer jumping: joins with the node 1, 2, 4, ..
    steps before, so a path of a million nodes takes 20 of them.  No rows for a target that cannot be reached.
    """
    kind = edges.schema["source"].dataType
    asked = pairs.select(*(F.col(c).cast(kind).alias(name) for c, name in zip(pairs.columns, ("origin", "target")))).distinct()
    trees = stage(shortest_path_trees(edges, asked.select("origin")), "paths-trees")
    ends = stage(asked.join(trees, (trees["origin"] == asked["origin"]) & (F.col("node") == F.col("target"))).select(asked["origin"], "target", "node", "hops"), "paths-read")
    longest = ends.agg(F.max("hops")).first()[0]
    jumps = [trees.where("prev IS NOT NULL").select("origin", F.col("node").alias("at"), F.col("prev").alias("to"))]
    while longest and 1 << len(jumps) <= longest:
        last = jumps[-1]
        jumps.append(stage(last.join(last.select("origin", F.col("at").alias("to"), F.col("to").alias("further")), ["origin", "to"])
                           .select("origin", "at", F.col("further").alias("to")), "paths-jumps"))
    found = ends.select("origin", "target", "node")
    for jump in reversed(jumps) if longest else []:
        before = found.join(jump, (found["origin"] == jump["origin"]) & (found["node"] == jump["at"])).select(found["origin"], "target", F.col("to").alias("node"))
        found = stage(found.unionByName(before), "paths-read")
    steps = found.join(trees, ["origin", "node"]).select("origin", "target", (F.col("hops") + 1).alias("seq"), "node", "cost")
    after = steps.select("origin", "target", (F.col("seq") - 1).alias("seq"), F.col("cost").alias("next"))
    return steps.join(after, ["origin", "target", "seq"], "left").select(
        "origin", "target", "seq", "node", (F.coalesce("next", "cost") - F.col("cost")).alias("cost"), F.col("cost").alias("agg_cost"))


def dijkstra(edges: DataFrame, source, target) -> DataFrame:
    """(seq, node, cost, agg_cost) along the cheapest path; ``cost`` is that of the edge leaving the node.

    No rows when the target cannot be reached.
    """
    pair = edges.sparkSession.range(1).select(F.lit(source).alias("origin"), F.lit(target).alias("target"))
    return routes(edges, pair).drop("origin", "target")
