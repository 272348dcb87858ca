"""Near-duplicates by SimHash, linked through the generalised pigeonhole principle.

A fingerprint is cut into parts of bits that vary together.  If two fingerprints differ in at most ``t`` bits and
the thresholds of one of them over ``m`` parts sum to ``t - m + 1``, then some part differs within its threshold.
For each fingerprint, dynamic programming shares that sum out over the parts (-1: the part is not probed) so that
the estimated number of candidates is least; crowded parts get the low thresholds.  Candidates are verified.

A fingerprint that would have to read a crowded bucket is *crowded*.  Crowded ones find each other through common
midpoints instead: two values differ in at most 2 bits if and only if some value is within 1 bit of both.  All others
probe, and so find their crowded neighbours too.  Nothing is dropped, and no bucket gives all its pairs: a midpoint
group holds at most 65 fingerprints, a probe reads at most ``CROWD`` entries a bucket.

Defined results: null text is the empty text, whose fingerprint is zero and which links like any other; texts of one
or two words have one shingle, all their words; equal rows are in one component; a row whose id is null gets the
component of its fingerprint, null if it has no other id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import blocks, id_and_text
from lodework.session import stage

#: A bucket with more fingerprints than this is crowded.
CROWD = 128
#: Parts that a fingerprint is cut into.
PARTS = 3
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (bigint, the bits of the unsigned value) of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                found = pa.array([fingerprint(t, width) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def bit_matrix(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers, lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bit positions of each part.  A part grows by the bit that varies most with those it has.

    The counts of bits and of pairs of bits are over all fingerprints; 64 x 64 sums come to the driver.
    """

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            n += len(values)
            for at in range(0, len(values), COUNTED):
                bits = bit_matrix(values[at : at + COUNTED]).astype(np.float32)
                total += bits.T @ bits
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n).astype(np.int64))], ["i", "j", "n"])

    both, n = np.zeros((64, 64)), 0
    for row in nodes.select("fp").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if row.i < 0:
            n = row.n
        else:
            both[row.i, row.j] = both[row.j, row.i] = row.n
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    together = np.abs(np.where(spread > 0, (both / max(n, 1) - np.outer(share, share)) / np.where(spread > 0, spread, 1), 0))
    np.fill_diagonal(together, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = (len(left) + parts - k - 1) // (parts - k)
        pick = [max(left, key=lambda b: (together[b, left].max(), -b))]
        while len(pick) < size:
            pick.append(max((b for b in left if b not in pick), key=lambda b: (together[b, pick].mean(), -b)))
        out.append(sorted(pick))
        left = [b for b in left if b not in pick]
    return out


def gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that some bits of each fingerprint make."""
    out = np.zeros(len(values), np.int64)
    for to, b in enumerate(bits):
        out |= ((values >> b) & 1) << to
    return out


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds by dynamic programming: ``costs[row, part, threshold + 1]`` to thresholds of least cost with that sum."""
    rows, parts, levels = costs.shape
    lowest = -parts
    reach = total - lowest + levels * parts
    best = np.full((rows, reach), np.inf)
    best[:, -lowest] = 0  # a sum of zero before the first part
    choice = np.zeros((parts, rows, reach), np.int8)
    for part in range(parts):
        after = np.full_like(best, np.inf)
        for level in range(levels):
            step = level - 1
            for s in range(reach):
                if 0 <= s - step < reach:
                    cost = best[:, s - step] + costs[:, part, level]
                    better = cost < after[:, s]
                    after[better, s] = cost[better]
                    choice[part, better, s] = step
        best = after
    at, out = np.full(rows, total - lowest), np.zeros((rows, parts), np.int8)
    for part in reversed(range(parts)):
        out[:, part] = choice[part, np.arange(rows), at]
        at = at - out[:, part]
    return out


def flips(bits: int, count: int) -> list[int]:
    """Masks with so many of so many bits set."""
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), count)]


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints ``fp`` such that all within ``distance`` (2) bits are connected through them."""
    if distance != 2:
        raise ValueError("crowded fingerprints meet at midpoints, which needs a distance of 2")
    parts = correlated_parts(nodes)

    def index(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for part, bits in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), part), pa.int32()), pa.array(gather(values, bits)), batch.column(0)], ["part", "value", "fp"])

    entries = nodes.select("fp").mapInArrow(index, "part int, value bigint, fp bigint")
    counts = entries.groupBy("part", "value").agg(F.count("*").alias("n"))
    indexed = stage(entries.join(counts, ["part", "value"]), "simhash-index")
    # how many entries a probe of each part meets on average, for the estimates
    mean = {r.part: r.mean for r in indexed.groupBy("part").agg(F.avg("n").alias("mean")).collect()}
    crowds = indexed.groupBy("fp").agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(f"n{p}") for p in range(len(parts))])
    sizes, crowd = [len(b) for b in parts], CROWD

    def probe(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            costs = np.zeros((len(values), len(parts), 3))
            own = np.stack([batch.column(1 + p).to_numpy(zero_copy_only=False) for p in range(len(parts))], axis=1).astype(float)
            costs[:, :, 1] = own + 1
            for p, size in enumerate(sizes):
                costs[:, p, 2] = own[:, p] + 1 + size * (1 + mean.get(p, 1.0))
            chosen = allocate(costs, distance - len(parts) + 1)
            held = ((chosen >= 0) & (own > crowd)).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(held.sum(), -1), pa.int32()), pa.array(values[held]), pa.array(values[held]), pa.array(np.zeros(held.sum()), pa.int32())], ["part", "value", "fp", "flips"])
            for p, bits in enumerate(parts):
                for count in (0, 1):
                    who = values[(chosen[:, p] >= count) & ~held]
                    base = gather(who, bits)
                    for mask in flips(len(bits), count):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(who), p), pa.int32()), pa.array(base ^ mask), pa.array(who), pa.array(np.full(len(who), count), pa.int32())], ["part", "value", "fp", "flips"])

    probes = stage(crowds.mapInArrow(probe, "part int, value bigint, fp bigint, flips int"), "simhash-probes")
    hot = indexed.where(F.col("n") > crowd).select("part", "value").distinct()
    crowded = probes.where("part < 0").select("fp").union(
        probes.where("flips > 0").join(hot, ["part", "value"], "left_semi").select("fp")).distinct()

    cold = indexed.where(F.col("n") <= crowd).select("part", "value", F.col("fp").alias("other"))
    near = probes.where("part >= 0").join(cold, ["part", "value"]).where(
        (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    met = near.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))

    masks = np.array([0] + [1 << b for b in range(64)], np.uint64).view(np.int64)

    def midpoints(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for mask in masks:
                yield pa.RecordBatch.from_arrays([pa.array(values ^ mask), batch.column(0)], ["middle", "fp"])

    groups = crowded.mapInArrow(midpoints, "middle bigint, fp bigint").groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    through = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
    return met.union(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's least node) of every node of the pairs ``u``, ``v``.

    Large-star and small-star steps in turn until no pair changes.  A node's least neighbour is an aggregate that
    each task starts on its own rows, and its pairs meet it in a join, so a node with very many neighbours is no
    single task's.  Each round is a table in the shared folder.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.select(F.col("u").alias("c"), F.col("v").alias("w")).union(pairs.select(F.col("v").alias("c"), F.col("u").alias("w")))
        least = both.groupBy("c").agg(F.least(F.min("w"), F.col("c")).alias("m"))
        if small:
            out = both.where("w < c").join(least, "c").select("w", "c", "m")
            moved = out.select(F.col("w").alias("a"), "m").union(out.select(F.col("c").alias("a"), "m"))
        else:
            moved = both.where("w > c").join(least, "c").select(F.col("w").alias("a"), "m")
        return moved.where("a != m").select(F.col("m").alias("u"), F.col("a").alias("v")).distinct()

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first())

    pairs = stage(edges.where("u < v").select("u", "v"), "simhash-pairs")
    before = None
    while (now := mark(pairs)) != before:
        before = now
        pairs = stage(star(star(pairs, False), True), "simhash-pairs")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the least id linked with it) of every document."""
    marked = stage(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = components(links(nodes, distance))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = stage(placed.join(least, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
