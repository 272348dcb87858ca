"""Near-duplicates by Jaccard similarity, found through SetSketch registers and confirmed on whole shingle sets.

A register holds the exponentially spaced, truncated minimum of one exponential hash over the set: the registers of a
union are the larger of the registers of its parts (``merge``), and the registers of two sets agree with a probability
that is hardly above their Jaccard similarity, since the spacing (``BASE``) is fine.  A text is a node per distinct
shingle set.  Bands of four registers, 64 bits together, deal the nodes into buckets; two sets of similarity 0.85
share none of the 32 buckets with probability 6e-11.

The hub of a bucket is its node with the most neighbours over all buckets, such as the text that edited copies were made
from; nodes with a hub in common are a group.  First every node meets its hubs, which links most groups of copies.  What
is left to be found are links from a node outside the hub's component to a node of another component.  For them, the
shingles of the nodes of such groups are counted: those that no other component holds are a set's own and shared with none
it could meet, and nodes with more than 15 % of their own go.  In a group with few nodes outside, these meet all others but
those that the own parts rule out.  In larger ones a set is taken as its difference from the hub.  Two sets differ by what
just one of the two differences holds, and if both are together small enough to link the sets by that alone, both sets
are linked with the hub already.  So all other links need shingles that both differences hold; their number follows from
the sizes, and the first of them, in the order of rarity within the group, lies so far ahead in both that as many can
follow.  Nodes meet in such shingles, if bit marks of the differences do not tell that too few are in common.  So no link between different components is lost, and neither a group of a million
copies of one text, nor as many that are nearly but not quite alike, nor many texts that share a passage and nothing else
cost all their pairs.

A pair that meets is compared by its sizes, then by the joint maximum likelihood of the similarity given which registers
are less, equal or greater (a pair goes if 0.85 is less likely than the best value by a factor of exp(25)), and what is
left is confirmed by intersecting the two whole sets, which are made anew from the texts of these nodes, so that no set of
another text is ever stored or dealt out.  Shingles count as equal if their XXH64 is.

Defined results: null and blank texts have no shingles, are linked with nothing and keep their own id; fewer than three
words are one shingle; equal rows are in one component; a row without an id gets the least id of its component, null if
there is none, and is kept in that case alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.llm.common import blocks, id_and_text
from lodework.llm.simhash import components
from lodework.session import stage

#: Registers of a sketch, and how many of them make a band.
REGISTERS, BAND = 128, 4
#: Spacing of the register values, rate of the exponential hashes, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: How much less likely, as a logarithm, the wanted similarity may be than the best one.
SLACK = 25.0
#: Nodes outside the hub's component that meet the other nodes of a group whole; if there are more, they meet in shingles.
OUTSIDERS = 4
#: Words of 64 bits, each bit for the shingles of a difference that fall on it; a power of two.
MARKS = 8
#: Shingles whose hashes are spread over all registers at a time.
SPREAD = 1 << 10

#: Odd factors that give each register an order of its own on the hashes.
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, REGISTERS, np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: str, width: int = 3) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of the word shingles; of the whole sequence if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) <= width else list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes; the sketch of the empty set is zero."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SPREAD):
        np.minimum(least, (hashes[at : at + SPREAD, None] * FACTORS).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(j, u, v, less, equal, greater):
    """Of similarity ``j`` of two sets with shares ``u`` and ``v`` of their summed size, up to a constant."""
    step = (BASE - 1) / BASE
    more = -np.log1p(-np.clip(u - v * j, 0, 1) * step) / np.log(BASE)
    fewer = -np.log1p(-np.clip(v - u * j, 0, 1) * step) / np.log(BASE)
    tiny = 1e-12
    return greater * np.log(np.maximum(more, tiny)) + less * np.log(np.maximum(fewer, tiny)) + equal * np.log(np.maximum(1 - more - fewer, tiny))


def similarity_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood estimates of the similarity of rows of registers with known set sizes, and a function of
    how far, as a logarithm, a given similarity lies below them."""
    greater, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
    less = a.shape[1] - greater - equal
    u, v = na / (na + nb), nb / (na + nb)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(60):  # the logarithm is concave in the similarity
        third = (high - low) / 3
        left, right = low + third, high - third
        up = _log_likelihood(left, u, v, less, equal, greater) < _log_likelihood(right, u, v, less, equal, greater)
        low, high = np.where(up, left, low), np.where(up, high, right)
    best = (low + high) / 2
    return best, lambda j: (_log_likelihood(best, u, v, less, equal, greater)
                            - _log_likelihood(np.minimum(j, np.minimum(u / v, v / u)), u, v, less, equal, greater))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two unsigned numbers."""
    return divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``n`` (size of the set), ``d1``, ``d2`` (digest of the set), ``sketch``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                sets = [shingle_set(t, width) for t in texts[a:b]]
                digests = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["row", "id", "n", "d1", "d2", "sketch"])

    texts = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "_id", "_text")
    return texts.mapInArrow(run, "row bigint, id bigint, n bigint, d1 bigint, d2 bigint, sketch binary")


def whole_sets(texts: DataFrame, wanted: DataFrame, width: int = 3) -> DataFrame:
    """``row`` and ``shingles`` of the nodes ``wanted`` (row, id, d1, d2), from texts ``_id``, ``_text``.

    The ids only choose which texts are read again; the digest decides which set is whose.
    """
    ids = stage(wanted.select("id").distinct(), "setsketch-ids")
    near = texts.join(ids, texts["_id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in blocks(found):
                sets = [shingle_set(t, width) for t in found[a:b]]
                digests = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["d1", "d2", "shingles"])

    sets = near.select("_text").mapInArrow(run, "d1 bigint, d2 bigint, shingles array<bigint>")
    # one set a node, however often its text is repeated under its id
    return sets.join(wanted.select("row", "d1", "d2"), ["d1", "d2"]).select("row", "shingles").dropDuplicates(["row"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def banded(nodes: DataFrame) -> DataFrame:
    """``band``, ``key`` (its registers), ``row``, ``n``: the buckets of every node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.ascontiguousarray(_matrix(batch.column(2))).view(np.int64)  # four registers are 64 bits
            for band in range(REGISTERS // BAND):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, band, np.int32)), pa.array(np.ascontiguousarray(keys[:, band])), batch.column(0), batch.column(1)], ["band", "key", "row", "n"])

    return nodes.select("row", "n", "sketch").mapInArrow(run, "band int, key bigint, row bigint, n bigint")


def confirmed(pairs: DataFrame, rows: DataFrame, sets_of, percent: int) -> DataFrame:
    """Those of the pairs ``u``, ``v`` of rows whose sets have that similarity or more; ``sets_of`` gives the sets of some rows."""

    def likely(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            best, below = similarity_estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb)
            keep = (best >= percent / 100) | (below(percent / 100) <= SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    side = lambda name: rows.select(F.col("row").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"sketch_{name}"))
    met = pairs.join(side("v"), "v").join(side("u"), "u")
    probable = stage(met.select("u", "v", "nu", "nv", "sketch_u", "sketch_v").mapInArrow(likely, "u bigint, v bigint"), "setsketch-probable")
    if probable.isEmpty():
        return probable
    needed = stage(probable.select(F.col("u").alias("row")).union(probable.select("v")).distinct(), "setsketch-needed")
    sets = sets_of(needed)
    both = probable.join(sets.toDF("v", "shingles_v"), "v").join(sets.toDF("u", "shingles_u"), "u")
    shared = F.size(F.array_intersect("shingles_u", "shingles_v"))
    return both.where(100 * shared >= percent * (F.size("shingles_u") + F.size("shingles_v") - shared)).select("u", "v")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can have that similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def grouped(entries: DataFrame) -> DataFrame:
    """``hub``, ``m`` (its size), ``row``, ``n``: the nodes that share a bucket with a hub, once each, without the hub itself."""
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stage(entries.join(shared, ["band", "key"]), "setsketch-buckets")
    ranked = buckets.join(buckets.groupBy("row").agg(F.sum("size").alias("met")), "row")
    hubs = ranked.groupBy("band", "key").agg(F.max_by(F.struct("row", "n"), F.struct("met", -F.col("row"))).alias("hub"))
    placed = buckets.join(hubs, ["band", "key"]).where("row != hub.row")
    return stage(placed.select(F.col("hub.row").alias("hub"), F.col("hub.n").alias("m"), "row", "n").distinct(), "setsketch-members")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the groups that hold more than one component, with ``root`` and ``inside`` (it is the hub's)."""
    placed = (members.join(roots.toDF("row", "own"), "row", "left").join(roots.toDF("hub", "center"), "hub", "left")
              .select("hub", "m", "row", "n", F.coalesce("own", "row").alias("root"), F.coalesce("center", "hub").alias("center")))
    several = placed.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub")
    return stage(placed.join(several, "hub").select("hub", "m", "row", "n", "root", (F.col("root") == F.col("center")).alias("inside")), "setsketch-open")


def with_partners(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members with ``common``, how many of their shingles other components hold, without those too unlike all of them, and
    with ``outside``, how many of their group are not inside."""
    rows = stage(members.groupBy("row").agg(F.min("n").alias("n"), F.min("root").alias("root")), "setsketch-left")
    shingles = sets.join(rows, "row").select("row", "root", F.explode("shingles").alias("shingle"))
    shared = shingles.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    common = shingles.join(shared, "shingle").groupBy("row").agg(F.count("*").alias("common"))
    kept = stage(rows.join(common, "row").where(100 * F.col("common") >= percent * F.col("n")).select("row", "common"), "setsketch-common")
    left = stage(members.join(kept, "row"), "setsketch-partners")
    return left.join(left.where("NOT inside").groupBy("hub").agg(F.count("*").alias("outside")), "hub")


def met_whole(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u < v``, maybe repeated, of the members outside and all of their group that their own shingles leave."""
    chosen = members.where("NOT inside").select("hub", F.col("row").alias("a"), F.col("n").alias("k"), F.col("root").alias("other"), F.col("common").alias("most"))
    most = F.least("common", "most")
    return (members.join(chosen, "hub")
            .where((F.col("root") != F.col("other")) & _alike(F.col("n"), F.col("k"), percent) & (100 * most >= percent * (F.col("n") + F.col("k") - most)))
            .select(F.least("a", "row").alias("u"), F.greatest("a", "row").alias("v")))


def met_in_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u < v``, maybe repeated, of members of different components whose differences from their hub can have enough
    in common.

    Sets of n and k shingles are linked if they differ by (100 - percent) / (100 + percent) * (n + k) at most, and differ by
    the sizes of their differences less twice what these have in common.  ``over`` is a member's share in what has to be
    in common, times 2 * (100 + percent).  A shingle of which ``rest`` and those behind it are as many in both is the first
    common one of a link only if that many are enough; a bit that one has and the other has not is a shingle of its own.
    """
    less, more = 100 - percent, 100 + percent
    held = members.join(sets.toDF("row", "mine"), "row").join(sets.toDF("hub", "its"), "hub")
    apart = held.select("hub", "m", "row", "n", "root", "inside", F.concat(F.array_except("mine", "its"), F.array_except("its", "mine")).alias("apart"))
    each = stage(apart.select("hub", "m", "row", "n", "root", "inside", F.size("apart").cast("long").alias("d"), F.explode("apart").alias("shingle")), "setsketch-apart")
    counts = each.groupBy("hub", "shingle").agg(F.count("*").alias("holders"), F.min("root").alias("low"), F.max("root").alias("high"))
    own = Window.partitionBy("hub", "row")
    at = F.row_number().over(own.orderBy("holders", "shingle")).cast("long")
    bit = lambda k: F.expr(f"IF(shingle & {MARKS - 1} = {k}, shiftleft(1L, CAST(shiftrightunsigned(shingle, 32) & 63 AS INT)), 0L)")
    marks = {f"mark{k}": F.bit_or(bit(k)).over(own) for k in range(MARKS)}
    placed = each.join(counts, ["hub", "shingle"]).withColumns({"at": at, **marks}).where("low < high")
    placed = placed.withColumn("rest", F.col("d") - F.col("at") + 1).withColumn("over", more * F.col("d") - less * F.col("n"))
    # no partner's share is less than what its size leaves; one outside is further from the hub than a link
    near = percent * (F.col("at") - 1) <= less * F.col("n")
    outer = ~F.col("inside") | (2 * more * F.col("rest") > F.col("over") + less * F.col("m"))
    firsts = stage(placed.where(near & outer).select("hub", "shingle", "row", "n", "root", "inside", "d", "at", "rest", "over", *marks), "setsketch-firsts")
    # of a pair, the smaller difference is on the right; it has at least half of what has to be in common
    short = firsts.where(2 * percent * (F.col("at") - 1) <= less * F.col("n")).select(
        "hub", "shingle", F.col("row").alias("a"), F.col("n").alias("k"), F.col("root").alias("other"), F.col("inside").alias("within"), F.col("d").alias("e"), F.col("rest").alias("left"), F.col("over").alias("beyond"),
        *[F.col(m).alias(f"its_{m}") for m in marks])
    lone = lambda a, b: sum((F.bit_count(F.col(a.format(m)).bitwiseAND(F.bitwise_not(b.format(m)))) for m in marks), F.lit(0))
    common = F.least("rest", "left", F.col("d") - lone("{}", "its_{}"), F.col("e") - lone("its_{}", "{}"))
    fits = ((F.col("root") != F.col("other")) & ((F.col("e") < F.col("d")) | ((F.col("e") == F.col("d")) & (F.col("a") < F.col("row"))))
            & _alike(F.col("n"), F.col("k"), percent) & (2 * more * common >= F.col("over") + F.col("beyond")))
    found = firsts.where("NOT inside").join(short, ["hub", "shingle"]).where(fits).union(
        firsts.where("inside").join(short.where("NOT within"), ["hub", "shingle"]).where(fits))
    return found.select(F.least("a", "row").alias("u"), F.greatest("a", "row").alias("v"))


def links(rows: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """``node`` and ``root`` of all nodes that are linked with another one."""

    def read_sets(needed: DataFrame) -> DataFrame:
        wanted = stage(nodes.join(needed, "row", "left_semi").select("row", "id", "d1", "d2"), "setsketch-wanted")
        return stage(whole_sets(texts, wanted, width), "setsketch-sets")

    members = grouped(banded(rows.join(nodes.select("row"), "row", "left_semi")))
    pairs = members.where(_alike(F.col("n"), F.col("m"), percent)).select(F.least("hub", "row").alias("u"), F.greatest("hub", "row").alias("v"))
    met = stage(pairs.distinct(), "setsketch-pairs")
    found = stage(confirmed(met, rows, read_sets, percent), "setsketch-links")
    roots = stage(components(found), "setsketch-roots")
    members = _open(members, roots)
    if members.isEmpty():
        return roots
    sets = read_sets(stage(members.select("row").union(members.select("hub")).distinct(), "setsketch-needed"))
    members = stage(with_partners(members, sets, percent), "setsketch-outsiders")
    pairs = met_whole(members.where(F.col("outside") <= OUTSIDERS), percent).union(
        met_in_shingles(members.where(F.col("outside") > OUTSIDERS), sets, percent))
    new = stage(pairs.distinct().join(met, ["u", "v"], "left_anti"), "setsketch-pairs")
    more = stage(confirmed(new, rows, lambda needed: sets, percent), "setsketch-links")
    return roots if more.isEmpty() else stage(components(found.union(more)), "setsketch-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 3) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the least id linked with it) and ``kept`` of every document."""
    rows = stage(sketches(docs, id_col, text_col, width), "setsketch-rows")
    nodes = stage(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("row"), F.min_by("id", "row").alias("id"), F.min("id").alias("rep")), "setsketch-nodes")
    roots = links(rows, nodes, id_and_text(docs, id_col, text_col), percent, width)
    placed = nodes.join(roots, nodes.row == roots.node, "left").select("d1", "d2", "rep", F.coalesce("root", "row").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = stage(placed.join(least, "root").select("d1", "d2", "component_id"), "setsketch-components")
    texts = rows.where("n > 0").join(of, ["d1", "d2"]).select("id", "n", "component_id")
    blank = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return texts.union(blank).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
