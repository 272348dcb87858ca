"""Full-text search over postings tables: BM25, boolean and phrase match, 2-gram substring search.

An index is a set of DataFrames staged in the shared folder.  BM25 postings are packed in blocks that carry a bound on
what any of their texts can score, 2-gram postings in blocks of delta-coded places within a segment of texts.  Blocks and
positions are spread by hash, so a frequent term is no single task's, and sorted by term within each file, so the
statistics of its pages let a search skip other terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.operators.ordered import topk
from lodework.session import stage

# English words that carry no meaning for ranking.
STOP_WORDS = ("a an and are as at be but by for from had has have he her his i if in into is it its "
              "no not of on or our she so such that the their then there these they this to was we "
              "were what when which who will with you your").split()


def _by_term(rows: DataFrame, label: str, *spread: str) -> DataFrame:
    """Stage rows spread by some columns; each file is sorted by term and these."""
    return stage(rows.repartition("term", *spread).sortWithinPartitions("term", *spread), label)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stop words, in text order."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def _terms_of(df: DataFrame, query: str) -> list[str]:
    """Distinct terms of one query text, cut by the same expression as the corpus."""
    return sorted(set(df.sparkSession.range(1).select(tokens(F.lit(query))).first()[0]))


#: Postings meant for one block, and how many times ``k`` texts of the rarest terms are scored for a first threshold.
BLOCK_POSTINGS, SEEDS = 128, 4
#: Scores are compared after rounding; pruning leaves this much room.
ROOM = 1e-5


@dataclass(frozen=True)
class Bm25Index:
    """blocks(term, block, texts, total_tf, max_tf, min_len, entries of id, tf, len) and terms(term, df, total_tf, bits, max_tf, min_len).

    len is the length of the text.  A term's postings are dealt into 2 ** bits blocks by the leading bits of a hash of the
    id, so the block that would hold a given id is known without a search.
    """

    blocks: DataFrame
    terms: DataFrame
    documents: int
    total_length: int

    @property
    def mean_length(self) -> float:
        return self.total_length / max(self.documents, 1)


def _block_of(id_col: str, bits: str) -> Column:
    return F.expr(f"CASE WHEN {bits} = 0 THEN 0 ELSE shiftrightunsigned(xxhash64({id_col}), 64 - {bits}) END")


def build_bm25(df: DataFrame, id_col: str, text: str) -> Bm25Index:
    """Term statistics and packed postings of a corpus.

    The words of a text are counted where it is read and go straight to the task that packs their block; all statistics
    come from the blocks.  How many blocks a term gets is counted beforehand, text by text, which is all but exact.  Texts
    without a word count as documents of length 0.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    cut = texts.select("id", tokens(F.col("text")).alias("words"))
    many = F.col("rows") / BLOCK_POSTINGS
    # only terms of more than one block have to be looked up
    wide = stage(cut.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
                 .where(many > 1).select("term", F.ceil(F.log2(many)).cast("int").alias("bits")), "terms-wide")
    kind = texts.schema["id"].dataType.simpleString()
    counted = cut.mapInArrow(_counted, f"id {kind}, term string, tf bigint, len bigint")
    placed = counted.join(wide, "term", "left").withColumn("bits", F.coalesce("bits", F.lit(0))).select("term", _block_of("id", "bits").alias("block"), "id", "tf", "len")
    blocks = stage(placed.repartition("term", "block").sortWithinPartitions("term", "block", "id").mapInArrow(
        _packed, f"term string, block bigint, texts bigint, total_tf bigint, max_tf bigint, min_len bigint, entries array<struct<id: {kind}, tf: bigint, len: bigint>>"), "postings-blocks")
    stats = blocks.groupBy("term").agg(F.sum("texts").alias("df"), F.sum("total_tf").alias("total_tf"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    terms = stage(stats.join(wide, "term", "left").withColumn("bits", F.coalesce("bits", F.lit(0))), "terms")
    documents, total = df.count(), terms.agg(F.sum("total_tf")).first()[0] or 0
    return Bm25Index(blocks, terms, documents, total)


#: Words that a task counts at a time.
COUNTED_WORDS = 1 << 20


def _counted(batches):
    """Rows (id, words) to (id, term, tf, len), text by text."""
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(lists):
            before = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, before + COUNTED_WORDS, "right")), start + 1)
            words = pc.dictionary_encode(lists.slice(start, end - start).flatten())
            kinds = max(len(words.dictionary), 1)
            keys = np.repeat(np.arange(end - start), sizes[start:end]) * kinds + words.indices.to_numpy(zero_copy_only=False)
            keys, tf = np.unique(keys, return_counts=True)
            row = keys // kinds + start
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.dictionary.take(pa.array(keys % kinds)), pa.array(tf.astype(np.int64)), pa.array(sizes[row])],
                                             ["id", "term", "tf", "len"])
            start = end


def _changes(values: pa.Array) -> np.ndarray:
    """Which values differ from the one before; NULLs are equal, NaNs too."""
    out = np.ones(len(values), bool)
    if pa.types.is_nested(values.type):
        rows = values.to_pylist()
        out[1:] = [a != b for a, b in zip(rows[1:], rows)]
        return out
    a, b = values.slice(1), values.slice(0, len(values) - 1)
    flags = lambda x, nan: pc.is_null(x, nan_is_null=nan).to_numpy(zero_copy_only=False)
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    out[1:] = (flags(a, False) != flags(b, False)) | (unlike & ~(flags(a, True) & flags(b, True)))
    return out


def _packed(batches):
    """Rows sorted by (term, block, id) to one row per block, rows that share an id as one text; the last block of a batch
    waits for the next batch."""
    held = None
    for batch in _then_none(batches):
        table = held if batch is None else pa.Table.from_batches([batch])
        if batch is not None and held is not None:
            table = pa.concat_tables([held, table])
        if table is None or not len(table):
            continue
        table = table.combine_chunks()
        term, block = table.column(0).combine_chunks(), table.column(1).to_numpy()
        starts = _changes(term)
        starts[1:] |= block[1:] != block[:-1]
        at = np.flatnonzero(starts)
        whole = len(table)
        if batch is not None:
            whole, held, at = int(at[-1]), table.slice(int(at[-1])), at[:-1]
        if not len(at):
            continue
        ids, tf, length = (table.column(i).combine_chunks().slice(0, whole) for i in (2, 3, 4))
        texts = np.flatnonzero(_changes(ids) | starts[:whole])
        tf, length = np.add.reduceat(tf.to_numpy(), texts), np.maximum.reduceat(length.to_numpy(), texts)
        first = np.searchsorted(texts, at)  # of each block among the texts
        entries = pa.StructArray.from_arrays([ids.take(pa.array(texts)), pa.array(tf), pa.array(length)], ["id", "tf", "len"])
        yield pa.RecordBatch.from_arrays(
            [term.take(pa.array(at)), pa.array(block[at]), pa.array(np.diff(np.append(first, len(texts)))), pa.array(np.add.reduceat(tf, first)), pa.array(np.maximum.reduceat(tf, first)),
             pa.array(np.minimum.reduceat(length, first)), pa.ListArray.from_arrays(pa.array(np.append(first, len(texts)).astype(np.int32)), entries)],
            ["term", "block", "texts", "total_tf", "max_tf", "min_len", "entries"])


def _then_none(batches):
    yield from batches
    yield None


class _Scorer:
    """BM25 parts and bounds for the statistics of an index."""

    def __init__(self, index: Bm25Index, k1: float, b: float):
        self.index, self.k1, self.b = index, k1, b

    @property
    def idf(self) -> Column:
        n = F.lit(float(self.index.documents))
        return F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def part(self, tf: str, length: str) -> Column:
        """What a term adds; grows with tf and falls with the length, so (max_tf, min_len) gives a bound."""
        norm = self.k1 * (1 - self.b + self.b * F.col(length) / self.index.mean_length)
        return F.col("idf") * F.col(tf) * (self.k1 + 1) / (F.col(tf) + norm)


def _asked(index: Bm25Index, queries: DataFrame, qid: str, text: str, score: _Scorer) -> DataFrame:
    """(q, term, bits, df, idf, bound) of the known terms of each query."""
    words = queries.select(F.col(qid).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()
    known = words.join(index.terms, "term").withColumn("idf", score.idf)
    return known.select("q", "term", "bits", "df", "idf", score.part("max_tf", "min_len").alias("bound"))


def _parts(score: _Scorer, blocks: DataFrame) -> DataFrame:
    """(q, id, part) of all entries of some blocks that carry q and idf."""
    return blocks.select("q", "idf", F.inline("entries")).select("q", "id", score.part("tf", "len").alias("part"))


def _rest(index: Bm25Index, score: _Scorer, wanted: DataFrame) -> DataFrame:
    """(q, id, part) for rows (q, id, term, bits, idf) whose text holds the term; other blocks of the term stay closed."""
    placed = wanted.withColumn("block", _block_of("id", "bits"))
    needed = stage(placed.select("term", "block").distinct(), "bm25-needed")  # its size decides how it is joined
    entries = index.blocks.join(needed, ["term", "block"]).select("term", F.inline("entries"))
    return placed.join(entries, ["term", "id"]).select("q", "id", score.part("tf", "len").alias("part"))


def _thresholds(index: Bm25Index, asked: DataFrame, k: int, score: _Scorer) -> DataFrame:
    """(q, floor): a score that at least ``k`` texts reach, from whole scores of the best texts of the rarest terms."""
    by_rarity = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = asked.withColumn("before", F.coalesce(F.sum("df").over(by_rarity), F.lit(0))).where(F.col("before") < SEEDS * k)
    partial = _parts(score, seeds.join(index.blocks.select("term", "entries"), "term")).groupBy("q", "id").agg(F.sum("part").alias("score"))
    best = topk(partial, ["q"], [F.desc("score"), F.asc("id")], 2 * k).select("q", "id")
    whole = _rest(index, score, best.join(asked, "q")).groupBy("q", "id").agg(F.sum("part").alias("score"))
    return topk(whole, ["q"], [F.desc("score"), F.asc("id")], k).groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - ROOM).otherwise(0.0).alias("floor"))


def _planned(index: Bm25Index, queries: DataFrame, qid: str, text: str, k: int, score: _Scorer) -> DataFrame:
    """The terms of each query with its floor, whether they are essential, and the bounds of the others."""
    asked = stage(_asked(index, queries, qid, text, score), "bm25-asked")
    floors = _thresholds(index, asked, k, score)
    by_bound = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("q")
    known = asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    return stage(known.select("*", (F.sum("bound").over(by_bound) >= F.col("floor")).alias("essential"), (F.sum("bound").over(every) - F.col("bound")).alias("others")), "bm25-planned")


def bm25_topk_many(index: Bm25Index, queries: DataFrame, qid: str, text: str, k: int,
                   k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, distance, rn): the ``k`` best documents of each query text of a table; the distance is the negative score.

    Block-max pruning: a first threshold comes from the rarest terms, blocks below it stay closed, and the frequent terms
    are looked up only for texts that can still reach it.  The rows are those of scoring everything.
    """
    score = _Scorer(index, k1, b)
    asked = _planned(index, queries, qid, text, k, score)
    found = stage(_parts(score, bm25_open(index, asked, score)).groupBy("q", "id").agg(F.sum("part").alias("score")), "bm25-found")
    # what k texts have already lifts the threshold; the bounds of the frequent terms decide which texts go on
    reached = topk(found, ["q"], [F.desc("score"), F.asc("id")], k).groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - ROOM).otherwise(0.0).alias("reached"))
    frequent = asked.groupBy("q").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))), F.lit(0.0)).alias("more"))
    limits = frequent.join(reached, "q", "left").select("q", "more", F.greatest("floor", F.coalesce("reached", F.lit(0.0))).alias("floor"))
    going = stage(found.join(limits, "q").where(F.col("score") + F.col("more") >= F.col("floor")).select("q", "id", "score"), "bm25-candidates")
    # a text of the result has all its essential parts, since none of its blocks stays closed; the frequent terms are added
    rest = _rest(index, score, going.select("q", "id").join(asked.where("NOT essential").select("q", "term", "bits", "idf"), "q"))
    whole = going.select("q", "id", F.col("score").alias("part")).unionByName(rest).groupBy("q", "id").agg(F.sum("part").alias("score"))
    rounded = whole.select(F.col("q").alias(qid), "id", F.round(-F.col("score"), 6).alias("distance"))
    return topk(rounded, [qid], [F.asc("distance"), F.asc("id")], k)


def bm25_open(index: Bm25Index, asked: DataFrame, score: _Scorer) -> DataFrame:
    """The blocks (q, term, idf, entries) that are unpacked for the candidates; the bounds alone decide.

    A text of the result holds an essential term, since the others together stay below the floor; and a block whose own
    bound does not lift the other terms over the floor holds none.
    """
    return asked.where("essential").join(index.blocks, "term").where(score.part("max_tf", "min_len") + F.col("others") >= F.col("floor")).select("q", "term", "idf", "entries")


def bm25_topk(index: Bm25Index, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, distance) of the ``k`` best documents, best first: the distance is the negative score."""
    wanted = F.col("term").isin(_terms_of(index.blocks, query))
    own = Bm25Index(index.blocks.where(wanted), index.terms.where(wanted), index.documents, index.total_length)
    asked = index.blocks.sparkSession.range(1).select("id", F.lit(query).alias("text"))
    return bm25_topk_many(own, asked.toDF("q", "text"), "q", "text", k, k1, b).orderBy("distance", "id").select("id", "distance")


@dataclass(frozen=True)
class PositionIndex:
    """postings(term, id, pos) with the place of each word in its text, stop words counted."""

    postings: DataFrame


def build_positions(df: DataFrame, id_col: str, text: str) -> PositionIndex:
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    words = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = texts.select("id", F.posexplode(words).alias("pos", "term"))
    return PositionIndex(_by_term(rows, "positions", "id"))


def fts(index: PositionIndex, terms: list[str], mode: str = "and", k: int | None = None) -> DataFrame:
    """(id, matches) of texts that hold all terms (and), any (or), or the exact phrase; most matches first.

    A phrase needs no self-join: each term votes for the position where the phrase would start, and a
    start with votes from all places is an occurrence.
    """
    words = [t.lower() for t in terms]
    hits = index.postings.where(F.col("term").isin(words))
    if mode == "phrase":
        offsets = F.explode(F.array(*[F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(words)])).alias("off")
        votes = hits.select("id", "pos", offsets).where(F.col("off").isNotNull())
        starts = (votes.groupBy("id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") == len(words)))
        found = starts.groupBy("id").agg(F.count(F.lit(1)).alias("matches"))
    else:
        per_term = hits.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
        found = per_term.groupBy("id").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("_terms"))
        if mode == "and":
            found = found.where(F.col("_terms") == len(set(words)))
        elif mode != "or":
            raise ValueError("mode is 'and', 'or' or 'phrase'")
        found = found.drop("_terms")
    return found if k is None else found.orderBy(F.desc("matches"), "id").limit(k)


def bigrams(text: Column) -> Column:
    """Overlapping 2-grams of the characters of a text, in order, in one pass over it."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


#: Texts and characters of a segment of the 2-gram index.
SEGMENT_TEXTS, SEGMENT_CHARS = 4096, 1 << 22


@dataclass(frozen=True)
class BigramIndex:
    """blocks(segment, term, n, places): which texts of a segment hold a 2-gram, as delta-coded bytes; segments(segment,
    ids): the ids of the texts by place; and the texts themselves."""

    blocks: DataFrame
    segments: DataFrame
    texts: DataFrame


def pack(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2 ** 28 as bytes, seven bits each, lowest first, the last one of a number with the high bit set; and how
    many bytes each number has."""
    sizes = 1 + (deltas >= 1 << 7) + (deltas >= 1 << 14) + (deltas >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        some = sizes > k
        out[ends[some] - sizes[some] + k] = (deltas[some] >> 7 * k) & 127
    out[ends - 1] |= 128
    return out, sizes


def unpack(data: bytes) -> np.ndarray:
    """The places of a packed block."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << 7 * at, starts))


def _segment_blocks(texts: list[str]) -> tuple[list[str], np.ndarray, list[bytes]]:
    """2-grams of some texts with how many texts hold them and which."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    keys = np.unique((((points[:-1] << np.uint64(21)) | points[1:]) << np.uint64(20) | owner[:-1])[inside])
    if not len(keys):
        return [], np.zeros(0, np.int64), []
    grams, places = keys >> np.uint64(20), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    deltas = np.diff(places, prepend=0)
    deltas[at] = places[at]
    data, widths = pack(deltas)
    cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(widths, at))]).tolist()
    raw = data.tobytes()
    names = [chr(g >> 21) + chr(g & ((1 << 21) - 1)) for g in grams[at].tolist()]
    return names, np.diff(np.append(at, len(keys))), [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def build_bigrams(df: DataFrame, id_col: str, text: str) -> BigramIndex:
    """Index of the distinct 2-grams of each text; texts are cut where they are read, in segments of bounded size."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    numbered = texts.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("segment"), "id", "text")

    def cut(batches):
        for batch in batches:
            own = batch.column(2).to_pylist()
            start = size = 0
            for end in range(1, len(own) + 1):
                size += len(own[end - 1])
                if end < len(own) and size < SEGMENT_CHARS and end - start < SEGMENT_TEXTS:
                    continue
                number = batch.column(0)[start].as_py()  # that of the segment's first row
                names, n, packed = _segment_blocks(own[start:end])
                ids = batch.column(1).slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * (len(names) + 1), pa.int64()), pa.array([*names, None]), pa.array([*n.tolist(), end - start], pa.int32()), pa.array([*packed, None], pa.binary()),
                     pa.concat_arrays([pa.nulls(len(names), pa.list_(ids.type)), pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), ids).cast(pa.list_(ids.type))])],
                    ["segment", "term", "n", "places", "ids"])
                start, size = end, 0

    made = numbered.mapInArrow(cut, f"segment bigint, term string, n int, places binary, ids array<{kind}>")
    staged = _by_term(made, "grams", "segment")
    return BigramIndex(staged.where("term IS NOT NULL").drop("ids"), staged.where("term IS NULL").select("segment", "ids"), texts)


def bigram_candidates(index: BigramIndex, pattern: str) -> DataFrame:
    """(id, text) of the texts that contain ``pattern``: those holding all of its 2-grams, verified.

    Segments without one of the 2-grams go by the heads of their blocks.  In the others the blocks are intersected from
    the rarest on, and the frequent ones stay packed once nothing is left.  A pattern of one character has no 2-gram
    and is looked up by a scan.
    """
    words = sorted({pattern[i:i + 2] for i in range(len(pattern) - 1)})
    if not words:
        return index.texts.where(F.col("text").contains(pattern))
    hits = index.blocks.where(F.col("term").isin(words))
    whole = hits.groupBy("segment").agg(F.collect_list(F.struct("n", "places")).alias("blocks")).where(F.size("blocks") == len(words))
    kind = index.texts.schema["id"].dataType.simpleString()

    def meet(batches):
        for batch in batches:
            keep, found = [], []
            for at, blocks in enumerate(batch.column(0).to_pylist()):
                left = None
                for block in sorted(blocks, key=lambda b: b["n"]):
                    places = unpack(block["places"])
                    left = places if left is None else left[np.isin(left, places, assume_unique=True)]
                    if not len(left):
                        break
                keep += [at] * len(left)
                found += left.tolist()
            ids = batch.column(1)
            spots = pa.array([ids.offsets[a].as_py() + p for a, p in zip(keep, found)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.values.take(spots)], ["id"])

    near = whole.join(index.segments, "segment").select("blocks", "ids").mapInArrow(meet, f"id {kind}")
    # the pattern comes with the ids, so the texts are tested after the join and not in the scan
    full = near.groupBy("id").agg(F.max(F.lit(pattern)).alias("_pattern"))
    return index.texts.join(full, "id").where(F.col("text").contains(F.col("_pattern"))).select("id", "text")
