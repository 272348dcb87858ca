"""Phrases whose words stand together more often than apart, from count streams in prefix and in suffix order.

One stream holds every start of a word with the two words after it.  It is dealt out by ranges of (lang, first, second,
third word) and sorted, so a task reads its part of the corpus in prefix order: counts of three words are complete there,
and those of two words and of one are sums over neighbours in the stream.  Only a prefix that crosses the border of a
range needs a second sum, so rare phrases end in the task that counts them, and a frequent word is no single task's.
What is left, the counts from ``least`` on, is kept once in prefix order and once in suffix order.  Sort-merge joins read
them side by side: the prefix order gives the counts of first parts and of extensions to the right, the suffix order
those of last parts and of extensions to the left.  Every part of a phrase is at least as frequent as the phrase, so
nothing that a candidate asks for has been left out.

Words go into the stream as counts per block of text, so a phrase that fills the corpus is one row a block.

Defined results: null text has no words; a null lang is ``und``; a repeated row counts again, whatever its id; ties of
score and count go by the bytes of the phrase; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import blocks, whole_text
from lodework.operators.ordered import topk
from lodework.session import stage

#: Characters that end a piece, and those that end a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Longest phrase, in words.
LONGEST = 3
#: Documents and phrases looked at to choose the borders of the ranges; what they hold decides no count.
SAMPLE_DOCS, SAMPLE_KEYS = 2048, 1 << 15
#: Starts of words meant for one range, and a rough number of bytes per word.
RANGE_ROWS, WORD_BYTES = 1 << 20, 6
#: Characters of a block of texts of one language.
BLOCK = 1 << 22

PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + WORD_ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(WORD_ENDS))
GRAMS = "lang string, w1 string, w2 string, w3 string, n bigint"


def word_stream(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of some texts and the stream of their numbers; 0 stands between pieces."""
    joined = b"\n".join(texts).translate(PLAIN).replace(b"\n", b" \n ")
    known = {b"\n": 0}
    stream = np.fromiter((known.setdefault(w, len(known)) for w in joined.split(b" ") if w), np.int64)
    return list(known), stream


def starts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, rows (first, second, third word's number; 0: the piece has ended) and how often each row occurs."""
    words, stream = word_stream(texts)
    padded = np.concatenate([stream, np.zeros(2, np.int64)])
    first, second, third = padded[:-2], padded[1:-1], padded[2:]
    third = np.where(second == 0, 0, third)
    rows = np.stack([first, second, third], axis=1)[first > 0]
    if not len(rows):
        return words, np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    # the numbers of a block's words fit into 21 bits: a block of 4 million characters has at most 2 million words
    if len(words) < 1 << 21:
        keys, counts = np.unique((rows[:, 0] << 42) | (rows[:, 1] << 21) | rows[:, 2], return_counts=True)
        return words, np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1), counts
    kept, counts = np.unique(rows, axis=0, return_counts=True)
    return words, kept, counts


def _texts_by_lang(batch: pa.RecordBatch):
    """(lang, texts) of one Arrow batch, in blocks of bounded size."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
    for lang in dict.fromkeys(langs):
        own = [t for name, t in zip(langs, texts) if name == lang and t]
        for a, b in blocks(own, BLOCK):
            yield lang, own[a:b]


def _key(lang: str, words: list[bytes], row) -> tuple:
    return (lang.encode(), *(words[i] if i else b"" for i in row))


def borders(texts: DataFrame) -> list[tuple]:
    """Keys that cut the stream into even ranges of about ``RANGE_ROWS`` rows, from a sample of the documents.

    They decide how the work is dealt out and nothing else.  At most ``SAMPLE_KEYS`` keys come to the driver.
    """
    docs, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = -(-size // (WORD_BYTES * RANGE_ROWS))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE_DOCS / docs)
    step = max(1, int(size * share / WORD_BYTES) // SAMPLE_KEYS)

    def run(batches):
        for batch in batches:
            for lang, own in _texts_by_lang(batch):
                words, rows, _ = starts(own)
                keys = [_key(lang, words, r) for r in rows[len(rows) % step :: step].tolist()]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.binary()) for i in range(4)), pa.array([zlib.crc32(b"\0".join(k)) for k in keys], pa.int64())], ["lang", "w1", "w2", "w3", "turn"])

    found = texts.sample(share, 7).mapInArrow(run, "lang binary, w1 binary, w2 binary, w3 binary, turn bigint").orderBy("turn").limit(SAMPLE_KEYS)
    keys = sorted(tuple(bytes(k) for k in row[:4]) for row in found.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def stream_of_starts(texts: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Counted starts per block of text with the number of their range."""
    by_lang: dict[bytes, list[tuple]] = {}
    for cut in cuts:
        by_lang.setdefault(cut[0], []).append(cut[1:])
    below = {lang: sum(1 for c in cuts if c[0] < lang) for lang in by_lang}

    def place(lang: bytes, words: list[bytes], rows: np.ndarray) -> np.ndarray:
        own = by_lang.get(lang)
        if not own:
            return np.full(len(rows), sum(1 for c in cuts if c[0] < lang), np.int32)
        # most rows are placed by their first word alone; where a border shares it, by the whole key
        firsts = {c[0] for c in own}
        place_of = np.array([bisect_right(own, (w,)) for w in words], np.int32)
        out = place_of[rows[:, 0]] if len(rows) else np.zeros(0, np.int32)
        split = np.array([w in firsts for w in words], bool)
        for at in np.flatnonzero(split[rows[:, 0]]):
            out[at] = bisect_right(own, tuple(words[i] if i else b"" for i in rows[at].tolist()))
        return out + below[lang]

    def run(batches):
        for batch in batches:
            for lang, own in _texts_by_lang(batch):
                words, rows, counts = starts(own)
                if not len(rows):
                    continue
                part = place(lang.encode(), words, rows)
                names = pa.array(words, pa.binary()).cast(pa.string())
                for at in range(0, len(rows), 1 << 16):
                    some = rows[at : at + (1 << 16)]
                    column = lambda i: names.take(pa.array(some[:, i], mask=some[:, i] == 0) if i else pa.array(some[:, i]))  # noqa: B023,E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[at : at + (1 << 16)]), pa.array([lang]).take(pa.array(np.zeros(len(some), np.int64))), column(0), column(1), column(2),
                         pa.array(counts[at : at + (1 << 16)])], ["part", "lang", "w1", "w2", "w3", "n"])

    return texts.mapInArrow(run, f"part int, {GRAMS}")


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column's value differs from the one before; the first row always does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


class Held:
    """Running sums of the prefixes of a sorted stream; the last prefix of each length waits for the next batch."""

    def __init__(self, least: int):
        self.least = least
        self.open: list[tuple | None] = [None] * (LONGEST + 1)  # (prefix, count, first of the range)

    def take(self, table: pa.Table) -> list[pa.Table]:
        columns = [table.column(i).combine_chunks() for i in range(5)]
        n = columns[4].to_numpy()
        change, out = np.zeros(len(n), bool), []
        for size in range(LONGEST + 1):
            change = change | _changes(columns[size])
            at = np.flatnonzero(change)
            sums = np.add.reduceat(n, at)
            head = tuple(c[0].as_py() for c in columns[: size + 1])
            done: list[tuple] = []
            first = self.open[size] is None
            if self.open[size] is not None:
                prefix, count, border = self.open[size]
                if prefix == head:
                    sums[0] += count
                    first = border
                else:
                    done.append((prefix, count, border))
            tail = tuple(c[int(at[-1])].as_py() for c in columns[: size + 1])
            self.open[size] = (tail, int(sums[-1]), first and len(at) == 1)
            keep = (sums[:-1] >= self.least) | (size == 0)
            if len(keep) and first and size < LONGEST:
                keep[0] = True
            if size:  # where the piece has ended there is no phrase of that length
                keep &= columns[size].is_valid().to_numpy(zero_copy_only=False)[at[:-1]]
            rows = pa.array(at[:-1][keep])
            nothing = pa.nulls(len(rows), pa.string())
            given = pa.table([columns[i].take(rows) if i <= size else nothing for i in range(4)] + [pa.array(sums[:-1][keep])], names=["lang", "w1", "w2", "w3", "n"])
            out.append(pa.concat_tables([self._table(size, done, False), given]))
        return out

    def finish(self) -> list[pa.Table]:
        return [self._table(size, [self.open[size]], True) for size in range(LONGEST + 1)]

    def _table(self, size: int, rows: list[tuple], last: bool) -> pa.Table:
        kept = [(p, c) for p, c, border in rows
                if (size == 0 or p[size] is not None) and (c >= self.least or size == 0 or (size < LONGEST and (border or last)))]
        columns = [pa.array([p[i] if i <= size else None for p, _ in kept], pa.string()) for i in range(4)]
        return pa.table([*columns, pa.array([c for _, c in kept], pa.int64())], names=["lang", "w1", "w2", "w3", "n"])


def counted(least: int):
    """Reads a range in prefix order and gives (size, lang, words, n): counts of up to three words, and of all words of a lang.

    A prefix inside the range is complete and given from ``least`` on; the first and the last one of each length may
    go on in another range and are given whatever their count.
    """

    def run(batches):
        held = Held(least)
        for batch in batches:
            if batch.num_rows:
                yield from _sized(held.take(pa.Table.from_batches([batch])))
        yield from _sized(held.finish())

    return run


def _sized(tables: list[pa.Table]):
    for size, table in enumerate(tables):
        for batch in table.combine_chunks().to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, size, np.int32)), *batch.columns], ["size", *batch.schema.names])


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10) -> DataFrame:
    """``size``, ``lang``, ``w1``, ``w2``, ``w3``, ``n``: phrases of one to three words that occur ``least`` times or more in a
    language; size 0 holds the number of all its words."""
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), whole_text(docs, text_col).alias("text"))
    cuts = borders(texts)
    ranged = stream_of_starts(texts, cuts).repartitionById(len(cuts) + 1, F.col("part"))
    # in prefix order within each range
    parts = ranged.select("lang", "w1", "w2", "w3", "n").sortWithinPartitions("lang", "w1", "w2", "w3").mapInArrow(counted(least), f"size int, {GRAMS}")
    keys = ["size", "lang", "w1", "w2", "w3"]
    return stage(stage(parts, "phrase-parts").groupBy(*keys).agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0)), "phrase-counts")


def _along(stream: DataFrame) -> DataFrame:
    """Phrases of two and three words with the counts of their first one (``one``) and two (``two``) words in the order of the
    stream, and for two words the count of their most frequent extension (``ext``).  All joins merge sorted streams."""
    one = stream.where("size = 1").select("lang", "k1", F.col("n").alias("one"))
    two = stream.where("size = 2").select("lang", "k1", "k2", F.col("n").alias("two"))
    three = stream.where("size = 3").select("size", "lang", "k1", "k2", "k3", "n")
    ext = three.groupBy("lang", "k1", "k2").agg(F.max("n").alias("ext"))
    pairs = (two.hint("merge").join(ext.hint("merge"), ["lang", "k1", "k2"], "left")
             .select(F.lit(2).alias("size"), "lang", "k1", "k2", F.lit("").alias("k3"), F.col("two").alias("n"), "two", "ext"))
    triples = (three.hint("merge").join(two.hint("merge"), ["lang", "k1", "k2"])
               .select("size", "lang", "k1", "k2", "k3", "n", "two", F.lit(None).cast("bigint").alias("ext")))
    return pairs.unionByName(triples).hint("merge").join(one.hint("merge"), ["lang", "k1"])


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of two or three words of each language.

    ``a`` is the count of the phrase, ``l`` and ``r`` are those of the two parts of its weakest cut and ``score`` is
    floor(1000000 a a / (l r)) of it.  A phrase of two words goes if an extension of it has ``covered`` percent of its count.
    """
    counts = phrase_counts(docs, lang_col, text_col, least)
    words = counts.where("size > 0")
    prefix = _along(words.select("size", "lang", F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.coalesce("w3", F.lit("")).alias("k3"), "n"))
    k1 = F.when(F.col("size") == 3, F.col("w3")).when(F.col("size") == 2, F.col("w2")).otherwise(F.col("w1"))
    k2 = F.when(F.col("size") == 3, F.col("w2")).when(F.col("size") == 2, F.col("w1"))
    suffix = _along(words.select("size", "lang", k1.alias("k1"), k2.alias("k2"), F.when(F.col("size") == 3, F.col("w1")).otherwise("").alias("k3"), "n"))
    is_pair = F.col("size") == 2
    left = prefix.select("size", "lang", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("k3").alias("w3"), F.col("n").alias("a"),
                         F.col("one").alias("l1"), F.col("two").alias("l2"), F.col("ext").alias("to_right"))
    right = suffix.select("size", "lang", F.when(is_pair, F.col("k2")).otherwise(F.col("k3")).alias("w1"), F.when(is_pair, F.col("k1")).otherwise(F.col("k2")).alias("w2"),
                          F.when(is_pair, "").otherwise(F.col("k1")).alias("w3"), F.col("one").alias("r1"), F.col("two").alias("r2"), F.col("ext").alias("to_left"))
    both = left.hint("merge").join(right.hint("merge"), ["size", "lang", "w1", "w2", "w3"])
    longer = F.greatest(F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0)))
    kept = both.where(~is_pair | (100 * longer < covered * F.col("a")))

    def score(l: str, r: str):  # noqa: E741
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        return F.call_function("div", (F.lit(1000000).cast("decimal(7,0)") * wide("a") * wide("a")).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))

    # cut after one word, or after two
    cut = kept.withColumn("s1", F.when(is_pair, score("l1", "r1")).otherwise(score("l1", "r2"))).withColumn("s2", F.when(~is_pair, score("l2", "r1")))
    first = is_pair | (F.col("s1") <= F.col("s2"))
    scored = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", F.nullif("w3", F.lit(""))).alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(is_pair, F.col("r1")).when(first, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.when(first, F.col("s1")).otherwise(F.col("s2")).alias("score"))
    best = topk(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    totals = counts.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
