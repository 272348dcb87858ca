"""Benchmark passages in training text: rare n-gram seeds, then Smith-Waterman alignment over words.

Words are runs of letters, digits and underscores in lower case.  Each item that has enough seeds close together in a
stretch of text is aligned with it locally (match 2, other word or gap -1).  Similarity is the number of matched words
over the words of the item or of the aligned stretch, whichever are more; from 0.8 on the stretch is a copy, which
edits, added or missing words leave above that.

Seeds are pairs of neighbouring words, which a copy need not keep longer runs than: at 0.8 a fifth of the item's words
may be missing and as many others may stand between the rest.  That destroys a bounded number of an item's pairs
(``destroyed``), so its seeds are the rarest of them, that many and up to ``TOGETHER`` more: a copy has as many of
them as were added.  Rarity, counted in all documents and among the items, orders the search and drops no case.  Documents meet a bitmap of the seeds first, whose size has a fixed bound, so only stretches of text around
possible seeds leave their task.

Defined results: null text has no words; an item of one word is its own seed, and an item without words is never
found; an item of more than ``PART`` words counts as its parts; of rows with equal ids the best alignment is kept for
each item; ties prefer more matched words, then the earlier place; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodework.llm.common import blocks, id_and_text
from lodework.llm.pieces import PieceCache
from lodework.session import stage

SEED, SIMILARITY = 2, 0.8
#: Seeds that must stand together, as far as edits are sure to leave so many.
TOGETHER = 3
PART = 4096
#: Bits of the bitmap of seeds: so many for each seed (one n-gram in that many passes by chance), between these bounds.
PER_SEED, BITS = 1 << 12, (1 << 16, 1 << 25)
#: Words after which a stretch is closed.
STRETCH = 1 << 16
WORDS = re.compile(r"\w+")
#: What ``WORDS`` finds in ASCII is what stands between these spaces.
ASCII_WORDS = "".join(chr(c) if WORDS.match(chr(c)) else " " for c in range(128))
#: Characters whose words are hashed together; the more, the fewer of them are distinct.
HASHED = 1 << 22
MATCH, OTHER = 2, -1


def words_of(text: str) -> list[str]:
    text = text.lower()
    return text.translate(ASCII_WORDS).split() if text.isascii() else WORDS.findall(text)


def word_cache() -> PieceCache:
    """Hashes of words that are kept from one call of ``hashes_of`` to the next."""
    return PieceCache(lambda words: list(map(xxhash.xxh64_intdigest, words)))


def keys_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key for each n-gram of word hashes."""
    count = max(len(hashes) - n + 1, 0)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hashes_of(words: list[str], known: PieceCache | None = None) -> np.ndarray:
    """XXH64 of each word; a distinct one is hashed, or looked up in ``known``, once."""
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    found = map(xxhash.xxh64_intdigest, distinct) if known is None else known.values(distinct.tolist())
    return np.fromiter(found, np.uint64, len(distinct))[coded.indices.to_numpy()]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two arrays of word hashes: (score, matched words, start, end) in the second.

    A cell packs its score, matched words and start (earlier is more) into one integer, so the maximum of ways into a
    cell carries the rest along; gaps along a row are a running maximum.
    """
    one, unit, far = 1 << 44, 1 << 22, (1 << 22) - 1
    n = len(text)
    fresh = far - np.arange(n + 1, dtype=np.int64)
    slope = np.arange(n + 1, dtype=np.int64) * one
    row, best = fresh.copy(), (0, 0)
    for word in item:
        new = np.maximum(row + OTHER * one, fresh)
        step = np.where(text == word, MATCH * one + unit, OTHER * one)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        new = np.maximum.accumulate(new + slope) - slope
        row = np.maximum(new, fresh)
        at = int(row.argmax())
        best = max(best, (int(row[at]), -at))
    packed, end = best[0], -best[1]
    return packed >> 44, (packed >> 22) & far, far - (packed & far), end


def similarity(matched: int, item_words: int, span: int) -> float:
    return matched / max(item_words, span, 1)


def destroyed(n: int, size: int, least: float) -> int:
    """Most of the n-grams of an item of ``n`` words that a copy of similarity ``least`` can lack.

    A missing word takes the ``size`` n-grams that it is in, a word put in between those that it stands within.
    """
    matched = max(math.ceil(least * n - 1e-9), 1)
    return size * (n - matched) + ((size - 1) * (int(matched / least + 1e-9) - matched) if size > 1 else 0)


def seed_plan(n: int, least: float) -> tuple[int, int, int]:
    """(words of a seed, seeds that must stand together, seeds to keep) for an item of ``n`` words."""
    size = SEED if least >= 0.5 and n - SEED + 1 > destroyed(n, SEED, least) else 1
    lost = destroyed(n, size, least)
    need = min(n - size + 1 - lost, TOGETHER)
    return size, need, lost + need


def span_of(n: int, least: float) -> int:
    """Words that an alignment with an item of ``n`` words can reach over, with some to spare."""
    return int(max(1.5, 1 / max(least, 1e-9)) * n) + SEED


def test_items(benchmark: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """A row ``number`` for every item part: ``item_id``, ``words`` (joined by spaces), ``n``, the ``keys`` of its
    n-grams in order, the ``size`` of these, and how many to ``keep`` and to ``need`` together."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, len(words), PART):
                    own = words[at : at + PART]
                    size, need, keep = seed_plan(len(own), least)
                    rows.append((number, item_id, " ".join(own), len(own), keys_of(hashes_of(own), size).view(np.int64).tolist(), size, need, keep))
                    number += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["number", "item_id", "words", "n", "keys", "size", "need", "keep"])

    return id_and_text(benchmark, id_col, text_col).mapInArrow(run, "number bigint, item_id bigint, words string, n int, keys array<bigint>, size int, need int, keep int")


def frequencies(docs: DataFrame, items: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """``key`` and ``times`` of n-grams of the items in all documents."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(items.select(F.explode("keys").alias("key")).distinct()))
    shift = shift_of(bitmap.value)

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, HASHED):
                every = hashes_of(list(chain.from_iterable(words_of(t) for t in texts[a:b])))
                keys = np.concatenate([keys_of(every, n) for n in sizes])
                keys, times = np.unique(keys[in_bitmap(bits, keys, shift)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "times"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "key bigint, times bigint").groupBy("key").agg(F.sum("times").alias("times"))


def rare_seeds(items: DataFrame, times: DataFrame) -> DataFrame:
    """``key``, ``number`` of the item part, ``n``, ``size`` and ``need`` of the seeds in use."""
    places = items.select(F.explode("keys").alias("key"), "number", "n", "size", "need", "keep")
    shared = places.groupBy("key").agg(F.count("*").alias("items"))
    order = W.partitionBy("number").orderBy(F.coalesce("times", F.lit(0)), "items", "key")  # at most PART rows
    ranked = places.join(shared, "key").join(times, "key", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= keep").select("key", "number", "n", "size", "need").distinct()


def shift_of(bitmap: np.ndarray) -> np.uint64:
    return np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)


def in_bitmap(bits: np.ndarray, keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    slot = (keys >> shift).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def salt_of(need: int) -> np.uint64:
    """Seeds that need others beside them have bits of their own."""
    return np.uint64(need * 0x9E3779B97F4A7C15 % (1 << 64))


def bitmap_of(seeds: DataFrame) -> np.ndarray:
    """The seeds as bits, put together from one bitmap a task."""
    n = seeds.count()
    bits = min(max(1 << (PER_SEED * n).bit_length(), BITS[0]), BITS[1])
    shift = shift_of(np.zeros(bits >> 3, np.uint8))

    def run(batches):
        for batch in batches:
            places = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> shift).astype(np.int64)
            cells, at = np.unique(places >> 3, return_inverse=True)
            values = np.zeros(len(cells), np.int32)
            np.bitwise_or.at(values, at, (1 << (places & 7)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values)], ["cell", "value"])

    out = np.zeros(bits >> 3, np.uint8)
    rows = seeds.select("key").mapInArrow(run, "cell bigint, value int").groupBy("cell").agg(F.bit_or("value").alias("value"))
    for cell, value in rows.toPandas().itertuples(index=False):  # at most a row for each byte of the bitmap
        out[cell] = value
    return out


def together(places: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Which of the sorted places are among ``need`` that lie within ``reach``."""
    out = np.zeros(len(places), bool)
    count = len(places) - need + 1
    if count > 0:
        near = places[need - 1 :] - places[:count] <= reach
        for k in range(need):
            out[k : k + count] |= near
    return out


def stretches(docs: DataFrame, bitmap: np.ndarray, groups: list[tuple[int, int, int]], reach: int, id_col: str, text_col: str) -> DataFrame:
    """Parts of the texts around n-grams in the bitmap: ``rid``, ``doc_id``, ``first`` (word number), ``words``, and of
    each such n-gram its ``keys`` and place in the part, ``at``.  A group of seeds is (size, need, reach)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    shift = shift_of(bitmap)
    kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "first": pa.int64(), "words": pa.string(), "keys": pa.list_(pa.int64()), "at": pa.list_(pa.int32())}

    def run(batches):
        bits, number = shared.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts, HASHED):
                cut = [words_of(t) for t in texts[a:b]]
                every = hashes_of(list(chain.from_iterable(cut)))
                ends = np.cumsum([len(w) for w in cut])
                places, found = [], []
                for n, need, near in groups:
                    keys = keys_of(every, n)
                    hit = np.flatnonzero(in_bitmap(bits, keys ^ salt_of(need), shift))
                    doc = np.searchsorted(ends, hit, side="right")
                    inside = hit + n <= ends[doc]  # not across two texts
                    hit, doc = hit[inside], doc[inside]
                    hit = hit[together(hit + doc * near, need, near)]  # texts stand apart
                    places.append(hit)
                    found.append(keys[hit])
                places, found = np.concatenate(places), np.concatenate(found).view(np.int64)
                order = np.lexsort((found, places))
                places, found = places[order], found[order]
                new = np.ones(len(places), bool)
                new[1:] = (np.diff(places) != 0) | (found[1:] != found[:-1])
                places, found = places[new], found[new]
                doc = np.searchsorted(ends, places, side="right")
                rows = []
                k = 0
                while k < len(places):
                    e = k + 1
                    while e < len(places) and doc[e] == doc[k] and places[e] - places[e - 1] <= reach and places[e] - places[k] <= STRETCH:
                        e += 1
                    start = int(ends[doc[k]]) - len(cut[doc[k]])
                    lo, hi = max(int(places[k]) - reach, start), min(int(places[e - 1]) + SEED + reach, int(ends[doc[k]]))
                    rows.append((number, ids[a + doc[k]], lo - start, " ".join(cut[doc[k]][lo - start : hi - start]), found[k:e].tolist(), (places[k:e] - lo).tolist()))
                    number += 1
                    if e < len(places) and doc[e] == doc[k] and places[e] - places[e - 1] <= reach:
                        k = max(int(np.searchsorted(places, places[e] - reach)), k + 1)  # what a copy over the cut needs is in the next
                    else:
                        k = e
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "rid bigint, doc_id bigint, first bigint, words string, keys array<bigint>, at array<int>")


RESULT = "doc_id bigint, item_id bigint, similarity double, score int, matched int, start bigint, end bigint"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and test item that it has a copy of, with the best alignment: similarity, score, matched
    words and the place in the document (numbers of words, end exclusive)."""
    items = stage(test_items(benchmark, item_col, item_text_col, least), "leak-items")
    groups = items.groupBy("size", "need").agg(F.max("n").alias("most")).collect()  # at most 2 sizes times TOGETHER
    sizes = sorted({g.size for g in groups}) or [SEED]
    seeds = stage(rare_seeds(items, frequencies(docs, items, sizes, id_col, text_col)), "leak-seeds")
    salts = F.array(*[F.lit(int(salt_of(k).view(np.int64))) for k in range(TOGETHER + 1)])
    bitmap = bitmap_of(seeds.select(F.col("key").bitwiseXOR(salts[F.col("need")]).alias("key")).distinct())
    reach = span_of(max((g.most for g in groups), default=0), least)
    wanted = [(g.size, g.need, span_of(g.most, least)) for g in groups] or [(SEED, 1, reach)]
    parts = stage(stretches(docs, bitmap, wanted, reach, id_col, text_col), "leak-stretches")
    hits = parts.select("rid", F.explode(F.arrays_zip("keys", "at")).alias("hit")).select("rid", F.col("hit.keys").alias("key"), F.col("hit.at").alias("at"))
    near = F.exists(F.zip_with("at", F.slice("at", F.col("need"), F.size("at")), lambda a, b: F.coalesce(b - a <= F.col("reach"), F.lit(False))), lambda x: x)
    spans = seeds.select("key", "number", "need", (F.col("n") * max(1.5, 1 / max(least, 1e-9)) + SEED).cast("int").alias("reach"))
    pairs = hits.join(spans, "key").groupBy("rid", "number").agg(F.array_sort(F.collect_list("at")).alias("at"), F.first("need").alias("need"), F.first("reach").alias("reach"))
    pairs = pairs.where(near).select("rid", "number", F.col("at")[0].alias("lo"), F.element_at("at", -1).alias("hi"))
    joined = pairs.join(items.select("number", "item_id", "n", F.col("words").alias("item")), "number")
    ready = joined.join(parts.select("rid", "doc_id", "first", "words"), "rid").select("doc_id", "item_id", "n", "item", "lo", "hi", "first", "words")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                item, words = r["item"].split(" "), r["words"].split(" ")
                margin = span_of(r["n"], least)
                lo = max(r["lo"] - margin, 0)
                words = words[lo : r["hi"] + margin + SEED]
                number: dict[str, int] = {}
                a = np.array([number.setdefault(w, len(number)) for w in item])
                b = np.array([number.get(w, -1) for w in words])
                score, matched, start, end = align(a, b)
                close = similarity(matched, r["n"], end - start)
                if close >= least:
                    rows.append((r["doc_id"], r["item_id"], close, score, matched, r["first"] + lo + start, r["first"] + lo + end))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])

    found = ready.mapInArrow(run, RESULT)
    best = F.max(F.struct("similarity", "matched", "score", (-F.col("start")).alias("early"), "end")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.similarity").alias("similarity"), F.col("b.score").alias("score"), F.col("b.matched").alias("matched"),
        (-F.col("b.early")).alias("start"), F.col("b.end").alias("end"))
