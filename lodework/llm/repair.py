"""Token ids in files, by Re-Pair grammar compression.

Documents are range-partitioned and sorted by id, so files follow that order.  A task cuts its documents into shards
of bounded size.  In each shard, pairs of neighbouring ids that are frequent are replaced by nonterminals, round by
round; no pair crosses the end of a document.  A shard is one row of a Parquet table:

* ``doc_ids`` (signed 64-bit), ``doc_sizes`` (ids of each document) and ``doc_symbols`` (symbols of each), 32-bit,
* ``rules``: pairs of symbols, 32-bit; the first rule is symbol ``terminals``, the next follow,
* ``lengths``: ids that each rule expands to, 32-bit,
* ``symbols``: 16-bit if all fit, else 32-bit (``wide``),
* ``base``: ids of the task's documents before the shard.

With the lengths, one document or one position is decoded without the others (``read_at``).  All integers are
little-endian.  The ids that precede a task's first document are the sums of one number per task.

Defined results: null text is the empty text and gives the end id alone; rows of equal id follow each other, ordered
by text, a null id first; equal rows are written twice; a document larger than a shard is one shard; an empty table
writes no shard and reads as no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodework.llm.common import blocks, id_and_text, worker_store
from lodework.llm.pieces import SpacedEncoder
from lodework.session import scratch_path

#: Ids after which a shard is closed: its arrays stay in a core's cache.
SHARD = 1 << 18
#: Rounds of replacement; a pair must occur once in so many ids of the shard.
ROUNDS, RARITY = 4, 4096
#: Characters that are encoded together; the more, the fewer of their pieces are distinct.
TOGETHER = 1 << 23
#: A piece that opens with its only white space.
OPENED = re.compile(r"[ \n]\S+").fullmatch
HASHED = 1 << 16  # 2 ** 32 >> 16: the shift below

SHARDS = ("task int, shard int, base bigint, n_docs int, n_ids bigint, wide boolean, terminals int, doc_ids binary, "
          "doc_sizes binary, doc_symbols binary, rules binary, lengths binary, symbols binary")


def replace_pairs(ids: np.ndarray, last: np.ndarray, first: int, rounds: int = ROUNDS, rarity: int = RARITY):
    """Symbols, their ``last`` flags and the rules of one shard.

    ``last`` marks the final id of each document.  Symbols from ``first`` on are rules.  A round counts neighbouring
    pairs by hash, takes for each frequent hash value a pair that has it, counts these exactly, and replaces their
    occurrences from left to right, the overlapping ones alternately.
    """
    ids, last, rules = ids.astype(np.uint32), last.astype(bool), [np.zeros((0, 2), np.uint32)]
    for _ in range(rounds):
        if len(ids) < 4:
            break
        left, right = ids[:-1], ids[1:]
        slot = left * np.uint32(0x9E3779B1)
        slot ^= right * np.uint32(0x85EBCA6B)
        slot >>= np.uint32(16)
        slot = slot.astype(np.intp)  # once, for all that follows
        least = max(4, len(ids) // rarity)
        tally = np.bincount(slot, minlength=HASHED)
        often = (tally >= least)[slot]
        often &= ~last[:-1]
        where = np.flatnonzero(often)
        if not len(where):
            break
        sample = np.full(HASHED, -1, np.int64)
        slot = slot[where]
        sample[slot] = where
        mine = sample[slot]
        same = (left[where] == left[mine]) & (right[where] == right[mine])
        where, slot = where[same], slot[same]
        exact = np.bincount(slot, minlength=HASHED)
        number = np.full(HASHED, -1, np.int64)
        frequent = np.flatnonzero(exact >= least)
        if not len(frequent):
            break
        number[frequent] = np.arange(len(frequent))
        symbol = number[slot]
        where, symbol = where[symbol >= 0], symbol[symbol >= 0]
        starts = np.ones(len(where), bool)
        starts[1:] = np.diff(where) != 1
        run = np.maximum.accumulate(np.where(starts, where, 0))
        even = (where - run) & 1 == 0
        where, symbol = where[even], symbol[even]
        at = sample[frequent]
        rules.append(np.stack([left[at], right[at]], axis=1))  # before the ids that these are views of change
        ids[where] = (symbol + first).astype(np.uint32)
        first += len(frequent)
        last[where] = last[where + 1]
        stay = np.ones(len(ids), bool)
        stay[where + 1] = False
        ids, last = ids[stay], last[stay]
    return ids, last, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1))
    return np.array(out, np.uint32)


def _repeats(n: int, places: np.ndarray, each: np.ndarray) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[places] = each
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that symbols stand for."""
    ends: list[bytes] = []
    for a, b in rules.tolist():
        ends.append((ends[a - terminals] if a >= terminals else a.to_bytes(4, "little")) + (ends[b - terminals] if b >= terminals else b.to_bytes(4, "little")))
    flat, sizes = np.frombuffer(b"".join(ends), "<u4"), lengths.astype(np.int64)
    # terminals stand for themselves: only the others are looked up
    places = np.flatnonzero(symbols >= terminals)
    ruled = symbols[places].astype(np.int64) - terminals
    each = sizes[ruled]
    out = np.repeat(symbols.astype(np.uint32), _repeats(len(symbols), places, each))
    grown = np.cumsum(each) - each
    starts = places + grown - np.arange(len(places))
    within = np.arange(int(each.sum())) - np.repeat(grown, each)
    out[np.repeat(starts, each) + within] = flat[np.repeat((np.cumsum(sizes) - sizes)[ruled], each) + within]
    return out


def pack_shard(doc_ids: list, packed: list[bytes], width: str, terminals: int) -> dict:
    """A row's fields for documents given as their ids' bytes."""
    ids = np.frombuffer(b"".join(packed), width)
    sizes = np.array([len(p) for p in packed], np.int64) // np.dtype(width).itemsize
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules = replace_pairs(ids, last, terminals)
    where = np.flatnonzero(ends)
    wide = terminals + len(rules) > 1 << 16
    null = np.iinfo(np.int64).min
    return {
        "n_docs": len(doc_ids), "n_ids": len(ids), "wide": wide, "terminals": terminals,
        "doc_ids": np.array([null if d is None else d for d in doc_ids], "<i8").tobytes(), "doc_sizes": sizes.astype("<u4").tobytes(),
        "doc_symbols": np.diff(where, prepend=-1).astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(),
        "lengths": rule_lengths(rules, terminals).astype("<u4").tobytes(), "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
    }


def unpack_rules(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"))


def read_at(row: dict, position: int, count: int) -> np.ndarray:
    """``count`` ids from ``position`` on of a shard, expanding only the symbols that hold them."""
    symbols, rules, lengths = unpack_rules(row)
    each = np.ones(len(symbols), np.int64)
    ruled = symbols >= row["terminals"]
    each[ruled] = lengths[symbols[ruled].astype(np.int64) - row["terminals"]]
    ends = np.cumsum(each)
    a, b = np.searchsorted(ends, [position, position + count - 1], side="right")
    if count < 1:
        return np.zeros(0, np.uint32)
    start = int(ends[a] - each[a])
    return expand(symbols[a : b + 1], rules, lengths, row["terminals"])[position - start : position - start + count]


class Spelling:
    """Ids of pieces of text by the tokenizer, packed.

    Pieces that open with their only white space are encoded many at a time, as one text: no match of the byte-level
    pattern reaches over such a border, so each piece's ids are those from one token that opens so to the next.
    """

    TOGETHER = 512

    def __init__(self, tokenizer: Tokenizer, width: str):
        self.tokenizer, self.width = tokenizer, width
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        # fixed value: a space and a line feed as the byte-level alphabet writes them
        self.opens[[i for token, i in vocab.items() if token[0] in "\u0120\u010a"]] = True

    def single(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for a, b in blocks(pieces) for e in self.tokenizer.encode_batch_fast(pieces[a:b], add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, self.width)
        at = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * ids.itemsize
        if len(at) != len(pieces) + 1:
            return self.single(pieces)
        packed, at = ids.tobytes(), at.tolist()
        return [packed[a:b] for a, b in zip(at, at[1:])]

    def many(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        plain = [OPENED(p) is not None for p in pieces]
        for way, size, of in ((self.joined, self.TOGETHER, True), (self.single, max(len(pieces), 1), False)):
            places = [i for i, x in enumerate(plain) if x == of]
            for at in range(0, len(places), size):
                some = places[at : at + size]
                for i, ids in zip(some, way([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out


def write_ids(docs: DataFrame, vocab_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the shards as a Parquet table at ``path``."""
    with open(vocab_path, encoding="utf-8") as f:
        config = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(config)
    terminals = max(Tokenizer.from_str(config).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if terminals <= 1 << 16 else "<u4"

    def encoder() -> SpacedEncoder:
        tokenizer = Tokenizer.from_str(shared.value)
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        return SpacedEncoder(Spelling(tokenizer, width).many, whole=special)

    def run(batches):
        known, end = worker_store(f"ids {hash(config)}", encoder), np.array([end_id], width).tobytes()
        task, shard, base, doc_ids, packed, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close():
            row = {"task": task, "shard": shard, "base": base} | pack_shard(doc_ids, packed, width, terminals)
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA), row["n_ids"]

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts, TOGETHER):
                for doc_id, found in zip(ids[a:b], known.encode(texts[a:b]), strict=True):
                    size = len(found) // len(end) + 1
                    if doc_ids and held + size > SHARD:
                        row, n = close()
                        yield row
                        shard, base, doc_ids, packed, held = shard + 1, base + n, [], [], 0
                    doc_ids.append(doc_id)
                    packed.append(found + end)
                    held += size
        if doc_ids:
            yield close()[0]

    SCHEMA = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in SHARDS.split(", "))])
    texts = id_and_text(docs, id_col, text_col)
    ordered = texts.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str, result: str, describe) -> DataFrame:
    """Read the shards at ``path``: ``describe(ids)`` gives, for a document's ids, the values of the columns ``result``
    beside ``doc_id``, ``start`` (ids of all documents before it) and ``n_tokens``."""
    names = ["doc_id", "task", "local", "n_tokens", *(x.split()[0] for x in result.split(", "))]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths = unpack_rules(row)
                ids = expand(symbols, rules, lengths, row["terminals"])
                sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                found = [describe(ids[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                columns = [pa.array(doc_ids, mask=doc_ids == np.iinfo(np.int64).min), pa.array(np.full(len(sizes), row["task"], np.int32)),
                           pa.array(starts + row["base"]), pa.array(sizes), *(pa.array(list(c)) for c in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    shards = spark.read.parquet(path)
    per_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    # one row per task that wrote: the window and the broadcast are as small as that
    before = per_task.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("before"))
    docs = shards.mapInArrow(run, f"doc_id bigint, task int, local bigint, n_tokens bigint, {result}")
    return docs.join(F.broadcast(before), "task").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", *names[4:])


def token_files(docs: DataFrame, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids below the shared folder, then read each document's place, size and checksum from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, vocab_path, path, end_id, id_col, text_col)
    return read_ids(spark, path, "ids_crc32 bigint", lambda ids: (zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()),))
