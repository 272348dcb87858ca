"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pattern is merged on its own.  Its symbols form a linked list; a bucket per merge rank holds the
places where that merge can happen; a bitmap over the ranks, with a bitmap over its words above it, gives
the lowest rank by find-first-set.  An entry whose pair has changed since is stale and skipped.  A pre-token of n
bytes costs O(n log n) at worst, however long it is.

Defined results: null text is the empty text, which has no ids and decodes to no bytes; repeated rows give equal
rows; ids are looked up by bytes, so any text can be encoded; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodework.llm.common import blocks, id_and_text, worker_store
from lodework.llm.pieces import SpacedEncoder

WORD = 8  # a bitmap word has 2 ** WORD bits
LOW = (1 << WORD) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a ``.tiktoken`` file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Merger:
    """Merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [bytes([b]) for b in range(256)]
        self.leaves = [0] * ((max(ranks.values(), default=0) >> WORD) + 1)  # all zero between calls

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the whole if it is a token, else by merging the lowest rank, leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks, leaves, buckets, top = self.ranks.get, self.leaves, {}, 0
        n = len(piece)
        parts: list[bytes | None] = [self.bytes[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank that each place waits for; an entry of the place under another rank is stale
        waits: list[int | None] = [ranks(piece[i : i + 2]) for i in range(n - 1)]
        waits.append(None)
        for i, rank in enumerate(waits):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # places ascend, so the list is a heap
                else:
                    buckets[rank] = [i]
                    leaves[rank >> WORD] |= 1 << (rank & LOW)
                    top |= 1 << (rank >> WORD)
        while top:
            first = top & -top
            leaf = first.bit_length() - 1
            bits = leaves[leaf]
            rank = leaf << WORD | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                leaves[leaf] = bits = bits & (bits - 1)
                if not bits:
                    top ^= first
            if waits[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            parts[i] = merged = parts[i] + parts[j]
            parts[j] = waits[j] = waits[i] = None
            if k < n:
                before[k] = i
                rank = ranks(merged + parts[k])
                if rank is not None:
                    waits[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        leaf = rank >> WORD
                        leaves[leaf] |= 1 << (rank & LOW)
                        top |= 1 << leaf
            h = before[i]
            if h >= 0:
                rank = ranks(parts[h] + merged)
                if rank != waits[h]:
                    waits[h] = rank
                    if rank is not None:
                        if rank in buckets:
                            heappush(buckets[rank], h)
                        else:
                            buckets[rank] = [h]
                            leaf = rank >> WORD
                            leaves[leaf] |= 1 << (rank & LOW)
                            top |= 1 << leaf
        return [self.ranks[p] for p in parts if p is not None]


class ByteCodec:
    """Texts to ids and back, with what a worker has merged before kept by piece of text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.merger = Merger(ranks)
        self.width = 2 if max(ranks.values(), default=0) < 1 << 16 else 4
        self.tokens = {i: t for t, i in ranks.items()}
        self.encoder = SpacedEncoder(self.many)

    def many(self, chunks: list[str]) -> list[bytes]:
        return [b"".join(map(self.pack, self.find(chunk))) for chunk in chunks]

    def pack(self, match: str) -> bytes:
        width = self.width
        return b"".join([i.to_bytes(width, "little") for i in self.merger.merge(match.encode("utf-8", "surrogatepass"))])

    def encode(self, texts: list[str]) -> list[memoryview]:
        return [memoryview(packed).cast("H" if self.width == 2 else "I") for packed in self.encoder.encode(texts)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, round_trip boolean"


def _share(df: DataFrame, vocab_path: str, pattern: str):
    """The vocabulary and pattern for the workers, with a name for what they make of them."""
    ranks = read_ranks(vocab_path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((ranks, pattern, name))


def _codec(shared) -> ByteCodec:
    ranks, pattern, name = shared.value
    return worker_store(f"byte codec {name}", lambda: ByteCodec(ranks, pattern))


def encode_texts(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ids as ``array<int>``; ``decode_ids`` is its inverse."""
    shared = _share(docs, vocab_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                packed = [list(x) for x in codec.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(packed, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document with its bytes decoded, as text where they are UTF-8 (else null) and as binary."""
    shared = _share(encoded, vocab_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            found = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            texts = []
            for raw in found:
                try:
                    texts.append(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.binary())], ["doc_id", "text", "bytes"])

    return encoded.select(encoded[id_col].cast("bigint").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id bigint, text string, bytes binary")


def round_trip(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass, keeping digests: ids as little-endian unsigned 32-bit integers,
    decoded bytes, and whether these are the text's own; with ``keep_ids`` the ids too, as ``array<int>``."""
    shared = _share(docs, vocab_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                encoded = [np.asarray(x) for x in codec.encode(texts[a:b])]
                n, digests, decoded, sizes, same = [], [], [], [], []
                for text, found in zip(texts[a:b], encoded, strict=True):
                    raw, own = codec.decode(found.tolist()), text.encode("utf-8", "surrogatepass")
                    n.append(len(found))
                    digests.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
                    sizes.append(len(own))
                    same.append(raw == own)
                columns = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()),
                           pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), np.concatenate(encoded).astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RESULT + ", ids array<int>" * keep_ids)
