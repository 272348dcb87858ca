"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths (in tokens) of frequent pre-tokens, the same on every worker and of a
fixed number of entries.  Each task of a first pass over all texts counts its pre-tokens in bounded memory and emits
its heaviest; the sums of these few name the table.  Tier two is a worker's cache of bounded size, which encodes what
it misses with the tokenizer in batches.  The tiers decide speed only: every length is the tokenizer's own.
Pre-tokens are never shuffled.

Defined results: null text is the empty text (0 bytes, 0 tokens, not over the limit); equal rows give equal rows;
a text of any length is counted whole; special strings inside texts count as the tokenizer's default has them; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodework.llm.common import blocks, id_and_text, worker_store
from lodework.llm.pieces import GENERATION, ODD_SPACES, PieceCache

#: Entries of tier one; at most a few MB.
FREQUENT = 1 << 16
#: Pre-tokens that a task of the first pass counts at a time and emits in the end.
COUNTED, EMITTED = 1 << 18, 1 << 14


def words_of(text: str) -> list[str]:
    """Pieces that the tokenizer's split never joins: what stands between white space."""
    return [text] if ODD_SPACES.search(text) else text.split()


def _tokenizer(shared) -> Tokenizer:
    config = shared.value
    return worker_store(f"tokenizer {hash(config)}", lambda: Tokenizer.from_str(config))


def lengths(tokenizer: Tokenizer, pieces: list[str]) -> list[int]:
    return [len(e.ids) for a, b in blocks(pieces) for e in tokenizer.encode_batch_fast(pieces[a:b], add_special_tokens=False)]


def frequent_lengths(texts: DataFrame, shared, entries: int = FREQUENT) -> tuple[bytes, bytes]:
    """Tier one, packed: the pre-tokens joined by spaces, and their lengths as unsigned 16-bit integers."""

    def count(batches):
        heavy: Counter[str] = Counter()
        for batch in batches:
            found = batch.column(1).to_pylist()
            for a, b in blocks(found):
                heavy.update(chain.from_iterable(t.split() for t in found[a:b] if not ODD_SPACES.search(t)))
                if len(heavy) > COUNTED:  # lossy counting: what is rare so far starts anew
                    heavy = Counter(dict(heavy.most_common(COUNTED // 2)))
        top = [x for x in heavy.most_common(EMITTED) if len(x[0]) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths(_tokenizer(shared), batch.column(0).to_pylist()), pa.int32())], ["piece", "length"])

    top = texts.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    rows = top.select("piece").mapInArrow(measure, "piece string, length int").collect()  # at most ``entries`` short strings
    return " ".join(r.piece for r in rows).encode(), np.array([min(r.length, 65535) for r in rows], "<u2").tobytes()


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document."""
    with open(vocab_path, encoding="utf-8") as f:
        config = f.read()
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(config)
    texts = id_and_text(docs, id_col, text_col)
    packed = frequent_lengths(texts, shared)
    frequent = context.broadcast(packed)

    def cache() -> PieceCache:
        pieces, sizes = frequent.value
        table = dict(zip(pieces.decode().split(" "), np.frombuffer(sizes, "<u2").tolist())) if pieces else {}
        tokenizer = _tokenizer(shared)
        return PieceCache(lambda new: lengths(tokenizer, new), GENERATION, table)

    key = f"lengths {hash(packed)} {hash(config)}"

    def run(batches):
        known = worker_store(key, cache)
        for batch in batches:
            found = batch.column(1).to_pylist()
            for a, b in blocks(found):
                cut = [words_of(t) for t in found[a:b]]
                every = np.array(known.values(list(chain.from_iterable(cut))), np.int64)
                n = np.diff(np.concatenate([[0], np.cumsum(every)])[np.cumsum([0, *map(len, cut)])])
                size = [len(t.encode("utf-8", "surrogatepass")) for t in found[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
