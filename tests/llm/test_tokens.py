"""Token counts, token files and byte-level BPE against the libraries."""

import tracemalloc
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodework.llm import bpe, repair, token_counts
from lodework.llm.pieces import PieceCache, SpacedEncoder
from tests.llm.cases import by_id, documents, empty, texts

RANKS, BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "Word", "é", "1", "½", "日", ".", ",", " ", "\x1c", "_", "<|endoftext|>", "<|startoftext|>", "Σ", "İ"]
    return ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(n)]


def test_byte_codec_is_the_library(encoding):
    codec = bpe.ByteCodec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    odd = odd_texts()
    for text, ids in zip(odd, codec.encode(odd), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    long = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert codec.encode([long])[0].tolist() == encoding.encode_ordinary(long)


def test_rank_queue_prefers_lowest_then_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301, b"bc": 302, b"ab": 303, b"abc": 299}
    merge = bpe.Merger(ranks).merge
    assert merge(b"aaaaa") == [300, 301] and merge(b"aaa") == [301] and merge(b"xabc") == [120, 299]
    assert merge(b"") == []


def test_byte_bpe_rows(spark, encoding):
    got, known = by_id(bpe.round_trip(documents(spark), RANKS, public_tokenizers.PATTERN)), texts()
    assert set(got) == {*known, None} and len(got[5]) == 2
    for i, text in known.items():
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        for row in got[i]:
            assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert row.round_trip and row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_texts(documents(spark), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect() if r.doc_id} == {i: t or "" for i, t in known.items()}
    assert bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN, keep_ids=True).count() == 0


def test_vocabularies_of_one_size_stay_apart(spark):
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, [(1, "Straße und Überfluss")])
    ids = [bpe.encode_texts(docs, path, public_tokenizers.PATTERN).where("doc_id = 1").first().ids for path in (RANKS, other, RANKS)]
    assert ids[0] == ids[2] != ids[1]


def test_token_counts(spark):
    library, known = Tokenizer.from_file(WORD), texts() | dict(enumerate(odd_texts(400), 1000))
    got = by_id(token_counts.count_tokens(documents(spark, known.items()), WORD))
    for i, text in known.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        for row in got[i]:
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(empty(spark), WORD).count() == 0


def test_cache_generations():
    cache = PieceCache(lambda new: [p.upper() for p in new], 4, {"fixed": "F"})
    for words in (["a", "b", "c"], ["c", "d"], ["e", "a", "fixed"], ["f", "g", "h", "i", "j"]):
        assert cache.values(words) == [{"fixed": "F"}.get(w, w.upper()) for w in words]


def test_token_files(spark):
    library, known = Tokenizer.from_file(BYTE), texts() | dict(enumerate(odd_texts(400), 1000))
    got = repair.token_files(documents(spark, known.items()), BYTE).collect()
    rows = sorted([*known.items(), (5, known[5])], key=lambda x: x[0])
    start = 0
    ordered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))
    for row, (i, text) in zip(ordered, [(None, "no id"), *rows], strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair.token_files(empty(spark), BYTE).count() == 0


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(5)
    ids = np.concatenate([r.integers(0, 6, 30_000), np.zeros(5000, int), np.tile([1, 2, 3, 4], 4000)]).astype("<u2")
    docs = [d.tobytes() for d in np.split(ids, sorted(r.integers(1, len(ids), 40))) if len(d)]
    row = repair.pack_shard(list(range(len(docs))), docs, "<u2", 50257)
    symbols, rules, lengths = repair.unpack_rules(row)
    assert len(rules) and len(symbols) < len(ids) / 2
    assert (repair.expand(symbols, rules, lengths, 50257) == ids).all()
    for at, n in ((0, 1), (777, 50), (len(ids) - 9, 9), (100, 0)):
        assert (repair.read_at(row, at, n) == ids[at : at + n]).all()
    # no symbol reaches over the end of a document
    ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(int))
    sizes = np.array([lengths[s - 50257] if s >= 50257 else 1 for s in symbols.tolist()])
    assert (np.cumsum(sizes)[ends - 1] == np.cumsum(np.frombuffer(row["doc_sizes"], "<u4"))).all()


def test_expansion_touches_few_bytes_a_symbol():
    """Terminals, most of a shard, are copied and not looked up: one array of 8 bytes a symbol beside the results (five before)."""
    r = np.random.default_rng(4)
    n, terminals = 400_000, 50_000
    rules = np.array([[1, 2], [terminals, 3], [terminals + 1, terminals]], np.uint32)
    lengths = repair.rule_lengths(rules, terminals)
    symbols = r.integers(0, terminals, n).astype(np.uint16)
    symbols[r.integers(0, n, n // 100)] = terminals + r.integers(0, 3, n // 100)
    tracemalloc.start()
    got = repair.expand(symbols, rules, lengths, terminals)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spelled = {terminals: [1, 2], terminals + 1: [1, 2, 3], terminals + 2: [1, 2, 3, 1, 2]}
    assert got.tolist() == [i for s in symbols.tolist() for i in spelled.get(s, [s])]
    assert peak < 24 * n


def test_pieces_are_looked_up_once():
    """Each distinct piece of the texts encoded together is looked up once, not at every place."""

    class Counting(PieceCache):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    tokenizer = Tokenizer.from_file(BYTE)
    encoder = SpacedEncoder(repair.Spelling(tokenizer, "<u2").many)
    encoder.tail = Counting(encoder.tails)
    some = ["one two two\nthree " * 500 + "end", "", "one", " lead", "two  spaces", "two two,"]
    assert encoder.encode(some) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in some]
    assert encoder.tail.asked < 20
