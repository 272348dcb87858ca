"""Texts as pieces that a tokenizer treats one by one, and worker caches of what the pieces give.

A tokenizer that splits text by pattern before it merges gives the same tokens for a text as for its pieces,
if no match of the pattern crosses a border of two pieces.  Pieces repeat, so a worker keeps their results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

#: Python's \s has these, the tokenizers' pattern has not: such texts are never cut.
ODD_SPACES = re.compile("[\x1c-\x1f]")
#: What can be cut from any text without crossing a match of the byte-level pattern.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A word and a mark after it, which a pattern of letters and of marks takes one by one.
MARKS = ",."
MARKED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.])").fullmatch
#: Entries of one generation of a cache.  A worker holds two.
GENERATION = 600_000


class PieceCache(dict):
    """Results by piece, in two generations of bounded size; pieces of the older one move up when they recur."""

    def __init__(self, encode_many: Callable[[list[str]], list], generation: int = GENERATION, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.encode_many, self.generation, self.older = encode_many, generation, {}
        self.fixed = fixed or {}

    def values(self, pieces: list[str]) -> list:
        """The result of each piece; what is missing is encoded together."""
        out = list(map(self.get, pieces))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            new = dict.fromkeys(pieces[i] for i in missing)
            if len(self) - len(self.fixed) + len(new) > self.generation:
                self.older = {k: v for k, v in self.items() if k not in self.fixed}
                self.clear()
                self.update(self.fixed)
            known = {p: self.older[p] for p in new if p in self.older}
            fresh = [p for p in new if p not in known]
            known.update(zip(fresh, self.encode_many(fresh), strict=True))
            self.update(known)
            for i in missing:
                out[i] = known[pieces[i]]
        return out

    def distinct(self, pieces: pa.Array) -> tuple[pa.Array, list]:
        """Each piece's place among the distinct ones, and the results of these: each is looked up once."""
        coded = pieces.dictionary_encode()
        return coded.indices, self.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())


def spaced(text: str) -> tuple[list[str], str | None]:
    """A text's pieces for a byte-level pattern: (those as they stand, then the others joined by spaces, or None).

    Texts whose white space is single spaces and line feeds within the text are cut by plain splitting: a piece of
    the second kind stands after a space that is not written in it, or starts with its line feed.  Any other text
    gives the first kind only.
    """
    if not text:
        return [], None
    if " ".join(text.split()) == text.replace("\n", " "):
        head, space, tail = text.replace("\n", " \n").partition(" ")
        return [head], tail if space else None
    if ODD_SPACES.search(text):
        return [text], None
    return CHUNKS.findall(text), None


def as_written(tail: str) -> str:
    """A piece of ``spaced``'s second kind as the text has it."""
    return tail if tail[0] == "\n" else " " + tail


class SpacedEncoder:
    """Ids of texts as packed little-endian integers, by worker caches over ``encode_many``.

    Texts with one of ``whole`` in them are never cut.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], generation: int = GENERATION, whole: tuple[str, ...] = ()):
        self.encode_many, self.whole = encode_many, whole
        self.marks = dict(zip(MARKS, encode_many(list(MARKS)), strict=True))
        self.plain = PieceCache(encode_many, generation // 4)
        self.tail = PieceCache(self.tails, generation)

    def tails(self, tails: list[str]) -> list[bytes]:
        """Results of pieces that follow a space; a word before a mark is looked up without the mark."""
        stems = [m[1] if t[-1] in MARKS and (m := MARKED(t)) else t for t in tails]
        newer, older = self.tail.get, self.tail.older.get
        known = {s: held for s, t in zip(stems, tails) if s is not t and (held := newer(s) or older(s))}
        fresh = [s for s in dict.fromkeys(stems) if s not in known]
        known.update(zip(fresh, self.encode_many([as_written(s) for s in fresh]), strict=True))
        return [known[s] if s is t else known[s] + self.marks[t[-1]] for s, t in zip(stems, tails)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [([t], None) if any(w in t for w in self.whole) else spaced(t) for t in texts]
        plain = self.plain.values([p for c in cut for p in c[0]])
        tails = pc.split_pattern(pa.array([c[1] for c in cut], pa.large_string()), " ")  # none for None
        place, found = self.tail.distinct(tails.flatten())
        ends = pc.fill_null(pc.list_value_length(tails), 0).to_numpy().cumsum()
        each = pa.LargeListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int64()), pa.array(found, pa.large_binary()).take(place))
        out, a = [], 0
        for c, tail in zip(cut, pc.binary_join(each, pa.scalar(b"", pa.large_binary())).to_pylist(), strict=True):
            b = a + len(c[0])
            out.append(b"".join(plain[a:b]) + tail)
            a = b
        return out
