"""Reversible short ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_BITS = 31
HALF = 2 ** HALF_BITS
ROUNDS = 4


def _mix(half: Column, salt: str, turn: int) -> Column:
    """Keyed value in one half of the id space."""
    return F.xxhash64(F.lit(f"{salt}|{turn}"), half).bitwiseAND(F.lit(HALF - 1))


def _round(salt: str, turn: int, forward: bool):
    if forward:
        return lambda s: F.struct(s.r.alias("l"), s.l.bitwiseXOR(_mix(s.r, salt, turn)).alias("r"))
    return lambda s: F.struct(s.r.bitwiseXOR(_mix(s.l, salt, turn)).alias("l"), s.l.alias("r"))


def _halves(value: Column, salt: str, turns, forward: bool) -> Column:
    """The keyed permutation, with the two halves as lambda variables: no column of the table is touched."""
    state = F.struct(F.shiftright(value, HALF_BITS).alias("l"), value.bitwiseAND(F.lit(HALF - 1)).alias("r"))
    for turn in turns:
        state = F.transform(F.array(state), _round(salt, turn, forward))[0]
    return F.transform(F.array(state), lambda s: F.shiftleft(s.l, HALF_BITS).bitwiseOR(s.r))[0]


def encode_ids(df: DataFrame, column: str, salt: str, name: str = "code") -> DataFrame:
    """Short text for each integer id in [0, 2^62): a keyed permutation (Feistel rounds) in base 36.

    Distinct ids get distinct texts; other ids raise.  It hides counters from readers; it is not encryption.
    """
    value = F.col(column).cast("long")
    bad = F.raise_error(F.concat(F.lit("id out of range: "), value.cast("string"))).cast("long")
    known = F.when((value >= 0) & (value < HALF * HALF), value).when(value.isNotNull(), bad)
    mixed = _halves(known, salt, range(ROUNDS), True)
    return df.withColumn(name, F.lower(F.conv(mixed.cast("string"), 10, 36)))


def decode_ids(df: DataFrame, column: str, salt: str, name: str = "id") -> DataFrame:
    """Ids back from their texts."""
    return df.withColumn(name, _halves(F.conv(F.col(column), 36, 10).cast("long"), salt, reversed(range(ROUNDS)), False))
