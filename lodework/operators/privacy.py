"""Static masking and authenticated encryption of columns.

Salts and keys are texts that begin with ``secret:``.  They are one-row tables that expressions read as scalar
subqueries, so a plan, which names columns of a table and not its rows, does not hold them.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "secret:"


def secret_from_env(name: str) -> str:
    """Secret text from an environment variable of the driver."""
    return as_secret(os.environ[name])


def as_secret(text: str) -> str:
    return text if text.startswith(PREFIX) else PREFIX + text


def _held(value: str | bytes) -> Column:
    """A value that expressions can use and plans do not show."""
    return SparkSession.active().createDataFrame(pa.table({"held": [value]})).scalar()


def keyed_hash(value: Column, secret: str) -> Column:
    """SHA-256 of the secret and the value as 64 hex characters; NULL stays NULL."""
    return F.sha2(F.concat(_held(as_secret(secret)), F.lit("|"), value.cast("string")), 256)


def fake(value: Column, pool: list[str], secret: str) -> Column:
    """An entry of ``pool``, always the same one for the same value."""
    at = F.conv(F.substring(keyed_hash(value, secret), 1, 12), 16, 10).cast("long") % len(pool)
    return F.when(value.isNotNull(), F.element_at(F.array(*[F.lit(p) for p in pool]), at.cast("int") + 1))


def partial(value: Column, keep_left: int = 0, keep_right: int = 0, char: str = "*") -> Column:
    """Text with all but the outer characters replaced; a text too short to keep anything is masked whole."""
    n = F.length(value)
    hidden = F.repeat(F.lit(char), n - keep_left - keep_right)
    tail = F.right(value, F.lit(keep_right)) if keep_right else F.lit("")
    return F.when(n > keep_left + keep_right, F.concat(F.left(value, F.lit(keep_left)), hidden, tail)).otherwise(F.repeat(F.lit(char), n))


def mask(df: DataFrame, rules: dict[str, tuple], secret: str = "") -> DataFrame:
    """Masked copy of a table in one projection.

    Rules per column: ("fake", pool), ("hash",), ("partial", left, right), ("null",), ("constant", value),
    ("shape",) for letters and digits replaced in place, ("regex", pattern, text),
    ("round", step) for numbers and ("trunc", unit) for times.
    """
    types = dict(df.dtypes)
    if not secret and any(kind in ("fake", "hash") for kind, *_ in rules.values()):
        raise ValueError("a keyed rule needs a secret")

    def masked(name: str) -> Column:
        value, (kind, *args) = F.col(name), rules[name]
        if kind == "fake":
            return fake(value, args[0], secret)
        if kind == "hash":
            return keyed_hash(value, secret)
        if kind == "partial":
            return partial(value.cast("string"), *args)
        if kind == "null":
            return F.lit(None).cast(types[name])
        if kind == "constant":
            return F.lit(args[0]).cast(types[name])
        if kind == "shape":
            return F.mask(value)
        if kind == "regex":
            return F.regexp_replace(value, args[0], args[1])
        if kind == "round":
            return (F.floor(value / args[0]) * args[0]).cast(types[name])
        if kind == "trunc":
            return F.date_trunc(args[0], value).cast(types[name])
        raise ValueError(f"unknown masking rule {kind}")

    return df.select(*[masked(c).alias(c) if c in rules else F.col(c) for c in df.columns])


def _key(secret: str) -> Column:
    """256-bit key of a secret."""
    return _held(hashlib.sha256(as_secret(secret).encode()).digest())


def encrypt(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """AES-GCM with a random nonce per value; the column name is authenticated, so values cannot be swapped
    between columns.  Values become binary."""
    key = _key(secret)
    return df.select(*[F.aes_encrypt(F.col(c).cast("string").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"),
                                     F.lit(b""), F.lit(c).cast("binary")).alias(c) if c in columns else F.col(c) for c in df.columns])


def decrypt(df: DataFrame, types: dict[str, str], secret: str) -> DataFrame:
    """Plain values of encrypted columns; NULL where the key is wrong or the value was tampered with."""
    return df.select(*[opened(F.col(c), c, secret).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def opened(value: Column, name: str, secret: str) -> Column:
    """Plain text of a value that was encrypted as column ``name``."""
    return F.try_aes_decrypt(value, _key(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(name).cast("binary")).cast("string")
