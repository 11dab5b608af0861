"""Hash ranks, folds and 64-bit hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | str, id_: Column, sep: str = "|") -> Column:
    """SHA-256 of ``seed`` and the id with a separator, in hex; its order is the rank."""
    return F.sha2(F.concat(F.lit(f"{seed}{sep}"), id_.cast("string")), 256)


def _first64(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_unit(seed: int | str, id_: Column, sep: str = "|") -> Column:
    """The first eight bytes of the rank as a fraction of 2^64."""
    return _first64(hash_hex(seed, id_, sep)).cast("double") / F.lit(2.0**64)


def hash_fold(seed: int | str, id_: Column, folds: int, sep: str = "|") -> Column:
    """The first eight bytes of the rank, modulo ``folds``."""
    return (_first64(hash_hex(seed, id_, sep)) % folds).cast("int")


def hex_to_long(hex_: Column) -> Column:
    """16 hex digits as a signed 64-bit integer."""
    return F.conv(hex_, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vector: str | Column) -> Column:
    """Sign bits of 64 numbers as a long; the first is the highest bit, a bit is set where the number is >= 0."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
