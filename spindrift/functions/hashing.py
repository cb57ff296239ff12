"""Stable hashes that give the same value in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The 128-bit MD5 of a text, taken as an integer, modulo ``buckets``.

    The digest is read in four 32-bit pieces and reduced piece by piece
    (Horner's rule), which stays within 64-bit integers.
    """
    digest = F.md5(key.cast("string"))
    base = 2**32 % buckets
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        piece = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * base + piece) % buckets
    return rest


def md5_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(2**32)
