"""Seeded draws from hashes of stable keys: the same rows get the same numbers on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(seed, *keys) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])


def hash_uniform(seed, *keys) -> Column:
    """A double in [0, 1): the first 13 hex digits of md5('seed:key...') over 2**52."""
    digits = F.substring(F.md5(_text(seed, *keys).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def hash_order(seed, *keys) -> Column:
    """A string to sort by in place of a shuffle."""
    return F.md5(_text(seed, *keys).cast("binary"))
