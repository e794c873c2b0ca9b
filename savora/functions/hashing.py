"""Reproducible pseudo-random numbers from md5, equal in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def hash_int(*parts: Column | str) -> Column:
    """Uniform integer in [0, 2^32) from the text of the given parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8)
    return F.conv(digest, 16, 10).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(HASH_RANGE))
