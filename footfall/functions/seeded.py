"""Deterministic stand-ins for random choices: an md5 digest of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed shared by the dictionary shuffle and the codebook fit.
DEFAULT_SEED = 2024


def digest(seed: object, *parts: Column) -> Column:
    """32 hex characters that depend on the seed and the parts only, never on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def unit_interval(seed: object, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(float(2**32))
