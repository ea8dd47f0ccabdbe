"""Random numbers as functions of a key: stable under repartitioning, retries and engine changes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def digest(key: Column, seed: object) -> Column:
    """md5 hex text of 'key|seed'."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def uniform(key: Column, seed: object) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def normal(key: Column, seed: object) -> Column:
    """Standard normal draw: Box-Muller on two uniform draws."""
    u1, u2 = uniform(key, f"{seed}a"), uniform(key, f"{seed}b")
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)
