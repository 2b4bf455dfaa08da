"""Keyed uniforms: random numbers that depend on (seed, tag, id) only, never on row order or partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**48)


def uniform(seed, tag: str, *ids: Column) -> Column:
    """Double in [0, 1) from the first 48 bits of md5('seed:tag:id...')."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(_SCALE)


def gaussian(seed, tag: str, *ids: Column) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    u1 = F.lit(1.0) - uniform(seed, tag + "a", *ids)
    u2 = uniform(seed, tag + "b", *ids)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
