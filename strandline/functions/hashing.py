"""Deterministic pseudo-random values that do not depend on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

HEX_DIGITS = 13  # 52 bits: every value is exact in a double
SPAN = float(16**HEX_DIGITS)


def digest(*parts: Column) -> Column:
    """md5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def unit(hexed: Column, slot: int = 0) -> Column:
    """Uniform value in [0, 1) from one of the two 52-bit slots of a digest."""
    piece = F.substring(hexed, 1 + slot * HEX_DIGITS, HEX_DIGITS)
    return F.conv(piece, 16, 10).cast("long") / F.lit(SPAN)


def seeded_parameters(name: str, *shape: int, scale: float = 1.0) -> np.ndarray:
    """Initial parameters in [-scale/2, scale/2), one md5 per flat position."""
    size = int(np.prod(shape))
    flat = [
        int(hashlib.md5(f"{name}|{i}".encode()).hexdigest()[:HEX_DIGITS], 16) / SPAN - 0.5
        for i in range(size)
    ]
    return (np.array(flat) * scale).reshape(shape)
