"""Bitmaps of ids that are sent to all tasks: of one size whatever the data, and never the last word.

A bitmap spares the rows that surely meet nothing a shuffle. The more ids, the more rows pass it; an
exact join always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

FILTER_BITS = 1 << 24


def bit_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The ids' low bits as a bitmap; words are put together before the driver sees them, at most bits / 32."""
    word = F.expr(f"cast(shiftright(`{column}` & {bits - 1}L, 5) as int)")
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 31 as int))")
    found = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def in_filter(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.astype(np.int64) & (len(bitmap) * 32 - 1)
    return ((bitmap[low >> 5] >> (low & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
