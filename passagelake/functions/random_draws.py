"""The reference's seeded generator as a pure column expression, and on arrays inside a task.

Its state advances by a constant, so draw ``j`` can be computed directly from ``j``: every row of a
distributed range produces exactly the value a sequential generator would have produced there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the generator.
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product; halves keep every intermediate inside a signed 64-bit long."""
    low = a * b.bitwiseAND(F.lit(0xFFFF).cast("long"))
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(MASK).cast("long"))


def with_uniform_draw(df: DataFrame, number: Column, seed: int, name: str) -> DataFrame:
    """Add draw ``number`` (0-based) in [0, 1) as column ``name``.

    Each mixing step is a column of its own, because a step uses its input several times.
    """
    mask, one, bits = (F.lit(v).cast("long") for v in (MASK, 1, 61))
    state = F.lit(seed).cast("long") + (number.cast("long") + 1).bitwiseAND(mask) * F.lit(STEP).cast("long")
    a, t, u = F.col("_a"), F.col("_t"), F.col("_u")
    staged = (
        df.withColumn("_a", state.bitwiseAND(mask))
        .withColumn("_t", _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(one)))
        .withColumn("_u", t.bitwiseXOR((t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(bits))).bitwiseAND(mask)))
    )
    return staged.withColumn(name, u.bitwiseXOR(F.shiftright(u, 14)) * F.lit(2.0**-32)).drop("_a", "_t", "_u")


def uniform_draws(first: int, count: int, seed: int) -> np.ndarray:
    """Draws ``first`` to ``first + count - 1`` (0-based) in [0, 1): the same numbers as ``with_uniform_draw``."""
    number = (np.arange(first + 1, first + count + 1, dtype=np.int64) & MASK).astype(np.uint32)
    a = np.uint32(seed & MASK) + number * np.uint32(STEP)  # 32-bit products and sums wrap, as the generator's do
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    u = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
    return (u ^ (u >> np.uint32(14))) * 2.0**-32
