"""Seeded generator of disjoint boxes: weighted choice of grid cells, then one box in each."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.sources.pieces import POINT, Axis, PieceTable

#: How sharply full skew favours the cells near the origin.
SKEW = 8.0


def cells_per_axis(n: int, ndim: int) -> int:
    """Side of a grid with at least twice as many cells as boxes."""
    return max(2, math.ceil((2 * n) ** (1 / ndim)))


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone, not on the partitioning."""
    h = F.xxhash64(*parts, F.lit(seed).cast("long"))
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(2**53))


def synth_pieces(
    spark: SparkSession, n: int, kinds: list[str], sizes: list[float], skew: float = 0.0, seed: int = 0, side: int | None = None
) -> PieceTable:
    """n disjoint pieces, one in each of n distinct cells; kinds: a bounds code for each axis; sizes: the axes' ends.

    The n cells are those with the least log(-log u) + SKEW * skew * distance: a weighted sample without replacement."""
    if n < 0 or not 0 <= skew <= 1 or len(kinds) != len(sizes) or not kinds:
        raise ValueError("need n >= 0, skew in [0, 1], and as many kinds as sizes")
    d = len(kinds)
    side = side or cells_per_axis(n, d)
    if side**d < n:
        raise ValueError(f"a grid of {side}^{d} cells is too small for {n} pieces")
    cells = spark.range(side**d)
    digits = [F.floor(F.col("id") / side**k) % side for k in range(d)]
    far = sum(digits[1:], digits[0]) / F.lit(float(d * max(1, side - 1)))
    order = F.log(-F.log(_uniform(seed, F.col("id")))) + F.lit(SKEW * skew) * far
    chosen = cells.orderBy(order, "id").limit(n)
    cols, axes = [], []
    for k, (kind, size) in enumerate(zip(kinds, sizes, strict=True)):
        step, base = F.lit(size / side), digits[k].cast("double")
        if kind == POINT:
            cols.append(((base + 0.5) * step).alias(f"x{k}_at"))
            axes.append(Axis(kind, f"x{k}_at"))
        else:
            u, v = _uniform(seed * 31 + 2 * k + 1, F.col("id")), _uniform(seed * 31 + 2 * k + 2, F.col("id"))
            cols += [((base + F.least(u, v)) * step).alias(f"x{k}_lo"), ((base + F.greatest(u, v)) * step).alias(f"x{k}_hi")]
            axes.append(Axis(kind, f"x{k}_lo", f"x{k}_hi"))
    df = chosen.select(F.col("id").alias("piece"), *cols, F.lit(1.0).alias("value"))
    return PieceTable.of(df, axes)


def boxes_2d(spark: SparkSession, n: int, max_x: float, max_y: float, skew: float = 0.0, seed: int = 0) -> PieceTable:
    """n disjoint rectangles."""
    return synth_pieces(spark, n, ["[)", "[)"], [max_x, max_y], skew, seed)
