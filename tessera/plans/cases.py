"""Nineteen join shapes over generated pieces, for differential tests and for timing at the published sizes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mapping
from tessera.sources import synth_pieces

SPACE = 64.0
SEEDS = {"A": 11, "B": 22, "C": 33, "Points": 55, "Data": 66, "Query": 77, "Mask": 88, "In": 99}
Frames = dict[str, DataFrame]


def eq(d: int, a: str, b: str) -> list[str]:
    return [f"x{d}_at[{a}] == x{d}_at[{b}]"]


def meet(d: int, a: str, b: str, e: int | None = None) -> list[str]:
    e = d if e is None else e
    return [f"x{d}_lo[{a}] < x{e}_hi[{b}]", f"x{e}_lo[{b}] < x{d}_hi[{a}]"]


def inside(d: int, point: str, of: str, e: int | None = None) -> list[str]:
    e = d if e is None else e
    return [f"x{e}_lo[{of}] <= x{d}_at[{point}]", f"x{d}_at[{point}] < x{e}_hi[{of}]"]


@dataclass(frozen=True)
class Case:
    name: str
    kinds: dict[str, list[str]]
    where: list[str]
    extra: Callable[[SparkSession, int, float], Frames] | None = None
    output: tuple[str, ...] | None = None

    def frames(self, spark: SparkSession, n: int, skew: float) -> Frames:
        out = {a: synth_pieces(spark, n, k, [SPACE] * len(k), skew, SEEDS[a]).df.drop("value") for a, k in self.kinds.items()}
        return out | (self.extra(spark, n, skew) if self.extra else {})

    def run(self, frames: Frames, strategy: str = "auto") -> DataFrame:
        return mapping(frames, self.output or list(frames), self.where, strategy)


def _box(spark: SparkSession, n: int, skew: float) -> Frames:
    box = spark.range(1).select(F.col("id").alias("piece"))
    return {"Box": box.withColumns({f"x{d}_{e}": F.lit(v) for d in (0, 1) for e, v in (("lo", 0.0), ("hi", 16.0))})}


def _weights(spark: SparkSession, n: int, skew: float) -> Frames:
    """27 offset boxes: a few around zero, as many as the skew says; the rest out of reach."""
    near = max(1, min(27, round(1 + 4 * skew)))
    cell = SPACE / max(2, int((2 * n) ** (1 / 3)))
    cols = {}
    for d in range(3):
        far = 1000.0 + F.col("piece") * cell + d * cell
        cols[f"x{d}_lo"] = F.when(F.col("piece") < near, -cell).otherwise(far)
        cols[f"x{d}_hi"] = F.when(F.col("piece") < near, cell).otherwise(far + 0.5)
    return {"Weight": spark.range(27).select(F.col("id").alias("piece")).withColumns(cols)}


P, R = "P", "[)"
_TRIPLE = [("A", "B"), ("A", "C"), ("B", "C")]
CASES = [
    Case("01_pointwise_1d_pp", {"A": [P], "B": [P]}, eq(0, "A", "B")),
    Case("02_pointwise_1d_ii", {"A": [R], "B": [R]}, meet(0, "A", "B")),
    Case("03_pointwise_1d_pi", {"A": [P], "B": [R]}, inside(0, "A", "B")),
    Case("04_pointwise_2d_pp", {"A": [P, P], "B": [P, P]}, eq(0, "A", "B") + eq(1, "A", "B")),
    Case("05_pointwise_2d_ii", {"A": [R, R], "B": [R, R]}, meet(0, "A", "B") + meet(1, "A", "B")),
    Case("06_pointwise_2d_pi", {"A": [P, R], "B": [P, R]}, eq(0, "A", "B") + meet(1, "A", "B")),
    Case("07_diagonal_ii_i", {"A": [R, R], "B": [R]}, meet(0, "A", "A", 1) + meet(0, "A", "B") + meet(1, "A", "B", 0)),
    Case("08_diagonal_ii_p", {"A": [R, R], "B": [P]}, inside(0, "B", "A", 0) + inside(0, "B", "A", 1)),
    Case("09_reduce_1d_pp", {"A": [P], "B": [P]}, eq(0, "A", "B")),
    Case("10_reduce_1d_ii", {"A": [R], "B": [R]}, meet(0, "A", "B")),
    Case("11_matmul_pp", {"A": [P], "B": [P]}, eq(0, "A", "B")),
    Case("12_matmul_ii", {"A": [R], "B": [R]}, meet(0, "A", "B")),
    Case("13_triple_1d_pp", {"A": [P], "B": [P], "C": [P]}, eq(0, "A", "B") + eq(0, "A", "C")),
    Case("14_triple_1d_ii", {"A": [R], "B": [R], "C": [R]}, [w for a, b in _TRIPLE for w in meet(0, a, b)]),
    Case("15_triple_2d_pp", {"A": [P, P], "B": [P, P], "C": [P, P]}, [w for d in (0, 1) for b in "BC" for w in eq(d, "A", b)]),
    Case("16_triple_2d_ii", {"A": [R, R], "B": [R, R], "C": [R, R]}, [w for d in (0, 1) for a, b in _TRIPLE for w in meet(d, a, b)]),
    Case("17_box_search", {"Points": [P, P]}, [w for d in (0, 1) for w in inside(d, "Points", "Box")], _box, ("Box", "Points")),
    Case("18_bio_intersect", {"Data": [R, P], "Query": [R, P]}, meet(0, "Data", "Query") + eq(1, "Data", "Query")),
    Case(
        "19_point_cloud",
        {"Mask": [P, P, P], "In": [P, P, P]},
        [w for d in range(3) for w in (f"x{d}_at[In] >= x{d}_at[Mask] + x{d}_lo[Weight]", f"x{d}_at[In] < x{d}_at[Mask] + x{d}_hi[Weight]")],
        _weights,
        ("Mask", "In", "Weight"),
    ),
]
