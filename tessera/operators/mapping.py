"""Piece-joining by declared predicates: which rows of the axes' tables belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicates import joined_name, parse_predicate
from tessera.operators.joins import join_axes


def mapping(
    frames: dict[str, DataFrame],
    output: list[str] | tuple[str, ...],
    where: list[str],
    strategy: str = "auto",
    piece: str = "piece",
    width: float | None = None,
    outer: bool = False,
) -> DataFrame:
    """One row (a piece id for each output axis) for each tuple of rows that satisfies all predicates.

    frames: axis name to DataFrame; all of an axis's columns are its own, so they have one length. One table may serve
    under two names (a self-join). Ids may have any type (a struct for composite ones); whole numbers come out as longs. Predicates are like ``A_lo[A] < B_hi[B]``. strategy: auto, equi, binned or theta;
    all give the same rows."""
    if not where and not outer:
        raise ValueError("no predicates")
    preds = [parse_predicate(w) for w in where]
    for p in preds:
        for axis, column in p.refs:
            if axis not in frames:
                raise ValueError(f"{p.text!r}: no axis {axis!r}")
            if column not in frames[axis].columns:
                raise ValueError(f"{p.text!r}: axis {axis!r} has no column {column!r}")
    for axis in output:
        if axis not in frames:
            raise ValueError(f"no axis {axis!r}")
    used = {a: {piece} | {c for p in preds for x, c in p.refs if x == a} for a in frames}
    slim = {a: df.select(*[c for c in df.columns if c in used[a]]) for a, df in frames.items()}
    joined = join_axes(slim, preds, strategy, width, outer)
    whole = {a: isinstance(slim[a].schema[piece].dataType, T.IntegralType) for a in output}
    ids = {a: F.col(joined_name((a, piece))) for a in output}
    return joined.select(*[(ids[a].cast("long") if whole[a] else ids[a]).alias(f"{a}_piece") for a in output])
