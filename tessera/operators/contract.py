"""Contraction: join pieces where they meet on shared indices, multiply, sum over the dropped indices, coalesce."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.notation import Notation, check_bounds, output_bounds, parse_algebra, parse_notation, to_notation
from tessera.functions.predicates import Predicate, joined_name, parse_predicate
from tessera.operators.coalesce import coalesce as coalesce_pieces
from tessera.operators.joins import join_axes
from tessera.sources.pieces import POINT, Axis, PieceTable
from tessera.sources.rows import from_rows


def meet(a: str, x: Axis, b: str, y: Axis) -> list[str]:
    """Predicates that the axes x of operand a and y of operand b share a place: ends that touch count where both are
    closed."""
    if x.point and y.point:
        return [f"{x.lo}[{a}] == {y.lo}[{b}]"]
    if x.point:
        return meet(b, y, a, x)
    if y.point:
        low, high = ("<=" if x.closed_left else "<"), ("<=" if x.closed_right else "<")
        return [f"{x.lo}[{a}] {low} {y.lo}[{b}]", f"{y.lo}[{b}] {high} {x.hi}[{a}]"]
    one = "<=" if x.closed_left and y.closed_right else "<"
    two = "<=" if y.closed_left and x.closed_right else "<"
    return [f"{x.lo}[{a}] {one} {y.hi}[{b}]", f"{y.lo}[{b}] {two} {x.hi}[{a}]"]


def _predicates(notation: Notation, tables: list[PieceTable]) -> list[Predicate]:
    out = []
    for places in notation.where.values():
        for (i, d), (j, e) in combinations(places, 2):
            out += meet(f"o{i}", tables[i].axes[d], f"o{j}", tables[j].axes[e])
    return [parse_predicate(p) for p in dict.fromkeys(out)]


def contract(
    equation: str,
    *tables: PieceTable,
    strategy: str = "auto",
    coalesce: str = "gated",
    strict_bounds: bool = False,
    outer: bool = False,
    width: float | None = None,
) -> PieceTable:
    """Evaluates an index equation such as ``ij,j->i`` over piece tables. Joins and sums are lazy up to coalescing, which
    writes its pieces once; with coalesce="never" nothing but the widths of ranges is read at once.

    Values are plain products, not weighted by lengths. Output pieces are told apart by the pieces that carry output
    indices, then made disjoint: coalesce is "gated" (all or nothing, only if two overlap), "always" or "never".
    A repeated index within one operand keeps its diagonal. outer=True allows operands that share no index."""
    notation = parse_notation(equation, [t.ndim for t in tables])
    if strict_bounds:
        check_bounds(notation, [t.bounds for t in tables])
    frames = {
        f"o{k}": t.df.select(*dict.fromkeys([*t.piece, *(c for a in t.axes for c in a.columns), t.value]))
        for k, t in enumerate(tables)
    }
    joined = join_axes(frames, _predicates(notation, list(tables)), strategy, width, outer)
    col = lambda k, c: F.col(joined_name((f"o{k}", c)))
    product = reduce(lambda a, b: a * b, [col(k, t.value) for k, t in enumerate(tables)])

    coords: list[tuple[str, Column]] = []
    axes: list[Axis] = []
    for n, letter in enumerate(notation.output):
        name = letter if letter not in notation.output[:n] else f"{letter}{n}"
        places = notation.where[letter]
        bounds = output_bounds([tables[k].axes[d].bounds for k, d in places])
        if bounds == POINT:
            k, d = next((k, d) for k, d in places if tables[k].axes[d].point)
            coords.append((f"{name}_at", col(k, tables[k].axes[d].lo)))
            axes.append(Axis(bounds, f"{name}_at"))
        else:
            lows = [col(k, tables[k].axes[d].lo) for k, d in places]
            highs = [col(k, tables[k].axes[d].hi) for k, d in places]
            coords.append((f"{name}_lo", F.greatest(*lows) if len(lows) > 1 else lows[0]))
            coords.append((f"{name}_hi", F.least(*highs) if len(highs) > 1 else highs[0]))
            axes.append(Axis(bounds, f"{name}_lo", f"{name}_hi"))
    providers = [k for k, letters in enumerate(notation.inputs) if set(letters) & set(notation.output)]
    ids = [(f"piece{k}_{p}" if len(tables[k].piece) > 1 else f"piece{k}", col(k, p)) for k in providers for p in tables[k].piece]
    rows = joined.select(*[c.alias(n) for n, c in [*ids, *coords]], product.alias("value"))
    if not notation.output:
        total = rows.agg(F.sum("value").alias("value"), F.count("*").alias("__n")).where(F.col("__n") > 0)
        return PieceTable(total.select(F.lit(0).cast("long").alias("piece"), "value"), (), "value")
    summed = rows.groupBy(*[n for n, _ in ids], *dict.fromkeys(n for n, _ in coords)).agg(F.sum("value").alias("value"))
    out = PieceTable(summed, tuple(axes), "value", tuple(n for n, _ in ids))
    return coalesce_pieces(out, coalesce)


def contract_algebra(equation: str, operands: dict[str, PieceTable], **options) -> PieceTable:
    """Evaluates ``y(i) = A(i,j) * x(j)``; operands by name."""
    (_, output), factors = parse_algebra(equation)
    if missing := [n for n, _ in factors if n not in operands]:
        raise ValueError(f"no operand named {', '.join(missing)}")
    return contract(to_notation(output, [i for _, i in factors]), *[operands[n] for n, _ in factors], **options)


def contract_rows(spark: SparkSession, equation: str, rows: list[list[dict]], bounds: list[list[str]], **options) -> PieceTable:
    """Evaluates an index equation over driver-side rows."""
    return contract(equation, *[from_rows(spark, r, b) for r, b in zip(rows, bounds, strict=True)], **options)
