"""Rewriting overlapping pieces into disjoint cells with summed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import Band, binned_join
from tessera.operators.store import stored
from tessera.sources.pieces import Axis, PieceTable

MODES = ("gated", "always", "never")
#: Parts of an axis that are sorted on their own.
SLICES = 4096


def overlap_exists(table: PieceTable, width: float | None = None) -> DataFrame:
    """One row ``overlap``: whether two pieces overlap with positive measure (equal on points) on every axis."""
    if not table.axes:
        return table.df.sparkSession.range(1).select(F.lit(False).alias("overlap"))
    ranges = [a for a in table.axes if a.hi is not None]
    points = [a for a in table.axes if a.hi is None]
    twice = lambda df: df.agg((F.count("*") > 0).alias("overlap"))
    if not ranges:
        repeated = table.df.groupBy(*[a.lo for a in points]).count().where("count > 1").limit(1)
        return twice(repeated)
    df = table.df.select(*dict.fromkeys([c for a in table.axes for c in a.columns]))
    for a in ranges:  # an empty or inverted range overlaps nothing
        df = df.where(F.col(a.lo) < F.col(a.hi))
    counted = df.groupBy(*df.columns).count()
    copies = twice(counted.where("count > 1").limit(1))
    one = counted.drop("count")
    left = one.select(*[F.col(c).alias(f"l_{c}") for c in df.columns])
    right = one.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
    cond = [F.col(f"l_{p.lo}") == F.col(f"r_{p.lo}") for p in points]
    for a in ranges:
        cond += [F.col(f"l_{a.lo}") < F.col(f"r_{a.hi}"), F.col(f"r_{a.lo}") < F.col(f"l_{a.hi}")]
    differ = reduce(lambda x, y: x | y, [F.col(f"l_{c}") != F.col(f"r_{c}") for c in df.columns])
    a = ranges[0]
    number = lambda c: F.col(c).cast("double")
    band = Band((number(f"l_{a.lo}"), number(f"l_{a.hi}")), (number(f"r_{a.lo}"), number(f"r_{a.hi}")), ())
    pairs = binned_join(left, right, band, reduce(lambda x, y: x & y, cond) & differ, width)
    return twice(pairs.limit(1)).union(copies).agg(F.bool_or("overlap").alias("overlap"))


def _position(c: str, kind: T.DataType) -> Column:
    """A breakpoint's place on the axis as a double: times as days or microseconds."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def ranked(places: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """Distinct breakpoints ``__b`` with their rank ``__r`` (from 1), the next larger one ``__next`` and, for each column of
    sums, its running total. Places are dealt into SLICES equal slices of their finite span; each slice is sorted by itself,
    and only one row for each slice is put in order in one task."""
    at = _position("__b", places.schema["__b"].dataType)
    finite = F.when(F.abs(at) < float("inf"), at)
    span = places.agg(F.min(finite).alias("__low"), F.max(finite).alias("__high"))
    part = (F.greatest(F.least(at, "__high"), F.col("__low")) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    slice_ = F.when(F.col("__high") > F.col("__low"), F.floor(part * F.lit(float(SLICES)))).otherwise(0)
    # Endless ends have slices of their own.
    slice_ = F.when(at == float("-inf"), -1).when((at == float("inf")) | F.isnan(at), SLICES + 1).otherwise(slice_)
    dealt = places.crossJoin(F.broadcast(span)).withColumn("__slice", slice_).drop("__low", "__high")
    heads = dealt.groupBy("__slice").agg(
        F.count("*").alias("__n"), F.min("__b").alias("__min"), *[F.sum(c).alias(f"__t_{c}") for c in sums]
    )
    order = W.orderBy("__slice")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    heads = heads.select(
        "__slice", before("__n").alias("__rank0"), F.lead("__min").over(order).alias("__min1"),
        *[before(f"__t_{c}").alias(f"__sum0_{c}") for c in sums],
    )
    inner = W.partitionBy("__slice").orderBy("__b")
    local = dealt.withColumns(
        {"__r": F.row_number().over(inner), "__next": F.lead("__b").over(inner)}
        | {f"__run_{c}": F.sum(c).over(inner.rowsBetween(W.unboundedPreceding, 0)) for c in sums}
    )
    return local.join(F.broadcast(heads), "__slice").select(  # at most SLICES + 1 rows
        "__b",
        (F.col("__r") + F.col("__rank0")).alias("__r"),
        F.coalesce("__next", "__min1").alias("__next"),
        *[(F.col(f"__run_{c}") + F.col(f"__sum0_{c}")).alias(c) for c in sums],
    )


def _exact(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegralType, T.DecimalType))


def sweep(table: PieceTable) -> DataFrame:
    """The grid of one range axis with exact values: running sums over the breakpoints of what starts and ends there."""
    (a,) = table.axes
    counts = F.col(a.lo) < F.col(a.hi)  # the ends of other pieces cut, but carry nothing
    v = F.when(counts, F.col(table.value)).otherwise(F.lit(0))
    ends = table.df.select(F.col(a.lo).alias("__b"), v.alias("value")).union(
        table.df.select(F.col(a.hi).alias("__b"), (-v).alias("value"))
    )
    steps = ends.groupBy("__b").agg(F.sum("value").alias("value"))
    out = ranked(steps, ("value",)).where(F.col("__next").isNotNull() & (F.col("value") != 0))
    return out.select(F.col("__b").alias(a.lo), F.col("__next").alias(a.hi), "value")


def grid(table: PieceTable) -> DataFrame:
    """Cells between neighbouring breakpoints of all pieces, with the sums of the pieces that cover them; cells that
    nothing covers, and those that sum to zero, are absent."""
    types = {f.name: f.dataType for f in table.df.schema}
    if len(table.axes) == 1 and table.axes[0].hi is not None and _exact(types[table.value]):
        if isinstance(types[table.axes[0].lo], T.NumericType):
            return sweep(table)
    df = table.df.select(*dict.fromkeys([c for a in table.axes for c in a.columns]), F.col(table.value).alias("__value"))
    source, keys = df, []
    marks: list[tuple[Axis, int, DataFrame]] = []
    for k, a in enumerate(table.axes):
        if a.hi is None:
            keys.append(a.lo)
            continue
        ends = source.select(F.col(a.lo).alias("__b")).union(source.select(F.col(a.hi).alias("__b"))).distinct()
        mark = ranked(ends)
        marks.append((a, k, mark))
        for side, c in (("lo", a.lo), ("hi", a.hi)):
            df = df.join(mark.select(F.col("__b").alias(c), F.col("__r").alias(f"__{side}{k}")), c)
        keys.append(f"__cell{k}")
    for _, k, _ in marks:
        df = df.where(F.col(f"__lo{k}") < F.col(f"__hi{k}"))
    for _, k, _ in marks:
        df = df.withColumn(f"__cell{k}", F.explode(F.sequence(f"__lo{k}", F.col(f"__hi{k}") - 1)))
    out = df.groupBy(*dict.fromkeys(keys)).agg(F.sum("__value").alias("value")).where(F.col("value") != 0)
    for a, k, mark in marks:
        named = mark.select(F.col("__r").alias(f"__cell{k}"), F.col("__b").alias(a.lo), F.col("__next").alias(a.hi))
        out = out.join(named, f"__cell{k}")
    return out.select(*[c for a in table.axes for c in a.columns], "value")


def coalesce(table: PieceTable, mode: str = "gated") -> PieceTable:
    """Equivalent pieces that don't overlap. "gated": unchanged if no two overlap, else all pieces are laid on the
    grid of all breakpoints; "always": the grid in any case; "never": unchanged. Cells are told apart by their places.

    Unless mode is "never", the pieces are written to the shared folder, as the gate and the grid read them several times,
    and the gate is read at once; the grid is lazy."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't one of {', '.join(MODES)}")
    if mode == "never" or not table.axes:
        return table
    names = list(dict.fromkeys(c for a in table.axes for c in a.columns))
    pieces = stored(table.df.select(*names, F.col(table.value).alias("value")))
    table = PieceTable(pieces, table.axes, "value", tuple(names))
    if mode == "gated" and not overlap_exists(table).first()["overlap"]:
        return table
    return PieceTable(grid(table), table.axes, "value", tuple(names))
