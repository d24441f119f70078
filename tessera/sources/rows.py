"""Editable rows (lo0, hi0, lo1, hi1, ..., value) to pieces and back, and the guard for new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.pieces import POINT, Axis, PieceTable

COORD_DIGITS, VALUE_DIGITS = 3, 6


def row_columns(bounds: list[str] | tuple[str, ...]) -> list[tuple[str, str]]:
    """(label, field) of the columns that show such rows."""
    out = []
    for k, b in enumerate(bounds):
        out += [(f"coord{k}", f"lo{k}")] if b == POINT else [(f"lo{k}", f"lo{k}"), (f"hi{k}", f"hi{k}")]
    return [*out, ("value", "value")]


def row_schema(ndim: int) -> T.StructType:
    fields = [T.StructField(f"{end}{k}", T.DoubleType()) for k in range(ndim) for end in ("lo", "hi")]
    return T.StructType([T.StructField("piece", T.LongType(), False), *fields, T.StructField("value", T.DoubleType())])


def _number(x) -> float | None:
    """A cell as a float; blank or unreadable cells are null."""
    try:
        return None if x is None or x == "" else float(x)
    except (TypeError, ValueError):
        return None


def from_rows(spark: SparkSession, rows: list[dict], bounds: list[str] | tuple[str, ...]) -> PieceTable:
    """Pieces of driver-side rows: a blank coordinate is 0, an absent value 1, a blank value 0."""
    schema = row_schema(len(bounds))
    names = schema.names[1:-1]
    data = [(i, *(_number(r.get(c)) for c in names), _number(r["value"]) if "value" in r else 1.0) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema)
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in [*names, "value"]})
    return PieceTable.of(df, [Axis(b, f"lo{k}", None if b == POINT else f"hi{k}") for k, b in enumerate(bounds)])


def to_rows(table: PieceTable) -> DataFrame:
    """Rows of pieces, rounded for display."""
    cols = []
    for k, a in enumerate(table.axes):
        cols.append(F.round(F.col(a.lo).cast("double"), COORD_DIGITS).alias(f"lo{k}"))
        if a.hi is not None:
            cols.append(F.round(F.col(a.hi).cast("double"), COORD_DIGITS).alias(f"hi{k}"))
    return table.df.select(*cols, F.round(F.col(table.value).cast("double"), VALUE_DIGITS).alias("value"))


def shares_region(a: str, b: str, axes: tuple[Axis, ...]) -> Column:
    """Whether two rows, whose columns begin with a and b, share a region: touching ends count only where both are closed."""

    def one(x: Axis) -> Column:
        if x.hi is None:
            return F.col(f"{a}{x.lo}") == F.col(f"{b}{x.lo}")
        (la, ha), (lb, hb) = ((F.least(f"{s}{x.lo}", f"{s}{x.hi}"), F.greatest(f"{s}{x.lo}", f"{s}{x.hi}")) for s in (a, b))
        inside = (la <= hb) & (lb <= ha)
        return inside if x.closed_left and x.closed_right else inside & (la != hb) & (lb != ha)

    return reduce(lambda p, q: p & q, map(one, axes), F.lit(True))


def insert_guard(new: PieceTable, held: PieceTable) -> DataFrame:
    """The new pieces that share no region with a held one: a join on bins (on keys, where all axes are points) finds the
    places that are taken, and an anti-join on places drops their pieces."""
    from tessera.operators.joins import Band, binned_join

    if new.bounds != held.bounds:
        raise ValueError("both tables need the same bounds")
    mine = [c for a in new.axes for c in a.columns]
    theirs = [c for a in held.axes for c in a.columns]
    one = new.df.select(*[F.col(c).alias(f"l_{c}") for c in dict.fromkeys(mine)]).distinct()
    two = held.df.select(*[F.col(t).alias(f"r_{m}") for m, t in dict(zip(mine, theirs, strict=True)).items()]).distinct()
    share = shares_region("l_", "r_", new.axes)
    ranges = [a for a in new.axes if a.hi is not None]
    if ranges:
        ends = lambda s, a: (F.col(f"{s}{a.lo}").cast("double"), F.col(f"{s}{a.hi}").cast("double"))
        first, *more = [Band(ends("l_", a), ends("r_", a), ()) for a in ranges]
        both = binned_join(one, two, first, share, more=tuple(more[:2]))
    else:
        both = one.join(two, share)
    taken = both.select(*[c for c in both.columns if c.startswith("l_")]).distinct()
    return new.df.join(taken, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in dict.fromkeys(mine)]), "left_anti")


def geometry(table: PieceTable) -> DataFrame:
    """What a drawing of the pieces needs: ends of the first two axes, whether they are drawn filled, and the shape."""
    if table.ndim not in (1, 2):
        shape = "text"
    else:
        points = sum(a.point for a in table.axes)
        shape = ("point" if points == table.ndim else "line" if points or table.ndim == 1 else "rect")
    cols = [F.lit(shape).alias("shape_kind")]
    for k, a in enumerate(table.axes[:2]):
        cols += [F.col(a.lo).alias(f"lo{k}"), F.col(a.hi or a.lo).alias(f"hi{k}"), F.lit(a.point).alias(f"is_point{k}"),
                 F.lit(a.point or a.closed_left).alias(f"filled_lo{k}"), F.lit(a.point or a.closed_right).alias(f"filled_hi{k}")]
    return table.df.select(*cols, F.col(table.value).alias("value"))
