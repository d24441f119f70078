"""The data model: a table of pieces, each a box on named axes with one value."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How an axis is bounded: a range with open or closed ends, or a point.
RANGES = ("[)", "(]", "[]", "()")
POINT = "P"


@dataclass(frozen=True)
class Axis:
    """One dimension of a piece table: its bounds code and the column or columns that hold it."""

    bounds: str
    lo: str
    hi: str | None = None

    def __post_init__(self) -> None:
        if self.bounds != POINT and self.bounds not in RANGES:
            raise ValueError(f"unknown bounds {self.bounds!r}; use one of {', '.join((*RANGES, POINT))}")
        if (self.hi is None) != (self.bounds == POINT):
            raise ValueError(f"bounds {self.bounds!r} need {'one column' if self.bounds == POINT else 'two columns'}")

    @property
    def point(self) -> bool:
        return self.bounds == POINT

    @property
    def closed_left(self) -> bool:
        return self.bounds[0] == "["

    @property
    def closed_right(self) -> bool:
        return self.bounds[-1] == "]"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.lo,) if self.hi is None else (self.lo, self.hi)


@dataclass(frozen=True)
class PieceTable:
    """A lazy DataFrame of pieces. ``piece`` names the columns that tell pieces apart."""

    df: DataFrame
    axes: tuple[Axis, ...]
    value: str = "value"
    piece: tuple[str, ...] = ("piece",)

    @classmethod
    def of(
        cls,
        df: DataFrame,
        axes: Iterable[Axis | tuple],
        value: str = "value",
        piece: str | tuple[str, ...] = "piece",
        dtype: str | None = None,
    ) -> PieceTable:
        """Wraps df after checking names and types; dtype casts coordinates and values. Runs nothing."""
        axes = tuple(a if isinstance(a, Axis) else Axis(*a) for a in axes)
        piece = (piece,) if isinstance(piece, str) else tuple(piece)
        types = {f.name: f.dataType for f in df.schema}
        for name in (*(c for a in axes for c in a.columns), value):
            if name not in types:
                raise ValueError(f"no column {name!r}; there are {', '.join(types)}")
            if not isinstance(types[name], (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
                raise ValueError(f"column {name!r} is {types[name].simpleString()}, not a number or time")
        for name in piece:
            if name not in types:
                raise ValueError(f"no piece column {name!r}; give each piece an id (see number_pieces)")
        if dtype is not None:
            numbers = dict.fromkeys([*(c for a in axes for c in a.columns), value])
            df = df.withColumns({c: F.col(c).cast(dtype) for c in numbers})
        return cls(df, axes, value, piece)

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, columns: Mapping[str, str | Column], axes, **kw) -> PieceTable:
        """Reads a Parquet table and projects it to the given columns (name: expression)."""
        df = spark.read.parquet(path)
        picked = {n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()}
        return cls.of(df.select(*[c.alias(n) for n, c in picked.items()]), axes, **kw)

    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def bounds(self) -> tuple[str, ...]:
        return tuple(a.bounds for a in self.axes)

    @property
    def dtype(self) -> T.DataType:
        return self.df.schema[self.value].dataType

    def nnz(self) -> int:
        """Number of pieces (an action)."""
        return self.df.count()

    def tagged(self) -> DataFrame:
        """The DataFrame with each axis's bounds code in its columns' metadata, which Parquet keeps."""
        out = self.df
        for k, a in enumerate(self.axes):
            for c in a.columns:
                out = out.withMetadata(c, {"axis": k, "bounds": a.bounds})
        return out

    @classmethod
    def untagged(cls, df: DataFrame, value: str = "value", piece: str | tuple[str, ...] = "piece") -> PieceTable:
        """The inverse of tagged()."""
        found: dict[int, tuple[str, list[str]]] = {}
        for f in df.schema:
            if "bounds" in f.metadata:
                found.setdefault(f.metadata["axis"], (f.metadata["bounds"], []))[1].append(f.name)
        return cls.of(df, [Axis(b, *cols) for _, (b, cols) in sorted(found.items())], value, piece)

    def validate(self) -> dict[str, int]:
        """Counts rows with a null, a NaN or inverted ends, and repeated piece ids (an action)."""
        names = [*(c for a in self.axes for c in a.columns), self.value]
        floats = {f.name for f in self.df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        null = F.lit(False)
        nan = F.lit(False)
        inverted = F.lit(False)
        for c in names:
            null = null | F.col(c).isNull()
            nan = nan | (F.isnan(c) if c in floats else F.lit(False))
        for a in self.axes:
            if a.hi is not None:
                wrong = F.col(a.lo) > F.col(a.hi)
                wrong = wrong & ~F.isnan(a.lo) if a.lo in floats else wrong
                inverted = inverted | F.coalesce(wrong, F.lit(False))
        row = self.df.agg(
            F.count_if(null).alias("null"), F.count_if(nan).alias("nan"), F.count_if(inverted).alias("inverted")
        ).first()
        twice = self.df.groupBy(*self.piece).count().where("count > 1").count()
        return {**row.asDict(), "repeated_ids": twice}

    def finite(self) -> PieceTable:
        """Without the rows that have a null or NaN coordinate or value."""
        names = [*(c for a in self.axes for c in a.columns), self.value]
        return PieceTable(self.df.na.drop(subset=names), self.axes, self.value, self.piece)


def number_pieces(df: DataFrame, *order: str, name: str = "piece") -> DataFrame:
    """Adds ids 0, 1, ... in the order of some columns (all, if none are named). One task sorts the whole table: this is
    for small tables without a key; where there is a key, it should be the piece id."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.orderBy(*(order or df.columns))) - 1
    return df.select(rank.cast("long").alias(name), *df.columns)
