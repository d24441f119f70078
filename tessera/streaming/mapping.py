"""Mapping of a stream's rows onto a table of ranges; coalescing needs all breakpoints, so it has no streaming form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_mapping(
    stream: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Joins each row of a stream with the rows of a table whose range [lo, hi) holds its place ``at`` (and whose keys
    are equal). Stateless: the table's ranges are cut into bins of the given width and the place has one bin, so it is
    an equi-join of a stream with a table. The column names of both sides must differ, keys aside."""
    cell = lambda c: F.floor(c / F.lit(width))
    cut = ranges.withColumn("__bin", F.explode(F.sequence(cell(F.least(lo, hi)), cell(F.greatest(lo, hi)))))
    rows = stream.withColumn("__bin", cell(F.col(at)))
    inside: Column = (F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))
    return rows.join(cut, ["__bin", *keys]).where(inside).drop("__bin")
