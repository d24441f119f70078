"""Piece tables: how box data enters and leaves the engine."""

from tessera.sources.pieces import Axis, PieceTable
from tessera.sources.rows import from_rows, geometry, insert_guard, row_columns, to_rows
from tessera.sources.synth import boxes_2d, cells_per_axis, synth_pieces

__all__ = [
    "Axis", "PieceTable", "boxes_2d", "cells_per_axis", "from_rows", "geometry", "insert_guard", "row_columns",
    "synth_pieces", "to_rows",
]
