"""Piece joins of a stream with a table."""

from tessera.streaming.mapping import stream_mapping

__all__ = ["stream_mapping"]
