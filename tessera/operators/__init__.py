"""Joins of pieces, contraction and coalescing."""

from tessera.operators.coalesce import coalesce, overlap_exists
from tessera.operators.contract import contract, contract_algebra, contract_rows
from tessera.operators.mapping import mapping

__all__ = ["coalesce", "contract", "contract_algebra", "contract_rows", "mapping", "overlap_exists"]
