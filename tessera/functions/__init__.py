"""Index notation and the predicate language."""

from tessera.functions.notation import Notation, output_bounds, parse_algebra, parse_notation, to_notation
from tessera.functions.predicates import Linear, Predicate, parse_predicate

__all__ = [
    "Linear", "Notation", "Predicate", "output_bounds", "parse_algebra", "parse_notation", "parse_predicate", "to_notation",
]
