"""Index notation: ``ij,j->i`` and ``y(i) = A(i,j) * x(j)``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.sources.pieces import POINT


@dataclass(frozen=True)
class Notation:
    """Index letters of the operands and the output. where: (operand, axis) of each index, in order of appearance."""

    inputs: tuple[str, ...]
    output: str

    @property
    def where(self) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for k, letters in enumerate(self.inputs):
            for d, letter in enumerate(letters):
                out.setdefault(letter, []).append((k, d))
        return out


def parse_notation(text: str, ndims: list[int] | None = None) -> Notation:
    """Reads ``ij,j->i``; ndims, if given, are the operands' numbers of axes, which must fit."""
    left, arrow, right = text.replace(" ", "").partition("->")
    if not arrow:
        raise ValueError(f"{text!r} has no '->'")
    out = Notation(tuple(left.split(",")), right)
    if ndims is not None:
        if len(ndims) != len(out.inputs):
            raise ValueError(f"{text!r} names {len(out.inputs)} operands, {len(ndims)} were given")
        for k, (letters, n) in enumerate(zip(out.inputs, ndims, strict=True)):
            if len(letters) != n:
                raise ValueError(f"operand {k} has {n} axes, {text!r} gives it {len(letters)}")
    if unknown := set(right) - set("".join(out.inputs)):
        raise ValueError(f"output indices {sorted(unknown)} are in no operand")
    return out


_TERM = re.compile(r"([A-Za-z_]\w*)(?:\(([^()]*)\))?")


def _term(text: str) -> tuple[str, str]:
    m = _TERM.fullmatch(text.strip())
    if not m:
        raise ValueError(f"can't read {text!r} as name(i,j)")
    return m[1], "".join(x.strip() for x in (m[2] or "").split(","))


def parse_algebra(text: str) -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """Reads ``y(i) = A(i,j) * x(j)`` as ((name, indices) of the output, those of the factors); a bare name is a scalar."""
    left, equals, right = text.partition("=")
    if not equals or not right.strip():
        raise ValueError(f"{text!r} isn't of the form y(i) = A(i,j) * x(j)")
    factors = right.split("*")
    if not all(f.strip() for f in factors):
        raise ValueError(f"{text!r} has an empty factor")
    return _term(left), [_term(f) for f in factors]


def to_notation(output: str, inputs: list[str]) -> str:
    return f"{','.join(inputs)}->{output}"


def output_bounds(codes: list[str]) -> str:
    """Bounds of the intersection along an index: a point if any is one, else closed where all are closed."""
    if POINT in codes:
        return POINT
    left = "[" if all(c[0] == "[" for c in codes) else "("
    return left + ("]" if all(c[1] == "]" for c in codes) else ")")


def check_bounds(notation: Notation, bounds: list[tuple[str, ...]]) -> None:
    """The strict rule: all ranges along an index have the same code; points go with any."""
    for letter, places in notation.where.items():
        codes = {bounds[k][d] for k, d in places} - {POINT}
        if len(codes) > 1:
            raise ValueError(f"index {letter!r} is carried with different bounds: {', '.join(sorted(codes))}")
