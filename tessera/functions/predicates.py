"""The predicate language: ``A_lo[A] + 1 < B_hi[B]``, one comparison of arithmetic over columns of axes.

A predicate becomes a Spark Column, and a linear form from which the join strategy is chosen."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Ref = tuple[str, str]  # (axis, column)
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def joined_name(ref: Ref) -> str:
    """The name of an axis's column in a join."""
    return f"{ref[0]}__{ref[1]}"


def ref_column(ref: Ref) -> Column:
    return F.col(joined_name(ref))


@dataclass(frozen=True)
class Linear:
    """A sum of columns times numbers, plus a number."""

    terms: tuple[tuple[Ref, float], ...] = ()
    const: float = 0.0

    def plus(self, other: Linear, sign: float = 1.0) -> Linear:
        sums: dict[Ref, float] = dict(self.terms)
        for ref, c in other.terms:
            sums[ref] = sums.get(ref, 0.0) + sign * c
        return Linear(tuple((r, c) for r, c in sums.items() if c), self.const + sign * other.const)

    def times(self, k: float) -> Linear:
        return Linear(tuple((r, c * k) for r, c in self.terms if c * k), self.const * k)

    def part(self, axes: set[str]) -> Linear:
        """The terms over some axes, without the constant."""
        return Linear(tuple((r, c) for r, c in self.terms if r[0] in axes))

    def column(self) -> Column:
        out = F.lit(float(self.const)) if self.const or not self.terms else None
        for ref, c in self.terms:
            x = ref_column(ref).cast("double")
            x = x if c == 1 else -x if c == -1 else x * F.lit(float(c))
            out = x if out is None else out + x
        return out


@dataclass(frozen=True)
class Predicate:
    text: str
    op: str
    left: Column = field(compare=False)
    right: Column = field(compare=False)
    refs: frozenset[Ref]
    linear: Linear | None  # left - right, if both are linear
    plain: tuple[Ref, Ref] | None = None  # both sides, if each is one column

    @property
    def axes(self) -> set[str]:
        return {a for a, _ in self.refs}

    def column(self, floats: frozenset[Ref] = frozenset()) -> Column:
        """The condition. Comparisons with NaN are false (``!=``: true), which matters where a column can hold one."""
        l, r = self.left, self.right
        out = {"==": l == r, "!=": l != r, "<": l < r, "<=": l <= r, ">": l > r, ">=": l >= r}[self.op]
        if self.refs & floats:
            a, b = F.isnan(l.cast("double")), F.isnan(r.cast("double"))
            out = (out | a | b) if self.op == "!=" else out & ~a & ~b
        return out


def _over(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(F.isnan(a), a).otherwise(by_zero))


def _walk(node: ast.AST, refs: set[Ref]) -> tuple[Column, Linear | None]:
    match node:
        case ast.Subscript(value=ast.Name(id=name), slice=ast.Name(id=axis)):
            refs.add((axis, name))
            return ref_column((axis, name)), Linear((((axis, name), 1.0),))
        case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return F.lit(v), Linear((), float(v))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            c, lin = _walk(x, refs)
            return -c, lin and lin.times(-1.0)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _walk(x, refs)
        case ast.BinOp(left=x, op=op, right=y):
            (a, la), (b, lb) = _walk(x, refs), _walk(y, refs)
            match op:
                case ast.Add():
                    return a + b, la.plus(lb) if la and lb else None
                case ast.Sub():
                    return a - b, la.plus(lb, -1.0) if la and lb else None
                case ast.Mult():
                    if la and lb and not (la.terms and lb.terms):
                        return a * b, lb.times(la.const) if lb.terms else la.times(lb.const)
                    return a * b, None
                case ast.Div():
                    by = lb is not None and not lb.terms and lb.const != 0
                    return (a.cast("double") / b) if by else _over(a, b), la.times(1 / lb.const) if la and by else None
    raise ValueError(f"not supported in a predicate: {ast.unparse(node)}")


def parse_predicate(text: str) -> Predicate:
    """Reads one comparison; never evaluates code."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"can't read the predicate {text!r}") from e
    if not isinstance(node, ast.Compare) or len(node.ops) != 1 or type(node.ops[0]) not in _COMPARE:
        raise ValueError(f"{text!r} isn't a single comparison")
    refs: set[Ref] = set()
    (l, ll), (r, lr) = _walk(node.left, refs), _walk(node.comparators[0], refs)
    plain = None
    if ll and lr and not ll.const and not lr.const and all(len(x.terms) == 1 and x.terms[0][1] == 1 for x in (ll, lr)):
        plain = ll.terms[0][0], lr.terms[0][0]
    return Predicate(text, _COMPARE[type(node.ops[0])], l, r, frozenset(refs), ll.plus(lr, -1.0) if ll and lr else None, plain)
