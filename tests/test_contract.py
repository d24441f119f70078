"""Hand-checked contractions, and contractions against a plain-Python version on random integer boxes."""

import math
import random

import pytest

from tessera.operators import coalesce, contract, contract_algebra, contract_rows, overlap_exists
from tessera.sources import Axis, PieceTable


def table(spark, bounds, rows):
    """rows: (coordinates..., value); a range takes two coordinates."""
    axes, names = [], []
    for k, b in enumerate(bounds):
        cols = [f"x{k}_at"] if b == "P" else [f"x{k}_lo", f"x{k}_hi"]
        axes.append(Axis(b, *cols))
        names += cols
    schema = "piece long, " + ", ".join(f"{n} double" for n in [*names, "value"])
    return PieceTable.of(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], schema), axes)


def rows_of(t):
    return sorted(tuple(r) for r in t.df.select(*[c for a in t.axes for c in a.columns], t.value).collect())


GOLDEN = [
    ("i,i->i", [(["[)"], [(0, 2, 2), (5, 7, 3)]), (["[)"], [(1, 3, 10), (6, 8, 20)])], ("[)",), [(1, 2, 20), (6, 7, 60)]),
    ("i,i->i", [(["P"], [(1, 10), (2, 20), (5, 30)]), (["P"], [(2, 1), (5, 2), (9, 3)])], ("P",), [(2, 20), (5, 60)]),
    ("i,i->i", [(["[]"], [(0, 1, 2), (3, 5, 4)]), (["[]"], [(1, 2, 3), (6, 9, 7)])], ("[]",), [(1, 1, 6)]),
    ("ij,i,j->i", [(["[)", "[)"], [(0, 2, 0, 1, 2), (1, 3, 5, 6, 3)]), (["[]"], [(1, 4, 10), (10, 12, 20)]),
                   (["P"], [(0.5, 100), (5.5, 200)])], ("[)",), [(1, 2, 8000), (2, 3, 6000)]),
    ("ij,j->i", [(["[)", "P"], [(0, 2, 1, 2), (5, 7, 3, 4)]), (["P"], [(1, 10), (1, 20), (3, 30)])], ("[)",),
     [(0, 2, 60), (5, 7, 120)]),
    ("ij,i->i", [(["[)", "P"], [(0, 10, 0, 1), (5, 15, 1, 1), (3, 13, 2, 1)]), (["[)"], [(2, 11, 1)])], ("[)",),
     [(2, 3, 1), (3, 5, 2), (5, 10, 3), (10, 11, 2)]),
    ("ij,jk->ik", [(["[)", "P"], [(0, 1, 0, 2), (1, 2, 1, 3)]), (["P", "[)"], [(0, 10, 11, 5), (1, 20, 21, 7), (0, 30, 31, 11)])],
     ("[)", "[)"), [(0, 1, 10, 11, 10), (0, 1, 30, 31, 22), (1, 2, 20, 21, 21)]),
    ("ij,ij->ij", [(["[)", "(]"], [(0, 2, 10, 12, 2), (4, 6, 14, 16, 3)]), (["[)", "(]"], [(1, 3, 11, 13, 5), (5, 7, 15, 17, 7)])],
     ("[)", "(]"), [(1, 2, 11, 12, 10), (5, 6, 15, 16, 21)]),
    ("ijk,k->ij", [(["[)", "[)", "P"], [(0, 2, 0, 2, 1, 2), (10, 12, 10, 12, 3, 4)]), (["P"], [(1, 10), (3, 30), (9, 99)])],
     ("[)", "[)"), [(0, 2, 0, 2, 20), (10, 12, 10, 12, 120)]),
    ("i,i,i->i", [(["[]"], [(0, 10, 2)]), (["[]"], [(1, 8, 3)]), (["[)"], [(2, 9, 5)])], ("[)",), [(2, 8, 30)]),
]


@pytest.mark.parametrize("strategy", ["auto", "theta"])
@pytest.mark.parametrize("case", GOLDEN, ids=[f"{k}:{c[0]}" for k, c in enumerate(GOLDEN)])
def test_golden(spark, case, strategy):
    equation, operands, bounds, want = case
    got = contract(equation, *[table(spark, b, r) for b, r in operands], strategy=strategy)
    assert got.bounds == bounds
    assert rows_of(got) == [tuple(map(float, r)) for r in sorted(want)]


def test_algebra(spark):
    a = table(spark, ["[)"], [(10, 40, 2), (60, 80, 3)])
    x = table(spark, ["[)"], [(20, 50, 5), (70, 90, 7), (0, 5, 11)])
    got = contract_algebra("y(i) = A(i) * x(i)", {"A": a, "x": x})
    assert rows_of(got) == [(20, 40, 10), (70, 80, 21)]


def test_scalar_output(spark):
    a, b = table(spark, ["P"], [(1, 2), (2, 3)]), table(spark, ["P"], [(1, 5), (7, 1)])
    assert rows_of(contract("i,i->", a, b)) == [(10,)]
    assert rows_of(contract("i,i->", a, table(spark, ["P"], [(9, 5)]))) == []


def test_touching_mixed_bounds_leave_an_empty_range(spark):
    got = contract("i,i->i", table(spark, ["[]"], [(0, 1, 2)]), table(spark, ["[)"], [(1, 2, 3)]))
    assert got.bounds == ("[)",) and rows_of(got) == [(1, 1, 6)]


def test_projection_transpose_diagonal_and_repeat(spark):
    a = table(spark, ["[)", "P"], [(0, 2, 5, 1), (1, 3, 6, 10)])
    assert rows_of(contract("ij->ji", a)) == [(5, 0, 2, 1), (6, 1, 3, 10)]
    assert rows_of(contract("ij->i", a)) == [(0, 1, 1), (1, 2, 11), (2, 3, 10)]
    d = table(spark, ["[)", "[)"], [(0, 2, 1, 3, 7), (0, 1, 1, 2, 9)])
    assert rows_of(contract("ii->i", d)) == [(1, 2, 7)]
    assert rows_of(contract("i->ii", table(spark, ["P"], [(4, 1)]))) == [(4, 4, 1)]


def test_coalesce_is_all_or_nothing(spark):
    boxes = table(spark, ["[)", "[)"], [(0, 10, 0, 1, 1), (3, 5, 5, 6, 1), (4, 6, 5, 6, 1)])
    got = rows_of(coalesce(boxes))
    assert len(got) == 8 and sorted(r[-1] for r in got) == [1] * 7 + [2]
    quiet = table(spark, ["[)"], [(0, 2, 0), (2, 2, 5), (2, 4, 1)])
    assert not overlap_exists(quiet).first()[0] and rows_of(coalesce(quiet)) == rows_of(quiet)
    cancel = table(spark, ["[)"], [(0, 2, 3), (1, 3, -3)])
    assert rows_of(coalesce(cancel)) == [(0, 1, 3), (2, 3, -3)]
    assert rows_of(coalesce(cancel, "never")) == rows_of(cancel)
    points = table(spark, ["P"], [(1, 2), (1, 3), (2, 4)])
    assert rows_of(coalesce(points)) == [(1, 5), (2, 4)]


def meets(x, bx, y, by):
    if bx == "P" and by == "P":
        return x[0] == y[0]
    if bx == "P":
        return meets(y, by, x, bx)
    le = lambda closed, a, b: a <= b if closed else a < b
    if by == "P":
        return le(bx[0] == "[", x[0], y[0]) and le(bx[1] == "]", y[0], x[1])
    return le(bx[0] == "[" and by[1] == "]", x[0], y[1]) and le(by[0] == "[" and bx[1] == "]", y[0], x[1])


@pytest.mark.parametrize("bx", ["[)", "(]", "[]", "()", "P"])
@pytest.mark.parametrize("by", ["[)", "[]", "P"])
def test_touching_ends_against_plain_python(spark, bx, by):
    r = random.Random(f"{bx}{by}")
    make = lambda b: [(*(r.randrange(-4, 5) for _ in range(1 if b == "P" else 2)), r.randrange(1, 5)) for _ in range(25)]
    xs, ys = make(bx), make(by)  # inverted ranges included
    want = sorted(
        (i, j, math.prod((x[-1], y[-1]))) for i, x in enumerate(xs) for j, y in enumerate(ys) if meets(x[:-1], bx, y[:-1], by)
    )
    for strategy in ("auto", "theta"):
        got = contract("i,i->i", table(spark, [bx], xs), table(spark, [by], ys), strategy=strategy, coalesce="never")
        assert sorted((r["piece0"], r["piece1"], r["value"]) for r in got.df.collect()) == want


def test_errors(spark):
    a, b = table(spark, ["P"], [(1, 2)]), table(spark, ["[)"], [(0, 2, 3)])
    with pytest.raises(ValueError):
        contract("i,j->ij", a, b)
    assert rows_of(contract("i,j->ij", a, b, outer=True)) == [(1, 0, 2, 6)]
    for bad in ("i,i", "i->i", "ij,i->i", "i,i->k"):
        with pytest.raises(ValueError):
            contract(bad, a, b)
    with pytest.raises(ValueError):
        contract("i,i->i", table(spark, ["[]"], [(0, 1, 1)]), b, strict_bounds=True)
    empty = table(spark, ["[)"], [])
    assert rows_of(contract("i,i->i", empty, b)) == []


def test_rows_and_four_operands(spark):
    got = contract_rows(spark, "i,i->i", [[{"lo0": 0, "hi0": 2}], [{"lo0": 1, "hi0": 3, "value": 4}]], [["[)"], ["[)"]])
    assert rows_of(got) == [(1, 2, 4)]
    four = [table(spark, ["[)"], [(k, 10, k + 1)]) for k in range(4)]
    assert rows_of(contract("i,i,i,i->i", *four)) == [(3, 10, 24)]
