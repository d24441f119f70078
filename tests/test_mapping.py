"""Mapping: strategies agree with each other and with plain Python, on data whose ends often touch."""

import itertools
import random
import time

import pytest

from tessera.functions import output_bounds, parse_algebra, parse_notation, parse_predicate
from tessera.operators import mapping
from tessera.sources import synth_pieces


def frame(spark, rows, *cols):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "piece long, " + ", ".join(f"{c} double" for c in cols))


def ranges(r, n, dims=1):
    return [tuple(r.randrange(-5, 6) for _ in range(2 * dims)) for _ in range(n)]  # inverted ones too


def ids(df):
    return sorted(map(tuple, df.collect()))


def compare(spark, frames, output, where, strategies):
    rows = {a: [tuple(x) for x in df.collect()] for a, df in frames.items()}
    cols = {a: df.columns for a, df in frames.items()}
    code = [compile(w.replace("[", "__").replace("]", ""), w, "eval") for w in where]
    want = []
    for combo in itertools.product(*rows.values()):
        names = {f"{c}__{a}": v for (a, cs), row in zip(cols.items(), combo) for c, v in zip(cs, row)}
        if all(eval(c, {}, names) for c in code):
            at = dict(zip(frames, combo))
            want.append(tuple(at[a][0] for a in output))
    for s in strategies:
        assert ids(mapping(frames, output, where, s)) == sorted(want), s
    return want


@pytest.mark.parametrize("one", ["<", "<="])
@pytest.mark.parametrize("two", ["<", "<="])
def test_overlap(spark, one, two):
    r = random.Random(one + two)
    a, b = (frame(spark, ranges(r, 30), "lo", "hi") for _ in "ab")
    assert compare(spark, {"A": a, "B": b}, ["B", "A"], [f"lo[A] {one} hi[B]", f"lo[B] {two} hi[A]"], ["auto", "binned", "theta"])


def test_two_dimensions_and_three_axes(spark):
    r = random.Random(2)
    frames = {x: frame(spark, ranges(r, 12, 2), "x_lo", "x_hi", "y_lo", "y_hi") for x in "ABC"}
    where = [f"{d}_lo[{p}] < {d}_hi[{q}]" for d in "xy" for p in "ABC" for q in "ABC" if p != q]
    compare(spark, frames, ["A", "B", "C"], where, ["auto", "theta"])


def test_points_equalities_and_same_axis(spark):
    r = random.Random(3)
    p = frame(spark, [(r.randrange(6), r.randrange(4)) for _ in range(40)], "at", "k")
    q = frame(spark, [(*x, r.randrange(4)) for x in ranges(r, 30)], "lo", "hi", "k")
    for where in (
        ["lo[Q] <= at[P]", "at[P] <= hi[Q]"],
        ["k[P] == k[Q]", "lo[Q] < at[P]", "at[P] < hi[Q]"],
        ["k[P] == k[Q]", "lo[Q] < hi[Q]"],
        ["2 * at[P] - 1 == lo[Q] + k[Q]"],
        ["at[P] + 1 >= lo[Q]", "at[P] - 1 <= hi[Q]"],
        ["at[P] * k[P] > lo[Q]"],
        ["at[P] != lo[Q]", "-k[P] < lo[Q] / 2"],
    ):
        compare(spark, {"P": p, "Q": q}, ["P", "Q"], where, ["auto", "theta"])


def test_offsets_of_a_third_axis(spark):
    r = random.Random(4)
    m, i = (frame(spark, [(r.randrange(8), r.randrange(8)) for _ in range(20)], "x", "y") for _ in "mi")
    w = frame(spark, [(-1, 0, 0, 1), (0, 1, -1, 0), (90, 91, 0, 1)], "x_lo", "x_hi", "y_lo", "y_hi")
    where = [c for d in "xy" for c in (f"{d}[I] >= {d}[M] + {d}_lo[W]", f"{d}[I] < {d}[M] + {d}_hi[W]")]
    compare(spark, {"M": m, "I": i, "W": w}, ["M", "I", "W"], where, ["auto", "theta"])


def test_any_operand_order_and_extremes(spark):
    r = random.Random(5)
    i, j = (frame(spark, [(r.randrange(5),) for _ in range(10)], "at") for _ in "ij")
    ij = frame(spark, [(r.randrange(5), r.randrange(5)) for _ in range(15)], "i", "j")
    compare(spark, {"I": i, "J": j, "T": ij}, ["I", "J", "T"], ["i[T] == at[I]", "j[T] == at[J]"], ["auto", "theta"])
    inf, nan = float("inf"), float("nan")
    a = frame(spark, [(-inf, inf), (-inf, 0), (5, inf), (1, 2), (nan, 1), (-1e308, 1e308)], "lo", "hi")
    b = frame(spark, [(0, 1), (-inf, -5), (7, 7), (2, nan), (inf, inf)], "lo", "hi")
    compare(spark, {"A": a, "B": b}, ["A", "B"], ["lo[A] <= hi[B]", "lo[B] <= hi[A]"], ["auto", "theta"])
    nothing = frame(spark, [], "lo", "hi")
    assert ids(mapping({"A": a, "B": nothing}, ["A", "B"], ["lo[A] < hi[B]", "lo[B] < hi[A]"])) == []


def test_division_by_zero_is_ieee(spark):
    a = frame(spark, [(1, 0), (-1, 0), (0, 0), (4, 2)], "x", "d")
    got = ids(mapping({"A": a}, ["A"], ["x[A] / d[A] > 1"]))
    assert got == [(0,), (3,)]


def test_errors(spark):
    a = frame(spark, [(1, 2)], "lo", "hi")
    for where in ([], ["lo[A] < hi[B] < 3"], ["lo[A] < f(hi[B])"], ["lo[A] < hi[C]"], ["zz[A] < hi[B]"], ["lo[A] < 1 or hi[B] < 2"], ["lo[A] < 5"], ["lo[A] +"]):
        with pytest.raises(ValueError):
            mapping({"A": a, "B": a}, ["A", "B"], where)
    with pytest.raises(ValueError):
        mapping({"A": a, "B": a}, ["A", "B"], ["lo[A] < hi[B]"], "equi")
    assert len(ids(mapping({"A": a, "B": a}, ["A", "B"], [], outer=True))) == 1


def test_plans(spark):
    a = frame(spark, [(1, 2)], "lo", "hi")
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    binned = text(mapping({"A": a, "B": a}, ["A", "B"], ["lo[A] < hi[B]", "lo[B] < hi[A]"]))
    assert "Generate explode" in binned and "Python" not in binned
    assert "Generate" not in text(mapping({"A": a, "B": a}, ["A", "B"], ["lo[A] == lo[B]", "hi[A] < hi[B]"]))


def test_matches_grow_with_skew(spark):
    count = []
    for skew in (0.0, 1.0):
        a, b = (synth_pieces(spark, 200, ["[)"], [64.0], skew, seed).df for seed in (11, 22))
        count.append(mapping({"A": a, "B": b}, ["A", "B"], ["x0_lo[A] < x0_hi[B]", "x0_lo[B] < x0_hi[A]"]).count())
    assert count[1] > count[0] > 0


def test_notation():
    n = parse_notation("ij, j -> i", [2, 1])
    assert n.inputs == ("ij", "j") and n.where == {"i": [(0, 0)], "j": [(0, 1), (1, 0)]}
    assert parse_algebra("y(i) = A(i,j) * x(j) * s") == (("y", "i"), [("A", "ij"), ("x", "j"), ("s", "")])
    for bad in ("y(i)", "y = ", "y = A(i) * ", "y = A(i", "= "):
        with pytest.raises(ValueError):
            parse_algebra(bad)
    assert [output_bounds(c) for c in (["[)", "[]"], ["(]", "[]"], ["()", "[]"], ["[]", "P"], ["[)", "(]"])] == ["[)", "(]", "()", "P", "()"]
    p = parse_predicate("2 * (a[A] - 1) < -b[B] / 4")
    assert dict(p.linear.terms) == {("A", "a"): 2.0, ("B", "b"): 0.25} and p.linear.const == -2.0


def test_many_short_ranges_and_a_few_wide_ones(spark):
    """Neither a ceiling on bins nor a few wide ranges makes short ranges meet in crowded bins."""
    n = 300_000
    short = spark.range(n).selectExpr("id AS piece", "id * 1.0 AS lo", "id + 0.75 AS hi")
    other = spark.range(n).selectExpr("id AS piece", "id + 0.5 AS lo", "id + 1.25 AS hi")
    wide = spark.range(n, n + 3).selectExpr("id AS piece", f"(id - {n}) * 1000.0 AS lo", f"{n} * 1.0 AS hi")
    where = ["lo[A] < hi[B]", "lo[B] < hi[A]"]
    start = time.perf_counter()
    got = mapping({"A": short.union(wide), "B": other}, ["A", "B"], where)
    # Each short range meets two neighbours (the first one only one), each wide one all that start after its start.
    assert got.count() == 2 * n - 1 + 3 * n - sum(max(0, k * 1000 - 1) for k in range(3))
    assert time.perf_counter() - start < 60


def test_levels_against_all_pairs(spark):
    r = random.Random(6)
    for _ in range(3):
        size = lambda: 10.0 ** r.randrange(-6, 7) * r.choice((0.0, 1.0, r.random()))
        rows = lambda n: [(x := r.uniform(-1, 1) * 10.0 ** r.randrange(-3, 4), x + size()) for _ in range(n)]
        a, b = (frame(spark, rows(60), "lo", "hi") for _ in "ab")
        compare(spark, {"A": a, "B": b}, ["A", "B"], ["lo[A] <= hi[B]", "lo[B] <= hi[A]"], ["auto"])


def test_ids_of_any_type(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "piece string, at double")
    b = spark.createDataFrame([((1, "k"), 2.0)], "piece struct<n: int, k: string>, at double")
    (row,) = mapping({"A": a, "B": b}, ["A", "B"], ["at[A] == at[B]"]).collect()
    assert row["A_piece"] == "y" and tuple(row["B_piece"]) == (1, "k")
