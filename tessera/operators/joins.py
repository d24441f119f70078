"""Conjunctive joins of several relations: equality keys where there are any, bins where ranges meet, else comparison.

A step joins one more axis to those joined so far. With equalities it is an equi-join and everything else is residual.
Otherwise, if one predicate bounds the new side from below and one from above, both sides' ranges are cut into bins and
joined on the bin, with the exact predicates as residual and each pair kept only in the first bin that both have.

Bins come in levels, each with bins STEP times as wide as the one below. A range's home is the first level whose bins are
as wide as the range; pairs meet in the home of the wider one, which the narrower one visits. As a rule one level will do,
that of the average width: its bins are at most twice as many as the ranges (plus one each). Where most ranges are much
narrower than the average, they get levels of their own, and so do ranges that would have very many bins. So neither the
number of bins nor the width of a range is limited, and a few wide ranges don't crowd the others into wide bins. Predicates
that bound further axes add bins on up to MORE_AXES of them, one level each. Ranges beyond the other side's span are
dropped first. Bins are plain join keys, so crowded ones are split by adaptive execution's skew join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicates import FLIPPED, Linear, Predicate, Ref, joined_name

STRATEGIES = ("auto", "equi", "binned", "theta")
STEP = 2.0
#: Ranges so many levels below the average get levels of their own, where these shares are as narrow or narrower.
FAR_BELOW, SHARES = 6, (0.25, 0.99)
#: The widest ranges get a level of their own if it is so many levels above the average.
FAR_ABOVE = 10
MORE_AXES = 2
#: Levels of points and of endless ranges; both are then held within LEVELS levels below the whole span's.
_POINT, _ENDLESS, LEVELS = -9999, 9999, 50


@dataclass(frozen=True)
class Band:
    """Ranges that meet if the predicates hold: [left_lo, left_hi] of the joined side and [right_lo, right_hi]."""

    left: tuple[Column, Column]
    right: tuple[Column, Column]
    score: tuple
    typical: tuple[str, tuple[Column, Column]] | None = None  # an axis of the joined side, and its own range
    refs: frozenset[Ref] = field(default=frozenset())


def prefixed(axis: str, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(joined_name((axis, c))) for c in df.columns])


def float_refs(frames: dict[str, DataFrame]) -> frozenset[Ref]:
    return frozenset(
        (a, f.name) for a, df in frames.items() for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    )


def _alike(a: Linear, b: Linear) -> int:
    """Length of the common beginning of the first columns' names, without the axis's own name."""
    if not a.terms or not b.terms:
        return 0
    (xa, x), (ya, y) = a.terms[0][0], b.terms[0][0]
    x, y = x.removeprefix(xa).lstrip("_"), y.removeprefix(ya).lstrip("_")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def find_bands(preds: list[Predicate], joined: set[str], new: str) -> list[Band]:
    """Pairs of predicates that bound the new axis from both sides, the best first, no column in two of them."""
    below: dict[Linear, list[Linear]] = {}  # right expression -> left expressions that are at most it
    above: dict[Linear, list[Linear]] = {}  # right expression -> left expressions that are at least it
    for p in preds:
        if p.linear is None or p.op in ("==", "!=") or new not in p.axes or not p.axes & joined:
            continue
        mine, other = p.linear.part({new}), p.linear.part(joined)
        # left - right = other + mine + const  op  0
        op, sign = (p.op, -1.0) if mine.terms[0][1] < 0 else (FLIPPED[p.op], 1.0)
        right = mine.times(sign)
        left = Linear(other.terms, p.linear.const).times(-sign)
        (below if op in ("<", "<=") else above).setdefault(right, []).append(left)
    found = []
    for high, lows in below.items():
        for low, highs in above.items():
            l1 = [x.column() for x in lows]
            l2 = [x.column() for x in highs]
            lo = F.greatest(*l1) if len(l1) > 1 else l1[0]
            hi = F.least(*l2) if len(l2) > 1 else l2[0]
            score = (low == high, _alike(low, high), len(lows) + len(highs))
            alone = lambda x: {r[0] for r, _ in x.terms}
            own = next(((x, y) for x in lows for y in highs if len(alone(x)) == 1 and alone(x) == alone(y)), None)
            typical = own and (*alone(own[0]), (own[0].column(), own[1].column()))
            refs = frozenset(r for x in (*lows, *highs, low, high) for r, _ in x.terms)
            found.append(Band((lo, hi), (low.column(), high.column()), score, typical, refs))
    out: list[Band] = []
    for band in sorted(found, key=lambda b: b.score, reverse=True):
        if not any(band.refs & b.refs for b in out):
            out.append(band)
    return out


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < math.inf, c)


def _level(ends: tuple[Column, Column]) -> Column:
    """The first level whose bins are as wide as the range."""
    w = F.greatest(*ends) - F.least(*ends)
    level = F.ceil(F.log(w) / math.log(STEP)).cast("int")
    return F.when(F.isnan(w), _POINT).when(w == math.inf, _ENDLESS).when(w > 0, level).otherwise(_POINT)


def _widths(df: DataFrame, bands: list[tuple[Column, Column]]) -> DataFrame:
    """One row: levels of the first range (least, at SHARES, largest) and its average width; for each range the finite
    span, the whole span and the largest width."""
    own, (x, y) = _level(bands[0]), bands[0]
    cols = [F.percentile_approx(own, list(SHARES), 100).alias("at"), F.min(own).alias("least"), F.max(own).alias("top"),
            F.avg(_finite(F.abs(x - y))).alias("mean")]
    for k, ends in enumerate(bands):
        x, y = F.least(*ends), F.greatest(*ends)
        cols += [F.min(_finite(x)).alias(f"low{k}"), F.max(_finite(y)).alias(f"high{k}"), F.max(y - x).alias(f"most{k}"),
                 F.min(x).alias(f"from{k}"), F.max(y).alias(f"to{k}")]
    return df.agg(*cols)


@dataclass(frozen=True)
class Bins:
    """Bins of one axis: the finite span that both sides' ends are held to, and each side's own span."""

    low: float
    high: float
    size: float
    spans: tuple[tuple[float, float], tuple[float, float]]


def _levels(one: Row, two: Row, guess: bool) -> tuple[list[int], list[tuple[int, int]]]:
    """The levels in use, at most four, and of each side the first and last index of a level that it can have homes in.
    guess: one is of other ranges than the left side's, which are no wider."""
    span = max(one["high0"] or 0.0, two["high0"] or 0.0) - min(one["low0"] or 0.0, two["low0"] or 0.0)
    level = lambda w: math.ceil(math.log(w, STEP)) if w > 0 else _POINT
    top = level(span) if 0 < span < math.inf else 1024 if span else 0
    held = lambda x: max(min(x, top), top - LEVELS)
    middle = held(level(max(one["mean"] or 0.0, two["mean"] or 0.0)))
    levels = {middle}
    for k in range(len(SHARES)):
        if middle - (x := max(held(one["at"][k]), held(two["at"][k]))) > FAR_BELOW:
            levels.add(x)
    if (x := max(held(one["top"]), held(two["top"]))) - middle > FAR_ABOVE:
        levels.add(x)
    out = sorted(levels)
    home = lambda x: next((k for k, l in enumerate(out) if held(x) <= l), len(out) - 1)
    return out, [(0 if guess and k == 0 else home(r["least"]), home(r["top"])) for k, r in enumerate((one, two))]


def binned_join(
    left: DataFrame,
    right: DataFrame,
    band: Band,
    condition: Column,
    width: float | None = None,
    base: DataFrame | None = None,
    more: tuple[Band, ...] = (),
) -> DataFrame:
    """Inner join on condition, which must imply that the band's ranges meet, and those of more.

    The join is lazy, but the widths are read at once, by one aggregation over both sides. base, if given, holds the band's
    typical axis: its ranges stand for those of the joined side, which are no wider. width, if given, is the bin size of
    the only level."""
    guess = base is not None and band.typical is not None
    if guess:
        more = tuple(b for b in more if b.typical and b.typical[0] == band.typical[0])
    bands = [band, *more]
    ends = [[b.left for b in bands], [b.right for b in bands]]
    stats = _widths(base if guess else left, [b.typical[1] for b in bands] if guess else ends[0])
    one, two = sorted(stats.withColumn("side", F.lit(0)).union(_widths(right, ends[1]).withColumn("side", F.lit(1))).collect(), key=lambda r: r["side"])
    if one["least"] is None or two["least"] is None:  # an empty side
        return left.join(right, condition & F.lit(False))
    axes = []
    for k in range(len(bands)):
        low, high = min(one[f"low{k}"] or 0.0, two[f"low{k}"] or 0.0), max(one[f"high{k}"] or 0.0, two[f"high{k}"] or 0.0)
        most = max(one[f"most{k}"] or 0.0, two[f"most{k}"] or 0.0)
        size = most if 0 < most < math.inf else high - low
        axes.append(Bins(low, high, size if 0 < size < math.inf else 1.0, tuple((r[f"from{k}"], r[f"to{k}"]) for r in (one, two))))
    levels, homes = ([0], [(0, 0)] * 2) if width else _levels(one, two, guess)
    sizes = [float(width)] if width else [STEP**x if x < 1024 else math.inf for x in levels]
    top = levels[-1]

    def bins(df: DataFrame, side: int) -> DataFrame:
        name, other = "lr"[side], 1 - side
        for k, (x, y) in enumerate(ends[side]):
            (first, last) = axes[k].spans[other]
            df = df.where((F.greatest(x, y) >= F.lit(first)) & (F.least(x, y) <= F.lit(last)))
        size = F.lit(sizes[0])
        if len(levels) > 1:
            own = _level(ends[side][0])
            entries = []  # 10 times the level, plus 0: both at home, 1: the left side at home, 2: the right side at home
            for k, x in enumerate(levels):
                under = own > levels[k - 1] if k else F.lit(True)
                at_home = under & (F.lit(True) if x == top else own <= x)
                entries.append(F.when(at_home, F.lit(10 * k)))
                if homes[other][0] < k:
                    entries.append(F.when(at_home, F.lit(10 * k + 1 + side)))
                if k and homes[other][0] <= k <= homes[other][1]:
                    entries.append(F.when(~under, F.lit(10 * k + 2 - side)))
            df = df.withColumn(f"__lev_{name}", F.explode(F.array_compact(F.array(*entries))))
            size = F.element_at(F.array(*map(F.lit, sizes)), F.floor(F.col(f"__lev_{name}") / 10).cast("int") + 1)
        for k, (x, y) in enumerate(ends[side]):
            wide = size if k == 0 else F.lit(axes[k].size)
            low, high = F.lit(axes[k].low), F.lit(axes[k].high)
            # Halves, as the whole span may be more than a double holds.
            place = lambda c: F.floor((F.greatest(F.least(c, high), low) / 2 - low / 2) / (wide / 2))  # noqa: E731, B023
            first, last = place(F.least(x, y)), place(F.greatest(x, y))
            df = df.withColumns({f"__first{k}_{name}": first, f"__bin{k}_{name}": F.explode(F.sequence(first, last))})
        return df

    both, work = condition, []
    if len(levels) > 1:
        both &= F.col("__lev_l") == F.col("__lev_r")
        work += ["__lev_l", "__lev_r"]
    for k in range(len(bands)):
        both &= (F.col(f"__bin{k}_l") == F.col(f"__bin{k}_r")) & (F.col(f"__bin{k}_l") == F.greatest(f"__first{k}_l", f"__first{k}_r"))
        work += [f"__{n}{k}_{x}" for n in ("first", "bin") for x in "lr"]
    return bins(left, 0).join(bins(right, 1), both).drop(*work)


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _is_key(p: Predicate, joined: set[str], new: str) -> bool:
    """An equality between the joined side and the new one, each side of it over one of them."""
    if p.op != "==" or p.linear is None or new not in p.axes or not p.axes & joined:
        return False
    return all(any(r[0] == new for r, _ in part.terms) != any(r[0] != new for r, _ in part.terms) for part in _sides(p, new))


def _sides(p: Predicate, new: str) -> list[Linear]:
    return [p.linear.part({new}), p.linear.part(p.axes - {new})]


def _key(p: Predicate, new: str) -> Column:
    """The equality in the form that the planner takes as a join key: one side over each input."""
    if p.plain:
        return p.column()
    mine, other = _sides(p, new)
    return mine.column() == Linear(other.terms, p.linear.const).times(-1.0).column()


def join_axes(
    frames: dict[str, DataFrame],
    preds: list[Predicate],
    strategy: str = "auto",
    width: float | None = None,
    outer: bool = False,
) -> DataFrame:
    """Joins all axes on the predicates; columns are named axis__column. outer=True allows axes without a predicate."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} isn't one of {', '.join(STRATEGIES)}")
    floats = float_refs(frames)
    ready: dict[str, DataFrame] = {}
    for axis, df in frames.items():
        part = prefixed(axis, df)
        for p in preds:
            if p.axes == {axis}:
                part = part.where(p.column(floats))
        ready[axis] = part
    rest = [p for p in preds if len(p.axes) > 1]
    todo = list(frames)
    linked = {a for p in rest for a in p.axes}
    if not outer and len(frames) > 1 and (alone := [a for a in todo if a not in linked]):
        raise ValueError(f"no predicate joins {', '.join(alone)} to the other axes")
    first = todo.pop(0)
    out, joined = ready[first], {first}
    while todo:
        usable = lambda a: [p for p in rest if a in p.axes and p.axes <= joined | {a}]
        by = {a: usable(a) for a in todo}
        keyed = [a for a in todo if any(_is_key(p, joined, a) for p in by[a])]
        banded = [a for a in todo if find_bands(by[a], joined, a)]
        # Without a usable predicate: the smallest side first, so that a small set of offsets meets the others.
        new = (keyed or banded or [a for a in todo if by[a]] or sorted(todo, key=lambda a: _bytes(frames[a])))[0]
        todo.remove(new)
        conds = by[new]
        rest = [p for p in rest if p not in conds]
        keys = [p for p in conds if _is_key(p, joined, new)]
        bands = [] if keys and strategy in ("auto", "equi") else find_bands(conds, joined, new)
        band = bands[0] if bands else None
        full = reduce(lambda a, b: a & b, [p.column(floats) for p in conds], F.lit(True))
        if strategy == "equi" and not keys:
            raise ValueError(f"no equality joins {new}")
        if strategy == "binned" and band is None:
            raise ValueError(f"no range predicates join {new}")
        if not conds:
            out = out.crossJoin(ready[new])
        elif strategy == "theta" or (not keys and band is None):
            out = out.join(ready[new], full)
        elif keys and strategy != "binned":
            out = out.join(ready[new], reduce(lambda a, b: a & b, [_key(p, new) for p in keys]) & full)
        else:
            if band.score[0]:  # a place between both bounds: without room between them there is none
                out = out.where(band.left[0] <= band.left[1])
            base = ready[band.typical[0]] if band.typical else None
            out = binned_join(out, ready[new], band, full, width, base, tuple(bands[1 : 1 + MORE_AXES]))
        joined.add(new)
    return out
