import math
import random

from tessera.llm import vafile
from tessera.llm.vafile import top_k

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=5, every=50):
    """rows in (vec_id, vector) -> {query row: [(rank, vec_id, score)]}; equal ids are told apart by their vectors."""
    ok = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q))
            out += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), **kw).collect()))


def test_random_vectors_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CANDIDATES", 40)
    monkeypatch.setattr(vafile, "QUERIES", 3)
    r = random.Random(1)
    rows = [(i, [r.randrange(-3, 4) / 8 for _ in range(6)]) for i in range(300)]
    assert run(spark, rows, every=20) == plain(rows, every=20)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(16)]) for i in range(300)]
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    single = spark.createDataFrame(rows, SCHEMA).collect()
    assert run(spark, rows) == plain([(x[0], x[1]) for x in single])


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (50, [1.0]),
            (6, [2.0]), (None, [1.0, 1.0]), (100, []), (7, [-1.0, -1.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_huge_components_are_exact_or_clipped(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e30, 5.0]), (2, [-2e30, 5.0]), (3, [0.0, 7.0])]
    got = {j: s for _, _, j, s in run(spark, rows)}
    assert got == {1: 2**63 - 1, 3: 256 * 7 * 256, 2: -(2**63)}
