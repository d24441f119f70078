"""The nineteen join shapes on generated pieces: strategies agree, there are rows, and matches grow with skew."""

import pytest

from tessera.plans.cases import CASES


@pytest.mark.parametrize("case", CASES, ids=[c.name for c in CASES])
def test_case(spark, case):
    counts = []
    for skew in (0.0, 1.0):
        frames = {a: df.cache() for a, df in case.frames(spark, 120, skew).items()}
        fast = sorted(map(tuple, case.run(frames).collect()))
        if skew:
            assert fast == sorted(map(tuple, case.run(frames, "theta").collect()))
        counts.append(len(fast))
    assert 0 <= counts[0] < counts[1]
