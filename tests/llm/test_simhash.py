import random

import brute
import numpy as np

from tessera.llm.components import components
from tessera.llm.simhash_dedup import PER_SHARD, SAMPLE, _star, fingerprint, fit_tree, fingerprint_links, keep_one, route, sample_of, shard_links, simhash_components


def test_fingerprints(spark):
    r = random.Random(1)
    texts = ["", "  \n", "One", "a B", "É a\x0bb c", "x " * 500]
    texts += [" ".join(r.choice("abcdefg") for _ in range(r.randrange(40))) for _ in range(50)]
    assert [fingerprint(t.encode()) for t in texts] == [brute.fingerprint(t) for t in texts]


def near(r, n):
    base = [r.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        for _ in range(r.randrange(4)):
            out.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.3))
    out |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    return np.array(sorted(out), np.uint64)


def labels(a, b, fps):
    u, v = _star(a, b, fps)
    known = dict(zip(u.tolist(), v.tolist()))
    return [known.get(x, x) for x in fps.tolist()]


def test_vantage_point_tree_finds_all_components():
    fps = near(random.Random(2), 400)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    want = labels(fps[i], fps[j], fps)
    found = list(shard_links(fps, leaf=16))
    assert labels(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), fps) == want
    shards = {}
    for label, part in route(fps, fit_tree(fps[::7], 3), 2):
        shards.setdefault(label, []).append(part)
    assert len(shards) > 4
    found = [x for parts in shards.values() for x in shard_links(np.unique(np.concatenate(parts)), leaf=16)]
    assert labels(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), fps) == want


def test_shards_keep_their_size(spark):
    """Ten times the shards, ten times the leaves: the largest holds a bounded multiple of its share."""
    r = np.random.default_rng(6)
    for depth in (8, 11):
        fps = np.unique(r.integers(0, 2**64, 100 << depth, np.uint64))
        tree = fit_tree(fps[: max(SAMPLE, PER_SHARD << depth)], depth)
        sizes = {}
        for label, part in route(fps, tree, 0):
            sizes[label] = sizes.get(label, 0) + len(part)
        assert sum(sizes.values()) == len(fps) and len(sizes) > 0.6 * 2**depth
        assert max(sizes.values()) < 20 * 100
    df = spark.createDataFrame([(int(x),) for x in fps[:5000].view(np.int64)], "fp long")
    some = sample_of(df, 5000, 500)
    assert 350 < len(some) < 650 and set(some) <= set(fps[:5000])


def test_links_over_many_shards(spark):
    fps = near(random.Random(8), 300)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = fingerprint_links(df, shard=40).toArrow()
    u, v = (got.column(c).to_numpy().view(np.uint64) for c in "uv")
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert labels(u, v, fps) == labels(fps[i], fps[j], fps)


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(up)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def docs_of(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(120)) for _ in range(8)]
    rows = [(k, r.choice(base) + r.choice(["", " " + word(), " Z"])) for k in range(60)]
    return rows + [(3, None), (61, ""), (62, " \t"), (None, base[0]), (63, "one two"), (None, "nothing like it at all")]


def test_query_against_brute_force(spark):
    rows = docs_of(random.Random(4))
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [(i, brute.fingerprint(t)) for i, t in rows]
    comp = brute.components(fps)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=key) == sorted(((i, f, comp[f]) for i, f in fps), key=key)
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one(spark):
    rows = [(i, t, "x", 5) for i, t in docs_of(random.Random(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int")
    comp = brute.components([(i, brute.fingerprint(t)) for i, t, *_ in rows])
    kept = keep_one(df).select("doc_id", "text", "fp", "rep").collect()
    gone = {i for i, t, *_ in rows if i is not None and comp[brute.fingerprint(t)] != i}
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(x) for x in rows if x[0] not in gone)
