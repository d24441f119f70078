import random
import re

import brute

import corpus_pipeline
from tessera.llm.near_copies import MAPS, bitmaps, keep_one_near, near_components, prefixes, shingle_sets


def grams(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER))
    return frozenset(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def components(rows):
    """(doc_id, text) -> component id by shingle set, from the similarity of all pairs."""
    sets = sorted({grams(t) for _, t in rows}, key=sorted)
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                up[root(a)] = root(b)
    at = {s: root(k) for k, s in enumerate(sets)}
    least = {}
    for i, t in rows:
        if i is not None:
            c = at[grams(t)]
            least[c] = min(i, least.get(c, i))
    return {t: least.get(at[grams(t)]) for _, t in rows}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def docs_of(r):
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(20, 200))]
        for _ in range(6):
            rows.append((i, edited(r, base, r.randrange(len(base) // 16 + 2))))
            i += 1
    chain = [f"c{k}" for k in range(104)]
    rows += [(200 + k, " ".join(chain[8 * k :] + [f"d{x}" for x in range(8 * k)])) for k in range(6)]
    common = [f"p{k}" for k in range(30)]
    rows += [(300 + k, " ".join(common + [f"q{k}-{x}" for x in range(40)])) for k in range(30)]
    return rows + [(3, None), (161, ""), (162, " \t"), (None, rows[0][1]), (163, "one two"), (164, "One  two"), (165, "a b c d e"), (None, "nothing like it")]


def test_sets():
    r = random.Random(6)
    texts = ["", " \n", "One", "a B c d e", "a B c d e f", "É a\x0bb c\x1cd e f"] + [edited(r, ["x", "y", "z"] * 9, 4) for _ in range(30)]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    for a, x in zip(texts, sets, strict=True):
        for b, y in zip(texts, sets, strict=True):
            assert len(set(x.tolist()) & set(y.tolist())) == len(grams(a) & grams(b))


def test_prefixes_and_bitmaps_lose_no_pair():
    import numpy as np

    r = random.Random(11)
    texts = ["", "one two"]
    for _ in range(30):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(8, 120))]
        texts += [edited(r, base, r.randrange(len(base) // 8 + 1)) for _ in range(6)]
    sets = shingle_sets([t.encode() for t in texts])
    tokens = np.unique(np.concatenate(sets))
    times = np.array([r.randrange(1, 9) for _ in range(len(tokens) // 2)])
    for keys in (tokens[: len(times)], tokens[:0]):
        pre, maps, found = prefixes(sets, (keys, times[: len(keys)])), bitmaps(sets), 0
        assert maps.shape == (len(sets), MAPS)
        for i, a in enumerate(sets):
            for j in range(i):
                both, apart = len(np.intersect1d(a, sets[j])), len(np.setxor1d(a, sets[j]))
                assert np.bitwise_count((maps[i] ^ maps[j]).view(np.uint64)).sum() <= apart
                if len(a) and 10 * both >= 8 * len(np.union1d(a, sets[j])):
                    assert set(pre[i].tolist()) & set(pre[j].tolist())
                    found += 1
        assert found > 20


def test_components_against_all_pairs(spark):
    for seed in (7, 8):
        rows = docs_of(random.Random(seed))
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")
        comp = components(rows)
        got = near_components(df).collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted(((i, comp[t]) for i, t in rows), key=key)
        gone = {i for i, t in rows if i is not None and comp[t] != i}
        kept = keep_one_near(df).select("doc_id", "text", "n", "node").collect()
        assert sorted(map(repr, map(tuple, kept))) == sorted(repr((i, t, 1, "x")) for i, t in rows if i not in gone)
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_removes_near_copies_and_only_those(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    one, two = list(base), list(base)
    for k in (30, 90, 150):
        one[k] = f"other{k}"
    for k in range(5, 200, 15):
        two[k] = f"other{k}"
    rows = [(1, " ".join(base)), (2, " ".join(one)), (3, " ".join(two)), (4, edited(r, base[::-1], 2))]
    assert (brute.fingerprint(rows[0][1]) ^ brute.fingerprint(rows[1][1])).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
