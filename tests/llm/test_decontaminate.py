import random

import brute
from tessera.llm import decontaminate
from tessera.llm.decontaminate import ItemIndex, find_leaks, keep_uncontaminated


def case(seed, n_docs=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randrange(1, 5)))
    vocabulary = [word() for _ in range(200)] + ["É", "über"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(j, text(r.randrange(8, 60))) for j in range(12)] + [(20, "one two"), (21, "three"), (22, ""), (23, None), (24, items_dup := text(30)), (25, items_dup)]
    docs = []
    for i in range(n_docs):
        t = text(r.randrange(150))
        if r.random() < 0.5:
            w = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(3)):  # light edits
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            t = f"{t} {' '.join(x.upper() if r.random() < 0.2 else x + r.choice(['', ',', '.']) for x in w)} {text(10)}"
        docs.append((i, t))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in find_leaks(d, b).collect()}
        assert got == brute.leaks(docs, items) and len(got) >= 5
        kept = {r["doc_id"] for r in keep_uncontaminated(d, b).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 400)
    docs, items = case(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(d, b).collect()} == brute.leaks(docs, items)
    kept = {r["doc_id"] for r in keep_uncontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in brute.leaks(docs, items)}


def test_defined_cases(spark):
    item = "a b c d e f g h i j"
    d = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, item, "x"), (2, item, "x"), (None, "z " + item, "x"), (3, "a b", "x")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(7, item), (None, "a b"), (9, None)], "item_id long, text string")
    got = find_leaks(d, b).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in got) == [(-1, -1), (-1, 7), (2, -1), (2, -1), (2, 7), (2, 7), (3, -1)]
    assert keep_uncontaminated(d, b).columns == d.columns
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0
    assert keep_uncontaminated(d, b.limit(0)).count() == 6


def test_very_long_document_and_place():
    item = " ".join(f"w{k}" for k in range(30))
    text = "filler " * 200_000 + item + " tail"
    (found,) = ItemIndex([5], [item.encode()]).matches([text.encode()])
    assert found == (0, 5, 1.0, 200_000, 30)


def test_blocks_miss_no_fingerprint_within_the_radius():
    import numpy as np

    r = np.random.default_rng(1)
    index = ItemIndex(list(range(40)), [" ".join(map(str, r.integers(0, 999, 20))).encode() for _ in range(40)])
    fps = r.integers(0, 2**63, 500, dtype=np.uint64)
    for k in range(500):
        bits = r.choice(64, r.integers(0, 30), replace=False)
        fps[k] = index.groups[20][1].fps[k % 40] ^ np.uint64(sum(1 << int(b) for b in bits))
    i, j = index.near(fps, 20)
    full = np.bitwise_count(fps[:, None] ^ index.groups[20][1].fps[None, :]) <= decontaminate.RADIUS
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(full)))


def plain_similarity(a, b):
    import collections

    x, y = collections.Counter(a), collections.Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_common_counts_repeats():
    import numpy as np

    r = np.random.default_rng(2)
    a, b = r.integers(0, 6, (200, 12), dtype=np.uint64), r.integers(0, 6, (200, 12), dtype=np.uint64)
    c = decontaminate.common(decontaminate.numbered(a), decontaminate.numbered(b))
    for x, y, k in zip(a.tolist(), b.tolist(), c.tolist(), strict=True):
        assert k / (24 - k) == plain_similarity(x, y)


def test_best_window_against_all_windows():
    """Items that share a template, some with repeated shingles: the similarity and place of the best window."""
    r = random.Random(5)
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = 160
    base = [f"t{k}" for k in range(n)]
    items = [[f"x{j}" if k in (j * 6, j * 6 + 2) else w for k, w in enumerate(base)] for j in range(25)] + [["a", "b"] * (n // 2), ["a"] * n]
    text = []
    for j in (3, 9, 25, 26, 14):
        w = list(items[j])
        if r.random() < 0.7:
            w[r.randrange(n)] = "edit"
        text += [f"f{r.randrange(50)}" for _ in range(r.randrange(9))] + w
    want = {}
    for j, item in enumerate(items):
        sims = [plain_similarity(grams(text[a : a + n]), grams(item)) for a in range(len(text) - n + 1)]
        if max(sims) >= 0.8:
            want[j] = (max(sims), sims.index(max(sims)))
    got = ItemIndex(list(range(len(items))), [" ".join(w).encode() for w in items], 64).matches([" ".join(text).encode()])
    assert {j: (sim, a) for _, j, sim, a, _ in got} == want and len(want) > 10


def test_templated_benchmark_takes_little_time():
    import time

    r = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    items = [[f"x{j}" if k in (j % 60, (j * 7) % 60) else w for k, w in enumerate(base)] for j in range(3000)]
    index = ItemIndex(list(range(3000)), [" ".join(w).encode() for w in items])
    text = " ".join(w for _ in range(300) for w in (*items[r.randrange(3000)], "then"))
    start = time.perf_counter()
    found = index.matches([text.encode()])
    assert len(found) > 500 and time.perf_counter() - start < 20


def test_recall_of_the_radius():
    """Planted windows with edits, similarity 0.8 or more: how many the fingerprints keep."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(40, 200))] for _ in range(300)]
    texts = []
    for w in items:
        w = list(w)
        for _ in range(len(w) // 45):  # each edit changes five shingles
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w).encode())
    raw = [" ".join(w).encode() for w in items]
    exact = {(t, j) for t, j, *_ in ItemIndex(list(range(300)), raw, 64).matches(texts)}
    found = {(t, j) for t, j, *_ in ItemIndex(list(range(300)), raw).matches(texts)}
    assert found <= exact and len(exact) > 250 and len(found) >= 0.99 * len(exact)
