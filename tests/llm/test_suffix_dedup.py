import random

import brute
import numpy as np

from tessera.llm import suffix_dedup as sd
from tessera.llm.pfp import corpus_order
from tessera.llm.suffix_dedup import suffix_dedup


def run(spark, rows, schema="doc_id long, text string"):
    return [tuple(r)[:5] for r in suffix_dedup(spark.createDataFrame(rows, schema)).collect()]


def corpus(seed, n=40):
    r = random.Random(seed)
    alphabet = r.choice(["ab", "abcdefgh ", "aé漢\n", "a"])
    some = lambda a, b: "".join(r.choice(alphabet) for _ in range(r.randrange(a, b)))
    pool = [some(60, 400) for _ in range(6)]
    part = lambda: r.choice([r.choice(pool), some(0, 80), r.choice(pool)[: r.randrange(300)], r.choice(pool)[r.randrange(100) :]])
    return [(i, "".join(part() for _ in range(r.randrange(5)))) for i in range(n)]


def test_corpus_order_is_suffix_order():
    r = random.Random(1)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 120))) for _ in range(r.randrange(1, 6))]
        strings += strings[:1]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        data = np.frombuffer(b"".join(strings), np.uint8)
        places = np.arange(len(data))
        suffix = {int(offsets[k]) + a: s[a:] for k, s in enumerate(strings) for a in range(len(s))}
        # Order is defined where the rest of the phrase is longer than a trigger; shorter rests stand at string ends.
        long = [p for p in places if len(suffix[p]) > 8]
        got = [suffix[int(p)] for p in np.array(long, np.int64)[corpus_order(data, offsets, np.array(long, np.int64))]] if long else []
        assert got == sorted(got)


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        rows = corpus(seed)
        monkeypatch.setattr(sd, "GROUP_BYTES", 700)
        monkeypatch.setattr(sd, "DICTIONARY_BYTES", 2000)
        monkeypatch.setattr(sd, "BUCKET_BYTES", 300)
        monkeypatch.setattr(sd, "PIECE", 9 if seed else 2048)
        assert sorted(run(spark, rows)) == sorted(brute.suffix_dedup(rows))


def test_defined_cases(spark):
    t = "".join(chr(97 + k % 23) for k in range(150)) + "end"
    rows = [(2, t), (1, t), (1, t + "x"), (3, None), (4, ""), (5, "short"), (None, t), (6, "a" * 3000)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    key = lambda r: (r[0] is None, r)
    assert sorted(run(spark, rows), key=key) == sorted(brute.suffix_dedup(sorted(rows, key=order)), key=key)
    assert run(spark, []) == []


def test_kept_bytes_and_clashing_names(spark):
    t = "é" * 80
    df = spark.createDataFrame([(1, t, "x", 1), (2, "ab" + t + "c", "x", 1)], "doc_id long, text string, kept string, k int")
    got = {r["doc_id"]: (r["kept_sha256"], brute.sha(bytes(r["kept"])), len(r["kept"])) for r in suffix_dedup(df).collect()}
    want = brute.suffix_dedup([(1, t), (2, "ab" + t + "c")])
    assert got == {i: (sha, sha, n - gone) for i, n, gone, _, sha in want} and want[0][2] == 158
