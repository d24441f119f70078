import random
import zlib

from tessera.llm.toxicity import keep_clean, learn, score_toxicity

BAD = ["blargh", "vexxor", "grumplet"]


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    vocabulary = [word() for _ in range(150)]
    rows = []
    for i in range(n):
        toxic = r.random() < 0.3
        ws = [r.choice(vocabulary) for _ in range(r.randrange(20, 80))]
        if toxic:
            for _ in range(1 + len(ws) // 15):
                w = r.choice(BAD)
                ws.insert(r.randrange(len(ws)), w.upper() if r.random() < 0.2 else w + r.choice(["", "s", ","]))
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_held_out_accuracy_and_flags(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    toxic = {i: x for i, _, x in rows}
    got = score_toxicity(docs, learn(docs, labels)).collect()
    assert len(got) == 400
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held) > 0.9


def test_held_out_labels_are_never_read(spark):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    flipped = spark.createDataFrame(
        [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, _, x in rows], "doc_id long, toxic int"
    )
    one, two = (sorted(map(tuple, score_toxicity(docs, learn(docs, x)).collect())) for x in (labels, flipped))
    assert one == two


def test_defined_cases(spark):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    model = learn(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "blargh " * 50, "s"), (2, "word " * 300_000, "s")], "doc_id long, text string, score string")
    got = score_toxicity(odd, model).collect()
    assert len(got) == 4 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    empty = [r["score"] for r in got if r["doc_id"] == 1]
    assert empty[0] == empty[1]
    assert score_toxicity(odd.limit(0), model).count() == 0
    none = learn(docs, labels.limit(0))
    assert {r["score"] for r in score_toxicity(odd, none).collect()} == {0.0}


def test_stage_keeps_columns_and_clean_rows(spark):
    rows = corpus(300)
    docs, labels = frames(spark, rows)
    wide = docs.selectExpr("doc_id", "'x' AS lang", "text", "1 AS score")
    kept = keep_clean(wide, labels)
    assert kept.columns == wide.columns
    ids = {r["doc_id"] for r in kept.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, learn(docs, labels)).collect()}
    assert ids == {i for i, p in scores.items() if not p}


def test_one_class_gives_no_model(spark):
    rows = [(i, "a b", 1) for i in range(20)]
    docs, labels = frames(spark, rows)
    assert learn(docs, labels).scores([b"a"]).tolist() == [0.0]
    assert learn(docs.limit(0), labels.union(spark.createDataFrame([(99, 0), (98, 0)], labels.schema))).scores([b"a"]).tolist() == [0.0]


def test_counts_are_not_sampled(spark):
    rows = corpus(400)
    rare = [(1000 + k, "quonzzle " * 3 + "abcde fgh " * 10, 1) for k in range(60)]
    docs, labels = frames(spark, rows + rare)
    _, few = frames(spark, rows)
    # The sampled rows, those with the least hash, are the same without the rare rows that it doesn't hold.
    ids = [r[0] for r in labels.where("toxic = 1 AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    own = {k for k, _, _ in rare}
    unsampled = [k for k in ids[20:] if k in own]
    docs = docs.where(~docs.doc_id.isin([k for k in ids[:20] if k in own]))
    assert len(unsampled) > 20
    text = b"quonzzle abcde quonzzle fgh"
    assert learn(docs, labels, per_class=20).scores([text])[0] > learn(docs, few, per_class=20).scores([text])[0] + 0.3


def test_pruned_nodes_change_no_feature(monkeypatch):
    import numpy as np

    from tessera.llm import toxicity

    rows = corpus(300)
    texts, kind = [t.encode() for _, t, _ in rows], np.array([2 * (i % 2) + x for i, _, x in rows])

    def model():
        tables, first = [], np.zeros((2, 2))
        for k, (keys, n, up, bucket) in enumerate(toxicity.count(texts, kind)):
            own = n[:, :2] + n[:, 2:]
            if k == 0:
                first = np.stack([own.sum(axis=0), (own > 0).sum(axis=0)]).astype(float)
            tables.append((keys, own.astype(float), up))
        fitted = toxicity.fit(tables, first)
        miss = [toxicity._log_ratio(toxicity._rest(first[:1], first[1:])), *(b for _, _, b in fitted[:-1])]
        return toxicity.Model([k for k, _, _ in fitted], [r for _, r, _ in fitted], miss)

    less = model()
    monkeypatch.setattr(toxicity, "LEAST", -np.inf)
    whole = model()
    monkeypatch.setattr(toxicity, "LEAST", 2.0)
    assert sum(map(len, less.keys)) < sum(map(len, whole.keys))
    unseen = [b"blarghx zzz grumpl vexxo", b"abcde new words", *texts[:100]]
    assert np.array_equal(less.features(unseen), whole.features(unseen))
